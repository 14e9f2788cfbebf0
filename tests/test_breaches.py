"""Breaches of a person are counted without meeting each of them."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from verigrain.operators import monitoring as O
from verigrain.plans.durable import settings

AT = datetime.datetime(2001, 8, 1)


def test_exposure_against_all_pairs(spark):
    """Records found by id, by e-mail, by both and by neither; one record of two rows; missing parts."""
    r = random.Random(2)
    people = [(i, r.choice([None, 1, 2, 3]), r.choice([None, "a", "b", "c"])) for i in range(40)]
    found = {k: (r.choice([0.2, 0.9, None]), AT - datetime.timedelta(days=r.randrange(600))) for k in range(25)}
    breaches = [(k, r.choice([None, 1, 2]), r.choice([None, "a", "b"]), *v) for k, v in found.items() for _ in range(2)]
    got = O.breach_exposure(
        spark.createDataFrame(people, "identity_key long, ssn_key long, email string"),
        spark.createDataFrame(breaches, "record_id long, ssn_key long, email string, severity double, found_at timestamp_ntz"), F.lit(AT).cast("timestamp_ntz"),
    )
    wanted = {}
    for i, ssn, mail in people:
        hits = {b[0] for b in breaches if (ssn and b[1] == ssn) or (mail and b[2] == mail)}
        aged = [found[k][0] * max(0.1, 1 - (AT - found[k][1]).days / 365) for k in hits if found[k][0] is not None]
        wanted[i] = (len(hits), min(1.0, sum(aged) / len(aged)) if aged else 0.0)
    rows = {x["identity_key"]: (x["breaches"], x["exposure"]) for x in got.collect()}
    assert rows.keys() == wanted.keys() and any(n > 5 for n, _ in wanted.values())
    for i, pair in wanted.items():
        assert rows[i] == pytest.approx(pair)


def test_people_do_not_meet_all_breaches(spark):
    """All share one id: no step may make a row for each person and breach."""
    people = spark.range(300).select(F.col("id").alias("identity_key"), F.lit(1).cast("long").alias("ssn_key"), F.lit("m").alias("email"))
    breaches = spark.range(300).select(F.col("id").alias("record_id"), F.lit(1).cast("long").alias("ssn_key"), F.lit("m").alias("email"), F.lit(0.5).alias("severity"), F.lit(AT).cast("timestamp_ntz").alias("found_at"))
    with settings(spark, spark__sql__adaptive__enabled="false"):
        df = O.breach_exposure(people, breaches, F.lit(AT).cast("timestamp_ntz"))
        assert {r["breaches"] for r in df.collect()} == {300}
    most, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        seen = node.metrics().get("numOutputRows")
        most = max(most, seen.get().value() if seen.isDefined() else 0)
        todo += [node.children().apply(k) for k in range(node.children().size())]
    assert 300 <= most <= 1000
