"""Trailing windows and latest elements against counting in plain Python; old uses are one row per element early."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from verigrain.operators import velocity as V
from verigrain.plans.durable import settings
from verigrain.sources.adapters import Tables

AT = datetime.datetime(2001, 8, 1)
FIELDS = "element_type string, element_key string, identity_key long, ssn_key long, ts timestamp_ntz, address_key long"
AS_OF = lambda: F.lit(AT).cast("timestamp_ntz")


@pytest.fixture(scope="module")
def rows():
    r = random.Random(4)
    made = [(r.choice(["phone", "email"]), str(r.randrange(6)), r.choice([None, 1, 2, 3, 4]), r.choice([None, 1, 2]), AT + datetime.timedelta(days=r.choice([-400, -181, -180, -90, -30, -5, 3])), r.randrange(3)) for _ in range(90)]
    return made + [("phone", "old", 1, 1, AT - datetime.timedelta(days=500), 1), ("phone", "none", None, None, AT, 1), ("phone", "when", 1, 1, None, 1)]


@pytest.mark.parametrize("bounded", [False, True])
def test_window_counts(spark, rows, bounded):
    kept = [r for r in rows if not bounded or (r[4] and r[4] <= AT)]
    wanted = {}
    for key in {r[:2] for r in kept}:
        own = [r for r in kept if r[:2] == key]
        n = lambda c, d: len({r[c] for r in own if r[c] is not None and r[4] and r[4] >= AT - datetime.timedelta(days=d)})
        times = [r[4] for r in own if r[4]]
        wanted[key] = (*[n(c, d) for c in (2, 3, 5) for d in V.WINDOWS], min(times, default=None), max(times, default=None))
    got = V.window_counts(spark.createDataFrame(rows, FIELDS), AS_OF(), {"i": "identity_key", "s": "ssn_key", "a": "address_key"}, bounded)
    assert {tuple(r)[:2]: tuple(r)[2:] for r in got.collect()} == wanted


def test_old_uses_are_not_expanded(spark):
    """10,000 identities used one phone long ago: it is one row once aggregated, not one for each."""
    uses = spark.range(10_000).select(F.lit("phone").alias("element_type"), F.lit("5").alias("element_key"), F.col("id").alias("identity_key"), F.col("id").alias("ssn_key"), F.lit(datetime.datetime(1999, 1, 1)).cast("timestamp_ntz").alias("ts"))
    with settings(spark, spark__sql__adaptive__enabled="false"):
        df = V.window_counts(uses, AS_OF(), {"i": "identity_key", "s": "ssn_key"})
        assert df.first()["unique_i_180d"] == 0
        df.collect()
    shuffled, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if node.getClass().getSimpleName() == "ShuffleExchangeExec":
            shuffled.append(node.metrics().get("shuffleRecordsWritten").get().value())
        todo += [node.children().apply(k) for k in range(node.children().size())]
    assert shuffled and max(shuffled) <= 100


def test_newest_uses(spark, tmp_path):
    """An order without lines, two at the same last moment, a customer that no order names, missing dates."""
    day = lambda k: datetime.date(2001, 1, k)
    orders = [(1, 7, day(3)), (2, 7, day(9)), (3, 7, day(5)), (4, 7, day(5)), (5, 8, None), (6, None, day(2)), (7, 9, day(1))]
    lines = [(1, 900, 1, 1), (3, 9, 2, 1), (3, 10, 2, 2), (4, 100, 5, 1), (5, 4, 4, 4), (6, 5, 5, 5), (7, 6, 6, 6)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderdate date").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    t = Tables(spark, str(tmp_path))
    latest = lambda uses: sorted(map(str, V.latest_elements(uses).collect()))
    assert latest(t.element_use(newest=True)) == latest(t.element_use())
    assert t.element_use(newest=True).where("identity_key = 7 AND element_type = 'address'").count() == 3


def test_fanout(spark, rows):
    df = V.fanout(spark.createDataFrame([*rows, (None, None, 5, 1, AT, 1)], FIELDS))
    assert "Expand" not in df._jdf.queryExecution().executedPlan().toString()
    wanted = {}
    for kind in ("phone", "email", None):
        own = [r for r in [*rows, (None, None, 5, 1, AT, 1)] if r[0] == kind]
        wanted[kind] = (len(own), len({r[1] for r in own} - {None}), len({r[2] for r in own} - {None}))
    assert {tuple(r)[0]: tuple(r)[1:] for r in df.collect()} == wanted


def test_uses_are_dealt_before_they_are_summed_up(spark):
    """In as many parts as asked for, since nearly every use is a pair of its own; the sums are the same."""
    rows = [("phone", str(k % 7), k % 5 if k % 11 else None, k) for k in range(200)]
    uses = spark.createDataFrame(rows, "element_type string, element_key string, identity_key int, day int").withColumn("ts", F.date_add(F.lit("2001-01-01"), F.col("day")).cast("timestamp_ntz"))
    at = F.lit("2001-08-01").cast("timestamp_ntz")
    for made in (lambda n: V.pair_writes(uses, n), lambda n: V.retention(uses, at, 100, n)[1]):
        plan = made(13)._jdf.queryExecution().executedPlan().toString()
        assert "13), REPARTITION_BY_NUM" in plan and sorted(map(str, made(13).collect())) == sorted(map(str, made(None).collect()))
