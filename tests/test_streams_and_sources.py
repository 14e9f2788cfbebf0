import datetime as dt
import json
from types import SimpleNamespace

import pandas as pd
import pytest
from pyspark.sql import functions as F

from verigrain.operators import credit as C
from verigrain.operators import learning as L
from verigrain.operators import velocity as V
from verigrain.plans import durable as D
from verigrain.sources import generators as N
from verigrain.sources import readers, sinks
from verigrain.sources.adapters import Tables
from verigrain.streaming import applications as A
from verigrain.streaming.trailing import TrailingUses


def application(k, **over):
    row = {
        "application_id": f"a{k}", "ssn_hash": "h", "dob": "1980-01-02", "first_name": "Ann", "last_name": "Lee", "address": {"street": "1 A St", "city": "Austin", "state": "TX", "zip": "73301"},
        "phone": "5551234567", "email": "a@x.com", "application_date": f"2024-01-0{1 + k % 9} 00:00:00",
    }
    return json.dumps({c: v for c, v in (row | over).items() if v is not None})


LINES = [application(1), application(1), application(2, application_type="auto_loan"), application(3, dob=None), "{broken", ""]


def test_decode(spark):
    good, bad = readers.applications(spark.createDataFrame([(x,) for x in LINES], "value string"))
    assert sorted((r["application_id"], r["application_type"], r["city"]) for r in good.collect()) == [("a1", "credit_card", "Austin")] * 2 + [("a2", "auto_loan", "Austin")]
    assert sorted(r["reason"] for r in bad.collect()) == ["malformed", "malformed", "missing dob"]


def test_stream_of_applications(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("\n".join(LINES))
    good, _ = A.application_stream(A.file_lines(spark, str(tmp_path / "in")))
    seen = []
    A.run_once(good, str(tmp_path / "c"), sinks.for_each_batch(lambda b, e: seen.extend(r["application_id"] for r in b.collect())))
    assert sorted(seen) == ["a1", "a2"]


def test_stream_of_alerts(spark, tmp_path):
    rows = [{"alert_id": str(k), "alert_type": t, "identity_hash": "h", "reported_by": "b", "reported_date": "2024-01-01 00:00:00"} for k, t in enumerate(("bust_out", "fraud_ring", "bust_out", "odd"))]
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("\n".join(map(json.dumps, rows)))
    seen = []
    A.run_once(A.alert_streams(A.file_lines(spark, str(tmp_path / "in")))["bust_out"], str(tmp_path / "c"), lambda b, e: seen.extend(r["alert_id"] for r in b.collect()))
    assert sorted(seen) == ["0", "2"]


def test_stream_is_enriched_and_scored(spark, tmp_path):
    """Scores by the rules for the known identity, alerts for high levels only, and nothing lost without a match."""
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("\n".join([application(1, ssn_hash="bad"), application(2, ssn_hash="good", device_fingerprint="d"), application(3, ssn_hash="unknown")]))
    credit = spark.createDataFrame([("bad", 7, True, True, True, 0.9), ("good", 8, False, False, False, 0.0)], "ssn_hash string, identity_key long, ssn_dob_mismatch boolean, death_master_match boolean, au_abuse_pattern boolean, phone_velocity double")
    credit = credit.withColumns({"address_velocity": F.col("phone_velocity"), "email_velocity": F.col("phone_velocity"), "is_thin_file": F.col("au_abuse_pattern"), "file_age_mismatch": F.col("au_abuse_pattern")})
    graph = spark.createDataFrame([(7, 3, 0.9, 20, 0.8)], "identity_key long, shared_ssn_count long, cluster_density double, cluster_size long, neighbor_avg_score double")
    good, _ = A.application_stream(A.file_lines(spark, str(tmp_path / "in")))
    A.score_stream(good, credit, graph, str(tmp_path / "out"), str(tmp_path / "c"))
    rows = {r["application_id"]: r for r in spark.read.parquet(str(tmp_path / "out/scores")).collect()}
    assert set(rows) == {"a1", "a2", "a3"} and rows["a2"]["score"] == 0 and abs(rows["a3"]["score"] - 0.03) < 1e-9
    assert rows["a1"]["identity_key"] == 7 and abs(rows["a1"]["score"] - (0.25 + 0.3 + 0.2 * 0.9 + 0.15 + 0.1 * 0.3)) < 1e-9
    alerts = [json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "out/alerts")).collect()]
    assert [a["identity_key"] for a in alerts] == [7]


def test_sessions(spark, tmp_path):
    start = dt.datetime(2023, 1, 1)
    rows = [("phone", "1", k, start + dt.timedelta(minutes=m)) for k, m in enumerate((0, 10, 25, 90, 95, 5000))]
    uses = spark.createDataFrame(rows, "element_type string, element_key string, identity_key long, ts timestamp")
    assert sorted(r["uses"] for r in A.sessions(uses).collect()) == [1, 2, 3]


def test_recent_alerts(spark):
    rows = [(str(k), f"2024-01-{k:02d} 00:00:00") for k in (1, 5, 9, 20)]
    found = A.recent_alerts(spark.createDataFrame(rows, "alert_id string, reported_date string"), F.lit("2024-01-10 00:00:00").cast("timestamp_ntz"), 7)
    assert [r["alert_id"] for r in found.collect()] == ["9", "5"]


def test_models_are_saved_and_loaded(spark, tmp_path):
    rows = spark.range(200).selectExpr("id", "id % 7 * 0.1 AS ssn_score", "id % 5 AS num_tradelines", "int(id % 7 > 3) AS is_synthetic")
    model = L.fit_scorer(rows, trees=3)
    L.save_model(model, str(tmp_path / "m"))
    L.save_model(model, str(tmp_path / "m"))
    a, b = (L.probabilities(m, rows, L.SCORER_FEATURES, "is_synthetic").select("id", "score").orderBy("id").collect() for m in (model, L.load_model(str(tmp_path / "m"))))
    assert a == b


def test_keyed_state_equals_the_batch(spark, tmp_path):
    start = dt.datetime(2023, 1, 1)
    rows = [("phone", str(k % 7), k % 23, k % 5, start + dt.timedelta(days=(k * 37) % 400)) for k in range(300)]
    uses = spark.createDataFrame(rows, "element_type string, element_key string, identity_key long, ssn_key long, ts timestamp_ntz")
    for part in range(3):  # three batches, in no order of time
        uses.where(f"identity_key % 3 = {part}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    stream = spark.readStream.schema(uses.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    A.run_once(A.trailing_velocity(stream), str(tmp_path / "c"), lambda b, e: b.withColumn("e", F.lit(e)).write.mode("append").parquet(out), "update")
    last = {r["element"]: r for r in spark.read.parquet(out).orderBy("e").collect()}
    for r in uses.groupBy("element_key").agg(F.max("ts").alias("now")).collect():
        own = V.window_counts(uses.where(F.col("element_key") == r["element_key"]), F.lit(r["now"]).cast("timestamp_ntz"), {"identities": "identity_key"}).first()
        got = last[f"phone:{r['element_key']}"]
        assert [got[f"identities_{d}d"] for d in (30, 90, 180)] == [own[f"unique_identities_{d}d"] for d in (30, 90, 180)]


def test_keyed_state_is_touched_only_where_a_batch_says(spark, tmp_path):
    """One more use of an element that 3000 identities share rewrites a few entries; after 180 idle days nothing is left."""
    start = dt.datetime(2023, 1, 1)
    batches = [[(k, start + dt.timedelta(minutes=k)) for k in range(3000)], [(5, start + dt.timedelta(days=40))], [(6, start + dt.timedelta(days=400))], [(7, start + dt.timedelta(days=395))]]
    for rows in batches:
        uses = spark.createDataFrame([("phone", "1", *r) for r in rows], "element_type string, element_key string, identity_key long, ts timestamp")
        uses.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(uses.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    seen, done = [], []
    with D.settings(spark, spark__sql__streaming__stateStore__providerClass=A.STORE):
        q = A.trailing_velocity(stream).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True)
        q = q.foreachBatch(lambda b, e: seen.extend((e, *r) for r in b.collect())).start()
        q.awaitTermination()
        done = [p.stateOperators[0].numRowsUpdated for p in q.recentProgress if p.stateOperators]
    assert [r[2:5] for r in sorted(seen)] == [(3000, 3000, 3000), (1, 3000, 3000), (1, 1, 1), (2, 2, 2)]
    assert done[0] > 3000 and done[1] < 20


class Entries(dict):
    """State of one element in plain Python, with the number of looks at it."""

    asked = 0

    def getValue(self, key):
        self.asked += 1
        return self.get(key)

    updateValue, iterator = dict.__setitem__, dict.items

    def removeKey(self, key):
        self.pop(key, None)


class Handle:
    def __init__(self):
        self.maps, self.timers = {}, []

    def getMapState(self, name, *_):
        return self.maps.setdefault(name, Entries())

    def getValueState(self, *_):
        return SimpleNamespace(get=lambda: self.maps.get("newest"), update=lambda v: self.maps.update(newest=v), clear=lambda: self.maps.pop("newest", None))

    def listTimers(self):
        return list(self.timers)

    deleteTimer, registerTimer = (lambda self, t: self.timers.remove(t)), (lambda self, t: self.timers.append(t))


def test_a_new_element_is_not_looked_up():
    """Of an element without state nothing is asked for, however many identities come; later only what a batch names."""
    uses, handle = TrailingUses(), Handle()
    uses.init(handle)
    day = 24 * 3_600_000_000

    def batch(rows):
        frame = pd.DataFrame(rows, columns=["identity", "us"])
        return next(uses.handleInputRows(("phone:1",), iter([frame]), None)).iloc[0].tolist()[1:4]

    first = [(str(k), k * day) for k in range(1, 200)] + [("5", 150 * day)]
    assert batch(first) == [31, 92, 182] and handle.maps["last"].asked == 0
    assert batch([("199", 200 * day), ("7", 199 * day)]) == [31, 92, 182] and handle.maps["last"].asked == 2
    assert batch([("x", 900 * day)]) == [1, 1, 1] and set(handle.maps["last"]) == {("x",)}


def test_windowed_counts(spark):
    uses = spark.createDataFrame([("phone", "1", 5, dt.datetime(2024, 1, 2)), ("phone", "1", 6, dt.datetime(2024, 1, 2))], "element_type string, element_key string, identity_key long, ts timestamp")
    rows = A.windowed_counts(uses, "2 days", "1 day").collect()
    assert len(rows) == 2 and all(r["uses"] == 2 and r["identities"] == 2 for r in rows)


def test_area_map_and_domain_list(spark, tmp_path):
    (tmp_path / "map.csv").write_text("area_number,year_start,year_end,state\n1,1936,1961,NH\n2,,,ME\nx,1,2,3\n")
    got = sorted(map(tuple, readers.read_area_map(spark, str(tmp_path / "map.csv")).collect()))
    assert got == [(1, 1936, 1961, "NH"), (2, None, None, "ME")]
    domains = {r["domain"] for r in readers.disposable_domains(spark.createDataFrame([(" New.Example ",), ("",), ("yopmail.com",)], "value string")).collect()}
    assert {"new.example", "yopmail.com", "grr.la"} <= domains and "" not in domains


def test_generators(spark):
    people = N.identities(spark.range(2000))
    assert sorted(map(tuple, people.collect())) == sorted(map(tuple, N.identities(spark.range(2000)).collect()))
    assert 140 < people.where("is_synthetic").count() < 260
    files = N.credit_files(people)
    assert files.where("total_balance > total_credit_limit OR authorized_user_accounts > num_tradelines").count() == 0
    lines = N.tradelines(files)
    assert lines.count() == files.agg(F.sum("num_tradelines")).first()[0]
    assert lines.where("is_authorized_user").count() == files.agg(F.sum("authorized_user_accounts")).first()[0]
    sizes = [r["count"] for r in N.fraud_rings(spark.range(30)).groupBy("ring").count().collect()]
    assert len(sizes) == 30 and min(sizes) >= 3 and max(sizes) <= 8


def test_models(spark):
    sequences = C.sequence_features(N.credit_sequences(spark.range(200)))
    train, test = L.split(sequences, "account_id", "is_bust_out")
    model = L.fit_bust_out(train, trees=10, depth=5)
    assert L.auc(L.probabilities(model, test, L.SEQUENCE_FEATURES, "is_bust_out")) > 0.9
    assert C.bust_out(sequences).where("is_bust_out").agg(F.avg("bust_out_probability")).first()[0] > C.bust_out(sequences).where("NOT is_bust_out").agg(F.avg("bust_out_probability")).first()[0]


def test_sinks(spark, tmp_path):
    scored = spark.createDataFrame([(1, "critical", 0.95), (2, "low", 0.25)], "identity_key long, risk_level string, score double")
    sinks.write_table(scored, str(tmp_path / "t"), partition_by=("risk_level",))
    assert readers.read_table(spark, str(tmp_path / "t")).count() == 2
    assert {(r["name"], r["label"]): r["value"] for r in sinks.metric_rows(scored).collect()}[("score_bucket", "0.3")] == 1.0
    assert [json.loads(r["value"])["identity_key"] for r in sinks.alert_rows(scored).collect()] == [1]


@pytest.mark.parametrize("table", ["element_use", "graph_use", "resolution_records", "emails", "streets"])
def test_adapters_need_no_action(spark, table):
    assert getattr(Tables(spark, "/root/testdata/sf0.001"), table)().schema


def test_exact_windows_of_a_table(spark):
    """Windows count each identity once, however often and however near the border it came."""
    import datetime as dt

    from verigrain.streaming import applications as A

    start = dt.datetime(2024, 1, 1)
    rows = [("device", "d", k % 3, start + dt.timedelta(hours=5 * k)) for k in range(12)] + [("device", "d", None, start), ("device", "e", 1, start)]
    uses = spark.createDataFrame(rows, "element_type string, element_key string, identity_key long, ts timestamp")
    got = {(r["window_start"], r["element_key"]): r["identities"] for r in A.exact_windows(uses, "2 days", "1 day").collect()}
    want = {}
    for day in range(-1, 3):
        begin = start + dt.timedelta(days=day)
        for key in "de":
            seen = {i for _, e, i, t in rows if e == key and i is not None and begin <= t < begin + dt.timedelta(days=2)}
            if seen:
                want[begin, key] = len(seen)
    assert got == want


def test_observed_metrics_gauges_and_latency(spark, tmp_path):
    from pyspark.sql import functions as F

    from verigrain.sources import sinks as S
    from verigrain.streaming import applications as A

    scored = spark.range(100).select((F.col("id") % 10 / 10.0).alias("score"), F.when(F.col("id") % 4 == 0, "high").otherwise("low").alias("risk_level"))
    counted, seen = S.observed(scored, "scores", scored=F.count(F.lit(1)), high=F.count_if(F.col("risk_level") == "high"), top=F.max("score"))
    counted.write.format("noop").mode("overwrite").save()
    assert seen.get == {"scored": 100, "high": 25, "top": 0.9}
    assert {(r["name"], r["label"], r["value"]) for r in S.gauge_rows("active_cases", scored, "risk_level").collect()} == {("active_cases", "high", 25.0), ("active_cases", "low", 75.0)}
    latency = S.BatchLatency()
    spark.streams.addListener(latency)
    try:
        for k in range(3):
            (tmp_path / "in").mkdir(exist_ok=True)
            (tmp_path / "in" / f"{k}.txt").write_text("a\nb\n")
        A.run_once(A.file_lines(spark, str(tmp_path / "in"), 1), str(tmp_path / "state"), lambda b, e: b.count())
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    finally:
        spark.streams.removeListener(latency)
    batches = [b for b in latency.batches if b[2]]
    assert sum(b[2] for b in batches) == 6 and len({b[1] for b in batches}) == len(batches) == 3
    found = {r["label"]: r["value"] for r in latency.rows(spark).collect()}
    values = [found[str(le)] for le in S.LATENCY_BUCKETS] + [found["+Inf"]]
    assert values == sorted(values) and values[-1] == len(latency.batches)
