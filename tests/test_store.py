"""The keyed store against a dictionary."""

import datetime as dt

from pyspark.sql import functions as F

from verigrain.sources.store import KeyedStore

START = dt.datetime(2024, 1, 1)


def test_touch_replay_and_expiry(spark, tmp_path):
    store = KeyedStore(spark, str(tmp_path / "store"), "k", ("who",), 3)
    day = lambda n: START + dt.timedelta(days=n)
    batches = [
        (1, [("a", 5, day(0)), ("b", 7, day(0)), (None, 1, day(0)), ("n", 1, None)]),
        (4, [("a", 9, day(3)), ("a", 4, day(3)), ("c", 2, day(2))]),
        (9, [("c", None, day(8))]),
        (10, []),
    ]
    want: dict = {}
    for end, rows in batches:
        frame = spark.createDataFrame(rows, "k string, who long, at timestamp_ntz")
        for k, who, at in rows:
            if k is not None and at is not None:
                first, last, old = want.get(k, (at, at, None))
                newer = (at, who is not None, who or 0) >= (last, old is not None, old or 0)
                want[k] = (min(first, at), max(last, at), who if newer else old)
        for _ in range(2):  # run again, as after a failure
            store.merge(frame, "at", F.lit(day(end)).cast("timestamp_ntz"), 6)
            got = {r["k"]: (r["first_seen"], r["last_seen"], r["who"]) for r in store.rows().collect()}
            touched = {k for k, _, _ in rows}
            # Only buckets of touched keys are swept: what is gone must be old, what is new must be right.
            assert all(want[k] == v for k, v in got.items())
            assert all(want[k][1] < day(end) - dt.timedelta(days=6) for k in set(want) - set(got)) and touched - {None, "n"} <= set(got)
        want = {k: v for k, v in want.items() if k in got}


def test_bucket_without_rows_is_replaced(spark, tmp_path):
    store = KeyedStore(spark, str(tmp_path / "store"), "k", (), 1)
    when = F.lit(START).cast("timestamp_ntz")
    store.merge(spark.createDataFrame([("a", START)], "k string, at timestamp_ntz"), "at", when, 1)
    assert store.rows().count() == 1
    late = F.lit(START + dt.timedelta(days=9)).cast("timestamp_ntz")
    store.merge(spark.createDataFrame([("b", START)], "k string, at timestamp_ntz"), "at", late, 1)
    assert store.rows().count() == 0
