"""Time-ordered target encoding against plain counting over all pairs of lines, and against SQL."""

import datetime as dt
import random
import zlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from verigrain.llm import target_encoding as E
from verigrain.llm.queries import ORACLES, QUERIES

LINES = "sale_id bigint, line_no int, item_id bigint, vendor_id bigint, flag string"
SALES = "sale_id bigint, client_id bigint, sold_at timestamp_ntz"


def tables(spark, lines, sales, items, vendors, clients):
    return (
        spark.createDataFrame(lines, LINES).selectExpr("*", "1 AS n", "2 AS at", "3 AS fold", "'x' AS kind"), spark.createDataFrame(sales, SALES).selectExpr("*", "5 AS s", "6 AS bin"),
        spark.createDataFrame(items, "item_id bigint, kind string"), spark.createDataFrame(vendors, "vendor_id bigint, nation_id int"),
        spark.createDataFrame(clients, "client_id bigint, segment string"),
    )


def brute(lines, sales, items, vendors, clients, folds=5, gap=0):
    sold = {s: (t, -1 if c is None else c) for s, c, t in sales if s is not None and t is not None}
    kind, nation, segment = dict(items), dict(vendors), dict(clients)
    rows = []
    for s, _, i, v, flag in lines:
        if s in sold:
            t, c = sold[s]
            i = -1 if i is None else i
            rows.append((s, i, v, t, zlib.crc32(str(s).encode()) % folds, flag == "returned", c, kind.get(i), nation.get(v), segment.get(c)))
    out = {}
    for s, i, v, t, fold, _, c, k, na, se in rows:
        if (s, i, v) in out:
            continue
        past = [r for r in rows if r[4] != fold and (t - r[3]) > dt.timedelta(microseconds=gap)]

        def counts(place, value):
            found = [r for r in past if place is None or r[place] == value]  # noqa: B023
            return len(found), sum(r[5] for r in found)

        rate = lambda ns, p: p if ns[0] < 1 else (1_000_000 * ns[1] + 50 * p) // (ns[0] + 50)
        p = rate(counts(None, None), 500_000)
        item, vendor, client = counts(1, i), counts(2, v), counts(6, c)
        mine = [r for r in rows if r[:3] == (s, i, v)]
        out[s, i, v] = (
            s, i, v, len(mine), sum(r[5] for r in mine), item[0], rate(item, rate(counts(7, k), p)), vendor[0], rate(vendor, rate(counts(8, na), p)),
            client[0], rate(client, rate(counts(9, se), p)),
        )
    return Counter(out.values())


def made(seed, n_sales, n_lines, seconds):
    r = random.Random(seed)
    start = dt.datetime(2024, 3, 31, 1, 0)  # an hour that some zones do not have
    some = lambda n, hot: r.choice([hot, r.randrange(n), r.randrange(n), None])
    sales = [(k, some(6, 0), None if k % 17 == 3 else start + dt.timedelta(seconds=r.randrange(seconds), microseconds=r.choice([0, 0, 1]))) for k in range(n_sales)]
    lines = [(r.choice([0, r.randrange(n_sales + 2), None if r.random() < 0.1 else r.randrange(n_sales)]), k, some(9, 7), r.choice([3, r.randrange(5)]), r.choice(["returned", "kept", None])) for k in range(n_lines)]
    lines += lines[:5]
    return lines, sales, [(k, None if k == 2 else f"k{k % 3}") for k in range(8)], [(k, k % 2) for k in range(4)], [(k, f"s{k % 2}" if k else None) for k in range(5)]


@pytest.mark.parametrize(("seed", "seconds", "gap", "rows_of_bin"), [(1, 40, 0, 32), (2, 5, 0, 2), (3, 10_000, 0, 1), (4, 300, 7_000_000, 2), (5, 1, 0, 1)])
def test_against_all_pairs(spark, monkeypatch, seed, seconds, gap, rows_of_bin):
    """Also with so few rows a bin that each key has many, and with a gap that reaches over bins."""
    monkeypatch.setattr(E, "ROWS_OF_BIN", rows_of_bin)
    monkeypatch.setattr(E, "FAN", 2)
    given = made(seed, 60, 160, seconds)
    got = E.encode_lines(*tables(spark, *given), gap=gap)
    assert Counter(tuple(r) for r in got.collect()) == brute(*given, gap=gap)


def test_empty_tables(spark):
    lines, sales, items, vendors, clients = made(6, 20, 30, 50)
    for empty in range(5):
        given = [[] if k == empty else t for k, t in enumerate((lines, sales, items, vendors, clients))]
        assert Counter(tuple(r) for r in E.encode_lines(*tables(spark, *given)).collect()) == brute(*given)


def test_other_time_zone(spark):
    given = made(7, 40, 60, 7200)
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
        got = Counter(tuple(r) for r in E.encode_lines(*tables(spark, *given)).collect())
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert got == brute(*given)


def test_query_against_sql(spark):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("sale_lines", "sales", "items", "vendors", "clients"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    want = con.sql(ORACLES["op13_target_encoding"])
    got = QUERIES["op13_target_encoding"](spark, folder)
    assert got.columns == want.columns
    assert Counter(tuple(r) for r in got.collect()) == Counter(want.fetchall())


def test_points_are_shuffled_once(spark):
    """Steps, sums of bins and moments do not each bring their own shuffle of all points."""
    rows = spark.range(3000).selectExpr("id % 2 AS k", "id * 7 % 1999 AS at", "CAST(id % 5 AS int) AS fold", "1L AS n", "id % 2 AS s")
    found = E.history(rows, ["k"], F.lit(9), 9, E.clock_of(rows, "at"), 5)
    got = {(r.k, r.at, r.fold): (r.n, r.s) for r in found.collect()}
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].splitlines()
    assert sum("REPARTITION_BY_COL" in line and "ReusedExchange" not in line for line in plan) == 1
    given = rows.collect()
    for r in given[::97]:
        past = [p for p in given if p.k == r.k and p.at < r.at and p.fold != r.fold]
        assert got[r.k, r.at, r.fold] == (len(past), sum(p.s for p in past))
