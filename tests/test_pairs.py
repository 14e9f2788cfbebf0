"""Pair joins leave nothing out for keys of very many members."""

import datetime
import itertools

from pyspark.sql import functions as F

from verigrain.operators import graph as G
from verigrain.operators import velocity as V
from verigrain.operators.pairs import block_pairs


def test_block_pairs(spark):
    rows = [("hub", m) for m in range(57)] + [("two", 3), ("two", 1), ("one", 9), (None, 4), (None, 5)]
    table = spark.createDataFrame(rows, "k string, m long")
    wanted = sorted([("hub", a, b) for a, b in itertools.combinations(range(57), 2)] + [("two", 1, 3)])
    for block in (1, 10, 1000):
        assert sorted(map(tuple, block_pairs(table, ["k"], "m", block).collect())) == wanted


def test_linked_addresses_keeps_hubs(spark):
    """Identity 0 has all addresses, others a few: most pairs reach two identities only with it."""
    held = {0: range(40), 1: range(5), 2: (3, 4, 7), 3: (30, 39), 4: (11,)}
    at = datetime.datetime(2001, 7, 1)
    uses = spark.createDataFrame([("address", a, i, at) for i, own in held.items() for a in own], "element_type string, element_key long, identity_key long, ts timestamp_ntz")
    count = {}
    for own in held.values():
        for pair in itertools.combinations(sorted(own), 2):
            count[pair] = count.get(pair, 0) + 1
    got = V.linked_addresses(uses, F.lit(datetime.datetime(2001, 8, 1)).cast("timestamp_ntz"), max_fanout=10)
    assert {tuple(r) for r in got.collect()} == {(*p, n) for p, n in count.items() if n >= 2}


def test_hub_element_pairs_all_identities(spark):
    """A phone of 1,001 identities, one above the block size: every feature sees each pair."""
    n = 1001
    uses = spark.range(1, n + 1).select(F.col("id").alias("identity_id"), F.lit("phone").alias("element_type"), F.lit(5).cast("long").alias("element_key"))
    edges = G.identity_edges(uses).persist()
    assert edges.count() == n * (n - 1) // 2 and edges.where("src < dst AND shared = 1").count() == n * (n - 1) // 2
    assert {r["degree"] for r in G.degrees(edges).select("degree").distinct().collect()} == {n - 1}
    assert G.shared_elements(uses).where(F.size("phone") == n - 1).count() == n
    assert G.component_density(edges).first()["density"] == 1.0
