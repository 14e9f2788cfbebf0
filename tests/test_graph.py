"""Small graphs worked by hand or by brute force."""

import itertools
import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from verigrain.operators import graph as G
from verigrain.operators import paths
from verigrain.operators.components import connected_components
from verigrain.plans.durable import durable


def uses_of(spark, elements):
    rows = [(i, kind, k) for k, (kind, members) in enumerate(elements) for i in members]
    return spark.createDataFrame(rows, "identity_id long, element_type string, element_key long")


@pytest.fixture(scope="module")
def triangle(spark):
    """1-2-3 each by a phone of its own, and 4 on 1."""
    return uses_of(spark, [("phone", (1, 2)), ("phone", (2, 3)), ("phone", (1, 3)), ("phone", (1, 4)), ("email", (9,))])


def edges_of(spark, pairs):
    return spark.createDataFrame(pairs, "src long, dst long")


def test_triangle(spark, triangle):
    edges = G.identity_edges(triangle)
    assert edges.count() == 4
    found = {r["identity_id"]: r["clustering"] for r in G.clustering(edges).collect()}
    assert found == {1: pytest.approx(1 / 3), 2: 1.0, 3: 1.0, 4: 0.0}
    cluster = G.detect_clusters(triangle).first()
    assert (cluster["size"], cluster["edges"], cluster["centre"], cluster["cluster_id"]) == (4, 4, 1, "cluster_1") and cluster["density"] == pytest.approx(4 / 6)
    with pytest.raises(ValueError):
        G.detect_clusters(triangle, "no such")


def test_features_of_an_identity_without_links(spark, triangle):
    ids = spark.createDataFrame([(1,), (77,)], "identity_id long")
    scores = spark.createDataFrame([(2, 0.9), (3, 0.3)], "identity_id long, score double")
    rows = {r["identity_id"]: r for r in G.feature_table(triangle, scores, ids).collect()}
    assert rows[77]["cluster_size"] == 1 and sum(rows[77]["feature_vector"]) == 1.0 and len(rows[77]["feature_vector"]) == 15
    assert rows[1]["degree"] == 3 and rows[1]["neighbor_avg_score"] == pytest.approx(0.4) and rows[1]["high_risk_neighbor_count"] == 1


def test_weights_count_an_element_once(spark):
    edges = G.identity_edges(uses_of(spark, [("ssn", (1, 2)), ("address", (1, 2)), ("address", (1, 2))])).first()
    assert edges["weight"] == pytest.approx(1.8) and edges["types"] == ["address", "ssn"] and edges["shared"] == 3


def test_hub_elements_become_stars(spark):
    uses = uses_of(spark, [("phone", tuple(range(1, 51)))])
    assert G.identity_pairs(uses).count() == 50 * 49 // 2
    assert G.identity_pairs(uses, max_fanout=10).count() == 49 and G.hub_elements(uses, 10).count() == 1
    assert {r["component"] for r in G.components(uses).collect()} == {1}


def test_neighbourhood(spark):
    uses = uses_of(spark, [("phone", (1, 2)), ("ssn", (2, 3)), ("email", (3, 4))])
    start = spark.createDataFrame([(1,)], "identity_id long")
    assert {(r["identity_id"], r["hops"]) for r in G.neighbourhood(uses, start, 2).collect()} == {(1, 0), (2, 1), (3, 2)}
    with pytest.raises(ValueError):
        G.neighbourhood(uses, start, 6)


def test_neighbourhood_reads_shared_elements_only(spark, monkeypatch):
    """10,000 elements of one identity each: the steps see the two uses of the shared one."""
    own = spark.range(10_000).select(F.lit(1).cast("long").alias("identity_id"), F.lit("email").alias("element_type"), (F.col("id") + 10).alias("element_key"))
    uses = uses_of(spark, [("phone", (1, 2))]).unionByName(own)
    written = []
    monkeypatch.setattr(G, "durable", lambda df: written.append(durable(df)) or written[-1])
    found = G.neighbourhood(uses, spark.createDataFrame([(1,)], "identity_id long"), 2)
    assert {(r["identity_id"], r["hops"]) for r in found.collect()} == {(1, 0), (2, 1)}
    assert sorted(tuple(r) for r in written[0].select("identity_id", "element_type").collect()) == [(1, "phone"), (2, "phone")]


def test_export_of_all_uses_joins_nothing(spark):
    uses = uses_of(spark, [("phone", (1, 2)), ("ssn", (2, 3)), ("email", (3, 3))]).distinct()
    nodes, edges = G.export_nodes_edges(uses)
    assert "Join" not in nodes._jdf.queryExecution().executedPlan().toString()
    assert sorted(nodes.select("kind").toPandas()["kind"]) == ["email", "identity", "identity", "identity", "phone", "ssn"] and edges.count() == 5
    nodes, edges = G.export_nodes_edges(uses, spark.createDataFrame([(3,), (3,)], "identity_id long"))
    assert {r["id"] for r in nodes.where("kind = 'identity'").collect()} == {"identity:3"} and nodes.count() == 3 and edges.count() == 2


def test_components(spark):
    pairs = [(5, 4), (4, 3), (10, 11), (7, 7), (20, 21), (21, 22), (22, 23), (23, 20), (1, 2), (2, 3), (30, 29), (29, 28)]
    got = {r[0]: r[1] for r in connected_components(edges_of(spark, pairs)).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 7: 7, 10: 10, 11: 10, 20: 20, 21: 20, 22: 20, 23: 20, 28: 28, 29: 28, 30: 28}
    assert {r[1] for r in connected_components(spark.range(1, 200).selectExpr("id src", "id + 1 dst")).collect()} == {1}
    assert connected_components(edges_of(spark, [])).collect() == []


def brandes(pairs):
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    n, out = len(near), dict.fromkeys(near, 0.0)
    for s in near:
        dist, paths, order, queue = {s: 0}, {s: 1.0}, [], deque([s])
        while queue:
            v = queue.popleft()
            order.append(v)
            for w in near[v]:
                if w not in dist:
                    dist[w] = dist[v] + 1
                    paths[w] = 0.0
                    queue.append(w)
                if dist[w] == dist[v] + 1:
                    paths[w] += paths[v]
        delta = dict.fromkeys(order, 0.0)
        for w in reversed(order):
            for v in near[w]:
                if dist[v] == dist[w] - 1:
                    delta[v] += paths[v] / paths[w] * (1 + delta[w])
            if w != s:
                out[w] += delta[w]
    return {v: b / ((n - 1) * (n - 2)) for v, b in out.items()}


def test_betweenness(spark):
    pairs = [(1, 2), (2, 3), (3, 4), (4, 5), (2, 6), (6, 4), (7, 8), (8, 9), (1, 5)]
    got = {r[0]: r[1] for r in G.betweenness(edges_of(spark, pairs)).collect()}
    assert got == pytest.approx(brandes(pairs))


def test_betweenness_takes_all_sources_in_batches(spark):
    """Two rings of 6 and a path: in batches of few rows the result is that of all at once; no size ends the exact job."""
    pairs = [(k, (k + 1) % 6) for k in range(6)] + [(10 + k, 10 + (k + 1) % 6) for k in range(6)] + [(20, 21), (21, 22)]
    edges = edges_of(spark, pairs)
    got = {r[0]: r[1] for r in G.betweenness(edges, rows_at_once=30).collect()}
    assert got == pytest.approx(brandes(pairs))


def test_betweenness_has_no_size_from_which_it_samples(spark):
    """Beyond 10,000 vertices it took 500 sources: of 3,500 paths of three, most centres then had nothing."""
    edges = spark.range(3500).selectExpr("explode(array(named_struct('src', 3 * id, 'dst', 3 * id + 1), named_struct('src', 3 * id + 1, 'dst', 3 * id + 2))) AS e").select("e.*")
    found = G.betweenness(edges)
    n = 10500
    assert found.where("identity_id % 3 = 1").count() == 3500
    wrong = found.where(f"abs(betweenness - CASE WHEN identity_id % 3 = 1 THEN 2 / ({n - 1} * {n - 2}D) ELSE 0 END) > 1e-15")
    assert wrong.count() == 0


def test_pagerank(spark):
    got = {r[0]: r[1] for r in G.pagerank(edges_of(spark, [(1, 2), (1, 3), (1, 4)]), 40).collect()}
    assert sum(got.values()) == pytest.approx(1) and got[2] == pytest.approx(got[3]) and got[1] > got[2]


def test_communities(spark):
    cliques = [list(itertools.combinations(range(k * 10, k * 10 + 5), 2)) for k in range(4)]
    edges = edges_of(spark, [p for c in cliques for p in c] + [(0, 10), (10, 20), (20, 30)]).withColumn("weight", F.lit(1.0))
    whole = connected_components(edges).select(F.col("node").alias("identity_id"), "component")
    for way in (G.louvain, G.label_propagation):
        found = way(edges)
        groups = {}
        for r in found.collect():
            groups.setdefault(r["component"], set()).add(r["identity_id"])
        assert sorted(map(sorted, groups.values())) == [list(range(k * 10, k * 10 + 5)) for k in range(4)]
        assert G.modularity(edges, found) > G.modularity(edges, whole)
        assert sorted(map(tuple, way(edges).collect())) == sorted(map(tuple, found.collect()))


def test_betweenness_in_tasks_and_by_joins(spark, monkeypatch):
    """Components that share a task, one that several tasks have, and one beyond the bound of a task, in one graph."""
    r = random.Random(9)
    crowd = sorted({tuple(sorted(r.sample(range(100, 130), 2))) for _ in range(60)})
    pairs = [(k, (k + 1) % 6) for k in range(6)] + [(10, 11), (11, 12), (20, 21)] + crowd
    wanted = pytest.approx(brandes(pairs))
    for in_task, a_task, cells in ((1000, 10**8, 10**6), (1000, 300, 40), (20, 300, 40), (0, 10**8, 10**6)):
        monkeypatch.setattr(paths, "EDGES_A_TASK", a_task)
        monkeypatch.setattr(paths, "CELLS", cells)
        assert {x[0]: x[1] for x in G.betweenness(edges_of(spark, pairs), edges_in_task=in_task).collect()} == wanted
