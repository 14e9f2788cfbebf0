"""Communities and ranks against plain Python and SQL on small graphs."""

import collections
import random

import duckdb
import numpy as np
import pandas as pd
import pytest

from verigrain.operators import communities as C
from verigrain.operators import graph as G


def made(spark, edges):
    return spark.createDataFrame([(a, b, float(w)) for a, b, w in edges], "src long, dst long, weight double")


def rings(n_rings=5, size=5):
    """Cliques in a ring, joined by single edges: the textbook case for Louvain."""
    edges = [(r * size + i, r * size + j, 1) for r in range(n_rings) for i in range(size) for j in range(i + 1, size)]
    return edges + [(r * size, (r + 1) % n_rings * size + 1, 1) for r in range(n_rings)]


def noise(n=40, m=90, seed=2):
    r = random.Random(seed)
    return [(*pair, w) for pair, w in sorted({tuple(sorted(r.sample(range(n), 2))): 1 + k % 3 for k in range(m)}.items())]


def graphs():
    return {"rings": rings(), "noise": noise(), "pair": [(7, 9, 2.5)], "star": [(0, k, 1) for k in range(1, 9)]}


def sql_modularity(edges, labels):
    con = duckdb.connect()
    e, l = pd.DataFrame(edges, columns=["src", "dst", "w"]), pd.DataFrame(labels, columns=["v", "c"])  # noqa: F841
    return con.sql("""WITH m AS (SELECT sum(w) AS m FROM e), inner_ AS (SELECT coalesce(sum(w), 0) AS w FROM e JOIN l a ON a.v = src JOIN l b ON b.v = dst WHERE a.c = b.c),
        k AS (SELECT c, sum(w) AS k FROM (SELECT src AS v, w FROM e UNION ALL SELECT dst, w FROM e) JOIN l USING (v) GROUP BY 1)
        SELECT inner_.w / m.m - (SELECT sum((k / (2 * m.m)) ** 2) FROM k, m) FROM inner_, m""").fetchall()[0][0]


def test_a_louvain_round_deals_edges_out_once(spark, monkeypatch):
    """Edges are dealt out as lists, and once more to their other end; it was five times, of eleven exchanges."""
    plans, real = [], C.durable

    def seen(frame):
        plans.append(frame._jdf.queryExecution().executedPlan().toString())
        return real(frame)

    ways = real(C._ways(made(spark, noise())))
    nodes = real(ways.selectExpr("src AS v", "weight AS k").groupBy("v").agg({"k": "sum"}).toDF("v", "k").selectExpr("*", "0D AS loop"))
    total = nodes.selectExpr("sum(k)").first()[0]
    monkeypatch.setattr(C, "durable", seen)
    found = C._move(ways, nodes, total, 1, 1.0)
    labels = [tuple(r) for r in found.labels.collect()]
    assert sql_modularity(noise(), labels) == pytest.approx(found.modularity, abs=1e-9)
    # Six of vertices by community or by themselves, one of lists of neighbours, one of what they are told.
    assert len(plans) == 3 and all(p.count("Exchange ") <= 8 for p in plans[1:])
    assert plans[1].count("REPARTITION_BY_COL") == 1


def test_louvain_splits_long_lists(spark, monkeypatch):
    """A star's centre has its neighbours in several lists; the result is that of one list."""
    frame = made(spark, [(0, k, 1) for k in range(1, 9)])
    monkeypatch.setattr(C, "LIST", 3)
    lists = C._lists(C._ways(frame)).selectExpr("v", "size(near) AS n").collect()
    assert len(lists) > 9 and sorted((r["v"]) for r in lists if r["v"]) == list(range(1, 9)) and sum(r["n"] for r in lists if not r["v"]) == 8


@pytest.mark.parametrize("name", ["rings", "noise", "pair", "star"])
def test_louvain_levels(spark, name):
    edges = graphs()[name]
    frame = made(spark, edges)
    levels = C.louvain_levels(frame)
    assert levels
    before = None
    for level in levels:
        labels = [tuple(r) for r in level.labels.collect()]
        assert {v for v, _ in labels} == {x for a, b, _ in edges for x in (a, b)} and len(labels) == len(dict(labels))
        assert sql_modularity(edges, labels) == pytest.approx(level.modularity, abs=1e-9)
        assert len({c for _, c in labels}) == level.communities and all(c == min(v for v, d in labels if d == c) for c in {c for _, c in labels})
        if before is not None:  # levels nest, and each gains
            assert level.modularity > before.modularity
            met = collections.defaultdict(set)
            for v, c in before.labels.collect():
                met[c].add(dict(labels)[v])
            assert all(len(s) == 1 for s in met.values())
        before = level
    assert levels[-1].modularity >= G.modularity(frame, G.louvain(frame)) - 1e-9
    if name == "rings":
        assert levels[-1].communities == 5


def test_colouring(spark):
    for edges in graphs().values():
        colour = dict(tuple(r) for r in C.colouring(made(spark, edges)).collect())
        assert all(colour[a] != colour[b] for a, b, _ in edges)
        degree = collections.Counter(x for a, b, _ in edges for x in (a, b))
        assert all(0 <= c <= degree[v] for v, c in colour.items())


def plain_propagation(edges, colour):
    near = collections.defaultdict(list)
    for a, b, _ in edges:
        near[a].append(b)
        near[b].append(a)
    label = {v: v for v in near}
    for sweep in range(1, 101):
        changed = 0
        for c in sorted(set(colour.values())):
            new = {}
            for v in (v for v in near if colour[v] == c):
                n = collections.Counter(label[x] for x in near[v])
                new[v] = max(n, key=lambda k: (n[k], k == label[v], -k))  # noqa: B023
            changed += sum(label[v] != x for v, x in new.items())
            label |= new
        if not changed:
            return label, sweep
    raise AssertionError


@pytest.mark.parametrize("name", ["rings", "noise", "star"])
def test_coloured_propagation(spark, name):
    edges = graphs()[name]
    frame = made(spark, edges)
    found = C.coloured_label_propagation(frame)
    label, sweeps = plain_propagation(edges, dict(tuple(r) for r in C.colouring(frame).collect()))
    assert found.converged and found.sweeps == sweeps
    assert dict(tuple(r) for r in found.labels.collect()) == label


def test_pagerank(spark):
    edges = graphs()["noise"]
    nodes = sorted({x for a, b, _ in edges for x in (a, b)} | {100, 101, 102})
    at = {v: k for k, v in enumerate(nodes)}
    a = np.zeros((len(nodes), len(nodes)))
    for x, y, _ in edges:
        a[at[x], at[y]] = a[at[y], at[x]] = 1
    out = a.sum(1)
    step = np.where(out[:, None] > 0, a / np.maximum(out, 1)[:, None], 1 / len(nodes)).T
    rank = np.linalg.solve(np.eye(len(nodes)) - 0.85 * step, np.full(len(nodes), 0.15 / len(nodes)))
    ids = spark.createDataFrame([(v,) for v in nodes] + [(None,), (100,)], "identity_id long")
    found = C.pagerank(made(spark, edges), ids)
    got = dict(tuple(r) for r in found.ranks.collect())
    assert found.residual <= 1e-12 and 10 < found.rounds < 300
    assert got == pytest.approx(dict(zip(nodes, rank, strict=True)), abs=1e-10) and sum(got.values()) == pytest.approx(1)
    short = C.pagerank(made(spark, edges), ids, most=4)
    assert short.rounds == 4 and short.residual > 1e-12


def test_no_edges(spark):
    none = made(spark, [])
    assert C.louvain_levels(none) == [] and C.colouring(none).count() == 0
    found = C.coloured_label_propagation(none)
    assert found.converged and found.labels.count() == 0
    assert C.pagerank(none).ranks.count() == 0
    alone = C.pagerank(none, spark.createDataFrame([(1,), (2,)], "identity_id long")).ranks
    assert dict(tuple(r) for r in alone.collect()) == pytest.approx({1: 0.5, 2: 0.5})


def test_pagerank_settles_in_few_rounds(spark):
    """On a star ranks swing to and fro; plain steps take 0.85 of the error to the next round."""
    found = C.pagerank(made(spark, [(1, 2, 1.0), (1, 3, 1.0)]))
    assert found.rounds <= 60 and {r[0]: r[1] for r in found.ranks.collect()} == pytest.approx({1: 0.9 / 1.85, 2: 0.475 / 1.85, 3: 0.475 / 1.85}, abs=1e-9)
