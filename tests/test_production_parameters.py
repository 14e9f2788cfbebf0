"""Registered queries run with the operators' own sizes."""

import pytest

from verigrain.operators import graph as G
from verigrain.operators import learning as L
from verigrain.plans import graph_queries, source_queries

SF = "/root/testdata/sf0.001"


def test_betweenness_is_exact_beyond_the_sample(spark):
    """A star of 600: its centre is on all shortest paths."""
    edges = spark.range(1, 601).selectExpr("0L AS src", "id AS dst")
    got = {r[0]: r[1] for r in G.betweenness(edges).where("identity_id < 3").collect()}
    assert got == pytest.approx({0: 1.0, 1: 0.0, 2: 0.0}, rel=1e-9)


def test_betweenness_follows_long_paths(spark):
    n = 34
    edges = spark.range(n - 1).selectExpr("id AS src", "id + 1 AS dst")
    got = {r[0]: r[1] for r in G.betweenness(edges).collect()}
    assert got == pytest.approx({v: 2 * v * (n - 1 - v) / ((n - 1) * (n - 2)) for v in range(n)})


def test_graph_features_have_betweenness(spark):
    rows = graph_queries.QUERIES["graph_features"](spark, SF).select("betweenness", "feature_vector").collect()
    assert max(r["betweenness"] for r in rows) > 0 and all(r["feature_vector"][3] == r["betweenness"] for r in rows)


@pytest.mark.parametrize("name", ["gbt_train", "rf_train", "model_inference"])
def test_models_have_all_trees(spark, monkeypatch, name):
    sizes, real = [], L.probabilities

    def watched(model, *rest):
        sizes.append(len(model.stages[-1].trees))
        return real(model, *rest)

    monkeypatch.setattr(L, "probabilities", watched)
    assert source_queries.QUERIES[name](spark, SF).columns and sizes == [100]
