"""Queries on the shared-element identity graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verigrain.functions.basics import joined
from verigrain.operators import communities as C
from verigrain.operators import graph as G
from verigrain.plans.registry import Registry
from verigrain.plans.sql_tables import GRAPH_USE, joined_sql, names_sql
from verigrain.sources.adapters import Tables

R = Registry()
query = R.query

_W = "CASE element_type WHEN 'ssn' THEN 1.0 WHEN 'device' THEN 0.7 WHEN 'phone' THEN 0.6 WHEN 'email' THEN 0.5 WHEN 'address' THEN 0.4 ELSE 0.3 END"
_PAIRS = f"{GRAPH_USE}, prs AS (SELECT element_type, element_key, a.identity_id AS src, b.identity_id AS dst FROM gu a JOIN gu b USING (element_type, element_key) WHERE a.identity_id < b.identity_id)"


def _edges_sql(where: str = "true") -> str:
    return f"{_PAIRS}, e AS (SELECT src, dst, list_sort(list(DISTINCT element_type)) AS types, count(*) AS shared, sum(({_W})::DECIMAL(18,4))::DOUBLE AS weight FROM prs WHERE {where} GROUP BY 1, 2), w2 AS (SELECT src, dst, types FROM e UNION ALL SELECT dst, src, types FROM e)"


_EDGES = _edges_sql()
_CC = "cc AS (SELECT src AS v, src AS c FROM w2 UNION SELECT w2.dst, cc.c FROM cc JOIN w2 ON w2.src = cc.v), comp AS (SELECT v AS identity_id, min(c) AS component FROM cc GROUP BY 1)"


@query(f"WITH {_PAIRS} SELECT * FROM prs")
def identity_pairs(t: Tables) -> DataFrame:
    return G.identity_pairs(t.graph_use())


@query(f"WITH {_EDGES} SELECT src, dst, array_to_string(types, ',') AS types, shared, round(weight, 6) AS weight FROM e")
def identity_graph_edges(t: Tables) -> DataFrame:
    return G.identity_edges(t.graph_use()).withColumns({"types": F.array_join("types", ","), "weight": F.round("weight", 6)})


@query(f"""WITH {_PAIRS}, d AS (SELECT DISTINCT element_type, src, dst FROM (SELECT element_type, src, dst FROM prs UNION ALL SELECT element_type, dst, src FROM prs)),
    l AS (SELECT src AS identity_id, {', '.join(f"coalesce(list_sort(list(dst) FILTER (element_type = '{k}')), []) AS {k}" for k in G.ALL_TYPES)} FROM d GROUP BY 1)
    SELECT identity_id, {', '.join(f"array_to_string({k}, ',') AS {k}" for k in G.ALL_TYPES)}, ({' + '.join(f'len({k})' for k in G.ALL_TYPES)})::BIGINT AS total_connections,
      {joined_sql(names_sql({"SHARED_SSN": "len(ssn) > 0", "HIGH_PHONE_SHARING": "len(phone) > 2", "HIGH_ADDRESS_SHARING": "len(address) > 5"}))} AS risk_indicators FROM l""")
def shared_elements(t: Tables) -> DataFrame:
    f = G.shared_elements(t.graph_use())
    return f.withColumns({k: F.array_join(k, ",") for k in G.ALL_TYPES} | {"risk_indicators": joined(F.col("risk_indicators"))})


@query(f"WITH {_EDGES} SELECT src AS identity_id, count(*) AS degree, sum(len(types))::BIGINT AS weighted_degree, {', '.join(f'''count(*) FILTER (list_contains(types, '{k}')) AS shared_{k}_count''' for k in G.ALL_TYPES)} FROM w2 GROUP BY 1")
def degree_features(t: Tables) -> DataFrame:
    return G.degrees(G.identity_edges(t.graph_use()))


def _scores(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    return t.read("customer").select(k.alias("identity_id"), ((k * 7 % 100) / 100.0).alias("score"))


@query(f"WITH {_EDGES}, s AS (SELECT c_custkey AS id, (c_custkey * 7 % 100) / 100.0::DOUBLE AS score FROM customer) SELECT src AS identity_id, round(avg(coalesce(score, 0)), 6) AS neighbor_avg_score, max(coalesce(score, 0)) AS neighbor_max_score, count(*) FILTER (score > 0.5) AS high_risk_neighbor_count FROM w2 LEFT JOIN s ON id = dst GROUP BY 1")
def neighbor_scores(t: Tables) -> DataFrame:
    return G.neighbour_scores(G.identity_edges(t.graph_use()), _scores(t)).withColumn("neighbor_avg_score", F.round("neighbor_avg_score", 6))


@query(f"""WITH {_EDGES}, deg AS (SELECT src AS v, count(*) AS d FROM w2 GROUP BY 1), tri AS (SELECT a.src AS v, count(*) / 2 AS triangles FROM w2 a JOIN w2 b ON a.dst = b.src JOIN w2 c ON b.dst = c.src AND c.dst = a.src GROUP BY 1)
    SELECT v AS identity_id, d AS degree, coalesce(triangles, 0)::BIGINT AS triangles, round(CASE WHEN d < 2 THEN 0 ELSE coalesce(triangles, 0) / (d * (d - 1) / 2.0::DOUBLE) END::DOUBLE, 6) AS clustering FROM deg LEFT JOIN tri USING (v)""")
def clustering_coefficient(t: Tables) -> DataFrame:
    return G.clustering(G.identity_edges(t.graph_use())).withColumn("clustering", F.round("clustering", 6))


@query(f"""WITH RECURSIVE {_EDGES}, r AS (SELECT DISTINCT identity_id AS start, identity_id, 0 AS hops FROM gu UNION SELECT r.start, w2.dst, r.hops + 1 FROM r JOIN w2 ON w2.src = r.identity_id WHERE r.hops < 2)
    SELECT start, identity_id, min(hops)::INT AS hops FROM r GROUP BY 1, 2""")
def khop_neighborhood(t: Tables) -> DataFrame:
    uses = t.graph_use()
    return G.neighbourhood(uses, uses.select("identity_id").distinct(), 2)


@query(f"WITH RECURSIVE {_EDGES}, {_CC} SELECT * FROM comp")
def connected_components(t: Tables) -> DataFrame:
    return G.components(t.graph_use())


@query(f"""WITH RECURSIVE {_EDGES}, {_CC}, sz AS (SELECT component, count(*) AS size FROM comp GROUP BY 1), m AS (SELECT component, count(*) AS edges FROM e JOIN comp ON src = identity_id GROUP BY 1)
    SELECT component, size, edges, round(CASE WHEN size < 2 THEN 0 ELSE 2.0::DOUBLE * edges / (size * (size - 1)) END, 6) AS density FROM sz JOIN m USING (component)""")
def component_density(t: Tables) -> DataFrame:
    return G.component_density(G.identity_edges(t.graph_use())).withColumn("density", F.round("density", 6))


_CLUSTERS = f"""WITH RECURSIVE {_edges_sql("element_type <> 'email'")}, {_CC}, sz AS (SELECT component AS cluster, count(*) AS size FROM comp GROUP BY 1 HAVING count(*) >= 3),
    tal AS (SELECT component AS cluster, count(*) AS edges, {', '.join(f"count(*) FILTER (list_contains(types, '{k}')) AS shared_{k}" for k in G.CLUSTER_TYPES)} FROM e JOIN comp ON src = identity_id GROUP BY 1),
    dg AS (SELECT component AS cluster, src, count(*) AS d FROM w2 JOIN comp ON src = identity_id GROUP BY 1, 2), ctr AS (SELECT cluster, arg_max(src, (d, -src)) AS centre FROM dg GROUP BY 1),
    cl AS (SELECT *, 2.0::DOUBLE * edges / (size * (size - 1)) AS density FROM sz JOIN tal USING (cluster) JOIN ctr USING (cluster)),
    scd AS (SELECT *, least(1.0::DOUBLE, CASE WHEN shared_ssn > 0 THEN 0.5::DOUBLE ELSE 0 END + CASE WHEN shared_phone > size THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN shared_device > 0 THEN 0.15::DOUBLE ELSE 0 END + 0.15::DOUBLE * density + CASE WHEN size >= 10 THEN 0.1::DOUBLE WHEN size >= 5 THEN 0.05::DOUBLE ELSE 0 END) AS sc FROM cl)"""


@query(f"""{_CLUSTERS} SELECT 'cluster_' || cluster AS cluster_id, size, edges, shared_ssn, shared_address, shared_phone, shared_device, centre, round(density, 6) AS density, round(sc, 6) AS score,
    CASE WHEN sc >= 0.8 THEN 'critical' WHEN sc >= 0.6 THEN 'high' WHEN sc >= 0.4 THEN 'medium' ELSE 'low' END AS risk_level FROM scd""")
def cluster_score(t: Tables) -> DataFrame:
    f = G.detect_clusters(t.graph_use())
    return f.select("cluster_id", "size", "edges", *[f"shared_{k}" for k in G.CLUSTER_TYPES], "centre", F.round("density", 6).alias("density"), F.round("score", 6).alias("score"), "risk_level")


@query(f"{_CLUSTERS} SELECT identity_id, 'cluster_' || component AS cluster_id FROM comp JOIN sz ON component = cluster")
def cluster_assignment(t: Tables) -> DataFrame:
    from verigrain.operators.components import connected_components as cc

    found = cc(G.identity_edges(t.graph_use(), G.CLUSTER_TYPES)).select(F.col("node").alias("identity_id"), "component")
    large = found.groupBy("component").count().where("count >= 3").select("component")
    return found.join(large, "component").select("identity_id", F.concat(F.lit("cluster_"), F.col("component").cast("string")).alias("cluster_id"))


_RANKS = ", ".join(
    f"r{k} AS (SELECT w2.dst AS v, 0.15::DOUBLE / (SELECT count(*) FROM deg) + 0.85::DOUBLE * sum(r.p / deg.d) AS p FROM r{k - 1} r JOIN deg USING (v) JOIN w2 ON w2.src = r.v GROUP BY 1)" for k in range(1, 11)
)


@query(f"WITH {_EDGES}, deg AS (SELECT src AS v, count(*) AS d FROM w2 GROUP BY 1), r0 AS (SELECT v, 1.0::DOUBLE / (SELECT count(*) FROM deg) AS p FROM deg), {_RANKS} SELECT v AS identity_id, round(p, 9) AS rank FROM r10")
def pagerank_fixed(t: Tables) -> DataFrame:
    return G.pagerank(G.identity_edges(t.graph_use()), 10).withColumn("rank", F.round("rank", 9))


_VOTES = ", ".join(
    f"""l{k} AS MATERIALIZED (SELECT src AS v, label FROM (SELECT w2.src, near.label, count(*) AS n, near.label = any_value(own.label) AS stays FROM w2 JOIN l{k - 1} near ON near.v = w2.dst JOIN l{k - 1} own ON own.v = w2.src GROUP BY 1, 2)
        QUALIFY row_number() OVER (PARTITION BY src ORDER BY n DESC, stays DESC, label) = 1)"""
    for k in range(1, 11)
)


@query(f"WITH {_EDGES}, l0 AS (SELECT DISTINCT src AS v, src AS label FROM w2), {_VOTES} SELECT v AS identity_id, label AS component FROM l10")
def label_propagation(t: Tables) -> DataFrame:
    return G.label_propagation(G.identity_edges(t.graph_use()))


@query()
def louvain(t: Tables) -> DataFrame:
    return G.louvain(G.identity_edges(t.graph_use(), G.CLUSTER_TYPES))


# Shortest paths of all sources level by level, then each vertex's share of those behind it, from the last level back.
_BETWEEN = """vs AS MATERIALIZED (SELECT DISTINCT src AS v FROM w2), nb AS MATERIALIZED (SELECT src, dst FROM w2),
    hops(s, v, d) USING KEY (s, v) AS (SELECT v, v, 0 FROM vs UNION SELECT h.s, nb.dst, min(h.d) + 1 FROM hops h JOIN nb ON nb.src = h.v LEFT JOIN recurring.hops x ON x.s = h.s AND x.v = nb.dst WHERE x.v IS NULL GROUP BY 1, 2),
    far AS MATERIALIZED (SELECT s, v, d FROM hops),
    ways AS (SELECT s, v, 0 AS d, 1.0::DOUBLE AS n FROM far WHERE d = 0 UNION ALL
      SELECT w.s, f.v, w.d + 1, sum(w.n) FROM ways w JOIN nb ON nb.src = w.v JOIN far f ON f.s = w.s AND f.v = nb.dst AND f.d = w.d + 1 GROUP BY 1, 2, 3),
    paths AS MATERIALIZED (SELECT s, v, d, n FROM ways),
    back AS (SELECT s, v, d, n, 0.0::DOUBLE AS share FROM paths WHERE d = (SELECT max(d) FROM paths) UNION ALL
      SELECT p.s, p.v, p.d, p.n, coalesce(any_value(g.g), 0) * p.n FROM paths p JOIN (SELECT max(d) - 1 AS d FROM back) at_ ON p.d = at_.d
        LEFT JOIN (SELECT b.s, nb.dst AS v, sum((1 + b.share) / b.n) AS g FROM back b JOIN nb ON nb.src = b.v GROUP BY 1, 2) g ON g.s = p.s AND g.v = p.v
      WHERE p.d > 0 GROUP BY p.s, p.v, p.d, p.n),
    btw AS (SELECT v, coalesce(b, 0) / nullif((n - 1) * (n - 2), 0)::DOUBLE AS b FROM vs LEFT JOIN (SELECT v, sum(share) AS b FROM back WHERE d > 0 GROUP BY 1) USING (v), (SELECT count(*) AS n FROM vs))"""


@query(f"WITH RECURSIVE {_EDGES}, {_BETWEEN} SELECT v AS identity_id, round(b, 9) AS betweenness FROM btw")
def betweenness(t: Tables) -> DataFrame:
    return G.betweenness(G.identity_edges(t.graph_use())).withColumn("betweenness", F.round("betweenness", 9))


_RANKS_20 = ", ".join(
    f"r{k} AS MATERIALIZED (SELECT w2.dst AS v, 0.15::DOUBLE / (SELECT count(*) FROM deg) + 0.85::DOUBLE * sum(r.p / deg.d) AS p FROM r{k - 1} r JOIN deg USING (v) JOIN w2 ON w2.src = r.v GROUP BY 1)" for k in range(1, 21)
)


@query(f"""WITH RECURSIVE {_EDGES}, {_BETWEEN}, {_CC}, deg AS (SELECT src AS v, count(*) AS d, sum(len(types))::BIGINT AS wd, {', '.join(f"count(*) FILTER (list_contains(types, '{k}')) AS {k}" for k in G.ALL_TYPES)} FROM w2 GROUP BY 1),
    r0 AS (SELECT v, 1.0::DOUBLE / (SELECT count(*) FROM deg) AS p FROM deg), {_RANKS_20},
    tri AS (SELECT a.src AS v, count(*) / 2 AS triangles FROM w2 a JOIN w2 b ON a.dst = b.src JOIN w2 c ON b.dst = c.src AND c.dst = a.src GROUP BY 1),
    sz AS (SELECT component, count(*) AS size FROM comp GROUP BY 1), m AS (SELECT component, count(*) AS edges FROM e JOIN comp ON src = identity_id GROUP BY 1),
    sc AS (SELECT c_custkey AS v, (c_custkey * 7 % 100) / 100.0::DOUBLE AS score FROM customer),
    ns AS (SELECT src AS v, avg(coalesce(score, 0)) AS near, max(coalesce(score, 0)) AS highest, count(*) FILTER (score > 0.5) AS risky FROM w2 LEFT JOIN sc ON sc.v = dst GROUP BY 1)
    SELECT sc.v AS identity_id, coalesce(d, 0) AS degree, coalesce(wd, 0) AS weighted_degree, {', '.join(f"coalesce({k}, 0) AS shared_{k}_count" for k in G.ALL_TYPES)},
      round(CASE WHEN coalesce(d, 0) < 2 THEN 0 ELSE coalesce(triangles, 0) / (d * (d - 1) / 2.0::DOUBLE) END::DOUBLE, 6) AS clustering, round(coalesce(b, 0), 9) AS betweenness, round(coalesce(p, 0), 9) AS rank,
      coalesce(size, 1) AS cluster_size, round(coalesce(2.0::DOUBLE * edges / (size * (size - 1)), 0), 6) AS cluster_density, round(coalesce(near, 0), 6) AS neighbor_avg_score, coalesce(highest, 0) AS neighbor_max_score, coalesce(risky, 0) AS high_risk_neighbor_count
    FROM sc LEFT JOIN deg USING (v) LEFT JOIN tri USING (v) LEFT JOIN btw USING (v) LEFT JOIN r20 USING (v) LEFT JOIN ns USING (v) LEFT JOIN comp ON comp.identity_id = sc.v LEFT JOIN sz USING (component) LEFT JOIN m USING (component)""")
def graph_features(t: Tables) -> DataFrame:
    """The fifteen features of every customer; ``feature_table`` has them as a vector too."""
    ids = t.read("customer").select(F.col("c_custkey").alias("identity_id"))
    places = {"clustering": 6, "betweenness": 9, "rank": 9, "cluster_density": 6, "neighbor_avg_score": 6}
    return G.feature_table(t.graph_use(), _scores(t), ids).withColumns({c: F.round(c, k) for c, k in places.items()}).drop("feature_vector")


@query(f"""WITH {GRAPH_USE}, n AS (SELECT DISTINCT 'identity:' || identity_id AS id, 'identity' AS kind FROM gu UNION SELECT DISTINCT element_type || ':' || element_key, element_type FROM gu)
    SELECT id, kind, CASE kind WHEN 'identity' THEN 'ID: ' || substr(split_part(id, ':', 2), 1, 8) WHEN 'ssn' THEN 'SSN' WHEN 'address' THEN 'Address' WHEN 'phone' THEN 'Phone' WHEN 'email' THEN 'Email' ELSE 'Device' END AS label,
      CASE kind WHEN 'identity' THEN '#ff6b6b' WHEN 'ssn' THEN '#4ecdc4' WHEN 'address' THEN '#45b7d1' WHEN 'phone' THEN '#96ceb4' WHEN 'email' THEN '#ffeaa7' ELSE '#dfe6e9' END AS colour, CASE kind WHEN 'identity' THEN 30 ELSE 20 END AS size FROM n""")
def graph_export(t: Tables) -> DataFrame:
    return G.export_nodes_edges(t.graph_use())[0]


@query(f"WITH {GRAPH_USE} SELECT 'identity:' || identity_id AS source, element_type || ':' || element_key AS target, 'HAS_' || upper(element_type) AS kind FROM gu")
def graph_export_edges(t: Tables) -> DataFrame:
    return G.export_nodes_edges(t.graph_use())[1]


@query(f"""{_CLUSTERS} SELECT 'cluster_' || cluster AS cluster_id, size, round(sc, 6) AS score FROM scd WHERE sc >= 0.2 ORDER BY sc DESC, cluster LIMIT 50""")
def top_clusters(t: Tables) -> DataFrame:
    return G.ranked_clusters(G.detect_clusters(t.graph_use()), min_score=0.2, most=50).select("cluster_id", "size", F.round("score", 6).alias("score"))


@query(f"""{_CLUSTERS}, k AS (SELECT component, identity_id, row_number() OVER (PARTITION BY component ORDER BY identity_id) AS place FROM comp JOIN sz ON component = cluster)
    SELECT 'cluster_' || component AS cluster_id, identity_id FROM k WHERE place <= 100""")
def cluster_members(t: Tables) -> DataFrame:
    edges = G.identity_edges(t.graph_use(), G.CLUSTER_TYPES)
    return G.members_of_clusters(edges, most=100)


_CONVERGED = ", ".join(
    f"t{k} AS MATERIALIZED (SELECT id AS v, (0.15::DOUBLE + 0.85::DOUBLE * (SELECT sum(p) FROM t{k - 1} WHERE v NOT IN (SELECT v FROM deg))) / (SELECT count(*) FROM t{k - 1}) + 0.85::DOUBLE * coalesce(i.s, 0) AS p"
    f" FROM ids LEFT JOIN (SELECT w2.dst, sum(r.p / deg.d) AS s FROM t{k - 1} r JOIN deg USING (v) JOIN w2 ON w2.src = r.v GROUP BY 1) i ON i.dst = id)"
    for k in range(1, 101)
)


@query(f"""WITH {_EDGES}, ids AS (SELECT c_custkey AS id FROM customer), deg AS (SELECT src AS v, count(*) AS d FROM w2 GROUP BY 1),
    t0 AS MATERIALIZED (SELECT id AS v, 1.0::DOUBLE / (SELECT count(*) FROM ids) AS p FROM ids), {_CONVERGED} SELECT v AS identity_id, round(p, 8) AS rank FROM t100""")
def pagerank(t: Tables) -> DataFrame:
    """Ranks of all customers at the fixed point, those without a link too."""
    ids = t.read("customer").select(F.col("c_custkey").alias("identity_id"))
    return C.pagerank(G.identity_edges(t.graph_use()), ids).ranks.withColumn("rank", F.round("rank", 8))


@query()
def louvain_levels(t: Tables) -> DataFrame:
    """The community of every identity on every level of Louvain, with the level's modularity."""
    parts = [x.labels.select("identity_id", F.lit(k).alias("level"), "component", F.lit(x.modularity).alias("modularity")) for k, x in enumerate(C.louvain_levels(G.identity_edges(t.graph_use(), G.CLUSTER_TYPES)), 1)]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


@query()
def label_propagation_clusters(t: Tables) -> DataFrame:
    """Clusters of label propagation at its fixed point."""
    f = G.detect_clusters(t.graph_use(), "coloured_label_propagation")
    return f.select("cluster_id", "size", "edges", "centre", "density", "score", "risk_level")


@query()
def louvain_clusters(t: Tables) -> DataFrame:
    f = G.detect_clusters(t.graph_use(), "louvain")
    return f.select("cluster_id", "size", "edges", "centre", "density", "score", "risk_level")


_LAYERS = ", ".join(
    f"""m{k} AS MATERIALIZED (SELECT s.v, {', '.join(f"s.{x} + greatest(0.0::DOUBLE, 0.5::DOUBLE * s.{x} + 0.5::DOUBLE * coalesce(near.{x}, 0)) AS {x}" for x in G.ALL_TYPES)} FROM m{k - 1} s
      LEFT JOIN (SELECT w2.src AS v, {', '.join(f'avg(o.{x}) AS {x}' for x in G.ALL_TYPES)} FROM w2 JOIN m{k - 1} o ON o.v = w2.dst GROUP BY 1) near USING (v))"""
    for k in (1, 2)
)


@query(f"""WITH {_EDGES}, m0 AS (SELECT src AS v, {', '.join(f"count(*) FILTER (list_contains(types, '{k}'))::DOUBLE AS {k}" for k in G.ALL_TYPES)} FROM w2 GROUP BY 1), {_LAYERS}
    SELECT v AS identity_id, {', '.join(f'round({k}, 6) AS {k}' for k in G.ALL_TYPES)} FROM m2""")
def message_passing(t: Tables) -> DataFrame:
    """How many neighbours share each type, passed on along two edges."""
    edges = G.identity_edges(t.graph_use())
    features = G.degrees(edges).select("identity_id", F.array(*[F.col(f"shared_{k}_count").cast("double") for k in G.ALL_TYPES]).alias("vec"))
    passed = G.message_passing(edges, features, len(G.ALL_TYPES))
    return passed.select("identity_id", *[F.round(F.get("vec", k), 6).alias(x) for k, x in enumerate(G.ALL_TYPES)])


QUERIES, ORACLES = R.queries, R.oracles
