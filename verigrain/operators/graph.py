"""The shared-element identity graph as tables: edges, neighbourhoods, features, communities, centrality.

Input is ``identity_element(identity_id, element_type, element_key)``, distinct. An element pairs each two of its
identities, also where they are very many; such pairs are made in blocks, and ``hub_elements`` reports the elements.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verigrain.config import CONFIG, EngineConfig
from verigrain.functions.basics import clip01, ladder, names_where, points
from verigrain.operators.communities import coloured_label_propagation, louvain_levels
from verigrain.operators.components import connected_components
from verigrain.operators.pairs import block_pairs
from verigrain.operators.paths import component_dependencies
from verigrain.plans.durable import discard, durable

CLUSTER_TYPES = ("ssn", "address", "phone", "device")
ALL_TYPES = ("ssn", "address", "phone", "email", "device")


def _sized(uses: DataFrame) -> DataFrame:
    counts = uses.groupBy("element_type", "element_key").agg(F.count(F.lit(1)).alias("fanout"), F.min("identity_id").alias("centre"))
    return uses.join(counts.where("fanout > 1"), ["element_type", "element_key"])


def hub_elements(uses: DataFrame, max_fanout: int = CONFIG.max_fanout) -> DataFrame:
    counts = uses.groupBy("element_type", "element_key").agg(F.count(F.lit(1)).alias("fanout"))
    return counts.where(F.col("fanout") > max_fanout)


def identity_pairs(uses: DataFrame, max_fanout: int | None = None) -> DataFrame:
    """src < dst for every shared element: element_type, element_key, src, dst.

    With ``max_fanout``, elements of more identities link theirs in a star around the smallest instead, which keeps
    components and nothing else; no feature is made from that.
    """
    if max_fanout is None:
        return block_pairs(uses, ["element_type", "element_key"], "identity_id")
    sized = _sized(uses)
    pairs = block_pairs(sized.where(F.col("fanout") <= max_fanout), ["element_type", "element_key"], "identity_id")
    stars = sized.where((F.col("fanout") > max_fanout) & (F.col("identity_id") != F.col("centre")))
    return pairs.union(stars.select("element_type", "element_key", F.col("centre").alias("src"), F.col("identity_id").alias("dst")))


def link_weight(kind: Column, config: EngineConfig = CONFIG) -> Column:
    table = F.create_map(*[F.lit(x) for kv in config.link_weights.items() for x in kv])
    return F.coalesce(F.try_element_at(table, kind), F.lit(config.other_link_weight))


def identity_edges(uses: DataFrame, types: tuple[str, ...] = ALL_TYPES, config: EngineConfig = CONFIG) -> DataFrame:
    """src < dst, types (sorted), shared elements and weight, each element counted once."""
    pairs = identity_pairs(uses.where(F.col("element_type").isin(*types)))
    return pairs.groupBy("src", "dst").agg(
        F.sort_array(F.collect_set("element_type")).alias("types"), F.count(F.lit(1)).alias("shared"),
        F.sum(link_weight(F.col("element_type"), config).cast("decimal(18,4)")).cast("double").alias("weight"),
    )


def both_ways(edges: DataFrame) -> DataFrame:
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *rest))


def degrees(edges: DataFrame) -> DataFrame:
    """degree, weighted degree (types on its edges) and neighbours that share each type."""
    shared = [F.count_if(F.array_contains("types", t)).alias(f"shared_{t}_count") for t in ALL_TYPES]
    return both_ways(edges).groupBy(F.col("src").alias("identity_id")).agg(F.count(F.lit(1)).alias("degree"), F.sum(F.size("types")).alias("weighted_degree"), *shared)


def shared_elements(uses: DataFrame) -> DataFrame:
    """Per identity, the sorted other identities that share each type, with the risk indicators."""
    pairs = identity_pairs(uses).select("element_type", "src", "dst").distinct()
    lists = [F.sort_array(F.collect_set(F.when(F.col("element_type") == t, F.col("dst")))).alias(t) for t in ALL_TYPES]
    found = both_ways(pairs.select("src", "dst", "element_type")).groupBy(F.col("src").alias("identity_id")).agg(*lists)
    total = F.lit(0)
    for t in ALL_TYPES:
        total = total + F.size(t)
    risk = names_where([("SHARED_SSN", F.size("ssn") > 0), ("HIGH_PHONE_SHARING", F.size("phone") > 2), ("HIGH_ADDRESS_SHARING", F.size("address") > 5)])
    return found.withColumn("total_connections", total.cast("long")).withColumn("risk_indicators", risk)


def neighbour_scores(edges: DataFrame, scores: DataFrame) -> DataFrame:
    """Mean, highest and number above 0.5 of the neighbours' scores; unknown scores are 0."""
    near = both_ways(edges.select("src", "dst")).join(scores.select(F.col("identity_id").alias("dst"), "score"), "dst", "left").withColumn("s", F.coalesce("score", F.lit(0.0)))
    return near.groupBy(F.col("src").alias("identity_id")).agg(
        F.avg("s").alias("neighbor_avg_score"), F.max("s").alias("neighbor_max_score"), F.count_if(F.col("s") > 0.5).alias("high_risk_neighbor_count")
    )


def clustering(edges: DataFrame) -> DataFrame:
    """triangles and local clustering coefficient. Edges point from the smaller degree to the larger, which bounds
    the pairs that a hub can make."""
    degree = both_ways(edges.select("src", "dst")).groupBy(F.col("src").alias("v")).agg(F.count(F.lit(1)).alias("d"))
    e = edges.select("src", "dst").join(degree.select(F.col("v").alias("src"), F.col("d").alias("ds")), "src").join(degree.select(F.col("v").alias("dst"), F.col("d").alias("dd")), "dst")
    forward = F.struct("ds", "src") < F.struct("dd", "dst")
    e = durable(e.select(F.when(forward, F.col("src")).otherwise(F.col("dst")).alias("x"), F.when(forward, F.col("dst")).otherwise(F.col("src")).alias("y")))
    wedges = e.join(e.select("x", F.col("y").alias("z")), "x").where("y <> z")
    closed = wedges.join(e.select(F.col("x").alias("y"), F.col("y").alias("z")), ["y", "z"])
    corners = closed.select(F.explode(F.array("x", "y", "z")).alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("triangles"))
    found = degree.join(corners, "v", "left").withColumn("triangles", F.coalesce("triangles", F.lit(0).cast("long")))
    possible = F.col("d") * (F.col("d") - 1) / 2.0
    return found.select(F.col("v").alias("identity_id"), F.col("d").alias("degree"), "triangles", F.when(F.col("d") < 2, 0.0).otherwise(F.col("triangles") / possible).alias("clustering"))


def neighbourhood(uses: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """(start, identity_id, hops): identities within ``depth`` (1 to 5) shared elements, with the fewest hops.

    An element of one identity leads nowhere, so the steps read the shared ones only.
    """
    if not 1 <= depth <= 5:
        raise ValueError("depth must be 1 to 5")
    uses = durable(_sized(uses).select("identity_id", "element_type", "element_key"))
    reached = durable(starts.select(F.col("identity_id").alias("start"), "identity_id", F.lit(0).alias("hops")))
    frontier = reached
    for hop in range(1, depth + 1):
        elements = frontier.select("start", "identity_id").join(uses, "identity_id").select("start", "element_type", "element_key").distinct()
        near = elements.join(uses, ["element_type", "element_key"]).select("start", "identity_id").distinct()
        frontier = durable(near.join(reached, ["start", "identity_id"], "left_anti").withColumn("hops", F.lit(hop)))
        reached = reached.union(frontier)
    return reached


def components(uses: DataFrame) -> DataFrame:
    """(identity_id, component) through shared elements: stars suffice, so a hub costs one edge per identity."""
    sized = _sized(uses)
    found = connected_components(sized.where("identity_id <> centre"), "centre", "identity_id")
    return found.select(F.col("node").alias("identity_id"), "component")


def component_density(edges: DataFrame) -> DataFrame:
    """size, edges and density 2m / (n (n - 1)) of each component."""
    labels = durable(connected_components(edges).select(F.col("node").alias("src"), "component"))
    sizes = labels.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    inside = edges.join(labels, "src").groupBy("component").agg(F.count(F.lit(1)).alias("edges"))
    n = F.col("size")
    return sizes.join(inside, "component").withColumn("density", F.when(n < 2, 0.0).otherwise(2.0 * F.col("edges") / (n * (n - 1))))


def cluster_scores(edges: DataFrame, assignment: DataFrame, min_size: int = CONFIG.min_cluster_size) -> DataFrame:
    """Per cluster of at least ``min_size``: size, density, edges that share each type, centre, score and level."""
    a, b = assignment.select(F.col("identity_id").alias("src"), F.col("component").alias("cluster")), assignment.select(F.col("identity_id").alias("dst"), F.col("component").alias("other"))
    inside = durable(edges.join(a, "src").join(b, "dst").where("cluster = other").drop("other"))
    sizes = assignment.groupBy(F.col("component").alias("cluster")).agg(F.count(F.lit(1)).alias("size")).where(F.col("size") >= min_size)
    tally = inside.groupBy("cluster").agg(F.count(F.lit(1)).alias("edges"), *[F.count_if(F.array_contains("types", t)).alias(f"shared_{t}") for t in CLUSTER_TYPES])
    degree = both_ways(inside.select("src", "dst", "cluster")).groupBy("cluster", "src").agg(F.count(F.lit(1)).alias("d"))
    centre = degree.groupBy("cluster").agg(F.max_by("src", F.struct("d", -F.col("src"))).alias("centre"))
    n = F.col("size")
    found = sizes.join(tally, "cluster").join(centre, "cluster").withColumn("density", F.when(n < 2, 0.0).otherwise(2.0 * F.col("edges") / (n * (n - 1))))
    score = clip01(
        points(F.col("shared_ssn") > 0, 0.5) + points(F.col("shared_phone") > n, 0.2) + points(F.col("shared_device") > 0, 0.15)
        + 0.15 * F.col("density") + F.when(n >= 10, 0.1).when(n >= 5, 0.05).otherwise(0.0)
    )
    found = found.withColumn("score", score).withColumn("cluster_id", F.concat(F.lit("cluster_"), F.col("cluster").cast("string")))
    return found.withColumn("risk_level", ladder(F.col("score"), [(0.8, "critical"), (0.6, "high"), (0.4, "medium")], "low"))


def detect_clusters(uses: DataFrame, algorithm: str = "components", min_size: int = CONFIG.min_cluster_size) -> DataFrame:
    edges = durable(identity_edges(uses, CLUSTER_TYPES))
    ways = {
        "components": lambda e: connected_components(e).select(F.col("node").alias("identity_id"), "component"), "label_propagation": label_propagation, "louvain": louvain,
        "louvain_levels": lambda e: louvain_levels(e)[-1].labels, "coloured_label_propagation": lambda e: coloured_label_propagation(e).labels,
    }
    if algorithm not in ways:
        raise ValueError(f"unknown algorithm {algorithm!r}")
    return cluster_scores(edges, durable(ways[algorithm](edges)), min_size)


def ranked_clusters(clusters: DataFrame, min_score: float = 0.0, most: int = 50) -> DataFrame:
    """The ``most`` clusters of at least ``min_score``, highest score first; ties by the smaller cluster."""
    return clusters.where(F.col("score") >= min_score).orderBy(F.desc("score"), "cluster").limit(most)


def members_of_clusters(edges: DataFrame, min_size: int = CONFIG.min_cluster_size, most: int = 100) -> DataFrame:
    """(cluster_id, identity_id) of components of at least ``min_size``, the ``most`` smallest identities of each."""
    found = connected_components(edges).select(F.col("node").alias("identity_id"), "component")
    large = found.groupBy("component").count().where(F.col("count") >= min_size).select("component")
    place = F.row_number().over(Window.partitionBy("component").orderBy("identity_id"))
    first = found.join(large, "component").withColumn("place", place).where(F.col("place") <= most)
    return first.select(F.concat(F.lit("cluster_"), F.col("component").cast("string")).alias("cluster_id"), "identity_id")


def scoring_features(uses: DataFrame, scores: DataFrame) -> DataFrame:
    """What the synthetic score takes from the graph, per identity with a link: identity_key, shared_ssn_count, size and
    density of its component, and the mean of its neighbours' stored scores."""
    edges = durable(identity_edges(uses))
    labels = durable(components(uses.where(F.col("element_type").isin(*ALL_TYPES))))  # from stars: one edge for each use
    sizes = labels.groupBy("component").agg(F.count(F.lit(1)).alias("cluster_size"))
    inside = edges.join(labels.withColumnRenamed("identity_id", "src"), "src").groupBy("component").agg(F.count(F.lit(1)).alias("m"))
    n = F.col("cluster_size")
    density = sizes.join(inside, "component").select("component", "cluster_size", (2.0 * F.col("m") / (n * (n - 1))).alias("cluster_density"))
    found = degrees(edges).select("identity_id", "shared_ssn_count").join(labels.join(density, "component").drop("component"), "identity_id")
    near = neighbour_scores(edges, scores).select("identity_id", F.round("neighbor_avg_score", 6).alias("neighbor_avg_score"))
    return durable(found.join(near, "identity_id").withColumnRenamed("identity_id", "identity_key"))


def pagerank(edges: DataFrame, rounds: int = 20, damping: float = 0.85) -> DataFrame:
    """(identity_id, rank) over the undirected graph after so many rounds, from equal ranks that sum to 1."""
    ways = durable(both_ways(edges.select("src", "dst")))
    out = durable(ways.groupBy("src").agg(F.count(F.lit(1)).alias("d")))
    n = out.count()
    if not n:
        return out.select(F.col("src").alias("identity_id"), F.lit(0.0).alias("rank"))
    links = durable(ways.join(out, "src"))
    rank = out.select("src", F.lit(1.0 / n).alias("rank"))
    for k in range(rounds):  # every vertex has an edge, so no rank is left dangling
        given = links.join(rank, "src").groupBy(F.col("dst").alias("src")).agg(F.sum(F.col("rank") / F.col("d")).alias("in"))
        rank = given.select("src", (F.lit((1 - damping) / n) + damping * F.col("in")).alias("rank"))
        rank = durable(rank) if k % 5 == 4 or k == rounds - 1 else rank
    return rank.select(F.col("src").alias("identity_id"), "rank")


def label_propagation(edges: DataFrame, rounds: int = 10) -> DataFrame:
    """Synchronous label propagation: each vertex takes its neighbours' most frequent label, the smallest among ties,
    and keeps its own if that is as frequent. Stops when nothing changes or after ``rounds``."""
    ways = durable(both_ways(edges.select("src", "dst")))
    labels = durable(ways.select(F.col("src").alias("v")).distinct().withColumn("label", F.col("v")))
    for _ in range(rounds):
        seen = ways.join(labels.select(F.col("v").alias("dst"), "label"), "dst").groupBy("src", "label").agg(F.count(F.lit(1)).alias("n"))
        own = labels.select(F.col("v").alias("src"), F.col("label").alias("own"))
        best = seen.join(own, "src").groupBy("src").agg(F.max(F.struct("n", (F.col("label") == F.col("own")).cast("int"), -F.col("label")))["n"].alias("n"), F.max_by("label", F.struct("n", (F.col("label") == F.col("own")).cast("int"), -F.col("label"))).alias("label"), F.first("own").alias("own"))
        best = durable(best)
        changed = best.where("label <> own").limit(1).count()
        labels = best.select(F.col("src").alias("v"), "label")
        if not changed:
            break
    return labels.select(F.col("v").alias("identity_id"), F.col("label").alias("component"))


def louvain(edges: DataFrame, rounds: int = 8, resolution: float = 1.0) -> DataFrame:
    """One level of Louvain moves, synchronous: a vertex moves to the neighbouring community of the largest gain in
    modularity, smallest label among ties; only one half of the vertices (by a hash of vertex and round) moves at a
    time, so that two do not swap for ever. Deterministic."""
    weighted = edges.select("src", "dst", F.col("weight") if "weight" in edges.columns else F.lit(1.0).alias("weight"))
    ways = durable(both_ways(weighted))
    strength = durable(ways.groupBy("src").agg(F.sum("weight").alias("k")))
    total = strength.agg(F.sum("k")).first()[0] or 1.0
    labels = durable(strength.select(F.col("src").alias("v"), F.col("src").alias("c"), "k"))
    for turn in range(rounds):
        size = labels.groupBy("c").agg(F.sum("k").alias("size"))
        into = ways.join(labels.select(F.col("v").alias("dst"), F.col("c")), "dst").groupBy("src", "c").agg(F.sum("weight").alias("w"))
        own = labels.select(F.col("v").alias("src"), F.col("c").alias("own"), "k")
        options = into.join(own, "src").join(size, "c")
        rest = F.col("size") - F.when(F.col("c") == F.col("own"), F.col("k")).otherwise(0.0)
        gain = F.round(F.col("w") - resolution * F.col("k") * rest / total, 9)
        stay = F.max(F.when(F.col("c") == F.col("own"), gain)).alias("stay")
        best = options.groupBy("src").agg(F.max_by(F.struct("c", gain.alias("g")), F.struct(gain, -F.col("c"))).alias("b"), stay)
        moves = best.where((F.col("b.g") > F.coalesce("stay", F.lit(0.0))) & (F.pmod(F.xxhash64("src", F.lit(turn)), F.lit(2)) == 0))
        moved = labels.join(moves.select(F.col("src").alias("v"), F.col("b.c").alias("to")), "v", "left")
        labels = durable(moved.select("v", F.coalesce("to", "c").alias("c"), "k"))
    return labels.select(F.col("v").alias("identity_id"), F.col("c").alias("component"))


def modularity(edges: DataFrame, assignment: DataFrame) -> float:
    """Weighted modularity of an assignment (identity_id, component)."""
    w = edges.select("src", "dst", F.col("weight") if "weight" in edges.columns else F.lit(1.0).alias("weight"))
    a = assignment.select(F.col("identity_id").alias("src"), F.col("component").alias("ca"))
    b = assignment.select(F.col("identity_id").alias("dst"), F.col("component").alias("cb"))
    inner, m = w.join(a, "src").join(b, "dst").agg(F.sum(F.when(F.col("ca") == F.col("cb"), F.col("weight"))), F.sum("weight")).first()
    k = both_ways(w).join(a, "src").groupBy("ca").agg(F.sum("weight").alias("k"))
    square = k.agg(F.sum((F.col("k") / (2 * m)) ** 2)).first()[0]
    return (inner or 0.0) / m - square


def betweenness(edges: DataFrame, sources: int | None = None, seed: int = 0, rows_at_once: int = 20_000_000, edges_in_task: int = 1_000_000) -> DataFrame:
    """Betweenness by Brandes' accumulation from all vertices; an estimate, scaled, if fewer ``sources`` are asked for.

    A component of at most ``edges_in_task`` edges goes whole to the tasks that each take some of its sources
    (``paths.py``). In larger ones breadth-first levels and dependencies are joins over (source, vertex) rows, until no
    level is reached: their sources are taken in batches that make about ``rows_at_once`` such rows, and what a batch wrote
    is deleted behind it. So memory and disk are bounded, but the work is that of each source with each edge of its
    component. Fewer sources are those of the smallest seeded hash.
    """
    ways = durable(both_ways(edges.select("src", "dst")))
    labels = durable(connected_components(ways.where("src < dst")).select(F.col("node").alias("v"), "component"))
    n = labels.count()
    if n < 3:
        return labels.select(F.col("v").alias("identity_id"), F.lit(0.0).alias("betweenness"))
    sources = min(n, sources or n)
    chosen = labels if n == sources else labels.orderBy(F.xxhash64("v", F.lit(seed)), "v").limit(sources)
    ways = durable(ways.join(labels.withColumnRenamed("v", "src"), "src"))
    sizes = labels.groupBy("component").agg(F.count(F.lit(1)).alias("size")).where("size > 2")  # two vertices have none between them
    sizes = durable(sizes.join(ways.groupBy("component").agg(F.count(F.lit(1)).alias("ways")), "component"))
    chosen = durable(chosen.join(sizes, "component"))
    small = F.col("ways") <= 2 * edges_in_task
    inside = sizes.where(small).select("component")
    summed = durable(component_dependencies(chosen.where(small), ways.join(inside, "component")).groupBy("v").agg(F.sum("delta").alias("delta")))
    large = chosen.where(~small)
    cells = large.agg(F.sum("size")).first()[0] or 0
    batches = -(-cells // rows_at_once)
    ways = durable(ways.join(inside, "component", "left_anti").select("src", "dst")) if batches else ways
    for batch in range(batches):
        part = large.where(F.pmod(F.xxhash64("v", F.lit(seed + 1)), F.lit(batches)) == batch)
        found = _dependencies(part, ways)
        added = durable(summed.union(found).groupBy("v").agg(F.sum("delta").alias("delta")))
        for old in (found, summed):
            discard(old)
        summed = added
    scale = (n / sources) / ((n - 1) * (n - 2))
    return labels.select("v").join(summed, "v", "left").select(F.col("v").alias("identity_id"), F.coalesce(F.col("delta") * scale, F.lit(0.0)).alias("betweenness"))


def _dependencies(chosen: DataFrame, ways: DataFrame) -> DataFrame:
    """(v, delta): the dependencies of the ``chosen`` sources on each other vertex, added up."""
    levels = [durable(chosen.select(F.col("v").alias("s"), "v", F.lit(1.0).alias("paths")))]
    while True:
        step = levels[-1].join(ways, F.col("v") == F.col("src")).groupBy("s", F.col("dst").alias("v")).agg(F.sum("paths").alias("paths"))
        for near in levels[-2:]:  # edges go both ways, so none leads from a level further back than to the one before
            step = step.join(near.select("s", "v"), ["s", "v"], "left_anti")
        levels.append(durable(step))
        if levels[-1].isEmpty():
            break
    discard(levels.pop())
    parts = [durable(levels[-1].withColumn("delta", F.lit(0.0)))]
    for upper in reversed(levels[1:-1]):
        back = parts[-1].join(ways, F.col("v") == F.col("src")).select("s", F.col("dst").alias("v"), ((1.0 + F.col("delta")) / F.col("paths")).alias("share"))
        gathered = back.join(upper, ["s", "v"]).groupBy("s", "v").agg(F.sum("share").alias("g"))
        parts.append(durable(upper.join(gathered, ["s", "v"], "left").select("s", "v", "paths", (F.col("paths") * F.coalesce("g", F.lit(0.0))).alias("delta"))))
    total = parts[0]
    for p in parts[1:]:
        total = total.union(p)
    summed = durable(total.groupBy("v").agg(F.sum("delta").alias("delta")))
    for old in (*levels, *parts):
        discard(old)
    return summed


def feature_table(uses: DataFrame, scores: DataFrame, identities: DataFrame, rank_rounds: int = 20, with_betweenness: bool = True) -> DataFrame:
    """The fifteen graph features of every identity; zeros and size 1 for one without a link."""
    edges = durable(identity_edges(uses))
    labels = durable(connected_components(edges).select(F.col("node").alias("identity_id"), "component"))
    density = component_density(edges).select("component", F.col("size").alias("cluster_size"), F.col("density").alias("cluster_density"))
    between = betweenness(edges) if with_betweenness else labels.select("identity_id", F.lit(0.0).alias("betweenness"))
    out = identities.select("identity_id").distinct()
    for part in (degrees(edges), clustering(edges).select("identity_id", "clustering"), between, pagerank(edges, rank_rounds), labels.join(density, "component").drop("component"), neighbour_scores(edges, scores)):
        out = out.join(part, "identity_id", "left")
    zero = {c: F.coalesce(F.col(c), F.lit(0).cast(k)) for c, k in out.dtypes if c not in ("identity_id", "cluster_size")}
    out = out.withColumns(zero | {"cluster_size": F.coalesce("cluster_size", F.lit(1).cast("long"))})
    names = ("degree", "weighted_degree", "clustering", "betweenness", "rank", *[f"shared_{t}_count" for t in ALL_TYPES], "cluster_size", "cluster_density", "neighbor_avg_score", "neighbor_max_score", "high_risk_neighbor_count")
    return out.withColumn("feature_vector", F.array(*[F.col(c).cast("double") for c in names]))


def graph_reports(uses: DataFrame, edges: DataFrame, depth: int = 2) -> DataFrame:
    """Per identity with a link: degree, neighbours that share each type, and the identities (nodes, itself included) and
    edges within ``depth`` steps."""
    edges = durable(edges)
    linked = degrees(edges).drop("weighted_degree")
    reached = durable(neighbourhood(uses, linked.select("identity_id"), depth).select("start", "identity_id"))
    nodes = reached.groupBy("start").agg(F.count(F.lit(1)).alias("nodes"))
    near = reached.join(edges.select(F.col("src").alias("identity_id"), F.col("dst").alias("other")), "identity_id")
    inside = near.join(reached.select("start", F.col("identity_id").alias("other")), ["start", "other"]).groupBy("start").agg(F.count(F.lit(1)).alias("edges"))
    sizes = nodes.join(inside, "start", "left").withColumnRenamed("start", "identity_id")
    return linked.join(sizes, "identity_id")


def message_passing(edges: DataFrame, features: DataFrame, width: int, layers: int = 2) -> DataFrame:
    """Mean aggregation over neighbours with a residual and a ReLU, ``layers`` times, on a column vec of ``width``."""
    ways = durable(both_ways(edges.select("src", "dst")))
    state = features.select(F.col("identity_id").alias("v"), "vec")
    for _ in range(layers):
        near = ways.join(state.select(F.col("v").alias("dst"), "vec"), "dst").groupBy("src").agg(F.array(*[F.avg(F.get("vec", k)) for k in range(width)]).alias("m"))
        mixed = F.zip_with("vec", F.coalesce("m", F.array_repeat(F.lit(0.0), width)), lambda x, y: F.greatest(F.lit(0.0), 0.5 * x + 0.5 * y) + x)
        state = durable(state.join(near, F.col("v") == F.col("src"), "left").select("v", mixed.alias("vec")))
    return state.select(F.col("v").alias("identity_id"), "vec")


def export_nodes_edges(uses: DataFrame, reached: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, kind, label, colour, size; once each) and bipartite edges of all uses, or of the identities that
    ``reached`` names, for drawing."""
    # Colours and sizes of node kinds.
    colours = {"identity": "#ff6b6b", "ssn": "#4ecdc4", "address": "#45b7d1", "phone": "#96ceb4", "email": "#ffeaa7", "device": "#dfe6e9"}
    members = uses if reached is None else uses.join(reached.select("identity_id").distinct(), "identity_id", "left_semi")
    element = F.concat_ws(":", "element_type", F.col("element_key").cast("string"))
    people, elements = members.select("identity_id").distinct(), members.select("element_type", "element_key").distinct()  # keys, not texts, are told apart
    nodes = people.select(F.concat(F.lit("identity:"), F.col("identity_id").cast("string")).alias("id"), F.lit("identity").alias("kind")).union(elements.select(element, "element_type"))
    table = F.create_map(*[F.lit(x) for kv in colours.items() for x in kv])
    label = F.when(F.col("kind") == "identity", F.concat(F.lit("ID: "), F.substring(F.substring_index("id", ":", -1), 1, 8))).when(F.col("kind") == "ssn", "SSN").otherwise(F.initcap("kind"))
    nodes = nodes.select("id", "kind", label.alias("label"), F.try_element_at(table, F.col("kind")).alias("colour"), F.when(F.col("kind") == "identity", 30).otherwise(20).alias("size"))
    edges = members.select(F.concat(F.lit("identity:"), F.col("identity_id").cast("string")).alias("source"), element.alias("target"), F.concat(F.lit("HAS_"), F.upper("element_type")).alias("kind"))
    return nodes, edges


