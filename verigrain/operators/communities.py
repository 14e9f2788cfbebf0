"""Communities that are settled: Louvain with contraction, label propagation by colour classes, converged PageRank.

Edges are ``src``, ``dst`` and maybe ``weight``, each pair once, no loops. Every loop ends by a criterion of its own and
reports whether it did; the driver sees a few numbers of each round.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verigrain.plans.durable import durable

#: Neighbours of a vertex in one list.
LIST = 10_000


def _ways(edges: DataFrame) -> DataFrame:
    """src, dst and weight in both directions."""
    weighted = edges.select("src", "dst", F.col("weight").cast("double") if "weight" in edges.columns else F.lit(1.0).alias("weight"))
    return weighted.union(weighted.select("dst", "src", "weight"))


def _lists(ways: DataFrame) -> DataFrame:
    """v and near: the neighbours (src, weight) of a vertex in as many lists of about ``LIST`` as it needs."""
    degree = ways.groupBy("dst").agg(F.ceil(F.count(F.lit(1)) / F.lit(LIST)).alias("parts"))
    dealt = ways.join(degree, "dst").groupBy("dst", F.pmod(F.xxhash64("src"), F.col("parts")).alias("part"))
    return dealt.agg(F.collect_list(F.struct("src", "weight")).alias("near")).select(F.col("dst").alias("v"), "near")


class Level(NamedTuple):
    labels: DataFrame
    communities: int
    modularity: float


class _Settled(NamedTuple):
    labels: DataFrame
    modularity: float


def _move(ways: DataFrame, nodes: DataFrame, total: float, rounds: int, resolution: float) -> _Settled:
    """The best labels (v, c) that so many rounds of moves reach, and their modularity.

    ``nodes`` has v, k (strength, twice its loops included) and loop (twice the weight inside). In a round every vertex
    weighs the communities next to it; of those that gain by moving, one half moves, chosen by a hash of vertex and
    round, so that two do not swap for ever. The rounds' modularity can fall, so the best is kept.
    """
    labels = nodes.select("v", F.col("v").alias("c"), "k", "loop")
    lists = durable(_lists(ways))
    best: _Settled | None = None
    for turn in range(rounds + 1):
        # A vertex tells its neighbours its community and that one's size, so edges are dealt out once, to their other end.
        sized = labels.join(labels.groupBy("c").agg(F.sum("k").alias("size")), "c")
        told = lists.join(sized.select("v", "c", "size"), "v").select(F.explode("near").alias("e"), "c", "size").select(F.col("e.src").alias("v"), "c", "size", F.col("e.weight").alias("weight"))
        into = told.repartition("v").groupBy("v", "c").agg(F.first("size").alias("size"), F.sum("weight").alias("w"))
        own = sized.select("v", F.col("c").alias("own"), "k", "loop", F.col("size").alias("own_size"))
        stays = F.col("c") == F.col("own")
        gain = F.round(F.col("w") - resolution * F.col("k") * (F.col("size") - F.when(stays, F.col("k")).otherwise(0.0)) / total, 9)
        chosen = own.join(into, "v", "left").groupBy("v").agg(
            F.max_by(F.struct("c", gain.alias("g")), F.struct(gain, -F.col("c"))).alias("b"), F.max(F.when(stays, gain)).alias("stay"), F.sum(F.when(stays, F.col("w")).otherwise(0.0)).alias("inner"),
            *[F.first(c).alias(c) for c in ("own", "k", "loop", "own_size")],
        )
        # A vertex that has left all its neighbours' communities gains nothing by staying but what it takes off alone.
        bare = F.round(-resolution * F.col("k") * (F.col("own_size") - F.col("k")) / total, 9)
        wanted = F.when(F.col("b.g") > F.coalesce("stay", bare), F.col("b.c"))
        decided = durable(chosen.select("v", F.col("own").alias("c"), "k", "loop", wanted.alias("to"), "inner"))
        by = decided.groupBy("c").agg(F.sum(F.col("inner") + F.col("loop")).alias("inside"), F.sum("k").alias("size"), F.count_if(F.col("to").isNotNull()).alias("wishes"))
        inside, square, wishes = by.agg(F.sum("inside"), F.sum(F.pow(F.col("size") / total, F.lit(2))), F.sum("wishes")).first()
        modularity = inside / total - resolution * square
        if best is None or modularity > best.modularity:
            best = _Settled(decided.select("v", "c"), modularity)
        if not wishes:
            break
        moves = F.col("to").isNotNull() & (F.pmod(F.xxhash64("v", F.lit(turn)), F.lit(2)) == 0)
        labels = decided.select("v", F.when(moves, F.col("to")).otherwise(F.col("c")).alias("c"), "k", "loop")
    return best


def louvain_levels(edges: DataFrame, rounds: int = 12, resolution: float = 1.0, tolerance: float = 1e-6, most: int = 20) -> list[Level]:
    """Louvain, level by level: labels (identity_id, component), number of communities and modularity of each.

    After the moves of a level its communities become the vertices of the next: what lies inside becomes a loop, edges
    between two add up. Levels go on until one gains no more than ``tolerance``, and that one is left out; so modularity
    rises from level to level. component is the smallest identity of the community. No edge gives no level.
    """
    ways = durable(_ways(edges))
    nodes = durable(ways.groupBy(F.col("src").alias("v")).agg(F.sum("weight").alias("k")).withColumn("loop", F.lit(0.0)))
    total = nodes.agg(F.sum("k")).first()[0]
    if not total:
        return []
    member = nodes.select(F.col("v").alias("identity_id"), "v")
    levels: list[Level] = []
    for _ in range(most):
        labels, modularity = _move(ways, nodes, total, rounds, resolution)
        if levels and modularity <= levels[-1].modularity + tolerance:
            break
        member = durable(member.join(labels, "v").select("identity_id", F.col("c").alias("v")))
        named = member.groupBy("v").agg(F.min("identity_id").alias("component"))
        out = member.join(named, "v").select("identity_id", "component")
        levels.append(Level(out, named.count(), modularity))
        # Contraction: loops hold twice the weight inside, as strengths count it.
        joined = ways.join(labels.toDF("src", "a"), "src").join(labels.toDF("dst", "b"), "dst").groupBy("a", "b").agg(F.sum("weight").alias("weight"))
        joined = durable(joined)
        inner = joined.where("a = b").select(F.col("a").alias("c"), F.col("weight").alias("inner"))
        merged = nodes.join(labels, "v").groupBy("c").agg(F.sum("k").alias("k"), F.sum("loop").alias("loop"))
        nodes = durable(merged.join(inner, "c", "left").select(F.col("c").alias("v"), "k", (F.col("loop") + F.coalesce("inner", F.lit(0.0))).alias("loop")))
        ways = joined.where("a <> b").toDF("src", "dst", "weight")
    return levels


def colouring(edges: DataFrame, seed: int = 0) -> DataFrame:
    """(v, colour): neighbours differ in colour.

    In each round the uncoloured vertices whose hashed priority is above that of all uncoloured neighbours take the
    smallest colour that no neighbour has. At least the highest of all is coloured, so the rounds end.
    """
    ways = durable(_ways(edges).select("src", "dst"))
    rank = F.struct(F.xxhash64("v", F.lit(seed)), F.col("v"))
    state = durable(ways.select(F.col("src").alias("v")).distinct().withColumn("colour", F.lit(None).cast("int")))
    left = state.count()
    while left:
        near = ways.join(state.select(F.col("v").alias("dst"), F.col("colour").alias("c"), rank.alias("r")), "dst")
        seen = near.groupBy(F.col("src").alias("v")).agg(F.max(F.when(F.col("c").isNull(), F.col("r"))).alias("highest"), F.collect_set("c").alias("used"))
        joined = state.join(seen, "v")
        free = F.array_min(F.array_except(F.sequence(F.lit(0), F.size("used")), F.col("used")))
        taken = F.when(F.col("highest").isNull() | (rank > F.col("highest")), free)
        state = durable(joined.select("v", F.coalesce("colour", taken).alias("colour")))
        left = state.where("colour IS NULL").count()
    return state


class Propagation(NamedTuple):
    labels: DataFrame
    converged: bool
    sweeps: int


def coloured_label_propagation(edges: DataFrame, most: int = 100) -> Propagation:
    """Label propagation to a fixed point: labels (identity_id, component), whether it was reached, and sweeps.

    A sweep updates one colour class after the other. A vertex takes the most frequent label of its neighbours, the
    smallest among ties, and keeps its own if that is as frequent. Since no two of a class are neighbours, each change
    adds to the edges whose ends agree; so the labels cannot swing to and fro, and the sweeps end.
    """
    colours = durable(colouring(edges))
    ways = durable(_ways(edges).select("src", "dst").join(colours.select(F.col("v").alias("src"), "colour"), "src"))
    classes = [r[0] for r in colours.select("colour").distinct().orderBy("colour").collect()]  # at most the largest degree, plus 1
    labels = durable(colours.select("v", F.col("v").alias("label")))
    for sweep in range(1, most + 1):
        changed = 0
        for colour in classes:
            seen = ways.where(F.col("colour") == colour).join(labels.select(F.col("v").alias("dst"), "label"), "dst").groupBy(F.col("src").alias("v"), "label").agg(F.count(F.lit(1)).alias("n"))
            rated = seen.join(labels.select("v", F.col("label").alias("own")), "v")
            best = rated.groupBy("v").agg(F.max_by("label", F.struct("n", (F.col("label") == F.col("own")).cast("int"), -F.col("label"))).alias("new"))
            step = durable(labels.join(best, "v", "left").select("v", F.coalesce("new", "label").alias("label"), (F.col("new") != F.col("label")).alias("moved")))
            changed += step.where("moved").count()
            labels = step.select("v", "label")
        if not changed:
            break
    return Propagation(labels.select(F.col("v").alias("identity_id"), F.col("label").alias("component")), not changed, sweep)


#: Neighbours in a list.
_LIST = 1000


class Ranks(NamedTuple):
    ranks: DataFrame
    rounds: int
    residual: float


def pagerank(edges: DataFrame, vertices: DataFrame | None = None, damping: float = 0.85, tolerance: float = 1e-12, most: int = 300, stride: int = 4) -> Ranks:
    """PageRank over the undirected graph to a fixed point: ranks (identity_id, rank) that sum to 1, rounds and residual.

    Stops when a round changes all ranks together by at most ``tolerance``; that is looked at every ``stride`` rounds.
    ``vertices`` (identity_id) without an edge take part: their rank goes to all vertices alike. They have no other
    income than that and the teleport, so they all have one rank, which is a number that can be solved for.

    Steps of an undirected graph have real eigenvalues within the damping, so Chebyshev's iteration applies: a round goes
    beyond the step from the ranks before it, and the error falls by 0.55 a round at 0.85 instead of by 0.85. A vertex
    keeps its neighbours in lists of about ``_LIST``, so that ranks meet vertices and not edges.
    """
    ways = durable(_ways(edges).select("src", "dst"))
    out = durable(ways.groupBy("src").agg(F.count(F.lit(1)).alias("d")))
    linked = out.count()
    loose = None
    if vertices is not None:
        known = vertices.select(F.col("identity_id").alias("src")).where("src IS NOT NULL").distinct()
        loose = durable(known.join(out, "src", "left_anti"))
    idle = loose.count() if loose is not None else 0
    n = linked + idle
    if not n:
        return Ranks(out.select(F.col("src").alias("identity_id"), F.lit(0.0).alias("rank")), 0, 0.0)
    lone = (1 - damping) / (n - damping * idle)
    part = F.pmod(F.xxhash64("dst"), F.ceil(F.col("d") / _LIST)).alias("part")
    links = durable(ways.join(out, "src").groupBy("src", "d", part).agg(F.collect_list("dst").alias("near")).withColumn("near", F.array_append("near", F.col("src"))))  # its own row too
    rank = out.select("src", F.lit(1.0 / n).alias("rank"), F.lit(0.0).alias("before"))
    residual, done, omega = 1.0, 0, 1.0
    while done < most and residual > tolerance:
        for _ in range(stride):
            omega = 1.0 if not done else 1.0 / (1.0 - damping**2 / 2) if done == 1 else 1.0 / (1.0 - damping**2 * omega / 4)
            own = F.col("src") == F.col("to")
            given = links.join(rank, "src").select("src", "d", "rank", "before", F.explode("near").alias("to"))
            given = given.select(F.col("to").alias("src"), F.when(~own, F.col("rank") / F.col("d")).alias("in"), F.when(own, F.col("rank")).alias("rank"), F.when(own, F.col("before")).alias("before"))
            met = given.groupBy("src").agg(F.sum("in").alias("in"), F.max("rank").alias("rank"), F.max("before").alias("before"))
            step = F.lit(lone) + damping * F.col("in")
            rank = met.select("src", (F.lit(omega) * (step - F.col("before")) + F.col("before")).alias("rank"), F.col("rank").alias("before"))
            done += 1
        rank = durable(rank)
        residual = rank.agg(F.sum(F.abs(F.col("rank") - F.col("before")))).first()[0] or 0.0
    found = rank.select(F.col("src").alias("identity_id"), "rank")
    if idle:
        found = found.union(loose.select("src", F.lit(lone)))
    return Ranks(found, done, residual)
