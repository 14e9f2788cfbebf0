"""Connected components by alternating large-star and small-star contractions.

Every round is two aggregations and two joins over the edge list, written to the checkpoint folder in as many
parts as its number of edges asks for. The driver sees only an edge count and a checksum. Node ids may be of any
orderable type.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verigrain.plans.durable import durable

EDGES_A_PART = 100_000


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node that has an edge; component is the smallest node reachable.

    Direction, repeated edges and loops do not matter; a loop alone makes a component of one. Edges with a null end
    are ignored. An empty edge list gives an empty result.
    """
    clean = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u IS NOT NULL AND v IS NOT NULL")
    high, low = F.greatest("u", "v"), F.least("u", "v")
    current, state = durable(clean.select(high.alias("u"), low.alias("v")).distinct()), None
    parts = current.count() // EDGES_A_PART + 1

    def written(df: DataFrame) -> DataFrame:
        return durable(df.coalesce(parts))

    for _ in range(max_rounds):
        both = current.union(current.select("v", "u")).toDF("u", "v")
        least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # Loops carry the nodes that are a component's smallest.
        large = written(large.union(least.where("u = m").select("u", "m")).toDF("u", "v").distinct())
        down = large.where("v < u")
        nearest = written(down.groupBy("u").agg(F.min("v").alias("m")))
        small = down.join(nearest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
        current = written(
            small.union(nearest.select("u", "m")).union(large.where("u = v")).toDF("u", "v").distinct()
        )
        row = current.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("decimal(38,0)"))).first()
        if tuple(row) == state:
            return current.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
        state = tuple(row)
    raise RuntimeError(f"no fixed point after {max_rounds} rounds")
