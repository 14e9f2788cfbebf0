"""All pairs of the members of a key, in blocks, so that a key with very many members is no single task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verigrain.config import CONFIG


def block_pairs(rows: DataFrame, keys: list[str], member: str, block: int = CONFIG.max_fanout) -> DataFrame:
    """``keys``, src and dst (src < dst) for each two rows of a key with different members; null keys pair nothing.

    The members of a key are dealt by hash into as many blocks of about ``block`` as they need, and each block meets
    itself and every other once. No pair is left out; ``block`` only decides how the work is divided.
    """
    counts = rows.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).cast("int").alias("blocks"), F.count(F.lit(1)).alias("of_key"))
    dealt = rows.select(*keys, F.col(member).alias("m")).join(counts.where("of_key > 1").drop("of_key"), keys)
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("m"), F.col("blocks")).cast("int"))
    left = dealt.select(*keys, F.col("m").alias("left_m"), F.col("own").alias("i"), F.explode(F.sequence("own", F.col("blocks") - 1)).alias("j"))
    right = dealt.select(*keys, F.col("m").alias("right_m"), F.explode(F.sequence(F.lit(0), F.col("own"))).alias("i"), F.col("own").alias("j"))
    met = left.join(right, [*keys, "i", "j"]).where("i < j OR left_m < right_m")
    return met.select(*keys, F.least("left_m", "right_m").alias("src"), F.greatest("left_m", "right_m").alias("dst"))
