"""Exact duplicates by progressive refinement: length, then prefix hash, then full hash.

The first pass reads lengths and a hash of the first characters, and keeps the (length, prefix hash) pairs that
more than one row has. The second pass hashes the full content only of rows whose pair is among them. Rows that
survive are grouped by the full SHA-256. Texts never enter a shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verigrain.llm.columns import ascii_lower, bitmap_of, salted_join, text_or_empty, with_bitmap_flag
from verigrain.plans.durable import durable

PREFIX_CHARS = 64


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    prefix_chars: int = PREFIX_CHARS,
    digest_col: str | None = None,
) -> DataFrame:
    """One row per input row: ``id_col``, keep_id, group_size and kept.

    If ``digest_col`` is given, it holds the hexadecimal SHA-256 of every text after lower-casing. Then all full
    contents are hashed, each once, and the refinement saves only what is shuffled and compared.

    Two texts are equal when identical after lower-casing A-Z. The row with the largest id of each group stays.

    * A null text counts as empty; all empty texts form one group. A null id is the smallest.
    * Rows that repeat an id and its text count in group_size, and all of them are marked alike.
    * An empty table gives an empty result. Other columns of ``docs`` are ignored, whatever their names.
    * Any number of copies: groups are aggregated before the shuffle, and the join back deals the rows of groups of
      more than ``HOT_GROUP`` over several keys.
    """
    raw = text_or_empty(text_col)
    length = F.length(raw)
    prefix = F.xxhash64(ascii_lower(F.substring(raw, 1, prefix_chars)))
    sized = docs.select(length.alias("n"), prefix.alias("p"))
    shared = sized.groupBy("n", "p").count().where("count > 1")
    bitmap = bitmap_of(shared, F.xxhash64("n", "p"))

    rows = docs.select(F.col(id_col).alias("row_id"), ascii_lower(raw).alias("text"), length.alias("n"), prefix.alias("p"))
    rows = with_bitmap_flag(rows, F.xxhash64("n", "p"), bitmap, "survives")
    whole = F.sha2("text", 256)
    if digest_col is not None:
        rows = rows.withColumn("digest", whole)
        whole = F.col("digest")
    digest = ["digest"] if digest_col is not None else []
    rows = durable(rows.select("row_id", "n", "p", F.when(F.col("survives"), F.unhex(whole)).alias("full"), *digest))
    groups = durable(
        rows.where(F.col("full").isNotNull())
        .groupBy("n", "p", "full")
        .agg(F.max("row_id").alias("keep"), F.count(F.lit(1)).alias("size"))
        .where("size > 1")
    )
    joined = salted_join(rows, groups, ["n", "p", "full"], "size")
    keep = F.when(F.col("size").isNotNull(), F.col("keep")).otherwise(F.col("row_id"))
    return joined.select(
        F.col("row_id").alias(id_col),
        keep.alias("keep_id"),
        F.coalesce("size", F.lit(1).cast("long")).alias("group_size"),
        F.col("row_id").eqNullSafe(keep).alias("kept"),
        *[F.col(c).alias(digest_col) for c in digest],
    )
