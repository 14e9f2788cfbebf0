"""Mixing sources to target weights by Poisson replication.

Every group (a named source, or all others together) gets a mean repetition rate: its target share of the output
divided by its share of the input. A document's copy count inverts the Poisson distribution of that mean at a
uniform number hashed from seed and id, so a rerun or a retried task draws the same counts. Copies are then dealt
to partitions and sorted there by a second hash, which shuffles the whole corpus.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verigrain.llm.columns import free_name, text_or_empty

OTHERS = "*"
#: exp(-rate) must not underflow; a larger mean is drawn as a sum of equal parts below it.
LARGEST_PART = 200.0


def hashed_uniform(*parts: Column) -> Column:
    """A double in [0, 1) from 52 bits of the MD5 of the parts joined by a bar."""
    digest = F.md5(F.concat_ws("|", *parts))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long").cast("double") / F.lit(float(1 << 52))


def poisson_cdf(mean: Column) -> Column:
    """P(X <= k) for k = 0, 1, ... as an array that reaches so far that the rest is below 2**-52."""
    last = F.ceil(mean + F.lit(12.0) * F.sqrt(mean) + F.lit(40.0)).cast("int")
    start = F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("c"), F.array(F.exp(-mean)).alias("all"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * mean / k.cast("double")
        return F.struct(p.alias("p"), (acc["c"] + p).alias("c"), F.concat(acc["all"], F.array(acc["c"] + p)).alias("all"))

    return F.aggregate(F.sequence(F.lit(1), last), start, step, lambda acc: acc["all"])


def mixing_rates(docs: DataFrame, weights: dict[str, float], source_col: str, text_col: str) -> DataFrame:
    """One row per group: grp, size (characters), rate, parts, cdf. At most ``len(weights) + 1`` rows."""
    given = F.create_map(*[F.lit(x) for k, w in weights.items() for x in (k, float(w))])
    sizes = docs.groupBy(_group(weights, source_col).alias("grp")).agg(F.sum(F.length(text_or_empty(text_col))).alias("size"))
    all_groups = Window.partitionBy(F.lit(0))  # at most len(weights) + 1 rows
    weight = F.coalesce(F.try_element_at(given, F.col("grp")), F.lit(0.0))
    # Summed in order of the names, so that a rerun rounds alike.
    present = F.aggregate(F.sort_array(F.collect_list(F.when(F.col("size") > 0, F.struct("grp", weight.alias("w")))).over(all_groups)), F.lit(0.0), lambda acc, x: acc + x["w"])
    sizes = sizes.select("grp", "size", weight.alias("weight"), present.alias("present"), F.sum("size").over(all_groups).cast("double").alias("whole"))
    scaled = F.col("weight") / F.col("present") * F.col("whole") / F.col("size").cast("double")
    rate = F.when((F.col("size") > 0) & (F.col("present") > 0), scaled).otherwise(F.lit(0.0))
    parts = F.greatest(F.lit(1), F.ceil(F.col("rate") / F.lit(LARGEST_PART)).cast("int"))
    return (
        sizes.select("grp", "size", rate.alias("rate"))
        .withColumn("parts", parts)
        .withColumn("cdf", poisson_cdf(F.col("rate") / F.col("parts")))
    )


def mix_sources(
    docs: DataFrame,
    weights: dict[str, float],
    seed: int = 0,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    partitions: int | None = None,
) -> DataFrame:
    """Every document repeated by its Poisson count, in shuffled order; adds copy (from 1), n_copies, shuffle_key.

    ``weights`` names sources and their target shares of all characters; the key ``*`` stands for every source
    not named, null included, as one group. A group without a weight, or with weight 0, vanishes. Shares are
    divided by the sum of those of groups that occur and have text, so the output has about as many characters as
    the input. If only groups of weight 0 occur, nothing is left.

    * Null source: group ``*``. Null text: no characters; the document is drawn at its group's rate like any other.
      A group whose texts are all empty has no size to scale by and gets rate 0.
    * Rows that repeat an id get equal counts and keys; both appear. A row with a null id draws by its text's hash.
    * Columns of ``docs`` named copy, n_copies or shuffle_key are replaced; all others are kept.
    * Empty table: empty result.
    """
    if not weights or any(w < 0 for w in weights.values()) or math.fsum(weights.values()) <= 0:
        raise ValueError("weights must be non-negative and not all zero")
    docs = docs.drop("copy", "n_copies", "shuffle_key")
    grp, part_cdf, parts, count = (free_name(docs, x) for x in ("grp", "cdf", "parts", "count"))
    rates = mixing_rates(docs, weights, source_col, text_col).select(
        F.col("grp").alias(grp), F.col("parts").alias(parts), F.col("cdf").alias(part_cdf)
    )
    ident = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("null|"), F.md5(text_or_empty(text_col))))

    def one(part: Column) -> Column:
        u = hashed_uniform(F.lit(str(seed)), ident, part.cast("string"))
        return F.size(F.filter(F.col(part_cdf), lambda c: c <= u))

    drawn = F.aggregate(F.sequence(F.lit(1), F.col(parts)), F.lit(0), lambda acc, i: acc + one(i))
    key = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(f"{seed} order"), ident, F.col("copy").cast("string"))), 1, 15), 16, 10)
    copies = (
        docs.withColumn(grp, _group(weights, source_col))
        .join(F.broadcast(rates), grp)  # at most len(weights) + 1 rows
        .withColumn(count, drawn)
        .where(F.col(count) > 0)
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col(count))))
        .withColumn("n_copies", F.col(count))
        .withColumn("shuffle_key", key.cast("long"))
        .drop(grp, parts, part_cdf, count)
    )
    dealt = copies.repartition(partitions, "shuffle_key") if partitions else copies.repartition("shuffle_key")
    return dealt.sortWithinPartitions("shuffle_key")


def _group(weights: dict[str, float], source_col: str) -> Column:
    named = [k for k in weights if k != OTHERS]
    source = F.col(source_col).cast("string")
    return F.when(source.isin(named), source).otherwise(F.lit(OTHERS)) if named else F.lit(OTHERS)
