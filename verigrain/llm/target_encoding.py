"""Target encoding in order of time: rates of earlier rows, other folds only.

What happened before a moment is a step function of time. A validity table has its steps: the counts of a key hold
from an event's time plus the gap (exclusive) to the next change (inclusive). It is made and asked in time bins: a
key of many rows has many short bins, so no task gets all its rows. An interval that reaches over the end of a bin is
split there; what lies before a bin comes from prefix sums over bins, taken 256 at a time, level by level. A moment is
looked up by a range join within its key, bin and fold; the component of its own fold has been taken off that of the key.

Rows of one key and moment are summed up before anything is sorted, so a hot sale is one step and one look-up.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verigrain.llm.token_files import shared_folder
from verigrain.plans.durable import durable, settings

#: Rows of a key that a bin has on average, at most twice as many; bits of bins at most; bits of a level of prefix sums.
ROWS_OF_BIN, MOST_LEVEL, FAN = 32, 24, 8
PRIOR, WEIGHT, UNIT, LEAST = 500_000, 50, 1_000_000, 1
_FIRST = -(1 << 63)


class Clock(NamedTuple):
    """Times are bigint and lie from ``start`` on, below ``start`` + 2**``bits``."""

    start: int
    bits: int


def clock_of(rows: DataFrame, at: str, gap: int = 0) -> Clock:
    """One row is read on the driver."""
    low, high = rows.agg(F.min(at), F.max(at)).first()
    return Clock(low or 0, max(((high or 0) + gap - (low or 0)).bit_length(), 1))


def level_of(rows: Column) -> Column:
    """Bits of the bins of a key with so many rows."""
    level = F.ceil(F.log2(F.greatest(rows, F.lit(1)) / F.lit(float(ROWS_OF_BIN))))
    return F.least(F.greatest(level, F.lit(0)), F.lit(MOST_LEVEL)).cast("int")


def _before(bins: DataFrame, keys: list[str], counts: list[str], level: int) -> DataFrame:
    """``bins`` with the sums over all earlier bins of the key in place of their own."""
    block = F.shiftright("bin", FAN)
    within = Window.partitionBy(*keys, "block").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)  # 256 rows at most
    found = bins.withColumn("block", block).select(*keys, "bin", "block", *[F.coalesce(F.sum(c).over(within), F.lit(0)).alias(c) for c in counts])
    if level <= FAN:
        return found.drop("block")
    blocks = bins.groupBy(*keys, block.alias("bin")).agg(*[F.sum(c).alias(c) for c in counts])
    above = _before(blocks, keys, counts, level - FAN).select(*keys, F.col("bin").alias("block"), *[F.col(c).alias(f"{c}_above") for c in counts])
    return found.join(above, [*keys, "block"]).select(*keys, "bin", *[(F.col(c) + F.col(f"{c}_above")).alias(c) for c in counts])


def bins_before(rows: DataFrame, keys: list[str], folds: int, level: int) -> DataFrame | None:
    """Counts n0_before, s0_before, ... that a key has before each of its bins; None where each key has one bin.

    They are summed up from the rows themselves and written before any level of prefix sums reads them, since a bin is
    many rows; the points are then read for the steps alone.
    """
    if not level:
        return None
    each = {f"{c}{f}": F.when(F.col("fold") == f, F.col(c)).otherwise(F.lit(0).cast("bigint")) for c in "ns" for f in range(folds)}
    bins = _written(rows.groupBy(*keys, "bin").agg(*[F.sum(x).alias(c) for c, x in each.items()]))
    return _before(bins, keys, list(each), level).withColumnsRenamed({c: f"{c}_before" for c in each})


def validity(points: DataFrame, slot: list[str], folds: int, before: DataFrame | None) -> DataFrame:
    """since (exclusive), until (inclusive) and counts n and s of other folds than ``fold`` in each step, split at bins.

    ``points`` has a row for each ``slot`` (key and bin), time and fold, with n and s to be added after that time; ``before`` is that of
    ``bins_before``. A fold's component is a running sum of its own points. A step ends at a point of the fold; no moment is asked
    for that is no point, so a fold needs no steps that end at points of others, and none behind the last of a bin.
    """
    earlier = Window.partitionBy(*slot).orderBy("at").rangeBetween(Window.unboundedPreceding, -1)  # no row of the same time
    own = Window.partitionBy(*slot, "fold").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    of = lambda x, rows: F.coalesce(F.sum(x).over(rows), F.lit(0))
    steps = points.select(*slot, "fold", "at", "n", "s", F.coalesce(F.max("at").over(earlier), F.lit(_FIRST)).alias("since"), *[of(c, earlier).alias(f"{c}_all") for c in "ns"])
    steps = steps.select(*slot, "fold", "since", F.col("at").alias("until"), *[(F.col(f"{c}_all") - of(c, own)).alias(c) for c in "ns"])
    if before is None:
        return steps
    total = {c: sum((F.col(f"{c}{f}_before") for f in range(1, folds)), F.col(f"{c}0_before")) for c in "ns"}
    part = {c: F.coalesce(*[F.when(F.col("fold") == f, F.col(f"{c}{f}_before")) for f in range(folds)]) for c in "ns"}
    return steps.join(before, slot).select(*slot, "fold", "since", "until", *[(F.col(c) + total[c] - part[c]).alias(c) for c in "ns"])


def history(rows: DataFrame, keys: Sequence[str], level: Column, most: int, clock: Clock, folds: int, gap: int = 0) -> DataFrame:
    """``keys``, at, fold, n and s for each key, time and fold of ``rows``: what other folds had more than ``gap`` before.

    ``rows`` has at (bigint), fold (int from 0), n and s (what a row counts) and ``keys``, none of them null. ``level``
    depends on the key alone and is at most ``most``. Beside them stand n_then and s_then, what the key, time and fold
    itself counts: with them, moments and steps are read from one shuffle of the points.
    """
    keys = list(keys)
    slot = ["bin", *keys] if most > FAN else [*keys, "bin"]  # sorts compare the first column before whole rows
    zero = F.lit(0).cast("bigint")
    narrow = rows.select(*keys, level.alias("level"), "at", "fold", "n", "s", F.lit(1).alias("asked"))
    if gap:
        told = narrow.withColumns({"at": F.col("at") + F.lit(gap), "asked": F.lit(0)})
        narrow = told.unionByName(narrow.withColumns({"n": zero, "s": zero}))
    shift = F.greatest(F.lit(clock.bits) - F.col("level"), F.lit(0))
    binned = narrow.withColumn("bin", F.call_function("shiftright", F.col("at") - F.lit(clock.start), shift))
    known = binned.where(" AND ".join(f"`{c}` IS NOT NULL" for c in (*keys, "bin", "at", "fold")))
    before = bins_before(known, keys, folds, most)
    summed = known.groupBy(*keys, "bin", "at", "fold").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), *([F.max("asked").alias("asked")] if gap else []))
    points = summed.repartition(*slot)
    probes = (points.where("asked = 1") if gap else points).select(*slot, "at", "fold", F.col("n").alias("n_then"), F.col("s").alias("s_then"))
    met = probes.join(validity(points, slot, folds, before), [*slot, "fold"]).where("since < at AND at <= until")
    return met.select(*keys, "at", "fold", "n", "s", "n_then", "s_then")


def rate(n: Column, s: Column, prior: Column) -> Column:
    """Millionths: the prior without enough rows, else pulled towards it as if ``WEIGHT`` rows had had it."""
    seen = F.call_function("div", F.lit(UNIT) * s + F.lit(WEIGHT) * prior, n + F.lit(WEIGHT))
    return F.when(n < LEAST, prior).otherwise(seen).cast("bigint")


def _group(value: Column) -> Column:
    """A name for each value; null, and what is unknown, share the empty one."""
    return F.coalesce(F.concat(F.lit("="), value.cast("string")), F.lit(""))


def described(uses: DataFrame, key: str, table: DataFrame, value: str) -> tuple[DataFrame, int, int]:
    """``key``, its level, its group by ``table``'s ``value`` and the group's level; and the highest of both levels.

    Should ``table`` repeat a key, the smallest value counts; keys that it lacks are of the shared group.
    """
    used = uses.groupBy(key).agg(F.count(F.lit(1)).alias("rows"))
    known = table.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(value).alias("value"))
    keyed = durable(used.join(known, key, "left").select(key, "rows", _group(F.col("value")).alias("grp")))
    groups = keyed.groupBy("grp").agg(F.sum("rows").alias("of_group"))
    found = keyed.join(groups, "grp").select(key, level_of(F.col("rows")).alias(f"{key}_level"), "grp", level_of(F.col("of_group")).alias("grp_level"))
    most = keyed.agg(level_of(F.max("rows"))).first()[0] or 0, groups.agg(level_of(F.max("of_group"))).first()[0] or 0
    return found, *most


def encode_lines(lines: DataFrame, sales: DataFrame, items: DataFrame, vendors: DataFrame, clients: DataFrame, folds: int = 5, gap: int = 0, target: str = "returned") -> DataFrame:
    """Per sale_id, item_id and vendor_id: n_lines, n_returned, and counts and rates of item, vendor and client.

    A line's history is all lines of other folds that were sold more than ``gap`` microseconds earlier; the fold is
    the crc32 of the sale's digits. The rate of all history is the prior of the rates of the item's kind, the vendor's
    nation and the client's segment, and these are the priors of item, vendor and client.

    Lines without a sale or a time are left out. Null item_id and client_id count as -1; a null vendor_id is a value
    of its own and stays null. Null and unknown kinds, nations and segments share one group each. Lines that repeat
    count as often as they occur; should a sale repeat, its lines meet each of its rows. A null flag is not the
    target. Empty tables give an empty result. Other columns are ignored.
    """
    spark = lines.sparkSession
    with settings(spark, spark__sql__session__timeZone="UTC"):  # times without a zone are numbered as if in UTC
        sold = sales.where("sale_id IS NOT NULL AND sold_at IS NOT NULL").select(
            "sale_id", F.unix_micros(F.col("sold_at").cast("timestamp")).alias("at"), F.coalesce("client_id", F.lit(-1)).cast("bigint").alias("client_id"),
            (F.crc32(F.col("sale_id").cast("string").cast("binary")) % folds).cast("int").alias("fold"),
        )
    clock = clock_of(sold, "at", gap)
    plain = lines.where("sale_id IS NOT NULL").select(
        "sale_id", F.coalesce("item_id", F.lit(-1)).cast("bigint").alias("item_id"), F.coalesce(F.col("vendor_id").cast("bigint"), F.lit(_FIRST)).alias("vendor_id"),
        F.coalesce((F.col("flag") == target).cast("bigint"), F.lit(0).cast("bigint")).alias("s"),
    )
    item, item_most, kind_most = described(plain, "item_id", items, "kind")
    vendor, vendor_most, nation_most = described(plain, "vendor_id", vendors, "nation_id")
    client, client_most, segment_most = described(sold, "client_id", clients, "segment")
    named = lambda df, name: df.withColumnsRenamed({"grp": name, "grp_level": f"{name}_level"})
    own = plain.groupBy("sale_id", "item_id", "vendor_id").agg(F.count(F.lit(1)).alias("n"), F.sum("s").alias("s"))
    base = own.join(sold.drop("client_id"), "sale_id").join(named(item, "kind"), "item_id").join(named(vendor, "nation"), "vendor_id")
    base = _written(base)
    of_sale = base.groupBy("sale_id", "at", "fold").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    by_sale = _written(of_sale.join(sold, ["sale_id", "at", "fold"]).join(named(client, "segment"), "client_id"))

    def past(rows: DataFrame, key: str, most: int) -> DataFrame:
        found = history(rows, [key], F.col(f"{key}_level"), most, clock, folds, gap)
        with settings(spark, spark__sql__requireAllClusterKeysForCoPartition="false"):  # dealt by key and bin, joined by fold too
            return _written(found.withColumnsRenamed({"n": f"{key}_n", "s": f"{key}_s"})).drop("n_then", "s_then")  # one small plan after the other

    # All history has one key; its bins are as many as all sales need.
    sales_level = by_sale.agg(level_of(F.count(F.lit(1)))).first()[0]
    every = by_sale.withColumns({"all_": F.lit(0), "all__level": F.lit(sales_level)})
    def beside(out: DataFrame, rows: DataFrame, key: str, most: int, prior: str, count: str | None = None) -> DataFrame:
        """``out`` with the key's rate, and its count if that has a name; the group or prior that nothing else reads is dropped."""
        by = ["at", "fold", *([key] if key != "all_" else [])]  # times tell rows apart, so sorts compare them first
        seen = rate(F.col(f"{key}_n"), F.col(f"{key}_s"), F.col(prior) if prior else F.lit(PRIOR).cast("bigint"))
        kept = [c for c in out.columns if c not in ((key,) if count is None else (prior,))]
        return out.join(past(rows, key, most), by).select(*kept, *([F.col(f"{key}_n").alias(count)] if count else []), seen.alias(f"{key}_rate"))

    of_client = by_sale.select("sale_id", "at", "fold", "client_id", "segment")
    of_client = beside(of_client, every, "all_", sales_level, "")
    of_client = beside(of_client, by_sale, "segment", segment_most, "all__rate")
    of_client = beside(of_client, by_sale, "client_id", client_most, "segment_rate", "client_n")
    of_client = _written(of_client.select("sale_id", "at", "fold", F.col("all__rate").alias("prior"), "client_n", F.col("client_id_rate").alias("client_rate")))
    out = base.select("sale_id", "item_id", "vendor_id", "n", "s", "at", "fold", "kind", "nation").join(of_client, ["sale_id", "at", "fold"])
    out = beside(out, base, "kind", kind_most, "prior")
    out = beside(out, base, "nation", nation_most, "prior").drop("prior")
    out = beside(out, base, "item_id", item_most, "kind_rate", "item_n")
    out = beside(out, base, "vendor_id", vendor_most, "nation_rate", "vendor_n")
    return out.select(
        "sale_id", "item_id", F.when(F.col("vendor_id") != _FIRST, F.col("vendor_id")).alias("vendor_id"), F.col("n").alias("n_lines"), F.col("s").alias("n_returned"),
        "item_n", F.col("item_id_rate").alias("item_rate"), "vendor_n", F.col("vendor_id_rate").alias("vendor_rate"), "client_n", "client_rate",
    )


def _written(df: DataFrame) -> DataFrame:
    folder = shared_folder(df.sparkSession, "encoding")
    # A dictionary of times, ids or counts is as large as the column.
    df.write.option("compression", "lz4_raw").option("parquet.enable.dictionary", "false").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
