"""Column builders and the fixed-size membership bitmap that the native operators share."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: 2**23 bits: at most 256 rows of 4 KiB, so a broadcast of the bitmap is 1 MiB however large the input is.
BITMAP_BITS = 1 << 23


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; every other code point stays as it is."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that clashes with none of ``df``'s."""
    taken = {c.lower() for c in df.columns}
    name = f"__{wanted}"
    while name.lower() in taken:
        name += "_"
    return name


def bits_for(keys: int) -> int:
    """Bits of a bitmap for so many keys: 16 a key, so that one in 16 of other keys errs, and at most 8 MiB."""
    return 1 << min(max((16 * keys).bit_length(), 23), 26)


def bitmap_of(keys: DataFrame, key: Column, bits: int = BITMAP_BITS) -> DataFrame:
    """The set bits of ``key`` (a 64-bit hash) as rows of 4 KiB, at most 256 by default (``bm_bucket``, ``bm_bits``)."""
    place = F.pmod(key, F.lit(bits))
    return (
        keys.select(place.alias("bm_place"))
        .groupBy(F.bitmap_bucket_number("bm_place").alias("bm_bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("bm_place")).alias("bm_bits"))
    )


def with_bitmap_flag(df: DataFrame, key: Column, bitmap: DataFrame, flag: str, bits: int = BITMAP_BITS) -> DataFrame:
    """Add boolean ``flag``: true wherever ``key`` is in the bitmap, and for a few others (hash collisions)."""
    place = F.pmod(key, F.lit(bits))
    bit = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substring("bm_bits", (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    probed = df.withColumn("bm_at", F.bitmap_bucket_number(place)).join(
        F.broadcast(bitmap), F.col("bm_at") == F.col("bm_bucket"), "left"
    )
    hit = F.getbit(byte, (bit % 8).cast("int")) == 1
    return probed.withColumn(flag, F.coalesce(hit, F.lit(False))).drop("bm_at", "bm_bucket", "bm_bits")


#: Groups of more rows are hot: their rows are dealt over so many salts.
HOT_GROUP, SALTS = 256, 64


def salted_join(rows: DataFrame, groups: DataFrame, keys: list[str], size: str) -> DataFrame:
    """``rows`` left-joined with ``groups`` (one row per value of ``keys``, whose number of rows is ``size``).

    A bitmap of the hot groups tells both sides alike which keys are salted, also where it errs; the group's one row is
    repeated for each salt. So no task gets all rows of a group.
    """
    key = F.xxhash64(*keys)
    hot = bitmap_of(groups.where(F.col(size) > HOT_GROUP), key)
    salt = F.when(F.col("hot_key"), F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))).otherwise(F.lit(0))
    salts = F.when(F.col("hot_key"), F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    rows = with_bitmap_flag(rows, key, hot, "hot_key").withColumn("salt", salt.cast("long")).drop("hot_key")
    groups = with_bitmap_flag(groups, key, hot, "hot_key").withColumn("salt", F.explode(salts)).drop("hot_key")
    return rows.join(groups, [*keys, "salt"], "left").drop("salt")
