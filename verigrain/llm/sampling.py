"""Folds and bounded samples of labelled rows, for the three classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from verigrain.llm.columns import free_name


MOST_STRATA = 2000


def crc_fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds


def hash_fraction(key: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on key and seed alone."""
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))


def bounded(df: DataFrame, id_col: str, strata: str, cap: int, seed: int, in_all: int | None = None) -> DataFrame:
    """About ``cap`` rows at most of each value of ``strata``, chosen by a hash of the id; about ``in_all`` together.

    Of more than ``MOST_STRATA`` values only the most frequent are sampled, the smaller of ties. Their shares are a table
    of so many rows at most, which is broadcast.
    """
    spark, values = df.sparkSession, df.where(F.col(strata).isNotNull()).groupBy(strata).count()
    sizes = values.orderBy(F.desc("count"), strata).limit(MOST_STRATA).collect()
    if not sizes:
        return df.limit(0)
    if in_all is not None:
        cap = min(cap, max(in_all // len(sizes), 1))
    share = free_name(df, "share")
    shares = spark.createDataFrame([(r[0], min(1.0, cap / r[1])) for r in sizes], StructType([StructField(strata, df.schema[strata].dataType), StructField(share, DoubleType())]))
    return df.join(F.broadcast(shares), strata).where(hash_fraction(F.col(id_col), seed) < F.col(share)).select(*df.columns)


def labelled_sample(labels: DataFrame, label: str, id_col: str, folds: int, held_out: int, cap: int, seed: int) -> DataFrame:
    """id and label of at most about ``cap`` rows of each label outside the held-out fold; small enough to broadcast.

    Null ids and null labels are left out; of several labels of one id the largest counts.
    """
    usable = (
        labels.where(F.col(label).isNotNull() & (crc_fold(id_col, folds) != held_out))
        .groupBy(id_col).agg((F.max(label) > 0).cast("int").alias("sample_label"))
    )
    return bounded(usable, id_col, "sample_label", cap, seed)
