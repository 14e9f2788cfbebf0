"""A keyed table on files: batches are merged in by key, what has not been touched for long expires in the same pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verigrain.plans.durable import durable

BUCKET = "bucket"


class KeyedStore:
    """first_seen, last_seen and the latest attributes of each key, in a Parquet table of so many buckets of keys.

    A merge reads and replaces only the buckets that its batch touches (dynamic partition overwrite). What it writes
    depends on what it read and on the batch by minimum, maximum and latest alone, so a batch that is run again changes
    nothing, and one that failed half-way is simply run again. All its rows are on disk elsewhere before a bucket is
    replaced.
    """

    def __init__(self, spark: SparkSession, folder: str, key: str, attributes: tuple[str, ...], buckets: int = 64):
        self.spark, self.folder, self.key, self.attributes, self.buckets = spark, folder, key, attributes, buckets

    def _shaped(self, batch: DataFrame, at: str) -> DataFrame:
        seen = batch.where(F.col(self.key).isNotNull() & F.col(at).isNotNull())
        place = F.pmod(F.xxhash64(F.col(self.key)), F.lit(self.buckets)).cast("int")
        return seen.select(self.key, F.col(at).alias("first_seen"), F.col(at).alias("last_seen"), *self.attributes, place.alias(BUCKET))

    def read(self, schema: DataFrame | None = None) -> DataFrame:
        """The rows of the table now; without a table those of ``schema``, which must be empty."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        if path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path) or schema is None:
            return self.spark.read.parquet(self.folder)
        return schema

    def merge(self, batch: DataFrame, at: str, as_of: Column, days: int) -> None:
        """Touch the keys of ``batch`` (times in ``at``); of the buckets it touches, keys last seen more than ``days``
        before ``as_of`` go. Rows without a key or a time are left out; equal times are settled by the attributes."""
        new = durable(self._shaped(batch, at))
        touched = [r[0] for r in new.select(BUCKET).distinct().collect()]  # at most ``buckets``
        if not touched:
            return
        old = self.read(new.limit(0)).where(F.col(BUCKET).isin(touched)).select(new.columns)
        latest = F.max(F.struct("last_seen", *self.attributes)).alias("latest")
        merged = old.union(new).groupBy(self.key, BUCKET).agg(F.min("first_seen").alias("first_seen"), latest)
        kept = merged.where(F.col("latest.last_seen") >= as_of - F.make_dt_interval(F.lit(days)))
        rows = durable(kept.select(self.key, "first_seen", "latest.*", BUCKET))
        # A bucket that is left without rows has to be replaced too; a row without a key stands for it.
        blank = self.spark.createDataFrame([(b,) for b in touched], f"{BUCKET} int").join(rows.select(BUCKET).distinct(), BUCKET, "left_anti")
        rows = rows.unionByName(blank, allowMissingColumns=True)
        rows.repartition(BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(self.folder)

    def rows(self) -> DataFrame:
        """key, first_seen, last_seen and attributes of the keys that the store holds."""
        return self.read().where(F.col(self.key).isNotNull()).select(self.key, "first_seen", "last_seen", *self.attributes)
