"""Where results go: tables, metrics and alerts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from verigrain.operators.monitoring import histogram


def write_table(df: DataFrame, path: str, kind: str = "parquet", partition_by: tuple[str, ...] = (), mode: str = "overwrite") -> None:
    df.write.format(kind).mode(mode).partitionBy(*partition_by).save(path)


def write_bucketed(df: DataFrame, table: str, keys: tuple[str, ...], buckets: int) -> None:
    """A table whose later joins and groupings on ``keys`` need no shuffle."""
    df.write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(table)


def metric_rows(scored: DataFrame) -> DataFrame:
    """name, label and value of the counters and cumulative histogram buckets that monitoring scrapes."""
    levels = scored.groupBy("risk_level").agg(F.count(F.lit(1)).cast("double").alias("value")).select(F.lit("identities_scored_total").alias("name"), F.col("risk_level").alias("label"), "value")
    buckets = histogram(scored).select(F.lit("score_bucket"), F.col("le").cast("string"), F.col("count").cast("double"))
    return levels.union(buckets)


def gauge_rows(name: str, rows: DataFrame, label: str) -> DataFrame:
    """A gauge: how many of ``rows`` have each value of ``label`` now."""
    return rows.groupBy(F.col(label).cast("string").alias("label")).agg(F.count(F.lit(1)).cast("double").alias("value")).select(F.lit(name).alias("name"), "label", "value")


def observed(df: DataFrame, name: str, **metrics: Column) -> tuple[DataFrame, Observation]:
    """``df`` that counts ``metrics`` while it is written for another purpose, and where they can be read afterwards."""
    seen = Observation(name)
    return df.observe(seen, *[c.alias(k) for k, c in metrics.items()]), seen


#: Seconds up to which the buckets of the latency histogram count.
LATENCY_BUCKETS = (0.01, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0)


class BatchLatency(StreamingQueryListener):
    """Rows and seconds of every micro-batch of the session's streams, and their cumulative histogram as metric rows."""

    def __init__(self) -> None:
        self.batches: list[tuple[str, int, int, float]] = []

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.batches.append((p.name or str(p.id), p.batchId, p.numInputRows, p.batchDuration / 1000))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def rows(self, spark: SparkSession) -> DataFrame:
        """name, label (seconds, or +Inf), value; one row for each bucket."""
        seconds = [s for *_, s in self.batches]
        found = [("scoring_latency_seconds", str(le), float(sum(s <= le for s in seconds))) for le in LATENCY_BUCKETS]
        return spark.createDataFrame([*found, ("scoring_latency_seconds", "+Inf", float(len(seconds)))], "name string, label string, value double")


def alert_rows(scored: DataFrame) -> DataFrame:
    """One JSON line per identity of the two highest levels."""
    high = scored.where(F.col("risk_level").isin("critical", "high"))
    return high.select(F.to_json(F.struct(F.lit("fraud_alert").alias("type"), "identity_key", "risk_level", "score")).alias("value"))


def for_each_batch(*handlers: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """Handlers in order over each micro-batch, which is read once."""

    def run(batch: DataFrame, epoch: int) -> None:
        batch.persist()
        try:
            for handler in handlers:
                handler(batch, epoch)
        finally:
            batch.unpersist()

    return run
