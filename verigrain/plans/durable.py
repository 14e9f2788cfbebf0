"""Lineage cuts that survive the loss of an executor.

Everything goes to the folder that the cluster names in ``spark.checkpoint.dir``. Only where a local session
names none (unit tests) is a folder of our own used; a cluster must name one.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

OWN_FOLDER = "/tmp/checkpoints/verigrain"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Make ``DataFrame.checkpoint`` usable without touching a folder that the cluster configured."""
    context = spark.sparkContext
    configured = context.getConf().get("spark.checkpoint.dir", None)
    if not context._jsc.sc().getCheckpointDir().isDefined():
        if not configured and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(configured or OWN_FOLDER)


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder now and continue from the written copy.

    A checkpoint also remembers the size that the planner had estimated, and a join multiplies the sizes of its
    sides: in a loop the number of digits doubles from round to round until planning takes longer than running.
    So the written rows are wrapped anew, without an estimate.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    written = df.checkpoint(eager=True)._jdf
    rows = written.queryExecution().toRdd()
    out = DataFrame(spark._jsparkSession.internalCreateDataFrame(rows, written.schema(), False), spark)
    out._checkpoint = written.logicalPlan().rdd().getCheckpointFile()
    return out


def discard(df: DataFrame) -> None:
    """Delete the written copy of a ``durable`` table that nothing will read again, before Spark would."""
    file = df._checkpoint
    if file.isDefined():
        context = df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(file.get())
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Plans that are run inside have these settings (dots written as two underscores)."""
    keys = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def batches_of(spark: SparkSession, rows: int):
    """Plans that are run inside send at most so many rows to Python at once; long texts then need less memory."""
    return settings(spark, spark__sql__execution__arrow__maxRecordsPerBatch=str(rows))
