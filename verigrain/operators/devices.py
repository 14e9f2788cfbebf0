"""Device binding, consistency, sharing and switching, from a log of device uses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verigrain.functions import identity as I
from verigrain.functions.basics import before, elapsed_days


def device_bindings(uses: DataFrame, as_of: Column) -> DataFrame:
    """Per identity and device: uses, days since the first, primary (most used, then smallest id), other devices,
    binding score, gap regularity and risk."""
    gap = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(Window.partitionBy("identity_key", "device").orderBy("ts")).cast("timestamp"))
    pair = (
        uses.withColumn("gap", gap / 1e6).groupBy("identity_key", "device")
        .agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"), F.avg("gap").alias("mean_gap"), F.stddev_pop("gap").alias("std_gap"))
    )
    own = Window.partitionBy("identity_key")
    days = elapsed_days(as_of, F.col("first"))
    rank = F.row_number().over(own.orderBy(F.desc("n"), "device"))
    ranked = pair.withColumn("is_primary", rank == 1).withColumn("devices", F.count(F.lit(1)).over(own)).withColumn("days", days)
    ranked = ranked.withColumn("span_days", elapsed_days(F.max("last").over(own), F.min("first").over(own)))
    binding = I.binding_score(F.col("n"), F.col("days"), F.col("is_primary"), F.col("devices") - 1)
    rate = I.change_rate(F.col("devices"), F.col("span_days"))
    return (
        ranked.withColumn("binding_score", binding).withColumn("change_rate", rate)
        .withColumn("consistency_score", I.consistency_score(F.col("n"), F.col("mean_gap"), F.col("std_gap")))
        .withColumn("binding_risk", I.binding_risk(F.lit(False), F.col("change_rate"), F.col("binding_score"), F.col("devices")))
    )


def device_history(uses: DataFrame) -> DataFrame:
    """Per identity: number of devices, primary device, change rate and the suspicious flag."""
    pair = uses.groupBy("identity_key", "device").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    found = pair.groupBy("identity_key").agg(
        F.count(F.lit(1)).alias("devices"), F.min(F.struct((-F.col("n")).alias("order"), "device"))["device"].alias("primary_device"),
        elapsed_days(F.max("last"), F.min("first")).alias("span_days"),
    )
    rate = I.change_rate(F.col("devices"), F.col("span_days"))
    return found.withColumn("change_rate", rate).withColumn("is_suspicious", (F.col("change_rate") > 3) | (F.col("devices") > 10))


def device_sharing(uses: DataFrame, least: int = 3) -> DataFrame:
    found = uses.groupBy("device").agg(F.count_distinct("identity_key").alias("identities"))
    return found.withColumn("is_shared", F.col("identities") >= least).withColumn("sharing_risk", I.sharing_risk(F.col("identities"), least))


def device_switching(uses: DataFrame, as_of: Column, hours: int = 24) -> DataFrame:
    recent = uses.where(F.col("ts") >= as_of - F.expr(f"INTERVAL {hours} HOURS"))
    found = recent.groupBy("identity_key").agg(F.count_distinct("device").alias("devices"))
    name, risk = I.switching(F.col("devices"))
    return found.withColumn("anomaly", name).withColumn("risk", risk)


def recent_uses(uses: DataFrame, as_of: Column, days: int) -> DataFrame:
    return uses.where(F.col("ts") >= before(as_of, days))
