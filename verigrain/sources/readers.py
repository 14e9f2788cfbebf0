"""Reading the inputs: dimension files, lists, JSON records with a dead-letter side, and streams of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamReader

from verigrain.functions.identity import DISPOSABLE

APPLICATION = (
    "application_id string, ssn_hash string, ssn_last4 string, ssn_first5 string, dob string, first_name string, last_name string, "
    "address struct<street:string,city:string,state:string,zip:string>, phone string, email string, application_date string, "
    "application_type string, requested_amount double, device_fingerprint string, ip_address string"
)
APPLICATION_REQUIRED = ("application_id", "ssn_hash", "dob", "first_name", "last_name", "address", "phone", "email", "application_date")
ALERT = (
    "alert_id string, alert_type string, ssn_hash string, identity_hash string, reported_by string, reported_date string, "
    "confidence_score double, details map<string,string>, related_identities array<string>"
)
ALERT_REQUIRED = ("alert_id", "alert_type", "identity_hash", "reported_by", "reported_date")
# Kinds of consortium alerts.
ALERT_TYPES = ("synthetic_identity", "bust_out", "fraud_ring", "identity_theft", "account_takeover")


def area_rows(lines: DataFrame) -> DataFrame:
    """area_number, year_start, year_end, state from the text lines of an area map; an empty year is null."""
    parts = F.split("value", ",")
    return lines.select(
        F.get(parts, 0).try_cast("bigint").alias("area_number"), F.get(parts, 1).try_cast("int").alias("year_start"),
        F.get(parts, 2).try_cast("int").alias("year_end"), F.get(parts, 3).alias("state"),
    ).where("area_number IS NOT NULL")


def read_area_map(spark: SparkSession, path: str) -> DataFrame:
    return area_rows(spark.read.text(path))


def disposable_domains(lines: DataFrame) -> DataFrame:
    """The built-in disposable domains together with those of a list, one per line."""
    listed = lines.select(F.lower(F.trim("value")).alias("domain")).where("domain <> ''")
    built_in = lines.sparkSession.createDataFrame([(d,) for d in DISPOSABLE], "domain string")
    return listed.union(built_in).distinct()


def read_table(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    return spark.read.format(kind).load(path)


def decode(lines: DataFrame, schema: str, required: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """Good records and dead letters (value, reason) of JSON lines. Works on batches and on streams."""
    parsed = lines.withColumn("r", F.from_json("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    missing = F.array_compact(F.array(*[F.when(F.col(f"r.{c}").isNull(), F.lit(c)) for c in required]))
    broken = F.col("r").isNull() | F.col("r._bad").isNotNull()
    reason = F.when(broken, "malformed").when(F.size(missing) > 0, F.concat(F.lit("missing "), F.array_join(missing, " ")))
    judged = parsed.withColumn("reason", reason)
    good = judged.where("reason IS NULL").select("r.*").drop("_bad")
    return good, judged.where("reason IS NOT NULL").select("value", "reason")


def applications(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    good, bad = decode(lines, APPLICATION, APPLICATION_REQUIRED)
    flat = good.select(
        "application_id", "ssn_hash", "ssn_last4", "ssn_first5", F.to_date("dob").alias("dob"), "first_name", "last_name", "address.*", "phone", "email",
        F.to_timestamp_ntz("application_date").alias("application_date"), F.coalesce("application_type", F.lit("credit_card")).alias("application_type"),
        "requested_amount", "device_fingerprint", "ip_address",
    )
    return flat, bad


def alerts(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Alerts of a known type; any other type goes to the dead letters."""
    good, bad = decode(lines, ALERT, ALERT_REQUIRED)
    known = F.col("alert_type").isin(*ALERT_TYPES)
    odd = good.where(~known).select(F.to_json(F.struct(*good.columns)).alias("value"), F.lit("unknown type").alias("reason"))
    return good.where(known).withColumn("reported_date", F.to_timestamp_ntz("reported_date")), bad.union(odd)


def kafka_source(spark: SparkSession, servers: str, topic: str, group: str = "fraud-detection", offsets: str = "earliest") -> DataFrame:
    """Lines of a topic as a stream; needs Spark's Kafka package on the class path."""
    reader: DataStreamReader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
    return reader.option("startingOffsets", offsets).option("kafka.group.id", group).load().selectExpr("cast(value AS string) AS value")


def consortium_topic(provider: str) -> str:
    return f"consortium-{provider}-alerts"
