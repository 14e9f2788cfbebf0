"""Full scoring: velocity, credit, authorised users, synthetic components, bust-out and their ensemble, set-oriented."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verigrain.config import CONFIG, EngineConfig
from verigrain.functions import scores as S
from verigrain.functions.basics import flag, or_zero

SSN_FLAGS = ("ssn_dob_mismatch", "death_master_match", "invalid_ssn", "itin_as_ssn", "multiple_ssns")
COMPONENTS = ("ssn", "graph", "velocity", "credit", "device")


def ssn_signals(result: Column, mismatch: Column) -> Column:
    return F.struct(
        flag(mismatch.isNotNull()).alias("ssn_dob_mismatch"), (result == "death_master").alias("death_master_match"), result.startswith("invalid").alias("invalid_ssn"),
        (result == "itin").alias("itin_as_ssn"), F.lit(False).alias("multiple_ssns"),
    )


def components(signals: DataFrame) -> DataFrame:
    """Adds the five component scores; ``signals`` has structs ssn_signals, graph_features, velocity_signals,
    credit_signals and device_signals whose missing fields are false or zero."""
    made = {
        "ssn_score": S.ssn_component(F.col("ssn_signals")), "graph_score": S.graph_component(F.col("graph_features")), "velocity_score": S.velocity_component(F.col("velocity_signals")),
        "credit_score": S.credit_component(F.col("credit_signals")), "device_score": S.device_component(F.col("device_signals")),
    }
    return signals.withColumns(made)


def synthetic(signals: DataFrame, config: EngineConfig = CONFIG) -> DataFrame:
    """Adds synthetic_score, synthetic_level, triggered_signals and top_component."""
    found = components(signals)
    parts = [F.col(f"{c}_score") for c in COMPONENTS]
    bags = [F.col(c) for c in ("ssn_signals", "graph_features", "velocity_signals", "credit_signals", "device_signals")]
    found = found.withColumn("synthetic_score", S.synthetic_score(*parts, config=config)).withColumn("triggered_signals", S.triggered_signals(*bags))
    return found.withColumn("synthetic_level", S.synthetic_level(F.col("synthetic_score"))).withColumn("top_component", S.top_component(*parts))


def ensemble(people: DataFrame, velocity: DataFrame, graph: DataFrame, bust_out: DataFrame, ssn: DataFrame, config: EngineConfig = CONFIG) -> DataFrame:
    """One row per identity with every component, the final score, level, signals and action.

    ``people`` is the output of ``credit_behaviour`` and ``au_abuse``; the others are keyed by identity_key and joined
    left: what is missing counts as no velocity, no link, no sequence, no finding.
    """
    joined = people.join(velocity, "identity_key", "left").join(graph, "identity_key", "left").join(bust_out, "identity_key", "left").join(ssn, "identity_key", "left")
    v = {t: or_zero(F.col(f"{t}_velocity")) for t in ("address", "phone", "email")}
    bags = joined.withColumns({
        "ssn_signals": ssn_signals(F.col("ssn_result"), F.col("mismatch")),
        "graph_features": F.struct("shared_ssn_count", "cluster_density", "cluster_size", F.col("neighbor_avg_score").alias("neighbor_avg_synthetic_score")),
        "velocity_signals": F.struct(*[c.alias(f"{t}_velocity_score") for t, c in v.items()]),
        "credit_signals": F.struct("is_thin_file", "file_age_mismatch", F.array_contains("credit_anomalies", "RAPID_CREDIT_BUILDING").alias("rapid_credit_building"), (F.col("abuse_probability") > 0.5).alias("au_abuse_pattern")),
        "device_signals": F.struct((or_zero(F.col("device_velocity")) == 0).alias("weak_binding"), F.lit(0).alias("shared_device_count"), F.lit(False).alias("known_fraud_device"), F.lit(False).alias("emulator_detected")),
    })
    scored = synthetic(bags, config)
    none = F.array().cast("array<string>")
    signals = F.sort_array(F.array_distinct(F.concat(*[F.coalesce(F.col(c), none) for c in ("anomalies", "credit_anomalies", "abuse_indicators", "triggered_signals", "warning_signals")])))
    final = S.ensemble_score(F.col("synthetic_score"), or_zero(F.col("overall_velocity_score")), F.col("behavior_score"), F.col("abuse_probability"), F.col("bust_out_probability"), config)
    scored = scored.withColumn("final_score", final).withColumn("all_signals", signals)
    scored = scored.withColumn("final_level", S.ensemble_level(F.col("final_score"), F.col("all_signals")))
    return scored.withColumn("action", S.recommended_action(F.col("final_level"), F.col("bust_out_probability")))


def explanation(found: DataFrame) -> DataFrame:
    """A sentence per identity: level, score, strongest component and the first five signals."""
    text = F.concat(
        F.lit("Risk "), F.col("final_level"), F.lit(" at "), F.round(F.round("final_score", 6).cast("decimal(18,6)"), 2).cast("decimal(18,2)").cast("string"), F.lit("; strongest component "), F.col("top_component"),
        F.when(F.size("all_signals") > 0, F.concat(F.lit("; signals: "), F.array_join(F.slice("all_signals", 1, 5), ", "))).otherwise(""),
    )
    return found.withColumn("explanation", text)


def latest_scores(log: DataFrame, key: str = "identity_key") -> DataFrame:
    """The last score written for each key, by time and then by value."""
    return log.groupBy(key).agg(F.max(F.struct("ts", "score")).alias("m")).select(key, F.col("m.score").alias("score"), F.col("m.ts").alias("ts"))


