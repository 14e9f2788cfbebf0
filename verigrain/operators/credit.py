"""Credit files, tradelines, application velocity, the five signals, bureau signals and credit sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verigrain.functions import identity as I
from verigrain.functions import scores as S
from verigrain.functions.basics import before, clip01, elapsed_days, ladder, months_of, names_where, or_zero, points, ratio


def credit_files(lines: DataFrame, as_of: Column) -> DataFrame:
    """Per holder: what a credit file says, from its tradelines."""
    age = elapsed_days(as_of, F.col("opened"))
    au = F.col("is_au")
    return lines.groupBy("holder").agg(
        F.count(F.lit(1)).alias("num_tradelines"), months_of(F.max(age)).alias("file_age_months"), F.count_if(au).alias("au_count"),
        F.count_if(au & (age < 180)).alias("au_recent"), F.count_if(au & (F.col("credit_limit") > 10000)).alias("au_high_limit"),
        F.count_if(au & (months_of(age) < 6)).alias("au_very_new"), F.count_if((F.col("status") != "current") & (age < 365)).alias("recent_delinquency"),
        F.count_if(age < 180).alias("new_accounts_6mo"), F.count_if(age < 90).alias("inquiries_6mo"),
        F.sum(F.col("credit_limit").cast("decimal(18,2)")).cast("double").alias("total_limit"), F.sum(F.col("balance").cast("decimal(18,4)")).cast("double").alias("total_balance"),
    )


def with_credit(identities: DataFrame, files: DataFrame, as_of: Column) -> DataFrame:
    """Identities with their file (missing: no lines, unknown age) and their age in years."""
    joined = identities.join(files, F.col("identity_key") == F.col("holder"), "left").drop("holder")
    counts = {c: F.coalesce(F.col(c), F.lit(0).cast("long")) for c in ("num_tradelines", "au_count", "au_recent", "au_high_limit", "au_very_new", "recent_delinquency", "new_accounts_6mo", "inquiries_6mo")}
    days = elapsed_days(as_of, F.col("dob").cast("timestamp_ntz"))
    return joined.withColumns(counts | {"age_years": days / 365.0, "is_thin_file": F.coalesce(F.col("num_tradelines") < 3, F.lit(True)), "utilization": ratio(F.col("total_balance"), F.col("total_limit"))})


def credit_behaviour(people: DataFrame) -> DataFrame:
    """au_ratio, file_age_mismatch, anomalies and behavior_score; ``people`` from ``with_credit``."""
    mismatch = S.file_age_mismatch(F.col("age_years"), F.col("file_age_months"))
    found = people.withColumn("au_ratio", ratio(F.col("au_count"), F.col("num_tradelines"))).withColumn("file_age_mismatch", mismatch).withColumn("credit_velocity", F.lit(0.0))
    args = [F.col(c) for c in ("is_thin_file", "age_years", "file_age_mismatch", "au_ratio")]
    patterns = S.behaviour_patterns(*args, F.col("au_count"), F.col("credit_velocity"))
    return found.withColumn("credit_anomalies", patterns).withColumn("behavior_score", S.behaviour_score(*args, F.col("credit_velocity")))


def file_age_consistency(people: DataFrame) -> DataFrame:
    expected = F.greatest(F.lit(0.0), (F.col("age_years") - 18) * 12)
    gap = expected - F.col("file_age_months")
    return people.withColumn("expected_months", expected).withColumn("gap_months", gap).withColumn("is_consistent", gap < 24)


def au_abuse(people: DataFrame, unrelated: Column | None = None) -> DataFrame:
    """indicators, abuse_probability and au_risk_level; without a graph every authorised user counts as related."""
    others = F.lit(0).cast("long") if unrelated is None else unrelated
    n = F.col("au_count")
    found = people.withColumn("abuse_indicators", S.au_indicators(n, others, F.col("au_recent"), F.col("au_high_limit"), F.col("au_very_new")))
    found = found.withColumn("abuse_probability", S.au_probability(n, others, F.col("abuse_indicators")))
    return found.withColumn("au_risk_level", S.au_level(F.col("abuse_probability"), F.col("abuse_indicators")))


def au_rings(lines: DataFrame, least: int = 3) -> DataFrame:
    """Primary holders with at least ``least`` authorised users of their accounts."""
    users = lines.where("is_au").groupBy("primary_holder").agg(F.count_distinct("holder").alias("au_holders"), F.count(F.lit(1)).alias("au_lines"))
    return users.where(F.col("au_holders") >= least)


def unrelated_au(lines: DataFrame, edges: DataFrame) -> DataFrame:
    """Per holder: authorised-user lines, and those whose primary holder the identity graph does not tie to them."""
    au = lines.where("is_au").select("holder", "primary_holder")
    both = edges.select("src", "dst").union(edges.select("dst", "src")).toDF("holder", "primary_holder").distinct().withColumn("related", F.lit(True))
    joined = au.join(both, ["holder", "primary_holder"], "left")
    return joined.groupBy("holder").agg(F.count(F.lit(1)).alias("au_lines"), F.count_if(F.col("related").isNull()).alias("unrelated"))


def bureau_signals(people: DataFrame) -> DataFrame:
    """Signals of the credit file and their clipped sum; 0.5 without a file."""
    rules = {
        "THIN_FILE": (F.col("is_thin_file"), 0.15), "YOUNG_CREDIT_FILE": (F.col("file_age_months") < 24, 0.2),
        "HIGH_AU_RATIO": (ratio(F.col("au_count"), F.col("num_tradelines")) > 0.5, 0.25), "HIGH_INQUIRY_VELOCITY": (F.col("inquiries_6mo") > 5, 0.15),
        "RAPID_ACCOUNT_OPENING": (F.col("new_accounts_6mo") > 3, 0.2), "HIGH_UTILIZATION": (F.col("utilization") > 0.8, 0.1),
        "RECENT_DELINQUENCY": (F.col("recent_delinquency") > 0, 0.1),
    }
    total = F.lit(0.0)
    for cond, weight in rules.values():
        total = total + points(cond, weight)
    none = F.col("file_age_months").isNull()
    return people.withColumn("bureau_signals", F.when(none, F.array().cast("array<string>")).otherwise(names_where([(k, c) for k, (c, _) in rules.items()]))).withColumn("bureau_risk", F.when(none, 0.5).otherwise(clip01(total)))


# --- the five signals: (severity, score), null severity where the signal is not raised ---------------------------------


def thin_file_signal(people: DataFrame) -> DataFrame:
    thin, age = F.col("is_thin_file"), F.col("age_years")
    severity = F.when(thin & (age > 35), "high").when(thin & (age > 25), "medium").when(thin, "low")
    return people.withColumn("severity", severity).withColumn("score", F.when(~thin, 0.0).when(age > 35, 0.35).when(age > 25, 0.2).otherwise(0.1))


def age_gap_signal(people: DataFrame) -> DataFrame:
    expected = F.greatest(F.lit(0.0), (F.col("age_years") - 18) * 12)
    gap = expected - F.col("file_age_months")
    score = F.when(gap > 60, 0.45).when(gap > 36, 0.3).when(gap > 12, 0.15).otherwise(0.0)
    return people.withColumn("gap_months", gap).withColumn("severity", F.when(gap > 60, "critical").when(gap > 36, "high").when(gap > 12, "medium")).withColumn("score", score)


def ssn_dob_signal(identities: DataFrame, areas: DataFrame) -> DataFrame:
    """Issuance of the id's area against the birth year; ``areas`` is a table of at most 899 rows."""
    area = I.ssn_part(F.col("ssn"), 1).try_cast("long")
    joined = identities.withColumn("ssn_area", area).join(F.broadcast(areas), F.col("ssn_area") == F.col("area"), "left")
    kind = I.issuance_mismatch(F.year("dob"), F.col("year_start"), F.col("year_end"))
    found = joined.withColumn("mismatch", kind).withColumn("confidence", I.issuance_confidence(F.col("mismatch"), F.col("area").isNotNull()))
    severity = F.when(F.col("mismatch") == "ssn_before_birth", "critical").when(F.col("mismatch") == "ssn_too_recent", "high")
    score = F.when(F.col("mismatch") == "ssn_before_birth", 0.4).when(F.col("mismatch") == "ssn_too_recent", 0.25).otherwise(0.0)
    return found.withColumn("mismatch_score", I.issuance_score(F.col("mismatch"), F.col("confidence"))).withColumn("severity", severity).withColumn("score", score)


def application_history(events: DataFrame, as_of: Column, days: int) -> DataFrame:
    """Applications of the ``days`` before ``as_of`` by id, each id's newest first; repeated (institution, time) once.

    One sort by ranges, so an id of very many applications is no single task.
    """
    recent = events.where((F.col("ts") >= before(as_of, days)) & (F.col("ts") <= as_of))
    return recent.select("ssn_key", "institution", "ts").distinct().orderBy("ssn_key", F.desc("ts"), "institution")


def application_velocity(events: DataFrame, as_of: Column) -> DataFrame:
    """Applications in 7, 30 and 90 days and institutions in 30, per id; repeated (institution, time) count once."""
    once = events.where(F.col("ts") >= before(as_of, 90)).dropDuplicates(["ssn_key", "institution", "ts"])
    since = lambda d: F.col("ts") >= before(as_of, d)
    found = once.groupBy("ssn_key").agg(
        F.count_if(since(7)).alias("apps_7d"), F.count_if(since(30)).alias("apps_30d"), F.count(F.lit(1)).alias("apps_90d"),
        F.count_distinct(F.when(since(30), F.col("institution"))).alias("institutions_30d"),
    )
    a7, a30, a90 = F.col("apps_7d"), F.col("apps_30d"), F.col("apps_90d")
    high = (a7 > 3) | (a30 > 6) | (a90 > 12)
    severity = F.when(~high, None).when(a7 > 6, "critical").when((a7 > 3) | (a30 > 9), "high").otherwise("medium")
    return found.withColumn("severity", severity).withColumn("score", F.when(F.col("severity") == "critical", 0.4).when(F.col("severity") == "high", 0.3).when(F.col("severity") == "medium", 0.2).otherwise(0.0))


def address_instability(uses: DataFrame, as_of: Column) -> DataFrame:
    """Address changes in 12 and 24 months of 30 days, mean months between them, and the signal."""
    moves = uses.where("element_type = 'address'").groupBy("identity_key", "element_key").agg(F.min("ts").alias("since"))
    gap = elapsed_days(F.lead("since").over(Window.partitionBy("identity_key").orderBy("since", "element_key")), F.col("since"))
    within = lambda m: F.greatest(F.lit(0).cast("long"), F.count_if(F.col("since") >= before(as_of, 30 * m)) - 1)
    found = moves.withColumn("gap", gap).groupBy("identity_key").agg(within(12).alias("changes_12m"), within(24).alias("changes_24m"), (F.avg("gap") / 30.0).alias("tenure_months"))
    c12, c24 = F.col("changes_12m"), F.col("changes_24m")
    unstable = (c12 > 2) | (c24 > 4) | F.coalesce(F.col("tenure_months") < 6, F.lit(False))
    return found.withColumn("severity", F.when(unstable & (c12 > 4), "high").when(unstable, "medium")).withColumn("score", F.when(unstable & (c12 > 4), 0.25).when(unstable, 0.15).otherwise(0.0))


# --- sequences ------------------------------------------------------------------------------------------------------


def sequence_features(sequences: DataFrame) -> DataFrame:
    """The features of each account's monthly arrays. They are named once, so later rules read columns."""
    made = S.sequence_features(*[F.col(c) for c in ("balances", "payments", "limits", "utilization", "cash")])
    return sequences.withColumns(made)


def bust_out(features: DataFrame, synthetic: Column | None = None) -> DataFrame:
    """bust_out_probability, warning signals, days, level and action from ``sequence_features``."""
    synthetic = F.lit(0.0) if synthetic is None else or_zero(synthetic)
    f = {c: F.col(c) for c in ("balance_trend", "payment_trend", "payment_declining", "max_utilization", "utilization_trend", "cash_frequency", "recent_cash")}
    found = features.withColumn("bust_out_probability", S.bust_out_probability(f, F.col("months_on_books"), synthetic))
    found = found.withColumn("warning_signals", S.bust_out_signals(f, synthetic)).withColumn("days_to_bust_out", S.days_to_bust_out(F.col("bust_out_probability"), F.col("utilization")))
    found = found.withColumn("bust_out_level", S.bust_out_level(F.col("bust_out_probability")))
    return found.withColumn("bust_out_action", S.bust_out_action(F.col("bust_out_level")))


def score_band(score: Column) -> Column:
    return ladder(score, [(0.8, "high"), (0.5, "medium"), (0.3, "low")], "minimal")
