"""Investigation cases as an append-only event log, and the reports made from their latest state.

An event is (case_id, seq, ts, kind, value, author): kinds create, status, assign, priority, note, link, sar.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verigrain.functions.basics import names_where, or_zero

# The states and priorities of a case.
STATUSES = ("open", "in_progress", "pending_info", "escalated", "closed", "sar_filed")
PRIORITIES = ("low", "medium", "high", "critical")


def case_priority(level: Column) -> Column:
    return F.when(level.isin("critical", "high", "medium"), level).otherwise("low")


def case_state(events: DataFrame) -> DataFrame:
    """Per case: status, assignee, priority, notes (in order) and linked cases, from all its events.

    The last event that says something decides; assigning sets the status in_progress, filing a report sar_filed. A
    link counts for both cases. Events of a case that was never created are left out.
    """
    kind = F.col("kind")
    order = F.struct("ts", "seq")
    status = F.when(kind == "create", "open").when(kind == "status", F.col("value")).when(kind == "assign", "in_progress").when(kind == "sar", "sar_filed")
    last = lambda value: F.max(F.when(value.isNotNull(), F.struct(order.alias("o"), value.alias("v"))))["v"]
    note = F.when(kind == "note", F.struct(order.alias("o"), F.col("value").alias("v")))
    state = events.groupBy("case_id").agg(
        F.min(F.when(kind == "create", F.col("ts"))).alias("created_at"), last(status).alias("status"), last(F.when(kind == "assign", F.col("value"))).alias("assignee"),
        last(F.when(kind.isin("create", "priority"), case_priority(F.col("value")))).alias("priority"), F.transform(F.sort_array(F.collect_list(note)), lambda x: x["v"]).alias("notes"), F.max("ts").alias("updated_at"),
    )
    links = events.where("kind = 'link'").select("case_id", F.col("value").cast("long").alias("other"))
    both = links.union(links.select("other", "case_id")).distinct().groupBy("case_id").agg(F.sort_array(F.collect_list("other")).alias("related"))
    return state.where("created_at IS NOT NULL").join(both, "case_id", "left").withColumn("related", F.coalesce("related", F.array().cast("array<bigint>")))


def case_list(cases: DataFrame, status: str | None = None, priority: str | None = None, assignee: str | None = None, limit: int = 50) -> DataFrame:
    """The newest cases (at most 100) that match every filter given; an unknown status or priority filters nothing."""
    if status in STATUSES:
        cases = cases.where(F.col("status") == status)
    if priority in PRIORITIES:
        cases = cases.where(F.col("priority") == priority)
    if assignee:
        cases = cases.where(F.col("assignee") == assignee)
    return cases.orderBy(F.desc("created_at"), "case_id").limit(min(limit, 100))


def recommendations(level: Column, signals: Column, score: Column) -> Column:
    some = F.concat(
        F.when(level == "critical", F.array(*map(F.lit, ("IMMEDIATE_REVIEW_REQUIRED", "CONSIDER_ACCOUNT_FREEZE", "PREPARE_SAR_FILING")))).otherwise(F.array().cast("array<string>")),
        F.when(F.array_contains(signals, "SHARED_SSN"), F.array(*map(F.lit, ("INVESTIGATE_SSN_SHARING", "VERIFY_IDENTITY_DOCUMENTATION")))).otherwise(F.array().cast("array<string>")),
        F.when(F.array_contains(signals, "HIGH_PHONE_VELOCITY"), F.array(*map(F.lit, ("INVESTIGATE_PHONE_PATTERNS", "CHECK_VOIP_STATUS")))).otherwise(F.array().cast("array<string>")),
        F.when(score > 0.7, F.array(*map(F.lit, ("HIGH_SYNTHETIC_PROBABILITY", "ENHANCED_VERIFICATION_REQUIRED")))).otherwise(F.array().cast("array<string>")),
    )
    return F.when(F.size(some) > 0, some).otherwise(F.array(F.lit("STANDARD_REVIEW_PROCESS")))


def report_recommendations(level: Column) -> Column:
    return names_where([
        ("Immediate review required", level == "critical"), ("Consider SAR filing", level == "critical"), ("Expedited review recommended", level == "high"), ("Standard review process", level == "medium"),
    ])


def sar_type(signals: Column, bust_out: Column) -> Column:
    return (
        F.when(F.array_contains(signals, "BUST_OUT") | (or_zero(bust_out) > 0.7), "SYNTHETIC_IDENTITY_BUST_OUT")
        .when(F.array_contains(signals, "SHARED_SSN"), "SYNTHETIC_IDENTITY_RING").otherwise("SYNTHETIC_IDENTITY_FRAUD")
    )


def sar_amount(balance: Column, limit: Column) -> Column:
    total = or_zero(balance) + or_zero(limit)
    return F.when(total > 0, total)


def sar_narrative(identity: Column, score: Column, signals: Column, bust_out: Column) -> Column:
    return F.concat_ws(
        " ", F.concat(F.lit("Suspected fabricated identity "), F.substring(identity.cast("string"), 1, 8), F.lit(".")), F.format_string("Score %d of 100.", F.floor(F.round(score, 6).cast("decimal(18,6)") * 100).cast("int")),
        F.when(F.size(signals) > 0, F.concat(F.lit("Indicators: "), F.array_join(F.slice(signals, 1, 5), ", "), F.lit("."))), F.when(or_zero(bust_out) > 0.5, F.lit("Default may be near.")),
    )


def consortium_reports(scored: DataFrame, provider: str) -> DataFrame:
    """Rows to share: fabricated identities by score, and bust-outs with full confidence."""
    kind = F.when(F.col("is_bust_out"), "bust_out").otherwise("synthetic_identity")
    return scored.select(F.sha2(F.col("identity_key").cast("string"), 256).alias("identity_hash"), kind.alias("alert_type"), F.when(F.col("is_bust_out"), 1.0).otherwise(F.col("score")).alias("confidence"), F.lit(provider).alias("reported_by"))


def dossiers(scored: DataFrame, graph: DataFrame, log: DataFrame) -> DataFrame:
    """``scored`` identities beside their part of the graph (``graph.graph_reports``) and of a case log (identity_key,
    log_entries). One without a link has a neighbourhood of itself, and no edge; one without a case no entries."""
    found = scored.join(graph.withColumnRenamed("identity_id", "identity_key"), "identity_key", "left").join(log, "identity_key", "left")
    numbers = [c for c in found.columns if c not in scored.columns]
    return found.withColumns({c: F.coalesce(F.col(c), F.lit(int(c == "nodes")).cast("long")) for c in numbers})
