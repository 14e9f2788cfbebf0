"""Queries on cases, reports and filings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verigrain.functions.basics import joined
from verigrain.operators import cases as K
from verigrain.operators import graph as G
from verigrain.operators import scoring as X
from verigrain.plans.durable import durable
from verigrain.plans.graph_queries import _edges_sql
from verigrain.plans.registry import Registry
from verigrain.plans.scoring_queries import _SLEVEL, _SYNTH, bags
from verigrain.plans.sql_tables import joined_sql
from verigrain.sources.adapters import Tables

R = Registry()
query = R.query

# The log of events: events of a user make a case; the type of each says what it does.
_LOG = """log AS (SELECT user_id AS case_id, event_id AS seq, ts, CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1 AND user_id % 10 <> 9 THEN 'create' WHEN event_type = 'click' THEN 'note' WHEN event_type = 'view' THEN 'status' WHEN event_type = 'purchase' THEN 'assign' WHEN event_type = 'signup' THEN 'link' ELSE 'priority' END AS kind,
    event_id AS e, event_type AS et FROM events),
    lg AS (SELECT case_id, seq, ts, kind, CASE kind WHEN 'create' THEN ['critical', 'high', 'medium', 'low', 'minimal'][e % 5 + 1] WHEN 'priority' THEN ['critical', 'high', 'medium', 'low', 'minimal'][e % 5 + 1] WHEN 'status' THEN ['open', 'pending_info', 'escalated', 'closed'][e % 4 + 1] WHEN 'assign' THEN 'agent' || (e % 7) WHEN 'link' THEN (case_id + 1)::VARCHAR ELSE 'note ' || e END AS value FROM log),
    st AS (SELECT case_id, min(ts) FILTER (kind = 'create') AS created_at, arg_max(CASE kind WHEN 'create' THEN 'open' WHEN 'status' THEN value WHEN 'assign' THEN 'in_progress' END, (ts, seq)) FILTER (kind IN ('create', 'status', 'assign')) AS status,
      arg_max(value, (ts, seq)) FILTER (kind = 'assign') AS assignee, arg_max(CASE WHEN value = 'minimal' THEN 'low' ELSE value END, (ts, seq)) FILTER (kind IN ('create', 'priority')) AS priority,
      coalesce(string_agg(value, '; ' ORDER BY ts, seq) FILTER (kind = 'note'), '') AS notes, max(ts) AS updated_at FROM lg GROUP BY 1),
    ln AS (SELECT case_id, value::BIGINT AS other FROM lg WHERE kind = 'link'), bl AS (SELECT DISTINCT * FROM (SELECT case_id, other FROM ln UNION ALL SELECT other, case_id FROM ln)),
    rl AS (SELECT case_id, array_to_string(list_sort(list(other)), ',') AS related FROM bl GROUP BY 1),
    cs AS (SELECT st.*, coalesce(related, '') AS related FROM st LEFT JOIN rl USING (case_id) WHERE created_at IS NOT NULL)"""


def event_log(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    first = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) == 1
    e, kind = F.col("event_id"), F.col("kind")
    named = (
        F.when(first & (F.col("user_id") % 10 != 9), "create").when(F.col("event_type") == "click", "note").when(F.col("event_type") == "view", "status")
        .when(F.col("event_type") == "purchase", "assign").when(F.col("event_type") == "signup", "link").otherwise("priority")
    )
    pick = lambda names, n: F.get(F.array(*[F.lit(x) for x in names]), (e % n).cast("int"))
    log = t.read("events").select(F.col("user_id").alias("case_id"), e.alias("seq"), F.col("ts").cast("timestamp_ntz").alias("ts"), named.alias("kind"), "event_id")
    value = (
        F.when(kind.isin("create", "priority"), pick(("critical", "high", "medium", "low", "minimal"), 5)).when(kind == "status", pick(("open", "pending_info", "escalated", "closed"), 4))
        .when(kind == "assign", F.concat(F.lit("agent"), (e % 7).cast("string"))).when(kind == "link", (F.col("case_id") + 1).cast("string")).otherwise(F.concat(F.lit("note "), e.cast("string")))
    )
    return log.withColumn("value", value).drop("event_id")


def _flat(cases: DataFrame) -> DataFrame:
    return cases.withColumns({"notes": F.array_join("notes", "; "), "related": F.array_join("related", ",")})


@query(f"WITH {_LOG} SELECT * FROM cs")
def case_state(t: Tables) -> DataFrame:
    return _flat(K.case_state(event_log(t)))


@query(f"WITH {_LOG} SELECT case_id, created_at, status, priority, assignee FROM cs WHERE status = 'in_progress' ORDER BY created_at DESC, case_id LIMIT 50")
def case_list(t: Tables) -> DataFrame:
    return K.case_list(K.case_state(event_log(t)), status="in_progress", priority="no such").select("case_id", "created_at", "status", "priority", "assignee")


@query(f"WITH {_LOG} SELECT priority, count(*) AS cases FROM cs GROUP BY 1")
def case_priority(t: Tables) -> DataFrame:
    return K.case_state(event_log(t)).groupBy("priority").agg(F.count(F.lit(1)).alias("cases"))


@query(f"WITH {_LOG} SELECT case_id, status FROM cs WHERE case_id = 7")
def cases_for_identity(t: Tables) -> DataFrame:
    return K.case_state(event_log(t).where("case_id IN (7) OR value IN ('7')")).where("case_id = 7").select("case_id", "status")


_NONE = "[]::VARCHAR[]"
_RECS = f"list_concat(list_concat(CASE WHEN {_SLEVEL} = 'critical' THEN ['IMMEDIATE_REVIEW_REQUIRED', 'CONSIDER_ACCOUNT_FREEZE', 'PREPARE_SAR_FILING'] ELSE {_NONE} END, CASE WHEN list_contains(sig, 'SHARED_SSN') THEN ['INVESTIGATE_SSN_SHARING', 'VERIFY_IDENTITY_DOCUMENTATION'] ELSE {_NONE} END), list_concat(CASE WHEN list_contains(sig, 'HIGH_PHONE_VELOCITY') THEN ['INVESTIGATE_PHONE_PATTERNS', 'CHECK_VOIP_STATUS'] ELSE {_NONE} END, CASE WHEN s > 0.7 THEN ['HIGH_SYNTHETIC_PROBABILITY', 'ENHANCED_VERIFICATION_REQUIRED'] ELSE {_NONE} END))"


@query(f"WITH {_SYNTH}, r AS (SELECT identity_key, {_RECS} AS recs FROM syn) SELECT identity_key, CASE WHEN len(recs) = 0 THEN 'STANDARD_REVIEW_PROCESS' ELSE array_to_string(recs, ',') END AS recommendations FROM r")
def recommendations(t: Tables) -> DataFrame:
    f = X.synthetic(bags(t))
    return f.select("identity_key", F.array_join(K.recommendations(F.col("synthetic_level"), F.col("triggered_signals"), F.col("synthetic_score")), ",").alias("recommendations"))


@query(f"""WITH {_SYNTH} SELECT identity_key, CASE WHEN (identity_key % 100) / 100.0 > 0.7 THEN 'SYNTHETIC_IDENTITY_BUST_OUT' WHEN list_contains(sig, 'SHARED_SSN') THEN 'SYNTHETIC_IDENTITY_RING' ELSE 'SYNTHETIC_IDENTITY_FRAUD' END AS activity_type,
    CASE WHEN c_acctbal + 1000 > 0 THEN round(c_acctbal + 1000, 2) END AS amount, concat_ws(' ', 'Suspected fabricated identity ' || substr(identity_key::VARCHAR, 1, 8) || '.', 'Score ' || floor(round(s, 6)::DECIMAL(18, 6) * 100)::INT || ' of 100.', CASE WHEN len(sig) > 0 THEN 'Indicators: ' || array_to_string(sig[1:5], ', ') || '.' END, CASE WHEN (identity_key % 100) / 100.0 > 0.5 THEN 'Default may be near.' END) AS narrative
    FROM syn JOIN customer ON c_custkey = identity_key""")
def sar_projection(t: Tables) -> DataFrame:
    f = X.synthetic(bags(t)).join(t.read("customer").select(F.col("c_custkey").alias("identity_key"), "c_acctbal"), "identity_key")
    risk = (F.col("identity_key") % 100) / 100.0
    return f.select("identity_key", K.sar_type(F.col("triggered_signals"), risk).alias("activity_type"), F.round(K.sar_amount(F.col("c_acctbal"), F.lit(1000.0)), 2).alias("amount"), K.sar_narrative(F.col("identity_key"), F.col("synthetic_score"), F.col("triggered_signals"), risk).alias("narrative"))


@query(f"WITH {_LOG}, {_SYNTH} SELECT case_id, CASE WHEN {_SLEVEL} = 'critical' OR case_id % 4 = 0 THEN 'sar_filed' ELSE status END AS status FROM cs JOIN syn ON identity_key = case_id")
def sar_filing(t: Tables) -> DataFrame:
    log = event_log(t)
    scored = X.synthetic(bags(t)).select(F.col("identity_key").alias("case_id"), "synthetic_level")
    due = scored.where("synthetic_level = 'critical' OR case_id % 4 = 0")
    last = log.groupBy("case_id").agg(F.max("seq").alias("seq"), F.max("ts").alias("ts")).join(due, "case_id")
    filed = last.select("case_id", (F.col("seq") + 1).alias("seq"), (F.col("ts") + F.expr("INTERVAL 1 SECOND")).alias("ts"), F.lit("sar").alias("kind"), F.concat(F.lit("SAR-"), F.col("case_id").cast("string")).alias("value"))
    return K.case_state(log.unionByName(filed)).join(scored, "case_id", "left_semi").select("case_id", "status")


@query(f"WITH {_LOG}, {_SYNTH} SELECT case_id, status, priority, round(s, 6) AS synthetic_score, {joined_sql('sig')} AS signals, CASE {_SLEVEL} WHEN 'critical' THEN 'Consider SAR filing,Immediate review required' WHEN 'high' THEN 'Expedited review recommended' WHEN 'medium' THEN 'Standard review process' ELSE '' END AS advice FROM cs JOIN syn ON identity_key = case_id")
def case_report(t: Tables) -> DataFrame:
    scored = X.synthetic(bags(t)).withColumnRenamed("identity_key", "case_id")
    f = K.case_state(event_log(t)).join(scored, "case_id")
    return f.select("case_id", "status", "priority", F.round("synthetic_score", 6).alias("synthetic_score"), joined(F.col("triggered_signals")).alias("signals"), joined(K.report_recommendations(F.col("synthetic_level"))).alias("advice"))


@query(f"WITH {_SYNTH} SELECT identity_key, round(s, 6) AS synthetic_score, {_SLEVEL} AS risk_level, len(sig)::INT AS n_signals FROM syn")
def identity_report(t: Tables) -> DataFrame:
    return X.synthetic(bags(t)).select("identity_key", F.round("synthetic_score", 6).alias("synthetic_score"), F.col("synthetic_level").alias("risk_level"), F.size("triggered_signals").alias("n_signals"))


@query(f"WITH {_SYNTH} SELECT sha256(identity_key::VARCHAR) AS identity_hash, CASE WHEN identity_key % 5 = 1 THEN 'bust_out' ELSE 'synthetic_identity' END AS alert_type, CASE WHEN identity_key % 5 = 1 THEN 1.0 ELSE round(s, 6) END AS confidence, 'bank' AS reported_by FROM syn WHERE s >= 0.3")
def consortium_reports(t: Tables) -> DataFrame:
    f = X.synthetic(bags(t)).where("synthetic_score >= 0.3").select("identity_key", F.round("synthetic_score", 6).alias("score"), (F.col("identity_key") % 5 == 1).alias("is_bust_out"))
    return K.consortium_reports(f, "bank")


@query(f"""WITH RECURSIVE {_SYNTH.removeprefix('RECURSIVE ')}, {_edges_sql()}, deg AS (SELECT src AS v, count(*) AS degree, {', '.join(f"count(*) FILTER (list_contains(types, '{k}')) AS shared_{k}_count" for k in G.ALL_TYPES)} FROM w2 GROUP BY 1),
    near AS (SELECT src AS start, src AS v FROM w2 UNION SELECT src, dst FROM w2 UNION SELECT a.src, b.dst FROM w2 a JOIN w2 b ON a.dst = b.src),
    nodes AS (SELECT start, count(*) AS nodes FROM near GROUP BY 1), inside AS (SELECT a.start, count(*) AS edges FROM near a JOIN e ON e.src = a.v JOIN near b ON b.start = a.start AND b.v = e.dst GROUP BY 1),
    cases AS (SELECT user_id AS id, count(*) AS log_entries FROM events GROUP BY 1)
    SELECT identity_key, round(s, 6) AS synthetic_score, {_SLEVEL} AS risk_level, coalesce(degree, 0) AS degree, {', '.join(f'coalesce(shared_{k}_count, 0) AS shared_{k}_count' for k in G.ALL_TYPES)},
      coalesce(nodes, 1) AS nodes, coalesce(edges, 0) AS edges, coalesce(log_entries, 0) AS log_entries
    FROM syn LEFT JOIN deg ON deg.v = identity_key LEFT JOIN nodes ON nodes.start = identity_key LEFT JOIN inside ON inside.start = identity_key LEFT JOIN cases ON cases.id = identity_key""")
def identity_dossier(t: Tables) -> DataFrame:
    """Every identity with its score, its place in the graph, the size of its neighbourhood, and its cases' entries."""
    scored = X.synthetic(bags(t)).select("identity_key", F.round("synthetic_score", 6).alias("synthetic_score"), F.col("synthetic_level").alias("risk_level"))
    log = t.read("events").groupBy(F.col("user_id").alias("identity_key")).agg(F.count(F.lit(1)).alias("log_entries"))
    uses = durable(t.graph_use())
    return K.dossiers(scored, G.graph_reports(uses, G.identity_edges(uses)), log)


QUERIES, ORACLES = R.queries, R.oracles
