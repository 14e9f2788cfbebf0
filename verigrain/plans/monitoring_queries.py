"""Queries on model and bust-out monitoring."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verigrain.operators import monitoring as O
from verigrain.plans.registry import Registry
from verigrain.plans.sql_tables import ORDERS_AT, PREDICTIONS
from verigrain.sources.adapters import ORDERS_AS_OF, Tables, as_of

R = Registry()
query = R.query

_CONF = "count(*) AS total, count(*) FILTER (score > 0.5 AND actual) AS tp, count(*) FILTER (score > 0.5 AND NOT actual) AS fp, count(*) FILTER (score <= 0.5 AND actual) AS fn, count(*) FILTER (score <= 0.5 AND NOT actual) AS tn"
_P, _Rc = "coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0)", "coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0)"


@query(f"WITH {PREDICTIONS}, c AS (SELECT model, {_CONF} FROM preds WHERE actual IS NOT NULL GROUP BY 1) SELECT *, round({_P}, 6) AS precision, round({_Rc}, 6) AS recall, round((tp + tn)::DOUBLE / total, 6) AS accuracy, round(coalesce(2 * {_P} * {_Rc} / nullif({_P} + {_Rc}, 0), 0), 6) AS f1 FROM c")
def confusion_metrics(t: Tables) -> DataFrame:
    return O.confusion(t.predictions(), "model").withColumns({c: F.round(c, 6) for c in ("precision", "recall", "accuracy", "f1")})


def _win(d: int, n: str) -> str:
    w = f"ts >= {ORDERS_AT} - INTERVAL {d} DAY"
    return f"coalesce(count(*) FILTER ({w} AND score > 0.5 AND actual)::DOUBLE / nullif(count(*) FILTER ({w} AND score > 0.5), 0), 0) AS {n}_precision, coalesce(count(*) FILTER ({w} AND score > 0.5 AND actual)::DOUBLE / nullif(count(*) FILTER ({w} AND actual), 0), 0) AS {n}_recall"


@query(f"""WITH {PREDICTIONS}, d AS (SELECT model, {_win(700, 'recent')}, {_win(1500, 'base')} FROM preds WHERE actual IS NOT NULL GROUP BY 1)
    SELECT model, round(recent_precision, 6) AS recent_precision, round(recent_recall, 6) AS recent_recall, round(base_precision, 6) AS base_precision, round(base_recall, 6) AS base_recall, abs(recent_precision - base_precision) > 0.02 OR abs(recent_recall - base_recall) > 0.02 AS has_drift FROM d""")
def drift_check(t: Tables) -> DataFrame:
    f = O.drift(t.predictions(), as_of(ORDERS_AS_OF), 700, 1500, 0.02)
    return f.withColumns({c: F.round(c, 6) for c in f.columns if c.endswith(("precision", "recall"))})


_EVENTS = f"""{PREDICTIONS}, ev AS (SELECT o_custkey AS account_id, o_orderdate AS event_at, max(o_totalprice) AS amount_lost FROM orders WHERE o_orderkey % 11 = 0 GROUP BY 1, 2),
    lp AS (SELECT e.account_id, e.event_at, max(e.amount_lost) AS amount_lost, arg_max(p.score, (p.ts, p.score)) AS probability, max(p.ts) AS at_ FROM ev e LEFT JOIN preds p ON p.account_id = e.account_id AND p.ts <= e.event_at AND p.prediction_id % 11 <> 0 GROUP BY 1, 2),
    mev AS (SELECT account_id, event_at, amount_lost, probability, coalesce(probability > 0.5, false) AS predicted, CASE WHEN probability > 0.5 THEN date_sub('day', at_, event_at) END AS lead_days FROM lp)"""


def matched(t: Tables) -> DataFrame:
    p = t.predictions()
    events = t.read("orders").where("o_orderkey % 11 = 0").groupBy(F.col("o_custkey").alias("account_id"), F.col("o_orderdate").cast("timestamp_ntz").alias("event_at")).agg(F.max("o_totalprice").alias("amount_lost"))
    return O.matched_events(events, p.where("prediction_id % 11 <> 0").select("account_id", F.col("score").alias("probability"), "ts"))


@query(f"WITH {_EVENTS} SELECT count(*) AS events, count(*) FILTER (predicted) AS detected, round(coalesce(avg(nullif(lead_days, 0)), 0), 6) AS avg_lead_days, sum(amount_lost::DECIMAL(18,2))::DOUBLE AS total_loss, coalesce(sum(amount_lost::DECIMAL(18,2)) FILTER (predicted), 0)::DOUBLE AS prevented_loss, round(count(*) FILTER (predicted)::DOUBLE / count(*), 6) AS detection_rate FROM mev")
def detection_rate(t: Tables) -> DataFrame:
    return O.detection_rate(matched(t)).withColumns({c: F.round(c, 6) for c in ("avg_lead_days", "detection_rate")})


@query(f"WITH {_EVENTS} SELECT account_id, event_at, amount_lost, probability, predicted, lead_days FROM mev WHERE event_at >= {ORDERS_AT} - INTERVAL 365 DAY ORDER BY event_at DESC, account_id")
def event_list(t: Tables) -> DataFrame:
    return matched(t).where(F.col("event_at") >= as_of(ORDERS_AS_OF) - F.expr("INTERVAL 365 DAYS")).orderBy(F.desc("event_at"), "account_id")


@query(f"WITH {_EVENTS} SELECT count(*) AS true_positives, round(avg(lead_days), 6) AS mean_lead, round(quantile_cont(lead_days, 0.5), 6) AS median_lead, round(avg((lead_days > 30)::INT::DOUBLE), 6) AS share_over_30d FROM mev WHERE predicted")
def lead_time(t: Tables) -> DataFrame:
    return O.lead_time(matched(t)).withColumns({c: F.round(c, 6) for c in ("mean_lead", "median_lead", "share_over_30d")})


@query(f"WITH {PREDICTIONS}, th AS (SELECT unnest([0.3, 0.5, 0.7, 0.8, 0.9]::DOUBLE[]) AS threshold), c AS (SELECT threshold, count(*) FILTER (score >= threshold AND actual) AS tp, count(*) FILTER (score >= threshold) AS flagged, count(*) FILTER (actual) AS positives FROM preds, th WHERE actual IS NOT NULL GROUP BY 1) SELECT *, round(coalesce(tp::DOUBLE / nullif(flagged, 0), 0), 6) AS precision, round(coalesce(tp::DOUBLE / nullif(positives, 0), 0), 6) AS recall FROM c")
def threshold_sweep(t: Tables) -> DataFrame:
    return O.threshold_sweep(t.predictions()).withColumns({c: F.round(c, 6) for c in ("precision", "recall")})


@query(f"""WITH {PREDICTIONS}, k AS (SELECT actual, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0::DOUBLE AS r FROM preds WHERE actual IS NOT NULL), s AS (SELECT count(*) FILTER (actual) AS positives, count(*) FILTER (NOT actual) AS negatives, sum(r) FILTER (actual) AS rs FROM k)
    SELECT positives, negatives, round((rs - positives * (positives + 1) / 2.0::DOUBLE) / (positives::DOUBLE * negatives), 6) AS auc FROM s""")
def roc_auc(t: Tables) -> DataFrame:
    return O.roc_auc(t.predictions()).withColumn("auc", F.round("auc", 6))


@query(f"WITH {PREDICTIONS}, b AS (SELECT unnest([0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]::DOUBLE[]) AS le) SELECT le, count(*) FILTER (score <= le) AS count FROM preds, b GROUP BY 1")
def score_histogram(t: Tables) -> DataFrame:
    return O.histogram(t.predictions())


@query(f"""WITH br AS (SELECT s_suppkey AS record_id, CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey % 997 END AS ssn_key, CASE WHEN s_suppkey % 3 = 0 THEN 'u' || (s_suppkey % 500) || '@x.com' END AS email, (s_suppkey % 10) / 10.0::DOUBLE AS severity, {ORDERS_AT} - to_days((s_suppkey % 600)::INT) AS found_at FROM supplier),
    pp AS (SELECT c_custkey AS identity_key, c_custkey % 997 AS ssn_key, 'u' || (c_custkey % 700) || '@x.com' AS email FROM customer),
    hit AS (SELECT DISTINCT identity_key, record_id, severity, found_at FROM pp JOIN br ON br.ssn_key = pp.ssn_key OR br.email = pp.email)
    SELECT p.identity_key, count(h.record_id) AS breaches, round(least(1.0::DOUBLE, coalesce(avg(severity * greatest(0.1::DOUBLE, 1.0::DOUBLE - date_sub('day', found_at, {ORDERS_AT}) / 365.0::DOUBLE)), 0)), 6) AS exposure FROM pp p LEFT JOIN hit h USING (identity_key) GROUP BY 1""")
def breach_score(t: Tables) -> DataFrame:
    s, c = F.col("s_suppkey"), F.col("c_custkey")
    at = as_of(ORDERS_AS_OF)
    breaches = t.read("supplier").select(
        s.alias("record_id"), F.when(s % 2 == 0, s % 997).alias("ssn_key"), F.when(s % 3 == 0, F.concat(F.lit("u"), (s % 500).cast("string"), F.lit("@x.com"))).alias("email"), ((s % 10) / 10.0).alias("severity"),
        (at - F.make_dt_interval(days=(s % 600).cast("int"))).alias("found_at"),
    )
    people = t.read("customer").select(c.alias("identity_key"), (c % 997).alias("ssn_key"), F.concat(F.lit("u"), (c % 700).cast("string"), F.lit("@x.com")).alias("email"))
    return O.breach_exposure(people, breaches, at).withColumn("exposure", F.round("exposure", 6))


QUERIES, ORACLES = R.queries, R.oracles
