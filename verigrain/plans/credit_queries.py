"""Queries on credit files, signals and credit sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verigrain.functions.basics import joined
from verigrain.operators import credit as C
from verigrain.plans.registry import Registry
from verigrain.plans.sql_tables import APPLICATIONS, ELEMENT_USE, EVENTS_AT, GRAPH_USE, ORDERS_AT, SEQUENCES, TRADELINES, WITH_CREDIT, clip, joined_sql, names_sql, points
from verigrain.sources.adapters import EVENTS_AS_OF, ORDERS_AS_OF, Tables, as_of

R = Registry()
query = R.query


def people(t: Tables) -> DataFrame:
    at = as_of(ORDERS_AS_OF)
    return C.with_credit(t.identities(), C.credit_files(t.tradelines(), at), at)


_EXPECTED = "greatest(0::DOUBLE, (age_years - 18) * 12)"
_MISMATCH = f"coalesce(file_age_months < 0.3::DOUBLE * {_EXPECTED}, false)"
_AU_RATIO = "coalesce(au_count / nullif(num_tradelines, 0)::DOUBLE, 0)"
BEHAVIOUR = f"""beh AS (SELECT *, {_AU_RATIO} AS au_ratio, {_MISMATCH} AS mism FROM pc),
    beh2 AS (SELECT *, {names_sql({"FILE_AGE_MISMATCH": "mism", "THIN_FILE_OLD_IDENTITY": "is_thin_file AND age_years > 30", "AU_ABUSE_PATTERN": "au_ratio > 0.6::DOUBLE AND au_count >= 3"})} AS anom,
      {clip(f"{points('is_thin_file', 0.2)} + {points('is_thin_file AND age_years > 35', 0.3)} + {points('au_ratio > 0.5', '0.4::DOUBLE * au_ratio')} + 0::DOUBLE + {points('mism', 0.4)}")} AS bscore FROM beh)"""
_IND = {
    "EXCESSIVE_AU_ACCOUNTS": "au_count >= 6", "HIGH_AU_COUNT": "au_count >= 4 AND au_count < 6", "RAPID_AU_ADDITIONS": "au_recent >= 3",
    "HIGH_LIMIT_AU_ACCOUNTS": "au_high_limit >= 2", "AU_ON_NEW_ACCOUNTS": "au_very_new >= 2",
}
AU = f"""au AS (SELECT identity_key, au_count, {names_sql(_IND)} AS ind, {clip(
    f"CASE WHEN au_count >= 6 THEN 0.4::DOUBLE WHEN au_count >= 4 THEN 0.25::DOUBLE WHEN au_count >= 3 THEN 0.1::DOUBLE ELSE 0 END + 0::DOUBLE + {points(_IND['EXCESSIVE_AU_ACCOUNTS'], 0.2)} + {points(_IND['RAPID_AU_ADDITIONS'], 0.15)} + {points(_IND['HIGH_LIMIT_AU_ACCOUNTS'], 0.1)} + {points(_IND['AU_ON_NEW_ACCOUNTS'], 0.1)} + {points(_IND['HIGH_AU_COUNT'], 0.05)}")} AS prob FROM pc)"""


@query(f"WITH {WITH_CREDIT}, {BEHAVIOUR} SELECT identity_key, round(age_years, 6) AS age_years, is_thin_file, round(au_ratio, 6) AS au_ratio, mism AS file_age_mismatch, {joined_sql('anom')} AS anomalies, round(bscore, 6) AS behavior_score FROM beh2")
def credit_behavior(t: Tables) -> DataFrame:
    f = C.credit_behaviour(people(t))
    return f.select("identity_key", F.round("age_years", 6).alias("age_years"), "is_thin_file", F.round("au_ratio", 6).alias("au_ratio"), "file_age_mismatch", joined(F.col("credit_anomalies")).alias("anomalies"), F.round("behavior_score", 6).alias("behavior_score"))


@query(f"WITH {WITH_CREDIT} SELECT identity_key, round({_EXPECTED}, 6) AS expected_months, round({_EXPECTED} - file_age_months, 6) AS gap_months, {_EXPECTED} - file_age_months < 24 AS is_consistent FROM pc")
def file_age_consistency(t: Tables) -> DataFrame:
    f = C.file_age_consistency(people(t))
    return f.select("identity_key", F.round("expected_months", 6).alias("expected_months"), F.round("gap_months", 6).alias("gap_months"), "is_consistent")


@query(f"""WITH {WITH_CREDIT}, {AU} SELECT identity_key, au_count, {joined_sql('ind')} AS indicators, round(prob, 6) AS abuse_probability,
    CASE WHEN prob >= 0.8 OR list_contains(ind, 'EXCESSIVE_AU_ACCOUNTS') THEN 'critical' WHEN prob >= 0.6 THEN 'high' WHEN prob >= 0.4 THEN 'medium' WHEN prob >= 0.2 THEN 'low' ELSE 'minimal' END AS risk_level FROM au""")
def au_abuse(t: Tables) -> DataFrame:
    f = C.au_abuse(people(t))
    return f.select("identity_key", "au_count", joined(F.col("abuse_indicators")).alias("indicators"), F.round("abuse_probability", 6).alias("abuse_probability"), F.col("au_risk_level").alias("risk_level"))


@query(f"WITH {TRADELINES} SELECT primary_holder, count(DISTINCT holder) AS au_holders, count(*) AS au_lines FROM (SELECT primary_holder // 5 AS primary_holder, holder FROM lines WHERE is_au) GROUP BY 1 HAVING count(DISTINCT holder) >= 3")
def au_rings(t: Tables) -> DataFrame:
    return C.au_rings(t.tradelines().withColumn("primary_holder", F.expr("primary_holder div 5")))


@query(f"""WITH {TRADELINES}, {GRAPH_USE}, tie AS (SELECT DISTINCT a.identity_id AS x, b.identity_id AS y FROM gu a JOIN gu b USING (element_type, element_key) WHERE a.identity_id <> b.identity_id)
    SELECT holder, count(*) AS au_lines, count(*) FILTER (y IS NULL) AS unrelated FROM lines LEFT JOIN tie ON holder = x AND primary_holder = y WHERE is_au GROUP BY 1""")
def unrelated_au(t: Tables) -> DataFrame:
    from verigrain.operators.graph import identity_edges

    return C.unrelated_au(t.tradelines(), identity_edges(t.graph_use()))


@query(f"""WITH {WITH_CREDIT}, s AS (SELECT identity_key, file_age_months IS NULL AS nofile, {names_sql({"THIN_FILE": "is_thin_file", "YOUNG_CREDIT_FILE": "file_age_months < 24", "HIGH_AU_RATIO": f"{_AU_RATIO} > 0.5", "HIGH_INQUIRY_VELOCITY": "inquiries_6mo > 5", "RAPID_ACCOUNT_OPENING": "new_accounts_6mo > 3", "HIGH_UTILIZATION": "utilization > 0.8", "RECENT_DELINQUENCY": "recent_delinquency > 0"})} AS sig FROM pc)
    SELECT identity_key, CASE WHEN nofile THEN '' ELSE {joined_sql('sig')} END AS signals, CASE WHEN nofile THEN 0.5 ELSE round(least(1.0, list_sum(list_transform(list_concat(sig, ['z']), lambda x: CASE x WHEN 'THIN_FILE' THEN 0.15 WHEN 'YOUNG_CREDIT_FILE' THEN 0.2 WHEN 'HIGH_AU_RATIO' THEN 0.25 WHEN 'HIGH_INQUIRY_VELOCITY' THEN 0.15 WHEN 'RAPID_ACCOUNT_OPENING' THEN 0.2 WHEN 'z' THEN 0.0 ELSE 0.1 END::DOUBLE)))::DOUBLE, 6) END::DOUBLE AS risk FROM s""")
def bureau_signals(t: Tables) -> DataFrame:
    f = C.bureau_signals(people(t))
    return f.select("identity_key", joined(F.col("bureau_signals")).alias("signals"), F.round("bureau_risk", 6).alias("risk"))


@query(f"WITH {WITH_CREDIT} SELECT identity_key, round(utilization, 6) AS utilization, CASE WHEN utilization > 0.8 THEN 'high' WHEN utilization > 0.5 THEN 'medium' ELSE 'low' END AS band FROM pc")
def utilization(t: Tables) -> DataFrame:
    u = F.col("utilization")
    return people(t).select("identity_key", F.round(u, 6).alias("utilization"), F.when(u > 0.8, "high").when(u > 0.5, "medium").otherwise("low").alias("band"))


# --- the five signals -------------------------------------------------------------------------------------------------


@query(f"WITH {WITH_CREDIT} SELECT identity_key, CASE WHEN is_thin_file AND age_years > 35 THEN 'high' WHEN is_thin_file AND age_years > 25 THEN 'medium' WHEN is_thin_file THEN 'low' END AS severity, CASE WHEN NOT is_thin_file THEN 0.0 WHEN age_years > 35 THEN 0.35 WHEN age_years > 25 THEN 0.2 ELSE 0.1 END::DOUBLE AS score FROM pc")
def thin_file_signal(t: Tables) -> DataFrame:
    return C.thin_file_signal(people(t)).select("identity_key", "severity", "score")


_GAP = f"({_EXPECTED} - file_age_months)"


@query(f"WITH {WITH_CREDIT} SELECT identity_key, round({_GAP}, 6) AS gap_months, CASE WHEN {_GAP} > 60 THEN 'critical' WHEN {_GAP} > 36 THEN 'high' WHEN {_GAP} > 12 THEN 'medium' END AS severity, CASE WHEN {_GAP} > 60 THEN 0.45 WHEN {_GAP} > 36 THEN 0.3 WHEN {_GAP} > 12 THEN 0.15 ELSE 0.0 END::DOUBLE AS score FROM pc")
def age_gap_signal(t: Tables) -> DataFrame:
    return C.age_gap_signal(people(t)).select("identity_key", F.round("gap_months", 6).alias("gap_months"), "severity", "score")


_AREAS = "areas AS (SELECT a AS area, CASE WHEN a % 7 <> 0 THEN 1936 + a % 60 END AS ys FROM range(1, 900) r(a))"


@query(f"""WITH {WITH_CREDIT}, {_AREAS}, m AS (SELECT identity_key, CASE WHEN year(dob) > ys + 25 THEN 'b' WHEN year(dob) >= 1987 AND ys > year(dob) + 5 THEN 'r' END AS k FROM people LEFT JOIN areas ON area = substr(ssn, 1, 3)::BIGINT)
    SELECT identity_key, CASE k WHEN 'b' THEN 'critical' WHEN 'r' THEN 'high' END AS severity, CASE k WHEN 'b' THEN 0.4 WHEN 'r' THEN 0.25 ELSE 0.0 END::DOUBLE AS score FROM m""")
def ssn_dob_signal(t: Tables) -> DataFrame:
    return C.ssn_dob_signal(t.identities(), t.area_map()).select("identity_key", "severity", "score")


@query(f"""WITH {APPLICATIONS}, d AS (SELECT DISTINCT * FROM ae WHERE ts >= {EVENTS_AT} - INTERVAL 90 DAY), c AS (SELECT ssn_key, count(*) FILTER (ts >= {EVENTS_AT} - INTERVAL 7 DAY) AS apps_7d, count(*) FILTER (ts >= {EVENTS_AT} - INTERVAL 30 DAY) AS apps_30d,
      count(*) AS apps_90d, count(DISTINCT CASE WHEN ts >= {EVENTS_AT} - INTERVAL 30 DAY THEN institution END) AS institutions_30d FROM d GROUP BY 1),
    s AS (SELECT *, CASE WHEN NOT (apps_7d > 3 OR apps_30d > 6 OR apps_90d > 12) THEN NULL WHEN apps_7d > 6 THEN 'critical' WHEN apps_7d > 3 OR apps_30d > 9 THEN 'high' ELSE 'medium' END AS severity FROM c)
    SELECT *, CASE severity WHEN 'critical' THEN 0.4 WHEN 'high' THEN 0.3 WHEN 'medium' THEN 0.2 ELSE 0.0 END::DOUBLE AS score FROM s""")
def application_velocity(t: Tables) -> DataFrame:
    return C.application_velocity(t.application_events(), as_of(EVENTS_AS_OF))


@query(f"""WITH {ELEMENT_USE}, mv AS (SELECT identity_key, element_key, min(ts) AS since FROM eu WHERE element_type = 'address' GROUP BY 1, 2),
    g AS (SELECT *, date_sub('day', since, lead(since) OVER (PARTITION BY identity_key ORDER BY since, element_key)) AS gap FROM mv),
    c AS (SELECT identity_key, greatest(0, count(*) FILTER (since >= {ORDERS_AT} - INTERVAL 360 DAY) - 1) AS changes_12m, greatest(0, count(*) FILTER (since >= {ORDERS_AT} - INTERVAL 720 DAY) - 1) AS changes_24m, avg(gap) / 30.0::DOUBLE AS ten FROM g GROUP BY 1),
    s AS (SELECT *, changes_12m > 2 OR changes_24m > 4 OR coalesce(ten < 6, false) AS un FROM c)
    SELECT identity_key, changes_12m, changes_24m, round(ten, 6) AS tenure_months, CASE WHEN un AND changes_12m > 4 THEN 'high' WHEN un THEN 'medium' END AS severity, CASE WHEN un AND changes_12m > 4 THEN 0.25 WHEN un THEN 0.15 ELSE 0.0 END::DOUBLE AS score FROM s""")
def address_instability(t: Tables) -> DataFrame:
    return C.address_instability(t.element_use("address"), as_of(ORDERS_AS_OF)).withColumn("tenure_months", F.round("tenure_months", 6))


# --- sequences ----------------------------------------------------------------------------------------------------------

FEATURES = f"""{SEQUENCES}, feat AS (SELECT account_id, count(*) AS n, CASE WHEN count(*) >= 3 THEN regr_slope(balance, i - 1) ELSE 0 END AS balance_trend, coalesce(stddev_pop(balance), 0) AS balance_volatility,
      coalesce(max(CASE WHEN i = n THEN balance END) - max(CASE WHEN i = n - 2 THEN balance END), 0) AS recent_balance_change, CASE WHEN count(*) >= 3 THEN regr_slope(payment, i - 1) ELSE 0 END AS payment_trend,
      CASE WHEN max(payment) > 0 THEN min(payment) / max(payment) ELSE 0 END AS min_payment_ratio,
      CASE WHEN count(*) >= 6 THEN avg(payment) FILTER (i > n - 3) < 0.8::DOUBLE * avg(payment) FILTER (i <= n - 3) ELSE false END AS payment_declining,
      avg(util) AS avg_utilization, max(util) AS max_utilization, CASE WHEN count(*) >= 3 THEN regr_slope(util, i - 1) ELSE 0 END AS utilization_trend,
      sum(cash) AS cash_total, count(*) FILTER (cash > 0) AS cash_frequency, coalesce(sum(cash) FILTER (i > n - 3), 0) AS recent_cash, coalesce(sum(lim) FILTER (lim > 0), 0) AS limit_increases, max(CASE WHEN i = n THEN lim END) AS recent_limit_change,
      max(CASE WHEN i = n THEN util END) AS util_now, max(CASE WHEN i = greatest(1, n - 5) THEN util END) AS util_then, least(6, count(*)) AS k FROM steps GROUP BY account_id)"""
_FEATURE_NAMES = ("balance_trend", "balance_volatility", "recent_balance_change", "payment_trend", "min_payment_ratio", "avg_utilization", "max_utilization", "utilization_trend", "cash_total", "recent_cash", "limit_increases", "recent_limit_change")


@query(f"WITH {FEATURES} SELECT account_id, n AS months_on_books, payment_declining, cash_frequency, {', '.join(f'round({c} + 1e-8::DOUBLE, 6) + 0 AS {c}' for c in _FEATURE_NAMES)} FROM feat")
def sequence_features(t: Tables) -> DataFrame:
    f = C.sequence_features(t.credit_sequences())
    return f.select("account_id", "months_on_books", "payment_declining", "cash_frequency", *[(F.round(F.col(c) + 1e-8, 6) + F.lit(0.0)).alias(c) for c in _FEATURE_NAMES])


BUST_OUT = f"""{FEATURES}, bo AS (SELECT *, {clip(f"{points('utilization_trend > 0.05', 0.2)} + {points('max_utilization > 0.9', 0.15)} + {points('payment_declining', 0.25)} + {points('payment_trend < -100', 0.15)} + {points('cash_frequency > 2', 0.2)} + {points('recent_cash > 1000', 0.15)} + {points('n < 12 AND balance_trend > 500', 0.2)}")} AS p,
    {names_sql({"MAXED_OUT": "max_utilization > 0.95", "DECLINING_PAYMENTS": "payment_declining", "FREQUENT_CASH_ADVANCES": "cash_frequency >= 3", "RAPID_UTILIZATION_INCREASE": "utilization_trend > 0.1", "RAPID_BALANCE_GROWTH": "balance_trend > 1000"})} AS warn,
    CASE WHEN k > 1 THEN (util_now - util_then) / (k - 1) END AS slope6 FROM feat)"""
_DAYS = "CASE WHEN p > 0.5 THEN CASE WHEN n < 3 THEN 90 WHEN util_now >= 0.95 THEN 30 WHEN slope6 > 0 THEN trunc(greatest(7.0::DOUBLE, least(90.0::DOUBLE, 30.0::DOUBLE * ((1.0::DOUBLE - util_now) / slope6))))::INT ELSE 90 END END"
_BO_LEVEL = "CASE WHEN p >= 0.9 THEN 'critical' WHEN p >= 0.75 THEN 'high' WHEN p >= 0.5 THEN 'medium' WHEN p >= 0.3 THEN 'low' ELSE 'minimal' END"


@query(f"""WITH {BUST_OUT}, lv AS (SELECT *, {_BO_LEVEL} AS lev FROM bo) SELECT account_id, round(p, 6) AS bust_out_probability, {joined_sql('warn')} AS warning_signals, ({_DAYS})::INT AS days_to_bust_out, lev AS risk_level,
    CASE lev WHEN 'critical' THEN 'IMMEDIATE_REVIEW_CREDIT_FREEZE' WHEN 'high' THEN 'URGENT_REVIEW_REDUCE_LIMIT' WHEN 'medium' THEN 'MONITOR_CLOSELY' WHEN 'low' THEN 'STANDARD_MONITORING' ELSE 'NO_ACTION' END AS recommended_action FROM lv""")
def bust_out(t: Tables) -> DataFrame:
    f = C.bust_out(C.sequence_features(t.credit_sequences()))
    return f.select("account_id", F.round("bust_out_probability", 6).alias("bust_out_probability"), joined(F.col("warning_signals")).alias("warning_signals"), "days_to_bust_out", F.col("bust_out_level").alias("risk_level"), F.col("bust_out_action").alias("recommended_action"))


@query(f"WITH {APPLICATIONS} SELECT DISTINCT ssn_key, institution, ts FROM ae WHERE ts >= {EVENTS_AT} - INTERVAL 90 DAY AND ts <= {EVENTS_AT} ORDER BY ssn_key, ts DESC, institution")
def application_history(t: Tables) -> DataFrame:
    return C.application_history(t.application_events(), as_of(EVENTS_AS_OF), 90)


QUERIES, ORACLES = R.queries, R.oracles
