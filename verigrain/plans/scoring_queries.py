"""Queries on component scores, the synthetic score, the ensemble and the scoring of applications."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verigrain.functions import identity as I
from verigrain.functions.basics import joined
from verigrain.operators import credit as C
from verigrain.operators import graph as G
from verigrain.operators import scoring as X
from verigrain.operators import velocity as V
from verigrain.plans.credit_queries import AU, BEHAVIOUR, BUST_OUT, people
from verigrain.plans.durable import durable
from verigrain.plans.identity_queries import _RESULT
from verigrain.plans.registry import Registry
from verigrain.plans.sql_tables import ELEMENT_USE, GRAPH_USE, WITH_CREDIT, clip, joined_sql, names_sql, points
from verigrain.plans.velocity_queries import _ANALYSIS
from verigrain.sources.adapters import ORDERS_AS_OF, Tables, as_of
from verigrain.sources.sinks import observed

R = Registry()
query = R.query

# Signal bags made from customers by integer arithmetic, so that every branch is met.
_K = "c_custkey"
_BAGS = f"""bags AS (SELECT {_K} AS identity_key, {_K} % 5 = 0 AS mism, {_K} % 97 = 0 AS death, {_K} % 13 = 0 AS inval, {_K} % 17 = 0 AS itin, {_K} % 19 = 0 AS multi, {_K} % 4 AS shared, ({_K} % 10) / 10.0::DOUBLE AS dens, {_K} % 15 AS size,
    ({_K} % 7) / 7.0::DOUBLE AS navg, ({_K} % 11) / 11.0::DOUBLE AS va, ({_K} % 6) / 6.0::DOUBLE AS vp, ({_K} % 9) / 9.0::DOUBLE AS ve, {_K} % 3 = 0 AS thin, {_K} % 8 = 0 AS fam, {_K} % 21 = 0 AS rapid, {_K} % 10 = 0 AS aua, {_K} % 2 = 0 AS weak, {_K} % 6 AS sdev, {_K} % 50 = 0 AS fraud, {_K} % 31 = 0 AS emu FROM customer)"""
_SYNTH = f"""{_BAGS}, comp AS (SELECT *, {clip(f"{points('mism', 0.6)} + {points('death', 0.8)} + {points('inval', 0.5)} + {points('itin', 0.4)} + {points('multi', 0.5)}")} AS c1,
      {clip(f"{points('shared > 0', 'least(0.6::DOUBLE, 0.3::DOUBLE * shared)')} + {points('dens > 0.5', 0.2)} + {points('size > 5', 'least(0.3::DOUBLE, 0.05::DOUBLE * (size - 5))')} + {points('navg > 0.5', 0.2)}")} AS c2,
      {clip("0.3::DOUBLE * va + 0.4::DOUBLE * vp + 0.3::DOUBLE * ve")} AS c3, {clip(f"{points('thin', 0.2)} + {points('fam', 0.4)} + {points('rapid', 0.3)} + {points('aua', 0.5)}")} AS c4,
      {clip(f"{points('weak', 0.3)} + {points('sdev > 3', 0.4)} + {points('fraud', 0.8)} + {points('emu', 0.5)}")} AS c5 FROM bags),
    syn AS (SELECT *, 0.25::DOUBLE * c1 + 0.3::DOUBLE * c2 + 0.2::DOUBLE * c3 + 0.15::DOUBLE * c4 + 0.1::DOUBLE * c5 AS s,
      {names_sql({"SSN_DOB_MISMATCH": "mism", "DEATH_MASTER_MATCH": "death", "MULTIPLE_SSNS": "multi", "SHARED_SSN": "shared > 0", "LARGE_CLUSTER": "size > 5", "HIGH_ADDRESS_VELOCITY": "va > 0.5", "HIGH_PHONE_VELOCITY": "vp > 0.5", "THIN_FILE": "thin", "AU_ABUSE": "aua", "FRAUD_DEVICE": "fraud"})} AS sig FROM comp)"""


def bags(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    part = lambda n: (k % n) / float(n)
    return t.read("customer").select(
        k.alias("identity_key"),
        F.struct((k % 5 == 0).alias("ssn_dob_mismatch"), (k % 97 == 0).alias("death_master_match"), (k % 13 == 0).alias("invalid_ssn"), (k % 17 == 0).alias("itin_as_ssn"), (k % 19 == 0).alias("multiple_ssns")).alias("ssn_signals"),
        F.struct((k % 4).alias("shared_ssn_count"), part(10).alias("cluster_density"), (k % 15).alias("cluster_size"), part(7).alias("neighbor_avg_synthetic_score")).alias("graph_features"),
        F.struct(part(11).alias("address_velocity_score"), part(6).alias("phone_velocity_score"), part(9).alias("email_velocity_score")).alias("velocity_signals"),
        F.struct((k % 3 == 0).alias("is_thin_file"), (k % 8 == 0).alias("file_age_mismatch"), (k % 21 == 0).alias("rapid_credit_building"), (k % 10 == 0).alias("au_abuse_pattern")).alias("credit_signals"),
        F.struct((k % 2 == 0).alias("weak_binding"), (k % 6).alias("shared_device_count"), (k % 50 == 0).alias("known_fraud_device"), (k % 31 == 0).alias("emulator_detected")).alias("device_signals"),
    )


@query(f"WITH {_SYNTH} SELECT identity_key, round(c1, 6) AS ssn_score, round(c2, 6) AS graph_score, round(c3, 6) AS velocity_score, round(c4, 6) AS credit_score, round(c5, 6) AS device_score FROM syn")
def synthetic_components(t: Tables) -> DataFrame:
    return X.components(bags(t)).select("identity_key", *[F.round(f"{c}_score", 6).alias(f"{c}_score") for c in X.COMPONENTS])


_SLEVEL = "CASE WHEN s >= 0.9 THEN 'critical' WHEN s >= 0.8 THEN 'high' WHEN s >= 0.5 THEN 'medium' WHEN s >= 0.3 THEN 'low' ELSE 'minimal' END"
_TOP = "CASE greatest(c1, c2, c3, c4, c5) WHEN c1 THEN 'ssn' WHEN c2 THEN 'graph' WHEN c3 THEN 'velocity' WHEN c4 THEN 'credit' ELSE 'device' END"


@query(f"WITH {_SYNTH} SELECT identity_key, round(s, 6) AS synthetic_score, {_SLEVEL} AS risk_level, {joined_sql('sig')} AS triggered_signals, {_TOP} AS top_component FROM syn")
def synthetic_score(t: Tables) -> DataFrame:
    f = X.synthetic(bags(t))
    return f.select("identity_key", F.round("synthetic_score", 6).alias("synthetic_score"), F.col("synthetic_level").alias("risk_level"), joined(F.col("triggered_signals")).alias("triggered_signals"), "top_component")


@query(f"WITH {_SYNTH} SELECT {_SLEVEL} AS risk_level, count(*) AS identities, round(avg(s), 6) AS mean_score FROM syn GROUP BY 1")
def score_levels(t: Tables) -> DataFrame:
    return X.synthetic(bags(t)).groupBy(F.col("synthetic_level").alias("risk_level")).agg(F.count(F.lit(1)).alias("identities"), F.round(F.avg("synthetic_score"), 6).alias("mean_score"))


# --- the ensemble over all tables -----------------------------------------------------------------------------------------


def full_scores(t: Tables, wanted: DataFrame | None = None) -> DataFrame:
    """Scores of all identities, or of those that ``wanted`` names. What others bring (shared elements, links) counts
    in either case; only rows about single identities are left out before they are joined."""
    at = as_of(ORDERS_AS_OF)
    credit = C.au_abuse(C.credit_behaviour(people(t)))
    if wanted is not None:
        credit = credit.join(wanted, "identity_key", "left_semi")
    velocity = V.velocity_analysis(t.element_use(), at, newest=t.element_use(newest=True)).drop("risk_level")
    stored = t.read("customer").select(F.col("c_custkey").alias("identity_id"), ((F.col("c_custkey") * 7 % 100) / 100.0).alias("score"))
    graph = G.scoring_features(t.graph_use(), stored)
    risk = C.bust_out(C.sequence_features(t.credit_sequences())).select(F.col("account_id").alias("identity_key"), "bust_out_probability", "warning_signals")
    ssn = C.ssn_dob_signal(t.identities(), t.area_map()).select("identity_key", "mismatch", I.ssn_result(F.col("ssn"), F.col("identity_key") % 101 == 0).alias("ssn_result"))
    return X.ensemble(credit, velocity, graph, risk, ssn)


_EDGES = f"""{GRAPH_USE}, ge AS (SELECT a.identity_id AS x, b.identity_id AS y, list_sort(list(DISTINCT element_type)) AS types FROM gu a JOIN gu b USING (element_type, element_key) WHERE a.identity_id <> b.identity_id GROUP BY 1, 2),
    walk AS (SELECT x AS v, x AS c FROM ge UNION SELECT ge.y, walk.c FROM walk JOIN ge ON ge.x = walk.v), comp AS (SELECT v, min(c) AS component FROM walk GROUP BY 1),
    csz AS (SELECT component, count(*) AS csize FROM comp GROUP BY 1), cme AS (SELECT component, count(*) / 2 AS m FROM ge JOIN comp ON x = v GROUP BY 1),
    stored AS (SELECT c_custkey AS id, (c_custkey * 7 % 100) / 100.0::DOUBLE AS score FROM customer),
    gn AS (SELECT x, count(*) FILTER (list_contains(types, 'ssn')) AS shared_ssn, round(avg(coalesce(score, 0)), 6) AS navg FROM ge LEFT JOIN stored ON id = y GROUP BY 1),
    gf AS (SELECT x AS identity_key, shared_ssn, navg, csize, 2.0::DOUBLE * m / (csize * (csize - 1)) AS cdens FROM gn JOIN comp ON x = v JOIN csz USING (component) JOIN cme USING (component))"""
_DEAD, _BAD, _ITIN = "res = 'death_master'", "starts_with(res, 'invalid')", "res = 'itin'"
_ALL = f"""WITH RECURSIVE {ELEMENT_USE}, {_ANALYSIS}, {WITH_CREDIT}, {BEHAVIOUR}, {AU}, {BUST_OUT}, {_EDGES},
    areas AS (SELECT a AS area, CASE WHEN a % 7 <> 0 THEN 1936 + a % 60 END AS ys FROM range(1, 900) r(a)),
    sr AS (SELECT identity_key, {_RESULT} AS res, year(dob) > ys + 25 OR (year(dob) >= 1987 AND ys > year(dob) + 5) AS mm FROM people LEFT JOIN areas ON area = substr(ssn, 1, 3)::BIGINT),
    j AS (SELECT b.identity_key, coalesce(t.address_velocity, 0) AS va, coalesce(t.phone_velocity, 0) AS vp, coalesce(t.email_velocity, 0) AS ve, coalesce(t.device_velocity, 0) AS vd, coalesce(t.overall, 0) AS vo, coalesce(t.names, []) AS vn,
      b.is_thin_file, b.mism AS fam, b.anom, b.bscore, au.prob AS aup, au.ind, coalesce(gf.shared_ssn, 0) AS shared_ssn, coalesce(gf.csize, 1) AS csize, coalesce(gf.cdens, 0) AS cdens, coalesce(gf.navg, 0) AS navg, bo.p AS bop, coalesce(bo.warn, []) AS warn, sr.res, coalesce(sr.mm, false) AS mm
      FROM beh2 b JOIN au ON b.identity_key = au.identity_key LEFT JOIN total t ON t.identity_key = b.identity_key LEFT JOIN gf ON gf.identity_key = b.identity_key LEFT JOIN bo ON bo.account_id = b.identity_key LEFT JOIN sr ON sr.identity_key = b.identity_key),
    c AS (SELECT *, {clip(f"{points('mm', 0.6)} + {points(_DEAD, 0.8)} + {points(_BAD, 0.5)} + {points(_ITIN, 0.4)}")} AS c1,
      {clip(f"{points('shared_ssn > 0', 'least(0.6::DOUBLE, 0.3::DOUBLE * shared_ssn)')} + {points('cdens > 0.5', 0.2)} + {points('csize > 5', 'least(0.3::DOUBLE, 0.05::DOUBLE * (csize - 5))')} + {points('navg > 0.5', 0.2)}")} AS c2, {clip('0.3::DOUBLE * va + 0.4::DOUBLE * vp + 0.3::DOUBLE * ve')} AS c3,
      {clip(f"{points('is_thin_file', 0.2)} + {points('fam', 0.4)} + {points('aup > 0.5', 0.5)}")} AS c4, {points('vd = 0', 0.3)} AS c5 FROM j),
    f AS (SELECT *, 0.25::DOUBLE * c1 + 0.3::DOUBLE * c2 + 0.2::DOUBLE * c3 + 0.15::DOUBLE * c4 + 0.1::DOUBLE * c5 AS s, list_sort(list_distinct(list_concat(vn, anom, ind, warn,
      {names_sql({"SSN_DOB_MISMATCH": "mm", "DEATH_MASTER_MATCH": "res = 'death_master'", "SHARED_SSN": "shared_ssn > 0", "LARGE_CLUSTER": "csize > 5", "HIGH_ADDRESS_VELOCITY": "va > 0.5", "HIGH_PHONE_VELOCITY": "vp > 0.5", "THIN_FILE": "is_thin_file", "AU_ABUSE": "aup > 0.5"})}))) AS sig FROM c),
    e AS (SELECT *, least(1.0::DOUBLE, CASE WHEN bop IS NULL THEN (0.4::DOUBLE * s + 0.2::DOUBLE * vo + 0.15::DOUBLE * bscore + 0.15::DOUBLE * aup) / (1.0::DOUBLE - 0.1::DOUBLE) ELSE 0.4::DOUBLE * s + 0.2::DOUBLE * vo + 0.15::DOUBLE * bscore + 0.15::DOUBLE * aup + 0.1::DOUBLE * bop END) AS fin FROM f),
    l AS (SELECT *, CASE WHEN list_has_any(sig, ['SSN_DOB_MISMATCH', 'DEATH_MASTER_MATCH', 'SHARED_SSN', 'FRAUD_DEVICE']) OR fin >= 0.85 THEN 'critical' WHEN fin >= 0.65 THEN 'high' WHEN fin >= 0.45 THEN 'medium' WHEN fin >= 0.25 THEN 'low' ELSE 'minimal' END AS lev FROM e)"""
_ACTION = "CASE WHEN lev = 'critical' AND coalesce(bop, 0) > 0.8 THEN 'IMMEDIATE_CREDIT_FREEZE_SAR_FILING' WHEN lev = 'critical' THEN 'IMMEDIATE_REVIEW_DECLINE_APPLICATION' WHEN lev = 'high' THEN 'MANUAL_REVIEW_REQUIRED' WHEN lev = 'medium' THEN 'ENHANCED_VERIFICATION' WHEN lev = 'low' THEN 'STANDARD_PROCESSING_MONITOR' ELSE 'APPROVE' END"


@query(f"{_ALL} SELECT identity_key, round(s, 6) AS synthetic_score, round(fin, 6) AS final_score, lev AS final_level, array_to_string(sig, ',') AS all_signals, {_ACTION} AS action FROM l")
def ensemble(t: Tables) -> DataFrame:
    f = full_scores(t)
    return f.select("identity_key", F.round("synthetic_score", 6).alias("synthetic_score"), F.round("final_score", 6).alias("final_score"), "final_level", F.array_join("all_signals", ",").alias("all_signals"), "action")


@query(f"{_ALL} SELECT o_orderkey AS application, identity_key, round(fin, 6) AS final_score, lev AS final_level, {_ACTION} AS action FROM l JOIN orders ON o_custkey = identity_key WHERE o_orderdate >= TIMESTAMP '2001-08-01' - INTERVAL 90 DAY")
def full_application_score(t: Tables) -> DataFrame:
    recent = t.read("orders").where(F.col("o_orderdate").cast("timestamp_ntz") >= as_of(ORDERS_AS_OF) - F.expr("INTERVAL 90 DAYS"))
    applicants = durable(recent.select(F.col("o_custkey").alias("identity_key")).distinct())
    scored = full_scores(t, applicants).select("identity_key", F.round("final_score", 6).alias("final_score"), "final_level", "action")
    return recent.select(F.col("o_orderkey").alias("application"), F.col("o_custkey").alias("identity_key")).join(scored, "identity_key")


@query(f"{_ALL} SELECT identity_key, 'Risk ' || lev || ' at ' || round(round(fin, 6)::DECIMAL(18, 6), 2)::DECIMAL(18, 2) || '; strongest component ' || {_TOP} || CASE WHEN len(sig) > 0 THEN '; signals: ' || array_to_string(sig[1:5], ', ') ELSE '' END AS explanation FROM l")
def explanation_text(t: Tables) -> DataFrame:
    return X.explanation(full_scores(t)).select("identity_key", "explanation")


@query("SELECT o_custkey AS identity_key, arg_max(o_totalprice, (o_orderdate, o_totalprice)) AS score, max(o_orderdate) AS ts FROM orders GROUP BY 1")
def latest_score(t: Tables) -> DataFrame:
    log = t.read("orders").select(F.col("o_custkey").alias("identity_key"), F.col("o_totalprice").alias("score"), F.col("o_orderdate").alias("ts"))
    return X.latest_scores(log)


LEVELS = ("critical", "high", "medium", "low", "minimal")
BUCKETS = tuple(k / 10 for k in range(1, 11))


@query(f"""WITH {_SYNTH}, v AS (SELECT s, {_SLEVEL} AS level FROM syn)
    SELECT 'scored' AS name, count(*)::DOUBLE AS value FROM v {' '.join(f"UNION ALL SELECT 'level_{k}', count(*) FILTER (level = '{k}') FROM v" for k in LEVELS)}
    {' '.join(f"UNION ALL SELECT 'score_le_{le}', count(*) FILTER (round(s, 9) <= {le}) FROM v" for le in BUCKETS)}""")
def scoring_metrics(t: Tables) -> DataFrame:
    """What a run that scores all identities counts on its way: no second pass over the scores."""
    score = F.round("synthetic_score", 9)
    counts = {"scored": F.count(F.lit(1))} | {f"level_{k}": F.count_if(F.col("synthetic_level") == k) for k in LEVELS} | {f"score_le_{le}": F.count_if(score <= le) for le in BUCKETS}
    scored, seen = observed(X.synthetic(bags(t)), "scoring", **counts)
    scored.write.format("noop").mode("overwrite").save()
    return t.spark.createDataFrame([(k, float(v)) for k, v in seen.get.items()], "name string, value double")


QUERIES, ORACLES = R.queries, R.oracles
