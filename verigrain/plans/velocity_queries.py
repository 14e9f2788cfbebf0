"""Queries on element re-use and devices, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verigrain.functions import identity as I
from verigrain.functions.basics import before, joined
from verigrain.operators import devices as D
from verigrain.operators import velocity as V
from verigrain.plans.registry import Registry
from verigrain.plans.sql_tables import DEVICE_USE, ELEMENT_USE, EVENTS_AT, ORDERS_AT, clip, names_sql
from verigrain.sources.adapters import EVENTS_AS_OF, ORDERS_AS_OF, Tables, as_of

AT, EVENTS = lambda: as_of(ORDERS_AS_OF), lambda: as_of(EVENTS_AS_OF)
R = Registry()
query = R.query


def _windows(kinds: dict[str, str]) -> str:
    return ", ".join(
        f"count(DISTINCT CASE WHEN ts >= {ORDERS_AT} - INTERVAL {d} DAY THEN {c} END) AS unique_{k}_{d}d" for k, c in kinds.items() for d in (30, 90, 180)
    )


_IDS = {"identities": "identity_key", "ssns": "ssn_key"}
_COUNTS = f"SELECT element_type, element_key, {_windows(_IDS)}, min(ts) AS first_seen, max(ts) AS last_seen FROM eu GROUP BY ALL"
_CAP = "CASE element_type WHEN 'address' THEN 5 WHEN 'phone' THEN 3 WHEN 'email' THEN 2 WHEN 'device' THEN 3 ELSE 5 END"


def _score_sql(cap: str) -> str:
    r = f"(unique_identities_180d::DOUBLE / {cap})"
    base = f"(CASE WHEN {r} <= 1 THEN 0.3::DOUBLE * {r} ELSE 0.3::DOUBLE + 0.233::DOUBLE * least({r} - 1, 3) END + CASE WHEN unique_ssns_180d > 1 THEN least(0.2::DOUBLE, 0.05::DOUBLE * (unique_ssns_180d - 1)) ELSE 0 END)"
    return f"CASE WHEN unique_identities_180d <= 1 THEN 0 ELSE least(1.0::DOUBLE, CASE WHEN unique_identities_30d::DOUBLE / unique_identities_180d > 0.5::DOUBLE THEN {base} * 1.2::DOUBLE ELSE {base} END) END"


_SCORED = f"counts AS ({_COUNTS}), scored AS (SELECT *, round({_score_sql(_CAP)}, 6) AS velocity_score FROM counts)"


@query(f"WITH {ELEMENT_USE} {_COUNTS}")
def velocity_counts(t: Tables) -> DataFrame:
    return V.window_counts(t.element_use(), AT(), _IDS)


def _one_type(kind: str):
    def run(t: Tables) -> DataFrame:
        return V.element_velocity(t.element_use(kind), AT()).withColumn("velocity_score", F.round("velocity_score", 6))

    run.__name__ = f"element_velocity_{kind}"
    query(f"WITH {ELEMENT_USE}, {_SCORED} SELECT * FROM scored WHERE element_type = '{kind}'")(run)


for _kind in ("address", "phone", "email", "device"):
    _one_type(_kind)

_PHONE_R = "(unique_identities_180d::DOUBLE / 3)"
_PHONE_BASE = f"(CASE WHEN {_PHONE_R} <= 1 THEN 0.4::DOUBLE * {_PHONE_R} ELSE 0.4::DOUBLE + 0.24::DOUBLE * least({_PHONE_R} - 1, 2.5::DOUBLE) END + CASE WHEN unique_ssns_180d > 1 THEN least(0.25::DOUBLE, 0.08::DOUBLE * (unique_ssns_180d - 1)) ELSE 0 END + CASE WHEN unique_addresses_180d > 2 THEN least(0.1::DOUBLE, 0.03::DOUBLE * (unique_addresses_180d - 2)) ELSE 0 END)"


@query(
    f"WITH {ELEMENT_USE}, c AS (SELECT element_type, element_key, {_windows(_IDS | {'addresses': 'address_key'})}, min(ts) AS first_seen, max(ts) AS last_seen FROM eu WHERE element_type = 'phone' GROUP BY ALL) "
    f"SELECT *, unique_identities_180d > 3 AS is_high_velocity, round(CASE WHEN unique_identities_180d <= 1 THEN 0 ELSE least(1.0::DOUBLE, CASE WHEN unique_identities_30d::DOUBLE / unique_identities_180d > 0.5::DOUBLE THEN {_PHONE_BASE} * 1.2::DOUBLE ELSE {_PHONE_BASE} END) END, 6) AS velocity_score FROM c"
)
def phone_tracker(t: Tables) -> DataFrame:
    return V.phone_tracker(t.element_use("phone"), AT()).withColumn("velocity_score", F.round("velocity_score", 6))


@query(f"WITH {ELEMENT_USE}, {_SCORED} SELECT *, unique_identities_180d > 5 AS is_high_velocity FROM scored WHERE element_type = 'address'")
def address_tracker(t: Tables) -> DataFrame:
    return V.address_tracker(t.element_use("address"), AT()).withColumn("velocity_score", F.round("velocity_score", 6))


_ANOMALIES = {
    "HIGH_ADDRESS_VELOCITY": "address_velocity > 0.5", "HIGH_PHONE_VELOCITY": "phone_velocity > 0.5", "HIGH_EMAIL_VELOCITY": "email_velocity > 0.5",
    "SHARED_DEVICE": "device_velocity > 0.5", "ADDRESS_PHONE_CORRELATION": "address_velocity > 0.3 AND phone_velocity > 0.3",
}
_WIDE = ", ".join(f"coalesce(max(CASE WHEN element_type = '{k}' THEN score END), 0) AS {k}_velocity" for k in ("address", "phone", "email", "device"))
_ANALYSIS = f"""{_SCORED.replace('round(', '(').replace(', 6) AS velocity_score', ') AS score')},
    own AS (SELECT identity_key, element_type, arg_max(element_key, (ts, element_key)) AS element_key FROM eu GROUP BY ALL),
    wide AS (SELECT identity_key, {_WIDE} FROM own LEFT JOIN scored USING (element_type, element_key) GROUP BY identity_key),
    total AS (SELECT *, least(1.0::DOUBLE, 0.25::DOUBLE * address_velocity + 0.35::DOUBLE * phone_velocity + 0.2::DOUBLE * email_velocity + 0.2::DOUBLE * device_velocity) AS overall, {names_sql(_ANOMALIES)} AS names FROM wide)"""
_LEVEL = "CASE WHEN overall >= 0.8 OR len(names) >= 4 THEN 'critical' WHEN overall >= 0.6 OR len(names) >= 3 THEN 'high' WHEN overall >= 0.4 OR len(names) >= 2 THEN 'medium' WHEN overall >= 0.2 OR len(names) >= 1 THEN 'low' ELSE 'minimal' END"


@query(
    f"WITH {ELEMENT_USE}, {_ANALYSIS} SELECT identity_key, round(address_velocity, 6) AS address_velocity, round(phone_velocity, 6) AS phone_velocity, round(email_velocity, 6) AS email_velocity, round(device_velocity, 6) AS device_velocity, round(overall, 6) AS overall_velocity_score, array_to_string(list_sort(names), ',') AS anomalies, {_LEVEL} AS risk_level FROM total"
)
def velocity_analysis(t: Tables) -> DataFrame:
    found = V.velocity_analysis(t.element_use(), AT(), newest=t.element_use(newest=True))
    rounded = {c: F.round(c, 6) for c in ("address_velocity", "phone_velocity", "email_velocity", "device_velocity", "overall_velocity_score")}
    return found.withColumns(rounded | {"anomalies": joined(F.col("anomalies"))})


@query(f"WITH {ELEMENT_USE}, {_ANALYSIS} SELECT unnest(names) AS anomaly, count(*) AS identities FROM total GROUP BY 1")
def velocity_anomalies(t: Tables) -> DataFrame:
    found = V.velocity_analysis(t.element_use(), AT(), newest=t.element_use(newest=True))
    return found.select(F.explode("anomalies").alias("anomaly")).groupBy("anomaly").agg(F.count(F.lit(1)).alias("identities"))


@query(f"""WITH {ELEMENT_USE} SELECT element_type, element_key, array_to_string(list_sort(list(DISTINCT identity_key)), ',') AS identities,
    array_to_string(list_sort(list(DISTINCT ssn_key)), ',') AS ssns, min(ts) AS first_seen, max(ts) AS last_seen
    FROM eu WHERE ts >= {ORDERS_AT} - INTERVAL 180 DAY GROUP BY 1, 2""")
def element_history(t: Tables) -> DataFrame:
    found = V.element_history(t.element_use(), AT())
    return found.withColumns({c: F.array_join(c, ",") for c in ("identities", "ssns")})


@query(f"WITH {ELEMENT_USE} SELECT element_type, element_key, identity_key, max(ts) AS last_use FROM eu WHERE ts >= {ORDERS_AT} - INTERVAL 180 DAY GROUP BY 1, 2, 3")
def shared_on_element(t: Tables) -> DataFrame:
    return V.last_use_per_identity(t.element_use(), AT())


@query(f"""WITH {ELEMENT_USE}, last AS (SELECT element_type, element_key, identity_key, max(ts) AS last FROM eu GROUP BY 1, 2, 3)
    SELECT element_type, element_key, count(*) FILTER (last <= {ORDERS_AT} - INTERVAL 180 DAY) AS removed, count(*) FILTER (last > {ORDERS_AT} - INTERVAL 180 DAY) AS kept FROM last GROUP BY 1, 2""")
def retention_cleanup(t: Tables) -> DataFrame:
    return V.retention(t.element_use(), AT(), 180, t.parts())[1]


@query(f"""WITH {ELEMENT_USE}, own AS (SELECT DISTINCT element_key, ssn_key FROM eu WHERE element_type = 'phone' AND ts >= {ORDERS_AT} - INTERVAL 180 DAY),
    n AS (SELECT element_key, count(*) AS ssns FROM own GROUP BY 1)
    SELECT o.element_key AS phone, o.ssn_key AS claimed, n.ssns - 1 AS others,
      round(CASE WHEN n.ssns - 1 <= 0 THEN 0 WHEN n.ssns - 1 = 1 THEN 0.5 WHEN n.ssns - 1 = 2 THEN 0.7 ELSE least(1.0::DOUBLE, 0.7::DOUBLE + 0.1::DOUBLE * (n.ssns - 3)) END::DOUBLE, 6) AS risk
    FROM own o JOIN n USING (element_key)""")
def phone_ssn_mismatch(t: Tables) -> DataFrame:
    recent = t.element_use("phone").where(F.col("ts") >= before(AT(), 180))
    own = recent.select("element_key", "ssn_key").distinct()
    n = own.groupBy("element_key").agg((F.count(F.lit(1)) - 1).alias("others"))
    found = own.join(n, "element_key")
    return found.select(F.col("element_key").alias("phone"), F.col("ssn_key").alias("claimed"), "others", F.round(I.other_ssn_risk(F.col("others")), 6).alias("risk"))


@query(f"""WITH {ELEMENT_USE}, p AS (SELECT DISTINCT identity_key, element_key FROM eu WHERE element_type = 'address' AND ts >= {ORDERS_AT} - INTERVAL 180 DAY)
    SELECT a.element_key AS address_a, b.element_key AS address_b, count(*) AS shared_identities FROM p a JOIN p b USING (identity_key)
    WHERE a.element_key < b.element_key GROUP BY 1, 2 HAVING count(*) >= 2""")
def linked_addresses(t: Tables) -> DataFrame:
    return V.linked_addresses(t.element_use("address"), AT())


@query(f"WITH {ELEMENT_USE} SELECT identity_key, element_type, element_key, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS uses FROM eu GROUP BY 1, 2, 3")
def graph_writer(t: Tables) -> DataFrame:
    return V.pair_writes(t.element_use(), t.parts())


@query(f"WITH {ELEMENT_USE} SELECT element_type, count(*) AS uses, count(DISTINCT element_key) AS elements, count(DISTINCT identity_key) AS identities FROM eu GROUP BY 1")
def use_log_fanout(t: Tables) -> DataFrame:
    return V.fanout(t.element_use())


# --- devices --------------------------------------------------------------------------------------------------------

_PAIRS = f"""{DEVICE_USE}, gaps AS (SELECT *, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY identity_key, device ORDER BY ts))) / 1e6 AS gap FROM du),
    pair AS (SELECT identity_key, device, count(*) AS n, min(ts) AS first, max(ts) AS last, avg(gap) AS mean_gap, stddev_pop(gap) AS std_gap FROM gaps GROUP BY 1, 2),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY identity_key ORDER BY n DESC, device) = 1 AS is_primary, count(*) OVER (PARTITION BY identity_key) AS devices,
      date_sub('day', first, {EVENTS_AT}) AS days, date_sub('day', min(first) OVER (PARTITION BY identity_key), max(last) OVER (PARTITION BY identity_key)) AS span_days FROM pair),
    bound AS (SELECT *, greatest(0::DOUBLE, least(1.0::DOUBLE, least(0.4::DOUBLE, 0.04::DOUBLE * n) + least(0.3::DOUBLE, 0.01::DOUBLE * days) + CASE WHEN is_primary THEN 0.2::DOUBLE ELSE 0 END - CASE WHEN devices - 1 > 5 THEN 0.1::DOUBLE ELSE 0 END)) AS binding_score,
      CASE WHEN devices <= 1 THEN 0 ELSE (devices - 1) / greatest(1.0::DOUBLE, span_days / 30.0::DOUBLE) END AS change_rate FROM ranked)"""


@query(f"""WITH {_PAIRS} SELECT identity_key, device, n, days, is_primary, devices, round(binding_score, 6) AS binding_score, round(change_rate, 6) AS change_rate,
    round(least(1.0::DOUBLE, CASE WHEN change_rate > 2 THEN 0.3::DOUBLE ELSE 0 END + CASE WHEN binding_score < 0.3::DOUBLE THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN change_rate > 3 OR devices > 10 THEN 0.4::DOUBLE ELSE 0 END), 6) AS binding_risk FROM bound""")
def device_binding(t: Tables) -> DataFrame:
    found = D.device_bindings(t.device_use(), EVENTS())
    return found.select("identity_key", "device", "n", "days", "is_primary", "devices", *[F.round(c, 6).alias(c) for c in ("binding_score", "change_rate", "binding_risk")])


@query(f"WITH {_PAIRS} SELECT identity_key, device, n, round(CASE WHEN n < 2 THEN 0.5 WHEN mean_gap = 0 THEN 1.0 ELSE greatest(0::DOUBLE, 1.0::DOUBLE - std_gap / (mean_gap + 1)) END::DOUBLE, 6) AS consistency_score FROM bound")
def device_consistency(t: Tables) -> DataFrame:
    return D.device_bindings(t.device_use(), EVENTS()).select("identity_key", "device", "n", F.round("consistency_score", 6).alias("consistency_score"))


@query(f"""WITH {_PAIRS} SELECT identity_key, any_value(devices) AS devices, max(CASE WHEN is_primary THEN device END) AS primary_device, any_value(span_days) AS span_days,
    round(any_value(change_rate), 6) AS change_rate, any_value(change_rate) > 3 OR any_value(devices) > 10 AS is_suspicious FROM bound GROUP BY 1""")
def device_history(t: Tables) -> DataFrame:
    return D.device_history(t.device_use()).withColumn("change_rate", F.round("change_rate", 6))


@query(f"WITH {DEVICE_USE}, c AS (SELECT device, count(DISTINCT identity_key) AS identities FROM du GROUP BY 1) SELECT *, identities >= 3 AS is_shared, CASE WHEN identities >= 10 THEN 1.0 WHEN identities >= 5 THEN 0.7 WHEN identities >= 3 THEN 0.4 ELSE 0.0 END::DOUBLE AS sharing_risk FROM c")
def device_sharing(t: Tables) -> DataFrame:
    return D.device_sharing(t.device_use())


@query(f"""WITH {DEVICE_USE}, c AS (SELECT identity_key, count(DISTINCT device) AS devices FROM du WHERE ts >= {EVENTS_AT} - INTERVAL 24 HOUR GROUP BY 1)
    SELECT *, CASE WHEN devices >= 5 THEN 'excessive_device_switching' WHEN devices >= 3 THEN 'high_device_switching' END AS anomaly, CASE WHEN devices >= 5 THEN 0.9 WHEN devices >= 3 THEN 0.5 ELSE 0.0 END::DOUBLE AS risk FROM c""")
def device_switching(t: Tables) -> DataFrame:
    return D.device_switching(t.device_use(), EVENTS())


# User agents of the made devices, by event id modulo 8.
AGENTS = (
    "Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 Chrome/120.0 Safari/537.36", "Mozilla/5.0 (Linux; Android 14; Pixel) Chrome/120.0 Mobile Safari/537.36",
    "Mozilla/5.0 (iPad; CPU OS 17_0 like Mac OS X) Safari/604.1", "Mozilla/5.0 (Macintosh; Intel Mac OS X 14_0) Safari/605.1", "Mozilla/5.0 (X11; Linux x86_64) Firefox/121.0",
    "Dalvik (Linux; Android SDK built for x86)", "Googlebot/2.1 (compatible)", "Mozilla/5.0 (Windows NT 10.0) Chrome/120.0 Edg/120.0",
)


def _devices(t: Tables) -> DataFrame:
    agent = F.get(F.array(*[F.lit(a) for a in AGENTS]), (F.col("event_id") % 8).cast("int"))
    e = t.read("events").select("event_id", "user_id", "ts", agent.alias("agent"), F.when(F.col("event_id") % 3 > 0, F.concat((F.col("event_id") % 5 * 100).cast("string"), F.lit("x800"))).alias("resolution"))
    fp = I.fingerprint_id(F.col("agent"), F.col("resolution"), F.lit("UTC"), F.lit(None).cast("string"), F.lit("gl"))
    kind = I.device_type(F.col("agent"))
    return e.withColumns({"fingerprint_id": fp, "device_type": kind, "os": I.device_os(F.col("agent")), "browser": I.device_browser(F.col("agent")), "is_emulator": I.is_emulator(F.col("agent")), "is_incognito": F.col("event_id") % 7 == 0})


_DEVICES = f"""raw AS (SELECT event_id, user_id, ts, [{", ".join(f"'{a}'" for a in AGENTS)}][event_id % 8 + 1] AS agent, CASE WHEN event_id % 3 > 0 THEN (event_id % 5 * 100) || 'x800' END AS resolution FROM events),
    dev AS (SELECT *, substr(sha256(agent || '|' || coalesce(resolution, '') || '|UTC||gl'), 1, 32) AS fingerprint_id,
      CASE WHEN contains(lower(agent), 'mobile') THEN 'mobile' WHEN contains(lower(agent), 'tablet') OR contains(lower(agent), 'ipad') THEN 'tablet' WHEN contains(lower(agent), 'bot') OR contains(lower(agent), 'crawler') OR contains(lower(agent), 'spider') THEN 'bot' ELSE 'desktop' END AS device_type,
      CASE WHEN contains(lower(agent), 'android') THEN 'Android' WHEN regexp_matches(lower(agent), 'iphone|ipad|ios') THEN 'iOS' WHEN contains(lower(agent), 'windows') THEN 'Windows' WHEN regexp_matches(lower(agent), 'mac os|macos') THEN 'macOS' WHEN contains(lower(agent), 'linux') THEN 'Linux' ELSE 'Unknown' END AS os,
      CASE WHEN contains(lower(agent), 'chrome') AND NOT contains(lower(agent), 'edg') THEN 'Chrome' WHEN contains(lower(agent), 'firefox') THEN 'Firefox' WHEN contains(lower(agent), 'safari') AND NOT contains(lower(agent), 'chrome') THEN 'Safari' WHEN contains(lower(agent), 'edg') THEN 'Edge' ELSE 'Unknown' END AS browser,
      regexp_matches(lower(agent), 'android sdk|emulator|simulator|genymotion|bluestacks') AS is_emulator, event_id % 7 = 0 AS is_incognito FROM raw)"""


@query(f"WITH {_DEVICES} SELECT event_id, fingerprint_id, device_type, os, browser, is_emulator, is_incognito FROM dev")
def device_parse(t: Tables) -> DataFrame:
    return _devices(t).select("event_id", "fingerprint_id", "device_type", "os", "browser", "is_emulator", "is_incognito")


@query(f"WITH {_DEVICES} SELECT fingerprint_id, arg_max(event_id, (ts, event_id)) AS event_id, max(ts) AS last_seen, min(ts) AS first_seen FROM dev GROUP BY 1")
def fingerprint_latest(t: Tables) -> DataFrame:
    return _devices(t).groupBy("fingerprint_id").agg(F.max(F.struct("ts", "event_id"))["event_id"].alias("event_id"), F.max("ts").alias("last_seen"), F.min("ts").alias("first_seen"))


def _device_risk(t: Tables) -> DataFrame:
    d = _devices(t)
    fraud = d.where("event_id % 97 = 0").select("fingerprint_id").distinct().withColumn("on_list", F.lit(True))
    each = d.groupBy("fingerprint_id").agg(F.count_distinct("user_id").alias("identities"), F.max("device_type").alias("device_type"), F.max("is_emulator").alias("is_emulator"), F.max("is_incognito").alias("is_incognito"))
    found = each.join(fraud, "fingerprint_id", "left").withColumn("on_list", F.coalesce("on_list", F.lit(False)))
    raw = I.device_risk_raw(F.col("device_type"), F.col("is_emulator"), F.col("is_incognito"), F.lit(False), F.col("identities"))
    factors = I.device_factors(F.col("on_list"), F.col("device_type"), F.col("is_emulator"), F.col("is_incognito"), F.lit(False), F.col("identities"))
    return found.withColumn("raw", F.when(F.col("on_list"), 1.0 + raw).otherwise(raw)).withColumn("factors", factors)


_RISK = f"""{_DEVICES}, fraud AS (SELECT DISTINCT fingerprint_id FROM dev WHERE event_id % 97 = 0),
    each AS (SELECT fingerprint_id, count(DISTINCT user_id) AS identities, max(device_type) AS device_type, max(is_emulator) AS em, max(is_incognito) AS inc FROM dev GROUP BY 1),
    risk AS (SELECT e.*, f.fingerprint_id IS NOT NULL AS on_list, CASE WHEN f.fingerprint_id IS NOT NULL THEN 1.0::DOUBLE ELSE 0 END + CASE WHEN em THEN 0.5::DOUBLE ELSE 0 END + CASE WHEN device_type = 'bot' THEN 0.8::DOUBLE ELSE 0 END
      + CASE WHEN inc THEN 0.1::DOUBLE ELSE 0 END + CASE WHEN identities > 3 THEN 0.3::DOUBLE ELSE 0 END AS raw FROM each e LEFT JOIN fraud f USING (fingerprint_id))"""


@query(f"""WITH {_RISK} SELECT fingerprint_id, identities, round({clip('raw')}, 6) AS risk_score, raw > 0.5 AS is_suspicious, array_to_string(list_sort(list_concat(
    {names_sql({"known_fraud_device": "on_list", "emulator_detected": "em", "bot_detected": "device_type = 'bot'", "incognito_mode": "inc"})}, CASE WHEN identities > 3 THEN ['multiple_identities_' || identities] ELSE [] END)), ',') AS risk_factors FROM risk""")
def device_risk(t: Tables) -> DataFrame:
    found = _device_risk(t)
    return found.select("fingerprint_id", "identities", F.round(F.least(F.lit(1.0), "raw"), 6).alias("risk_score"), (F.col("raw") > 0.5).alias("is_suspicious"), joined(F.col("factors")).alias("risk_factors"))


@query(f"WITH {_RISK} SELECT on_list, count(*) AS devices, sum(identities)::BIGINT AS identities FROM risk GROUP BY 1")
def fraud_device_mark(t: Tables) -> DataFrame:
    return _device_risk(t).groupBy("on_list").agg(F.count(F.lit(1)).alias("devices"), F.sum("identities").alias("identities"))


QUERIES, ORACLES = R.queries, R.oracles
