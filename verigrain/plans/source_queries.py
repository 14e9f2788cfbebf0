"""Queries on sources, decoding, generators, models and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verigrain.operators import attention as A
from verigrain.operators import credit as C
from verigrain.operators import graph as G
from verigrain.operators import learning as L
from verigrain.plans.durable import durable, ensure_checkpoint_dir
from verigrain.plans.registry import Registry
from verigrain.plans.sql_tables import DEVICE_USE
from verigrain.sources import generators as N
from verigrain.sources import readers
from verigrain.sources.adapters import Tables, as_of
from verigrain.sources.store import KeyedStore

R = Registry()
query = R.query


def application_lines(t: Tables) -> DataFrame:
    """JSON lines made from orders; some lack a required field and some are cut short."""
    k = F.col("o_orderkey")
    made = F.to_json(F.struct(
        k.cast("string").alias("application_id"), F.sha2(F.col("o_custkey").cast("string"), 256).alias("ssn_hash"), F.when(k % 10 != 0, F.lit("1980-01-02")).alias("dob"), F.lit("Ann").alias("first_name"), F.lit("Lee").alias("last_name"),
        F.struct(F.lit("1 Main St").alias("street"), F.lit("Austin").alias("city"), F.lit("TX").alias("state"), F.lit("73301").alias("zip")).alias("address"), F.lit("5551234567").alias("phone"), F.lit("a@x.com").alias("email"),
        F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("application_date"), F.when(k % 3 == 0, F.lit("auto_loan")).alias("application_type"), F.col("o_totalprice").alias("requested_amount"),
    ))
    return t.read("orders").select(F.when(k % 25 == 1, F.substring(made, 1, 40)).otherwise(made).alias("value"))


_STATUS = "CASE WHEN o_orderkey % 25 = 1 THEN 'malformed' WHEN o_orderkey % 10 = 0 THEN 'missing dob' END"


@query("SELECT o_orderkey::VARCHAR AS application_id, sha256(o_custkey::VARCHAR) AS ssn_hash, 'Austin' AS city, o_orderdate AS application_date, CASE WHEN o_orderkey % 3 = 0 THEN 'auto_loan' ELSE 'credit_card' END AS application_type, o_totalprice AS requested_amount FROM orders WHERE o_orderkey % 25 <> 1 AND o_orderkey % 10 <> 0")
def application_decode(t: Tables) -> DataFrame:
    good, _ = readers.applications(application_lines(t))
    return good.select("application_id", "ssn_hash", "city", "application_date", "application_type", "requested_amount")


@query(f"SELECT {_STATUS} AS reason, count(*) AS records FROM orders WHERE {_STATUS} IS NOT NULL GROUP BY 1")
def stream_decode_deadletter(t: Tables) -> DataFrame:
    _, bad = readers.applications(application_lines(t))
    return bad.groupBy("reason").agg(F.count(F.lit(1)).alias("records"))


@query("SELECT CASE event_type WHEN 'click' THEN 'synthetic_identity' WHEN 'view' THEN 'bust_out' WHEN 'purchase' THEN 'fraud_ring' WHEN 'signup' THEN 'identity_theft' END AS alert_type, count(*) AS alerts, round(avg(event_id % 100 / 100.0::DOUBLE), 6) AS mean_confidence FROM events WHERE event_type <> 'error' GROUP BY 1")
def alert_dispatch(t: Tables) -> DataFrame:
    e = F.col("event_id")
    kinds = F.create_map(*[F.lit(x) for kv in {"click": "synthetic_identity", "view": "bust_out", "purchase": "fraud_ring", "signup": "identity_theft", "error": "odd"}.items() for x in kv])
    lines = t.read("events").select(F.to_json(F.struct(
        e.cast("string").alias("alert_id"), F.try_element_at(kinds, F.col("event_type")).alias("alert_type"), F.lit("h").alias("identity_hash"), F.lit("bank").alias("reported_by"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("reported_date"), (e % 100 / 100.0).alias("confidence_score"),
    )).alias("value"))
    good, _ = readers.alerts(lines)
    return good.groupBy("alert_type").agg(F.count(F.lit(1)).alias("alerts"), F.round(F.avg("confidence_score"), 6).alias("mean_confidence"))


def _u(seed: int, *parts: str) -> str:
    """``generators.draw`` in SQL."""
    return f"(('0x' || substr(md5(concat_ws('|', {', '.join(parts)}, '{seed}')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE)"


def _whole(u: str, low: int, high: int) -> str:
    return f"({low} + floor({u} * {high - low + 1}))::INT"


_ID = {k: _u(1, "id::VARCHAR", f"'{k}'") for k in ("kind", "ssn", "name", "dob", "lines", "age", "au")}
_SSN = f"sha256(concat_ws('-', {_whole(_ID['ssn'], 1, 899)}::VARCHAR, floor({_ID['ssn']} * 7919 * 99)::BIGINT::VARCHAR, floor({_ID['ssn']} * 104729 * 9999)::BIGINT::VARCHAR))"
_MADE = lambda k, fake, own: f"CASE WHEN {_ID['kind']} < 0.1::DOUBLE THEN {_whole(_ID[k], *fake)} ELSE {_whole(_ID[k], *own)} END"
_FILE = {k: _u(4, "ssn_hash", f"'{k}'") for k in ("thin", "limit", "lines", "au", "use")}
_LINE = {k: _u(5, "ssn_hash", "i::VARCHAR", f"'{k}'") for k in ("limit", "use", "late", "kind", "age")}


@query(f"""SELECT 'id_' || lpad(id::VARCHAR, 10, '0') AS identity_id, {_SSN} AS ssn_hash, 'First' || {_whole(_ID['name'], 1, 500)} AS first_name, 'Last' || {_whole(_ID['dob'], 1, 2000)} AS last_name,
    (DATE '1950-01-01' + {_whole(_ID['dob'], 0, 19000)})::DATE AS dob, {', '.join(f"sha256('{k}|' || id || '|1') AS {k}_hash" for k in ('address', 'phone', 'email'))}, {_ID['kind']} < 0.1::DOUBLE AS is_synthetic,
    {_MADE('lines', (0, 4), (2, 20))} AS num_tradelines, {_MADE('age', (1, 24), (12, 300))} AS file_age_months, {_MADE('au', (1, 6), (0, 1))} AS au_accounts FROM (SELECT c_custkey AS id FROM customer)""")
def identity_generate(t: Tables) -> DataFrame:
    """A made identity beside each customer."""
    return N.identities(t.read("customer").select(F.col("c_custkey").alias("id")))


@query(f"""WITH m AS (SELECT ring, unnest(range(1, {_whole(_u(2, 'ring::VARCHAR'), 3, 8)} + 1)) AS k FROM (SELECT s_suppkey AS ring FROM supplier))
    SELECT 'ring_' || ring || '_' || k AS identity_id, ring, {', '.join(f"sha256('{x}' || CASE WHEN {_u(2, 'ring::VARCHAR', 'k::VARCHAR', f"'{x}'")} < {share}::DOUBLE THEN 'ring' || ring ELSE 'own_' || ring || '_' || k END) AS {x}_hash" for x, share in (('address', 0.7), ('phone', 0.5)))}, true AS is_synthetic FROM m""")
def ring_generate(t: Tables) -> DataFrame:
    """A made fraud ring around each supplier."""
    return N.fraud_rings(t.read("supplier").select(F.col("s_suppkey").alias("id")))


@query(f"""WITH people AS (SELECT DISTINCT {_SSN} AS ssn_hash FROM (SELECT c_custkey AS id FROM customer)),
    files AS (SELECT ssn_hash, {_FILE['thin']} < 0.15::DOUBLE AS thin, CASE WHEN {_FILE['thin']} < 0.15::DOUBLE THEN {_whole(_FILE['lines'], 0, 2)} ELSE {_whole(_FILE['lines'], 3, 25)} END AS n FROM people),
    held AS (SELECT ssn_hash, least(n, CASE WHEN thin THEN {_whole(_FILE['au'], 1, 5)} ELSE {_whole(_FILE['au'], 0, 1)} END) AS au, unnest(range(0, n)) AS i FROM files),
    d AS (SELECT *, 500 + 20000 * {_LINE['limit']} AS credit_limit FROM held)
    SELECT 'TL-' || substr(ssn_hash, 1, 4) || '-' || lpad(i::VARCHAR, 3, '0') AS tradeline_id, ssn_hash, (['credit_card', 'auto_loan', 'mortgage', 'student_loan', 'personal_loan', 'retail_card'])[1 + {_whole(_LINE['kind'], 0, 5)}] AS account_type,
      {_whole(_LINE['age'], 1, 240)} AS age_months, credit_limit, credit_limit * {_LINE['use']} AS current_balance, CASE WHEN {_LINE['late']} < 0.05::DOUBLE THEN 'late' ELSE 'current' END AS payment_status, i < au AS is_authorized_user FROM d""")
def bureau_generate(t: Tables) -> DataFrame:
    """The lines of a made bureau file of each customer's identity."""
    return N.tradelines(N.credit_files(N.identities(t.read("customer").select(F.col("c_custkey").alias("id")))))


@query("SELECT c_custkey AS identity_key, coalesce(n, 0) AS shared_count, round(coalesce(m, 0), 6) AS mean_price FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, avg(o_totalprice) AS m FROM orders WHERE o_custkey % 3 > 0 GROUP BY 1) ON o_custkey = c_custkey")
def training_join(t: Tables) -> DataFrame:
    extra = t.read("orders").where("o_custkey % 3 > 0").groupBy(F.col("o_custkey").alias("identity_key")).agg(F.count(F.lit(1)).alias("shared_count"), F.avg("o_totalprice").alias("mean_price"))
    return t.read("customer").select(F.col("c_custkey").alias("identity_key")).join(extra, "identity_key", "left").fillna(0).withColumn("mean_price", F.round("mean_price", 6))


def labelled_identities(t: Tables) -> DataFrame:
    """Every customer with what links and earlier tradelines say, and whether the newest tradeline has the highest balance
    so far (null with less than two tradelines)."""
    latest = F.max_by(F.struct("balance", "is_au", "opened"), F.struct("opened", "tradeline_id"))
    held = t.tradelines().groupBy(F.col("holder").alias("identity_id")).agg(
        latest.alias("newest"), F.max("balance").alias("highest"), F.count(F.lit(1)).alias("held"), F.count_if("is_au").alias("au"), F.min("opened").alias("oldest")
    )
    earlier = held.select(
        "identity_id", F.when(F.col("held") > 1, F.col("newest.balance") >= F.col("highest")).alias("is_bust_out"), (F.col("held") - 1).alias("num_tradelines"),
        (F.col("au") - F.col("newest.is_au").cast("int")).alias("au_accounts"), F.months_between("newest.opened", "oldest").alias("file_age_months"),
    )
    uses = t.graph_use()
    labels = G.components(uses)
    sizes = labels.groupBy("component").agg(F.count(F.lit(1)).alias("cluster_size"))
    linked = G.degrees(G.identity_edges(uses)).select("identity_id", "degree", *[f"shared_{k}_count" for k in G.ALL_TYPES])
    out = t.read("customer").select(F.col("c_custkey").alias("identity_id"))
    for part in (earlier, linked, labels.join(sizes, "component").drop("component")):
        out = out.join(part, "identity_id", "left")
    return durable(out.withColumn("au_ratio", F.coalesce(F.try_divide("au_accounts", "num_tradelines"), F.lit(0.0))))


@query()
def gbt_train(t: Tables) -> DataFrame:
    """Test identities scored by trees that learn from the others whether the newest tradeline reaches a new highest balance."""
    train, test = L.split(labelled_identities(t).where("is_bust_out IS NOT NULL"), "identity_id", "is_bust_out")
    model = L.fit_scorer(train, "is_bust_out")
    return L.probabilities(model, test, L.SCORER_FEATURES, "is_bust_out").select("identity_id", "is_bust_out", "score")


def _sequences(t: Tables) -> DataFrame:
    """Features of all months of an account but the last, and whether that last month's balance was the highest so far."""
    arrays = ("balances", "payments", "limits", "utilization", "cash")
    known = t.credit_sequences().where("months_on_books > 1").withColumn("is_bust_out", F.element_at("utilization", -1) >= 1.0)
    before = known.withColumns({c: F.slice(c, 1, F.size(c) - 1) for c in arrays} | {"months_on_books": F.col("months_on_books") - 1})
    return durable(C.sequence_features(before))


@query()
def rf_train(t: Tables) -> DataFrame:
    """Test accounts scored by a forest that learns from the others whether the next month reaches a new highest balance."""
    train, test = L.split(_sequences(t), "account_id", "is_bust_out")
    model = L.fit_bust_out(train)
    return L.probabilities(model, test, L.SEQUENCE_FEATURES, "is_bust_out").select("account_id", "is_bust_out", "score")


@query()
def model_inference(t: Tables) -> DataFrame:
    """The forest of ``rf_train``, saved and loaded, applied to all months of every account."""
    ensure_checkpoint_dir(t.spark)
    path = f"{t.spark.sparkContext._jsc.sc().getCheckpointDir().get()}/forest-{uuid.uuid4().hex}"
    L.save_model(L.fit_bust_out(_sequences(t)), path)
    real = C.sequence_features(t.credit_sequences()).withColumn("is_bust_out", F.lit(False))
    return L.probabilities(L.load_model(path), real, L.SEQUENCE_FEATURES, "is_bust_out").select("account_id", "score")


#: Width, layers and rate of the attention network, which is trained until its loss has settled.
ATTENTION = {"hidden": 16, "layers": 2, "rate": 0.02}
ATTENTION_FEATURES = ("degree", *[f"shared_{k}_count" for k in G.ALL_TYPES], "cluster_size", "au_ratio", "file_age_months", "num_tradelines", "au_accounts")


@query()
def attention_scores(t: Tables) -> DataFrame:
    """Every identity's score of an attention network over the links, trained on identities outside ``held_out``."""
    rows = labelled_identities(t)
    known = {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in ATTENTION_FEATURES}
    scale = rows.agg(*[F.avg(v).alias(f"m_{c}") for c, v in known.items()], *[F.stddev_pop(v).alias(f"s_{c}") for c, v in known.items()]).first()
    features = F.array(*[(v - (scale[f"m_{c}"] or 0.0)) / (scale[f"s_{c}"] or 1.0) for c, v in known.items()])
    held_out = F.pmod(F.crc32(F.col("identity_id").cast("string")), F.lit(5)) == 0
    vertices = durable(rows.select("identity_id", features.alias("features"), held_out.alias("held_out"), F.col("is_bust_out").cast("int").alias("known")))
    shown = vertices.withColumn("label", F.when(~F.col("held_out"), F.col("known")))
    edges = durable(G.identity_edges(t.graph_use()).select("src", "dst", "weight"))
    start = A.initial_network(len(ATTENTION_FEATURES), ATTENTION["hidden"], ATTENTION["layers"])
    done = A.train(start, shown, edges, rate=ATTENTION["rate"])
    return A.scored(done.network, vertices, edges).join(vertices.select("identity_id", "held_out", F.col("known").alias("is_bust_out")), "identity_id")


@query(f"""WITH {DEVICE_USE}, l AS (SELECT device, identity_key, max(ts) AS t FROM du GROUP BY 1, 2), n AS (SELECT device, max(t) AS newest FROM l GROUP BY 1)
    SELECT 'device:' || device AS element, {', '.join(f"count(*) FILTER (t >= newest - INTERVAL {d} DAY) AS identities_{d}d" for d in (30, 90, 180))}, newest AS last_seen FROM l JOIN n USING (device) GROUP BY device, newest""")
def stream_velocity(t: Tables) -> DataFrame:
    """Device re-use from a stream of events, state after all of them; the table it leaves is in the shared folder."""
    from verigrain.streaming import applications as A

    spark = t.spark
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/stream-{uuid.uuid4().hex}"
    events = spark.readStream.schema(t.read("events").schema).parquet(f"{t.dir}/events.parquet*")
    uses = events.select(F.lit("device").alias("element_type"), F.get_json_object("props", "$.k").alias("element_key"), F.col("user_id").alias("identity_key"), "ts")
    A.run_once(A.trailing_velocity(uses), f"{folder}/state", lambda b, e: b.write.mode("append").parquet(f"{folder}/out"), "update")
    done = spark.read.parquet(f"{folder}/out")
    return done.groupBy("element").agg(F.max_by(F.struct("identities_30d", "identities_90d", "identities_180d"), "last_seen").alias("s"), F.max("last_seen").alias("last_seen")).select("element", "s.*", "last_seen")


@query(f"""WITH {DEVICE_USE}, w AS (SELECT device, identity_key, date_trunc('day', ts) - to_days(k::INT) AS start FROM du, range(7) r(k)),
    last AS (SELECT max(ts) - INTERVAL 1 DAY AS mark FROM du)
    SELECT start AS window_start, device::VARCHAR AS element_key, count(DISTINCT identity_key) AS identities FROM w, last
    WHERE start + INTERVAL 7 DAY <= mark AND device IS NOT NULL GROUP BY 1, 2""")
def stream_windows(t: Tables) -> DataFrame:
    """Exact distinct identities of each device in weeks that slide by days, from a stream: the weeks that are closed."""
    from verigrain.streaming import applications as A

    spark = t.spark
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/stream-{uuid.uuid4().hex}"
    events = spark.readStream.schema(t.read("events").schema).parquet(f"{t.dir}/events.parquet*")
    uses = events.select(F.lit("device").alias("element_type"), F.get_json_object("props", "$.k").alias("element_key"), F.col("user_id").alias("identity_key"), F.col("ts").cast("timestamp").alias("ts"))
    counts = A.exact_windows(uses.where("element_key IS NOT NULL"), "7 days", "1 day")
    A.run_once(counts, f"{folder}/state", lambda b, e: b.write.mode("overwrite").parquet(f"{folder}/out/batch={e}"))
    done = spark.read.parquet(f"{folder}/out")
    return done.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "element_key", "identities")


#: The ends of the batches of ``fingerprint_store``; a device that is not used for ``IDLE_DAYS`` before one is forgotten.
BATCH_ENDS, IDLE_DAYS = ("2024-01-11 00:00:00", "2024-01-18 00:00:00", "2024-01-31 00:00:00"), 5


def _store_sql() -> str:
    steps, before = [], "SELECT NULL::BIGINT AS device, NULL::TIMESTAMP AS first_seen, NULL::TIMESTAMP AS last_seen, NULL::BIGINT AS identity_key WHERE false"
    for k, (start, end) in enumerate(zip(("1900-01-01 00:00:00", *BATCH_ENDS), BATCH_ENDS, strict=False)):
        new = f"SELECT device, ts AS first_seen, ts AS last_seen, identity_key FROM du WHERE ts >= TIMESTAMP '{start}' AND ts < TIMESTAMP '{end}' AND device IS NOT NULL"
        steps.append(f"""s{k} AS (SELECT device, min(first_seen) AS first_seen, max(last_seen) AS last_seen, arg_max(identity_key, (last_seen, identity_key)) AS identity_key
            FROM ({before} UNION ALL {new}) GROUP BY device HAVING max(last_seen) >= TIMESTAMP '{end}' - INTERVAL {IDLE_DAYS} DAY)""")
        before = f"SELECT * FROM s{k}"
    return f"WITH {DEVICE_USE}, {', '.join(steps)} {before}"


@query(_store_sql())
def fingerprint_store(t: Tables) -> DataFrame:
    """Devices after three batches, each merged twice, as after a failure: first and last use and the last identity."""
    spark = t.spark
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/store-{uuid.uuid4().hex}"
    store = KeyedStore(spark, folder, "device", ("identity_key",), 16)
    uses = t.device_use()
    for start, end in zip(("1900-01-01 00:00:00", *BATCH_ENDS), BATCH_ENDS, strict=False):
        batch = uses.where((F.col("ts") >= as_of(start)) & (F.col("ts") < as_of(end)))
        for _ in range(2):
            store.merge(batch, "ts", as_of(end), IDLE_DAYS)
    return store.rows()


QUERIES, ORACLES = R.queries, R.oracles
