"""Domain tables and idioms of the DuckDB side: common table expressions that match ``sources.adapters``."""

from __future__ import annotations

ORDERS_AT = "TIMESTAMP '2001-08-01 00:00:00'"
EVENTS_AT = "TIMESTAMP '2024-01-31 00:00:00'"

ELEMENT_USE = """eu AS (
    SELECT t.element_type, t.element_key::VARCHAR AS element_key, o_custkey AS identity_key, o_custkey % 997 AS ssn_key, o_orderdate AS ts, l_partkey AS address_key
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey,
      LATERAL (VALUES ('address', l_partkey), ('phone', l_partkey // 2), ('email', l_partkey * 4 + l_linenumber % 4), ('device', l_suppkey)) t(element_type, element_key))"""
DEVICE_USE = "du AS (SELECT user_id AS identity_key, (props::JSON->>'k')::BIGINT AS device, ts FROM events)"
APPLICATIONS = "ae AS (SELECT user_id AS ssn_key, (props::JSON->>'k')::BIGINT % 10 AS institution, ts FROM events WHERE event_type IN ('signup', 'purchase'))"
IDENTITIES = """people AS (
    SELECT c_custkey AS identity_key, lpad((c_custkey * 7919 % 1000)::VARCHAR, 3, '0') || '-' || lpad((c_custkey % 100)::VARCHAR, 2, '0') || '-' || lpad((c_custkey * 31 % 10000)::VARCHAR, 4, '0') AS ssn,
      (DATE '1940-01-01' + (c_custkey * 37 % 25000)::INT)::DATE AS dob, c_name AS first_name, c_mktsegment AS last_name, c_acctbal AS balance FROM customer)"""
TRADELINES = """lines AS (
    SELECT o_orderkey AS tradeline_id, o_custkey AS holder, o_orderdate AS opened, o_totalprice AS credit_limit, o_totalprice * 0.5::DOUBLE AS balance,
      CASE WHEN o_orderstatus = 'P' THEN 'late' ELSE 'current' END AS status, o_orderpriority = '1-URGENT' AS is_au, o_custkey + 1 AS primary_holder FROM orders)"""
AGE = f"date_sub('day', opened, {ORDERS_AT})"
FILES = f"""files AS (
    SELECT holder, count(*) AS num_tradelines, max({AGE}) // 30 AS file_age_months, count(*) FILTER (is_au) AS au_count, count(*) FILTER (is_au AND {AGE} < 180) AS au_recent,
      count(*) FILTER (is_au AND credit_limit > 10000) AS au_high_limit, count(*) FILTER (is_au AND {AGE} // 30 < 6) AS au_very_new,
      count(*) FILTER (status <> 'current' AND {AGE} < 365) AS recent_delinquency, count(*) FILTER ({AGE} < 180) AS new_accounts_6mo, count(*) FILTER ({AGE} < 90) AS inquiries_6mo,
      sum(credit_limit::DECIMAL(18,2))::DOUBLE AS total_limit, sum(balance::DECIMAL(18,4))::DOUBLE AS total_balance FROM lines GROUP BY holder)"""
WITH_CREDIT = f"""{IDENTITIES}, {TRADELINES}, {FILES}, pc AS (
    SELECT p.*, coalesce(num_tradelines, 0) AS num_tradelines, file_age_months, coalesce(au_count, 0) AS au_count, coalesce(au_recent, 0) AS au_recent, coalesce(au_high_limit, 0) AS au_high_limit,
      coalesce(au_very_new, 0) AS au_very_new, coalesce(recent_delinquency, 0) AS recent_delinquency, coalesce(new_accounts_6mo, 0) AS new_accounts_6mo, coalesce(inquiries_6mo, 0) AS inquiries_6mo,
      date_sub('day', dob::TIMESTAMP, {ORDERS_AT}) / 365.0::DOUBLE AS age_years, coalesce(num_tradelines < 3, true) AS is_thin_file, coalesce(total_balance / nullif(total_limit, 0), 0) AS utilization
    FROM people p LEFT JOIN files ON identity_key = holder)"""
SEQUENCES = """paid AS (SELECT l_orderkey, sum(round(l_extendedprice * l_discount, 4)::DECIMAL(18,4)) AS paid FROM lineitem GROUP BY 1),
    months AS (SELECT o_custkey AS account_id, o_orderdate AS at_, o_orderkey AS k, o_totalprice / 100 AS balance, coalesce(paid::DOUBLE, 0) / 100 AS payment,
      CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice / 100 ELSE 0 END AS cash, max(o_totalprice / 100) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS highest,
      row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS i, count(*) OVER (PARTITION BY o_custkey) AS n
      FROM orders LEFT JOIN paid ON o_orderkey = l_orderkey),
    steps AS (SELECT *, balance / highest AS util, coalesce(highest - lag(highest) OVER (PARTITION BY account_id ORDER BY i), 0) AS lim FROM months)"""
GRAPH_USE = """gu AS (SELECT DISTINCT o_custkey AS identity_id, ['ssn', 'address', 'phone', 'email', 'device'][l_partkey % 5 + 1] AS element_type, l_partkey * 1000 + l_quantity::BIGINT * 10 + l_linenumber AS element_key
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
PREDICTIONS = """preds AS (SELECT o_orderkey AS prediction_id, o_custkey AS account_id, 'm' || (o_orderkey % 3) AS model, (o_orderkey * 13 % 1000) / 1000.0::DOUBLE AS score,
    CASE WHEN o_orderstatus <> 'O' THEN o_orderstatus = 'F' END AS actual, o_orderdate AS ts FROM orders)"""


def clip(x: str) -> str:
    return f"least(1.0::DOUBLE, {x})"


def points(condition: str, value: float | str) -> str:
    return f"CASE WHEN {condition} THEN ({value})::DOUBLE ELSE 0::DOUBLE END"


def names_sql(rules: dict[str, str]) -> str:
    """A list of the names whose condition holds."""
    return "list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in rules.items()) + "], lambda x: x IS NOT NULL)"


def joined_sql(names: str) -> str:
    return f"array_to_string(list_sort(list_distinct({names})), ',')"
