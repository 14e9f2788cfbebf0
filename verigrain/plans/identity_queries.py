"""Queries on identity elements: national ids, hashes, addresses, e-mail, phone."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verigrain.functions import address as A
from verigrain.functions import identity as I
from verigrain.functions.basics import elapsed_days
from verigrain.plans.durable import ensure_checkpoint_dir
from verigrain.plans.registry import Registry
from verigrain.plans.sql_tables import IDENTITIES, ORDERS_AT, clip, points
from verigrain.sources.adapters import ORDERS_AS_OF, Tables, as_of
from verigrain.sources.readers import read_area_map

R = Registry()
query = R.query

# --- national ids -----------------------------------------------------------------------------------------------------

_DEATH = "identity_key % 101 = 0"
_RESULT = f"""CASE WHEN NOT regexp_matches(ssn, '^[0-9]{{3}}-?[0-9]{{2}}-?[0-9]{{4}}$') THEN 'invalid_format' WHEN substr(ssn, 1, 3) >= '900' THEN 'itin' WHEN substr(ssn, 1, 3) IN ('000', '666') THEN 'invalid_area'
    WHEN substr(ssn, 5, 2) = '00' THEN 'invalid_group' WHEN substr(ssn, 8, 4) = '0000' THEN 'invalid_format' WHEN {_DEATH} THEN 'death_master' ELSE 'valid' END"""
_AREAS = "areas AS (SELECT a AS area, CASE WHEN a % 7 <> 0 THEN 1936 + a % 60 END AS year_start, CASE WHEN a % 7 <> 0 THEN 1936 + a % 60 + 25 END AS year_end FROM range(1, 900) r(a))"


@query(f"WITH {IDENTITIES} SELECT identity_key, ssn, {_RESULT} AS result, {_RESULT} = 'valid' AS is_valid, substr(ssn, 1, 3) AS area FROM people")
def ssn_validate(t: Tables) -> DataFrame:
    people = t.identities()
    dead = people.where("identity_key % 101 = 0").select("identity_key", F.lit(True).alias("on_list"))
    found = people.join(dead, "identity_key", "left").withColumn("result", I.ssn_result(F.col("ssn"), F.col("on_list")))
    return found.select("identity_key", "ssn", "result", (F.col("result") == "valid").alias("is_valid"), I.ssn_part(F.col("ssn"), 1).alias("area"))


@query(f"""WITH {IDENTITIES}, {_AREAS}, m AS (SELECT identity_key, a.area, CASE WHEN year_end IS NOT NULL AND year(dob) > year_end THEN 'ssn_before_birth' WHEN year_start IS NOT NULL AND year(dob) >= 1987 AND year_start > year(dob) + 5 THEN 'ssn_too_recent' END AS mismatch
      FROM people LEFT JOIN areas a ON a.area = substr(ssn, 1, 3)::BIGINT),
    c AS (SELECT *, CASE WHEN area IS NULL THEN 0.0 WHEN mismatch = 'ssn_before_birth' THEN 0.95 WHEN mismatch = 'ssn_too_recent' THEN 0.7 ELSE 0.8 END::DOUBLE AS confidence FROM m)
    SELECT identity_key, mismatch, confidence, CASE WHEN mismatch IS NULL THEN 0 ELSE round(CASE WHEN mismatch = 'ssn_before_birth' THEN 1.0 ELSE 0.6 END::DOUBLE * confidence, 6) END AS mismatch_score FROM c""")
def ssn_issuance(t: Tables) -> DataFrame:
    from verigrain.operators.credit import ssn_dob_signal

    found = ssn_dob_signal(t.identities(), t.area_map())
    return found.select("identity_key", "mismatch", "confidence", F.round("mismatch_score", 6).alias("mismatch_score"))


@query(f"WITH {IDENTITIES} SELECT identity_key, dob, CASE WHEN dob < DATE '2011-06-25' THEN 0.3 ELSE 0.0 END::DOUBLE AS risk, dob + INTERVAL 2 YEAR >= DATE '2011-06-25' AS randomised_era FROM people")
def ssn_randomization(t: Tables) -> DataFrame:
    p = t.identities()
    return p.select("identity_key", "dob", I.randomisation_risk(F.col("dob")).alias("risk"), I.randomised_era(F.add_months("dob", 24)).alias("randomised_era"))


_HIGHEST = "hg AS (SELECT DISTINCT split_part(ssn, '-', 1)::INT AS area, (split_part(ssn, '-', 1)::INT * 7) % 99 + 1 AS highest FROM people WHERE split_part(ssn, '-', 1)::INT % 3 <> 0)"
_ISSUED = "CASE WHEN identity_key % 5 <> 0 THEN (dob + INTERVAL 2 YEAR)::DATE END"


@query(f"""WITH {IDENTITIES}, {_HIGHEST}, p AS (SELECT identity_key, split_part(ssn, '-', 1)::INT AS area, split_part(ssn, '-', 2)::INT AS grp, dob, {_ISSUED} AS issued FROM people),
    v AS (SELECT p.*, highest, CASE WHEN issued < DATE '2011-06-25' AND highest IS NOT NULL THEN grp <= highest END AS valid FROM p LEFT JOIN hg USING (area))
    SELECT identity_key, issued >= DATE '2011-06-25' AS randomised_era, valid AS high_group_valid,
      CASE WHEN NOT valid THEN 0.8 WHEN dob < DATE '2011-06-25' THEN 0.3 ELSE 0.0 END::DOUBLE AS risk,
      CASE WHEN valid IS NOT NULL THEN 'group ' || grp || CASE WHEN valid THEN ' within ' ELSE ' above ' END || 'highest group ' || highest || ' of area ' || area
        WHEN issued >= DATE '2011-06-25' THEN 'issued after randomisation' ELSE 'not on the list or not dated' END AS note FROM v""")
def high_group(t: Tables) -> DataFrame:
    """Groups of numbers against the highest group of their area; the list has two areas in three, four dates in five."""
    p = t.identities().withColumns({"area": F.split_part("ssn", F.lit("-"), F.lit(1)).cast("int"), "grp": F.split_part("ssn", F.lit("-"), F.lit(2)).cast("int")})
    issued = p.withColumn("issued", F.when(F.col("identity_key") % 5 != 0, F.add_months("dob", 24)))
    known = p.where("area % 3 <> 0").select("area", (F.col("area") * 7 % 99 + 1).alias("highest")).distinct()
    found = issued.join(known, "area", "left")
    valid = I.high_group_valid(F.col("grp"), F.col("highest"), F.col("issued"))
    return found.select(
        "identity_key", I.randomised_era(F.col("issued")).alias("randomised_era"), valid.alias("high_group_valid"), I.randomisation_risk(F.col("dob"), valid).alias("risk"),
        I.randomisation_note(F.col("grp"), F.col("area"), F.col("highest"), F.col("issued")).alias("note"),
    )


# --- hashes -------------------------------------------------------------------------------------------------------------

_SSN9 = "replace(ssn, '-', '')"
_ID = f"substr(sha256(lower(trim({_SSN9} || '|' || first_name || '|' || last_name))), 1, 16)"


@query(f"""WITH {IDENTITIES} SELECT identity_key, sha256(lower(trim(ssn))) AS ssn_hash, sha256(lower(trim(replace(lower(first_name), ' ', '') || '|' || replace(lower(last_name), ' ', '') || '|tx|' || (identity_key % 99999)))) AS address_hash,
    sha256(regexp_replace('+1 (555) ' || ssn, '[^0-9]', '', 'g')) AS phone_hash, {_ID} AS identity_id, 'APP-' || upper(substr(sha256(lower(trim({_ID} || dob::VARCHAR))), 1, 8)) AS application_id FROM people""")
def pii_hash(t: Tables) -> DataFrame:
    p = t.identities()
    ident = I.identity_id(F.col("ssn"), F.col("first_name"), F.col("last_name"))
    return p.select(
        "identity_key", I.pii_hash(F.col("ssn")).alias("ssn_hash"),
        I.request_address_hash(F.col("first_name"), F.col("last_name"), F.lit("tx"), (F.col("identity_key") % 99999).cast("string")).alias("address_hash"),
        I.request_phone_hash(F.concat(F.lit("+1 (555) "), "ssn")).alias("phone_hash"), ident.alias("identity_id"),
        I.application_id(ident, F.col("dob").cast("string")).alias("application_id"),
    )


# --- addresses ------------------------------------------------------------------------------------------------------------

_ENDS = ["ST", "Avenue", "Main St APT 4", "Oak Rd #700", "PMB 12", "PO BOX 9", "Steele Suite 20", "Lane", "Motel Dr", "Western Blvd.", "Elm Court Unit 7", ""]
_STREETS = f"""streets AS (SELECT p_partkey AS address_id, p_partkey || ' ' || split_part(p_name, ' ', 1) || ' ' || {_ENDS!r}[p_size % 12 + 1] AS street,
    CASE WHEN p_partkey % 3 = 0 THEN 'St Louis' WHEN p_partkey % 3 = 1 THEN 'Mt Vernon' ELSE 'Ft Worth' END AS city, ['california', 'New York', 'tx', ' Ohio ', 'Puerto Rico'][p_partkey % 5 + 1] AS state,
    CASE WHEN p_partkey % 3 = 0 THEN lpad((p_partkey % 100000)::VARCHAR, 5, '0') WHEN p_partkey % 3 = 1 THEN lpad((p_partkey % 100000)::VARCHAR, 5, '0') || '-1234' ELSE '12' END AS zip FROM part)"""
_UNIT = r"\s+(APT|APARTMENT|UNIT|STE|SUITE|#)\s*([A-Z0-9-]+)$"
_TYPE_CASE = " ".join(rf"WHEN regexp_matches(words, '\b{w}\b\.?$') THEN '{s}'" for w, s in A.STREET_TYPES)
_NAME_CASE = " ".join(rf"WHEN regexp_matches(words, '\b{w}\b\.?$') THEN trim(regexp_replace(words, '\b{w}\b\.?$', ''))" for w, _ in A.STREET_TYPES)
_NORMAL = rf"""{_STREETS}, n1 AS (SELECT *, upper(trim(street)) AS s, regexp_extract(upper(trim(street)), '^([0-9]+[-0-9]*)\s+', 1) AS number, regexp_replace(upper(trim(street)), '^([0-9]+[-0-9]*)\s+', '') AS rest FROM streets),
    n2 AS (SELECT *, regexp_extract(rest, '{_UNIT}', 1) AS uword, regexp_extract(rest, '{_UNIT}', 2) AS unit_number, CASE WHEN regexp_matches(rest, '{_UNIT}') THEN regexp_replace(rest, '{_UNIT}', '') ELSE regexp_replace(rest, '\s+[A-Z0-9-]+\s*$', '') END AS words FROM n1),
    n3 AS (SELECT address_id, number, CASE uword WHEN 'APARTMENT' THEN 'APT' WHEN 'APT' THEN 'APT' WHEN '#' THEN 'APT' WHEN 'UNIT' THEN 'UNIT' WHEN 'SUITE' THEN 'STE' WHEN 'STE' THEN 'STE' ELSE '' END AS unit_type, unit_number,
      CASE {_TYPE_CASE} ELSE '' END AS street_type, CASE {_NAME_CASE} ELSE trim(words) END AS street_name,
      CASE city WHEN 'St Louis' THEN 'SAINT LOUIS' WHEN 'Mt Vernon' THEN 'MOUNT VERNON' ELSE 'FORT WORTH' END AS city, CASE trim(lower(state)) WHEN 'california' THEN 'CA' WHEN 'new york' THEN 'NY' WHEN 'ohio' THEN 'OH' ELSE upper(trim(state)) END AS state,
      CASE WHEN length(replace(zip, '-', '')) >= 5 THEN substr(replace(zip, '-', ''), 1, 5) ELSE zip END AS zip5, CASE WHEN length(replace(zip, '-', '')) >= 9 THEN substr(replace(zip, '-', ''), 6, 4) END AS zip4 FROM n2)"""
_PARTS = ", ".join(f"nullif({c}, '')" for c in ("number", "street_name", "street_type", "unit_type", "unit_number", "city", "state", "zip5"))


@query(f"WITH {_NORMAL} SELECT *, substr(sha256(upper(concat_ws('|', {_PARTS}))), 1, 16) AS address_hash FROM n3")
def address_normalize(t: Tables) -> DataFrame:
    s = F.col("street")
    found = t.streets().select(
        "address_id", A.street_number(s).alias("number"), A.unit_type(s).alias("unit_type"), A.unit_number(s).alias("unit_number"), A.street_type(s).alias("street_type"),
        A.street_name(s).alias("street_name"), A.city_name(F.col("city")).alias("city"), A.state_code(F.col("state")).alias("state"), A.zip5(F.col("zip")).alias("zip5"), A.zip4(F.col("zip")).alias("zip4"),
    )
    parts = [F.col(c) for c in ("number", "street_name", "street_type", "unit_type", "unit_number", "city", "state", "zip5")]
    return found.withColumn("address_hash", A.address_hash(*parts))


_CMRA = "regexp_matches(lower(street), 'ups store|mailboxes etc|postal connections|postnet|mail center|pack & ship|postal annex|pmb|private mail') OR coalesce(try_cast(regexp_extract(lower(street), '#\\s*([0-9]+)', 1) AS BIGINT) > 500, false)"
_PLACE = "regexp_matches(lower(street), 'homeless shelter|halfway house|motel|hotel|extended stay|correctional|detention')"
_PO = "regexp_matches(lower(street), 'po box|p\\.o\\. box')"
_PROB = "CASE WHEN po THEN 0.3::DOUBLE WHEN cmra THEN 0.2::DOUBLE ELSE 0.7::DOUBLE END"


@query(f"""WITH {_STREETS}, f AS (SELECT *, {_CMRA} AS cmra, {_PLACE} AS place, {_PO} AS po FROM streets)
    SELECT address_id, cmra AS is_cmra, place AS is_high_risk, CASE WHEN po THEN 'po_box' WHEN cmra THEN 'cmra' ELSE 'residential' END AS address_type, {_PROB} AS residential_probability,
      CASE WHEN regexp_matches(lower(street), 'apt|apartment|unit|#') THEN 'apartment' WHEN regexp_matches(lower(street), 'suite|ste|floor|fl ') THEN 'commercial' ELSE 'single_family' END AS dwelling_type,
      round({clip(f"{points('cmra', 0.5)} + {points('place', 0.4)} + {points('po', 0.3)} + 0.3::DOUBLE * (1.0::DOUBLE - {_PROB})")}, 6) AS risk FROM f""")
def residential_score(t: Tables) -> DataFrame:
    s = F.col("street")
    return t.streets().select(
        "address_id", A.is_cmra(s).alias("is_cmra"), A.is_high_risk_place(s).alias("is_high_risk"), A.address_type(s).alias("address_type"),
        A.residential_probability(s).alias("residential_probability"), A.dwelling_type(s).alias("dwelling_type"), F.round(A.residential_risk(s), 6).alias("risk"),
    )


# --- e-mail ---------------------------------------------------------------------------------------------------------------

_DOMAINS = ["@gmail.com", "@mailinator.com", "@gmx.com", "@mit.edu", "@irs.gov", "@acme.io", "", "@yahoo.com", "@yopmail.com", "@zoho.com", "@x@y.com", "@Outlook.COM"]
_EMAILS = f"""emails AS (SELECT p_partkey AS identity_id, split_part(p_name, ' ', 1) || CASE WHEN p_partkey % 5 = 0 THEN p_partkey::VARCHAR WHEN p_partkey % 5 = 1 THEN '.' || coalesce(nullif(split_part(p_name, ' ', 2), ''), 'z') || p_partkey
      WHEN p_partkey % 5 = 2 THEN '_ab_' || p_partkey WHEN p_partkey % 5 = 3 THEN '' ELSE 'xxqqrrttvvbbn' END || {_DOMAINS!r}[p_partkey % 12 + 1] AS email,
      split_part(p_name, ' ', 1) AS f, split_part(p_name, ' ', 2) AS l, CASE WHEN p_partkey % 3 > 0 THEN p_partkey % 500 END AS email_days FROM part),
    e2 AS (SELECT *, CASE WHEN contains(email, '@') THEN lower(split_part(email, '@', 2)) END AS domain, CASE WHEN contains(email, '@') THEN lower(split_part(email, '@', 1)) END AS loc FROM emails)"""
_KIND = f"CASE WHEN domain IS NULL THEN 'unknown' WHEN domain IN {I.MAJOR} THEN 'major' WHEN domain IN {I.DISPOSABLE} THEN 'disposable' WHEN domain IN {I.FREE} THEN 'free_uncommon' WHEN suffix(domain, '.edu') THEN 'edu' WHEN suffix(domain, '.gov') THEN 'gov' ELSE 'custom' END"


@query(f"""WITH {_EMAILS}, k AS (SELECT identity_id, domain, {_KIND} AS domain_type FROM e2) SELECT *, CASE domain_type WHEN 'unknown' THEN 0.0 WHEN 'disposable' THEN 0.1 WHEN 'gov' THEN 0.95 WHEN 'edu' THEN 0.9 WHEN 'major' THEN 0.8 WHEN 'free_uncommon' THEN 0.6 ELSE 0.7 END::DOUBLE AS reputation,
    CASE domain_type WHEN 'unknown' THEN 1.0 WHEN 'disposable' THEN 0.9 WHEN 'free_uncommon' THEN 0.4 WHEN 'major' THEN 0.2 WHEN 'gov' THEN 0.1 WHEN 'edu' THEN 0.15 ELSE 0.3 END::DOUBLE AS risk FROM k""")
def email_domain(t: Tables) -> DataFrame:
    found = t.emails().select("identity_id", I.email_domain(F.col("email")).alias("domain")).withColumn("domain_type", I.email_domain_type(F.col("domain")))
    return found.withColumn("reputation", I.domain_reputation(F.col("domain_type"))).withColumn("risk", I.domain_risk(F.col("domain_type")))


_BARE = "regexp_replace(loc, '[0-9._-]', '', 'g')"
_HOLDS = f"(contains({_BARE}, lower(f)[1:1]) OR (l <> '' AND contains({_BARE}, lower(l))))"
_RANDOM = "(" + " OR ".join(f"regexp_matches(loc, '{p}')" for p in I.RANDOM_LOCAL) + " OR (length(loc) > 12 AND length(regexp_replace(loc, '[^aeiou]', '', 'g'))::DOUBLE / length(loc) < 0.15))"
_SYNTH = "(" + " OR ".join(f"regexp_matches(loc, '{p}')" for p in I.SYNTHETIC_LOCAL) + ")"
_NUM = "regexp_matches(loc, '[0-9]')"


@query(f"""WITH {_EMAILS}, x AS (SELECT identity_id, loc, coalesce({_HOLDS}, false) AS named, {_RANDOM} AS rnd, {_SYNTH} AS syn, {_NUM} AS num, regexp_extract(loc, '([0-9]+)$', 1) AS suf FROM e2)
    SELECT identity_id, named AS matches_name, CASE WHEN loc IS NULL THEN 'invalid' WHEN rnd THEN 'random_generated' WHEN syn THEN 'synthetic_pattern' WHEN named AND NOT num THEN 'name_based' WHEN named AND num THEN 'name_with_numbers' WHEN num THEN 'numbered' ELSE 'standard' END AS pattern_type,
      CASE WHEN loc IS NULL THEN 1.0 ELSE round({clip(f"{points('rnd', 0.5)} + {points('syn', 0.4)} + {points('num', 0.1)} + {points('length(suf) >= 4', 0.2)} + {points('NOT named', 0.15)}")}, 6) END AS synthetic_score FROM x""")
def email_pattern(t: Tables) -> DataFrame:
    found = t.emails().withColumn("local", I.email_local(F.col("email")))
    found = found.withColumn("matches_name", F.coalesce(I.holds_name(F.col("local"), F.col("first_name"), F.col("last_name")), F.lit(False)))
    local, named = F.col("local"), F.col("matches_name")
    return found.select("identity_id", "matches_name", I.email_pattern(local, named).alias("pattern_type"), F.round(I.email_pattern_score(local, named), 6).alias("synthetic_score"))


@query(f"""WITH {_EMAILS}, a AS (SELECT e2.*, date_sub('day', (DATE '1940-01-01' + (identity_id * 37 % 25000)::INT)::TIMESTAMP, {ORDERS_AT}) / 365.0::DOUBLE AS age FROM e2),
    m AS (SELECT *, CASE WHEN age >= 25 AND email_days < 180 THEN 0.6 WHEN age >= 40 AND email_days < 365 THEN 0.7 ELSE 0.0 END::DOUBLE AS mismatch FROM a)
    SELECT identity_id, mismatch, least(1.0::DOUBLE, greatest(0.1::DOUBLE, mismatch, CASE WHEN email_days < 90 THEN 0.4 ELSE 0.0 END)) AS risk FROM m""")
def email_age(t: Tables) -> DataFrame:
    dob = F.date_add(F.lit("1940-01-01").cast("date"), (F.col("identity_id") * 37 % 25000).cast("int"))
    age = elapsed_days(as_of(ORDERS_AS_OF), dob.cast("timestamp_ntz")) / 365.0
    found = t.emails().withColumn("mismatch", I.email_age_mismatch(age, F.col("email_days")))
    return found.select("identity_id", "mismatch", I.email_age_risk(F.lit(0.1), F.col("mismatch"), F.col("email_days")).alias("risk"))


_LISTED = ("listed1.example", "acme.io", " Listed2.Example ")


@query(f"WITH {_EMAILS}, listed AS (SELECT unnest(list_concat({list(I.DISPOSABLE)!r}, ['listed1.example', 'acme.io', 'listed2.example'])) AS domain) SELECT domain, count(identity_id) AS emails FROM (SELECT DISTINCT domain FROM listed) LEFT JOIN e2 USING (domain) GROUP BY 1")
def domain_list(t: Tables) -> DataFrame:
    from verigrain.sources.readers import disposable_domains

    lines = t.spark.createDataFrame([(x,) for x in (*_LISTED, "", "  ")], "value string")
    emails = t.emails().select("identity_id", I.email_domain(F.col("email")).alias("domain"))
    return disposable_domains(lines).join(emails, "domain", "left").groupBy("domain").agg(F.count("identity_id").alias("emails"))


# --- phone ----------------------------------------------------------------------------------------------------------------

_PHONES = """phones AS (SELECT p_partkey AS phone_id, CASE WHEN p_partkey % 6 = 0 THEN '1-' ELSE '' END || ['800', '900', '212', '976', '844', '31'][p_partkey % 6 + 1] || '-555-' || lpad((p_partkey % 10000)::VARCHAR, 4, '0') AS phone, p_partkey % 4 = 0 AS voip, p_partkey % 5 = 0 AS ported,
    CASE WHEN p_partkey % 3 = 0 THEN 'c' END AS carrier, p_partkey % 8 = 0 AS burner, p_partkey % 12 = 0 AS virt, CASE WHEN p_partkey % 2 = 0 THEN p_partkey % 120 END AS age_days, CASE WHEN p_partkey % 16 = 4 THEN 'TextNow' ELSE 'other' END AS provider FROM part),
    p2 AS (SELECT *, regexp_replace(phone, '[^0-9]', '', 'g') AS d FROM phones), p3 AS (SELECT *, CASE WHEN length(d) = 11 AND d[1:1] = '1' THEN d[2:11] ELSE d END AS number FROM p2)"""


def _phones(t: Tables) -> DataFrame:
    p = F.col("p_partkey")
    prefix = F.get(F.array(*[F.lit(x) for x in ("800", "900", "212", "976", "844", "31")]), (p % 6).cast("int"))
    return t.read("part").select(
        p.alias("phone_id"), F.concat(F.when(p % 6 == 0, "1-").otherwise(""), prefix, F.lit("-555-"), F.lpad((p % 10000).cast("string"), 4, "0")).alias("phone"), (p % 4 == 0).alias("voip"), (p % 5 == 0).alias("ported"),
        F.when(p % 3 == 0, "c").alias("carrier"), (p % 8 == 0).alias("burner"), (p % 12 == 0).alias("virt"), F.when(p % 2 == 0, p % 120).alias("age_days"), F.when(p % 16 == 4, "TextNow").otherwise("other").alias("provider"),
    ).withColumn("number", I.phone_digits(F.col("phone")))


@query(f"""WITH {_PHONES}, k AS (SELECT *, length(number) = 10 AS valid, CASE WHEN length(number) <> 10 THEN 'unknown' WHEN number[1:3] IN {I.TOLL_FREE} THEN 'toll_free' WHEN number[1:3] IN {I.PREMIUM} THEN 'premium' ELSE 'unknown' END AS line_type FROM p3),
    b AS (SELECT *, CASE WHEN NOT valid THEN 0.5 WHEN line_type = 'toll_free' THEN 0.8 WHEN line_type = 'premium' THEN 0.9 ELSE 0.0 END::DOUBLE AS base FROM k)
    SELECT phone_id, number, valid AS is_valid, line_type, base AS base_risk, round({clip(f"CASE WHEN voip THEN greatest(base, 0.6::DOUBLE) ELSE base END + {points('ported', 0.1)} + {points('valid AND carrier IS NULL', 0.2)}")}, 6) AS risk FROM b""")
def carrier_lookup(t: Tables) -> DataFrame:
    n = F.col("number")
    found = _phones(t).withColumn("is_valid", I.phone_valid(n)).withColumn("line_type", I.line_type(n)).withColumn("base_risk", I.line_risk(n, F.col("line_type")))
    risk = I.carrier_risk(F.col("base_risk"), F.col("is_valid"), F.col("voip"), F.col("ported"), F.col("carrier"))
    return found.select("phone_id", "number", "is_valid", "line_type", "base_risk", F.round(risk, 6).alias("risk"))


@query(f"""WITH {_PHONES} SELECT phone_id, voip AND (burner OR coalesce(age_days < 30, false) OR lower(provider) IN {I.RISKY_VOIP}) AS high_risk,
    CASE WHEN voip THEN round({clip(f"0.4::DOUBLE + {points('burner', 0.4)} + {points('virt', 0.2)} + CASE WHEN age_days < 7 THEN 0.3::DOUBLE WHEN age_days < 30 THEN 0.2::DOUBLE WHEN age_days < 90 THEN 0.1::DOUBLE ELSE 0 END")}, 6) ELSE 0.1 END AS risk FROM phones""")
def voip_risk(t: Tables) -> DataFrame:
    c = [F.col(x) for x in ("voip", "burner", "virt", "age_days", "provider")]
    return _phones(t).select("phone_id", I.voip_high_risk(c[0], c[1], c[3], c[4]).alias("high_risk"), F.round(I.voip_risk(*c[:4]), 6).alias("risk"))


_TEXTS = "texts AS (SELECT 'documents' AS origin, doc_id AS id, text AS t FROM documents UNION ALL SELECT 'pages', page_id, html FROM pages)"
_MAIL, _TEL, _IP = "[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{2,}", "[(]?[0-9]{3}[)]?[-. ][0-9]{3}[-. ][0-9]{4}", "[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}"


@query(f"""WITH {_TEXTS} SELECT origin, id, len(regexp_extract_all(t, '{_MAIL}'))::INT AS emails, len(regexp_extract_all(t, '{_TEL}'))::INT AS phones, len(regexp_extract_all(t, '{_IP}'))::INT AS addresses,
    array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(t, '{_MAIL}'), lambda x: sha256(lower(x))))), ',') AS email_hashes FROM texts WHERE regexp_matches(t, '{_MAIL}') OR regexp_matches(t, '{_TEL}') OR regexp_matches(t, '{_IP}')""")
def pii_extract_text(t: Tables) -> DataFrame:
    docs = t.read("documents").select(F.lit("documents").alias("origin"), F.col("doc_id").alias("id"), F.col("text").alias("t"))
    texts = docs.union(t.read("pages").select(F.lit("pages"), "page_id", "html"))
    found = {k: F.regexp_extract_all("t", F.lit(p), F.lit(0)) for k, p in (("emails", _MAIL), ("phones", _TEL), ("addresses", _IP))}
    hashes = F.array_join(F.sort_array(F.array_distinct(F.transform(found["emails"], lambda x: I.pii_hash(x)))), ",")
    some = F.col("t").rlike(_MAIL) | F.col("t").rlike(_TEL) | F.col("t").rlike(_IP)
    return texts.where(some).select("origin", "id", *[F.size(c).alias(k) for k, c in found.items()], hashes.alias("email_hashes"))


@query("""SELECT 1 + o_custkey % 899 AS area_number, CASE WHEN min(o_custkey) % 7 <> 0 THEN year(min(o_orderdate)) END::INT AS year_start, CASE WHEN min(o_custkey) % 7 <> 0 THEN year(max(o_orderdate)) END::INT AS year_end,
    'S' || min(c_nationkey) AS state FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1""")
def area_map_load(t: Tables) -> DataFrame:
    """The area map read from text files, which hold the years in which an area's customers ordered, and lines that are none."""
    spark = t.spark
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/areas-{uuid.uuid4().hex}"
    orders, people = t.read("orders").select("o_custkey", "o_orderdate"), t.read("customer").select("c_custkey", "c_nationkey")
    first, last = F.year(F.min("o_orderdate")).alias("first"), F.year(F.max("o_orderdate")).alias("last")
    used = orders.join(people, F.col("c_custkey") == F.col("o_custkey")).groupBy((1 + F.col("o_custkey") % 899).alias("area")).agg(first, last, F.min("c_nationkey").alias("nation"), F.min("o_custkey").alias("customer"))
    known = F.col("customer") % 7 != 0
    year = lambda c: F.when(known, F.col(c).cast("string")).otherwise("")
    lines = used.select(F.concat_ws(",", F.col("area").cast("string"), year("first"), year("last"), F.concat(F.lit("S"), F.col("nation").cast("string"))).alias("value"))
    lines.union(used.select(F.concat(F.lit("# area "), F.col("area").cast("string")))).write.text(folder)
    return read_area_map(spark, folder)


QUERIES, ORACLES = R.queries, R.oracles
