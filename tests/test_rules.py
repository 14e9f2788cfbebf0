"""Truth tables of the rules, at, below and above each threshold."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from verigrain.functions import address as A
from verigrain.functions import identity as I
from verigrain.functions import scores as S
from verigrain.operators import credit as C
from verigrain.operators.resolution import jaro_winkler, jaro_winkler_text, register


def value(spark, column, **cells):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in cells.items()]) if cells else spark.range(1)
    return row.select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("ssn, want", [
    ("123-45-6789", "valid"), ("123456789", "valid"), ("000-45-6789", "invalid_area"), ("666-45-6789", "invalid_area"), ("900-45-6789", "itin"), ("123-00-6789", "invalid_group"),
    ("123-45-0000", "invalid_format"), ("12-345-6789", "invalid_format"), ("987-65-4320", "itin"), ("123 45 6789", "invalid_format"), (None, "invalid_format"),
])
def test_ssn(spark, ssn, want):
    assert value(spark, I.ssn_result(F.lit(ssn).cast("string"), F.lit(False))) == want


def test_ssn_on_the_death_list_and_issuance(spark):
    assert value(spark, I.ssn_result(F.lit("123-45-6789"), F.lit(True))) == "death_master"
    for birth, start, end, want, score in [(1990, 1950, 1980, "ssn_before_birth", 0.95), (1990, 1996, 2021, "ssn_too_recent", 0.42), (1990, 1995, 2020, None, 0.0), (1980, 1986, None, None, 0.0), (1990, None, None, None, 0.0)]:
        kind = I.issuance_mismatch(F.lit(birth), F.lit(start).cast("int"), F.lit(end).cast("int"))
        assert value(spark, kind) == want
        assert value(spark, F.round(I.issuance_score(kind, I.issuance_confidence(kind, F.lit(True))), 6)) == score
    assert [value(spark, I.randomisation_risk(F.lit(dt.date(2011, 6, d)))) for d in (24, 25)] == [0.3, 0.0]


@pytest.mark.parametrize("args, want", [((0.5, 0.0, 0.0, 0.0), 0.125), ((1.0, 1.0, 1.0, 1.0), 1.0)])
def test_overall_velocity(spark, args, want):
    assert value(spark, S.overall_velocity(*map(F.lit, args))) == pytest.approx(want)


@pytest.mark.parametrize("args, want", [((0.3, 0.3, 0.3, 0.3), []), ((0.4, 0.4, 0.0, 0.0), ["ADDRESS_PHONE_CORRELATION"]), ((0.0, 0.0, 0.0, 0.6), ["SHARED_DEVICE"])])
def test_velocity_anomalies(spark, args, want):
    assert value(spark, S.velocity_anomalies(*map(F.lit, args))) == want


@pytest.mark.parametrize("score, n, want", [(0.8, 0, "critical"), (0.79, 4, "critical"), (0.6, 0, "high"), (0.0, 3, "high"), (0.4, 0, "medium"), (0.0, 2, "medium"), (0.2, 0, "low"), (0.0, 1, "low"), (0.19, 0, "minimal")])
def test_velocity_level(spark, score, n, want):
    assert value(spark, S.velocity_level(F.lit(score), F.array_repeat(F.lit("x"), n))) == want


@pytest.mark.parametrize("n30, n180, ssn180, want", [(2, 5, 5, 0.5), (10, 20, 15, 1.0), (1, 1, 1, 0.0), (0, 0, 0, 0.0), (2, 3, 1, 0.216)])
def test_element_velocity(spark, n30, n180, ssn180, want):
    assert value(spark, F.round(S.velocity_score(F.lit(5), F.lit(n30), F.lit(n180), F.lit(ssn180)), 6)) == want


def _bags(**over):
    base = {
        "ssn_dob_mismatch": False, "death_master_match": False, "invalid_ssn": False, "itin_as_ssn": False, "multiple_ssns": False, "shared_ssn_count": 0, "cluster_density": 0.0, "cluster_size": 1,
        "neighbor_avg_synthetic_score": 0.0, "address_velocity_score": 0.0, "phone_velocity_score": 0.0, "email_velocity_score": 0.0, "is_thin_file": False, "file_age_mismatch": False,
        "rapid_credit_building": False, "au_abuse_pattern": False, "weak_binding": False, "shared_device_count": 0, "known_fraud_device": False, "emulator_detected": False,
    } | over
    return F.struct(*[(F.lit(v) if v is not None else F.lit(None).cast("boolean")).alias(k) for k, v in base.items()])


def _synthetic(spark, **over):
    b = _bags(**over)
    parts = [f(b) for f in (S.ssn_component, S.graph_component, S.velocity_component, S.credit_component, S.device_component)]
    score = S.synthetic_score(*parts)
    r = spark.range(1).select(F.round(score, 6).alias("s"), S.synthetic_level(score).alias("l"), S.triggered_signals(b, b, b, b, b).alias("t"), F.round(parts[1], 6).alias("g")).first()
    return r["s"], r["l"], r["t"], r["g"]


def test_synthetic_score(spark):
    assert _synthetic(spark, ssn_dob_mismatch=True)[:3] == (0.15, "minimal", ["SSN_DOB_MISMATCH"])
    assert _synthetic(spark, address_velocity_score=0.1)[:3] == (0.006, "minimal", [])
    assert _synthetic(spark, ssn_dob_mismatch=None)[0] == 0.0
    score, _, signals, graph = _synthetic(spark, cluster_size=12, cluster_density=0.8, neighbor_avg_synthetic_score=0.6)
    assert graph == 0.7 and signals == ["LARGE_CLUSTER"] and score == 0.21
    assert _synthetic(spark, shared_ssn_count=3)[3] == 0.6


def test_ensemble(spark):
    zero = F.lit(0.0)
    assert value(spark, F.round(S.ensemble_score(F.lit(0.9), zero, zero, zero, F.lit(None).cast("double")), 6)) == 0.4
    assert value(spark, F.round(S.ensemble_score(F.lit(0.9), zero, zero, zero, F.lit(0.5)), 6)) == 0.41
    for score, signals, want in [(0.1, ["SHARED_SSN"], "critical"), (0.85, ["x"], "critical"), (0.849, ["x"], "high"), (0.65, ["x"], "high"), (0.45, ["x"], "medium"), (0.25, ["x"], "low"), (0.2, ["x"], "minimal")]:
        assert value(spark, S.ensemble_level(F.lit(score), F.array(*map(F.lit, signals)))) == want


AGENTS = [
    ("Mozilla/5.0 (Windows NT 10.0) Chrome/120 Safari/537", "desktop", "Windows", "Chrome"), ("Mozilla/5.0 (Linux; Android 14) Chrome/120 Mobile", "mobile", "Android", "Chrome"),
    ("Mozilla/5.0 (iPad; CPU OS 17) Safari/604", "tablet", "iOS", "Safari"), ("Googlebot/2.1", "bot", "Unknown", "Unknown"),
]


@pytest.mark.parametrize("agent, kind, os, browser", AGENTS)
def test_user_agent(spark, agent, kind, os, browser):
    a = F.lit(agent)
    assert [value(spark, f(a)) for f in (I.device_type, I.device_os, I.device_browser)] == [kind, os, browser]


def test_device_rules(spark):
    assert value(spark, I.device_risk(F.lit(True), F.lit(0.0))) == 1.0 and value(spark, I.is_emulator(F.lit("Android SDK built for x86")))
    bound = lambda n, d, p, o: value(spark, F.round(I.binding_score(F.lit(n), F.lit(d), F.lit(p), F.lit(o)), 6))
    assert bound(5, 10, True, 0) - bound(5, 10, False, 0) == pytest.approx(0.2) and bound(10, 30, True, 1) == 0.9 and bound(10, 30, True, 6) == 0.8
    assert [value(spark, I.sharing_risk(F.lit(n))) for n in (2, 3, 5, 10)] == [0.0, 0.4, 0.7, 1.0]
    assert [value(spark, I.switching(F.lit(n))[0]) for n in (2, 3, 5)] == [None, "high_device_switching", "excessive_device_switching"]
    assert [round(value(spark, I.other_ssn_risk(F.lit(n))), 6) for n in (0, 1, 2, 3, 6)] == [0.0, 0.5, 0.7, 0.8, 1.0]


def test_addresses(spark):
    def hashed(street):
        s = F.lit(street)
        parts = [A.street_number(s), A.street_name(s), A.street_type(s), A.unit_type(s), A.unit_number(s), F.lit("AUSTIN"), F.lit("TX"), F.lit("73301")]
        return value(spark, A.address_hash(*parts))

    assert hashed("123 Main St") == hashed("123 Main Ave") != hashed("123 Main St.")
    s = F.lit("12 Oak Street APT 4")
    assert [value(spark, f(s)) for f in (A.street_number, A.street_name, A.street_type, A.unit_type, A.unit_number)] == ["12", "OAK", "ST", "APT", "4"]
    assert value(spark, A.street_type(F.lit("12 Oak Street"), keep_street_type=True)) == "ST"
    assert [value(spark, A.address_type(F.lit(x))) for x in ("PO Box 1", "1 A St #501", "1 A St #500", "UPS Store 9")] == ["po_box", "cmra", "residential", "cmra"]
    assert value(spark, A.dwelling_type(F.lit("9 Western Rd"))) == "commercial" and value(spark, A.state_code(F.lit(" new york "))) == "NY"


def test_phone_lines(spark):
    for raw, risk in (("800-555-0000", 0.8), ("1-900-555-0000", 0.9), ("555-0000", 0.5), ("212-555-0000", 0.0), (None, 0.5)):
        n = I.phone_digits(F.lit(raw).cast("string"))
        assert value(spark, I.line_risk(n, I.line_type(n))) == risk


def test_email(spark):
    kinds = {"a@gmail.com": "major", "a@yopmail.com": "disposable", "a@zoho.com": "free_uncommon", "a@mit.edu": "edu", "a@irs.gov": "gov", "a@b.c": "custom", "nope": "unknown"}
    assert {k: value(spark, I.email_domain_type(I.email_domain(F.lit(k)))) for k in kinds} == kinds
    pattern = lambda e, f, l: value(spark, I.email_pattern(I.email_local(F.lit(e)), I.holds_name(I.email_local(F.lit(e)), F.lit(f), F.lit(l))))
    assert pattern("ann.lee@x.com", "Ann", "Lee") == "name_based" and pattern("ann7@x.com", "Ann", "Lee") == "name_with_numbers"
    assert pattern("zzkkttpp123@x.com", "Q", "W") == "random_generated" and pattern("user55@x.com", "Q", "W") == "synthetic_pattern"


def test_application_signal(spark):
    now = dt.datetime(2024, 1, 31)
    for recent, month, want in [(7, 0, "critical"), (4, 0, "high"), (0, 7, "medium"), (0, 10, "high"), (0, 6, None), (3, 0, None)]:
        rows = [(1, i, now - dt.timedelta(days=1, minutes=i)) for i in range(recent)] + [(1, i, now - dt.timedelta(days=20, minutes=i)) for i in range(month)]
        events = spark.createDataFrame(rows, "ssn_key long, institution long, ts timestamp_ntz")
        assert C.application_velocity(events, F.lit(now).cast("timestamp_ntz")).first()["severity"] == want
    twice = spark.createDataFrame([(1, 1, now), (1, 1, now)], "ssn_key long, institution long, ts timestamp_ntz")
    assert C.application_velocity(twice, F.lit(now).cast("timestamp_ntz")).first()["apps_7d"] == 1


def test_age_gap_signal(spark):
    for gap, want in ((61.0, "critical"), (60.0, "high"), (36.5, "high"), (36.0, "medium"), (12.0, None), (None, None)):
        people = spark.createDataFrame([(38.0, None if gap is None else 240.0 - gap)], "age_years double, file_age_months double")
        assert C.age_gap_signal(people).first()["severity"] == want


def test_sequences(spark):
    arr = lambda *x: F.array(*[F.lit(float(v)) for v in x]) if x else F.array().cast("array<double>")
    assert value(spark, S.slope(arr(1, 3, 5))) == 2.0 and value(spark, S.slope(arr(1, 3))) == 0.0
    f = S.sequence_features(arr(1, 2, 4), arr(10, 10, 10, 5, 5, 5), arr(0, 5, -2), arr(0.5, 0.6, 0.7), arr(0, 7, 0, 9))
    got = spark.range(1).select(*[c.alias(k) for k, c in f.items()]).first()
    assert got["recent_balance_change"] == 3.0 and got["payment_declining"] and got["limit_increases"] == 5.0 and got["recent_limit_change"] == -2.0
    assert got["cash_total"] == 16.0 and got["cash_frequency"] == 2 and got["recent_cash"] == 16.0 and got["min_payment_ratio"] == 0.5
    empty = S.sequence_features(arr(), arr(), arr(), arr(), arr())
    assert all(v in (0, 0.0, False) for v in spark.range(1).select(*[c.alias(k) for k, c in empty.items()]).first())
    assert value(spark, S.days_to_bust_out(F.lit(0.6), arr(0.1, 0.96, 0.97))) == 30 and value(spark, S.days_to_bust_out(F.lit(0.5), arr(0.1, 0.2, 0.3))) is None


def test_jaro_winkler(spark):
    for a, b, want in [("MARTHA", "MARHTA", 0.961111), ("DIXON", "DICKSONX", 0.813333), ("", "", 0.0), ("a", "", 0.0), ("same", "same", 1.0), ("abc", "xyz", 0.0)]:
        assert round(jaro_winkler_text(a, b), 6) == want
        assert round(value(spark, jaro_winkler(F.lit(a), F.lit(b))), 6) == want
    register(spark)
    assert spark.sql("SELECT round(jaro_winkler('MARTHA', 'MARHTA'), 6) v").first()["v"] == 0.961111
