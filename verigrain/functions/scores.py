"""Scoring rules: weighted sums, ladders and signal lists. Doubles are added in the order written."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from verigrain.config import CONFIG, EngineConfig
from verigrain.functions.basics import clip01, flag, ladder, lit0, names_where, or_zero, points, ratio

# --- velocity -----------------------------------------------------------------------------------------------------


def velocity_score(cap: Column, n30: Column, n180: Column, ssn180: Column) -> Column:
    r = n180 / cap
    base = F.when(r <= 1, 0.3 * r).otherwise(0.3 + 0.233 * F.least(r - 1, F.lit(3.0)))
    score = base + F.when(ssn180 > 1, F.least(F.lit(0.2), 0.05 * (ssn180 - 1))).otherwise(0.0)
    recent = ratio(n30, n180) > 0.5
    return F.when(n180 <= 1, 0.0).otherwise(clip01(F.when(recent, score * 1.2).otherwise(score)))


def phone_velocity_score(cap: Column, n30: Column, n180: Column, ssn180: Column, addresses180: Column) -> Column:
    r = n180 / cap
    score = F.when(r <= 1, 0.4 * r).otherwise(0.4 + 0.24 * F.least(r - 1, F.lit(2.5)))
    score = score + F.when(ssn180 > 1, F.least(F.lit(0.25), 0.08 * (ssn180 - 1))).otherwise(0.0)
    score = score + F.when(addresses180 > 2, F.least(F.lit(0.1), 0.03 * (addresses180 - 2))).otherwise(0.0)
    recent = ratio(n30, n180) > 0.5
    return F.when(n180 <= 1, 0.0).otherwise(clip01(F.when(recent, score * 1.2).otherwise(score)))


def overall_velocity(address: Column, phone: Column, email: Column, device: Column, config: EngineConfig = CONFIG) -> Column:
    w = config.velocity_weights
    return clip01(w["address"] * address + w["phone"] * phone + w["email"] * email + w["device"] * device)


def velocity_anomalies(address: Column, phone: Column, email: Column, device: Column) -> Column:
    return names_where([
        ("HIGH_ADDRESS_VELOCITY", address > 0.5), ("HIGH_PHONE_VELOCITY", phone > 0.5), ("HIGH_EMAIL_VELOCITY", email > 0.5),
        ("SHARED_DEVICE", device > 0.5), ("ADDRESS_PHONE_CORRELATION", (address > 0.3) & (phone > 0.3)),
    ])


def velocity_level(score: Column, anomalies: Column) -> Column:
    n = F.size(anomalies)
    return (
        F.when((score >= 0.8) | (n >= 4), "critical").when((score >= 0.6) | (n >= 3), "high")
        .when((score >= 0.4) | (n >= 2), "medium").when((score >= 0.2) | (n >= 1), "low").otherwise("minimal")
    )


# --- the five components and their sum ------------------------------------------------------------------------------


def ssn_component(s: Column) -> Column:
    return clip01(
        points(flag(s["ssn_dob_mismatch"]), 0.6) + points(flag(s["death_master_match"]), 0.8) + points(flag(s["invalid_ssn"]), 0.5)
        + points(flag(s["itin_as_ssn"]), 0.4) + points(flag(s["multiple_ssns"]), 0.5)
    )


def graph_component(s: Column) -> Column:
    shared, size = or_zero(s["shared_ssn_count"]), F.coalesce(s["cluster_size"].cast("double"), F.lit(1.0))
    return clip01(
        F.when(shared > 0, F.least(F.lit(0.6), 0.3 * shared)).otherwise(0.0) + points(or_zero(s["cluster_density"]) > 0.5, 0.2)
        + F.when(size > 5, F.least(F.lit(0.3), 0.05 * (size - 5))).otherwise(0.0) + points(or_zero(s["neighbor_avg_synthetic_score"]) > 0.5, 0.2)
    )


def velocity_component(s: Column) -> Column:
    return clip01(0.3 * or_zero(s["address_velocity_score"]) + 0.4 * or_zero(s["phone_velocity_score"]) + 0.3 * or_zero(s["email_velocity_score"]))


def credit_component(s: Column) -> Column:
    return clip01(
        points(flag(s["is_thin_file"]), 0.2) + points(flag(s["file_age_mismatch"]), 0.4) + points(flag(s["rapid_credit_building"]), 0.3)
        + points(flag(s["au_abuse_pattern"]), 0.5)
    )


def device_component(s: Column) -> Column:
    return clip01(
        points(flag(s["weak_binding"]), 0.3) + points(or_zero(s["shared_device_count"]) > 3, 0.4) + points(flag(s["known_fraud_device"]), 0.8)
        + points(flag(s["emulator_detected"]), 0.5)
    )


def synthetic_score(ssn: Column, graph: Column, velocity: Column, credit: Column, device: Column, config: EngineConfig = CONFIG) -> Column:
    w = config.component_weights
    return w["ssn"] * ssn + w["graph"] * graph + w["velocity"] * velocity + w["credit"] * credit + w["device"] * device


def synthetic_level(score: Column) -> Column:
    return ladder(score, [(0.9, "critical"), (0.8, "high"), (0.5, "medium"), (0.3, "low")], "minimal")


def triggered_signals(ssn: Column, graph: Column, velocity: Column, credit: Column, device: Column) -> Column:
    return names_where([
        ("SSN_DOB_MISMATCH", flag(ssn["ssn_dob_mismatch"])), ("DEATH_MASTER_MATCH", flag(ssn["death_master_match"])),
        ("MULTIPLE_SSNS", flag(ssn["multiple_ssns"])), ("SHARED_SSN", or_zero(graph["shared_ssn_count"]) > 0),
        ("LARGE_CLUSTER", or_zero(graph["cluster_size"]) > 5),
        ("HIGH_ADDRESS_VELOCITY", or_zero(velocity["address_velocity_score"]) > 0.5),
        ("HIGH_PHONE_VELOCITY", or_zero(velocity["phone_velocity_score"]) > 0.5),
        ("THIN_FILE", flag(credit["is_thin_file"])), ("AU_ABUSE", flag(credit["au_abuse_pattern"])),
        ("FRAUD_DEVICE", flag(device["known_fraud_device"])),
    ])


def top_component(ssn: Column, graph: Column, velocity: Column, credit: Column, device: Column) -> Column:
    best = F.greatest(ssn, graph, velocity, credit, device)
    out = F
    for name, value in (("ssn", ssn), ("graph", graph), ("velocity", velocity), ("credit", credit), ("device", device)):
        out = out.when(value == best, name)
    return out


# --- credit -------------------------------------------------------------------------------------------------------


def file_age_mismatch(age_years: Column, file_months: Column) -> Column:
    expected = F.greatest(lit0(), (age_years - 18) * 12)
    return F.coalesce(file_months < 0.3 * expected, F.lit(False))


def behaviour_patterns(thin: Column, age_years: Column, mismatch: Column, au_ratio: Column, au_count: Column, velocity: Column) -> Column:
    return names_where([
        ("FILE_AGE_MISMATCH", mismatch), ("THIN_FILE_OLD_IDENTITY", thin & (age_years > 30)),
        ("AU_ABUSE_PATTERN", (au_ratio > 0.6) & (au_count >= 3)), ("RAPID_CREDIT_BUILDING", velocity > 0.7),
    ])


def behaviour_score(thin: Column, age_years: Column, mismatch: Column, au_ratio: Column, velocity: Column) -> Column:
    return clip01(
        points(thin, 0.2) + points(thin & (age_years > 35), 0.3) + F.when(au_ratio > 0.5, 0.4 * au_ratio).otherwise(0.0)
        + 0.3 * velocity + points(mismatch, 0.4)
    )


def au_indicators(n: Column, unrelated: Column, recent: Column, high_limit: Column, very_new: Column) -> Column:
    return names_where([
        ("EXCESSIVE_AU_ACCOUNTS", n >= 6), ("HIGH_AU_COUNT", (n >= 4) & (n < 6)), ("MOSTLY_UNRELATED_AU", ratio(unrelated, n) > 0.7),
        ("RAPID_AU_ADDITIONS", recent >= 3), ("HIGH_LIMIT_AU_ACCOUNTS", high_limit >= 2), ("AU_ON_NEW_ACCOUNTS", very_new >= 2),
    ])


def au_probability(n: Column, unrelated: Column, indicators: Column) -> Column:
    # Weights of the indicators; any other counts 0.05.
    weights = {"EXCESSIVE_AU_ACCOUNTS": 0.2, "MOSTLY_UNRELATED_AU": 0.25, "RAPID_AU_ADDITIONS": 0.15, "HIGH_LIMIT_AU_ACCOUNTS": 0.1, "AU_ON_NEW_ACCOUNTS": 0.1}
    base = F.when(n >= 6, 0.4).when(n >= 4, 0.25).when(n >= 3, 0.1).otherwise(0.0)
    total = base + 0.3 * ratio(unrelated, n)
    for name, weight in (*weights.items(), ("HIGH_AU_COUNT", 0.05)):
        total = total + points(F.array_contains(indicators, name), weight)
    return clip01(total)


def au_level(probability: Column, indicators: Column) -> Column:
    return (
        F.when((probability >= 0.8) | F.array_contains(indicators, "EXCESSIVE_AU_ACCOUNTS"), "critical")
        .when(probability >= 0.6, "high").when(probability >= 0.4, "medium").when(probability >= 0.2, "low").otherwise("minimal")
    )


# --- credit sequences -----------------------------------------------------------------------------------------------


def total(values: Column) -> Column:
    return F.aggregate(values, lit0(), lambda a, x: a + x)


def mean(values: Column) -> Column:
    return F.coalesce(F.try_divide(total(values), F.size(values).cast("double")), lit0())


def slope(values: Column) -> Column:
    """Least-squares slope against 0, 1, 2, ...; 0 for fewer than three values."""
    n = F.size(values).cast("double")
    xy = F.aggregate(F.transform(values, lambda x, i: x * i), lit0(), lambda a, x: a + x)
    sx, sxx = n * (n - 1) / 2, (n - 1) * n * (2 * n - 1) / 6
    return F.when(n >= 3, F.coalesce(F.try_divide(n * xy - sx * total(values), n * sxx - sx * sx), lit0())).otherwise(0.0)


def deviation(values: Column) -> Column:
    m = mean(values)
    return F.sqrt(F.greatest(lit0(), mean(F.transform(values, lambda x: (x - m) * (x - m)))))


def nth_last(values: Column, k: int) -> Column:
    return F.try_element_at(values, F.lit(-k))


def tail(values: Column, k: int) -> Column:
    return F.when(F.size(values) > k, F.slice(values, -k, k)).otherwise(values)


def sequence_features(balances: Column, payments: Column, limits: Column, utilisation: Column, cash: Column) -> dict[str, Column]:
    n = F.size(payments)
    earlier = F.when(n > 3, F.slice(payments, 1, F.greatest(n - 3, F.lit(1))))
    return {
        "balance_trend": slope(balances),
        "balance_volatility": deviation(balances),
        "recent_balance_change": F.coalesce(nth_last(balances, 1) - nth_last(balances, 3), lit0()),
        "payment_trend": slope(payments),
        "min_payment_ratio": F.when(F.coalesce(F.array_max(payments), lit0()) > 0, F.array_min(payments) / F.array_max(payments)).otherwise(0.0),
        "payment_declining": F.when(n >= 6, mean(tail(payments, 3)) < 0.8 * mean(earlier)).otherwise(False),
        "avg_utilization": mean(utilisation),
        "max_utilization": F.coalesce(F.array_max(utilisation), lit0()),
        "utilization_trend": slope(utilisation),
        "cash_total": total(cash),
        "cash_frequency": F.size(F.filter(cash, lambda x: x > 0)).cast("long"),
        "recent_cash": total(tail(cash, 3)),
        "limit_increases": total(F.filter(limits, lambda x: x > 0)),
        "recent_limit_change": F.coalesce(nth_last(limits, 1), lit0()),
    }


def bust_out_probability(f: dict[str, Column], months: Column, synthetic: Column) -> Column:
    return clip01(
        points(f["utilization_trend"] > 0.05, 0.2) + points(f["max_utilization"] > 0.9, 0.15) + points(f["payment_declining"], 0.25)
        + points(f["payment_trend"] < -100, 0.15) + points(f["cash_frequency"] > 2, 0.2) + points(f["recent_cash"] > 1000, 0.15)
        + points((months < 12) & (f["balance_trend"] > 500), 0.2) + points(or_zero(synthetic) > 0.7, 0.3)
    )


def bust_out_signals(f: dict[str, Column], synthetic: Column) -> Column:
    return names_where([
        ("MAXED_OUT", f["max_utilization"] > 0.95), ("DECLINING_PAYMENTS", f["payment_declining"]), ("FREQUENT_CASH_ADVANCES", f["cash_frequency"] >= 3),
        ("RAPID_UTILIZATION_INCREASE", f["utilization_trend"] > 0.1), ("RAPID_BALANCE_GROWTH", f["balance_trend"] > 1000),
        ("HIGH_SYNTHETIC_RISK", or_zero(synthetic) > 0.7),
    ])


def days_to_bust_out(probability: Column, utilisation: Column) -> Column:
    now, last = nth_last(utilisation, 1), tail(utilisation, 6)
    trend = (nth_last(last, 1) - F.try_element_at(last, F.lit(1))) / (F.size(last) - 1)
    guess = F.greatest(F.lit(7.0), F.least(F.lit(90.0), 30.0 * F.try_divide(1.0 - now, trend)))
    days = F.when(F.size(utilisation) < 3, 90).when(now >= 0.95, 30).when(trend > 0, guess.cast("int")).otherwise(90)
    return F.when(probability > 0.5, days)


def bust_out_level(probability: Column) -> Column:
    return ladder(probability, [(0.9, "critical"), (0.75, "high"), (0.5, "medium"), (0.3, "low")], "minimal")


def bust_out_action(level: Column) -> Column:
    return (
        F.when(level == "critical", "IMMEDIATE_REVIEW_CREDIT_FREEZE").when(level == "high", "URGENT_REVIEW_REDUCE_LIMIT")
        .when(level == "medium", "MONITOR_CLOSELY").when(level == "low", "STANDARD_MONITORING").otherwise("NO_ACTION")
    )


# --- ensemble -------------------------------------------------------------------------------------------------------

CRITICAL_SIGNALS = ("SSN_DOB_MISMATCH", "DEATH_MASTER_MATCH", "SHARED_SSN", "FRAUD_DEVICE")


def ensemble_score(synthetic: Column, velocity: Column, credit: Column, au: Column, bust_out: Column, config: EngineConfig = CONFIG) -> Column:
    """The weights of the other four are scaled up where there is no bust-out probability."""
    w = config.ensemble_weights
    four = w["synthetic"] * synthetic + w["velocity"] * velocity + w["credit"] * credit + w["au"] * au
    return clip01(F.when(bust_out.isNull(), four / (1.0 - w["bust_out"])).otherwise(four + w["bust_out"] * bust_out))


def ensemble_level(score: Column, signals: Column) -> Column:
    critical = F.arrays_overlap(signals, F.array(*[F.lit(s) for s in CRITICAL_SIGNALS]))
    return F.when(critical, "critical").otherwise(ladder(score, [(0.85, "critical"), (0.65, "high"), (0.45, "medium"), (0.25, "low")], "minimal"))


def recommended_action(level: Column, bust_out: Column) -> Column:
    return (
        F.when((level == "critical") & (or_zero(bust_out) > 0.8), "IMMEDIATE_CREDIT_FREEZE_SAR_FILING")
        .when(level == "critical", "IMMEDIATE_REVIEW_DECLINE_APPLICATION").when(level == "high", "MANUAL_REVIEW_REQUIRED")
        .when(level == "medium", "ENHANCED_VERIFICATION").when(level == "low", "STANDARD_PROCESSING_MONITOR").otherwise("APPROVE")
    )
