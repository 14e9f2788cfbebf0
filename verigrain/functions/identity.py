"""National ids, hashes, e-mail, phone and device: Column -> Column rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from verigrain.functions.basics import any_substring, clip01, digits, flag, lit0, names_where, or_zero, points, strip

# --- hashes -----------------------------------------------------------------------------------------------------


def pii_hash(c: Column) -> Column:
    return F.sha2(F.lower(strip(c)), 256)


def request_address_hash(street: Column, city: Column, state: Column, zip_code: Column) -> Column:
    parts = [F.replace(F.lower(p), F.lit(" "), F.lit("")) for p in (street, city, state, zip_code)]
    return pii_hash(F.concat_ws("|", *parts))


def request_phone_hash(phone: Column) -> Column:
    return pii_hash(digits(phone))


def identity_id(ssn: Column, first: Column, last: Column) -> Column:
    return F.substring(pii_hash(F.concat_ws("|", digits(ssn), first, last)), 1, 16)


def application_id(identity: Column, day: Column) -> Column:
    return F.concat(F.lit("APP-"), F.upper(F.substring(pii_hash(F.concat(identity, day)), 1, 8)))


# --- national id --------------------------------------------------------------------------------------------------

SSN_PATTERN = r"^([0-9]{3})-?([0-9]{2})-?([0-9]{4})$"
# Numbers printed in advertising: area 987, group 65, serials 4320 to 4329.
ADVERTISED = tuple(f"98765{serial}" for serial in range(4320, 4330))


def ssn_part(ssn: Column, k: int) -> Column:
    return F.regexp_extract(ssn, SSN_PATTERN, k)


def ssn_result(ssn: Column, on_death_list: Column) -> Column:
    """The first rule that applies; the format is judged on the raw text."""
    area, group, serial = (ssn_part(ssn, k) for k in (1, 2, 3))
    return (
        F.when(ssn.isNull() | ~ssn.rlike(SSN_PATTERN), "invalid_format")
        .when(area >= "900", "itin").when(area.isin("000", "666"), "invalid_area")
        .when(group == "00", "invalid_group").when(serial == "0000", "invalid_format")
        .when(digits(ssn).isin(*ADVERTISED), "advertising").when(flag(on_death_list), "death_master").otherwise("valid")
    )


def issuance_mismatch(birth_year: Column, year_start: Column, year_end: Column) -> Column:
    return (
        F.when(year_end.isNotNull() & (birth_year > year_end), "ssn_before_birth")
        .when(year_start.isNotNull() & (birth_year >= 1987) & (year_start > birth_year + 5), "ssn_too_recent")
    )


def issuance_confidence(mismatch: Column, known: Column) -> Column:
    return F.when(~known, 0.0).when(mismatch == "ssn_before_birth", 0.95).when(mismatch == "ssn_too_recent", 0.7).otherwise(0.8)


def issuance_score(mismatch: Column, confidence: Column) -> Column:
    weight = F.when(mismatch == "ssn_before_birth", 1.0).when(mismatch == "ssn_too_recent", 0.6).otherwise(0.5)
    return F.when(mismatch.isNull(), 0.0).otherwise(weight * confidence)


RANDOMISED = "2011-06-25"


def randomised_era(issued: Column) -> Column:
    return issued >= F.lit(RANDOMISED).cast("date")


def high_group_valid(group: Column, highest: Column, issued: Column) -> Column:
    """Whether a group had been issued by the area's highest one; null where the list cannot tell: without a date, after
    the change, or for an area that it lacks."""
    return F.when(~randomised_era(issued) & highest.isNotNull(), group <= highest)


def randomisation_note(group: Column, area: Column, highest: Column, issued: Column) -> Column:
    """What the comparison found, in words."""
    valid = high_group_valid(group, highest, issued)
    checked = F.concat(F.lit("group "), group.cast("string"), F.when(valid, " within ").otherwise(" above "), F.lit("highest group "), highest.cast("string"), F.lit(" of area "), area.cast("string"))
    return F.when(valid.isNotNull(), checked).when(randomised_era(issued), "issued after randomisation").otherwise("not on the list or not dated")


def randomisation_risk(dob: Column, valid_for_era: Column | None = None) -> Column:
    """0.3 for births before the change; 0.8 where a dated group is known to be impossible."""
    old = F.when(dob < F.lit(RANDOMISED).cast("date"), 0.3).otherwise(0.0)
    return old if valid_for_era is None else F.when(valid_for_era.eqNullSafe(F.lit(False)), 0.8).otherwise(old)


# --- e-mail -------------------------------------------------------------------------------------------------------

# Provider lists and name patterns of the e-mail rules.
MAJOR = (
    "gmail.com", "yahoo.com", "hotmail.com", "outlook.com", "live.com", "msn.com", "icloud.com", "me.com", "aol.com",
    "protonmail.com", "mail.com",
)
DISPOSABLE = (
    "tempmail.com", "guerrillamail.com", "10minutemail.com", "mailinator.com", "throwaway.email", "temp-mail.org",
    "fakemailgenerator.com", "getnada.com", "maildrop.cc", "yopmail.com", "sharklasers.com", "guerrillamail.info",
    "grr.la", "spam4.me", "trash-mail.com",
)
FREE = ("zoho.com", "gmx.com", "yandex.com", "tutanota.com", "fastmail.com", "hushmail.com", "inbox.com", "mail.ru")
RANDOM_LOCAL = (r"^[a-z]{8,}[0-9]{3,}$", r"^[a-z0-9]{15,}$", r"^[a-z]{2,3}[0-9]{5,}$", r"^[a-z]+_[a-z]+_[0-9]+$")
SYNTHETIC_LOCAL = (r"^(user|account|test|temp|fake)[0-9]+$", r"^[a-z]+\.[a-z]+[0-9]{4,}$", r"^[a-z]{2}[0-9]{6,}$")


def email_domain(email: Column) -> Column:
    return F.when(F.contains(email, F.lit("@")), F.lower(F.split_part(email, F.lit("@"), F.lit(2))))


def email_domain_type(domain: Column, listed_disposable: Column | None = None) -> Column:
    disposable = domain.isin(*DISPOSABLE)
    if listed_disposable is not None:
        disposable = disposable | flag(listed_disposable)
    return (
        F.when(domain.isNull(), "unknown").when(domain.isin(*MAJOR), "major").when(disposable, "disposable")
        .when(domain.isin(*FREE), "free_uncommon").when(F.endswith(domain, F.lit(".edu")), "edu")
        .when(F.endswith(domain, F.lit(".gov")), "gov").otherwise("custom")
    )


def _by_type(kind: Column, values: dict[str, float], otherwise: float) -> Column:
    out = F
    for name, value in values.items():
        out = out.when(kind == name, value)
    return out.otherwise(otherwise)


def domain_reputation(kind: Column) -> Column:
    return _by_type(kind, {"unknown": 0.0, "disposable": 0.1, "gov": 0.95, "edu": 0.9, "major": 0.8, "free_uncommon": 0.6, "custom": 0.7}, 0.5)


def domain_risk(kind: Column) -> Column:
    return _by_type(kind, {"unknown": 1.0, "disposable": 0.9, "free_uncommon": 0.4, "major": 0.2, "gov": 0.1, "edu": 0.15, "custom": 0.3}, 0.5)


def email_local(email: Column) -> Column:
    return F.when(F.contains(email, F.lit("@")), F.lower(F.substring_index(email, "@", 1)))


def number_suffix(local: Column) -> Column:
    return F.regexp_extract(local, "([0-9]+)$", 1)


def looks_random(local: Column) -> Column:
    out = F.lit(False)
    for p in RANDOM_LOCAL:
        out = out | local.rlike(p)
    vowels = F.length(F.regexp_replace(local, "[^aeiou]", ""))
    return out | ((F.length(local) > 12) & (vowels / F.length(local) < 0.15))


def looks_synthetic(local: Column) -> Column:
    out = F.lit(False)
    for p in SYNTHETIC_LOCAL:
        out = out | local.rlike(p)
    return out


def holds_name(local: Column, first: Column, last: Column) -> Column:
    """A bare first initial counts, so most addresses do."""
    bare, f, l = F.regexp_replace(local, "[0-9._-]", ""), F.lower(first), F.lower(last)
    out = F.lit(False)
    for part in (f, F.substring(f, 1, 1), l, F.concat(f, l), F.concat(l, f), F.concat(F.substring(f, 1, 1), l), F.concat(f, F.substring(l, 1, 1))):
        out = out | (F.coalesce(F.length(part) > 0, F.lit(False)) & F.coalesce(F.contains(bare, part), F.lit(False)))
    return out


def email_pattern(local: Column, named: Column) -> Column:
    numbered = local.rlike("[0-9]")
    return (
        F.when(local.isNull(), "invalid").when(looks_random(local), "random_generated").when(looks_synthetic(local), "synthetic_pattern")
        .when(named & ~numbered, "name_based").when(named & numbered, "name_with_numbers").when(numbered, "numbered").otherwise("standard")
    )


def email_pattern_score(local: Column, named: Column) -> Column:
    suffix = number_suffix(local)
    score = points(looks_random(local), 0.5) + points(looks_synthetic(local), 0.4) + points(local.rlike("[0-9]"), 0.1)
    score = score + points(F.length(suffix) >= 4, 0.2) + points(~named, 0.15)
    return F.when(local.isNull(), 1.0).otherwise(clip01(score))


def email_age_mismatch(age_years: Column, email_days: Column) -> Column:
    return F.when((age_years >= 25) & (email_days < 180), 0.6).when((age_years >= 40) & (email_days < 365), 0.7).otherwise(0.0)


def email_age_risk(base: Column, mismatch: Column, email_days: Column) -> Column:
    return clip01(F.greatest(or_zero(base), mismatch, points(email_days < 90, 0.4)))


# --- phone --------------------------------------------------------------------------------------------------------

# Free internet-telephony providers.
RISKY_VOIP = ("google_voice", "textnow", "textfree", "burner", "hushed")
# Prefixes that are not subscriber lines.
TOLL_FREE = ("800", "888", "877", "866", "855", "844", "833")
PREMIUM = ("900", "976")


def phone_digits(phone: Column) -> Column:
    d = digits(phone)
    return F.when((F.length(d) == 11) & (F.substring(d, 1, 1) == "1"), F.substring(d, 2, 10)).otherwise(d)


def line_type(number: Column) -> Column:
    prefix = F.substring(number, 1, 3)
    return (
        F.when(~phone_valid(number), "unknown").when(prefix.isin(*TOLL_FREE), "toll_free")
        .when(prefix.isin(*PREMIUM), "premium").otherwise("unknown")
    )


def phone_valid(number: Column) -> Column:
    return F.coalesce(F.length(number) == 10, F.lit(False))


def line_risk(number: Column, kind: Column) -> Column:
    return F.when(~phone_valid(number), 0.5).otherwise(_by_type(kind, {"toll_free": 0.8, "premium": 0.9}, 0.0))


def carrier_risk(base: Column, valid: Column, voip: Column, ported: Column, carrier: Column) -> Column:
    risk = F.when(flag(voip), F.greatest(base, F.lit(0.6))).otherwise(base)
    return clip01(risk + points(flag(ported), 0.1) + points(flag(valid) & carrier.isNull(), 0.2))


def voip_high_risk(voip: Column, burner: Column, age_days: Column, provider: Column) -> Column:
    return flag(voip) & (flag(burner) | F.coalesce(age_days < 30, F.lit(False)) | flag(F.lower(provider).isin(*RISKY_VOIP)))


def voip_risk(voip: Column, burner: Column, virtual: Column, age_days: Column) -> Column:
    young = F.when(age_days < 7, 0.3).when(age_days < 30, 0.2).when(age_days < 90, 0.1).otherwise(0.0)
    return F.when(flag(voip), clip01(0.4 + points(flag(burner), 0.4) + points(flag(virtual), 0.2) + young)).otherwise(0.1)


def other_ssn_risk(others: Column) -> Column:
    return F.when(others <= 0, 0.0).when(others == 1, 0.5).when(others == 2, 0.7).otherwise(F.least(F.lit(1.0), 0.7 + 0.1 * (others - 2)))


# --- device -------------------------------------------------------------------------------------------------------

# User-agent marks of emulators.
EMULATOR = ("android sdk", "emulator", "simulator", "genymotion", "bluestacks")


def device_type(agent: Column) -> Column:
    a = F.lower(agent)
    return (
        F.when(F.contains(a, F.lit("mobile")), "mobile").when(any_substring(a, ("tablet", "ipad")), "tablet")
        .when(any_substring(a, ("bot", "crawler", "spider")), "bot").otherwise("desktop")
    )


def device_os(agent: Column) -> Column:
    a = F.lower(agent)
    return (
        F.when(F.contains(a, F.lit("android")), "Android").when(any_substring(a, ("iphone", "ipad", "ios")), "iOS")
        .when(F.contains(a, F.lit("windows")), "Windows").when(any_substring(a, ("mac os", "macos")), "macOS")
        .when(F.contains(a, F.lit("linux")), "Linux").otherwise("Unknown")
    )


def device_browser(agent: Column) -> Column:
    a = F.lower(agent)
    chrome, edge = F.contains(a, F.lit("chrome")), F.contains(a, F.lit("edg"))
    return (
        F.when(chrome & ~edge, "Chrome").when(F.contains(a, F.lit("firefox")), "Firefox")
        .when(F.contains(a, F.lit("safari")) & ~chrome, "Safari").when(edge, "Edge").otherwise("Unknown")
    )


def fingerprint_id(agent: Column, resolution: Column, timezone: Column, canvas: Column, webgl: Column) -> Column:
    parts = [F.coalesce(c, F.lit("")) for c in (agent, resolution, timezone, canvas, webgl)]
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 32)


def is_emulator(agent: Column) -> Column:
    return any_substring(F.lower(agent), EMULATOR)


def device_risk_raw(kind: Column, emulator: Column, incognito: Column, vm: Column, identities: Column) -> Column:
    return (
        points(flag(emulator), 0.5) + points(kind == "bot", 0.8) + points(flag(incognito), 0.1)
        + points(flag(vm), 0.4) + points(identities > 3, 0.3)
    )


def device_risk(on_fraud_list: Column, raw: Column) -> Column:
    return F.when(flag(on_fraud_list), 1.0).otherwise(clip01(raw))


def _device_flags(on_fraud_list: Column, kind: Column, emulator: Column, incognito: Column, vm: Column) -> Column:
    return names_where([
        ("known_fraud_device", flag(on_fraud_list)), ("emulator_detected", flag(emulator)), ("bot_detected", kind == "bot"),
        ("incognito_mode", flag(incognito)), ("virtual_machine", flag(vm)),
    ])


def device_factors(on_fraud_list: Column, kind: Column, emulator: Column, incognito: Column, vm: Column, identities: Column) -> Column:
    many = F.when(identities > 3, F.array(F.concat(F.lit("multiple_identities_"), identities.cast("string")))).otherwise(F.array().cast("array<string>"))
    return F.concat(_device_flags(on_fraud_list, kind, emulator, incognito, vm), many)


def binding_score(n: Column, days: Column, primary: Column, others: Column) -> Column:
    score = F.least(F.lit(0.4), 0.04 * n) + F.least(F.lit(0.3), 0.01 * days) + points(flag(primary), 0.2) - points(others > 5, 0.1)
    return F.greatest(lit0(), clip01(score))


def consistency_score(n: Column, mean_gap: Column, std_gap: Column) -> Column:
    return F.when(n < 2, 0.5).when(mean_gap == 0, 1.0).otherwise(F.greatest(lit0(), 1.0 - std_gap / (mean_gap + 1)))


def change_rate(devices: Column, span_days: Column) -> Column:
    return F.when(devices <= 1, 0.0).otherwise((devices - 1) / F.greatest(F.lit(1.0), span_days / 30.0))


def binding_risk(never_seen: Column, rate: Column, binding: Column, devices: Column) -> Column:
    suspicious = (rate > 3) | (devices > 10)
    return clip01(points(never_seen, 0.3) + points(rate > 2, 0.3) + points(binding < 0.3, 0.2) + points(suspicious, 0.4))


def sharing_risk(identities: Column, least: int = 3) -> Column:
    return F.when(identities >= 10, 1.0).when(identities >= 5, 0.7).when(identities >= least, 0.4).otherwise(0.0)


def switching(devices: Column) -> tuple[Column, Column]:
    """Anomaly name (null if none) and risk of so many devices in a day."""
    name = F.when(devices >= 5, "excessive_device_switching").when(devices >= 3, "high_device_switching")
    return name, F.when(devices >= 5, 0.9).when(devices >= 3, 0.5).otherwise(0.0)
