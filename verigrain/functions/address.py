"""Address normalisation and residential scoring: Column -> Column rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from verigrain.functions.basics import any_substring, clip01, digits, points, strip

# Street words in the order in which they are tried, unit words, states, and place names.
STREET_TYPES = (
    ("STREET", "ST"), ("STR", "ST"), ("ST", "ST"), ("AVENUE", "AVE"), ("AVE", "AVE"), ("AV", "AVE"), ("BOULEVARD", "BLVD"),
    ("BLVD", "BLVD"), ("DRIVE", "DR"), ("DR", "DR"), ("LANE", "LN"), ("LN", "LN"), ("ROAD", "RD"), ("RD", "RD"),
    ("COURT", "CT"), ("CT", "CT"), ("CIRCLE", "CIR"), ("CIR", "CIR"), ("PLACE", "PL"), ("PL", "PL"), ("WAY", "WAY"),
    ("HIGHWAY", "HWY"), ("HWY", "HWY"), ("PARKWAY", "PKWY"), ("PKWY", "PKWY"),
)
UNIT_TYPES = {"APARTMENT": "APT", "APT": "APT", "#": "APT", "UNIT": "UNIT", "SUITE": "STE", "STE": "STE"}
STATES = {
    "alabama": "AL", "alaska": "AK", "arizona": "AZ", "arkansas": "AR", "california": "CA", "colorado": "CO", "connecticut": "CT",
    "delaware": "DE", "florida": "FL", "georgia": "GA", "hawaii": "HI", "idaho": "ID", "illinois": "IL", "indiana": "IN", "iowa": "IA",
    "kansas": "KS", "kentucky": "KY", "louisiana": "LA", "maine": "ME", "maryland": "MD", "massachusetts": "MA", "michigan": "MI",
    "minnesota": "MN", "mississippi": "MS", "missouri": "MO", "montana": "MT", "nebraska": "NE", "nevada": "NV", "new hampshire": "NH",
    "new jersey": "NJ", "new mexico": "NM", "new york": "NY", "north carolina": "NC", "north dakota": "ND", "ohio": "OH",
    "oklahoma": "OK", "oregon": "OR", "pennsylvania": "PA", "rhode island": "RI", "south carolina": "SC", "south dakota": "SD",
    "tennessee": "TN", "texas": "TX", "utah": "UT", "vermont": "VT", "virginia": "VA", "washington": "WA", "west virginia": "WV",
    "wisconsin": "WI", "wyoming": "WY",
}
CMRA = ("ups store", "mailboxes etc", "postal connections", "postnet", "mail center", "pack & ship", "postal annex", "pmb", "private mail")
HIGH_RISK = ("homeless shelter", "halfway house", "motel", "hotel", "extended stay", "correctional", "detention")

NUMBER = r"^([0-9]+[-0-9]*)\s+"
UNIT = r"\s+(APT|APARTMENT|UNIT|STE|SUITE|#)\s*([A-Z0-9-]+)$"
LAST_TOKEN = r"\s+[A-Z0-9-]+\s*$"


def state_code(state: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in STATES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.lower(strip(state))), F.upper(strip(state)))


def zip5(zip_code: Column) -> Column:
    d = digits(zip_code)
    return F.when(F.length(d) >= 5, F.substring(d, 1, 5)).otherwise(d)


def zip4(zip_code: Column) -> Column:
    d = digits(zip_code)
    return F.when(F.length(d) >= 9, F.substring(d, 6, 4))


def city_name(city: Column) -> Column:
    out = F.upper(strip(city))
    for short, long in (("ST", "SAINT"), ("MT", "MOUNT"), ("FT", "FORT")):
        out = F.regexp_replace(out, rf"\b{short}\b", long)
    return out


def street_number(street: Column) -> Column:
    return F.regexp_extract(F.upper(strip(street)), NUMBER, 1)


def _without_number(street: Column) -> Column:
    return F.regexp_replace(F.upper(strip(street)), NUMBER, "")


def unit_type(street: Column) -> Column:
    word = F.regexp_extract(_without_number(street), UNIT, 1)
    table = F.create_map(*[F.lit(x) for pair in UNIT_TYPES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, word), F.lit(""))


def unit_number(street: Column) -> Column:
    return F.regexp_extract(_without_number(street), UNIT, 2)


def _street_words(street: Column, keep_street_type: bool) -> Column:
    rest = _without_number(street)
    dropped = rest if keep_street_type else F.regexp_replace(rest, LAST_TOKEN, "")
    return F.when(rest.rlike(UNIT), F.regexp_replace(rest, UNIT, "")).otherwise(dropped)


def street_type(street: Column, keep_street_type: bool = False) -> Column:
    """Without a unit the last token is dropped first, unless ``keep_street_type``: then no type is usually left."""
    words, out = _street_words(street, keep_street_type), F
    for word, short in STREET_TYPES:
        out = out.when(words.rlike(rf"\b{word}\b\.?$"), short)
    return out.otherwise("")


def street_name(street: Column, keep_street_type: bool = False) -> Column:
    words, out = _street_words(street, keep_street_type), F
    for word, _ in STREET_TYPES:
        out = out.when(words.rlike(rf"\b{word}\b\.?$"), strip(F.regexp_replace(words, rf"\b{word}\b\.?$", "")))
    return out.otherwise(strip(words))


def address_hash(*parts: Column) -> Column:
    """Of number, name, type, unit type, unit number, city, state and zip, without the empty ones."""
    return F.substring(F.sha2(F.upper(F.concat_ws("|", *[F.nullif(p, F.lit("")) for p in parts])), 256), 1, 16)


def is_cmra(street: Column) -> Column:
    s = F.lower(street)
    box = F.regexp_extract(s, r"#\s*([0-9]+)", 1).try_cast("bigint")
    return any_substring(s, CMRA) | F.coalesce(box > 500, F.lit(False))


def is_high_risk_place(street: Column) -> Column:
    return any_substring(F.lower(street), HIGH_RISK)


def is_po_box(street: Column) -> Column:
    return any_substring(F.lower(street), ("po box", "p.o. box"))


def address_type(street: Column) -> Column:
    return F.when(is_po_box(street), "po_box").when(is_cmra(street), "cmra").otherwise("residential")


def residential_probability(street: Column) -> Column:
    return F.when(is_po_box(street), 0.3).when(is_cmra(street), 0.2).otherwise(0.7)


def dwelling_type(street: Column) -> Column:
    s = F.lower(street)
    return (
        F.when(any_substring(s, ("apt", "apartment", "unit", "#")), "apartment")
        .when(any_substring(s, ("suite", "ste", "floor", "fl ")), "commercial").otherwise("single_family")
    )


def residential_risk(street: Column) -> Column:
    return clip01(
        points(is_cmra(street), 0.5) + points(is_high_risk_place(street), 0.4) + points(is_po_box(street), 0.3)
        + 0.3 * (1.0 - residential_probability(street))
    )
