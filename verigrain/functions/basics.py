"""Column helpers that the rule builders share. None of them runs an action."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def lit0() -> Column:
    return F.lit(0.0)


def or_zero(c: Column) -> Column:
    return F.coalesce(c.cast("double"), lit0())


def flag(c: Column) -> Column:
    """An absent flag is false."""
    return F.coalesce(c.cast("boolean"), F.lit(False))


def points(condition: Column, value: float | Column) -> Column:
    """``value`` where the condition holds, else (or if unknown) 0."""
    return F.when(condition, value).otherwise(lit0())


def clip01(c: Column) -> Column:
    return F.least(F.lit(1.0), c)


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), lit0())


def ladder(value: Column, steps: list[tuple[float, str]], otherwise: str) -> Column:
    """The first name whose bound the value reaches."""
    out = F
    for bound, name in steps:
        out = out.when(value >= bound, name)
    return out.otherwise(otherwise)


def names_where(pairs: list[tuple[str, Column]]) -> Column:
    """Names whose condition holds, in the order given."""
    return F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in pairs]))


def joined(names: Column) -> Column:
    """An array of names as one comma-joined, sorted string."""
    return F.array_join(F.sort_array(F.array_distinct(names)), ",")


def elapsed_days(later: Column, earlier: Column) -> Column:
    """Whole 24-hour days between two timestamps without zone, rounded down."""
    micros = F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))
    return F.floor(micros / F.lit(86_400_000_000)).cast("long")


def months_of(days: Column) -> Column:
    return F.floor(days / F.lit(30)).cast("long")


def before(as_of: Column, days: int) -> Column:
    return as_of - F.expr(f"INTERVAL {days} DAYS")


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def any_substring(text: Column, parts: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | F.contains(text, F.lit(p))
    return out
