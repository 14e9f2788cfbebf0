"""Deterministic made data beside given rows: every value is derived from a row's id and a seed by hashing.

A table of n ids makes n identities, rings or accounts; equal ids make equal rows, and a null id makes none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def draw(seed: int, *parts: Column | str) -> Column:
    """A number in [0, 1) of the parts and the seed: 52 bits of a hash that other engines have too."""
    text = F.concat_ws("|", *[F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))


def whole(u: Column, low: int, high: int) -> Column:
    return (F.lit(low) + F.floor(u * (high - low + 1))).cast("int")


def ssn_hash(u: Column) -> Column:
    return F.sha2(F.concat_ws("-", whole(u, 1, 899).cast("string"), F.floor(u * 7919 * 99).cast("string"), F.floor(u * 104729 * 9999).cast("string")), 256)


def identities(rows: DataFrame, share_synthetic: float = 0.1, seed: int = 1) -> DataFrame:
    """An identity for each id of ``rows``, about the given share fabricated: thin, young files with many
    authorised-user accounts."""
    fake = draw(seed, "id", F.lit("kind")) < share_synthetic
    u = {k: draw(seed, "id", F.lit(k)) for k in ("ssn", "name", "dob", "lines", "age", "au")}
    return rows.where("id IS NOT NULL").select(
        F.concat(F.lit("id_"), F.lpad(F.col("id").cast("string"), 10, "0")).alias("identity_id"), ssn_hash(u["ssn"]).alias("ssn_hash"), F.concat(F.lit("First"), whole(u["name"], 1, 500).cast("string")).alias("first_name"),
        F.concat(F.lit("Last"), whole(u["dob"], 1, 2000).cast("string")).alias("last_name"), F.date_add(F.lit("1950-01-01").cast("date"), whole(u["dob"], 0, 19000)).alias("dob"),
        *[F.sha2(F.concat_ws("|", F.lit(k), F.col("id").cast("string"), F.lit(str(seed))), 256).alias(f"{k}_hash") for k in ("address", "phone", "email")], fake.alias("is_synthetic"),
        F.when(fake, whole(u["lines"], 0, 4)).otherwise(whole(u["lines"], 2, 20)).alias("num_tradelines"), F.when(fake, whole(u["age"], 1, 24)).otherwise(whole(u["age"], 12, 300)).alias("file_age_months"),
        F.when(fake, whole(u["au"], 1, 6)).otherwise(whole(u["au"], 0, 1)).alias("au_accounts"),
    )


def fraud_rings(rows: DataFrame, seed: int = 2) -> DataFrame:
    """For each id of ``rows`` a ring of 3 to 8 fabricated identities; about 70 % share the ring's address and 50 % its
    phone."""
    ring = rows.where("id IS NOT NULL").select(F.col("id").alias("ring"), whole(draw(seed, "id"), 3, 8).alias("size"))
    member = ring.select("ring", F.explode(F.sequence(F.lit(1), "size")).alias("k"))
    own = F.concat_ws("_", F.lit("own"), F.col("ring").cast("string"), F.col("k").cast("string"))
    common = F.concat(F.lit("ring"), F.col("ring").cast("string"))
    pick = lambda kind, share: F.sha2(F.concat(F.lit(kind), F.when(draw(seed, "ring", "k", F.lit(kind)) < share, common).otherwise(own)), 256)
    return member.select(F.concat_ws("_", F.lit("ring"), F.col("ring").cast("string"), F.col("k").cast("string")).alias("identity_id"), "ring", pick("address", 0.7).alias("address_hash"), pick("phone", 0.5).alias("phone_hash"), F.lit(True).alias("is_synthetic"))


def credit_sequences(rows: DataFrame, share_bust_out: float = 0.2, months: int = 12, seed: int = 3) -> DataFrame:
    """Monthly arrays of an account for each id of ``rows``; accounts that bust out, about the given share, run their
    balance up and stop paying in the last quarter."""
    base = rows.where("id IS NOT NULL").select("id", (draw(seed, "id", F.lit("kind")) < share_bust_out).alias("is_bust_out"))
    at = F.sequence(F.lit(1), F.lit(months))
    noise = lambda k, tag: draw(seed, "id", k, F.lit(tag))
    rising = lambda k: F.when(F.col("is_bust_out"), 0.3 + 0.65 * k / months).otherwise(0.2 + 0.2 * noise(k, "u"))
    late = lambda k: F.col("is_bust_out") & (k > months * 3 // 4)
    return base.select(
        F.concat(F.lit("acct_"), F.col("id").cast("string")).alias("account_id"), "is_bust_out", F.lit(months).cast("long").alias("months_on_books"),
        F.transform(at, lambda k: 10_000 * rising(k)).alias("balances"), F.transform(at, lambda k: F.when(late(k), 20 * noise(k, "p")).otherwise(200 + 300 * noise(k, "p"))).alias("payments"),
        F.transform(at, lambda k: F.when(noise(k, "l") > 0.9, 500.0).otherwise(0.0)).alias("limits"), F.transform(at, lambda k: rising(k)).alias("utilization"),
        F.transform(at, lambda k: F.when(late(k) & (noise(k, "c") > 0.3), 500 + 500 * noise(k, "c")).otherwise(0.0)).alias("cash"),
    )


def credit_files(people: DataFrame, seed: int = 4) -> DataFrame:
    """A made bureau file per ssn_hash: 15 % thin, 3 % bankruptcies, 8 % collections, balance at most the limit."""
    u = lambda tag: draw(seed, "ssn_hash", F.lit(tag))
    thin = u("thin") < 0.15
    limit = F.when(thin, 500 + 4500 * u("limit")).otherwise(5000 + 95000 * u("limit"))
    lines = F.when(thin, whole(u("lines"), 0, 2)).otherwise(whole(u("lines"), 3, 25))
    return people.select("ssn_hash").distinct().select(
        "ssn_hash", lines.alias("num_tradelines"), F.when(thin, whole(u("age"), 1, 24)).otherwise(whole(u("age"), 24, 360)).alias("file_age_months"), limit.alias("total_credit_limit"), (limit * u("use")).alias("total_balance"),
        whole(u("inq"), 0, 8).alias("num_inquiries_6mo"), whole(u("new"), 0, 4).alias("num_new_accounts_6mo"), F.when(thin, F.least(lines, whole(u("au"), 1, 5))).otherwise(F.least(lines, whole(u("au"), 0, 1))).alias("authorized_user_accounts"),
        whole(u("score"), 500, 850).alias("credit_score"), (u("bk") < 0.03).alias("has_bankruptcy"), (u("coll") < 0.08).alias("has_collections"),
    )


def tradelines(files: DataFrame, seed: int = 5) -> DataFrame:
    """One row per line of a file; its first authorized_user_accounts lines are authorised-user ones."""
    each = files.where("num_tradelines > 0").select("ssn_hash", "authorized_user_accounts", F.explode(F.sequence(F.lit(0), F.col("num_tradelines") - 1)).alias("i"))
    u = lambda tag: draw(seed, "ssn_hash", "i", F.lit(tag))
    # Kinds of account.
    kinds = F.array(*[F.lit(k) for k in ("credit_card", "auto_loan", "mortgage", "student_loan", "personal_loan", "retail_card")])
    limit = 500 + 20000 * u("limit")
    return each.select(
        F.concat(F.lit("TL-"), F.substring("ssn_hash", 1, 4), F.lit("-"), F.lpad(F.col("i").cast("string"), 3, "0")).alias("tradeline_id"), "ssn_hash", F.get(kinds, whole(u("kind"), 0, 5)).alias("account_type"),
        whole(u("age"), 1, 240).alias("age_months"), limit.alias("credit_limit"), (limit * u("use")).alias("current_balance"), F.when(u("late") < 0.05, "late").otherwise("current").alias("payment_status"),
        (F.col("i") < F.col("authorized_user_accounts")).alias("is_authorized_user"),
    )
