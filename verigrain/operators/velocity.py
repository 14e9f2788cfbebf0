"""Trailing-window re-use of identity elements, from an append-only log of uses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verigrain.config import CONFIG, EngineConfig
from verigrain.functions import scores as S
from verigrain.functions.basics import before
from verigrain.operators.pairs import block_pairs

WINDOWS = (30, 90, 180)


def window_counts(uses: DataFrame, as_of: Column, members: dict[str, str], bounded: bool = False) -> DataFrame:
    """Per element, distinct members of each kind in 30, 90 and 180 days, and first and last use.

    ``members`` maps an output name to a column of ``uses``. A member counts in a window exactly if its last use
    does, so one aggregation brings every (element, member) down to a row before members are counted; nothing is
    expanded once per window. Uses before all windows only count for first and last use: without their members they
    are one row per element, which map-side aggregation makes of them before anything is shuffled. Without
    ``bounded``, uses later than ``as_of`` count too.
    """
    uses = uses.where(F.col("ts") <= as_of) if bounded else uses
    held = list(dict.fromkeys(members.values()))
    recent = F.col("ts") >= before(as_of, max(WINDOWS))
    span = [F.max("ts").alias("last"), F.min("ts").alias("first")]
    together = uses.select("element_type", "element_key", "ts", *[F.when(recent, F.col(c)).alias(c) for c in held]).groupBy("element_type", "element_key", *held).agg(*span)
    types = {uses.schema[c].dataType.simpleString() for c in held}
    kind = types.pop() if len(types) == 1 else "string"
    named = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).cast(kind).alias("member")) for k, c in members.items()])
    nobody = F.array(F.struct(F.lit("").alias("kind"), F.lit(None).cast(kind).alias("member")))
    someone = F.coalesce(*[F.col(c).cast("string") for c in held]).isNotNull()
    last = (
        together.select("element_type", "element_key", "last", "first", F.explode(F.when(someone, named).otherwise(nobody)).alias("m"))
        .groupBy("element_type", "element_key", "m.kind", "m.member").agg(F.max("last").alias("last"), F.min("first").alias("first"))
    )
    counts = [
        F.count_if((F.col("kind") == k) & F.col("member").isNotNull() & (F.col("last") >= before(as_of, d))).alias(f"unique_{k}_{d}d")
        for k in members for d in WINDOWS
    ]
    return last.groupBy("element_type", "element_key").agg(*counts, F.min("first").alias("first_seen"), F.max("last").alias("last_seen"))


def element_velocity(uses: DataFrame, as_of: Column, config: EngineConfig = CONFIG) -> DataFrame:
    counts = window_counts(uses, as_of, {"identities": "identity_key", "ssns": "ssn_key"})
    caps = F.create_map(*[F.lit(x) for kv in config.velocity_caps.items() for x in kv])
    cap = F.coalesce(F.try_element_at(caps, F.col("element_type")), F.lit(config.other_velocity_cap))
    score = S.velocity_score(cap, F.col("unique_identities_30d"), F.col("unique_identities_180d"), F.col("unique_ssns_180d"))
    return counts.withColumn("velocity_score", score)


def phone_tracker(uses: DataFrame, as_of: Column, config: EngineConfig = CONFIG) -> DataFrame:
    phones = uses.where("element_type = 'phone'")
    counts = window_counts(phones, as_of, {"identities": "identity_key", "ssns": "ssn_key", "addresses": "address_key"})
    n180, cap = F.col("unique_identities_180d"), F.lit(config.velocity_caps["phone"])
    score = S.phone_velocity_score(cap, F.col("unique_identities_30d"), n180, F.col("unique_ssns_180d"), F.col("unique_addresses_180d"))
    return counts.withColumn("is_high_velocity", n180 > cap).withColumn("velocity_score", score)


def address_tracker(uses: DataFrame, as_of: Column, config: EngineConfig = CONFIG) -> DataFrame:
    found = element_velocity(uses.where("element_type = 'address'"), as_of, config)
    return found.withColumn("is_high_velocity", F.col("unique_identities_180d") > config.velocity_caps["address"])


def latest_elements(uses: DataFrame) -> DataFrame:
    """Per identity and type, the element used last (the largest key among ties)."""
    return uses.groupBy("identity_key", "element_type").agg(F.max(F.struct("ts", "element_key"))["element_key"].alias("element_key"))


def velocity_analysis(uses: DataFrame, as_of: Column, config: EngineConfig = CONFIG, newest: DataFrame | None = None) -> DataFrame:
    """Per identity, the scores of its latest elements, the overall score, the anomalies and the level.

    ``newest`` may be the uses among which the latest are, where they can be had without sorting all.
    """
    scored = element_velocity(uses, as_of, config).select("element_type", "element_key", "velocity_score")
    own = latest_elements(uses if newest is None else newest).join(scored, ["element_type", "element_key"], "left")
    of = {t: F.coalesce(F.max(F.when(F.col("element_type") == t, F.col("velocity_score"))), F.lit(0.0)).alias(f"{t}_velocity") for t in config.velocity_weights}
    wide = own.groupBy("identity_key").agg(*of.values())
    cols = [F.col(f"{t}_velocity") for t in ("address", "phone", "email", "device")]
    anomalies = S.velocity_anomalies(*cols)
    return (
        wide.withColumn("overall_velocity_score", S.overall_velocity(*cols, config=config)).withColumn("anomalies", anomalies)
        .withColumn("risk_level", S.velocity_level(F.col("overall_velocity_score"), F.col("anomalies")))
    )


def element_history(uses: DataFrame, as_of: Column, days: int = 180) -> DataFrame:
    """Identities and ids last used within so many days, per element, with first and last use."""
    each = F.explode(F.array(F.struct(F.lit("i").alias("kind"), F.col("identity_key").alias("m")), F.struct(F.lit("s").alias("kind"), F.col("ssn_key").alias("m"))))
    last = uses.where(F.col("ts") >= before(as_of, days)).select("element_type", "element_key", "ts", each.alias("e"))
    last = last.groupBy("element_type", "element_key", "e.kind", "e.m").agg(F.max("ts").alias("last"), F.min("ts").alias("first"))
    listed = lambda k: F.sort_array(F.collect_list(F.when(F.col("kind") == k, F.col("m"))))
    return last.groupBy("element_type", "element_key").agg(
        listed("i").alias("identities"), listed("s").alias("ssns"), F.min("first").alias("first_seen"), F.max("last").alias("last_seen")
    )


def last_use_per_identity(uses: DataFrame, as_of: Column, days: int = 180) -> DataFrame:
    recent = uses.where(F.col("ts") >= before(as_of, days))
    return recent.groupBy("element_type", "element_key", "identity_key").agg(F.max("ts").alias("last_use"))


def linked_addresses(uses: DataFrame, as_of: Column, days: int = 180, least: int = 2, max_fanout: int = CONFIG.max_fanout) -> DataFrame:
    """Pairs of addresses with at least ``least`` identities in common, whatever the number of addresses of an identity.

    An address of fewer than ``least`` identities is in no such pair and goes first. The addresses of an identity with
    more than ``max_fanout`` of them are paired in blocks of that size.
    """
    pairs = uses.where((F.col("element_type") == "address") & (F.col("ts") >= before(as_of, days))).select("identity_key", "element_key").where("identity_key IS NOT NULL").distinct()
    shared = pairs.groupBy("element_key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("element_key")
    both = block_pairs(pairs.join(shared, "element_key"), ["identity_key"], "element_key", max_fanout)
    return (
        both.groupBy(F.col("src").alias("address_a"), F.col("dst").alias("address_b"))
        .agg(F.count(F.lit(1)).alias("shared_identities")).where(F.col("shared_identities") >= least)
    )


def retention(uses: DataFrame, as_of: Column, days: int, parts: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Uses that stay, and per element how many identities no longer have any; ``parts`` as for ``pair_writes``."""
    cutoff = before(as_of, days)
    kept = uses.where(F.col("ts") > cutoff)
    last = _dealt(uses, parts).groupBy("element_type", "element_key", "identity_key").agg(F.max("ts").alias("last"))
    removed = last.groupBy("element_type", "element_key").agg(F.count_if(F.col("last") <= cutoff).alias("removed"), F.count_if(F.col("last") > cutoff).alias("kept"))
    return kept, removed


def pair_writes(uses: DataFrame, parts: int | None = None) -> DataFrame:
    """What repeated upserts of (identity, element) leave: first and last use and the number of uses.

    Nearly every use is a pair of its own, so summing up before the shuffle only takes memory. With ``parts``, uses are
    dealt over so many tasks and summed up there.
    """
    return _dealt(uses, parts).groupBy("identity_key", "element_type", "element_key").agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count(F.lit(1)).alias("uses"))


def _dealt(uses: DataFrame, parts: int | None) -> DataFrame:
    return uses.repartition(parts, "identity_key", "element_type", "element_key") if parts else uses


def fanout(uses: DataFrame) -> DataFrame:
    """Per type, uses and distinct elements and identities: each is brought down to its keys for itself, so no use is
    repeated once for every distinct count."""
    elements = uses.groupBy("element_type", "element_key").agg(F.count(F.lit(1)).alias("n")).groupBy("element_type").agg(F.sum("n").alias("uses"), F.count("element_key").alias("elements"))
    identities = uses.groupBy("element_type", "identity_key").agg(F.lit(1)).groupBy(F.col("element_type").alias("of_type")).agg(F.count("identity_key").alias("identities"))
    return elements.join(identities, F.col("element_type").eqNullSafe(F.col("of_type"))).drop("of_type")
