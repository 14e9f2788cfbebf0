"""N-gram Jaccard self-join by universe partition and the pigeonhole principle.

Each document is the set of its hashed word n-grams. Two sets of sizes a and b whose Jaccard similarity reaches t
differ in at most H = (a + b)(1 - t)/(1 + t) elements. The universe of hashes is cut into more than H segments, so a
document with u non-empty segments has at least u - H of them in common with every partner, element for element.
Sizes fall into bands, and a band's pool (its own documents and those of the next band) has its own segments.

Cost-based allocation: a document may give up as many of its segments as it has beyond H + 1. It gives up those
whose subset most documents have; the order is the same for all, so the rarest subset that two partners share is
given up by neither. A document that shares no more subsets with others than it may give up has no partner at all.
One with fewer than H + 1 non-empty segments cannot rely on equal subsets; between two such documents, one-deletion
neighbourhoods (a segment's subset without any one element) find segments that differ in one element, and where
even those are too few, single elements do.

Candidates are verified on the whole sets. Documents with equal sets are one class from the start. Classes that share
a subset are tested against one pivot, then only classes that are not yet connected are paired, so a large group of
copies costs a few tests for each member and not one for each pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from verigrain.llm.columns import bitmap_of, with_bitmap_flag
from verigrain.llm.textkit import HashOf, as_bytes
from verigrain.operators.components import connected_components
from verigrain.plans.durable import batches_of, discard, durable

_U = np.uint64
_ODD = tuple(map(_U, (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)))
DOCS_AT_A_TIME = 256
CLASSES_AT_A_TIME, SIGNATURES_AT_A_TIME = 1 << 10, 400_000
PIVOT_ROUNDS = 2
BATCH_ROWS = 2000
#: Beside the bin, which the leading bits choose: bins grow with the input, so chance meetings in a bin stay rare.
_SIG_BITS = 36


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


class Shingles:
    """Sorted distinct hashes of a text's word n-grams; of all its words if they are fewer than n."""

    def __init__(self, n: int):
        self.n, self.hash = n, HashOf(limit=200_000)

    def __call__(self, text: bytes) -> np.ndarray:
        h = self.hash.all(text.lower().split())
        n = min(self.n, len(h))
        if not n:
            return h
        s = np.full(len(h) - n + 1, n, _U) * _ODD[0]
        for k in range(n):
            s = (s ^ (s >> _U(29))) * _ODD[1] + h[k : len(h) - n + 1 + k] * _ODD[k % 5]
        return np.unique(mix(s))


class Bands:
    """Size bands and their pools' segments for a Jaccard threshold of num / den."""

    def __init__(self, num: int, den: int, largest: int = 1 << 26):
        self.num, self.den = num, den
        self.lows = [1]
        while self.lows[-1] <= largest:
            self.lows.append(self.lows[-1] * den // num + 1)
        self.segments = []
        for high in self.lows[1:]:
            need = self.differ(high - 1, (high - 1) * den // num) + 1
            self.segments.append(max(need + (2 * need + 4) // 5, min(2 * high, 64)))

    def differ(self, a: int, b: int) -> int:
        return (a + b) * (self.den - self.num) // (self.den + self.num)

    def pools(self, size: int) -> list[tuple[int, int, int]]:
        """(kind, pool, most elements in which a partner of that pool differs) for a set of ``size``."""
        band = int(np.searchsorted(self.lows, size, "right")) - 1
        out = [(0, band, self.differ(size, size * self.den // self.num))]
        below = self.lows[band] - 1
        if band and below * self.den >= size * self.num:
            out.append((1, band - 1, self.differ(size, below)))
        return out

    def lonely(self, size: int) -> bool:
        """No other size, and no other set of this size, can reach the threshold."""
        return size * self.den // self.num == size and self.differ(size, size) < 2


def class_key(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, as two signed numbers."""
    a = int(mix(s * _ODD[2]).sum(dtype=_U)) ^ len(s) * int(_ODD[3])
    b = int(mix(s ^ _ODD[4]).sum(dtype=_U)) ^ len(s)
    return tuple(((x & (1 << 64) - 1) ^ (1 << 63)) - (1 << 63) for x in (a, b))


def signatures(s: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Signatures of a set, their kinds (0 own band's pool, 1 the pool below, 2 short of segments), and how many
    signatures of kinds 0 and 1 the set may give up."""
    found, kinds, slack = [], [], [0, 0]
    weight = mix(s ^ _ODD[0])
    for kind, pool, differ in bands.pools(len(s)):
        m = bands.segments[pool]
        segment = (s >> _U(32)) * _U(m) >> _U(32)  # s is sorted, and so are its segments
        starts = np.concatenate([[0], np.flatnonzero(np.diff(segment)) + 1])
        place = segment[starts] + _U(pool) * _U(1 << 40)
        sums = np.add.reduceat(weight, starts)
        found.append(mix(sums ^ mix(place)))
        kinds.append(np.full(len(starts), kind, np.uint8))
        slack[kind] = max(len(starts) - differ - 1, 0)
        if len(starts) > differ:
            continue
        sizes = np.diff(np.append(starts, len(s)))
        wide = np.repeat(sizes > 1, sizes)
        without = (np.repeat(sums, sizes) - weight)[wide]
        tagged = mix(place + _U(1 << 62))
        short = [mix(sums ^ tagged), mix(without ^ np.repeat(tagged, sizes)[wide])]
        if len(starts) + int((sizes > 1).sum()) <= differ:
            short.append(mix(weight ^ mix(np.full(len(s), _U(pool) + _U(1 << 61)))))
        found += short
        kinds.append(np.full(sum(map(len, short)), 2, np.uint8))
    return np.concatenate(found), np.concatenate(kinds), slack


def bin_keys(spark: SparkSession, bins: int) -> list[int]:
    """A number for each bin that Spark's hash deals to the bin's own partition."""
    part = F.pmod(F.hash(F.col("id").cast("int")), F.lit(bins))
    found = spark.range(bins * 40 + 1000).groupBy(part.alias("part")).agg(F.min("id").alias("key")).collect()  # one row for each bin
    keys = {r["part"]: r["key"] for r in found}
    return [keys.get(b, bins * 40 + 1000 + b) for b in range(bins)]


def _packed(held: list[tuple[int, np.ndarray, np.ndarray, list[int]]], keys_of_bins: list[int]) -> list[tuple[int, bytes, bytes, bytes]]:
    """A row for each bin: its signatures with kind and owner (six bytes each), and the owners' keys and allowances."""
    bins = len(keys_of_bins)
    keys, slacks = np.array([h[0] for h in held], np.int64), np.minimum([h[3] for h in held], 0xFFFF).astype(np.uint16)
    sig = np.concatenate([h[1] for h in held])
    who = np.repeat(np.arange(len(held), dtype=np.uint16), [len(h[1]) for h in held])
    kind = np.concatenate([h[2] for h in held])
    into = ((sig >> _U(48)) * _U(bins) >> _U(16)).astype(np.uint16)
    order = np.argsort(into, kind="stable")
    cuts = np.searchsorted(into[order], np.arange(bins + 1))
    out = []
    for b in range(bins):
        part = order[cuts[b] : cuts[b + 1]]
        if len(part):
            used, local = np.unique(who[part], return_inverse=True)
            entry = (sig[part] & _U((1 << _SIG_BITS) - 1)) << _U(12) | kind[part].astype(_U) << _U(10) | local.astype(_U)
            six = np.ascontiguousarray(entry.view(np.uint8).reshape(-1, 8)[:, :6])
            out.append((keys_of_bins[b], six.tobytes(), keys[used].tobytes(), slacks[used].tobytes()))
    return out


def packed_signatures(docs: DataFrame, id_col: str, text_col: str, n: int, bands: Bands, bins: list[int]) -> DataFrame:
    """Two kinds of rows from one reading of the texts.

    With bin -1: row_id, size (distinct n-grams), ka and kb (the class of equal sets) of every document. With a bin
    from 0 on: all signatures that a batch's classes have in that bin, packed into entries, keys and slack.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(n)
        for batch in batches:
            schema = pa.schema([
                ("bin", pa.int32()), ("entries", pa.binary()), ("keys", pa.binary()), ("slack", pa.binary()),
                ("row_id", batch.schema.field(0).type), ("size", pa.int64()), ("ka", pa.int64()), ("kb", pa.int64()),
            ])

            def made(columns: dict, schema: pa.Schema = schema) -> pa.RecordBatch:
                rows = len(next(iter(columns.values())))
                return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(rows, f.type) for f in schema], schema=schema)

            held, count, seen, classes = [], 0, set(), []
            for at in range(0, batch.num_rows, DOCS_AT_A_TIME):
                for text in as_bytes(batch.column(1).slice(at, DOCS_AT_A_TIME)):
                    s = shingles(text)
                    key = class_key(s)
                    classes.append((len(s), *key))
                    if not len(s) or bands.lonely(len(s)) or key in seen:
                        continue
                    seen.add(key)
                    held.append((key[0], *signatures(s, bands)))
                    count += len(held[-1][1])
                    if count > SIGNATURES_AT_A_TIME or len(held) == CLASSES_AT_A_TIME:
                        yield made(dict(zip(("bin", "entries", "keys", "slack"), zip(*_packed(held, bins), strict=True), strict=True)))
                        held, count = [], 0
            if held:
                yield made(dict(zip(("bin", "entries", "keys", "slack"), zip(*_packed(held, bins), strict=True), strict=True)))
            if classes:
                size, ka, kb = zip(*classes, strict=True)
                yield made({"bin": [-1] * len(classes), "row_id": batch.column(0), "size": size, "ka": ka, "kb": kb})

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(
        pack, f"bin int, entries binary, keys binary, slack binary, row_id {kind}, size bigint, ka bigint, kb bigint"
    )


def shared_signatures(table: pa.Table) -> pa.Table:
    """ka, kind, sig, sharers, slack of the signatures in a bin that at least two classes have."""
    bins = table.column("bin").to_pylist()
    parts = [[], [], [], []]
    for entries, keys, slack in zip(*(table.column(c).to_pylist() for c in ("entries", "keys", "slack")), strict=True):
        wide = np.zeros((len(entries) // 6, 8), np.uint8)
        wide[:, :6] = np.frombuffer(entries, np.uint8).reshape(-1, 6)
        e = wide.view(_U).ravel()
        who, kind = (e & _U(0x3FF)).astype(np.int64), (e >> _U(10) & _U(3)).astype(np.int64)
        allowed = np.frombuffer(slack, np.uint16).astype(np.int64).reshape(-1, 2)[who, np.minimum(kind, 1)] * (kind < 2)
        for part, x in zip(parts, (e >> _U(12), np.frombuffer(keys, np.int64)[who], kind, allowed), strict=True):
            part.append(x)
    sig, key, kind, slack = map(np.concatenate, parts)
    order = np.argsort(sig)
    same = np.diff(sig[order]) == 0
    some = order[np.concatenate([same, [False]]) | np.concatenate([[False], same])]
    sig, key, kind, slack = sig[some], key[some], kind[some], slack[some]
    order = np.lexsort((kind, key, sig))
    sig, key, kind, slack = sig[order], key[order], kind[order], slack[order]
    first = np.ones(len(sig), bool)
    first[1:] = (np.diff(sig) != 0) | (np.diff(key) != 0)
    sig, key, kind, slack = sig[first], key[first], kind[first], slack[first]
    _, back, sharers = np.unique(sig, return_inverse=True, return_counts=True)
    n = sharers[back]
    sig, key, kind, slack, n = sig[n > 1], key[n > 1], kind[n > 1], slack[n > 1], n[n > 1]
    whole = sig.astype(np.int64) << 24 | (bins[0] if bins else 0)
    return pa.table({"ka": key, "kind": kind.astype(np.int32), "sig": whole, "sharers": n.astype(np.int64), "slack": slack.astype(np.int64)})


def candidate_groups(packed: DataFrame) -> DataFrame:
    """(sig, ka): classes under the signatures that they share and neither gives up."""
    bins = packed.where("bin >= 0").select("bin", "entries", "keys", "slack")
    shared = bins.groupBy("bin").applyInArrow(shared_signatures, "ka bigint, kind int, sig bigint, sharers bigint, slack bigint")
    rank = F.row_number().over(Window.partitionBy("ka", "kind").orderBy(F.desc("sharers"), "sig"))
    kept = durable(shared.withColumn("rank", rank).where("rank > slack").select("sig", "ka").distinct())
    # Near copies share many signatures; of those with the same members one says it all.
    members = [F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("ka")).alias("x"), F.sum(F.xxhash64("ka", F.lit(1)).cast("decimal(38,0)")).alias("s")]
    distinct = durable(kept.groupBy("sig").agg(*members).where("n > 1").groupBy("n", "x", "s").agg(F.min("sig").alias("sig")).select("sig"))
    return durable(kept.join(distinct, "sig", "left_semi"))


_SKETCH_LONGS = 8


def node_of_class() -> Column:
    """ka and kb as 16 bytes."""
    return F.concat(*[F.unhex(F.lpad(F.hex(k), 16, "0")) for k in ("ka", "kb")])


def parity_sketch(s: np.ndarray) -> np.ndarray:
    """512 bits as eight numbers. Bit k is the parity of the elements that hash to k, so two sets differ in at least
    as many elements as their sketches differ in bits."""
    parity = np.bincount((s >> _U(55)).astype(np.int64), minlength=64 * _SKETCH_LONGS).astype(np.uint8) & 1
    return np.packbits(parity).view(np.int64)


def sketch_distance(a: Column, b: Column) -> Column:
    out = F.lit(0)
    for k in range(_SKETCH_LONGS):
        out = out + F.bit_count(a[f"s{k}"].bitwiseXOR(b[f"s{k}"]))
    return out


def hopeful(a: str, b: str, num: int, den: int) -> Column:
    """Whether sizes and sketches of two sides, which bound their similarity from above, leave a chance of a link."""
    x, y = F.col(f"{a}_size"), F.col(f"{b}_size")
    near = sketch_distance(F.col(f"{a}_sketch"), F.col(f"{b}_sketch")) * (den + num) <= (x + y) * (den - num)
    return (F.least(x, y) * den >= F.greatest(x, y) * num) & near


def _sketches(sets: list[np.ndarray]) -> pa.StructArray:
    table = np.array([parity_sketch(s) for s in sets], np.int64).reshape(-1, _SKETCH_LONGS)
    return pa.StructArray.from_arrays([pa.array(table[:, k]) for k in range(_SKETCH_LONGS)], [f"s{k}" for k in range(_SKETCH_LONGS)])


def class_sets(docs: DataFrame, classes: DataFrame, wanted: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """ka, node (16 bytes), size, sketch and hashes (array<bigint>) of the classes whose ka is ``wanted``.

    Each is read from its smallest document. A fixed-size bitmap of those ids keeps all other texts out of Python.
    """
    chosen = classes.join(wanted, "ka", "left_semi").select("row_id")
    flagged = with_bitmap_flag(
        docs.select(F.col(id_col).alias("row_id"), F.col(text_col).alias("text")), F.xxhash64("row_id"), bitmap_of(chosen, F.xxhash64("row_id")), "chosen"
    )

    # Not a column function: the planner would copy one below the filter, to test it for null on every document.
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(n)
        for batch in batches:
            found = [shingles(t) for t in as_bytes(batch.column(0))]
            keys = [class_key(s) for s in found]
            ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
            flat = np.concatenate([*found, np.zeros(0, _U)]).view(np.int64)
            yield pa.RecordBatch.from_arrays([
                pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.array([len(s) for s in found], pa.int64()),
                _sketches(found), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)),
            ], ["ka", "kb", "size", "sketch", "hashes"])

    sketch = ",".join(f"s{k}:bigint" for k in range(_SKETCH_LONGS))
    found = flagged.where("chosen").select("text").mapInArrow(sets, f"ka bigint, kb bigint, size bigint, sketch struct<{sketch}>, hashes array<bigint>")
    found = found.join(wanted, "ka", "left_semi").dropDuplicates(["ka", "kb"])
    return durable(found.select("ka", node_of_class().alias("node"), "size", "sketch", "hashes"))


def _side(sets: DataFrame, end: str, *columns: str) -> DataFrame:
    return sets.select(F.col("node").alias(end), *[F.col(c).alias(f"{end}_{c}") for c in columns])


def verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The links among ``pairs`` (a, b: nodes), by exact comparison of their sets."""

    @arrow_udf("boolean")
    def similar(left: pa.Array, right: pa.Array) -> pa.Array:
        out = []
        for x, y in zip(left, right, strict=True):
            x, y = x.values.to_numpy(zero_copy_only=False), y.values.to_numpy(zero_copy_only=False)
            common = len(np.intersect1d(x, y, assume_unique=True))
            out.append(den * common >= num * (len(x) + len(y) - common))
        return pa.array(out, pa.bool_())

    both = pairs.join(_side(sets, "a", "hashes"), "a").join(_side(sets, "b", "hashes"), "b")
    return both.where(similar("a_hashes", "b_hashes")).select("a", "b")


def _pivots(groups: DataFrame, weight: DataFrame, turn: int) -> DataFrame:
    """For each signature the member of the largest weight; in every other round any member, by a hash."""
    order = F.when(F.lit(turn % 2 == 0), F.coalesce("w", F.lit(0).cast("long"))).otherwise(F.lit(0).cast("long"))
    best = F.max(F.struct(order.alias("w"), F.xxhash64("node", F.lit(turn)).alias("o"), "node", "comp")).alias("p")
    weighted = groups.join(weight, "node", "left") if turn % 2 == 0 else groups.withColumn("w", F.lit(0).cast("long"))
    return durable(weighted.groupBy("sig").agg(best).select("sig", F.col("p.node").alias("b"), F.col("p.comp").alias("other")))


def similarity_components(groups: DataFrame, sets: DataFrame, num: int, den: int, pivot_rounds: int = PIVOT_ROUNDS) -> DataFrame | None:
    """(node, component) over classes, from enough links to tell every component; None if there is no link.

    In a round each class is held against the pivots of its signatures, and the one of the nearest sketch is verified.
    The first pivots are the classes with the most live signatures, which are closest to what a group has in common;
    later ones are those with the most links. Classes whose signatures hold one component only drop out. What is
    left is paired in full, except where sizes and sketches rule a link out.
    """
    links, tested, state = None, None, None
    groups = durable(groups.join(sets.select("ka", "node"), "ka").select("sig", "node", F.col("node").alias("comp")))
    weight = durable(groups.groupBy("node").agg(F.count(F.lit(1)).alias("w")))
    for turn in range(pivot_rounds + 1):
        if turn < pivot_rounds:
            pivots = _pivots(groups, weight, turn)
            pairs = groups.join(pivots, "sig").where("comp <> other").select(F.col("node").alias("a"), "b").distinct()
            near = pairs.join(_side(sets, "a", "size", "sketch"), "a").join(_side(sets, "b", "size", "sketch"), "b").where(hopeful("a", "b", num, den))
            near = near.select("a", "b", sketch_distance(F.col("a_sketch"), F.col("b_sketch")).alias("far"), F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"))
            if tested is not None:
                near = near.join(tested.select(F.col("a").alias("x"), F.col("b").alias("y")), ["x", "y"], "left_anti")
            pairs = near.groupBy("a").agg(F.min(F.struct("far", "x", "y")).alias("t")).select(F.col("t.x").alias("a"), F.col("t.y").alias("b")).distinct()
        else:
            rows = groups.join(sets.select("node", "size", "sketch"), "node")
            left, right = (rows.select("sig", F.col("node").alias(e), F.col("comp").alias(f"{e}_comp"), F.col("size").alias(f"{e}_size"), F.col("sketch").alias(f"{e}_sketch")) for e in "ab")
            apart = (F.col("a") < F.col("b")) & (F.col("a_comp") != F.col("b_comp")) & hopeful("a", "b", num, den)
            pairs = left.join(right, (left["sig"] == right["sig"]) & apart).select("a", "b").distinct()
            if tested is not None:
                pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = durable(pairs)
        if pairs.isEmpty():
            continue
        tested = pairs if tested is None else durable(tested.union(pairs))
        new = durable(verified(pairs, sets, num, den))
        if new.isEmpty():
            continue
        links = new if links is None else durable(links.union(new))
        state = durable(connected_components(links, "a", "b"))
        if turn < pivot_rounds:
            groups = groups.join(state, "node", "left").select("sig", "node", F.coalesce("component", "comp").alias("comp"))
            apart = durable(groups.groupBy("sig").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("sig"))
            groups = durable(groups.join(apart, "sig", "left_semi"))
            weight = durable(links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("w")))
    return state


def ngram_jaccard_join(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: ``id_col``, n_shingles, component_id (the smallest id that links reach, its own included).

    Documents link when den * intersection >= num * union of their sets of word n-grams, after lower-casing A-Z;
    words are runs of characters other than ASCII white space. Fewer than n words make one n-gram.

    * Null or empty text, or one without words: n_shingles 0, linked with nothing, its component is itself.
    * A null id never is a component's smallest unless no member has an id.
    * Repeated rows have equal sets and so share a component. An empty table gives an empty result. Other columns
      are ignored. Whole texts count, whatever their length.
    """
    spark, bands = docs.sparkSession, Bands(num, den)
    bins = bin_keys(spark, min(1 << 15, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    docs = docs.select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("body"))
    with batches_of(spark, BATCH_ROWS):
        packed = durable(packed_signatures(docs, "doc", "body", n, bands, bins))
        rows = durable(packed.where("bin < 0").select("row_id", "size", "ka", "kb"))
        classes = durable(rows.where("size > 0").groupBy("ka", "kb").agg(F.min("row_id").alias("row_id")))
        groups = candidate_groups(packed)
        discard(packed)
        wanted = durable(groups.select("ka").distinct())
        state = None
        if not wanted.isEmpty():
            state = similarity_components(groups, class_sets(docs, classes, wanted, "doc", "body", n), num, den)
    if state is None:
        found = classes.select("ka", "kb", F.col("row_id").alias("component_id"))
    else:
        joined = durable(classes.withColumn("node", node_of_class()).join(state, "node", "left").select("ka", "kb", "row_id", "component"))
        least = joined.where("component IS NOT NULL").groupBy("component").agg(F.min("row_id").alias("least"))
        found = durable(joined.join(least, "component", "left").select("ka", "kb", F.coalesce("least", "row_id").alias("component_id")))
    placed = rows.where("size > 0").join(found, ["ka", "kb"]).select("row_id", "size", "component_id")
    alone = rows.where("size = 0").select("row_id", "size", F.col("row_id").alias("component_id"))
    return placed.union(alone).select(F.col("row_id").alias(id_col), F.col("size").alias("n_shingles"), "component_id")
