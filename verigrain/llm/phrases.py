"""Collocations by hierarchical pair naming.

Texts become blocks of some MB: sequences of block-local codes, each with the list of what its codes stand for. On
level 1 a code stands for a word, on level k for a phrase of k words. A level goes so:

1. Each block counts its distinct units; the counts are summed over all blocks. Units of at least ``min_count`` are
   frequent; each gets a global id. On level k a unit is a pair of adjacent (k-1)-grams, that is two of their ids
   which overlap in all but one word, so its two parts are its parent pointers.
2. The ids are joined back to the blocks' lists, and the blocks' sequences are written over frequent units alone.
   A phrase can only be frequent if both of its parents are, so what falls out is needed on no later level.
3. Two adjacent pairs are three ids, so the next level is counted from the same sequences; a bitmap of the frequent
   pairs spares what cannot be frequent. Of what is, the two pairs are replaced by their global ids, with one join of
   distinct units. So blocks are rewritten only for the level after the next.

The pointers give all else: prefixes of a phrase are those of its left parent and the phrase itself, endings those of
its right parent, so the counts of both sides of every cut come with two joins a level; and a phrase lies inside a
frequent longer one exactly if it is a parent of a frequent phrase of one word more.

Rows that are shuffled are distinct units of blocks, not occurrences; Python handles one block at a time.
"""

from __future__ import annotations

import string
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verigrain.llm.columns import SALTS, bitmap_of, bits_for, text_or_empty, with_bitmap_flag
from verigrain.llm.token_files import shared_folder
from verigrain.plans.durable import batches_of, durable, settings

#: Bytes of text of a block.
BLOCK_BYTES = 8 << 20
#: What a task holds of texts whose blocks are not full yet.
HELD_BYTES = 2 * BLOCK_BYTES
#: Texts sent to a Python worker at once, and blocks.
BATCH_ROWS, BATCH_BLOCKS = 500, 1
#: Bytes that end a piece.
_ENDS = b".,;:!?\n\x0b\x0c\r"
#: Lower-cases A-Z, turns ends of pieces into line feeds and tabs into blanks.
_BYTES = bytes(10 if b in _ENDS else 32 if b == 9 else ord(chr(b).lower()) if chr(b) in string.ascii_uppercase else b for b in range(256))


def _cuts(text: bytes) -> Iterator[bytes]:
    """``text`` (translated) in parts of about a block, cut at ends of pieces only."""
    at = 0
    while len(text) - at > BLOCK_BYTES:
        end = text.rfind(b"\n", at, at + BLOCK_BYTES)
        if end <= at:
            end = text.find(b"\n", at + BLOCK_BYTES)
        if end < 0:
            break
        yield text[at:end]
        at = end + 1
    yield text[at:]


def coded(raw: bytes) -> tuple[np.ndarray, pa.Array]:
    """The words of ``raw`` (translated) in order, as 2 * code + 1 for the last of a piece and 2 * code else; the words."""
    data = np.frombuffer(raw, np.uint8)
    end = data == 10
    blank = end | (data == 32)
    first = ~blank
    first[1:] &= blank[:-1]
    begin = np.flatnonzero(first)
    edges = np.append(np.cumsum(~blank)[begin] - 1, len(data) - np.count_nonzero(blank)).astype(np.int64)
    words = pa.LargeStringArray.from_buffers(len(begin), pa.py_buffer(edges), pa.py_buffer(data[~blank].tobytes())).dictionary_encode()
    piece = np.cumsum(end)[begin]
    last = np.ones(len(begin), np.uint32)
    last[:-1] = piece[1:] != piece[:-1]
    return words.indices.to_numpy().astype(np.uint32) * 2 + last, words.dictionary


def adjacent(seq: np.ndarray, units: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs of neighbours in ``seq`` (left codes, right codes, counts) and their own sequence of codes."""
    at = np.flatnonzero(seq[:-1] % 2 == 0) if len(seq) else np.zeros(0, int)
    code = seq.astype(np.int64) // 2
    met, place, counts = np.unique(code[at] * max(units, 1) + code[at + 1], return_inverse=True, return_counts=True)
    last = np.ones(len(at), np.uint32)
    last[:-1] = at[1:] != at[:-1] + 1
    return met // max(units, 1), met % max(units, 1), counts, place.astype(np.uint32) * 2 + last


def only(seq: np.ndarray, units: int, codes: np.ndarray) -> np.ndarray:
    """``seq`` over the units ``codes`` alone, which are counted from 0 in their order; what lay next to others is last."""
    new = np.full(max(units, 1), -1, np.int64)
    new[codes] = np.arange(len(codes))
    found = new[seq // 2]
    kept = found >= 0
    last = seq % 2 == 1
    last[:-1] |= ~kept[1:]
    return (found[kept] * 2 + last[kept]).astype(np.uint32)


def stored(seq: np.ndarray) -> bytes:
    return zstandard.compress(seq.astype("<u4").tobytes(), 1)


def restored(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data), "<u4")


def _list(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.array([values], pa.list_(kind))


def _blocks(docs: DataFrame) -> DataFrame:
    """block, lang, seq (see ``coded``), words and counts."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[bytes]] = defaultdict(list)
        sizes: dict[str, int] = defaultdict(int)
        numbers = iter(range(TaskContext.get().partitionId() << 33, 1 << 62))

        def block(lang: str) -> pa.RecordBatch:
            seq, words = coded(b"\n".join(held.pop(lang)))
            del sizes[lang]
            counts = np.bincount(seq // 2, minlength=len(words))
            lists = pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words.cast(pa.string()))
            arrays = [pa.array([next(numbers)]), pa.array([lang]), pa.array([stored(seq)], pa.binary()), lists, _list(counts, pa.int64())]
            return pa.RecordBatch.from_arrays(arrays, ["block", "lang", "seq", "words", "counts"])

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                for part in _cuts(text.as_py().translate(_BYTES)):
                    held[lang].append(part)
                    sizes[lang] += len(part) + 1
                    if sizes[lang] >= BLOCK_BYTES:
                        yield block(lang)
                if sum(sizes.values()) >= HELD_BYTES:
                    yield from map(block, list(held))
        yield from map(block, list(held))

    return docs.mapInArrow(cut, "block bigint, lang string, seq binary, words array<string>, counts array<bigint>")


def _over_frequent(named: DataFrame, level: int) -> DataFrame:
    """block, seq over frequent units and their ids, from blocks with codes and ids of what is frequent in them."""

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                codes, ids = np.array(row["codes"], np.int64), np.array(row["ids"], np.int64)
                seq, units = restored(row["seq"]), row["units"]
                if level > 1:
                    left, _, _, seq = adjacent(seq, units)
                    units = len(left)
                arrays = [pa.array([row["block"]]), pa.array([stored(only(seq, units, codes))], pa.binary()), _list(ids, pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, ["block", "seq", "ids"])

    return named.mapInArrow(narrow, "block bigint, seq binary, ids array<bigint>")


def _pairs(state: DataFrame) -> DataFrame:
    """block, code, left, right, n: the distinct adjacent pairs of each block, by the global ids of their parts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, seq, ids in zip(*(c.to_pylist() for c in batch.columns[:2]), batch.column(2), strict=True):
                ids = ids.values.to_numpy()
                left, right, n, _ = adjacent(restored(seq), len(ids))
                arrays = [np.full(len(left), block), np.arange(len(left)), ids[left], ids[right], n]
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()) for a in arrays], ["block", "code", "left", "right", "n"])

    return state.select("block", "seq", "ids").mapInArrow(count, "block bigint, code bigint, left bigint, right bigint, n bigint")


def hashes(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """What the SQL function xxhash64 makes of two bigints."""
    # The primes of XXH64.
    p1, p2, p3, p4, p5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turned = lambda x, n: (x << np.uint64(n)) | (x >> np.uint64(64 - n))
    seed = np.full(len(left), 42, np.uint64)
    for value in (left, right):
        h = (seed + p5 + np.uint64(8)) ^ (turned(value.astype(np.int64).view(np.uint64) * p2, 31) * p1)
        h = turned(h, 27) * p1 + p4
        h = (h ^ (h >> np.uint64(33))) * p2
        h = (h ^ (h >> np.uint64(29))) * p3
        seed = h ^ (h >> np.uint64(32))
    return seed


def _bitmap(pairs: DataFrame, bits: int) -> np.ndarray:
    """The bits of the pairs' hashes, as bytes (see ``_places``): at most 8 MiB on the driver."""
    out = np.zeros((1 + (bits >> 15), 4096), np.uint8)
    for bucket, some in bitmap_of(pairs, F.xxhash64("left", "right"), bits).collect():
        part = np.frombuffer(some, np.uint8)
        out[bucket, : len(part)] = part
    return out.ravel()


def _places(hashed: np.ndarray, bits: int) -> np.ndarray:
    """Where Spark's bitmap functions keep these hashes: bucket 0 has the number 0 alone, the others follow."""
    place = (hashed & np.uint64(bits - 1)).astype(np.int64)
    return np.where(place > 0, place + 32767, 0)


def _triples(state: DataFrame, frequent: DataFrame) -> DataFrame:
    """a, b, c, n: in each block the distinct adjacent pairs of pairs, those that may be of ``frequent`` ones."""
    bits = bits_for(frequent.count())
    sent = state.sparkSession.sparkContext.broadcast(_bitmap(frequent, bits))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = sent.value
        for batch in batches:
            for seq, ids in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = ids.values.to_numpy()
                left, right, _, pairs = adjacent(restored(seq), len(ids))
                place = _places(hashes(ids[left], ids[right]), bits)
                codes = np.flatnonzero(met[place >> 3] >> (place & 7).astype(np.uint8) & 1)
                first, second, n, _ = adjacent(only(pairs, len(left), codes), len(codes))
                left, right = ids[left[codes]], ids[right[codes]]
                arrays = [left[first], right[first], right[second], n]
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()) for a in arrays], ["a", "b", "c", "n"])

    return state.select("seq", "ids").mapInArrow(count, "a bigint, b bigint, c bigint, n bigint")


def _written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder: compressed, and read by column."""
    spark = df.sparkSession
    folder = shared_folder(spark, "phrases")
    df.write.option("compression", "zstd").parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def _by_block(found: DataFrame) -> DataFrame:
    """codes and ids of the frequent units of each block, at most as many as the block has."""
    pairs = F.sort_array(F.collect_list(F.struct("code", "id")))
    return found.groupBy("block").agg(pairs.alias("u")).select("block", F.col("u.code").alias("codes"), F.col("u.id").alias("ids"))


def frequent_phrases(docs: DataFrame, min_count: int, max_words: int, lang_col: str = "lang", text_col: str = "text") -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """Words in all of each lang (lang, n), the frequent words (id, text), and a table for each number of words.

    Those have id, lang, f, words (their ids), starts (counts of the first 1, 2, ... words), ends (of the last 1, 2, ...
    words), left and right (the parents' ids; null on level 1).
    """
    spark = docs.sparkSession
    with batches_of(spark, BATCH_ROWS):
        blocks = _written(_blocks(docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")), text_or_empty(text_col))))
    total = blocks.groupBy("lang").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda s, x: s + x)).alias("n"))
    words = blocks.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("w")).groupBy("lang", F.col("w.words").alias("text")).agg(F.sum("w.counts").alias("f"))
    named = _written(words.where(F.col("f") >= min_count).withColumn("id", F.monotonically_increasing_id()))
    nothing = F.lit(None).cast("bigint")
    levels = [named.select("id", "lang", "f", F.array("id").alias("words"), F.array("f").alias("starts"), F.array("f").alias("ends"), nothing.alias("left"), nothing.alias("right"))]
    with batches_of(spark, BATCH_BLOCKS):
        units = blocks.select("block", "lang", F.posexplode("words").alias("code", "text")).join(named.select("lang", "text", "id"), ["lang", "text"])
        parts = blocks.select("block", "seq", F.size("words").alias("units")).join(_by_block(units), "block")
        state = _written(_over_frequent(parts, 1))
        frequent = None
        for level in range(2, max_words + 1):
            if level == 2:
                sums = _pairs(state).groupBy("left", "right").agg(F.sum("n").alias("f")).where(F.col("f") >= min_count)
            else:
                if level > 3:
                    state = _written(_over_frequent(_named_pairs(state, shorter), level - 2))
                sums = _triples(state, frequent).groupBy("a", "b", "c").agg(F.sum("n").alias("f")).where(F.col("f") >= min_count)
                ids = frequent.select("left", "right", "id")
                sums = sums.join(ids.toDF("a", "b", "left"), ["a", "b"]).join(ids.toDF("b", "c", "right"), ["b", "c"]).select("left", "right", "f")
            shorter, frequent = frequent, _written(sums.withColumn("id", F.monotonically_increasing_id()))
            levels.append(_written(_described(frequent, levels[-1])))
    return total, named.select("id", "text"), levels


def _named_pairs(state: DataFrame, frequent: DataFrame) -> DataFrame:
    """Blocks with codes and ids of their frequent pairs."""
    key, bits = F.xxhash64("left", "right"), bits_for(frequent.count())
    hopeful = with_bitmap_flag(_pairs(state).drop("n"), key, bitmap_of(frequent, key, bits), "met", bits).where("met").drop("met")
    found = hopeful.join(frequent.select("left", "right", "id"), ["left", "right"])
    return state.select("block", "seq", F.size("ids").alias("units")).join(_by_block(found), "block")


def _described(frequent: DataFrame, shorter: DataFrame) -> DataFrame:
    left = shorter.select(F.col("id").alias("left"), "lang", F.col("words").alias("head"), "starts")
    right = shorter.select(F.col("id").alias("right"), F.col("words").alias("rest"), "ends")
    return frequent.join(left, "left").join(right, "right").select(
        "id", "lang", "f", F.concat("head", F.slice("rest", -1, 1)).alias("words"), F.concat("starts", F.array("f")).alias("starts"),
        F.concat("ends", F.array("f")).alias("ends"), "left", "right",
    )


def _spelled(rows: DataFrame, names: DataFrame) -> DataFrame:
    """``rows`` with phrase in place of words, the ids of its words."""
    placed = rows.select("lang", "words", F.posexplode("words").alias("place", "id")).join(names, "id")
    texts = placed.groupBy("words").agg(F.array_sort(F.collect_list(F.struct("place", "text"))).alias("t"))
    return rows.join(texts, "words").withColumn("phrase", F.array_join(F.col("t.text"), " ")).drop("words", "t")


def _cut(words: int) -> Column:
    """The lowest-scoring cut: score, l and r; the first of several. Decimals of 38 digits: exact for counts below 10**13."""
    square = (F.col("f").cast("decimal(19,0)") * F.col("f").cast("decimal(19,0)")).cast("decimal(26,0)")
    cuts = []
    for k in range(1, words):
        l, r = F.col("starts")[k - 1], F.col("ends")[words - k - 1]
        score = F.call_function("div", square * F.lit(10**6).cast("decimal(7,0)"), l.cast("decimal(19,0)") * r.cast("decimal(19,0)"))
        cuts.append(F.struct(score.alias("score"), F.lit(k).alias("k"), l.alias("l"), r.alias("r")))
    return cuts[0] if len(cuts) == 1 else F.least(*cuts)


def mine_phrases(docs: DataFrame, min_count: int = 10, max_words: int = 3, top: int = 2000, cover: int = 50, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """The ``top`` phrases of each lang: lang, rank, phrase, a, l, r, n, score, parent pointers resolved.

    Phrases of 2 to ``max_words`` words that occur ``min_count`` times within pieces. The score floor(10**6 a a / (l r))
    is that of the lowest-scoring cut. A phrase is dropped if a longer frequent one that holds it has ``cover`` percent
    of its occurrences. Order: score and a descending, phrase ascending by its UTF-8 bytes.

    A-Z are lower-cased. Null lang is ``und``; null, empty and blank texts have no words; repeated rows count as often
    as they occur; texts of any length are cut at ends of pieces only. An empty table gives an empty result. Other
    columns are ignored.
    """
    total, names, levels = frequent_phrases(docs, min_count, max_words, lang_col, text_col)
    found = None
    for words, table in enumerate(levels[1:], 2):
        rows = table.select("id", "lang", "words", F.col("f").alias("a"), _cut(words).alias("c"))
        if words < max_words:
            longer = levels[words].select(F.explode(F.array("left", "right")).alias("id"), "f").groupBy("id").agg(F.max("f").alias("longer"))
            rows = rows.join(longer, "id", "left").where(f"longer IS NULL OR 100 * longer < {cover} * a").drop("longer")
        rows = rows.select("lang", "words", "a", "c.l", "c.r", "c.score")
        found = rows if found is None else found.unionByName(rows)
    # Each task keeps the first of each lang and salt before the rest meets, and so does each salt of a lang. Texts are
    # wanted for the order of ties only, so they are looked up for what is first without them, ties and all.
    order = [F.desc("score"), F.desc("a")]
    spark = docs.sparkSession
    with settings(spark, spark__sql__optimizer__windowGroupLimitThreshold=str(top)):
        salted = found.withColumn("salt", F.pmod(F.xxhash64("words"), F.lit(SALTS)))
        for by in (["lang", "salt"], ["lang"]):
            salted = salted.withColumn("rank", F.rank().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= top)
        first = _spelled(_written(salted.drop("salt", "rank")), names)
        best = durable(first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order, "phrase"))).where(F.col("rank") <= top))
    return best.join(total, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
