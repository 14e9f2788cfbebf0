"""Best-fit packing of token sequences, in bulk-synchronous rounds.

Documents become pieces of at most ``capacity`` tokens. Pieces and the gaps of open sequences are tables of runs: a
run of pieces has one length and consecutive ranks, a run of gaps one size and consecutive sequences. There are at
most ``capacity`` lengths, so a round handles tables of some thousand rows however many pieces there are.

In a round both tables are range-sorted by size and swept together, which tells each piece how many gaps hold it and
so its successor, the smallest gap that does. Where more pieces want gaps than there are, ranks resolve the conflict:
the longest pieces come first, and each takes the smallest gap that the others leave it. The gaps are updated by a
sweep over the sequences, written out, and the next round begins. A round admits the pieces of the longest lengths
left, as best-fit decreasing would. Pieces that no gap holds open new sequences.

What a round decides is a range of ranks per range of sequences. The pieces find their own rank, read their sequence
from those ranges and their offset from what comes before them in it, in parallel.
"""

from __future__ import annotations

import functools
import itertools
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from verigrain.llm.textkit import sliced_by_bytes
from verigrain.plans.durable import durable, settings

CAPACITY = 4096
#: A length may belong to a third of all pieces; its ranks are counted in so many shares.
RANK_SHARES = 256
#: Bytes of text that a worker encodes at a time.
BYTES_AT_A_TIME = 8 << 20
#: A round admits pieces longer than this share of the longest one left.
ADMITTED = 0.5
#: Letters that are their own composed form and have a lower case of one character: ASCII and Latin-1.
_LETTERS = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
#: ASCII marks other than the apostrophe.
_MARKS = re.compile(r"[!-&(-/:-@\[-`{-~]+")


def _byte_characters() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: its own if printable, else one from 256 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = itertools.count(256)
    return {b: chr(b if b in own else next(others)) for b in range(256)}


_CHARACTERS = _byte_characters()


@functools.cache
def loaded(path: str):
    """The tokenizer, read once in a Python worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


_BLANK = np.frombuffer(bytes(32 if b in b"\t\n\x0b\x0c\r" else b for b in range(256)), np.uint8)
_SMALL = np.frombuffer(_BLANK.tobytes().lower(), np.uint8)
_IS_LETTER, _IS_MARK = (np.array([bool(kind.fullmatch(chr(b))) if b < 128 else False for b in range(256)]) for kind in (_LETTERS, _MARKS))
#: Second bytes of the Latin-1 letters, whose first byte is 0xC3.
_IS_SECOND = np.array([0x80 <= b < 0xC0 and bool(_LETTERS.fullmatch(chr(b + 0x40))) for b in range(256)])


def _divided(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The chunks of all texts, in one array, and where each text's chunks begin (and the last ends).

    Blanks stand for ASCII white space, small letters for A-Z, and a blank is put at each border between a letter and
    a mark. Texts that may hold a special token are only divided at white space and keep their letters.
    """
    texts = pa.concat_arrays([pc.fill_null(texts.cast(pa.large_string()), "")])
    special = np.flatnonzero(pc.match_substring(texts, "<|").to_numpy(zero_copy_only=False))
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[: len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[: at[-1]] if data else np.zeros(0, np.uint8)
    small, letter, mark = _SMALL[raw], _IS_LETTER[raw], _IS_MARK[raw]
    begins, two = letter.copy(), (raw[:-1] == 0xC3) & _IS_SECOND[raw[1:]]
    letter[1:] |= two
    begins[:-1] |= two
    border = np.zeros(len(raw), bool)  # whether a blank comes before the byte
    border[1:] = (letter[:-1] & mark[1:]) | (mark[:-1] & begins[1:])
    for k in special:
        small[at[k] : at[k + 1]] = _BLANK[raw[at[k] : at[k + 1]]]
        border[at[k] : at[k + 1]] = False
    blank = small == 32
    # A chunk begins at a byte that is no blank behind a blank, a border or the start of a text.
    first = border.copy()
    first[1:] |= blank[:-1]
    first[at[:-1][at[:-1] < len(raw)]] = True
    first &= ~blank
    last = np.ones(len(raw), bool)
    last[:-1] = blank[1:] | first[1:]
    last &= ~blank
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    kept = small[~blank]
    edges = np.concatenate([[0], np.cumsum(end - begin)])
    chunks = pa.LargeStringArray.from_buffers(len(begin), pa.py_buffer(edges), pa.py_buffer(kept))
    return chunks, np.searchsorted(begin, at)


class ChunkTokens:
    """Token ids of texts, through the distinct chunks of many texts at once.

    The tokenizer's pattern never crosses white space, nor the border between a letter and an ASCII mark other than
    the apostrophe, and it lower-cases. So a text's ids are those of its chunks in order, and each distinct chunk is
    encoded once. Runs of ``_LETTERS`` or ``_MARKS`` go straight to the vocabulary's merges; every other chunk takes
    the tokenizer's whole way. A table of ids (as little-endian 32-bit bytes) keeps chunks for the next call; it is
    emptied when it holds ``limit`` of them, which changes no result.
    """

    def __init__(self, path: str, limit: int = 500_000):
        self.tokenizer, self.limit = loaded(path), limit
        self.table: dict[str, bytes] = {}

    def learn(self, chunks: list[str]) -> list[bytes]:
        if len(self.table) > self.limit:
            self.table.clear()
        table, merges, pack = self.table, self.tokenizer.model.tokenize, struct.pack
        new, hard = [c for c in chunks if c not in table], []
        for chunk in new:
            if chunk.isascii() and chunk.isalpha() and chunk.islower() or _MARKS.fullmatch(chunk):
                tokens = merges(chunk)
            elif _LETTERS.fullmatch(chunk):
                tokens = merges(chunk.lower().encode().decode("latin-1").translate(_CHARACTERS))
            else:
                hard.append(chunk)
                continue
            table[chunk] = pack(f"<{len(tokens)}I", *[t.id for t in tokens])
        for chunk, found in zip(hard, self.tokenizer.encode_batch_fast(hard, add_special_tokens=False), strict=True):
            table[chunk] = pack(f"<{len(found)}I", *found.ids)
        return [table[c] for c in chunks]

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each with ``end_id`` behind it, and where each text's ids begin (and the last ends)."""
        chunks, borders = _divided(texts)
        coded = chunks.dictionary_encode()
        learned = self.learn(coded.dictionary.to_pylist())
        size = np.fromiter(map(len, learned), np.int64, len(learned)) // 4
        ids = np.frombuffer(b"".join(learned), "<u4")
        word = coded.indices.to_numpy()
        each = size[word]
        before = np.concatenate([[0], np.cumsum(each)])
        taken = ids[np.repeat((np.cumsum(size) - size)[word] - before[:-1], each) + np.arange(before[-1])]
        starts = before[borders]
        out = np.empty(len(taken) + len(texts), np.uint32)
        out[np.arange(len(taken)) + np.repeat(np.arange(len(texts)), np.diff(starts))] = taken
        starts = starts + np.arange(len(texts) + 1)
        out[starts[1:] - 1] = end_id
        return out, starts


def token_pieces(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: ``id_col``, piece, start, length, ids_crc32 and, if asked for, ids (array<int>)."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"row_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + (", ids array<int>" if with_ids else "")

    # Not a column function under an explode: the planner would copy it into a filter and so tokenize twice.
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The table is the task's own: kept for later tasks it would hold an executor's memory for good.
        coder = ChunkTokens(tokenizer_path)
        for batch in batches:
            for some in sliced_by_bytes(batch, 1, BYTES_AT_A_TIME):
                ids, starts = coder.encode(some.column(1), end_id)
                count = np.diff(starts)
                pieces = -(-count // capacity)
                owner = np.repeat(np.arange(len(count)), pieces)
                piece = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = piece * capacity
                length = np.minimum(count[owner] - start, capacity)
                at = starts[owner] + start
                whole = memoryview(ids.astype("<u4", copy=False)).cast("B")
                crc = [zlib.crc32(whole[4 * a : 4 * b]) for a, b in zip(at.tolist(), (at + length).tolist(), strict=True)]
                arrays = [some.column(0).take(pa.array(owner)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                if with_ids:
                    arrays.append(pa.ListArray.from_arrays(pa.array(np.append(at, len(ids)), pa.int32()), pa.array(ids.view(np.int32))))
                yield pa.RecordBatch.from_arrays(arrays, ["row_id", "piece", "start", "length", "ids_crc32", "ids"][: len(arrays)])

    found = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text_")).mapInArrow(cut, schema)
    return found.withColumnRenamed("row_id", id_col)


# A round's state has two kinds of runs. Gaps (kind 0): x is the first of y sequences, each with a gap of ``at``. Pieces
# (kind 1): x are placed, y are left of length ``at``. It is kept in one part, being some thousand rows at most.

#: What the next round begins with: see ``best_fit_rounds``.
_OUTLOOK = """
SELECT max(at) AS longest, max(IF(at <= largest, at, NULL)) AS held, sum(IF(at > largest, at * y, 0)) AS tokens,
       sum(IF(at > largest AND 2 * at > {capacity}, y, 0)) AS own
FROM (SELECT *, max(IF(kind = 0, at, 0)) OVER (PARTITION BY 0) AS largest FROM {state}) WHERE kind = 1 AND y > 0"""

#: The placements of one round. A gap offers as many slots as it holds pieces of length {longest}, at least one; slots
#: count sequence by sequence, then from the first again. The sweep down the sizes tells how many slots hold a piece
#: (seen). Longest first, pieces are taken while slots that hold them are left; each then gets the last slot, so the
#: smallest gap, that leaves enough for the shorter ones (until). A second sweep, along the slots, lays both side by side.
_MATCH = """
WITH offered AS (SELECT /*+ COALESCE(1) */ * FROM (
       SELECT kind, at, x, y, IF(kind = 0, y * greatest(1, at DIV {longest}), 0) AS width FROM {state}
       WHERE kind = 0 OR (y > 0 AND at <= {longest} AND at > {admitted} * {longest})
       UNION ALL SELECT 0, {capacity}, {opened}, {new}, {new} * ({capacity} DIV {longest}) WHERE {new} > 0)),
     swept AS (SELECT *, sum(width) OVER (ORDER BY at DESC, kind, x ROWS UNBOUNDED PRECEDING) AS seen FROM offered),
     ranked AS (SELECT *, sum(y) OVER (ORDER BY at DESC ROWS UNBOUNDED PRECEDING) AS ranks FROM swept WHERE kind = 1),
     held AS (SELECT *, ranks + least(0, min(seen - ranks) OVER (ORDER BY at DESC ROWS UNBOUNDED PRECEDING)) AS taken FROM ranked),
     chosen AS (SELECT at, x, taken - lag(taken, 1, 0) OVER (ORDER BY at DESC) AS n,
                       taken + min(seen - taken) OVER (ORDER BY at ROWS UNBOUNDED PRECEDING) AS until FROM held),
     edges AS (SELECT /*+ COALESCE(1) */ * FROM (
       SELECT until - n AS place, struct(at AS length, x AS done, until - n AS since, until) AS run, NULL AS slot FROM chosen WHERE n > 0
       UNION ALL SELECT seen - width, NULL, struct(x AS first, y AS around, seen - width AS since, seen AS until) FROM swept WHERE kind = 0)),
     along AS (SELECT place, lead(place) OVER (ORDER BY place) AS next, last(run, true) OVER (ORDER BY place ROWS UNBOUNDED PRECEDING) AS run,
                      last(slot, true) OVER (ORDER BY place ROWS UNBOUNDED PRECEDING) AS slot FROM edges),
     met AS (SELECT place, run, slot, least(next, run.until, slot.until) - place AS n FROM along WHERE run IS NOT NULL AND slot IS NOT NULL)
SELECT run.length AS length, run.done + place - run.since AS first_rank, n AS count, slot.first AS first, slot.around AS around,
       (place - slot.since) % slot.around AS phase
FROM met WHERE n > 0"""

#: The state after a round: a sweep over the sequences, along the edges of gaps and placements; and what is left.
_UPDATE = """
WITH gaps AS (SELECT at, x, y FROM {state} WHERE kind = 0 UNION ALL SELECT {capacity}, {opened}, {new} WHERE {new} > 0),
     used AS (SELECT *, count DIV around AS turns, phase + count % around AS ends FROM {placed}),
     parts AS (
       SELECT x AS frm, x + y AS until, at AS by FROM gaps
       UNION ALL SELECT first, first + around, -length * turns FROM used
       UNION ALL SELECT first + phase, first + least(ends, around), -length FROM used
       UNION ALL SELECT first, first + ends - around, -length FROM used WHERE ends > around),
     edges AS (SELECT place, sum(by) AS by FROM (SELECT /*+ COALESCE(1) */ * FROM (
       SELECT frm AS place, by FROM parts UNION ALL SELECT until, -by FROM parts)) GROUP BY place),
     sizes AS (SELECT sum(by) OVER (ORDER BY place ROWS UNBOUNDED PRECEDING) AS at, place AS x, lead(place) OVER (ORDER BY place) - place AS y
               FROM edges WHERE by <> 0),
     runs AS (SELECT at, sum(x) AS x, sum(y) AS y FROM (SELECT /*+ COALESCE(1) */ * FROM (
       SELECT at, x, y FROM {state} WHERE kind = 1 UNION ALL SELECT length, count, -count FROM {placed})) GROUP BY at HAVING sum(y) > 0)
SELECT /*+ COALESCE(1) */ * FROM (SELECT 0 AS kind, at, x, y FROM sizes WHERE at > 0 UNION ALL SELECT 1, at, x, y FROM runs)"""


def best_fit_rounds(counts: DataFrame, capacity: int) -> list[DataFrame]:
    """Placements of pieces, of which ``counts`` has length and count, round by round.

    Columns: length, first_rank, count, first, around, phase. The piece of ``length`` with rank first_rank + i,
    i < count, goes to sequence first + (phase + i) % around. The driver sees four numbers of each round. Every round
    places a piece, and about a score of them places all: the admitted lengths halve every few rounds. Pieces longer
    than every gap open as many sequences as their tokens fill, or one each if they are longer than half a sequence.
    """
    spark = counts.sparkSession
    rounds: list[DataFrame] = []
    opened = 0
    with settings(spark, spark__sql__codegen__wholeStage="false"):  # compiling takes longer than some thousand rows do
        state = durable(counts.selectExpr("1 AS kind", "CAST(length AS BIGINT) AS at", "0L AS x", "CAST(count AS BIGINT) AS y").coalesce(1))
        while (ahead := spark.sql(_OUTLOOK, state=state, capacity=capacity).first())["longest"] is not None:
            new = ahead["own"] or -(-ahead["tokens"] // capacity)
            longest = ahead["longest"] if new else ahead["held"]
            numbers = {"capacity": f"{capacity}L", "opened": f"{opened}L", "new": f"{new}L", "longest": f"{longest}L", "admitted": ADMITTED}
            placed = durable(_asked(_MATCH, numbers, state=state))
            state = durable(_asked(_UPDATE, numbers, state=state, placed=placed))
            rounds.append(placed)
            opened += new
    return rounds


def _asked(query: str, numbers: dict[str, object], **tables: DataFrame) -> DataFrame:
    """``query`` with literal numbers and tables in place of its names."""
    for name, number in numbers.items():
        query = query.replace(f"{{{name}}}", str(number))
    return next(iter(tables.values())).sparkSession.sql(query, **tables)


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, order_by: tuple[str, ...] = ("doc_id", "piece", "ids_crc32")) -> DataFrame:
    """``pieces`` (with a column length, 1 to ``capacity``) plus sequence_id and offset, both bigint.

    Sequences hold at most ``capacity`` tokens and no gap between pieces. Every row is placed, rows that repeat
    ``order_by`` too. Empty table: empty result. The placements that are sent out are bounded by lengths and rounds.
    """
    pieces = durable(pieces.withColumn("rank_share", F.pmod(F.xxhash64(*order_by), F.lit(RANK_SHARES))))
    shares = durable(pieces.groupBy("length", "rank_share").count())
    before = F.sum("count").over(Window.partitionBy("length").orderBy("rank_share").rowsBetween(Window.unboundedPreceding, -1))
    shares_before = shares.select("length", "rank_share", F.coalesce(before, F.lit(0)).alias("before"))
    rounds = best_fit_rounds(shares.groupBy("length").agg(F.sum("count").alias("count")), capacity)
    rows = [tuple(r) for placed in rounds for r in placed.collect()]  # some thousand, whatever the number of pieces
    plan = np.array(rows or [(0, 0, 0, 0, 1, 0)], np.int64)
    plan = plan[np.lexsort((plan[:, 1], plan[:, 0]))]
    keys = plan[:, 0] * (1 << 48) + plan[:, 1]
    sent = pieces.sparkSession.sparkContext.broadcast((keys, plan))

    @arrow_udf("bigint")
    def sequence(length: pa.Array, rank: pa.Array) -> pa.Array:
        keys, plan = sent.value
        n, r = length.to_numpy(zero_copy_only=False), rank.to_numpy(zero_copy_only=False)
        row = plan[np.maximum(np.searchsorted(keys, n * (1 << 48) + r, "right") - 1, 0)]
        return pa.array(row[:, 3] + (row[:, 5] + r - row[:, 1]) % row[:, 4])

    within = F.row_number().over(Window.partitionBy("length", "rank_share").orderBy(*order_by)) - 1
    ranked = pieces.withColumn("rank_within", within).join(shares_before, ["length", "rank_share"])
    placed = ranked.withColumn("sequence_id", sequence("length", F.col("before") + F.col("rank_within")))
    in_sequence = Window.partitionBy("sequence_id").orderBy(F.desc("length"), *order_by).rowsBetween(Window.unboundedPreceding, Window.currentRow)  # at most ``capacity`` rows
    placed = placed.withColumn("offset", F.sum("length").over(in_sequence) - F.col("length"))
    kept = [c for c in pieces.columns if c != "rank_share"]
    return placed.select(*kept, "sequence_id", "offset")


def packed_sequences(packed: DataFrame) -> DataFrame:
    """sequence_id and ids (array<int>) of each sequence, from packed pieces that carry their ids."""
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])
    return packed.groupBy("sequence_id").agg(F.flatten(ordered).alias("ids"))  # at most ``capacity`` tokens


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Pieces of every document with their place: see ``token_pieces`` and ``pack_pieces``.

    * Null and empty texts are the end token alone, one piece of length 1. A null id is kept as it is.
    * Longer documents are cut every ``capacity`` tokens, whole texts, whatever their length.
    * Repeated rows are packed as often as they occur. Other columns are ignored, whatever their names.
    """
    pieces = token_pieces(docs, tokenizer_path, end_id, capacity, id_col, text_col, with_ids)
    return pack_pieces(pieces, capacity, (id_col, "piece", "ids_crc32"))
