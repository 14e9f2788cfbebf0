"""Token files: round trips of the codec, and files against the tokenizer itself."""

import io
import json
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from verigrain.llm import token_files as T
from verigrain.llm.token_blocks import BLOCK, ShardReader, ShardWriter, decode_blocks, encode_blocks

PATH = public_tokenizers.path("word_bpe_49k.json")


def decoded(blocks):
    starts = np.concatenate([[0], np.cumsum([len(b) for b in blocks])])[:-1].astype(np.int64)
    return decode_blocks(b"".join(blocks), starts) if blocks else np.zeros(0, np.uint32)


@given(st.integers(0, 3 * BLOCK), st.integers(0, 2**32 - 1), st.integers(1, 2**32 - 1), st.floats(0.01, 1), st.integers(0, 40))
@settings(deadline=None, max_examples=120)
def test_blocks_round_trip(n, low, spread, percentile, outliers):
    rng = np.random.default_rng(n)
    ids = np.minimum(low + rng.integers(0, min(spread, 2**16), n), 2**32 - 1).astype(np.uint32)
    if n:
        ids[rng.integers(0, n, outliers)] = rng.integers(0, 2**32, outliers)
    assert np.array_equal(decoded(encode_blocks(ids, percentile)), ids)


def test_width_and_exceptions():
    """Small differences are packed narrow; the one outlier is an exception and does not widen the block."""
    ids = np.full(BLOCK, 7, np.uint32)
    ids[::2] = 8
    narrow = encode_blocks(ids)
    ids[5] = 2**32 - 1
    patched = encode_blocks(ids)
    assert len(narrow[0]) == 9 + BLOCK // 8 and len(patched[0]) == len(narrow[0]) + 6
    assert np.array_equal(decoded(patched), ids)
    assert len(encode_blocks(np.full(BLOCK, 9, np.uint32))[0]) == 9


@pytest.mark.parametrize("sizes", [[], [0], [0, 0, 1], [3, 0, BLOCK - 3, 0], [5, 700_000, 1, 0, 2 * BLOCK, 9], [1] * 3000])
def test_shard_round_trip(sizes):
    rng = np.random.default_rng(1)
    docs = [(None if k % 3 == 1 else k - 5, rng.integers(0, 49_408, n).astype(np.uint32)) for k, n in enumerate(sizes)]
    sink = io.BytesIO()
    writer = ShardWriter(sink)
    for doc in docs:
        writer.add(*doc)
    writer.finish()
    shard = ShardReader(io.BytesIO(sink.getvalue()), len(sink.getvalue()))
    found = list(shard.documents(0, shard.n_ids + 1, with_ids=True))
    assert [d.doc_id for d in found] == [i for i, _ in docs]
    at = 0
    for d, (_, ids) in zip(found, docs, strict=True):
        assert np.array_equal(d.ids, ids) and d.start == at and d.ids_crc32 == zlib.crc32(ids.astype("<u4").tobytes())
        at += len(ids)
    whole = np.concatenate([ids for _, ids in docs]) if docs else np.zeros(0, np.uint32)
    for begin, end in ((0, len(whole)), (len(whole) // 3, len(whole) // 2), (len(whole), len(whole))):
        assert np.array_equal(shard.ids(begin, end), whole[begin:end])
    cuts = [0, shard.n_ids // 2, shard.n_ids + 1]
    assert [d.start for a, b in zip(cuts, cuts[1:], strict=False) for d in shard.documents(a, b)] == [d.start for d in found]


def test_damage_is_noticed():
    sink = io.BytesIO()
    writer = ShardWriter(sink)
    writer.add(1, np.arange(5000, dtype=np.uint32))
    writer.finish()
    raw = bytearray(sink.getvalue())
    raw[-60] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        ShardReader(io.BytesIO(bytes(raw)), len(raw))


def expected(docs):
    tokenizer, out, at = Tokenizer.from_file(PATH), [], 0
    rows = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 1]
        out.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        at += len(ids)
    return out


def test_files_against_the_tokenizer(spark, small, odd):
    for docs in (small, odd, odd.limit(0)):
        got = [tuple(r) for r in T.token_files(docs, PATH, 1, ids=True).collect()]
        assert sorted(got, key=lambda r: r[1]) == expected(docs)


def test_reading_by_ranges(spark, odd, monkeypatch):
    """Small ranges of ids, so that a shard is read by many tasks, give the same rows."""
    whole = T.token_files(odd, PATH, 1)
    monkeypatch.setattr(T, "IDS_AT_A_TASK", 7)
    reader = T.TokenReader(T.shared_folder(spark, "x"), True)
    folder = T.shared_folder(spark, "ranges")
    T.write_token_files(odd, folder, PATH, 1)
    reader.path = folder
    pieces = reader.partitions()
    assert len(pieces) > 5
    rows = [row for p in pieces for batch in reader.read(p) for row in zip(*(c.to_pylist() for c in batch.columns[:4]), strict=True)]
    assert rows == sorted((tuple(r) for r in whole.collect()), key=lambda r: r[1])


def test_folder_holds_one_table_and_unnamed_files_do_not_count(spark, odd):
    folder = T.shared_folder(spark, "one")
    T.write_token_files(odd, folder, PATH, 1)
    before = T.read_token_files(spark, folder).count()
    place = Path(folder.removeprefix("file:"))
    named = {s["name"] for s in json.loads((place / T.MANIFEST).read_text())}
    (place / "part-000000-lost.tok").write_bytes(b"half a shard")
    assert {p.name for p in place.glob("*.tok")} > named
    assert T.read_token_files(spark, folder).count() == before == odd.count()
    with pytest.raises(Exception, match="holds a table"):
        T.write_token_files(odd, folder, PATH, 1)


def test_ids_must_be_integers(spark):
    with pytest.raises(ValueError, match="integer"):
        T.token_files(spark.createDataFrame([("a", "b")], "doc_id string, text string"), PATH, 1)


def test_one_repeated_id(spark):
    """A third of the rows has one id; they are dealt to several shards and all come back."""
    docs = spark.range(3000).selectExpr("if(id % 3 = 0, 5L, id) AS doc_id", "concat('word ', id) AS text")
    got = T.token_files(docs, PATH, 1).collect()
    assert len(got) == 3000 and sum(r["doc_id"] == 5 for r in got) == 1001
    ordered = sorted(got, key=lambda r: r["start"])
    assert all(a["start"] + a["n_tokens"] == b["start"] and a["doc_id"] <= b["doc_id"] for a, b in zip(ordered, ordered[1:], strict=False))
