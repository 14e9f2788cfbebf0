import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from verigrain.llm.packing import ChunkTokens, best_fit_rounds, pack_documents, packed_sequences

PATH = public_tokenizers.path("word_bpe_49k.json")


def check_places(rows, capacity):
    used = defaultdict(list)
    for r in rows:
        used[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in used.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(used)


def expected_pieces(docs, capacity):
    tokenizer, out = Tokenizer.from_file(PATH), []
    for r in docs.collect():
        ids = np.array([*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 1], "<u4")
        for k, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            out.append((r["doc_id"], k, at, len(part), zlib.crc32(part.tobytes())))
    return out


@pytest.mark.parametrize("capacity", [4096, 64])
def test_pieces_and_places(spark, small, odd, capacity):
    for docs in (small, odd):
        rows = pack_documents(docs, PATH, 1, capacity).collect()
        got = [tuple(r[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")) for r in rows]
        key = lambda t: tuple(-1 if x is None else x for x in t)
        assert sorted(got, key=key) == sorted(expected_pieces(docs, capacity), key=key)
        check_places(rows, capacity)


def test_sequences_hold_the_ids(spark, odd):
    packed = pack_documents(odd, PATH, 1, 128, with_ids=True)
    rows = packed.collect()
    ids = {r["sequence_id"]: r["ids"] for r in packed_sequences(packed).collect()}
    for r in rows:
        assert ids[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]] == r["ids"]


def test_empty_table(spark, odd):
    assert pack_documents(odd.limit(0), PATH, 1).collect() == []


def best_fit_decreasing(lengths, capacity):
    gaps = []
    for n in sorted(lengths, reverse=True):
        fits = [k for k, g in enumerate(gaps) if g >= n]
        if fits:
            gaps[min(fits, key=lambda k: gaps[k])] -= n
        else:
            gaps.append(capacity - n)
    return len(gaps)


@pytest.mark.parametrize("lengths", [
    [5, 5, 5, 5, 1, 1, 1, 1, 1, 1, 1, 3, 9, 10], [1] * 1000, [40] * 3 + [1] * 7, [], [21] * 5 + [20] * 5,
    np.random.default_rng(1).integers(1, 41, 500).tolist(), [*np.random.default_rng(2).integers(1, 41, 90).tolist(), *[2] * 300],
])
def test_rounds_against_plain_best_fit(spark, lengths):
    """Every piece has one place, no sequence overflows, and few more are used than by plain best-fit decreasing."""
    counts = sorted((n, lengths.count(n)) for n in set(lengths))
    rounds = best_fit_rounds(spark.createDataFrame(counts, "length long, count long"), 40)
    seen, used = defaultdict(set), defaultdict(int)
    for length, first_rank, count, first, around, phase in (tuple(r) for placed in rounds for r in placed.collect()):
        for i in range(count):
            assert first_rank + i not in seen[length]
            seen[length].add(first_rank + i)
            used[first + (phase + i) % around] += length
    assert {n: set(range(c)) for n, c in counts} == dict(seen)
    assert all(v <= 40 for v in used.values()) and set(used) == set(range(len(used)))
    assert len(used) <= 1.1 * best_fit_decreasing(lengths, 40) + 1


@given(st.lists(st.text(alphabet="aBé ÉßÿÀ÷×'.,!$<|>1२\u0301\u0338=İΣς\n\t\u00a0endoftx-", max_size=40), max_size=12))
@settings(deadline=None, max_examples=300)
def test_chunks_equal_the_tokenizer(texts):
    texts = [*texts, "<|endoftext|>", None, "Don't STOP.it's $5,000 naïve ÉCOLE!!"]
    ids, starts = ChunkTokens(PATH).encode(pa.array(texts, pa.string()), 1)
    tokenizer = Tokenizer.from_file(PATH)
    for k, text in enumerate(texts):
        assert ids[starts[k] : starts[k + 1]].tolist() == [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], text
