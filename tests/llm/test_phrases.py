"""Collocations against plain counting, block by block and whole."""

import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from verigrain.llm import phrases as P
from verigrain.llm.queries import ORACLES, QUERIES


def pieces_of(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [[w for w in re.split("[ \t]+", p) if w] for p in re.split("[.,;:!?\n-\r]", lower)]


def brute(rows, min_count, max_words, top, cover):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        for words in pieces_of(text):
            n[lang or "und"] += len(words)
            for k in range(1, max_words + 1):
                f[lang or "und"].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        cand = {p: a for p, a in counts.items() if len(p) > 1 and a >= min_count}
        inside = defaultdict(int)
        for p, a in cand.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    inside[p[i : i + k]] = max(inside[p[i : i + k]], a)
        found = []
        for p, a in cand.items():
            score, _, l, r = min((10**6 * a * a // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            if not (inside[p] and 100 * inside[p] >= cover * a):
                found.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, p, l, r) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, n[lang], -score))
    return sorted(out)


def mined(docs, **options):
    return sorted(tuple(r) for r in P.mine_phrases(docs, **options).collect())


@pytest.mark.parametrize(("min_count", "max_words"), [(10, 3), (2, 3), (2, 5), (3, 2)])
def test_small_tables(spark, small, odd, min_count, max_words):
    for docs in (small, odd, odd.limit(0)):
        rows = [(r["lang"], r["text"]) for r in docs.collect()]
        got = mined(docs, min_count=min_count, max_words=max_words, top=300)
        assert got == brute(rows, min_count, max_words, 300, 50)


def test_small_blocks(spark, small, monkeypatch):
    """Texts are cut into many blocks, of several languages; nothing changes."""
    rows = [(r["lang"], r["text"]) for r in small.collect()]
    monkeypatch.setattr(P, "BLOCK_BYTES", 3000)
    monkeypatch.setattr(P, "HELD_BYTES", 5000)
    assert mined(small, min_count=5) == brute(rows, 5, 3, 2000, 50)


def test_nulls_ties_many_languages_and_long_texts(spark):
    rows = [(None, "a b c. a b c"), ("en", None), ("en", ""), ("en", "x y z " * 50_000), ("fr", "É b É b c É b"), ("en", "p q! p q? P Q"), ("und", "a b c")]
    rows += [(f"l{k}", "one two three one two") for k in range(700)]
    docs = spark.createDataFrame(rows, "lang string, text string").selectExpr("*", "1 AS block", "2 AS n", "3 AS id", "'x' AS left", "4 AS code")
    assert mined(docs, min_count=2) == brute(rows, 2, 3, 2000, 50)


def test_score_beyond_64_bits(spark):
    """a a 10**6 passes 2**63 from 3.1 million occurrences on; the division stays exact."""
    table = spark.createDataFrame([(10**12 + 7, [10**12 + 9, 10**12 + 7], [10**12 + 11, 10**12 + 7])], "f long, starts array<long>, ends array<long>")
    (row,) = table.select(P._cut(2).alias("c")).collect()
    a, l, r = 10**12 + 7, 10**12 + 9, 10**12 + 11
    assert row["c"]["score"] == 10**6 * a * a // (l * r)


@given(st.lists(st.lists(st.sampled_from("abc"), max_size=9), max_size=9), st.sets(st.sampled_from("abc")))
@settings(deadline=None, max_examples=200)
def test_sequences(pieces, frequent):
    raw = b"\n".join(" ".join(p).encode() for p in pieces)
    seq, words = P.coded(raw)
    words = words.to_pylist()
    assert [words[c // 2] for c in seq] == [w for p in pieces for w in p]
    kept = np.array(sorted(words.index(w) for w in frequent if w in words), int)
    seq = P.only(seq, len(words), kept)
    left, right, n, pairs = P.adjacent(seq, len(kept))
    names = [words[k] for k in kept]
    want = Counter((x, y) for p in pieces for x, y in zip(p, p[1:], strict=False) if {x, y} <= frequent)
    assert {(names[x], names[y]): c for x, y, c in zip(left, right, n, strict=True)} == want
    # The pairs' own neighbours are triples of frequent words.
    l2, r2, n2, _ = P.adjacent(pairs, len(left))
    triples = Counter(t for p in pieces for t in zip(p, p[1:], p[2:], strict=False) if set(t) <= frequent)
    assert {(names[left[x]], names[right[x]], names[right[y]]): c for x, y, c in zip(l2, r2, n2, strict=True)} == triples


def test_query_against_sql(spark):
    folder = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    want = con.sql(ORACLES["op11_phrases"])
    got = QUERIES["op11_phrases"](spark, folder)
    assert got.columns == want.columns
    assert sorted(tuple(r) for r in got.collect()) == sorted(want.fetchall())


def test_hashes_and_bitmap(spark):
    """The numpy hash is Spark's, and the collected bitmap has the bit of every pair."""
    rows = [(0, 0), (1, -1), (2**62, -(2**63)), *[(k * 7919, k << 33) for k in range(500)]]
    table = spark.createDataFrame(rows, "left long, right long")
    left, right = np.array(rows, np.int64).T
    own = P.hashes(left, right)
    assert own.view(np.int64).tolist() == [r[0] for r in table.selectExpr("xxhash64(left, right)").collect()]
    bits = P._bitmap(table, 1 << 23)
    place = P._places(own, 1 << 23)
    assert (bits[place >> 3] >> (place & 7).astype(np.uint8) & 1).all() and np.unpackbits(bits).sum() == len(set(place.tolist()))
