"""Exact dedup, mixing and line dedup against plain Python."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import pytest

from verigrain.llm.exact_dedup import exact_dedup
from verigrain.llm.line_dedup import line_dedup
from verigrain.llm.mixing import mix_sources


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def low_id(i):
    return (i is not None, i or 0)


def test_exact_dedup(small, odd):
    for docs in (small, odd, odd.limit(0)):
        rows = [(r["doc_id"], lower(r["text"])) for r in docs.collect()]
        groups = defaultdict(list)
        for i, t in rows:
            groups[t].append(i)
        want = sorted((str(i), str(max(groups[t], key=low_id)), len(groups[t]), i == max(groups[t], key=low_id)) for i, t in rows)
        got = exact_dedup(docs)
        assert got.columns == ["doc_id", "keep_id", "group_size", "kept"]
        assert sorted((str(r[0]), str(r[1]), r[2], r[3]) for r in got.collect()) == want


def uniform(*parts):
    return int(hashlib.md5("|".join(parts).encode()).hexdigest()[:13], 16) / 2**52


def poisson(mean, u):
    p = c = math.exp(-mean)
    k = 0
    while c <= u and k < math.ceil(mean + 12 * math.sqrt(mean) + 40):
        k += 1
        p *= mean / k
        c += p
    return k + (c <= u)


@pytest.mark.parametrize("weights", [{"a": 1.0, "b": 3.0, "*": 1.0}, {"src0": 0.5, "*": 0.5}, {"*": 2.0}, {"b": 1.0}])
def test_mixing(small, odd, weights):
    for docs in (small, odd, odd.limit(0)):
        rows = [(r["doc_id"], r["text"] or "", r["source"]) for r in docs.collect()]
        group = lambda s: s if s in weights and s != "*" else "*"
        size = Counter()
        for _, t, s in rows:
            size[group(s)] += len(t)
        want = Counter()
        for i, t, s in rows:
            g = group(s)
            present = sum(weights.get(k, 0) for k in sorted(size) if size[k])
            rate = weights.get(g, 0) / present * sum(size.values()) / size[g] if size[g] and present else 0
            ident = "null|" + hashlib.md5(t.encode()).hexdigest() if i is None else str(i)
            parts = max(1, math.ceil(rate / 200))
            n = sum(poisson(rate / parts, uniform("7", ident, str(k + 1))) for k in range(parts))
            for copy in range(n):
                want[i, t, s, copy + 1, n] += 1
        out = mix_sources(docs, weights, 7).collect()
        assert Counter((r["doc_id"], r["text"] or "", r["source"], r["copy"], r["n_copies"]) for r in out) == want


def test_mixing_reaches_the_weights(spark):
    docs = spark.range(20_000).selectExpr("id doc_id", "repeat('x', 10) text", "if(id % 10 = 0, 'a', 'b') source")
    share = {r[0]: r[1] for r in mix_sources(docs, {"a": 0.5, "b": 0.5}, 1).groupBy("source").count().collect()}
    assert abs(share["a"] - 10_000) < 400 and abs(share["b"] - 10_000) < 400


def test_mixing_null_ids_and_absent_sources(spark):
    """Rows without an id draw each for themselves; the weight of a source that does not occur is shared out."""
    docs = spark.range(20_000).selectExpr("CAST(NULL AS BIGINT) doc_id", "lpad(id, 10, '0') text", "if(id % 10 = 0, 'a', 'b') source")
    rows = mix_sources(docs, {"a": 0.25, "b": 0.25, "absent": 0.5}, 1).groupBy("source", "text").count().collect()
    share = Counter()
    for r in rows:
        share[r["source"]] += r["count"]
    assert abs(share["a"] - 10_000) < 400 and abs(share["b"] - 10_000) < 400 and max(r["count"] for r in rows) > 10


def test_exact_dedup_hot_group(spark):
    """A group with a third of all rows, ids null or not, is marked whole; its rows meet in no one task."""
    docs = spark.range(3000).selectExpr("if(id % 7 = 0, NULL, id) doc_id", "if(id % 3 = 0, 'Same Text', concat('text ', id % 1000)) text")
    rows = [(r["doc_id"], lower(r["text"])) for r in docs.collect()]
    size, keep = Counter(t for _, t in rows), {}
    for i, t in rows:
        keep[t] = max((i, keep.get(t)), key=low_id)
    got = sorted((str(r[0]), str(r[1]), r[2], r[3]) for r in exact_dedup(docs).collect())
    assert got == sorted((str(i), str(keep[t]), size[t], i == keep[t]) for i, t in rows)


def test_mixing_large_rate(spark):
    docs = spark.range(1000).selectExpr("id doc_id", "'xxxx' text", "if(id < 2, 'a', 'b') source")
    got = {r[0]: r[1] for r in mix_sources(docs, {"a": 1.0}, 1).groupBy("doc_id").count().collect()}
    assert set(got) == {0, 1} and all(abs(n - 500) < 150 for n in got.values())


def plain_line_dedup(rows, depth=3, min_docs=10, min_constant=0.8):
    """{(id, text): kept text} by the same definition, one line at a time."""
    docs = sorted({(i, t or "") for i, t in rows}, key=lambda d: (low_id(d[0]), d[1]))
    lines = []
    for d, (i, t) in enumerate(docs):
        for pos, line in enumerate(t.split("\n")):
            tokens = re.sub(r"[\t\x0b\x0c\r ]+", " ", line).strip(" ")
            tokens = ["<*>" if re.search("[0-9]", x) else x for x in tokens.split(" ")] if tokens else []
            if tokens:
                lines.append((d, pos, (len(tokens), *tokens[:depth]), tuple(tokens)))
    reach = defaultdict(set)
    for d, _, leaf, _ in lines:
        reach[leaf].add(d)
    holders = defaultdict(set)
    for d, _, leaf, tokens in lines:
        if len(reach[leaf]) >= min_docs:
            holders[leaf, tokens].add(d)
    seen = Counter()
    for (leaf, tokens), ds in holders.items():
        for at, x in enumerate(tokens):
            seen[leaf, at, x] += len(ds)
    template = {}
    for leaf, tokens in holders:
        fixed = [x if x != "<*>" and seen[leaf, at, x] >= min_docs else "<*>" for at, x in enumerate(tokens)]
        if sum(x != "<*>" for x in fixed) >= max(min_constant * sum(x != "<*>" for x in tokens), 1):
            template[leaf, tokens] = (leaf, tuple(fixed))
    members = defaultdict(list)
    for d, pos, leaf, tokens in lines:
        if (leaf, tokens) in template:
            members[template[leaf, tokens]].append((low_id(docs[d][0]), pos, d))
    gone = set()
    for found in members.values():
        if len({d for _, _, d in found}) >= min_docs:
            first = min(found)[:2]
            gone |= {(d, pos) for i, pos, d in found if (i, pos) != first}
    return {doc: "\n".join(x for pos, x in enumerate(doc[1].split("\n")) if (d, pos) not in gone) for d, doc in enumerate(docs)}


def test_line_dedup(spark, small, odd):
    planted = [
        (i, f"Own{chr(97 + i)} words{chr(97 + i)} here only for this\nShare this page with {i}{i} of your friends today\n  Cookies   are\tused here \nshort\n" + "long passage of words " * 20)
        for i in range(15)
    ]
    planted += [(100 + i, "alone a b c d e\nCookies are used here") for i in range(3)] + [(200, "Share this page now please do it all again")]
    made = spark.createDataFrame(planted, "doc_id bigint, text string")
    for docs in (made, small, odd, odd.limit(0)):
        rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
        for options in ({}, {"min_docs": 2}):
            want = plain_line_dedup(rows, **options)
            got = sorted((str(r["doc_id"]), r["text"]) for r in line_dedup(docs, **options).collect())
            assert got == sorted((str(i), want[i, t or ""]) for i, t in rows)
    kept = {r["doc_id"]: r for r in line_dedup(made).collect()}
    assert kept[0]["n_dropped"] == 0 and kept[1]["text"].startswith("Ownb wordsb here") and "Share" not in kept[1]["text"]
    assert "Cookies" not in kept[101]["text"] and kept[101]["text"].startswith("alone") and "Share" in kept[200]["text"]
