import random
import re

import numpy as np
import pytest

from verigrain.llm.ngram_join import Bands, Shingles, ngram_jaccard_join, signatures
from verigrain.operators.components import connected_components


def grams(text, n=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    n = min(n, len(words))
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1))


def brute_force(rows, num=80, den=100):
    """(id, n, component) of every row, by comparing all pairs."""
    sets = [grams(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and den * len(a & b) >= num * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(least.get(find(i), doc), doc)
    return sorted(((str(d), len(s), str(least.get(find(i)))) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))))


def spark_rows(spark, rows, **options):
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id bigint, text string, size int")
    return sorted((str(r[0]), r[1], str(r[2])) for r in ngram_jaccard_join(docs, **options).collect())


def family(rng, size, members, edits):
    """Copies of one text, each with a few words replaced: similarities around the threshold."""
    base = [f"w{rng.randrange(5000)}" for _ in range(size)]
    out = []
    for _ in range(members):
        words = list(base)
        for _ in range(rng.randrange(edits + 1)):
            words[rng.randrange(len(words))] = f"w{rng.randrange(5000)}"
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_families_around_the_threshold(spark, seed):
    rng, texts = random.Random(seed), []
    for size, members, edits in [(4, 5, 1), (5, 6, 1), (8, 10, 1), (12, 10, 2), (20, 15, 2), (35, 15, 2), (60, 15, 3), (120, 20, 5), (400, 20, 12), (1500, 6, 50)]:
        texts += family(rng, size, members, edits)
    passage = " ".join(f"p{i}" for i in range(60))
    texts += [" ".join([f"u{rng.randrange(10**6)}" for _ in range(80)]) + " " + passage for _ in range(20)]
    texts += ["", None, "one", "One", "a b c", "A  b\tc", *[" ".join(["again"] * 50)] * 3]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    assert spark_rows(spark, rows) == brute_force(rows)


def test_other_parameters(spark):
    rng = random.Random(9)
    rows = list(enumerate(family(rng, 50, 20, 6) + family(rng, 9, 12, 2)))
    assert spark_rows(spark, rows, num=60) == brute_force(rows, num=60)


def test_awkward_rows(spark, odd):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    got = sorted((str(r[0]), r[1], str(r[2])) for r in ngram_jaccard_join(odd).collect())
    assert got == brute_force(rows)
    assert ngram_jaccard_join(odd.limit(0)).collect() == []


def test_every_similar_pair_shares_a_signature_that_neither_gives_up():
    """The pigeonhole argument itself, on sets drawn to be short of segments as well."""
    rng, bands, met = np.random.default_rng(5), Bands(80, 100), 0
    for size in [4, 5, 6, 7, 9, 12, 17, 25, 40, 64, 90, 150, 400] * 30:
        narrow = rng.random() < 0.5  # hashes that crowd into few segments
        pool = np.unique(rng.integers(0, 2**60 if narrow else 2**63, 3 * size, dtype=np.uint64))
        a = np.sort(rng.permutation(pool)[:size])
        swaps = int(rng.integers(0, max(1, size // 8) + 1))
        b = np.unique(np.concatenate([rng.permutation(a)[: size - swaps], rng.permutation(np.setdiff1d(pool, a))[: int(rng.integers(0, swaps + 1))]]))
        common = len(np.intersect1d(a, b))
        if not len(b) or 100 * common < 80 * (len(a) + len(b) - common) or np.array_equal(a, b):
            continue
        met += 1
        sides = []
        for s in (a, b):
            sig, kind, slack = signatures(s, bands)
            sides.append((set(sig.tolist()), dict(zip(sig.tolist(), kind.tolist(), strict=True)), slack))
        shared = sides[0][0] & sides[1][0]
        assert shared
        # However the order by cost falls out, the rarest shared signature survives on both sides.
        order = {x: rng.random() for x in sides[0][0] | sides[1][0]}
        kept = []
        for sigs, kind, slack in sides:
            mine = set()
            for k in (0, 1, 2):
                ranked = sorted((x for x in sigs if kind[x] == k), key=lambda x: (x not in shared, order[x]))
                mine |= set(ranked[slack[k] if k < 2 else 0 :])
            kept.append(mine)
        assert kept[0] & kept[1] & shared
    assert met > 100


def test_words_split_as_the_contract_says():
    s = Shingles(5)
    assert len(s("a b c d e f".encode())) == 2 and len(s(b"a b")) == 1 and len(s(b" \t\x0b\x0c\r\n")) == 0
    assert np.array_equal(s("Ä B\xa0c d e f g".encode()), s("Ä  b\xa0C\td e f g".encode()))


def test_components(spark):
    edges = [(5, 4), (4, 3), (10, 11), (7, 7), (20, 21), (21, 22), (22, 23), (23, 24), (24, 20), (1, 2), (2, 3), (30, 29), (29, 28), (None, 3)]
    got = {r[0]: r[1] for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 7: 7, 10: 10, 11: 10, 20: 20, 21: 20, 22: 20, 23: 20, 24: 20, 28: 28, 29: 28, 30: 28}
    chain = spark.range(1, 300).selectExpr("id src", "id + 1 dst")
    assert {r[1] for r in connected_components(chain).collect()} == {1}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).collect() == []
