import hashlib
import random
import re
import time

import regex

from verigrain.llm.fingerprints import canonical, canonical_groups, digest, edited_text, fingerprint_with_next, fingerprints_with_groups
from verigrain.llm.licenses import BASE_PHRASES, NOTICES, NoticeSearch, scan_licenses, scan_text

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def test_base_phrases_by_brute_force(small, odd):
    for docs in (small, odd):
        for r in scan_licenses(docs).collect():
            words = WORD.findall(lower(r["text"]))
            places = [(i, label) for p, label in BASE_PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
            assert (r["n_words"], r["n_base"]) == (len(words), len(places))
            assert r["first_word"] == min((i for i, _ in places), default=None)
            assert r["last_word"] == max((i for i, _ in places), default=None)
            assert r["base_labels"] == ",".join(sorted({x for _, x in places}))
            assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(",")))
            assert 0 <= r["score"] <= 1


def edits_of(notice, text):
    """Fewest edits of any occurrence bounded by blanks, or None: all of the text, no seeds."""
    m = regex.search(rf"(?b)(?<![^ ])(?:{regex.escape(notice.words)}){{e<={notice.edits}}}(?![^ ])", text)
    return sum(m.fuzzy_counts) if m else None


def test_notices_by_brute_force():
    texts = [
        "this is the apache licence version", "under the mit licens and more", "gnu genral public licence x", "submit license please",
        "permission is hereby granted free of charge to any person obtainin a copi", "licensed under the apachee license version 2 0",
        "gnu lesser general public license and gnu general public license", "mozila public license", "apache license apache license",
        "nothing at all here", "", "cc by sa creative common attribution", "mit  license", "redistribution and use in sorce and binary form",
    ]
    search = NoticeSearch()
    for text in texts:
        found = search.find(text)
        for k, notice in enumerate(NOTICES):
            best = min((e for n, _, _, e in found if n == k), default=None)
            assert best == edits_of(notice, text), (text, notice)
        for k, start, end, edits in found:
            assert edits <= NOTICES[k].edits and 0 <= start < end <= len(text)


def next_texts(docs):
    rows = sorted(((r["doc_id"], r["text"] or "") for r in docs.collect()), key=lambda x: (x[0] is not None, x))
    return [(i, t, rows[(k + 1) % len(rows)][1]) for k, (i, t) in enumerate(rows)]


def test_fingerprints_by_brute_force(small, odd):
    for docs in (small, odd, odd.limit(1), odd.limit(0)):
        want = []
        for i, text, after in next_texts(docs):
            edited = edited_text(text, after)
            assert len(edited) <= len(text)
            want.append((
                str(i), len(text), hashlib.sha256(edited.encode()).hexdigest(), digest(canonical(text)), digest(canonical(edited)),
                float(canonical(text) == canonical(edited)), float(canonical(text) == canonical(after)),
            ))
        for partitions in (None, 3):
            got = [(str(r[0]), *r[1:]) for r in fingerprint_with_next(docs, partitions=partitions).collect()]
            assert sorted(got) == sorted(want)


def test_canonical_groups(small, odd):
    for docs in (small, odd, odd.limit(0)):
        rows = [(r["doc_id"], canonical(r["text"] or "")) for r in docs.collect()]
        for r in canonical_groups(docs).collect():
            form = [f for i, f in rows if i == r["doc_id"]][0]
            same = [i for i, f in rows if f == form]
            assert r["group_size"] == len(same) and r["fingerprint"] == digest(form)
            assert r["group_id"] == min((i for i in same if i is not None), default=None)


def test_license_time_grows_with_the_text():
    """Many places, exact and with edits, in one text: twice the text takes about twice the time."""
    search = NoticeSearch()
    for unit in (b"mit license ", b"mit licence x ", b"gnu general public license "):
        took = []
        for n in (4000, 16000):
            start = time.process_time()
            row = scan_text(search, unit * n, BASE_PHRASES)
            took.append(time.process_time() - start)
            assert row["labels"] in ("mit", "gpl") and len(row["spans"]) >= n
        assert took[1] < 10 * took[0] + 0.5


def edited(words, edits, rng):
    """``words`` with letters replaced inside, but not next to each other."""
    out = list(words)
    for at in rng.sample(range(4, len(words) - 1, 2), edits):
        if out[at] != " ":
            out[at] = "q"
    return "".join(out)


def test_planted_notices_with_edits():
    """Every notice with 0 to its number of edits is found; words that only look alike are not."""
    rng, search = random.Random(3), NoticeSearch()
    for n in NOTICES:
        for k in range(n.edits + 1):
            for _ in range(5):
                text = f"some words before {edited(n.words, min(k, len(n.words) // 4), rng)} and after"
                assert n.label in scan_text(search, text.encode(), {})["labels"].split(","), text
    for clean in ("it license", "is license", "the mint licence plate", "general public", "apache helicopter", "a driving license", "cc by"):
        assert scan_text(search, clean.encode(), {})["labels"] == "", clean


def test_groups_beside_the_fingerprints(spark, small, odd):
    """The query's groups are those of the canonical forms, a hot group included."""
    hot = spark.range(900).selectExpr("id doc_id", "if(id % 3 = 0, if(id % 2 = 0, 'The  Same', 'the same'), concat('own ', id)) text")
    for docs in (small, odd, odd.limit(0), hot):
        forms = {}
        for r in docs.collect():
            forms.setdefault(canonical(r["text"] or ""), []).append(r["doc_id"])
        want = sorted((digest(f), min((i for i in ids if i is not None), default=None), len(ids)) for f, ids in forms.items() for _ in ids)
        got = fingerprints_with_groups(docs).collect()
        assert sorted((r["fingerprint"], r["group_id"], r["group_size"]) for r in got) == want


def test_one_fingerprint_on_a_third_of_the_rows(spark, monkeypatch):
    """Texts that differ in case and blanks alone are one group; colliding digests are told apart by their bytes."""
    from verigrain.llm import fingerprints as P

    rows = [(k, (" A  b\tC " if k % 2 else "a B c") if k % 3 == 0 else f"text {k}") for k in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc_id"]: (r["group_id"], r["group_size"]) for r in P.canonical_groups(docs).collect()}
    assert got == {k: (0, 1000) if k % 3 == 0 else (k, 1) for k in range(3000)}
    monkeypatch.setattr(P, "HELD_FORMS", 10)
    marked = docs.selectExpr("doc_id AS row_id", "'same' AS fingerprint", "sha2(text, 256) AS raw")
    seen = P.compared(docs.selectExpr("sha2(text, 256) AS raw", "text"))
    monkeypatch.setattr(P, "compared", lambda chosen: seen.withColumn("fingerprint", P.F.lit("same")))
    apart = {r["row_id"]: (r["group_id"], r["group_size"]) for r in P.grouped(marked, docs.select("text")).collect()}
    assert apart == got
