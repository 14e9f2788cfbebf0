import corpus_pipeline as P
from test_native import plain_line_dedup
from test_ngram_join import brute_force
from test_packing import PATH, check_places, expected_pieces

from verigrain.llm.langid import identify_language, train_language_model
from verigrain.llm.mixing import mix_sources
from verigrain.llm.queries import MIX_SEED, MIX_WEIGHTS
from verigrain.llm.sampling import crc_fold

SF = "/root/testdata/sf0.001"


def test_stages_by_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    kept = P.language_stage(spark, docs, SF)
    assert kept.columns == columns
    before, after = {r["doc_id"]: r["text"] for r in docs.collect()}, {r["doc_id"] for r in kept.collect()}
    assert all(not any(c.isalpha() for c in t or "") for i, t in before.items() if i not in after)

    found = identify_language(docs, train_language_model(docs, crc_fold("doc_id", 4) != 2)).collect()
    assert after == {r["doc_id"] for r in found if r["lang_pred"] != "und" and not (r["ambiguous"] and r["score"] < P.LEAST_SCORE)}

    lines = P.line_stage(spark, kept, SF)
    rows = [(r["doc_id"], r["text"]) for r in kept.collect()]
    want = plain_line_dedup(rows)
    assert sorted((r["doc_id"], r["text"]) for r in lines.collect()) == sorted((i, want[i, t]) for i, t in rows if want[i, t].strip() or want[i, t] == t)
    assert all(r["n_chars"] == len(r["text"]) for r in lines.collect()) and lines.columns == columns

    near = P.near_copy_stage(spark, lines, SF)
    found = brute_force([(r["doc_id"], r["text"]) for r in lines.collect()])
    assert sorted(str(r["doc_id"]) for r in near.collect()) == sorted(i for i, _, c in found if i == c)
    assert near.columns == columns

    mixed = P.mixing_stage(spark, near, SF)
    assert mixed.columns == columns
    assert sorted(r["doc_id"] for r in mixed.collect()) == sorted(r["doc_id"] for r in mix_sources(near, MIX_WEIGHTS, MIX_SEED).collect())

    packed = P.packing_stage(spark, mixed, SF).collect()
    got = [tuple(r[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")) for r in packed]
    assert sorted(got) == sorted(expected_pieces(mixed, 4096))
    check_places(packed, 4096)
    assert sorted((r["doc_id"], r["piece"], r["length"]) for r in P.run(spark, SF).collect()) == sorted((g[0], g[1], g[3]) for g in got)


def test_odd_rows(spark, odd):
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars")
    for step in (docs, docs.limit(0)):
        for _, stage in P.STAGES[:-1]:
            step = stage(spark, step, SF)
            assert step.columns == docs.columns
        P.STAGES[-1][1](spark, step, SF).collect()
    assert PATH


def test_columns_named_like_those_that_stages_add(spark, odd):
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars").selectExpr("*", *[f"'own' AS {c}" for c in ("score", "ambiguous", "lang_pred", "n_lines", "n_dropped", "copy", "n_copies", "shuffle_key", "found")])
    for _, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert all(set(r[5:]) == {"own"} for r in docs.collect())


def test_near_copies_without_an_id(spark):
    """Rows without an id are judged one by one, and go before those that have one."""
    a, b = " ".join(f"w{k}" for k in range(60)), " ".join(f"v{k}" for k in range(60))
    rows = [(5, a, "s"), (None, a + " more", "s"), (None, b, "s"), (None, b + " more", "t"), (-3, b + " again", "t"), (7, "x y z", "s"), (7, "x y z", "t"), (None, None, "s"), (2**62, a + " too", "s")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = sorted((r["doc_id"] or 0, r["text"] or "") for r in P.near_copy_stage(spark, docs, SF).collect())
    assert got == sorted([(5, a), (-3, b + " again"), (7, "x y z"), (0, "")])
