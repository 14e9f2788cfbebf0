"""Texts of some MB through every operator: one line, very many lines, very many notices, one word, many marks."""

import hashlib

import pytest
from test_packing import PATH, check_places

from verigrain.llm.exact_dedup import exact_dedup
from verigrain.llm.fingerprints import fingerprints_with_groups
from verigrain.llm.langid import identify_language, train_language_model
from verigrain.llm.licenses import scan_licenses
from verigrain.llm.line_dedup import line_dedup
from verigrain.llm.mixing import mix_sources
from verigrain.llm.ngram_join import ngram_jaccard_join
from verigrain.llm.packing import pack_documents
from verigrain.llm.quality import classify_quality, train_quality_model
from verigrain.llm.toxicity import classify_toxicity, train_toxicity_model

SF = "/root/testdata/sf0.001"
TEXTS = {
    1: " ".join(f"word{k % 977} and {k}" for k in range(150_000)),
    2: "\n".join(f"line number {k} of {k % 13} many" for k in range(80_000)),
    3: "mit license and gnu general public license; " * 40_000,
    4: "x" * 2_000_000,
    5: "!? " * 700_000,
    6: "short text",
}


@pytest.fixture(scope="module")
def long(spark):
    return spark.createDataFrame([(k, t, "src0", "en", len(t)) for k, t in TEXTS.items()], "doc_id bigint, text string, source string, lang string, n_chars bigint")


def test_whole_texts(spark, long):
    digests = {r["doc_id"]: r["d"] for r in exact_dedup(long, digest_col="d").collect()}
    assert digests == {k: hashlib.sha256(t.lower().encode()).hexdigest() for k, t in TEXTS.items()}
    assert {r["doc_id"]: r["n_chars"] for r in fingerprints_with_groups(long).collect()} == {k: len(t) for k, t in TEXTS.items()}
    lines = {r["doc_id"]: r for r in line_dedup(long).collect()}
    assert lines[2]["n_lines"] == 80_000 and all(lines[k]["n_dropped"] == 0 and lines[k]["text"] == t for k, t in TEXTS.items())
    found = {r["doc_id"]: r for r in scan_licenses(long).collect()}
    assert found[3]["n_base"] == 80_000 and found[3]["last_word"] == 7 * 40_000 - 4 and found[3]["labels"] == "gpl,mit"
    joined = {r["doc_id"]: r for r in ngram_jaccard_join(long).collect()}
    assert joined[4]["n_shingles"] == 1 and joined[5]["n_shingles"] == 1 and all(r["component_id"] == k for k, r in joined.items())
    assert {r["doc_id"]: len(r["text"]) for r in mix_sources(long, {"src0": 1.0}, 5).collect()}.items() <= {k: len(t) for k, t in TEXTS.items()}.items()


def test_whole_texts_are_packed(spark, long):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(PATH)
    rows = pack_documents(long.where("doc_id <> 4"), PATH, 1).collect()
    check_places(rows, 4096)
    for k in (1, 2, 3, 5, 6):
        assert sum(r["length"] for r in rows if r["doc_id"] == k) == len(tokenizer.encode(TEXTS[k], add_special_tokens=False).ids) + 1


def test_whole_texts_are_scored(spark, long):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    for rows in (
        identify_language(long, train_language_model(docs)), classify_quality(long, train_quality_model(docs, labels)),
        classify_toxicity(long, train_toxicity_model(docs, labels)),
    ):
        found = rows.collect()
        assert {r["doc_id"] for r in found} == set(TEXTS) and all(0 <= r["score"] <= 1 for r in found)
