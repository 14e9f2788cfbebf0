"""Held-out accuracy, defined results for odd rows, and models without examples."""

import inspect
import itertools
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from verigrain.llm import queries as Q
from verigrain.llm.langid import codewords, identify_language, train_language_model
from verigrain.llm.quality import BINS, Binned, classify_quality, estimated_prior, fit_nnpu, style_measures, train_quality_model
from verigrain.llm.toxicity import classify_toxicity, fit_machine, train_toxicity_model

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("query, label, least", [("op3_quality", "quality", 0.95), ("op7_toxicity", "toxic", 0.93)])
def test_held_out_accuracy(spark, query, label, least):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = Q.QUERIES[query](spark, SF).join(labels, "doc_id").where("held_out").toPandas()
    assert (got.predicted == got[label]).mean() >= least


def test_languages(spark):
    lang = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    got = Q.op9_language_id(spark, SF).join(lang, "doc_id").where("held_out").toPandas()
    assert (got.lang_pred == got.lang).mean() >= 0.97


def test_labels_of_the_held_out_fold_and_other_columns_change_nothing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    flipped = labels.selectExpr("doc_id", *[f"if(crc32(cast(cast(doc_id as string) as binary)) % 3 = 1, 1 - {c}, {c}) {c}" for c in ("quality", "toxic")])
    other = docs.withColumn("source", docs.doc_id.cast("string")).withColumn("lang", docs.doc_id.cast("string"))
    for train, classify in ((train_quality_model, classify_quality), (train_toxicity_model, classify_toxicity)):
        a = classify(docs, train(docs, labels)).select("doc_id", "score").orderBy("doc_id").toPandas()
        b = classify(docs, train(other, flipped)).select("doc_id", "score").orderBy("doc_id").toPandas()
        assert np.allclose(a.score, b.score)


def test_odd_rows(spark, odd):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    for train, classify in ((train_quality_model, classify_quality), (train_toxicity_model, classify_toxicity)):
        model = train(docs, labels)
        rows = classify(odd, model).collect()
        assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 and r["predicted"] in (0, 1) for r in rows)
        assert classify(odd.limit(0), model).collect() == []
        for none in (train(docs, labels.limit(0)), train(docs.limit(0), labels)):
            assert all(0 <= r["score"] <= 1 for r in classify(odd, none).collect())
    model = train_language_model(docs)
    rows = identify_language(odd, model).collect()
    for r in rows:
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] != "und") == letters and 0 <= r["score"] <= 1
    assert identify_language(odd.limit(0), model).collect() == []
    assert {r["lang_pred"] for r in identify_language(odd, train_language_model(docs.limit(0))).collect()} == {"und"}


def area(margin, label):
    order = np.argsort(np.argsort(margin))
    return (order[label == 1].mean() - (label.sum() - 1) / 2) / (1 - label).sum()


def test_machine_learns_what_addition_cannot():
    """With production parameters: two terms that are toxic only one without the other, among others that tell nothing."""
    rng = np.random.default_rng(0)
    texts, label = [], []
    for _ in range(3000):
        a, b = rng.random(2) < 0.5
        texts.append(np.unique(np.concatenate([[1] * int(a), [2] * int(b), rng.choice(np.arange(10, 200), 6)])).astype(np.int64))
        label.append(int(a != b))
    label, settings = np.array(label), {k: v.default for k, v in inspect.signature(train_toxicity_model).parameters.items()}
    model = fit_machine(texts[:2000], label[:2000], settings["least_z"], settings["common"], settings["rounds"], settings["seed"])
    margin = np.array([model.margin(t) for t in texts[2000:]])
    additive = np.array([model.linear[model.rows(t)].sum() for t in texts[2000:]])
    assert area(margin, label[2000:]) > 0.95 and area(additive, label[2000:]) < 0.6


def test_toxicity_by_plain_sums(spark):
    """An independent scorer: every pair of known terms, one by one."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = train_toxicity_model(docs, labels)
    linear, factors = dict(zip(model.terms.tolist(), model.linear, strict=True)), dict(zip(model.terms.tolist(), model.factors, strict=True))
    for r in classify_toxicity(docs.limit(40), model).collect():
        words = set(re.findall(rb"(?:[0-9a-z]|[\x80-\xff])+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (r["text"] or "").encode())))
        terms = {b"w:" + w for w in words}
        terms |= {b"s:" + w.decode()[:n].encode() for w in words for n in (4, 5, 7) if len(w.decode()) > n}
        known = [h for h in {xxhash.xxh3_64_intdigest(t) % ((1 << 20) - 1) + 1 for t in terms} if h in linear]
        pairs = sum(factors[x] @ factors[y] for x, y in itertools.combinations(known, 2)) / max(len(known), 1)
        margin = model.bias + sum(linear[h] for h in known) + pairs
        assert abs(r["score"] - 1 / (1 + np.exp(-np.clip(margin, -40, 40)))) < 1e-6


def test_quality_by_plain_sums(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = train_quality_model(docs, labels)
    for r in classify_quality(docs.limit(40), model).collect():
        margin = model.bias
        for j, x in enumerate(style_measures((r["text"] or "").encode())):
            margin += model.weights[j * BINS + sum(bool(x >= e) for e in model.edges[:, j])]
        assert abs(r["score"] - 1 / (1 + np.exp(-np.clip(margin, -40, 40)))) < 1e-6


def test_languages_by_plain_sums(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = train_language_model(docs)
    for r in identify_language(docs.limit(30), model).where("lang_pred <> 'und'").collect():
        b = b" " + r["text"].encode().lower() + b" "
        counts = Counter()
        for k in range(len(b) - 1):
            pair = (b[k] * 0x9E3779B1 + b[k + 1] * 0x85EBCA77) % 2**32
            counts[pair * 0x165667B1 % 2**32 >> 20] += 1
            if k < len(b) - 2:
                counts[(pair ^ (b[k + 2] * 0xC2B2AE3D) % 2**32) * 0x27D4EB2F % 2**32 >> 20] += 1
        margins = model.bias + sum(np.sqrt(n / (2 * len(b) - 3)) * model.weights[g] for g, n in counts.items())
        loss = [sum(t * np.log1p(np.exp(-m * c)) for t, m, c in zip(model.trust, margins, code, strict=True)) for code in model.code]
        likely = np.exp(-(np.array(loss) - min(loss)) * model.code.shape[1])
        assert r["lang_pred"] == model.languages[int(np.argmin(loss))] and abs(r["score"] - max(likely) / likely.sum()) < 1e-3


def binned(x):
    return Binned(np.stack([j * BINS + np.clip(x[:, j] * 2 + 8, 0, BINS - 1).astype(int) for j in range(x.shape[1])], 1))


@pytest.mark.parametrize("prior", [0.3, 0.95])
def test_risk_falls_along_the_gradient(prior):
    """The non-negative risk, written out, falls; with a large prior its negative part is held at zero or above."""
    rng = np.random.default_rng(4)
    positive, unlabelled = binned(rng.normal(1, 1, (80, 3))), binned(np.vstack([rng.normal(1, 1, (40, 3)), rng.normal(-1, 1, (60, 3))]))

    def risks(w, b):
        p, u = positive @ w + b, unlabelled @ w + b
        below = np.logaddexp(0, u).mean() - prior * np.logaddexp(0, p).mean()
        return prior * np.logaddexp(0, -p).mean(), below

    start, few, many = (sum(max(x, 0) for x in risks(*fit_nnpu(positive, unlabelled, prior, rounds=n, l2=0))) for n in (1, 20, 200))
    assert many < few < start
    assert risks(*fit_nnpu(positive, unlabelled, prior, rounds=400, l2=0))[1] > -0.05


def test_estimated_prior():
    rng = np.random.default_rng(5)
    positive, unlabelled = binned(rng.normal(1.5, 1, (1500, 2))), binned(np.vstack([rng.normal(1.5, 1, (900, 2)), rng.normal(-1.5, 1, (600, 2))]))
    assert abs(estimated_prior(positive, unlabelled, 1) - 0.6) < 0.1


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 9, 30])
def test_codewords_are_distinct(n):
    code = codewords(n)
    assert code.shape[0] == n and len({tuple(r) for r in code}) == n


@pytest.mark.parametrize("languages", [600, 3000])
def test_many_languages(spark, languages):
    """A dirty language column neither stops the training nor drowns the languages that are frequent."""
    from verigrain.llm.langid import identify_language, train_language_model
    from verigrain.llm.sampling import MOST_STRATA

    rows = [(k, "der hund und die katze sind nicht hier " * 3, "de") for k in range(400)]
    rows += [(1000 + k, "the dog and the cat are not here today " * 3, "en") for k in range(400)]
    rows += [(5000 + k, f"zq{k}x wv{k % 7}", f"junk{k:04d}") for k in range(languages)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = train_language_model(docs, rounds=20)
    assert len(model.languages) == min(languages + 2, MOST_STRATA) and {"de", "en"} <= set(model.languages)
    got = {r["doc_id"]: r["lang_pred"] for r in identify_language(docs.where("doc_id < 5000"), model).collect()}
    assert len(got) == 800 and sum(v == ("de" if k < 1000 else "en") for k, v in got.items()) > 700
