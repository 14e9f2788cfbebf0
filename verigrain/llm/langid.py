"""Language identification with error-correcting output codes.

Each language gets a codeword of bits. For every bit, a binary classifier over hashed byte n-grams learns to tell
the languages with a 1 there from those with a 0. A text is decoded to the language whose codeword loses least,
each bit's loss weighted by how well its classifier did; a small lead over the second is flagged as ambiguous.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from verigrain.llm.columns import free_name
from verigrain.llm.sampling import bounded
from verigrain.llm.textkit import as_bytes, sigmoid, slices

BUCKETS = 1 << 12
UNDETERMINED = "und"
_ASCII_LETTER = re.compile(rb"[A-Za-z]")


def has_letter(text: bytes) -> bool:
    return bool(_ASCII_LETTER.search(text)) or any(c.isalpha() for c in text.decode("utf-8", "replace"))


def ngram_counts(text: bytes) -> np.ndarray:
    """Counts of hashed byte 2-grams and 3-grams of the whole text, A-Z lower-cased; length BUCKETS, sum 1."""
    b = np.frombuffer(b" " + text.lower() + b" ", np.uint8).astype(np.uint32)
    pairs = b[:-1] * np.uint32(0x9E3779B1) + b[1:] * np.uint32(0x85EBCA77)
    triples = (pairs[:-1] ^ (b[2:] * np.uint32(0xC2B2AE3D))) * np.uint32(0x27D4EB2F)
    places = np.concatenate([pairs * np.uint32(0x165667B1) >> np.uint32(20), triples >> np.uint32(20)])
    counts = np.bincount(places, minlength=BUCKETS).astype(np.float32)
    return np.sqrt(counts / max(len(places), 1))


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """n rows of +1/-1. All distinct splits for up to five languages, else the best of random dense codes."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 5:
        splits = [[1 if (s >> k) & 1 else -1 for k in range(n)] for s in range(1, 1 << (n - 1))]
        return np.array(splits, float).T
    rng, bits, best, widest = np.random.default_rng(seed), int(np.ceil(10 * np.log2(n))), None, -1
    for _ in range(200 if n <= 200 else 10):
        code = rng.choice([-1.0, 1.0], (n, bits))
        near = (bits - code @ code.T) / 2 + np.eye(n) * bits
        usable = (np.abs(code.sum(0)) < n).all()
        if usable and near.min() > widest:
            best, widest = code, near.min()
    return best if best is not None else rng.choice([-1.0, 1.0], (n, bits))


@dataclass
class LanguageModel:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray = field(repr=False)
    bias: np.ndarray
    trust: np.ndarray

    def decode(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best language's index, its score and its lead over the second, for each row of n-gram counts."""
        margins = counts @ self.weights + self.bias
        one = self.code > 0  # the loss of each bit under either value, summed by codeword
        loss = np.logaddexp(0, -margins) @ (one * self.trust).T + np.logaddexp(0, margins) @ (~one * self.trust).T
        likely = np.exp(-(loss - loss.min(1, keepdims=True)) * self.code.shape[1])
        likely /= likely.sum(1, keepdims=True)
        ranked = np.sort(likely, 1)
        lead = ranked[:, -1] - (ranked[:, -2] if likely.shape[1] > 1 else 0)
        return loss.argmin(1), ranked[:, -1], lead


def train_language_model(
    docs: DataFrame, trainable: Column | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    docs_per_language: int = 1500, docs_in_all: int = 12_000, rounds: int = 60, seed: int = 11,
) -> LanguageModel:
    """Fit on at most about ``docs_per_language`` documents of each language, chosen by a hash of the id.

    With many languages each has fewer, so that they are about ``docs_in_all`` together: the driver's memory is
    bounded. Of more than 2000 languages the most frequent are learned. Rows without text or language are left out. Without any row the model knows no language and finds
    every text undetermined.
    """
    rows = docs.where(trainable) if trainable is not None else docs
    rows = rows.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = bounded(rows.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("id").isNotNull()), "id", "lang", docs_per_language, seed, docs_in_all)

    @arrow_udf("binary")
    def sparse(texts: pa.Array) -> pa.Array:
        out = []
        for text in as_bytes(texts):
            counts = ngram_counts(text)
            at = np.flatnonzero(counts).astype(np.uint16)
            out.append(at.tobytes() + counts[at].astype(np.float16).tobytes())
        return pa.array(out, pa.binary())

    got = rows.select("id", "lang", sparse("text").alias("x")).orderBy("id", "lang", F.crc32("x")).collect()  # bounded by docs_per_language
    languages = sorted({r["lang"] for r in got})
    code = codewords(len(languages))
    if not got:
        return LanguageModel([], np.ones((0, 1)), np.zeros((BUCKETS, 1), np.float32), np.zeros(1), np.ones(1))
    x = np.zeros((len(got), BUCKETS), np.float32)
    for k, r in enumerate(got):
        n = len(r["x"]) // 4
        x[k, np.frombuffer(r["x"], np.uint16, n)] = np.frombuffer(r["x"], np.float16, n, 2 * n)
    label = np.array([languages.index(r["lang"]) for r in got])
    weight = (1.0 / np.bincount(label, minlength=len(languages)))[label]
    y, weight = code[label], (weight / weight.sum()).astype(np.float32)
    w, b = np.zeros((BUCKETS, code.shape[1]), np.float32), np.zeros(code.shape[1])
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), np.zeros_like(b), np.zeros_like(b)
    for t in range(1, rounds + 1):  # Adam on the logistic loss
        slope = -(weight[:, None] * y * sigmoid(-y * (x @ w + b))).astype(np.float32)
        g, gb = x.T @ slope + 1e-5 * w, slope.sum(0)
        m, mb = 0.9 * m + 0.1 * g, 0.9 * mb + 0.1 * gb
        v, vb = 0.99 * v + 0.01 * g * g, 0.99 * vb + 0.01 * gb * gb
        a, c = 1 - 0.9**t, 1 - 0.99**t
        w -= (0.5 * (m / a) / (np.sqrt(v / c) + 1e-7)).astype(np.float32)
        b -= 0.5 * (mb / a) / (np.sqrt(vb / c) + 1e-7)
    right = ((np.sign(x @ w + b) == y) * weight[:, None]).sum(0)
    trust = np.maximum(right - 0.5, 1e-3)
    return LanguageModel(languages, code, w, b, trust / trust.sum())


def language_of(model: LanguageModel, spark, text: Column, lead_needed: float = 0.2) -> Column:
    """Struct lang_pred, score, ambiguous of a text column."""
    sent = spark.sparkContext.broadcast(model)

    @arrow_udf("struct<lang_pred:string,score:double,ambiguous:boolean>")
    def identify(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = sent.value
        for texts in columns:
            pred, score, doubt = [], [], []
            for some in slices(texts):
                batch = as_bytes(some)
                known = [bool(model.languages) and has_letter(t) for t in batch]
                if not batch:
                    continue
                best, sure, lead = model.decode(np.stack([ngram_counts(t) for t in batch])) if model.languages else (np.zeros(len(batch), int), np.zeros(len(batch)), np.zeros(len(batch)))
                pred += [model.languages[k] if ok else UNDETERMINED for k, ok in zip(best, known, strict=True)]
                score += [float(s) if ok else 0.0 for s, ok in zip(sure, known, strict=True)]
                doubt += [bool(d < lead_needed) or not ok for d, ok in zip(lead, known, strict=True)]
            yield pa.StructArray.from_arrays(
                [pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(doubt, pa.bool_())], ["lang_pred", "score", "ambiguous"]
            )

    return identify(text)


def identify_language(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """``docs`` plus lang_pred, score (0 to 1) and ambiguous.

    lang_pred is ``und``, with score 0 and ambiguous true, for a null text, a text without any letter, and under a
    model that knows no language. Columns with the added names are replaced; all others are kept. Repeated rows
    get equal answers, an empty table an empty result, and a text is read whole whatever its length.
    """
    docs = docs.drop("lang_pred", "score", "ambiguous")
    name = free_name(docs, "found")
    found = docs.withColumn(name, language_of(model, docs.sparkSession, F.col(text_col).cast("string")))
    return found.withColumns({c: F.col(f"{name}.{c}") for c in ("lang_pred", "score", "ambiguous")}).drop(name)
