"""Toxicity by a factorization machine over hashed terms.

The terms of a text are its words and word stems, each once. Beside a weight for every term the machine learns a
short vector, and the product of two terms' vectors is the weight of their meeting in one text. That is how an
insult counts for more beside the mention of a group than the two do apart, which additive weights cannot say.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from verigrain.llm.sampling import labelled_sample
from verigrain.llm.textkit import HashOf, as_bytes, sigmoid, slices, words_of

TERM_BITS = 20
FACTORS = 8
STEMS = (4, 5, 7)
TELLING_L2, COMMON_L2 = 1e-4, 2e-2


class TermsOf:
    """Hashed terms of a text: each distinct word, and its first 4, 5 and 7 characters where it is longer."""

    def __init__(self) -> None:
        def mix(word: bytes) -> int:
            chars = word.decode("utf-8", "replace")
            terms = [b"w:" + word] + [b"s:" + chars[:n].encode() for n in STEMS if len(chars) > n]
            packed = 0
            for k, term in enumerate(terms):
                packed |= (xxhash.xxh3_64_intdigest(term) % ((1 << TERM_BITS) - 1) + 1) << (TERM_BITS * k)
            return packed

        self.table = HashOf(mix)

    def __call__(self, text: bytes) -> np.ndarray:
        mask, out = (1 << TERM_BITS) - 1, set()
        for packed in map(self.table.__getitem__, set(words_of(text))):
            while packed:
                out.add(packed & mask)
                packed >>= TERM_BITS
        return np.fromiter(out, np.int64, len(out))


@dataclass
class ToxicityModel:
    terms: np.ndarray = field(repr=False)  # sorted hashes that the training texts made known
    linear: np.ndarray = field(repr=False)
    factors: np.ndarray = field(repr=False)
    bias: float

    def rows(self, hashes: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.terms, hashes), max(len(self.terms) - 1, 0))
        return at[self.terms[at] == hashes] if len(self.terms) else at[:0]

    def margin(self, hashes: np.ndarray) -> float:
        rows = self.rows(hashes)
        v = self.factors[rows] / np.sqrt(max(len(rows), 1))
        total = v.sum(0)
        return float(self.bias + self.linear[rows].sum() + 0.5 * (total @ total - (v * v).sum()))


def telling_terms(texts: list[np.ndarray], label: np.ndarray, least_z: float, common: float) -> tuple[np.ndarray, np.ndarray]:
    """Terms whose share differs between the labels by ``least_z`` standard errors, in all texts or in those that hold
    a term of toxic texts, so that a term that tells something only beside another is kept; and those that so many
    texts have (share ``common``) that their meeting others can matter. With each its larger number of errors."""
    terms = np.unique(np.concatenate(texts))
    rows = [np.searchsorted(terms, t) for t in texts]

    def difference(chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Standard errors by which the share in toxic texts is above that in others, and how many texts have a term."""
        n1, n0 = label[chosen].sum(), (1 - label[chosen]).sum()
        seen, toxic = np.zeros(len(terms)), np.zeros(len(terms))
        if not n1 or not n0:
            return toxic, seen
        for k in chosen:
            seen[rows[k]] += 1
            toxic[rows[k]] += label[k]
        p = (seen + 1) / (n1 + n0 + 2)
        return (toxic / n1 - (seen - toxic) / n0) / np.sqrt(p * (1 - p) * (1 / n1 + 1 / n0)), seen

    z, seen = difference(np.arange(len(texts)))
    beside = difference(np.array([k for k, r in enumerate(rows) if (z[r] >= least_z).any()], int))[0]
    z = np.maximum(np.abs(z), np.abs(beside))
    kept = (z >= least_z) | (seen >= common * len(texts))
    return terms[kept], z[kept]


def fit_machine(texts: list[np.ndarray], label: np.ndarray, least_z: float, common: float, rounds: int, seed: int) -> ToxicityModel:
    """Adam on the logistic loss, whole batches; both labels weigh alike. Terms that tell little alone shrink more."""
    terms, z = telling_terms(texts, label, least_z, common)
    l2 = np.where(z >= least_z, TELLING_L2, COMMON_L2)
    model = ToxicityModel(terms, np.zeros(len(terms)), np.random.default_rng(seed).normal(0, 0.01, (len(terms), FACTORS)), 0.0)
    rows = [model.rows(t) for t in texts]
    size = np.array([len(r) for r in rows])
    term, text = np.concatenate(rows), np.repeat(np.arange(len(rows)), size)
    order = np.argsort(term, kind="stable")
    by_term, by_text = term[order], text[order]
    weight = np.where(label == 1, 0.5 / max(label.sum(), 1), 0.5 / max((1 - label).sum(), 1))
    scale = 1 / np.sqrt(np.maximum(size, 1))
    starts = np.searchsorted(by_term, np.arange(len(terms)))
    text_starts = np.concatenate([[0], np.cumsum(size)[:-1]])

    def over_texts(values: np.ndarray) -> np.ndarray:
        out = np.zeros((len(rows), *values.shape[1:]))
        full = size > 0
        out[full] = np.add.reduceat(values, text_starts[full], axis=0)
        return out

    params = [model.linear, model.factors, np.zeros(1)]
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    for t in range(1, rounds + 1):
        linear, factors, bias = params
        v = factors[term] * scale[text][:, None]
        total = over_texts(v)
        margin = bias[0] + over_texts(linear[term]) + 0.5 * ((total**2).sum(1) - over_texts((v * v).sum(1)))
        slope = weight * (sigmoid(margin) - label)
        s = slope[by_text]
        pull = s[:, None] * scale[by_text][:, None] * (total[by_text] - factors[by_term] * scale[by_text][:, None])
        grads = [np.add.reduceat(s, starts) + l2 * linear, np.add.reduceat(pull, starts, axis=0) + l2[:, None] * factors, np.array([slope.sum()])]
        for k, g in enumerate(grads):
            m, q = state[k]
            m, q = 0.9 * m + 0.1 * g, 0.99 * q + 0.01 * g * g
            state[k] = m, q
            params[k] = params[k] - 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(q / (1 - 0.99**t)) + 1e-9)
    return ToxicityModel(terms, params[0], params[1], float(params[2][0]))


def train_toxicity_model(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    folds: int = 3, held_out: int = 1, cap: int = 2500, least_z: float = 4.0, common: float = 0.2, rounds: int = 80, seed: int = 3,
) -> ToxicityModel:
    """Fit on at most about ``cap`` documents of each label, none of the held-out fold.

    Null ids, null labels and labels of unknown documents are left out. Without both labels the model scores every
    text 0 (no toxic example) or 1 (no other example), and 0 without any.
    """
    sample = labelled_sample(labels, label_col, id_col, folds, held_out, cap, seed).select(F.col(id_col).alias("id"), "sample_label")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(sample), "id")

    @arrow_udf("binary")
    def hashed(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        terms = TermsOf()
        for texts in columns:
            yield pa.array([np.sort(terms(t)).astype(np.uint32).tobytes() for t in as_bytes(texts)], pa.binary())

    got = texts.select("id", "sample_label", hashed("text").alias("x")).orderBy("id", F.crc32("x")).collect()
    label = np.array([r["sample_label"] for r in got])
    if not len(got) or label.min() == label.max():
        return ToxicityModel(np.zeros(0, np.int64), np.zeros(0), np.zeros((0, FACTORS)), 40.0 if len(got) and label[0] else -40.0)
    return fit_machine([np.frombuffer(r["x"], np.uint32).astype(np.int64) for r in got], label, least_z, common, rounds, seed)


def toxicity_score(model: ToxicityModel, spark, text: Column) -> Column:
    sent = spark.sparkContext.broadcast(model)

    @arrow_udf("double")
    def score(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        terms, model = TermsOf(), sent.value
        for texts in columns:
            found = [model.margin(terms(t)) for some in slices(texts) for t in as_bytes(some)]
            yield pa.array(sigmoid(np.array(found, float)), pa.float64())

    return score(text)


def classify_toxicity(docs: DataFrame, model: ToxicityModel, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """``docs`` plus score (0 to 1, higher: more toxic) and predicted (1 from ``threshold`` on, else 0).

    Null texts score as empty ones; whole texts are read; repeated rows score alike; an empty table gives an empty
    result. Columns named score or predicted are replaced, all others kept.
    """
    docs = docs.drop("score", "predicted")
    scored = docs.withColumn("score", toxicity_score(model, docs.sparkSession, F.col(text_col).cast("string")))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
