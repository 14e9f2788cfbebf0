"""Quality classifier by positive-unlabelled learning.

Trusted positives and a sample of unlabelled web text train an additive model over quantile bins of style
measures. Training minimises the non-negative unbiased risk: with class prior p, the negative risk is estimated as
the unlabelled risk minus p times the positives' risk as negatives, and is not allowed below zero.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from verigrain.llm.sampling import bounded, crc_fold, labelled_sample
from verigrain.llm.textkit import as_bytes, sigmoid, slices

BINS = 16
_MARKS = b".,!?;:'\"-_|#$%&*@/\\<>()[]{}=+~^"
_N_MEASURES = 24 + len(_MARKS)


def style_measures(text: bytes) -> np.ndarray:
    """Style of a whole text: character classes, marks, word lengths, repetition of words, triples and lines."""
    n = max(len(text), 1)
    seen = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    upper, lower, digits, high = seen[65:91].sum(), seen[97:123].sum(), seen[48:58].sum(), seen[128:].sum()
    letters = max(upper + lower + high, 1)
    words = text.split()
    k = max(len(words), 1)
    counts = Counter(words)
    common = counts.most_common(3)
    triples = len(set(zip(words, words[1:], words[2:], strict=False)))
    lines = text.split(b"\n")
    repeats = sum(a == b for a, b in zip(words, words[1:], strict=False))
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ended = sum(map(text.count, (b".\n", b". ", b"!\n", b"! ", b"?\n", b"? "))) + text.endswith((b".", b"!", b"?"))
    measures = [
        np.log1p(len(text)), np.log1p(len(words)), upper / letters, lower / n, digits / n, high / letters, seen[32] / n, seen[10] / n,
        sizes.mean() if len(words) else 0.0, sizes.std() if len(words) else 0.0, sizes.max() if len(words) else 0.0,
        len(counts) / k, len(counts) / k**0.8, common[0][1] / k if common else 0.0, sum(c for _, c in common) / k,
        triples / max(k - 2, 1), repeats / k, len(lines) / k, len(set(lines)) / len(lines), max(map(len, lines)) / n,
        ended / k, (seen > 0).sum() / n**0.3, seen.max() / n, sum(seen[c] for c in _MARKS) / n,
    ]
    return np.array(measures + [seen[c] / k for c in _MARKS], np.float32)


@dataclass
class QualityModel:
    edges: np.ndarray = field(repr=False)
    weights: np.ndarray = field(repr=False)
    bias: float
    prior: float

    def score(self, measures: np.ndarray) -> np.ndarray:
        return sigmoid(_binned(measures, self.edges) @ self.weights + self.bias)


class Binned:
    """One-hot quantile bins, BINS columns for each measure, by the numbers of the columns that are one."""

    def __init__(self, at: np.ndarray):
        self.at, self.shape = at, (len(at), at.shape[1] * BINS)

    def __len__(self) -> int:
        return len(self.at)

    def __getitem__(self, rows: np.ndarray) -> Binned:
        return Binned(self.at[rows])

    def __matmul__(self, weights: np.ndarray) -> np.ndarray:
        return weights[self.at].sum(1)

    def pulled(self, slope: np.ndarray) -> np.ndarray:
        """The transpose times ``slope``."""
        return np.bincount(self.at.ravel(), np.repeat(slope, self.at.shape[1]), self.shape[1])


def _binned(measures: np.ndarray, edges: np.ndarray) -> Binned:
    at = [j * BINS + np.searchsorted(edges[:, j], measures[:, j], "right") for j in range(edges.shape[1])]
    return Binned(np.stack(at, 1))


def fit_nnpu(positive: Binned, unlabelled: Binned, prior: float, rounds: int = 400, rate: float = 0.05, l2: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative risk under the logistic loss (Adam, whole batches)."""
    w, b, n, u = np.zeros(positive.shape[1]), 0.0, len(positive), len(unlabelled)
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for t in range(1, rounds + 1):
        pos, unl = sigmoid(positive @ w + b), sigmoid(unlabelled @ w + b)
        below = -np.log1p(-np.clip(unl, 0, 1 - 1e-9)).mean() + prior * np.log1p(-np.clip(pos, 0, 1 - 1e-9)).mean()
        # Slopes of the positives' risk and of the negative risk, by the margin of each text.
        if below >= 0:
            by_pos, by_unl = prior * (pos - 1) / n - prior * pos / n, unl / u
        else:  # step back out of a negative risk
            by_pos, by_unl = prior * pos / n, -unl / u
        g = np.append(positive.pulled(by_pos) + unlabelled.pulled(by_unl) + l2 * w, by_pos.sum() + by_unl.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, float(b)


def estimated_prior(positive: Binned, unlabelled: Binned, seed: int, parts: int = 2, turns: int = 3) -> float:
    """Share of positives in the unlabelled text, by the best bin of a score (Garg et al., 2021).

    Above any score the unlabelled text has at least that share of what trusted positives have there. The score is
    taken above which the two shares' quotient, with its margin of error, is least. Each part of either sample is
    scored by a model of the other parts: one that had met the unlabelled texts as negatives would score them too low.
    The better the score, the closer the bound, so each turn scores with the prior that the one before has found.
    """
    rng = np.random.default_rng(seed)
    folds = [rng.permutation(np.arange(len(x)) % parts) for x in (positive, unlabelled)]
    if min(len(positive), len(unlabelled)) < parts:
        return 0.5
    prior = 0.5
    for _ in range(turns):
        scores: tuple[list[np.ndarray], list[np.ndarray]] = ([], [])
        for k in range(parts):
            w, b = fit_nnpu(positive[folds[0] != k], unlabelled[folds[1] != k], prior, rounds=100, l2=1e-3)
            for out, x, fold in zip(scores, (positive, unlabelled), folds, strict=True):
                out.append(x[fold == k] @ w + b)
        trusted, web = (np.sort(np.concatenate(s)) for s in scores)
        above = np.arange(len(trusted), 0, -1) / len(trusted)
        ratio = (len(web) - np.searchsorted(web, trusted)) / len(web) / above
        error = sum(np.sqrt(np.log(40) / 2 / len(x)) for x in (trusted, web)) / above
        prior = float(np.clip(ratio[np.argmin(ratio + error)], 0.05, 0.95))
    return prior


def train_quality_model(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    folds: int = 3, held_out: int = 1, cap: int = 4000, prior: float | None = None, seed: int = 5,
) -> QualityModel:
    """Fit on at most about ``cap`` trusted positives and ``cap`` unlabelled documents, none of the held-out fold.

    The class prior is estimated from positives and unlabelled text, unless given; labels of negatives are not used.
    Null ids, null labels and labels of unknown documents are left out. Without positives the model scores every
    text 0.5.
    """
    trusted = labelled_sample(labels.where(F.col(label_col) > 0), label_col, id_col, folds, held_out, cap, seed).select(F.col(id_col).alias("id"))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    web = bounded(texts.where(crc_fold("id", folds) != held_out).withColumn("all", F.lit(1)), "id", "all", cap, seed + 1)
    positive = _measured(texts.join(F.broadcast(trusted), "id"))  # about ``cap`` ids
    unlabelled = _measured(web)
    if not len(positive) or not len(unlabelled):
        return QualityModel(np.zeros((BINS - 1, _N_MEASURES), np.float32), np.zeros(_N_MEASURES * BINS), 0.0, 0.5)
    edges = np.quantile(np.vstack([positive, unlabelled]), np.arange(1, BINS) / BINS, axis=0).astype(np.float32)
    positive, unlabelled = _binned(positive, edges), _binned(unlabelled, edges)
    if prior is None:
        prior = estimated_prior(positive, unlabelled, seed)
    w, b = fit_nnpu(positive, unlabelled, prior)
    return QualityModel(edges, w, b, prior)


def _measured(rows: DataFrame) -> np.ndarray:
    """Measures of a bounded sample, in order of id."""

    @arrow_udf("binary")
    def measure(texts: pa.Array) -> pa.Array:
        return pa.array([style_measures(t).tobytes() for t in as_bytes(texts)], pa.binary())

    got = rows.select("id", measure("text").alias("x")).orderBy("id", F.crc32("x")).collect()
    return np.array([np.frombuffer(r["x"], np.float32) for r in got]).reshape(-1, _N_MEASURES)


def quality_score(model: QualityModel, spark, text: Column) -> Column:
    sent = spark.sparkContext.broadcast(model)

    @arrow_udf("double")
    def score(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in columns:
            parts = [sent.value.score(np.stack([style_measures(t) for t in as_bytes(some)])) for some in slices(texts) if len(some)]
            yield pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64())

    return score(text)


def classify_quality(docs: DataFrame, model: QualityModel, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """``docs`` plus score (0 to 1, higher: better) and predicted (1 from ``threshold`` on, else 0).

    Null texts score as empty ones; whole texts are read; repeated rows score alike; an empty table gives an empty
    result. Columns named score or predicted are replaced, all others kept.
    """
    docs = docs.drop("score", "predicted")
    scored = docs.withColumn("score", quality_score(model, docs.sparkSession, F.col(text_col).cast("string")))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
