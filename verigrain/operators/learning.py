"""Training and applying the two tabular models with Spark ML."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Columns of the scorer's training table; those that a table lacks are left out.
SCORER_FEATURES = (
    "ssn_score", "graph_score", "velocity_score", "credit_behavior_score", "device_score", "shared_ssn_count", "shared_address_count",
    "shared_phone_count", "cluster_size", "au_ratio", "file_age_months", "num_tradelines", "au_accounts",
)
SEQUENCE_FEATURES = (
    "balance_trend", "balance_volatility", "recent_balance_change", "payment_trend", "min_payment_ratio", "avg_utilization", "max_utilization", "utilization_trend",
    "cash_total", "cash_frequency", "recent_cash", "limit_increases", "recent_limit_change", "months_on_books",
)


def prepared(table: DataFrame, wanted: tuple[str, ...], label: str) -> tuple[DataFrame, list[str]]:
    """The wanted columns that exist, nulls as 0, with a double label; and their names."""
    names = [c for c in wanted if c in table.columns]
    columns = {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in names}
    return table.withColumns(columns | {"label": F.col(label).cast("double")}), names


def split(table: DataFrame, key: str, label: str, share: float = 0.8, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Train and test rows; the hash of key and label decides, so both labels are split alike and reruns agree."""
    u = F.pmod(F.xxhash64(F.col(key), F.col(label), F.lit(seed)), F.lit(10_000)) / 10_000.0
    return table.where(u < share), table.where(u >= share)


def fit_scorer(table: DataFrame, label: str = "is_synthetic", trees: int = 100, depth: int = 5, rate: float = 0.1, seed: int = 42) -> PipelineModel:
    rows, names = prepared(table, SCORER_FEATURES, label)
    return Pipeline(stages=[VectorAssembler(inputCols=names, outputCol="features"), GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=rate, seed=seed)]).fit(rows)


def fit_bust_out(table: DataFrame, label: str = "is_bust_out", trees: int = 100, depth: int = 10, seed: int = 42) -> PipelineModel:
    """A random forest whose rows are weighted so that both labels weigh alike."""
    rows, names = prepared(table, SEQUENCE_FEATURES, label)
    counts = {r[0]: r[1] for r in rows.groupBy("label").count().collect()}
    n = sum(counts.values())
    weight = F.when(F.col("label") == 1, n / (2 * counts.get(1.0, n))).otherwise(n / (2 * counts.get(0.0, n)))
    stages = [VectorAssembler(inputCols=names, outputCol="features"), RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, weightCol="weight")]
    return Pipeline(stages=stages).fit(rows.withColumn("weight", weight))


def save_model(model: PipelineModel, path: str) -> None:
    """Write a fitted model where driver and executors can read it; one that is there is replaced."""
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def probabilities(model: PipelineModel, table: DataFrame, wanted: tuple[str, ...], label: str) -> DataFrame:
    rows, _ = prepared(table, wanted, label)
    return model.transform(rows).withColumn("score", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability")


def auc(scored: DataFrame) -> float:
    return BinaryClassificationEvaluator(rawPredictionCol="score").evaluate(scored)
