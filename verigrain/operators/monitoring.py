"""Model and bust-out monitoring: confusion metrics, drift, detection rate, sweeps, ranking quality, histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verigrain.functions.basics import before, clip01, elapsed_days, ratio

SCORE_BUCKETS = tuple(k / 10 for k in range(1, 11))


def confusion(predictions: DataFrame, *by: str, threshold: float = 0.5) -> DataFrame:
    """Counts and ratios per group over predictions whose outcome is known."""
    positive, actual = F.col("score") > threshold, F.col("actual")
    known = predictions.where(actual.isNotNull())
    counts = known.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(positive & actual).alias("tp"), F.count_if(positive & ~actual).alias("fp"), F.count_if(~positive & actual).alias("fn"), F.count_if(~positive & ~actual).alias("tn"),
    )
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    found = counts.withColumn("precision", p).withColumn("recall", r).withColumn("accuracy", ratio(F.col("tp") + F.col("tn"), F.col("total")))
    return found.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def drift(predictions: DataFrame, as_of: Column, recent_days: int = 7, base_days: int = 90, allowed: float = 0.1) -> DataFrame:
    """Precision and recall per model in both windows, in one pass, and whether they moved by more than allowed."""
    positive, actual = F.col("score") > 0.5, F.col("actual")
    sums = {}
    for name, days in (("recent", recent_days), ("base", base_days)):
        within = F.col("ts") >= before(as_of, days)
        sums |= {f"{name}_tp": F.count_if(within & positive & actual), f"{name}_p": F.count_if(within & positive), f"{name}_a": F.count_if(within & actual)}
    found = predictions.where(actual.isNotNull()).groupBy("model").agg(*[c.alias(k) for k, c in sums.items()])
    for name in ("recent", "base"):
        found = found.withColumn(f"{name}_precision", ratio(F.col(f"{name}_tp"), F.col(f"{name}_p"))).withColumn(f"{name}_recall", ratio(F.col(f"{name}_tp"), F.col(f"{name}_a")))
    moved = (F.abs(F.col("recent_precision") - F.col("base_precision")) > allowed) | (F.abs(F.col("recent_recall") - F.col("base_recall")) > allowed)
    return found.withColumn("has_drift", moved).drop(*sums)


def matched_events(events: DataFrame, predictions: DataFrame) -> DataFrame:
    """Bust-out events with the account's last prediction up to them: predicted, probability, lead_days."""
    last = events.join(predictions.select("account_id", "probability", F.col("ts").alias("predicted_at")), "account_id", "left")
    last = last.where(F.col("predicted_at").isNull() | (F.col("predicted_at") <= F.col("event_at")))
    found = last.groupBy("account_id", "event_at", "amount_lost").agg(F.max(F.struct("predicted_at", "probability")).alias("m"))
    lost = events.join(found.select("account_id", "event_at", "m"), ["account_id", "event_at"], "left")
    probability = F.col("m.probability")
    predicted = F.coalesce(probability > 0.5, F.lit(False))
    return lost.select("account_id", "event_at", "amount_lost", probability.alias("probability"), predicted.alias("predicted"), F.when(predicted, elapsed_days(F.col("event_at"), F.col("m.predicted_at"))).alias("lead_days"))


def detection_rate(matched: DataFrame) -> DataFrame:
    """One row: events, detected, rate, mean lead (leads of 0 days left out), loss and loss of detected events."""
    money = F.col("amount_lost").cast("decimal(18,2)")
    found = matched.agg(
        F.count(F.lit(1)).alias("events"), F.count_if("predicted").alias("detected"), F.coalesce(F.avg(F.nullif(F.col("lead_days"), F.lit(0))), F.lit(0.0)).alias("avg_lead_days"),
        F.coalesce(F.sum(money), F.lit(0)).cast("double").alias("total_loss"), F.coalesce(F.sum(F.when(F.col("predicted"), money)), F.lit(0)).cast("double").alias("prevented_loss"),
    )
    return found.withColumn("detection_rate", ratio(F.col("detected"), F.col("events")))


def threshold_sweep(predictions: DataFrame, thresholds: tuple[float, ...] = (0.3, 0.5, 0.7, 0.8, 0.9)) -> DataFrame:
    """Precision and recall from each threshold on; every row is read once and counted for all of them."""
    known = predictions.where(F.col("actual").isNotNull())
    each = F.explode(F.array(*[F.struct(F.lit(x).alias("threshold"), (F.col("score") >= x).alias("hit")) for x in thresholds]))
    found = known.select("actual", each.alias("e")).groupBy("e.threshold").agg(F.count_if(F.col("e.hit") & F.col("actual")).alias("tp"), F.count_if("e.hit").alias("flagged"), F.count_if("actual").alias("positives"))
    return found.withColumn("precision", ratio(F.col("tp"), F.col("flagged"))).withColumn("recall", ratio(F.col("tp"), F.col("positives")))


def roc_auc(predictions: DataFrame) -> DataFrame:
    """One row: positives, negatives and the area under the ROC curve, from counts per distinct score.

    Tied scores share their mean rank. Scores are brought down to one row each before any order is needed, so the
    window runs over distinct scores, not over predictions.
    """
    per = predictions.where(F.col("actual").isNotNull()).groupBy("score").agg(F.count_if("actual").alias("p"), F.count_if(~F.col("actual")).alias("n"))
    below = F.coalesce(F.sum("n").over(Window.orderBy("score").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    wins = per.select("p", "n", (F.col("p") * (below + F.col("n") / 2.0)).alias("w"))
    found = wins.agg(F.sum("p").alias("positives"), F.sum("n").alias("negatives"), F.sum("w").alias("w"))
    return found.select("positives", "negatives", F.try_divide(F.col("w"), F.col("positives") * F.col("negatives")).alias("auc"))


def lead_time(matched: DataFrame) -> DataFrame:
    """Mean and median lead of predicted events, and the share above 30 days."""
    return matched.where("predicted").agg(
        F.count(F.lit(1)).alias("true_positives"), F.avg("lead_days").alias("mean_lead"), F.percentile("lead_days", F.lit(0.5)).alias("median_lead"), F.avg((F.col("lead_days") > 30).cast("double")).alias("share_over_30d")
    )


def histogram(scores: DataFrame, column: str = "score", buckets: tuple[float, ...] = SCORE_BUCKETS) -> DataFrame:
    """Cumulative counts: how many scores are at most each bound."""
    each = F.explode(F.array(*[F.struct(F.lit(b).alias("le"), (F.col(column) <= b).alias("hit")) for b in buckets]))
    return scores.select(each.alias("e")).groupBy("e.le").agg(F.count_if("e.hit").alias("count"))


def breach_exposure(people: DataFrame, breaches: DataFrame, as_of: Column) -> DataFrame:
    """Per person the number of breaches of their id or e-mail and the mean aged severity, clipped; 0 without any.

    ``people`` has a row for each person, ``breaches`` one or more for each record. Records are added up by id, by
    e-mail and by both, so a person meets three sums, not all records: by id plus by e-mail less those by both.
    """
    aged = F.col("severity") * F.greatest(F.lit(0.1), 1.0 - elapsed_days(as_of, F.col("found_at")) / 365.0)
    records = breaches.groupBy("record_id").agg(F.max(F.struct("severity", "found_at")).alias("r")).select("record_id", "r.*").select("record_id", aged.alias("aged"))
    by_ssn = breaches.where("ssn_key IS NOT NULL").select("record_id", "ssn_key").distinct()
    by_mail = breaches.where("email IS NOT NULL").select("record_id", "email").distinct()
    out = people
    for name, of in (("s", by_ssn), ("m", by_mail), ("b", by_ssn.join(by_mail, "record_id"))):
        keys = [c for c in of.columns if c != "record_id"]
        sums = of.join(records, "record_id").groupBy(*keys).agg(F.count(F.lit(1)).alias(f"{name}_n"), F.count("aged").alias(f"{name}_known"), F.sum("aged").alias(f"{name}_sum"))
        out = out.join(sums, keys, "left")
    total = lambda x: F.coalesce(f"s_{x}", F.lit(0)) + F.coalesce(f"m_{x}", F.lit(0)) - F.coalesce(f"b_{x}", F.lit(0))
    mean = F.coalesce(F.try_divide(total("sum"), total("known")), F.lit(0.0))
    return out.select("identity_key", total("n").alias("breaches"), clip01(mean).alias("exposure"))
