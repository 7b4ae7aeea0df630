"""Model-quality metrics and reports over metric logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from flowspark.functions import bce
from flowspark.operators.order_stats import column_quantiles


def confusion(pred: str, label: str) -> list[Column]:
    """The four counts of a binary decision, for one aggregation."""
    p, y = F.col(pred).cast("boolean"), F.col(label).cast("boolean")
    return [
        F.count_if(p & y).alias("tp"), F.count_if(p & ~y).alias("fp"),
        F.count_if(~p & y).alias("fn"), F.count_if(~p & ~y).alias("tn"),
    ]


def rates(counts: DataFrame) -> DataFrame:
    """Accuracy, precision, recall and F1 from the four counts; a rate over nothing is 0."""

    def over(top: str, bottom: str) -> Column:
        return F.coalesce(F.expr(f"try_divide({top}, {bottom})"), F.lit(0.0))

    return counts.select(
        "*",
        over("tp + tn", "tp + fp + fn + tn").alias("accuracy"),
        over("tp", "tp + fp").alias("precision"),
        over("tp", "tp + fn").alias("recall"),
        over("2 * tp", "2 * tp + fp + fn").alias("f1_score"),
    )


def binary_metrics(df: DataFrame, pred: str, label: str, by: list[str] = ()) -> DataFrame:
    return rates(df.groupBy(*by).agg(*confusion(pred, label)))


def bce_loss(df: DataFrame, logit: str, label: str, by: list[str] = ()) -> DataFrame:
    """Mean binary cross-entropy with logits."""
    return df.groupBy(*by).agg(F.avg(bce(logit, label)).alias("loss"))


def weighted_metric(df: DataFrame, value: str, weight: str, by: list[str] = ()) -> DataFrame:
    """Mean of ``value`` with weights."""
    total = F.sum(F.col(value) * F.col(weight)) / F.sum(weight)
    return df.groupBy(*by).agg(total.alias(value))


def federated_eval(df: DataFrame, round_: str, client: str, logit: str, label: str) -> DataFrame:
    """Per round, loss and accuracy of the clients weighted by their rows."""
    pred = F.col(logit) > 0
    per_client = df.withColumn("_p", pred).groupBy(round_, client).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg((F.col("_p") == F.col(label).cast("boolean")).cast("double")).alias("accuracy"),
        F.avg(bce(logit, label)).alias("loss"),
    )
    return per_client.groupBy(round_).agg(
        (F.sum(F.col("loss") * F.col("n")) / F.sum("n")).alias("loss"),
        (F.sum(F.col("accuracy") * F.col("n")) / F.sum("n")).alias("accuracy"),
        F.sum("n").alias("n"),
    )


def last_round(log: DataFrame) -> DataFrame:
    """Final value of each (client, metric, model)."""
    return log.groupBy("client", "metric", "model").agg(
        F.max("round").alias("round"), F.max_by("value", "round").alias("value")
    )


def metric_report(log: DataFrame) -> DataFrame:
    """Mean (per cent), median, sample variance, sample deviation (per cent), max and min."""
    keys = ["client", "metric"]
    return log.groupBy(*keys).agg(
        (F.avg("value") * 100).alias("mean"),
        F.var_samp("value").alias("variance"),
        (F.stddev_samp("value") * 100).alias("std"),
        F.max("value").alias("max"), F.min("value").alias("min"),
        F.median("value").alias("median"),
    )


def best_model(losses: DataFrame) -> DataFrame:
    """The model with the smallest loss in its last round; the first one on ties."""
    final = losses.groupBy("model").agg(F.max_by("loss", "round").alias("loss"))
    return final.agg(
        F.min_by("model", F.struct("loss", "model")).alias("model"), F.min("loss").alias("loss")
    )


def metric_by_round(log: DataFrame, losses: DataFrame, metric: str) -> DataFrame:
    """A metric by client and round (from 1) for the best model."""
    best = best_model(losses).select("model").scalar()
    rows = log.filter((F.col("metric") == metric) & (F.col("model") == best))
    place = F.row_number().over(W.partitionBy("client").orderBy("round"))
    return rows.select("client", "model", place.alias("round"), "value")


#: What the parts of a run key are, in order, for approaches that vary more than the epochs.
RUN_SETTINGS = {"fedprox": ["epochs", "mu"], "fedadam": ["epochs", "tau", "eta", "eta_l"]}


def run_settings(key: Column, approach: str) -> list[Column]:
    """The settings of a run, taken from its key, as number columns; NULL where a part is no number."""
    parts = F.split(key, "_")
    names = RUN_SETTINGS.get(approach, ["epochs"])
    return [F.get(parts, F.lit(i)).try_cast("double").alias(name) for i, name in enumerate(names)]


def loss_curve(log: DataFrame, approach: str, metric: str = "final_loss") -> DataFrame:
    """Loss by round (from 1) of the first model of each run, next to the settings of the run."""
    runs = ["run", "client"]
    rows = log.filter(F.col("metric") == metric)
    rows = rows.withColumn("_first", F.min("model").over(W.partitionBy(*runs)))
    rows = rows.filter(F.col("model") == F.col("_first"))
    return rows.select(
        *run_settings(F.col("run"), approach), "client",
        F.row_number().over(W.partitionBy(*runs).orderBy("round")).alias("round"),
        F.col("value").alias("loss"),
    )


def describe(df: DataFrame, cols: list[str]) -> DataFrame:
    """Count, mean, sample deviation, min, quartiles and max; a row per column."""
    doubles = df.select(*[F.col(c).cast("double").alias(c) for c in cols])
    rows = doubles.unpivot([], cols, "feature", "_x")
    basic = rows.groupBy("feature").agg(
        F.count("_x").alias("n"), F.avg("_x").alias("mean"), F.stddev_samp("_x").alias("std"),
        F.min("_x").alias("min"), F.max("_x").alias("max"),
    )
    points = column_quantiles(doubles, cols, {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    return basic.join(points, "feature", "left")
