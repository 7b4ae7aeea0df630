"""Answers of the live monitor over alerts: totals, breakdowns, rankings, running values.

Alert columns: ``src_ip``, ``dst_ip``, ``is_malicious``, ``latency``, ``classification_time``,
``worker``, a time ``ts`` and a unique numeric ``event_id``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from flowspark.operators.joins import key_join
from flowspark.operators.order_stats import exact_quantiles, running

TIMING_POINTS = {"median": 0.5, "quantile_75": 0.75, "quantile_95": 0.95, "quantile_99": 0.99}


def alert_totals(df: DataFrame) -> DataFrame:
    """Packets, malicious packets, mean latency and mean classification time."""
    return df.agg(
        F.count(F.lit(1)).alias("total_packets"),
        F.count_if("is_malicious").alias("total_malicious"),
        F.avg("latency").alias("avg_latency"),
        F.avg("classification_time").alias("avg_classification_time"),
    )


def malicious_pct(df: DataFrame) -> DataFrame:
    """Malicious share in per cent; NULL for no rows."""
    return df.agg(
        (F.lit(100.0) * F.try_divide(F.count_if("is_malicious"), F.count(F.lit(1))))
        .alias("malicious_pct")
    )


def traffic_mix(df: DataFrame) -> DataFrame:
    """Packets by category, ``normal`` and ``malicious``."""
    totals = alert_totals(df)
    return totals.select(
        F.expr(
            "stack(2, 'normal', total_packets - total_malicious, 'malicious', total_malicious)"
            " AS (category, packets)"
        )
    )


def address_counts(df: DataFrame, col: str) -> DataFrame:
    """Malicious packets per address."""
    rows = df.filter("is_malicious").groupBy(F.col(col).alias("key"))
    return rows.agg(F.count(F.lit(1)).alias("value"))


def worker_counts(df: DataFrame) -> DataFrame:
    """Classified packets per worker."""
    return df.groupBy(F.col("worker").alias("key")).agg(F.count(F.lit(1)).alias("value"))


def top_addresses(df: DataFrame, col: str, n: int = 5) -> DataFrame:
    """The ``n`` addresses with most malicious packets; equal counts by address descending."""
    return address_counts(df, col).orderBy(F.desc("value"), F.desc("key")).limit(n)


def ranked(top: DataFrame) -> DataFrame:
    """Number the rows of a top-n list (at most n rows)."""
    order = W.partitionBy().orderBy(F.desc("value"), F.desc("key"))
    return top.withColumn("rank", F.row_number().over(order))


def latest(df: DataFrame, n: int = 8, order: str = "ts", tie: str = "event_id") -> DataFrame:
    """The ``n`` newest alerts, newest first."""
    return df.orderBy(F.desc(order), F.desc(tie)).limit(n)


def timing_metrics(df: DataFrame, col: str, by: list[str] = (), total: str | None = None) -> DataFrame:
    """Mean, median, p75, p95, p99, max and min. Without ``by``, zeros for no rows.

    ``total`` names a further group of all rows, which is worked out in the same passes as the groups.
    """
    by = list(by)
    if total is not None:
        (name,) = by
        own = F.struct(F.col(name).cast("string").alias(name), F.lit(False).alias("_whole"))
        whole = F.struct(F.lit(total).alias(name), F.lit(True).alias("_whole"))
        rows = df.select(F.explode(F.array(own, whole)).alias("_g"), F.col(col)).select("_g.*", col)
        return timing_metrics(rows, col, [name, "_whole"]).drop("_whole")
    basic = df.groupBy(*by).agg(
        F.avg(col).alias("mean"),
        F.max(F.col(col).cast("double")).alias("max"),
        F.min(F.col(col).cast("double")).alias("min"),
    )
    points = exact_quantiles(df, col, TIMING_POINTS, by)
    names = ["mean", *TIMING_POINTS, "max", "min"]
    if by:
        return key_join(basic, points, by, "left").select(*by, *names)
    point = points.select(F.struct("*").alias("p")).scalar()
    both = basic.select("mean", "max", "min", *[point[p].alias(p) for p in TIMING_POINTS])
    return both.select(*[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in names])


def run_rollup(df: DataFrame, run: str) -> DataFrame:
    """Roll up worker records (one row per run and worker) to a row per run."""
    return df.groupBy(run).agg(
        F.count(F.lit(1)).alias("total_files"),
        F.sum("processed_packets").alias("processed_packets"),
        F.sort_array(F.collect_list("total_timer")).alias("timers"),
        F.avg("total_timer").alias("mean"),
    )


def throughput_summary(df: DataFrame, workers: str, timer: str) -> DataFrame:
    """Timing bundle over runs, by number of workers."""
    return timing_metrics(df, timer, [workers]).drop("max", "min")


def running_stats(
    df: DataFrame, order: str = "ts", tie: str = "event_id", buckets: int | None = None
) -> DataFrame:
    """Totals and means of the known times as they stand after each alert."""
    sums = {
        "total_packets": F.lit(1).cast("long"),
        "total_malicious": F.col("is_malicious").cast("long"),
    }
    times = {"avg_latency": "latency", "avg_classification_time": "classification_time"}
    for out, col in times.items():
        sums |= {f"_sum_{out}": F.col(col), f"_known_{out}": F.col(col).isNotNull().cast("long")}
    rows = running(df, order, tie, sums, buckets=buckets)
    return rows.select(
        *df.columns, "total_packets", "total_malicious",
        *[F.try_divide(f"_sum_{out}", f"_known_{out}").alias(out) for out in times],
    )


def running_address_counts(
    df: DataFrame, col: str, order: str = "ts", tie: str = "event_id", buckets: int | None = None
) -> DataFrame:
    """For each malicious alert, the malicious packets of its address so far."""
    return running(
        df.filter("is_malicious"), order, tie, {"running_count": F.lit(1).cast("long")}, [col], buckets
    )
