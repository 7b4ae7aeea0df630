"""Significance tests: Mann-Whitney U and Shapiro-Wilk, on tables of any size."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from flowspark.functions.normal import normal_quantile, poly, tail_depth, upper_tail
from flowspark.operators.joins import key_join
from flowspark.operators.order_stats import average_rank, global_rank
from flowspark.session import settle


def mann_whitney(df: DataFrame, value: str, group: str, by: list[str] = (), **kw) -> DataFrame:
    """Two-sided test of the rows with ``group`` true (first sample) against the others.

    ``u`` is the statistic of the first sample; ties get average ranks; ``z`` is the asymptotic
    form with tie and continuity correction; NULL where a sample is empty or all values are equal.
    """
    by = list(by)
    first = F.when(F.col(group).cast("boolean"), 1).otherwise(0).cast("long")
    per_value = average_rank(df, value, by, {"_n1": first}, **kw)
    sums = per_value.groupBy(*by).agg(
        F.sum("_n1").alias("n1"),
        (F.sum("n") - F.sum("_n1")).alias("n2"),
        F.sum(F.col("_n1") * F.col("avg_rank")).alias("_r1"),
        F.sum(F.pow(F.col("n").cast("double"), 3) - F.col("n")).alias("_ties"),
    )
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n = n1 + n2
    sums = sums.withColumn("u", F.col("_r1") - n1 * (n1 + 1) / 2)
    spread = F.sqrt(
        n1 * n2 / 12 * ((n + 1) - F.expr("try_divide(_ties, (n1 + n2) * (n1 + n2 - 1.0))"))
    )
    far = F.greatest(F.col("u"), n1 * n2 - F.col("u")) - n1 * n2 / 2 - 0.5
    z = F.try_divide(far, spread)
    scored = sums.withColumn("z", F.when((n1 > 0) & (n2 > 0), z))
    return scored.select(*by, "n1", "n2", "u", "z")


def mann_whitney_p(df: DataFrame, value: str, group: str, by: list[str] = (), **kw) -> DataFrame:
    """:func:`mann_whitney` with the two-sided p-value."""
    tested = mann_whitney(df, value, group, by, **kw)
    return tested.withColumn("p", F.least(F.lit(1.0), 2 * upper_tail(F.col("z"))))


# Royston (1995), algorithm AS R94, ascending powers.
_LAST = [0.0, 0.221157, -0.147981, -2.071190, 4.434685, -2.706056]
_SECOND = [0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633]
_MEAN_SMALL = [0.5440, -0.39978, 0.025054, -6.714e-4]
_SD_SMALL = [1.3822, -0.77857, 0.062767, -0.0020322]
_MEAN_LARGE = [-1.5861, -0.31082, -0.083751, 0.0038915]
_SD_LARGE = [-0.4803, -0.082676, 0.0030302]
_GAMMA = [-2.273, 0.459]
# End of fixed values.


def shapiro(
    df: DataFrame, value: str, key: str, by: list[str] = (), buckets: int | None = None
) -> DataFrame:
    """Shapiro-Wilk W and p of each group, over all its rows.

    Rank, expected normal score and both sums of W are computed row by row, so a large group needs
    no task of its own. ``key`` is a unique number that orders equal values. Groups of fewer than 3
    rows or of equal values give NULL; p is calibrated for up to 5,000 rows.
    """
    by = list(by)
    rows = df.filter(F.col(value).isNotNull()).select(
        *by, F.col(value).cast("double").alias("_x"), F.col(key).alias("_key")
    )
    sizes = rows.groupBy(*by).agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.avg("_x").alias("_mean")
    )
    ranked = global_rank(rows, "_x", "_key", by, "_rank", buckets)
    if by:
        ranked = key_join(ranked, settle(sizes, "sizes"), by)
    else:
        one = settle(sizes, "sizes").select(F.struct("*").alias("s")).scalar()
        ranked = ranked.withColumn("n", one["n"]).withColumn("_mean", one["_mean"])
    n, i = F.col("n"), F.col("_rank")
    scored = ranked.withColumn("_p", (i - 0.375) / (n + 0.25))
    scored = scored.withColumn("_t", tail_depth(F.col("_p")))
    scored = scored.withColumn("_m", normal_quantile(F.col("_p"), F.col("_t")))
    centred = F.col("_x") - F.col("_mean")
    # The two outermost scores on each side get their own weights; all others are proportional.
    edge = F.when(i == n, 1).when(i == 1, -1).otherwise(0)
    second = F.when(i == n - 1, 1).when(i == 2, -1).otherwise(0)
    inner = (i > 2) & (i < n - 1)
    sums = scored.groupBy(*by, "n").agg(
        F.sum(F.col("_m") * F.col("_m")).alias("_mm"),
        F.max(F.when(i == n, F.col("_m"))).alias("_m1"),
        F.max(F.when(i == n - 1, F.col("_m"))).alias("_m2"),
        F.sum(centred * centred).alias("_ss"),
        F.sum(edge * F.col("_x")).alias("_d1"),
        F.sum(second * F.col("_x")).alias("_d2"),
        F.sum(F.when(inner, F.col("_m") * centred)).alias("_inner"),
        F.sum(F.when((i > 1) & (i < n), F.col("_m") * centred)).alias("_inner1"),
    )
    sums = sums.withColumn("_root", 1 / F.sqrt("n")).withColumn("_log", F.log("n"))
    root = F.col("_root")
    a1 = poly(_LAST, root) + F.col("_m1") / F.sqrt("_mm")
    a2 = poly(_SECOND, root) + F.col("_m2") / F.sqrt("_mm")
    sums = sums.withColumn("_a1", a1).withColumn("_a2", a2)
    phi_small = (F.col("_mm") - 2 * F.pow("_m1", F.lit(2))) / (1 - 2 * F.pow("_a1", F.lit(2)))
    phi_large = (
        F.col("_mm") - 2 * F.pow("_m1", F.lit(2)) - 2 * F.pow("_m2", F.lit(2))
    ) / (1 - 2 * F.pow("_a1", F.lit(2)) - 2 * F.pow("_a2", F.lit(2)))
    top = (
        F.when(n == 3, F.col("_d1") * math.sqrt(0.5))
        .when(n <= 5, F.col("_a1") * F.col("_d1") + F.col("_inner1") / F.sqrt(phi_small))
        .otherwise(
            F.col("_a1") * F.col("_d1") + F.col("_a2") * F.col("_d2")
            + F.coalesce(F.col("_inner"), F.lit(0.0)) / F.sqrt(phi_large)
        )
    )
    w = F.least(F.lit(1.0), F.try_divide(F.pow(top, F.lit(2)), F.col("_ss")))
    sums = sums.withColumn("w", F.when((n >= 3) & (F.col("_ss") > 0), w))
    sums = sums.withColumn("_gap", F.log(1 - F.col("w")))
    log_n, gap = F.col("_log"), F.col("_gap")
    small = (
        -F.log(poly(_GAMMA, n) - gap) - poly(_MEAN_SMALL, n)
    ) / F.exp(poly(_SD_SMALL, n))
    large = (gap - poly(_MEAN_LARGE, log_n)) / F.exp(poly(_SD_LARGE, log_n))
    exact3 = F.lit(6 / math.pi) * (F.asin(F.sqrt("w")) - F.lit(math.asin(math.sqrt(0.75))))
    sums = sums.withColumn("_z", F.when(n <= 11, small).otherwise(large))
    tail = upper_tail(F.col("_z"))
    p = F.when(n == 3, F.greatest(exact3, F.lit(0.0))).otherwise(tail)
    return sums.select(
        *by, F.col("n").cast("long").alias("n"), "w", F.when(F.col("w").isNotNull(), p).alias("p")
    )
