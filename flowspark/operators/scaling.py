"""Min-max, standard and robust scaling. A scaler is a small table with a row per feature."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from flowspark.operators.joins import key_join
from flowspark.operators.order_stats import column_quantiles
from flowspark.session import settle


def _known(c: str) -> Column:
    """The value of a column; NaN counts as missing in every fit."""
    x = F.col(c).cast("double")
    return F.when(~F.isnan(x), x)


def _long(stats: DataFrame, cols: list[str], by: list[str], fields: list[str]) -> DataFrame:
    """From columns ``<feature>__<field>`` to rows (by, feature, fields)."""
    items = [
        F.struct(F.lit(c).alias("feature"), *[F.col(f"{c}__{f}").alias(f) for f in fields])
        for c in cols
    ]
    rows = stats.select(*by, F.explode(F.array(*items)).alias("_s"))
    return rows.select(*by, "_s.*")


def fit_minmax(df: DataFrame, cols: list[str], by: list[str] = ()) -> DataFrame:
    """``scale`` and ``offset`` with ``x * scale + offset`` in 0 .. 1; one pass for all groups.

    A constant column gets scale 1.
    """
    stats = df.groupBy(*by).agg(
        *[
            fn(_known(c)).alias(f"{c}__{name}")
            for c in cols for name, fn in (("data_min", F.min), ("data_max", F.max))
        ]
    )
    rows = _long(stats, cols, list(by), ["data_min", "data_max"])
    span = F.col("data_max") - F.col("data_min")
    scale = F.when(span == 0, F.lit(1.0)).otherwise(F.lit(1.0) / span)
    return rows.withColumn("scale", scale).withColumn("offset", -F.col("data_min") * F.col("scale"))


def fit_standard(df: DataFrame, cols: list[str], by: list[str] = ()) -> DataFrame:
    """Mean and population standard deviation (1 for a constant column)."""
    stats = df.groupBy(*by).agg(
        *[
            fn(_known(c)).alias(f"{c}__{name}")
            for c in cols for name, fn in (("center", F.avg), ("spread", F.stddev_pop))
        ]
    )
    rows = _long(stats, cols, list(by), ["center", "spread"])
    return rows.withColumn("spread", F.when(F.col("spread") == 0, 1.0).otherwise(F.col("spread")))


def fit_robust(df: DataFrame, cols: list[str], by: list[str] = ()) -> DataFrame:
    """Median and interquartile range (1 for a range of 0); no row where all values are missing."""
    by = list(by)
    doubles = df.select(*by, *[_known(c).alias(c) for c in cols])
    rows = column_quantiles(doubles, cols, {"q25": 0.25, "center": 0.5, "q75": 0.75}, by)
    spread = F.col("q75") - F.col("q25")
    return rows.select(
        *by, "feature", "center", F.when(spread == 0, 1.0).otherwise(spread).alias("spread")
    )


def _apply(
    df: DataFrame, scaler: DataFrame, cols: list[str], by: list[str], formula, suffix: str
) -> DataFrame:
    """Replace each column by ``formula(x, row of the scaler)``.

    Without ``by`` the scaler is one row, read as a scalar subquery. With ``by`` it is settled, so
    that its true size decides between a broadcast and a shuffled join. Rows without a fit stay,
    with null in every scaled column.
    """
    by = list(by)
    fields = [c for c in scaler.columns if c not in [*by, "feature"]]
    values = F.struct(*fields)
    wide = scaler.groupBy(*by).agg(
        *[F.max(F.when(F.col("feature") == c, values)).alias(f"_s_{c}") for c in cols]
    )
    if by:
        joined = key_join(df, settle(wide, "scaler"), by, "left")
        at = {c: F.col(f"_s_{c}") for c in cols}
    else:
        joined = df.withColumn("_s", settle(wide, "scaler").select(F.struct("*").alias("s")).scalar())
        at = {c: F.col("_s")[f"_s_{c}"] for c in cols}
    scaled: dict[str, Column] = {
        c + suffix: formula(F.col(c).cast("double"), at[c]) for c in cols
    }
    keep = [F.col(c) for c in df.columns if c not in scaled]
    return joined.select(*keep, *[e.alias(c) for c, e in scaled.items()])


def apply_minmax(
    df: DataFrame, scaler: DataFrame, cols: list[str], by: list[str] = (), form: str = "offset",
    suffix: str = "",
) -> DataFrame:
    """Scale with a fit made on this or another table.

    ``offset``: ``x * scale + offset``, the form the scaler was fitted for. ``legacy_min``:
    ``(x - offset) * scale``, which takes the stored offset for the data minimum.
    """
    if form == "offset":
        formula = lambda x, s: x * s["scale"] + s["offset"]
    elif form == "legacy_min":
        formula = lambda x, s: (x - s["offset"]) * s["scale"]
    else:
        raise ValueError(f"unknown scaler form {form!r}")
    return _apply(df, scaler, cols, by, formula, suffix)


def apply_standard(
    df: DataFrame, scaler: DataFrame, cols: list[str], by: list[str] = (), suffix: str = ""
) -> DataFrame:
    return _apply(df, scaler, cols, by, lambda x, s: (x - s["center"]) / s["spread"], suffix)


apply_robust = apply_standard
