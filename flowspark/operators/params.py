"""Model parameters as rows, and the rules that combine client models.

Columns: ``round``, ``client``, ``layer``, ``pos``, ``value`` and a ``weight`` per client. Each rule
is one aggregation per (round, layer, pos), so it grows with clients x parameters and holds no model
in the driver. A group of it has a row per client.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window as W, functions as F

KEY = ["round", "layer", "pos"]


def batch_weight(rows: str, batch_size: int = 512):
    """Number of batches, as an alternative weight to the number of rows."""
    return F.ceil(F.col(rows) / batch_size).cast("long")


def fed_avg(params: DataFrame) -> DataFrame:
    """Weighted mean of each parameter."""
    mean = F.sum(F.col("value") * F.col("weight")) / F.sum("weight")
    return params.groupBy(*KEY).agg(mean.alias("value"))


def fed_median(params: DataFrame) -> DataFrame:
    """Unweighted median of each parameter."""
    return params.groupBy(*KEY).agg(F.median("value").alias("value"))


def fed_trimmed(params: DataFrame, beta: float = 0.2) -> DataFrame:
    """Mean after cutting ``floor(beta * clients)`` values at each end."""
    if not 0 <= beta < 0.5:
        raise ValueError("beta must be at least 0 and below one half")
    own = W.partitionBy(*KEY)
    ranked = params.filter(F.col("value").isNotNull()).select(
        *KEY, "value", F.row_number().over(own.orderBy("value")).alias("_rank"),
        F.count(F.lit(1)).over(own).alias("_total"),
    )
    cut = F.floor(F.lit(beta) * F.col("_total"))
    kept = ranked.filter((F.col("_rank") > cut) & (F.col("_rank") <= F.col("_total") - cut))
    return kept.groupBy(*KEY).agg(F.avg("value").alias("value"))


def fed_adaptive(
    state: DataFrame, params: DataFrame, kind: str, eta: float = 0.1, tau: float = 1e-9,
    beta_1: float = 0.9, beta_2: float = 0.99,
) -> DataFrame:
    """Adaptive server step on the weighted mean: ``adagrad``, ``adam`` or ``yogi``.

    ``state`` holds ``value``, ``m`` and ``v`` per parameter; the result is the next state.
    """
    mean = fed_avg(params).withColumnRenamed("value", "_mean")
    rows = state.join(mean, KEY).withColumn("_d", F.col("_mean") - F.col("value"))
    d, m, v = F.col("_d"), F.col("m"), F.col("v")
    if kind == "adagrad":
        next_m, next_v = d, v + d * d
    elif kind == "adam":
        next_m = beta_1 * m + (1 - beta_1) * d
        next_v = beta_2 * v + (1 - beta_2) * d * d
    elif kind == "yogi":
        next_m = beta_1 * m + (1 - beta_1) * d
        next_v = v - (1 - beta_2) * d * d * F.signum(v - d * d)
    else:
        raise ValueError(f"unknown adaptive rule {kind!r}")
    stepped = rows.select(*KEY, "value", next_m.alias("m"), next_v.alias("v"))
    return stepped.withColumn(
        "value", F.col("value") + eta * F.col("m") / (F.sqrt("v") + F.lit(tau))
    )


def pair_params(a: DataFrame, b: DataFrame, keys: list[str] = ("layer", "pos")) -> DataFrame:
    """Parameters of two models side by side: ``value_a``, ``value_b``."""
    left = a.withColumnRenamed("value", "value_a")
    right = b.select(*keys, F.col("value").alias("value_b"))
    return left.join(right, list(keys))


def param_distance(a: DataFrame, b: DataFrame, by: list[str] = ()) -> DataFrame:
    """Sum over layers of the Euclidean distance, and whether the models are equal."""
    by = list(by)
    pairs = pair_params(a.select(*by, "layer", "pos", "value"), b, [*by, "layer", "pos"])
    gap = F.col("value_a") - F.col("value_b")
    layers = pairs.groupBy(*by, "layer").agg(
        F.sqrt(F.sum(gap * gap)).alias("_norm"),
        F.count_if(F.col("value_a") != F.col("value_b")).alias("_unequal"),
    )
    return layers.groupBy(*by).agg(
        F.sum("_norm").alias("distance"), (F.sum("_unequal") == 0).alias("equal")
    )


def params_equal(a: DataFrame, b: DataFrame, by: list[str] = ()) -> DataFrame:
    """Whether two models agree in every parameter."""
    return param_distance(a, b, by).drop("distance")


def fedplus_mix(
    local: DataFrame, global_: DataFrame, lr: float, delta: float = 0.1, constraint: float = 0.9,
    keys: list[str] = ("round", "layer", "pos"),
) -> DataFrame:
    """One mixing step ``k * w + (1 - k) * (global + theta)`` of each client parameter."""
    sigma = (1 - constraint) / (lr * constraint)
    k = 1 / (1 + lr * sigma)
    pairs = pair_params(local, global_, list(keys))
    theta = (F.col("value_a") - F.col("value_b")) / (1 + delta)
    mixed = k * F.col("value_a") + (1 - k) * (F.col("value_b") + theta)
    return pairs.withColumn("value", mixed).drop("value_a", "value_b")


# Published defaults of each rule.
_RULES: dict[str, tuple[str, dict]] = {
    "fedavg": ("mean", {}),
    "fedprox": ("mean", {"mu": 1.0}),
    "fedavgplus": ("mean", {"delta": 0.1, "lam": 0.0}),
    "fedmedian": ("median", {}),
    "fedtrimmed": ("trimmed", {"beta": 0.2}),
    "fedadagrad": ("adagrad", {"eta": 0.1, "eta_l": 0.1, "tau": 1e-9}),
    "fedadam": ("adam", {"eta": 0.1, "eta_l": 0.1, "tau": 1e-9, "beta_1": 0.9, "beta_2": 0.99}),
    "fedyogi": ("yogi", {"eta": 0.01, "eta_l": 0.0316, "tau": 1e-3, "beta_1": 0.9, "beta_2": 0.99}),
}
# End of fixed values.


class Strategy:
    """A named aggregation rule with its settings."""

    def __init__(self, name: str, kind: str, settings: dict):
        self.name, self.kind, self.settings = name, kind, settings

    @property
    def adaptive(self) -> bool:
        return self.kind in ("adagrad", "adam", "yogi")

    def client_settings(self) -> dict:
        """Settings the client update must honour."""
        names = {"mu": "mu", "delta": "delta", "lam": "lam", "eta_l": "lr"}
        return {new: self.settings[old] for old, new in names.items() if old in self.settings}

    def aggregate(self, params: DataFrame, state: DataFrame | None = None) -> DataFrame:
        """Next global parameters (with ``m`` and ``v`` for an adaptive rule)."""
        if self.adaptive:
            steps = {k: v for k, v in self.settings.items() if k != "eta_l"}
            return fed_adaptive(state, params, self.kind, **steps)
        rules: dict[str, Callable[[DataFrame], DataFrame]] = {
            "mean": fed_avg,
            "median": fed_median,
            "trimmed": lambda p: fed_trimmed(p, self.settings["beta"]),
        }
        return rules[self.kind](params)


def strategy(name: str, **overrides) -> Strategy:
    """Look up a strategy by name; unknown names and settings are errors."""
    if name not in _RULES:
        raise ValueError(f"unknown strategy {name!r}; known: {', '.join(sorted(_RULES))}")
    kind, defaults = _RULES[name]
    unknown = set(overrides) - set(defaults)
    if unknown:
        raise ValueError(f"strategy {name!r} has no setting {', '.join(sorted(unknown))}")
    return Strategy(name, kind, {**defaults, **overrides})
