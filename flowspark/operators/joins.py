"""Joins on grouping keys, which may hold NULL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F


def key_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join that treats NULL keys as equal and keeps one copy of the keys."""
    right = right.select(
        *[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)],
        *[c for c in right.columns if c not in keys],
    )
    match = reduce(
        lambda a, b: a & b, [left[k].eqNullSafe(right[f"_key{i}"]) for i, k in enumerate(keys)]
    )
    return left.join(right, match, how).drop(*[f"_key{i}" for i in range(len(keys))])


def fill_dimension(
    dim: DataFrame, counts: DataFrame, key: str, value: str = "value"
) -> DataFrame:
    """Counts for every row of a fixed list: 0 where absent; keys outside the list are dropped."""
    joined = dim.join(counts.select(key, value), key, "left")
    return joined.withColumn(value, F.coalesce(F.col(value), F.lit(0).cast("long")))
