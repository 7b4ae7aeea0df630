"""Preparation of flow tables: projections, filters, duplicates, unions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from flowspark.schemas import CLASS, IDENTITY


def drop_identity(df: DataFrame, cols: list[str] = (*IDENTITY, CLASS)) -> DataFrame:
    """Drop the address, port and class columns that are present."""
    return df.drop(*cols)


def features_label(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """Feature vector (in the given order) and label."""
    vector = F.array(*[F.col(f).cast("double") for f in features])
    return df.select(vector.alias("features"), F.col(label).alias("label"))


def malicious(df: DataFrame, flag: str = "is_malicious") -> DataFrame:
    return df.filter(F.col(flag))


def drop_outliers(df: DataFrame, col: str, limit: float) -> DataFrame:
    """Keep rows whose value is finite and at most ``limit`` in size."""
    return df.filter(~F.isnan(col) & (F.abs(col) <= limit))


def duplicate_count(df: DataFrame, cols: list[str]) -> DataFrame:
    """Rows, distinct rows and rows that repeat an earlier one, over ``cols``."""
    groups = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n_rows"),
        F.count(F.lit(1)).alias("n_distinct"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("n_duplicates"),
    )


def dup_by_class(df: DataFrame, cols: list[str], cls: str, key: str) -> DataFrame:
    """Rows that repeat an earlier row (by ``key``) when the class is ignored, counted by class.

    Rows are folded to one per (cols, class) before the shuffle, so a combination shared by a third
    of the table is one row per class; the class that owns the first key has one repeat fewer.
    """
    folded = df.groupBy(*cols, cls).agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("first"))
    place = F.struct("first", cls)
    owner = place == F.min(place).over(W.partitionBy(*cols))
    repeats = folded.withColumn("repeats", F.col("n") - F.when(owner, 1).otherwise(0))
    return (
        repeats.groupBy(cls).agg(F.sum("repeats").alias("duplicates")).filter("duplicates > 0")
    )


def dedup(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def union_clients(dfs: list[DataFrame]) -> DataFrame:
    """All rows of all client tables, matched by column name."""
    return reduce(lambda a, b: a.unionByName(b), dfs)


def central(df: DataFrame, client: str = "client_id") -> DataFrame:
    """Central data set: distinct rows over all clients (a split column keeps splits apart)."""
    keep = [c for c in df.columns if c != client]
    return df.select(*keep).dropDuplicates()


def class_counts(df: DataFrame, col: str) -> DataFrame:
    """Rows per class, most frequent first."""
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.asc(col))


def class_share(df: DataFrame, col: str) -> DataFrame:
    """Share of each class in the rows."""
    counts = df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / counts.agg(F.sum("n").alias("t")).scalar())


def n_largest(df: DataFrame, col: str, n: int, ties: list[str] = ()) -> DataFrame:
    """The ``n`` rows with the largest values."""
    order: list[Column] = [F.desc(col), *[F.asc(t) for t in ties]]
    return df.orderBy(*order).limit(n)
