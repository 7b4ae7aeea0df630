"""Repeatable samples and splits ordered by a hash of the row key.

"The first k rows of each class in hash order" needs no rank for most rows. A radix select narrows
each class to the bucket in which its k-th row lies: a histogram of the next hash digits, folded
map-side, picks a bucket; while that holds more than a leaf's rows, its rows alone are counted by the
digits that follow. Only leaves are sorted. The number of passes follows from the size of the classes, and rows of
one class are spread by their digits, so a class of all rows is no task of its own. Selecting rows is
then a comparison with the hash of the k-th row: narrow scans and one pass, no shuffle of whole rows
as long as the cuts fit a broadcast (beyond that, a join that adaptive execution splits when skewed).
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from flowspark.functions import hash_key
from flowspark.operators.joins import key_join
from flowspark.session import settle

#: Hash digits (of 16 values) that one pass counts by, and digits in all.
_STEP, _WIDTH = 3, 32
#: Rows of a bucket that are sorted rather than divided again.
LEAF_ROWS = 4096


def hash_sample(df: DataFrame, key: str, frac: float, seed: int) -> DataFrame:
    """Keep a fraction of the rows: a filter on the leading 32 bits of the hash."""
    if not 0.0 <= frac <= 1.0:
        raise ValueError("fraction must be between 0 and 1")
    if frac == 1.0:
        return df
    limit = f"{int(frac * 2**32):08x}"
    return df.filter(F.substring(hash_key(key, seed), 1, 8) < F.lit(limit))


def class_sizes(df: DataFrame, cls: str) -> DataFrame:
    return df.groupBy(cls).agg(F.count(F.lit(1)).alias("n"))


def _total(sizes: DataFrame, size: str) -> int:
    return sizes.agg(F.sum(size)).first()[0] or 0


def ranked(df: DataFrame, order: list[Column], out: str) -> DataFrame:
    """Add the row number along a total order, for tables of any size.

    Rows are dealt to ranges of the order; each range is numbered by itself and raised by the rows of
    the ranges before it. The driver holds one count per range.
    """
    spark = df.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id())
    rows = settle(rows, "ranges")
    before, start = [], 0
    sizes = {r["_range"]: r["n"] for r in rows.groupBy("_range").agg(F.count(F.lit(1)).alias("n")).collect()}
    for i in range(max(sizes, default=0) + 1):
        before.append(F.lit(start).cast("long"))
        start += sizes.get(i, 0)
    place = F.row_number().over(W.partitionBy("_range").orderBy(*order))
    return rows.withColumn(out, place + F.get(F.array(*before), F.col("_range"))).drop("_range")


def largest_remainder(sizes: DataFrame, cls: str, size: str, share: float, out: str) -> DataFrame:
    """Divide ``ceil(share * total)`` over classes in proportion to ``size`` so that the parts add up to it.

    Works on one row per class; the classes with the largest remainders, ties by class, get one more.
    """
    total = _total(sizes, size)
    target = math.ceil(share * total)
    ideal = F.lit(float(target)) * F.col(size) / F.lit(float(max(total, 1)))
    base = sizes.withColumn("_ideal", ideal).withColumn("_floor", F.floor("_ideal").cast("long"))
    base = base.withColumn("_left", F.col("_ideal") - F.col("_floor"))
    base = ranked(base, [F.desc("_left"), F.asc(cls)], "_place")
    spare = target - _total(base, "_floor")
    return base.withColumn(
        out, F.col("_floor") + F.when(F.col("_place") <= spare, 1).otherwise(0)
    ).drop("_ideal", "_floor", "_left", "_place")


def _placed(rows: DataFrame, cls: str, leaves: DataFrame) -> DataFrame:
    """The hash at the wanted place of each leaf: rows (cls, _name, _h, _take); that many rows of the
    hash itself are within the place."""
    near = key_join(rows, leaves.drop("_n"), [cls, "_p"])
    order = W.partitionBy(cls, "_p", "_name").orderBy("_h")
    near = near.withColumn("_place", F.row_number().over(order)).withColumn("_rank", F.rank().over(order))
    near = near.filter("_place = _need")
    return near.select(cls, "_name", "_h", (F.col("_place") - F.col("_rank") + 1).alias("_take"))


def _points(
    df: DataFrame, cls: str, hashed: str, quotas: DataFrame, names: list[str], leaf: int = LEAF_ROWS
) -> DataFrame:
    """The radix select of :func:`cuts`, a row per class and quota above 0."""
    rows = df.select(cls, F.col(hashed).alias("_h"))
    spots = quotas.unpivot(cls, names, "_name", "_need").filter("_need > 0")
    spots = spots.withColumn("_p", F.lit(""))
    found, depth = [], 0
    while True:
        inside = rows.withColumn("_p", F.substring("_h", 1, depth))
        if depth:
            inside = key_join(inside, spots.select(cls, "_p").distinct(), [cls, "_p"])
        depth += _STEP
        hist = inside.groupBy(cls, "_p", F.substring("_h", 1, depth).alias("_q")).agg(
            F.count(F.lit(1)).alias("_n")
        )
        upto = F.sum("_n").over(W.partitionBy(cls, "_p").orderBy("_q"))
        near = key_join(hist.withColumn("_upto", upto), spots, [cls, "_p"])
        near = near.filter("_need <= _upto AND _need > _upto - _n")
        spots = settle(
            near.select(cls, "_name", F.col("_q").alias("_p"), F.expr("_need - _upto + _n").alias("_need"), "_n"),
            "cut_buckets",
        )
        last = F.col("_n") <= leaf if depth < _WIDTH else F.lit(True)
        found.append(_placed(rows.withColumn("_p", F.substring("_h", 1, depth)), cls, spots.filter(last)))
        spots = spots.filter(~last).drop("_n")
        if depth >= _WIDTH or spots.isEmpty():
            break
    return reduce(lambda a, b: a.unionByName(b), found)


def cuts(
    df: DataFrame, cls: str, hashed: str, quotas: DataFrame, names: list[str], leaf: int = LEAF_ROWS
) -> DataFrame:
    """For each class and quota, the hash of the row at that place in hash order.

    ``quotas`` has one row per class and a count column per name; the result has the same rows with
    a text column per name: NULL where the quota is 0.
    """
    quotas = settle(quotas.select(cls, *names), "quotas")
    places = _points(df, cls, hashed, quotas, names, leaf).groupBy(cls).agg(
        *[F.max(F.when(F.col("_name") == n, F.col("_h"))).alias(n) for n in names]
    )
    return settle(key_join(quotas.select(cls), places, [cls], "left"), "cuts")


def _with_cuts(rows: DataFrame, cls: str, cut: DataFrame, names: list[str]) -> DataFrame:
    return key_join(rows, cut.select(cls, *[F.col(n).alias(f"_cut_{n}") for n in names]), [cls])


def _within(name: str) -> Column:
    """True for rows up to the cut (a missing cut selects none)."""
    return F.coalesce(F.col("_h") <= F.col(f"_cut_{name}"), F.lit(False))


def stratified_sample(df: DataFrame, cls: str, key: str, n: int, seed: int) -> DataFrame:
    """About ``n`` rows, ``round(n * class / total)`` from each class (halves round up)."""
    sizes = settle(class_sizes(df, cls), "sizes")
    total = F.lit(max(_total(sizes, "n"), 1))
    quotas = sizes.select(
        cls, F.least(F.floor(F.lit(n) * F.col("n") / total + F.lit(0.5)), F.col("n")).alias("keep")
    )
    rows = df.withColumn("_h", hash_key(key, seed))
    cut = cuts(rows, cls, "_h", quotas, ["keep"])
    return _with_cuts(rows, cls, cut, ["keep"]).filter(_within("keep")).select(*df.columns)


def stratified_split(
    df: DataFrame, cls: str, key: str, share: float = 0.2, seed: int = 69, out: str = "split"
) -> DataFrame:
    """Mark each row ``train`` or ``test``; the test part has ``ceil(share * rows)`` rows."""
    if not 0.1 <= share <= 0.5:
        raise ValueError("test share must be between 0.1 and 0.5")
    quotas = largest_remainder(settle(class_sizes(df, cls), "sizes"), cls, "n", share, "test")
    rows = df.withColumn("_h", hash_key(key, seed))
    cut = cuts(rows, cls, "_h", quotas, ["test"])
    marked = _with_cuts(rows, cls, cut, ["test"])
    return marked.select(*df.columns, F.when(_within("test"), "test").otherwise("train").alias(out))


def three_way_split(
    df: DataFrame, cls: str, key: str, seed: int = 69, out: str = "split"
) -> DataFrame:
    """Mark each row ``train`` (60 %), ``eval`` (20 %) or ``test`` (20 %), stratified.

    Forty per cent is set aside first and then halved, each by largest remainder.
    """
    held = largest_remainder(settle(class_sizes(df, cls), "sizes"), cls, "n", 0.4, "held")
    quotas = largest_remainder(held, cls, "held", 0.5, "test")
    rows = df.withColumn("_h", hash_key(key, seed))
    cut = cuts(rows, cls, "_h", quotas, ["test", "held"])
    marked = _with_cuts(rows, cls, cut, ["test", "held"])
    part = F.when(_within("test"), "test").when(_within("held"), "eval").otherwise("train")
    return marked.select(*df.columns, part.alias(out))


def shuffled_head(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """The first ``n`` rows in hash order, sorted by it in as many tasks as there are shuffle partitions.

    Rows of equal keys have one hash; where the cut falls among them, any of them fill the number.
    """
    if n <= 0:
        return df.limit(0)
    rows = df.withColumn("_h", hash_key(key, seed)).filter("_h IS NOT NULL")
    quota = df.sparkSession.range(1).select(F.lit(0).alias("_all"), F.lit(n).cast("long").alias("head"))
    last = _points(rows.withColumn("_all", F.lit(0)), "_all", "_h", quota, ["head"]).first()
    if last is None:  # fewer rows than wanted
        return rows.orderBy("_h").select(*df.columns)
    below = rows.filter(F.col("_h") < F.lit(last["_h"]))
    edge = rows.filter(F.col("_h") == F.lit(last["_h"])).limit(last["_take"])
    return below.unionByName(edge).orderBy("_h").select(*df.columns)
