"""Ranks, prefix sums and quantiles over a total order, without a global window.

A window without PARTITION BY, or over one hot key, puts its rows in one task. Here rows get an
*order bucket* instead: a number that grows with the order key and holds a bounded share of the
rows. Bucket totals (one row per bucket) are summed up first; each row then needs only a window
inside its bucket plus the total of the buckets before it.

Bucket bounds come from one pass of quantile sketches. They only steer the balance; results
are exact whatever the bounds are. A value frequent enough to fill a bucket gets a bucket of its own,
which is split again by a unique tie key.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from flowspark.operators.joins import key_join
from flowspark.session import default_buckets, settle

#: Rows that a bucket is meant to hold, where the number of buckets is left open.
_ROWS_PER_BUCKET = 1_000_000


def _as_double(df: DataFrame, column: str) -> Column:
    """The order of a column as a double, independent of the session time zone."""
    kind = dict(df.dtypes)[column]
    if kind == "timestamp_ntz":
        since = f"`{column}` - TIMESTAMP_NTZ'1970-01-01 00:00:00'"
        return F.expr(f"CAST(CAST({since} AS INTERVAL SECOND) AS DECIMAL(20, 6))").cast("double") * 1e6
    if kind == "timestamp":
        return F.unix_micros(column).cast("double")
    if kind == "date":
        return F.unix_date(column).cast("double")
    if kind.split("(")[0] not in ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal"):
        raise TypeError(f"{column} orders rows and must be a number or a time, not {kind}")
    return F.col(column).cast("double")


def _bounds(df: DataFrame, columns: dict[str, Column], buckets: int | None) -> dict[str, list[float]]:
    """For each column, values that cut the rows in about ``buckets`` equal parts.

    Without ``buckets`` their number follows from the rows counted here. One aggregation sketches all
    columns, sketches are merged map-side, and the driver gets the bounds alone.
    """
    aggs = []
    for name, c in columns.items():
        aggs += [F.count(F.when(~F.isnan(c), c)).alias(f"n_{name}"), _sketch(c).alias(f"s_{name}")]
    est = settle(df.agg(*aggs), "bounds")
    rows = est.select(*[f"n_{name}" for name in columns]).first()
    wanted = {}
    for name in columns:
        if rows[f"n_{name}"]:
            n = buckets or max(default_buckets(df.sparkSession), math.ceil(rows[f"n_{name}"] / _ROWS_PER_BUCKET))
            points = F.expr(f"array({', '.join(f'{i / n}D' for i in range(1, n))})")
            wanted[name] = F.kll_sketch_get_quantile_double(f"s_{name}", points)
    found = est.select(*[c.alias(name) for name, c in wanted.items()]).first() if wanted else None
    return {name: list(found[name]) if name in wanted else [] for name in columns}


def _splits(bounds: list[float]) -> tuple[list[float], list[float]]:
    """Bucket edges and the values frequent enough to get a bucket of their own."""
    hot = sorted({a for a, b in zip(bounds, bounds[1:]) if a == b})
    edges = sorted(set(bounds) | {math.nextafter(v, math.inf) for v in hot})
    edges = [e for e in edges if math.isfinite(e)]
    return [-math.inf, *edges, math.inf], hot


def _bucketed(df: DataFrame, edges: list[float], source: Column, out: str) -> DataFrame:
    if len(edges) < 3:  # no rows, or no finite bound: one bucket
        return df.withColumn(out, F.lit(0).cast("long"))
    model = Bucketizer(
        splits=edges, inputCol="_src", outputCol="_dbl", handleInvalid="keep"
    )
    bucket = F.coalesce(F.col("_dbl").cast("long"), F.lit(len(edges)))  # NULL after NaN
    return model.transform(df.withColumn("_src", source)).withColumn(out, bucket).drop("_src", "_dbl")


def order_buckets(
    df: DataFrame, order: str, tie: str | None = None, buckets: int | None = None,
    out: str = "_bucket",
) -> DataFrame:
    """Add ``out``, a number that never falls along ``(order, tie)``.

    NaN and then NULL come last. No bucket holds much more than ``1/buckets`` of the rows: a hot value of ``order`` is divided
    along the quantiles of the numeric key ``tie`` over all rows. Without ``tie`` the values of
    ``order`` are taken to be few rows each (for example already grouped by value).
    """
    if buckets is not None and buckets <= 1:
        return df.withColumn(out, F.lit(0).cast("long"))
    wanted = {"order": _as_double(df, order)}
    if tie is not None:
        wanted["tie"] = _as_double(df, tie)
    bounds = _bounds(df, wanted, buckets)
    edges, hot = _splits(bounds["order"])
    df = _bucketed(df, edges, _as_double(df, order), out)
    if tie is None or not hot:
        return df
    tie_edges, _ = _splits(bounds["tie"])
    df = _bucketed(df, tie_edges, _as_double(df, tie), "_sub")
    is_hot = _as_double(df, order).isin(hot)
    combined = F.col(out) * F.lit(len(tie_edges) + 1) + F.when(is_hot, F.col("_sub")).otherwise(0)
    return df.withColumn(out, combined.cast("long")).drop("_sub")


def bucket_sums(rows: DataFrame, by: list[str], sums: dict[str, Column]) -> DataFrame:
    """Per (``by``, bucket): each sum up to and with the bucket (``name``) and before it
    (``_before_name``). Rows fold map-side; the window sees one row per group and bucket."""
    totals = rows.groupBy(*by, "_bucket").agg(*[F.sum(e).alias(f"_t_{n}") for n, e in sums.items()])
    order = W.partitionBy(*by).orderBy("_bucket")
    upto = order.rowsBetween(W.unboundedPreceding, 0)
    earlier = order.rowsBetween(W.unboundedPreceding, -1)  # not a difference: inf - inf is no number
    return totals.select(
        *by, "_bucket", *[F.sum(f"_t_{n}").over(upto).alias(n) for n in sums],
        *[F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_before_{n}") for n in sums],
    )


def add_running(
    rows: DataFrame, base: DataFrame, order: str, tie: str, by: list[str], sums: dict[str, Column],
    start: DataFrame | None = None,
) -> DataFrame:
    """Running sums on bucketed ``rows``. ``base`` has the same rows and buckets with a shorter plan:
    the bucket totals come from it, so chained calls do not repeat each other's work.

    What comes before a bucket enters its window as one extra first row, so rows are shuffled once,
    by (``by``, bucket), and never joined. ``start`` (``by`` and the sums) adds to it what comes
    before all rows.
    """
    before = bucket_sums(base, by, sums).drop(*sums)
    if start is not None:
        old = start.select(*by, *[F.col(n).alias(f"_start_{n}") for n in sums])
        before = key_join(before, old, by, "left")
        for n in sums:
            old_sum = F.coalesce(F.col(f"_start_{n}"), F.lit(0))
            before = before.withColumn(f"_before_{n}", F.col(f"_before_{n}") + old_sum)
    keys = [*by, "_bucket"]
    own = rows.select(
        *rows.columns, F.lit(1).alias("_real"), *[e.alias(f"_in_{n}") for n, e in sums.items()]
    )
    heads = before.select(
        *[F.col(c) if c in keys else F.lit(None).cast(t).alias(c) for c, t in rows.dtypes],
        F.lit(0).alias("_real"), *[F.col(f"_before_{n}").alias(f"_in_{n}") for n in sums],
    )
    inside = W.partitionBy(*keys).orderBy("_real", F.asc_nulls_last(order), tie)
    inside = inside.rowsBetween(W.unboundedPreceding, 0)
    ran = own.union(heads).select(
        *rows.columns, "_real", *[F.sum(f"_in_{n}").over(inside).alias(n) for n in sums]
    )
    return ran.filter("_real = 1").drop("_real")


def running(
    df: DataFrame, order: str, tie: str, sums: dict[str, Column], by: list[str] = (),
    buckets: int | None = None,
) -> DataFrame:
    """Add running sums (this row included) along ``(order, tie)``, per ``by`` group.

    ``sums`` maps output names to the expression to add up. Rows with equal ``order`` are taken in
    the order of the unique numeric ``tie``. A group of any size is spread over the buckets.
    """
    rows = order_buckets(df, order, tie, buckets)
    return add_running(rows, rows, order, tie, list(by), sums).drop("_bucket")


def global_rank(
    df: DataFrame, order: str, tie: str, by: list[str] = (), out: str = "rank",
    buckets: int | None = None,
) -> DataFrame:
    """Row number along ``(order, tie)``, per ``by`` group."""
    return running(df, order, tie, {out: F.lit(1).cast("long")}, by, buckets)


def value_counts(
    df: DataFrame, value: str, by: list[str] = (), counts: dict[str, Column] | None = None,
    buckets: int | None = None,
) -> DataFrame:
    """One row per distinct value of a group, with its rank range.

    Columns: ``by``, the value, ``n`` (rows with the value), each of ``counts`` (summed), ``start``
    (rows of the group below the value) and ``total`` (rows of the group). Equal values fold in the
    map-side aggregation, so a frequent value is one row.
    """
    by = list(by)
    counts = counts or {}
    rows = df.filter(F.col(value).isNotNull())
    per_value = rows.groupBy(*by, value).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(e).alias(n) for n, e in counts.items()]
    )
    per_value = settle(per_value, "value_counts")
    ranked = running(per_value, value, value, {"_upto": F.col("n")}, by, buckets)
    ranked = ranked.withColumn("start", F.col("_upto") - F.col("n")).drop("_upto")
    totals = per_value.groupBy(*by).agg(F.sum("n").alias("total"))
    if not by:
        return ranked.withColumn("total", totals.scalar())
    return key_join(ranked, settle(totals, "totals"), by)


def average_rank(
    df: DataFrame, value: str, by: list[str] = (), counts: dict[str, Column] | None = None,
    buckets: int | None = None,
) -> DataFrame:
    """:func:`value_counts` with ``avg_rank``: the mean rank of the rows that share the value."""
    return value_counts(df, value, by, counts, buckets).withColumn(
        "avg_rank", F.col("start") + (F.col("n") + 1) / 2
    )


#: Size of a quantile sketch, and the number of equal steps that are read from it: a step is wider than the
#: rank error of such a sketch, so that bounds a step or two away from a quantile hardly ever miss it.
_SKETCH, _STEPS = 2048, 200
#: Rows of a group that may be counted by value; with more of them, windows are narrowed by a further pass.
_INSIDE = 5_000_000


def _position(q: float) -> Column:
    return F.lit(float(q)) * (F.col("_total") - 1)


def _sketch(v: Column) -> Column:
    return F.kll_sketch_agg_double(F.when(~F.isnan(v), v), F.lit(_SKETCH))


def _steps(m: Column, sketch: Column) -> Column:
    """Values at the ranks 1, 2, ... steps; NULL for a sketch of no rows."""
    ranks = F.expr(f"array({', '.join(f'{i / _STEPS}D' for i in range(1, _STEPS))})")
    return F.when(m > 0, F.kll_sketch_get_quantile_double(sketch, ranks))


def _windows(est: DataFrame, qs: dict[str, float], spare: int | None) -> DataFrame:
    """Move the ends of each window to ``spare`` steps around its quantile. NaN, the greatest value, is an
    open upper end. Without ``spare`` the ends stay."""
    if spare is None:
        return est
    out = {}
    for name, q in qs.items():
        m, steps = F.greatest(F.col(f"_m_{name}"), F.lit(1)), F.col(f"_steps_{name}")
        first = F.floor((F.floor(_position(q)) - F.col(f"_below_{name}")) / m * _STEPS) - spare
        last = F.ceil((F.ceil(_position(q)) + 1 - F.col(f"_below_{name}")) / m * _STEPS) + spare
        low, high = F.get(steps, (first - 1).cast("int")), F.get(steps, (last - 1).cast("int"))
        out[f"_lo_{name}"] = F.coalesce(low, F.col(f"_lo_{name}"))
        out[f"_hi_{name}"] = F.coalesce(high, F.col(f"_hi_{name}"))
    return est.withColumns(out)


def _inside(name: str) -> Column:
    return (F.col("_v") >= F.col(f"_lo_{name}")) & (F.col("_v") <= F.col(f"_hi_{name}"))


def _narrowed(rows: DataFrame, windows: DataFrame, qs: dict[str, float], keys: list[str]) -> DataFrame:
    """Counts and sketches of the rows inside each window, in one aggregation."""
    ends = [c for n in qs for c in (f"_lo_{n}", f"_hi_{n}")]
    joined = key_join(rows, windows.select(*keys, "_total", *ends), keys)
    aggs = [F.max("_total").alias("_total")]
    for n in qs:
        aggs += [F.max(f"_lo_{n}").alias(f"_lo_{n}"), F.max(f"_hi_{n}").alias(f"_hi_{n}"),
                 F.count_if(F.col("_v") < F.col(f"_lo_{n}")).alias(f"_below_{n}"),
                 F.count_if(_inside(n) & ~F.isnan("_v")).alias(f"_m_{n}"),
                 _sketch(F.when(_inside(n), F.col("_v"))).alias(f"_s_{n}")]
    out = settle(joined.groupBy(*keys).agg(*aggs), "narrowed")
    return out.withColumns({f"_steps_{n}": _steps(F.col(f"_m_{n}"), F.col(f"_s_{n}")) for n in qs})


def _counted(rows: DataFrame, windows: DataFrame, qs: dict[str, float], keys: list[str]) -> DataFrame:
    """Both neighbours of each quantile from one counted pass; NULL where a window misses its place.

    Rows inside a window are counted by value, all others by the stretch between windows they are in.
    """
    ends = [c for n in qs for c in (f"_lo_{n}", f"_hi_{n}")]
    joined = key_join(rows, windows.select(*keys, "_total", *ends), keys)
    inside = reduce(lambda a, b: a | b, [_inside(n) for n in qs])
    stretch = reduce(lambda a, b: a + b, [(F.col("_v") > F.col(f"_hi_{n}")).cast("int") for n in qs])
    counts = joined.groupBy(
        *keys, F.when(inside, F.col("_v")).alias("_value"), F.when(~inside, stretch).alias("_stretch")
    ).agg(F.count(F.lit(1)).alias("n"), F.max("_v").alias("_last"), F.max("_total").alias("_total"))
    before = W.partitionBy(*keys).orderBy("_last").rowsBetween(W.unboundedPreceding, -1)
    placed = counts.withColumn("_from", F.coalesce(F.sum("n").over(before), F.lit(0).cast("long")))

    def at(p: Column) -> Column:
        here = (p >= F.col("_from")) & (p < F.col("_from") + F.col("n")) & F.col("_stretch").isNull()
        return F.max(F.when(here, F.col("_value")))

    return settle(placed.groupBy(*keys).agg(
        F.max("_total").alias("_total"),
        *[at(F.floor(_position(q))).alias(f"_left_{n}") for n, q in qs.items()],
        *[at(F.ceil(_position(q))).alias(f"_right_{n}") for n, q in qs.items()],
    ), "quantiles")


def column_quantiles(
    df: DataFrame, columns: list[str], qs: dict[str, float], by: list[str] = ()
) -> DataFrame:
    """Exact quantiles with linear interpolation of several columns: a row per ``by`` group and column
    (``feature``) with a known value. NaN is the greatest value.

    One aggregation sketches all columns of all groups; the sketches bound where each quantile lies, and one
    pass counts the rows inside those bounds by value and all others as a whole. Results do not rest on
    the sketches: if bounds miss a quantile, which the counts show, they are widened for that group and
    counted again, at last over all its values. Where bounds hold too many rows they are narrowed first.
    """
    by, keys = list(by), [*by, "feature"]
    doubles = df.select(*by, *[F.col(c).cast("double").alias(c) for c in columns])
    aggs = []
    for i, c in enumerate(columns):
        aggs += [F.count(c).alias(f"_t{i}"), F.count(F.when(~F.isnan(c), F.col(c))).alias(f"_m{i}"),
                 _sketch(F.col(c)).alias(f"_s{i}")]
    each = F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(f"_t{i}").alias("_total"), F.col(f"_m{i}").alias("_m"),
                 _steps(F.col(f"_m{i}"), F.col(f"_s{i}")).alias("_steps")) for i, c in enumerate(columns)
    ])).alias("_e")
    est = doubles.groupBy(*by).agg(*aggs).select(*by, each).select(*by, "_e.*").filter("_total > 0")
    est = settle(est, "sketches")
    most = est.agg(F.max("_total")).first()[0] or 0
    whole = est.select(*keys, "_total", *[c for n in qs for c in (
        F.lit(-math.inf).alias(f"_lo_{n}"), F.lit(math.nan).alias(f"_hi_{n}"), F.lit(0).alias(f"_below_{n}"),
        F.col("_m").alias(f"_m_{n}"), F.col("_steps").alias(f"_steps_{n}"))])
    rows = doubles.unpivot(by, columns, "feature", "_v").filter("_v IS NOT NULL")
    start, held = whole, 5 / _STEPS * most  # rows in a window
    while held > _INSIDE:
        start = _narrowed(rows, _windows(start, qs, 1), qs, keys)
        held *= 5 / _STEPS
    missing = reduce(lambda a, b: a | b, [F.col(f"_{s}_{n}").isNull() for n in qs for s in ("left", "right")])
    found, left = [], rows
    for from_, spare in ((start, 1), (whole, 20), (whole, None)):
        done = _counted(left, _windows(from_, qs, spare), qs, keys)
        found.append(done.filter(~missing))
        again = done.filter(missing).select(*keys)
        if not again.take(1):
            break
        left = key_join(rows, again, keys)
    done = reduce(DataFrame.unionByName, found)

    def between(name: str, q: float) -> Column:
        lo, hi = F.col(f"_left_{name}"), F.col(f"_right_{name}")
        share = _position(q) - F.floor(_position(q))
        return F.when(lo == hi, lo).otherwise(lo + share * (hi - lo))  # inf - inf is no number

    return done.select(*keys, *[between(name, q).alias(name) for name, q in qs.items()])


def exact_quantiles(df: DataFrame, value: str, qs: dict[str, float], by: list[str] = ()) -> DataFrame:
    """:func:`column_quantiles` of one column: one row per ``by`` group with a known value."""
    rows = df.select(*by, F.col(value).cast("double").alias("_x"))
    return column_quantiles(rows, ["_x"], qs, by).drop("feature")
