"""Ranks, prefix sums and quantiles: exact for any number of buckets, any ties, any group size."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from flowspark.operators import monitor, order_stats as os_
from flowspark.operators.running_top import running_top


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(3)
    n = 3000
    t = rng.integers(0, 400, n).astype(float)
    t[: n // 3] = 77.0  # one value holds a third of the rows
    return pd.DataFrame(
        {"id": np.arange(n), "t": t, "x": rng.normal(size=n).round(3),
         "g": np.where(rng.random(n) < 0.4, "hot", rng.choice(["a", "b", "c"], n))}
    )


@pytest.mark.parametrize("buckets", [1, 2, 16, 64])
def test_running_sums(spark, frame, buckets):
    df = spark.createDataFrame(frame).repartition(5)
    out = os_.running(df, "t", "id", {"s": F.col("x"), "n": F.lit(1).cast("long")}, buckets=buckets)
    got = out.toPandas().sort_values(["t", "id"])
    assert list(got["n"]) == list(range(1, len(frame) + 1))
    np.testing.assert_allclose(got["s"], frame.sort_values(["t", "id"])["x"].cumsum(), atol=1e-9)


def test_hot_value_is_split(spark, frame):
    rows = os_.order_buckets(spark.createDataFrame(frame), "t", "id", 30)
    sizes = rows.groupBy("_bucket").count().toPandas()["count"]
    assert sizes.max() <= 3 * len(frame) / 30
    edges = rows.groupBy("_bucket").agg(
        F.min(F.struct("t", "id")).alias("lo"), F.max(F.struct("t", "id")).alias("hi")
    ).orderBy("_bucket").collect()
    assert all(tuple(a["hi"]) < tuple(b["lo"]) for a, b in zip(edges, edges[1:]))


@pytest.mark.parametrize("buckets", [1, 8])
def test_rank_in_groups(spark, frame, buckets):
    got = os_.global_rank(spark.createDataFrame(frame), "t", "id", ["g"], buckets=buckets).toPandas()
    want = frame.sort_values(["t", "id"])
    want["rank"] = want.groupby("g").cumcount() + 1
    merged = got.merge(want[["id", "rank"]], on="id")
    assert (merged["rank_x"] == merged["rank_y"]).all()


def test_null_group_is_kept(spark):
    df = spark.createDataFrame(
        [(1, 1.0, None), (2, 2.0, None), (3, 3.0, "a")], "id long, t double, g string"
    )
    got = {r["id"]: r["rank"] for r in os_.global_rank(df, "t", "id", ["g"], buckets=4).collect()}
    assert got == {1: 1, 2: 2, 3: 1}


@pytest.mark.parametrize("buckets", [1, 6])
def test_missing_order_comes_last(spark, buckets):
    rows = [(i, float(i % 5) if i % 4 else None) for i in range(40)] + [(40, float("nan"))]
    df = spark.createDataFrame(rows, "id long, t double")
    got = [r["id"] for r in os_.global_rank(df, "t", "id", buckets=buckets).orderBy("rank").collect()]
    want = sorted(rows, key=lambda r: (2 if r[1] is None else 1 if r[1] != r[1] else 0,
                                       0.0 if r[1] is None or r[1] != r[1] else r[1], r[0]))
    assert got == [r[0] for r in want]


def test_text_cannot_order_rows(spark):
    df = spark.createDataFrame([(1, "9"), (2, "10")], "id long, t string")
    with pytest.raises(TypeError):
        os_.global_rank(df, "t", "id")


def test_times_order_rows(spark):
    df = spark.sql(
        "SELECT id, TIMESTAMP_NTZ'2024-03-31 00:00:00' + make_dt_interval(0, 0, 0, id * 0.001) AS t,"
        " DATE'2024-01-01' + CAST(id AS INT) AS d FROM range(0, 5000)"
    )
    for col in ("t", "d"):
        out = os_.global_rank(df, col, "id", buckets=9).filter("rank <> id + 1")
        assert out.count() == 0


@pytest.mark.parametrize("inside", [5_000_000, 3])
@pytest.mark.parametrize("by", [[], ["g"]])
def test_quantiles(spark, frame, by, inside, monkeypatch):
    monkeypatch.setattr(os_, "_INSIDE", inside)  # with few rows allowed, bounds are narrowed by more passes
    df = spark.createDataFrame(frame)
    qs = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    for col in ("x", "t"):
        got = os_.exact_quantiles(df, col, qs, by).toPandas()
        parts = frame.groupby("g") if by else [(None, frame)]
        assert len(got) == len(list(parts))
        for g, part in parts:
            row = got[got["g"] == g].iloc[0] if by else got.iloc[0]
            for q, level in qs.items():
                assert row[q] == pytest.approx(np.quantile(part[col], level), abs=1e-12)


def test_infinite_quantiles(spark):
    inf = float("inf")
    df = spark.createDataFrame([(-inf,), (1.0,), (inf,), (inf,), (inf,), (None,)], "v double")
    row = os_.exact_quantiles(df, "v", {"a": 0.0, "b": 0.25, "c": 0.6, "d": 1.0}).first()
    assert tuple(row) == (-inf, 1.0, inf, inf)


def test_buckets_follow_the_rows(spark, monkeypatch):
    monkeypatch.setattr(os_, "_ROWS_PER_BUCKET", 50)
    df = spark.range(5000).select("id", (F.col("id") % 5).cast("double").alias("t"))
    sizes = os_.order_buckets(df, "t", "id").groupBy("_bucket").count().toPandas()["count"]
    assert len(sizes) > 100 and sizes.max() <= 3 * 50


def test_fixed_quantiles(spark):
    df = spark.createDataFrame([(v,) for v in (1.0, 2.0, 4.0, 8.0)], "v double")
    row = os_.exact_quantiles(df, "v", {"a": 0.5, "b": 0.75, "c": 0.95}).first()
    assert tuple(row) == pytest.approx((3.0, 5.0, 7.4))


@pytest.mark.parametrize("buckets", [None, 1, 6])
def test_value_counts(spark, frame, buckets):
    got = os_.average_rank(spark.createDataFrame(frame), "t", ["g"], buckets=buckets).toPandas()
    want = frame.assign(r=frame.groupby("g")["t"].rank(method="average"))
    want = want.groupby(["g", "t"])["r"].first().reset_index()
    merged = got.merge(want, on=["g", "t"])
    assert len(merged) == len(want)
    np.testing.assert_allclose(merged["avg_rank"], merged["r"])
    assert got.groupby("g")["n"].sum().to_dict() == frame["g"].value_counts().to_dict()


def test_empty_input(spark):
    df = spark.createDataFrame([], "id long, t double, x double")
    assert os_.running(df, "t", "id", {"s": F.col("x")}).count() == 0
    zeros = monitor.timing_metrics(df, "x").first()
    assert tuple(zeros) == (0.0,) * 7


def test_published_run_times(spark):
    times = [29.0] * 27 + [36.0, 40.0, 50.0]
    df = spark.createDataFrame([(3, t) for t in times], "workers int, timer double")
    row = monitor.throughput_summary(df, "workers", "timer").first()
    assert tuple(row)[1:] == pytest.approx((30.3, 29, 29, 38.2, 47.1))


def test_no_global_window_over_rows(spark, frame):
    """The only single-partition exchange is the one over bucket totals."""
    df = spark.createDataFrame(frame).withColumn("is_malicious", F.lit(True))
    df = df.withColumn("latency", F.col("x")).withColumn("classification_time", F.col("x"))
    plan = monitor.running_stats(df, "t", "id")._jdf.queryExecution().executedPlan().toString()
    lines = plan.splitlines()
    spots = [i for i, line in enumerate(lines) if "Exchange SinglePartition" in line]
    assert spots
    assert all("HashAggregate" in lines[i + 1] for i in spots)


@pytest.mark.parametrize("buckets", [1, 7])
def test_running_top(spark, frame, buckets):
    frame = frame.assign(bad=frame["id"] % 3 != 0)
    df = spark.createDataFrame(frame).withColumn("bad", F.when(F.col("bad"), True))
    extra = [(-1, 50.0, 0.0, None, True)]  # a flagged row without an address changes nothing
    df = df.union(spark.createDataFrame(extra, "id long, t double, x double, g string, bad boolean"))
    rows = running_top(df, {"top": "g"}, 2, "t", "id", "bad", buckets=buckets).collect()
    got = {r["id"]: [(i["key"], i["value"]) for i in r["top"]] for r in rows}
    counts: dict = {}
    for r in frame.sort_values(["t", "id"]).itertuples():
        if r.bad:
            counts[r.g] = counts.get(r.g, 0) + 1
        best = sorted(counts.items(), key=lambda kv: (kv[1], kv[0]), reverse=True)[:2]
        assert got[r.id] == best


@pytest.mark.parametrize("inside", [5_000_000, 20])
def test_quantiles_of_hot_values_nan_and_groups(spark, inside, monkeypatch):
    """Groups of one row to most of all rows, one value held by a third of them, NaN as greatest value."""
    monkeypatch.setattr(os_, "_INSIDE", inside)
    r = np.random.default_rng(8)
    x = np.where(r.random(6000) < .34, 5.0, r.normal(0, 100, 6000))
    y = np.where(r.random(6000) < .2, np.nan, r.exponential(3, 6000))
    g = np.where(r.random(6000) < .9, 0, r.integers(1, 300, 6000))
    df = spark.createDataFrame(pd.DataFrame({"g": g, "x": x, "y": y}))
    df = df.withColumn("z", F.when(F.col("g") % 2 == 1, F.col("x")))
    qs = {"a": 0.0, "b": 0.01, "c": 0.5, "d": 0.793, "e": 1.0}
    got = {(r["g"], r["feature"]): r for r in os_.column_quantiles(df, ["x", "y", "z"], qs, ["g"]).collect()}
    for group in np.unique(g):
        for name, values in (("x", x), ("y", y)):
            own = np.sort(values[g == group])  # NaN last
            for q, level in qs.items():
                p = level * (len(own) - 1)
                lo, hi = own[int(np.floor(p))], own[int(np.ceil(p))]
                want = lo if lo == hi or (np.isnan(lo) and np.isnan(hi)) else lo + (p - np.floor(p)) * (hi - lo)
                assert got[group, name][q] == pytest.approx(want, abs=1e-9, nan_ok=True)
        assert ((group, "z") in got) == (group % 2 == 1)
    assert os_.column_quantiles(df.limit(0), ["x"], qs).count() == 0


def test_missed_quantiles_are_counted_again(spark, monkeypatch):
    """Bounds that lie wrong cost a pass, not the result."""
    monkeypatch.setattr(os_, "_steps", lambda m, s: F.array_repeat(F.lit(1e9), 199))
    df = spark.createDataFrame([(float(v),) for v in range(1000)], "v double")
    assert tuple(os_.exact_quantiles(df, "v", {"a": 0.25, "b": 0.5}).first()) == pytest.approx((249.75, 499.5))
