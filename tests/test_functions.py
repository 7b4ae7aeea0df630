import datetime

import pytest
from pyspark.sql import functions as F

from flowspark import functions as fn
from flowspark.functions.scalar import epoch_to_timestamp


def values(spark, schema, rows, column):
    df = spark.createDataFrame([(r,) for r in rows], schema)
    return [r[0] for r in df.select(column).collect()]


def test_duration_text(spark):
    seconds = [0.25, 1.0, 1.2, 59.4, 80.0, 90.0, 3599.0, 3600.0, 7200.0]
    assert values(spark, "s double", seconds, fn.fmt_duration("s")) == [
        "250ms", "1 second", "1 seconds", "59 seconds", "1 minute", "2 minutes", "60 minutes",
        "1 hour", "2 hours",
    ]


def test_number_text(spark):
    assert values(spark, "x double", [0.5, 1234.56789, 0.00005, 12.0], fn.fmt_seconds("x")) == [
        "0.5000s", "1,234.5679s", "0.0001s", "12.0000s",
    ]
    assert values(spark, "x double", [12.3456], fn.fmt_pct("x")) == ["12.3456"]
    counts = [0, 7, 999, 1000, 1234, 9950, 12345, 999_499, 999_500, 3_000_000, 2_500_000_000]
    assert values(spark, "x long", counts, fn.fmt_compact("x")) == [
        "0", "7", "999", "1K", "1.2K", "10K", "12K", "999K", "1M", "3M", "2.5B",
    ]
    assert values(spark, "b boolean", [True, False], fn.fmt_bool("b")) == ["True", "False"]


def test_lenient_parse(spark):
    texts = ["x", "3.5", "", None, "1e3", "-2", "3.5f", "7 "]
    assert values(spark, "s string", texts, fn.to_float("s")) == [0, 3.5, 0, 0, 1000, -2, 0, 0]
    assert values(spark, "s string", ["443", "", "x", None, "4.5"], fn.to_int("s")) == [443, 0, 0, 0, 0]


def test_keys(spark):
    name = ["client-2: Beta"]
    assert values(spark, "s string", name, fn.client_no("s")) == [2]
    assert values(spark, "s string", name, fn.client_dataset("s")) == ["BETA"]
    files = ["metrics_5_1.json", "metrics_fedavg.json", "metrics.json"]
    assert values(spark, "s string", files, fn.run_key("s")) == ["5_1", "fedavg", ""]


def test_logistic(spark):
    assert values(spark, "z double", [0.0, 1e-9, -3.0], fn.decide("z")) == [False, True, False]
    assert values(spark, "z double", [0.0], fn.sigmoid("z")) == [0.5]
    df = spark.createDataFrame([(800.0, 0), (-800.0, 1), (0.0, 1)], "z double, y int")
    losses = [r[0] for r in df.select(fn.bce("z", "y")).collect()]
    assert losses == pytest.approx([800.0, 800.0, 0.6931471805599453])


def test_latency(spark):
    sent = datetime.datetime(2024, 1, 1, 0, 0, 0, 250_000)
    now = datetime.datetime(2024, 1, 1, 0, 0, 1, 750_001)
    df = spark.createDataFrame([(sent, now)], "a timestamp, b timestamp")
    assert df.select(fn.latency_s("a", "b")).first()[0] == 1.500001
    moment = spark.createDataFrame([(1704067200.25,)], "e double").select(
        F.unix_micros(epoch_to_timestamp("e"))
    )
    assert moment.first()[0] == 1704067200250000


def test_alert_id_is_stable_and_distinct(spark):
    df = spark.range(100).withColumn("id2", fn.alert_id("id"))
    assert df.select("id2").distinct().count() == 100
    assert df.first()["id2"] == df.first()["id2"]


def test_normal_distribution(spark):
    import math
    from statistics import NormalDist

    from flowspark.functions.normal import normal_quantile, upper_tail

    ps = [1e-300, 1e-15, 1e-5, 0.01, 0.07, 0.2, 0.5, 0.63, 0.925, 0.99, 1 - 1e-9]
    got = values(spark, "p double", ps, normal_quantile(F.col("p")))
    assert got == pytest.approx([NormalDist().inv_cdf(p) for p in ps], rel=1e-13, abs=1e-15)
    zs = [-9.0, -3.0, -0.5, 0.0, 0.3, 0.66, 0.67, 1.96, 4.0, 5.6, 5.7, 12.0, 30.0]
    got = values(spark, "z double", zs, upper_tail(F.col("z")))
    assert got == pytest.approx([0.5 * math.erfc(z / math.sqrt(2)) for z in zs], rel=1e-12)
