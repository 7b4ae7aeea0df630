"""Missing values, infinities and unknown keys."""

import math

import numpy as np
import pytest

from flowspark.operators import metrics, monitor, order_stats, scaling, score

INF = float("inf")


@pytest.mark.parametrize("buckets", [1, 8])
def test_running_sums_over_gaps(spark, buckets):
    values = [1.0, 2.0] + [None] * 10 + [4.0, INF, 5.0]
    df = spark.createDataFrame([(i, i, v) for i, v in enumerate(values)], "t long, id long, x double")
    out = order_stats.running(df, "t", "id", {"s": df["x"]}, buckets=buckets).orderBy("t").collect()
    assert [r["s"] for r in out] == [1.0] + [3.0] * 11 + [7.0, INF, INF]


def test_running_means_count_known_times(spark):
    rows = [(0, 0, True, None, None), (1, 1, False, 2.0, 1.0), (2, 2, False, None, 3.0), (3, 3, True, 4.0, None)]
    df = spark.createDataFrame(
        rows, "ts long, event_id long, is_malicious boolean, latency double, classification_time double")
    out = monitor.running_stats(df, buckets=4).orderBy("ts").collect()
    assert [r["avg_latency"] for r in out] == [None, 2.0, 2.0, 3.0]
    assert [r["avg_classification_time"] for r in out] == [None, 1.0, 2.0, 2.0]


def test_groups_without_a_name(spark):
    df = spark.createDataFrame([(None, "m", 1.0), (None, "m", 3.0), ("a", "m", 5.0)],
                               "client string, metric string, value double")
    report = {r["client"]: r["median"] for r in metrics.metric_report(df).collect()}
    assert report == {None: 2.0, "a": 5.0}
    timing = {r["client"]: r["median"] for r in monitor.timing_metrics(df, "value", ["client"]).collect()}
    assert timing == {None: 2.0, "a": 5.0}


def test_client_without_a_fit_keeps_its_rows(spark):
    fitted = spark.createDataFrame([("a", 1.0), ("a", 3.0)], "client string, x double")
    seen = spark.createDataFrame([("a", 2.0), ("b", 2.0), (None, 2.0)], "client string, x double")
    out = scaling.apply_minmax(seen, scaling.fit_minmax(fitted, ["x"], ["client"]), ["x"], ["client"])
    assert sorted(((r["client"], r["x"]) for r in out.collect()), key=str) == [("a", 0.5), ("b", None), (None, None)]


@pytest.mark.parametrize("tasks", [1, 3])
def test_rows_that_cannot_be_scored(spark, tasks):
    rows = [(1.0, 1.0, "a"), (None, 1.0, "a"), (float("nan"), 0.0, "a"), (-1.0, 0.0, None), (2.0, None, None),
            (None, 1.0, "c")]
    df = spark.createDataFrame(rows, "x double, y double, c string").repartition(tasks)
    out = {r["c"]: r for r in score.evaluate_models(
        df, {"m": [np.array([[1.0]]), np.array([0.0])]}, ["x"], "y", "c").collect()}
    loss = math.log1p(math.exp(-1))
    assert (out["a"]["tp"], out["a"]["fn"], out["a"]["unscored"]) == (1, 0, 2)
    assert abs(out["a"]["final_loss"] - loss) < 1e-12
    assert (out[None]["tn"], out[None]["unscored"]) == (1, 1) and abs(out[None]["final_loss"] - loss) < 1e-12
    assert out["c"]["unscored"] == 1 and out["c"]["final_loss"] is None


def test_keys_in_any_case_and_values_untouched(spark):
    from pyspark.sql import types as T

    from flowspark.schemas import parse_messages

    schema = T.StructType([
        T.StructField("metadata", T.StructType([T.StructField("IPV4_SRC_ADDR", T.StringType())])),
        T.StructField("note", T.StringType()),
    ])
    texts = [
        '{"metadata": {"Ipv4_Src_Addr": "a"}, "NOTE": "n"}',
        r'{"Metadata" : {"ipv4_src_addr" : "a"}, "note": "\"ipv4_src_addr\": \"Note\""}',
        '{"metadata": {"ipv4": "a"}, "note": "n"}', None,
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, value string")
    rows = parse_messages(df, "value", schema).orderBy("i").collect()
    assert [bool(r["valid"]) for r in rows] == [True, True, False, False]
    assert rows[0]["message"]["note"] == "n"
    assert rows[1]["message"]["note"] == '"ipv4_src_addr": "Note"'


def test_only_keys_spelled_otherwise_cost_a_rewrite(spark):
    import time

    from pyspark.sql import functions as F

    from flowspark.schemas import REQUEST, parse_messages

    ends = '"IPV4_SRC_ADDR": "a", "L4_SRC_PORT": 1, "IPV4_DST_ADDR": "\u00e9 \\"packet", "L4_DST_PORT": 2'
    vector = f"[{', '.join(['0.25'] * 300)}]"
    plain = f'{{"send_timestamp": 1.5, "metadata": {{{ends}}}, "packet": {vector}}}'
    turned = f'{{"packet": {vector}, "metadata": {{{ends}}}, "send_timestamp": 1.5}}'
    spellings = [('"packet":', '"Packet":'), ("SRC_PORT", "src_Port"), ('"packet":', '"PACKET" :')]
    odd = [plain.replace(*pair) for pair in spellings]
    twice = plain.replace('"packet":', '"Packet": [1.0], "packet":')
    last = plain[:-1] + ', "PACKET": [2.0]}'
    texts = [plain, turned, *odd, twice, last, "", "no quote", '"', None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, value string")
    got = [r["message"] for r in parse_messages(df, "value", REQUEST).orderBy("i").collect()]
    assert all(m == got[0] for m in got[:6]) and len(got[0]["packet"]) == 300
    assert got[0]["metadata"]["IPV4_DST_ADDR"] == '\u00e9 "packet' and got[6]["packet"] == [2.0]
    assert not any(m and m["packet"] for m in got[7:])

    def seconds(text):
        rows = spark.range(4000, numPartitions=1)
        rows = rows.select(F.concat(F.lit(text), F.repeat(F.lit(" "), F.col("id").cast("int") % 7)).alias("value"))
        took = []
        for _ in range(4):
            begin = time.perf_counter()
            parse_messages(rows, "value", REQUEST).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - begin)
        return min(took)

    assert 1.5 * seconds(plain) < seconds(odd[0])


def test_local_logs_and_unknown_shapes(spark, tmp_path):
    import pytest

    from flowspark.sources import read_metric_log

    path = tmp_path / "local.json"
    path.write_text('{"m1": {"A": {"acc": [0.5, 0.75]}, "B": {"acc": [1.0]}}, "m2": {"A": {"loss": [2.0]}}}')
    rows = read_metric_log(spark, str(path), "local").drop("file").collect()
    assert sorted(tuple(r) for r in rows) == [
        ("A", "acc", "m1", 1, 0.5), ("A", "acc", "m1", 2, 0.75), ("A", "loss", "m2", 1, 2.0),
        ("B", "acc", "m1", 1, 1.0),
    ]
    with pytest.raises(ValueError):
        read_metric_log(spark, str(path), "other")
    with pytest.raises(Exception):
        read_metric_log(spark, str(path)).collect()
