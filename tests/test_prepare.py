import pytest
from pyspark.sql import functions as F

from flowspark.operators import joins, metrics, monitor, prep, sampling, scaling
from flowspark.schemas import ALERT, SNAPSHOT, WORKER_FILE, check_width, validate
from flowspark.sources import (
    read_clients, read_json_glob, read_metric_log, read_packets, read_round_losses, read_scaler,
    read_train_log, write_csv, write_flows, write_metric_log, write_round_losses, write_scaler, write_train_log,
)


def test_duplicates(spark):
    df = spark.createDataFrame([(1, "A", 1), (1, "B", 2), (2, "A", 3)], "x int, c string, k int")
    assert tuple(prep.duplicate_count(df, ["x", "c"]).first()) == (3, 3, 0)
    assert tuple(prep.duplicate_count(df, ["x"]).first()) == (3, 2, 1)
    assert [tuple(r) for r in prep.dup_by_class(df, ["x"], "c", "k").collect()] == [("B", 1)]


def test_duplicates_against_pandas(spark):
    df = spark.range(500).select(
        F.col("id"), (F.col("id") % 7).alias("x"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("c")
    )
    pdf = df.toPandas()
    want = pdf[pdf.duplicated(["x"])]["c"].value_counts().to_dict()
    got = {r["c"]: r["duplicates"] for r in prep.dup_by_class(df, ["x"], "c", "id").collect()}
    assert got == want


def test_central_keeps_splits_apart(spark):
    df = spark.createDataFrame(
        [("o1", "train", 1.0), ("o2", "train", 1.0), ("o2", "test", 1.0)],
        "client_id string, split string, x double",
    )
    assert prep.central(df).count() == 2


def test_outliers(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (float("inf"),), (2e139,), (None,)], "x double")
    assert [r["x"] for r in prep.drop_outliers(df, "x", 1e12).collect()] == [1.0]


def test_top_ties_and_empty(spark):
    rows = [("a", True), ("a", True), ("b", True), ("b", True), ("c", True), ("d", False)]
    df = spark.createDataFrame(rows, "src string, is_malicious boolean")
    assert [r["key"] for r in monitor.top_addresses(df, "src", 5).collect()] == ["b", "a", "c"]
    assert monitor.malicious_pct(df.limit(0)).first()[0] is None


def test_fill_dimension(spark):
    dim = spark.createDataFrame([("w1",), ("w2",)], "key string")
    counts = spark.createDataFrame([("w2", 5), ("w9", 1)], "key string, value long")
    got = {r["key"]: r["value"] for r in joins.fill_dimension(dim, counts, "key").collect()}
    assert got == {"w1": 0, "w2": 5}


def split_frame(spark, n=1003):
    cls = F.when(F.col("id") % 10 < 7, "big").when(F.col("id") % 10 < 9, "mid").otherwise("rare")
    return spark.range(n).select("id", cls.alias("cls"))


@pytest.mark.parametrize("share", [0.1, 0.2, 0.33, 0.5])
def test_split_sizes(spark, share):
    import math

    df = split_frame(spark)
    out = sampling.stratified_split(df, "cls", "id", share)
    pdf = out.toPandas()
    assert len(pdf) == 1003 and pdf["id"].is_unique
    assert (pdf["split"] == "test").sum() == math.ceil(share * 1003)
    for _, one in pdf.groupby("cls"):
        assert abs((one["split"] == "test").sum() - share * len(one)) <= 1
    again = sampling.stratified_split(df.repartition(7), "cls", "id", share).toPandas()
    assert set(again[again["split"] == "test"]["id"]) == set(pdf[pdf["split"] == "test"]["id"])


def test_split_share_is_checked(spark):
    for share in (0.05, 0.6):
        with pytest.raises(ValueError):
            sampling.stratified_split(split_frame(spark), "cls", "id", share)


def test_three_way(spark):
    pdf = sampling.three_way_split(split_frame(spark, 1000), "cls", "id").toPandas()
    assert pdf["split"].value_counts().to_dict() == {"train": 600, "eval": 200, "test": 200}


def test_stratified_sample(spark):
    pdf = sampling.stratified_sample(split_frame(spark), "cls", "id", 100, 1).toPandas()
    assert pdf["cls"].value_counts().to_dict() == {"big": 70, "mid": 20, "rare": 10}
    every = sampling.stratified_sample(split_frame(spark), "cls", "id", 10**6, 1)
    assert every.count() == 1003


def test_null_class_is_kept(spark):
    df = spark.range(50).select("id", F.when(F.col("id") < 25, F.lit("a")).alias("cls"))
    pdf = sampling.stratified_split(df, "cls", "id", 0.2).toPandas()
    assert len(pdf) == 50 and (pdf["split"] == "test").sum() == 10


def test_hash_sample_and_head(spark):
    df = spark.range(10_000)
    assert 900 < sampling.hash_sample(df, "id", 0.1, 5).count() < 1100
    assert sampling.hash_sample(df, "id", 1.0, 5).count() == 10_000
    head = [r["id"] for r in sampling.shuffled_head(df, "id", 100, 5).collect()]
    want = df.orderBy(F.md5(F.concat(F.lit("5:"), F.col("id").cast("string")))).limit(100)
    assert head == [r["id"] for r in want.collect()]
    assert sampling.shuffled_head(df, "id", 10**6, 5).count() == 10_000


def test_scaler_forms(spark):
    df = spark.createDataFrame([(1.0, 5.0), (58.0, 5.0)], "x double, c double")
    fit = scaling.fit_minmax(df, ["x", "c"])
    one = spark.createDataFrame([(6.0, 5.0)], "x double, c double")
    right = scaling.apply_minmax(one, fit, ["x", "c"]).first()
    assert right["x"] == pytest.approx(5 / 57) and right["c"] == 0.0
    legacy = scaling.apply_minmax(one, fit, ["x", "c"], form="legacy_min").first()
    assert legacy["x"] == pytest.approx((6 + 1 / 57) / 57)
    with pytest.raises(ValueError):
        scaling.apply_minmax(one, fit, ["x"], form="other")


def test_standard_and_robust(spark):
    df = spark.createDataFrame([(v, 3.0) for v in (1.0, 2.0, 4.0, 8.0)], "x double, c double")
    std = scaling.apply_standard(df, scaling.fit_standard(df, ["x", "c"]), ["x", "c"]).toPandas()
    assert std["x"].mean() == pytest.approx(0) and std["x"].std(ddof=0) == pytest.approx(1)
    assert (std["c"] == 0).all()
    rob = scaling.apply_robust(df, scaling.fit_robust(df, ["x", "c"]), ["x", "c"]).toPandas()
    assert list(rob["x"]) == pytest.approx([(v - 3) / 3.25 for v in (1, 2, 4, 8)])


def test_missing_values_do_not_spoil_a_fit(spark):
    rows = [(v,) for v in (0.0, 2.0, 4.0, float("nan"))] + [(None,)]
    df = spark.createDataFrame(rows, "x double")
    fit = scaling.fit_minmax(df, ["x"]).first()
    assert (fit["data_min"], fit["data_max"]) == (0.0, 4.0)
    assert scaling.fit_standard(df, ["x"]).first()["center"] == 2.0
    assert scaling.fit_robust(df, ["x"]).first()["center"] == 2.0


def test_scaler_documents(spark, tmp_path):
    df = spark.createDataFrame([(1.0, 5.0), (58.0, 5.0)], "x double, c double")
    write_scaler(scaling.fit_minmax(df, ["x", "c"]), ["x", "c"], str(tmp_path / "s"))
    back = {r["feature"]: r for r in read_scaler(spark, str(tmp_path / "s"), ["x", "c"]).collect()}
    assert back["x"]["scale"] == 1 / 57 and back["x"]["offset"] == -1 / 57
    assert back["c"]["scale"] == 1.0 and back["c"]["offset"] == -5.0


def test_files_by_prefix(spark, tmp_path):
    for name, n in (("worker_a.json", 1), ("deep/worker_b.json", 2), ("run.json", 9)):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(f'{{"processed_packets": {n}, "total_timer": 1.5}}')
    rows = read_json_glob(spark, str(tmp_path), "worker", WORKER_FILE).collect()
    assert sorted(r["processed_packets"] for r in rows) == [1, 2]


def test_metric_log_round_trip(spark, tmp_path):
    rows = [("client-1: A", "f1", m, r, m + r / 10) for m in (0, 1) for r in (1, 2, 3)]
    log = spark.createDataFrame(rows, "client string, metric string, model int, round int, value double")
    write_metric_log(log, str(tmp_path / "log"))
    back = read_metric_log(spark, str(tmp_path / "log")).drop("file")
    assert sorted(tuple(r) for r in back.collect()) == sorted(rows)


def test_scaler_of_other_client_rows(spark):
    df = spark.createDataFrame([("a", 0.0), ("a", 10.0), ("b", 5.0), (None, 1.0)], "g string, x double")
    fit = scaling.fit_minmax(df, ["x"], ["g"])
    got = scaling.apply_minmax(df, fit, ["x"], ["g"]).collect()
    assert sorted((r["g"] or "", r["x"]) for r in got) == [("", 0.0), ("a", 0.0), ("a", 1.0), ("b", 0.0)]


def test_width_and_validation(spark):
    df = spark.createDataFrame([([1.0, 2.0],), ([1.0],), (None,)], "v array<double>")
    assert check_width(df, "v", 2).count() == 1
    whole = (
        '{"metadata":{"ipv4_src_addr":"a","l4_src_port":1,"ipv4_dst_addr":"b","l4_dst_port":2},'
        '"classification_time":0.1,"latency":0.2,"worker_name":"w","is_malicious":true,"timestamp":5}'
    )
    texts = [whole, whole[:40], whole.replace('"latency":0.2,', ""), whole.replace("true", '"x"'), "", None]
    msgs = spark.createDataFrame([(t,) for t in texts], "value string")
    valid, rejected = validate(msgs, "value", ALERT)
    assert valid.count() == 1 and rejected.count() == 5
    assert valid.first()["message"]["metadata"]["IPV4_SRC_ADDR"] == "a"


def test_snapshot_validation(spark):
    import json

    alert = {
        "metadata": {"IPV4_SRC_ADDR": "a", "L4_SRC_PORT": 1, "IPV4_DST_ADDR": "b", "L4_DST_PORT": 2},
        "classification_time": 0.1, "latency": 0.2, "worker_name": "w", "is_malicious": True,
        "timestamp": 5,
    }

    def message(ips):
        stats = {
            "total_packets": 1, "total_malicious": 1, "malicious_ips": ips, "targeted_ips": [],
            "avg_latency": 0.1, "avg_classification_time": 0.1,
        }
        return json.dumps({"id": "x", "stats": stats, "packet_info": alert})

    texts = [message([{"key": "a", "value": 1}]), message([]), message([{"key": "a"}]), message(None)]
    msgs = spark.createDataFrame([(t,) for t in texts], "value string")
    valid, rejected = validate(msgs, "value", SNAPSHOT)
    assert valid.count() == 2 and rejected.count() == 2


def test_packets(spark, tmp_path):
    rows = [("1.1.1.1", "2.2.2.2", "x", "80", "3.5", "bad")]
    raw = spark.createDataFrame(
        rows, "IPV4_SRC_ADDR string, IPV4_DST_ADDR string, L4_SRC_PORT string, L4_DST_PORT string, a string, b string"
    )
    write_csv(raw, str(tmp_path / "p"))
    row = read_packets(spark, str(tmp_path / "p")).first()
    assert row["packet"] == [3.5, 0.0]
    assert tuple(row["metadata"]) == ("1.1.1.1", 0, "2.2.2.2", 80)


def test_clients(spark, tmp_path):
    write_flows(spark.range(3), str(tmp_path / "a"))
    write_flows(spark.range(2), str(tmp_path / "b"))
    rows = read_clients(spark, [("c1", "TRAIN", str(tmp_path / "a")), ("c2", "TEST", str(tmp_path / "b"))])
    assert rows.groupBy("client_id", "split").count().count() == 2


def test_metric_logs(spark, tmp_path):
    (tmp_path / "metrics_fedavg.json").write_text(
        '{\n "c1": {"f1": [[0.1, 0.2], [0.3, 0.4]]},\n "weighted_metrics": [{"model_1":'
        ' {"metrics_distributed": {}, "losses_distributed": [[1, 0.9], [2, 0.4]]}}]\n}'
    )
    rows = read_metric_log(spark, str(tmp_path / "metrics_fedavg.json")).collect()
    got = {(r["client"], r["model"], r["round"]): r["value"] for r in rows}
    assert got == {("c1", 0, 1): 0.1, ("c1", 0, 2): 0.2, ("c1", 1, 1): 0.3, ("c1", 1, 2): 0.4}
    losses = read_round_losses(spark, str(tmp_path / "metrics_fedavg.json")).collect()
    assert [(r["model"], r["round"], r["loss"]) for r in losses] == [(0, 1, 0.9), (0, 2, 0.4)]
    (tmp_path / "central.json").write_text('{"c1": {"f1": [0.5, 0.6]}}')
    rows = read_metric_log(spark, str(tmp_path / "central.json"), "central").collect()
    assert [(r["model"], r["round"], r["value"]) for r in rows] == [(0, 1, 0.5), (1, 1, 0.6)]
    (tmp_path / "train.json").write_text('{"c1": {"epoch_0": {"loss": 0.7}, "epoch_12": {"loss": 0.2}}}')
    rows = read_train_log(spark, str(tmp_path / "train.json")).collect()
    assert sorted((r["epoch"], r["loss"]) for r in rows) == [(0, 0.7), (12, 0.2)]


def test_metrics(spark):
    none = spark.createDataFrame([(0, 0), (0, 0)], "p int, y int")
    row = metrics.binary_metrics(none, "p", "y").first()
    assert (row["accuracy"], row["precision"], row["recall"], row["f1_score"]) == (1.0, 0.0, 0.0, 0.0)
    w = spark.createDataFrame([(1, 0.0), (3, 1.0)], "w int, v double")
    assert metrics.weighted_metric(w, "v", "w").first()["v"] == 0.75


def test_best_model_takes_first_on_ties(spark):
    rows = [(0, 1, 0.1), (0, 2, 0.5), (1, 1, 0.9), (1, 2, 0.3), (2, 2, 0.3)]
    losses = spark.createDataFrame(rows, "model int, round int, loss double")
    assert metrics.best_model(losses).first()["model"] == 1


# 30 published accuracies of the central model and their published summary.
ACCURACIES = [
    0.9980700016021729, 0.9981799721717834, 0.9980400204658508, 0.9980400204658508,
    0.9983699917793274, 0.9982500076293945, 0.9982500076293945, 0.9983100295066833,
    0.9983900189399719, 0.9981399774551392, 0.9983599781990051, 0.9982600212097168,
    0.9983800053596497, 0.9983400106430054, 0.9982500076293945, 0.9983599781990051,
    0.9982799887657166, 0.9982100129127502, 0.9982900023460388, 0.9983100295066833,
    0.9982900023460388, 0.9981600046157837, 0.9983299970626831, 0.9980000257492065,
    0.998199999332428, 0.9982200264930725, 0.9983100295066833, 0.9983699917793274,
    0.9983100295066833, 0.9983100295066833,
]
REPORT = {
    "mean": 99.82526739438374, "median": 0.9982849955558777, "variance": 1.1695612799051546e-08,
    "std": 0.01081462565188992, "max": 0.9983900189399719, "min": 0.9980000257492065,
}
SHAPIRO = {"w": 0.9057387262978227, "p": 0.011636766789959065}
# End of fixed values.


def accuracies(spark):
    rows = [("c", "accuracy", i, v) for i, v in enumerate(ACCURACIES)]
    return spark.createDataFrame(rows, "client string, metric string, model int, value double")


def test_published_report(spark):
    row = metrics.metric_report(accuracies(spark)).first()
    assert row["mean"] == pytest.approx(REPORT["mean"], abs=1e-10)
    assert row["median"] == pytest.approx(REPORT["median"], abs=1e-12)
    assert row["variance"] == pytest.approx(REPORT["variance"], rel=1e-6)
    assert row["std"] == pytest.approx(REPORT["std"], rel=1e-6)
    assert (row["max"], row["min"]) == (REPORT["max"], REPORT["min"])


def test_published_shapiro(spark):
    from flowspark.operators.hypothesis import shapiro

    for buckets in (1, 6):
        row = shapiro(accuracies(spark), "value", "model", ["client"], buckets).first()
        assert row["n"] == 30
        assert row["w"] == pytest.approx(SHAPIRO["w"], abs=1e-6)
        assert row["p"] == pytest.approx(SHAPIRO["p"], abs=1e-5)


def test_shapiro_edges(spark):
    from flowspark.operators.hypothesis import shapiro

    rows = [("two", 1, 1.0), ("two", 2, 2.0), *[("same", i, 5.0) for i in range(6)],
            *[("three", i, v) for i, v in enumerate((1.0, 2.0, 4.0))]]
    df = spark.createDataFrame(rows, "g string, k long, x double")
    got = {r["g"]: r for r in shapiro(df, "x", "k", ["g"]).collect()}
    assert got["two"]["w"] is None and got["same"]["w"] is None
    assert got["three"]["w"] == pytest.approx(0.9642857, abs=1e-6)
    assert got["three"]["p"] == pytest.approx(0.6368868, abs=1e-5)


def test_mann_whitney(spark):
    from flowspark.operators.hypothesis import mann_whitney_p

    rows = [("apart", i <= 3, float(i)) for i in range(1, 7)] + [("tied", i < 3, 1.0) for i in range(6)]
    df = spark.createDataFrame(rows, "g string, first boolean, x double")
    for buckets in (1, 5):
        got = {r["g"]: r for r in mann_whitney_p(df, "x", "first", ["g"], buckets=buckets).collect()}
        assert got["apart"]["u"] == 0.0 and got["tied"]["u"] == 4.5
        # by hand: (9 - 4.5 - 0.5) / sqrt(3 * 3 * 7 / 12) = 1.745743
        assert got["apart"]["z"] == pytest.approx(1.7457431, abs=1e-6)
        assert got["apart"]["p"] == pytest.approx(0.0808556, abs=1e-6)
        assert got["tied"]["z"] is None


@pytest.mark.parametrize("leaf", [1, 40, 4096])
def test_cuts_of_any_depth(spark, leaf):
    """The hash at a place is that of sorting, for one class of nearly all rows and many of one row."""
    cls = F.when(F.col("id") < 3000, F.lit(-1)).otherwise(F.col("id") % 500)
    rows = spark.range(3500).select(cls.alias("cls"), F.md5(F.col("id").cast("string")).alias("h"))
    rows = rows.unionByName(spark.sql("SELECT 7000L AS cls, md5('same') AS h FROM range(60)"))
    quotas = sampling.class_sizes(rows, "cls").select(
        "cls", F.ceil(F.col("n") / 3).alias("a"), F.col("n").alias("b"), F.lit(0).cast("long").alias("c")
    )
    got = {r["cls"]: (r["a"], r["b"], r["c"]) for r in sampling.cuts(rows, "cls", "h", quotas, ["a", "b", "c"], leaf).collect()}
    want = {}
    for c, one in rows.toPandas().groupby("cls"):
        h = sorted(one["h"])
        want[c] = (h[-(-len(h) // 3) - 1], h[-1], None)
    assert got == want


def test_ranked_is_a_total_order(spark):
    rows = spark.range(1000).select((F.col("id") % 3).alias("x"), F.col("id").alias("k"))
    got = sampling.ranked(rows.repartition(5), [F.desc("x"), F.asc("k")], "place").orderBy("place").collect()
    assert [r["place"] for r in got] == list(range(1, 1001))
    assert [(r["x"], r["k"]) for r in got] == sorted(((k % 3, k) for k in range(1000)), key=lambda t: (-t[0], t[1]))
    assert sampling.ranked(rows.limit(0), [F.asc("k")], "place").count() == 0


def test_head_with_repeated_keys_and_no_rows(spark):
    rows = spark.sql("SELECT 'k' AS key, id FROM range(300)")
    assert sampling.shuffled_head(rows, "key", 7, 1).count() == 7
    assert sampling.shuffled_head(rows.limit(0), "key", 7, 1).count() == 0


def test_run_settings(spark):
    rows = [("5_0.8", "c", "final_loss", 0, 1, 0.5), ("5_0.8", "c", "final_loss", 1, 1, 0.1),
            ("5_x", "c", "final_loss", 0, 2, 0.4)]
    log = spark.createDataFrame(rows, "run string, client string, metric string, model int, round int, value double")
    got = sorted(map(tuple, metrics.loss_curve(log, "fedprox").collect()), key=str)
    assert got == [(5.0, 0.8, "c", 1, 0.5), (5.0, None, "c", 1, 0.4)]


@pytest.mark.parametrize("setting", ["federated", "central", "local"])
def test_metric_logs_of_every_shape_round_trip(spark, tmp_path, setting):
    kind = "string" if setting == "local" else "int"
    models = ["m: a", 'm "b"'] if setting == "local" else [0, 1]
    rounds = (1,) if setting == "central" else (1, 2, 11)
    rows = [(c, f, m, i, (len(c) + i) / 8) for c in ("x y", "z") for f in ("f1", "acc") for m in models
            for i in range(1, len(rounds) + 1)]
    log = spark.createDataFrame(rows, f"client string, metric string, model {kind}, round int, value double")
    path = str(tmp_path / "log")
    write_metric_log(log, path, setting=setting)
    back = read_metric_log(spark, path, setting).drop("file")
    assert sorted(map(tuple, back.collect())) == sorted(rows)
    with pytest.raises(ValueError):
        write_metric_log(log, str(tmp_path / "none"), setting="other")


def test_train_logs_and_histories_round_trip(spark, tmp_path):
    rows = [("c", e, e / 4) for e in (0, 1, 10)] + [("d", 0, 1e-17)]
    write_train_log(spark.createDataFrame(rows, "client string, epoch int, loss double"), str(tmp_path / "t"))
    assert sorted(map(tuple, read_train_log(spark, str(tmp_path / "t")).drop("file").collect())) == sorted(rows)
    rows = [(m, r, m + r / 10) for m in range(12) for r in (1, 2, 10)]
    write_round_losses(spark.createDataFrame(rows, "model int, round int, loss double"), str(tmp_path / "r"))
    assert sorted(map(tuple, read_round_losses(spark, str(tmp_path / "r")).drop("file").collect())) == rows


@pytest.mark.parametrize("text,message", [
    ('{"c": {"f1": [[0.1, "high"]]}}', "no number at log.json: c / f1 / 0 / 1"),
    ('{"c": {"f1": [[true]]}}', "no number at log.json: c / f1 / 0 / 0"),
    ('{"c": {"f1": {"a": [1]}}}', "unknown log shape at log.json: c / f1 / a / 0"),
    ('{"c": {"f1": [[0.1', "no JSON in log.json"),
    ("7", "unknown log shape at log.json"),
    ('{"c": [[[[[[[[1]]]]]]]]}', "at log.json: c / 0 / 0"),
])
def test_unknown_logs_name_the_place(spark, tmp_path, text, message):
    (tmp_path / "log.json").write_text(text)
    with pytest.raises(Exception, match=message):
        read_metric_log(spark, str(tmp_path / "log.json")).collect()


def test_logs_without_values(spark, tmp_path):
    (tmp_path / "log.json").write_text('{"c": {"f1": [[null, 2], []], "f2": []}, "d": {}}')
    rows = read_metric_log(spark, str(tmp_path / "log.json")).drop("file").collect()
    assert sorted(map(tuple, rows), key=lambda r: r[3]) == [("c", "f1", 0, 1, None), ("c", "f1", 0, 2, 2.0)]
