"""Training, scoring, aggregation rules and whole runs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowspark.operators import mlp, params as fed, score, train
from flowspark.plans import rounds
from flowspark.plans.model_queries import demo_network

CFG = train.TrainConfig(hidden=(5,), epochs=2, lr=1e-2, weight_decay=0.0, batch_size=32, seed=1, shards=1)


def rows(spark, n=400, clients=("a", "b"), seed=0):
    rng = np.random.default_rng(seed)
    data = []
    for i in range(n):
        x = rng.normal(size=3)
        data.append((i, clients[i % len(clients)], *map(float, x), int(x[0] - x[1] > 0)))
    return spark.createDataFrame(data, "key long, client string, x0 double, x1 double, x2 double, label int")


FEATURES = ["x0", "x1", "x2"]


def test_logits_work_in_place_and_agree_with_training():
    """A block needs two arrays as large as its widest layer, whatever the number of operations on it."""
    import tracemalloc

    params = [t + 0.1 for t in mlp.init(39, (512, 64), 1)]
    x = np.random.default_rng(2).normal(size=(1024, 39)) * 50 + 300
    tracemalloc.start()
    got = mlp.logits(params, x)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    np.testing.assert_allclose(got, mlp.gradients(params, x, np.zeros(1024))[2], atol=1e-9)
    assert peak < 2.5 * 8 * 1024 * 512
    assert mlp.logits(params, x[:0]).shape == (0,)


def test_gradients_by_finite_difference():
    rng = np.random.default_rng(4)
    params = [t + rng.normal(scale=0.1, size=t.shape) for t in mlp.init(4, (6, 5), 2)]
    x, y = rng.normal(size=(20, 4)), (rng.random(20) > 0.5).astype(float)
    _, grads, _ = mlp.gradients(params, x, y)
    for t, g in zip(params, grads):
        flat = t.reshape(-1)
        for j in rng.choice(flat.size, min(6, flat.size), replace=False):
            keep, h = flat[j], 1e-6
            flat[j] = keep + h
            up = mlp.mean_loss(mlp.logits(params, x), y)
            flat[j] = keep - h
            down = mlp.mean_loss(mlp.logits(params, x), y)
            flat[j] = keep
            assert g.reshape(-1)[j] == pytest.approx((up - down) / (2 * h), abs=1e-6)


@pytest.mark.parametrize("kind", ["adamw", "adam", "sgd"])
def test_optimizers_lower_the_loss(kind):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 3))
    y = (x[:, 0] > 0).astype(float)
    cfg = CFG.with_(optimizer=kind, epochs=8, lr=5e-2)
    _, losses = train.fit_arrays(mlp.init(3, (5,), 1), x, y, cfg, 1)
    assert losses[-1] < losses[0] * 0.8
    with pytest.raises(ValueError):
        mlp.Optimizer("other", 0.1, 0.9, 0.0)


def test_sgd_momentum_by_hand():
    opt = mlp.Optimizer("sgd", 0.1, 0.9, 0.5)
    p = opt.step([np.array([1.0])], [np.array([1.0])])
    assert p[0][0] == pytest.approx(1 - 0.1 * 1.5)
    p = opt.step(p, [np.array([0.0])])
    assert p[0][0] == pytest.approx(0.85 - 0.1 * (0.9 * 1.5 + 0.5 * 0.85))


def test_adamw_first_step_by_hand():
    opt = mlp.Optimizer("adamw", 0.1, 0.9, 0.5)
    p = opt.step([np.array([2.0])], [np.array([3.0])])
    assert p[0][0] == pytest.approx(2 * (1 - 0.05) - 0.1, abs=1e-7)


def test_proximal_term_changes_the_result():
    rng = np.random.default_rng(6)
    x, y = rng.normal(size=(200, 3)), (rng.random(200) > 0.5).astype(float)
    start = mlp.init(3, (5,), 1)
    free, _ = train.fit_arrays(start, x, y, CFG, 1)
    held, _ = train.fit_arrays(start, x, y, CFG.with_(mu=50.0), 1)

    def far(p):
        return sum(((a - b) ** 2).sum() for a, b in zip(p, start))

    assert 0 < far(held) < far(free)


def test_personal_mix():
    x, y = np.zeros((10, 3)), np.zeros(10)
    start, own = mlp.init(3, (), 1), [np.ones((3, 1)), np.ones(1)]
    cfg = CFG.with_(hidden=(), delta=0.1, epochs=1, lr=1e-9, optimizer="sgd", batch_size=100)
    got, _ = train.fit_arrays(start, x, y, cfg, 1, own)
    want = 0.9 * own[0] + 0.1 * (start[0] + (own[0] - start[0]) / 1.1)
    np.testing.assert_allclose(got[0], want, atol=1e-6)
    got, _ = train.fit_arrays(start, x, y, cfg.with_(lam=1.0), 1, own)
    want = 0.9 * start[0] + 0.1 * (start[0] + (own[0] - start[0]) / 1.1)
    np.testing.assert_allclose(got[0], want, atol=1e-6)


def test_one_shard_is_plain_training(spark):
    df = rows(spark)
    start = mlp.init(3, CFG.hidden, 1)
    shards = train.to_shards(df, FEATURES, "label", "client", "key", 1)
    merged = train.merge_shards(train.client_update(shards, FEATURES, start, CFG))
    models = score.load_models(merged, mlp.shapes(3, CFG.hidden), "client")
    pdf = df.filter("client = 'a'").toPandas().sort_values("key")
    want, _ = train.fit_arrays(
        start, pdf[FEATURES].to_numpy(), pdf["label"].to_numpy(float), CFG,
        train.shard_seed(CFG.seed, 1, "a", 0),
    )
    for got, t in zip(models["a"], want):
        np.testing.assert_allclose(got, t, atol=1e-12)


@pytest.mark.parametrize("batch", [None, 32])
def test_no_task_holds_a_shard(spark, monkeypatch, batch):
    """Rows of shards stream through the tasks; results are those of shards held in memory."""
    df = rows(spark, clients=("a", "a", "a", None))
    cfg = CFG.with_(shards=3, batch_size=batch, optimizer="sgd", momentum=0.0, epochs=1)
    start = mlp.init(3, CFG.hidden, 1)
    placed = train.to_shards(df, FEATURES, "label", "client", "key", 3)
    pdf = placed.toPandas().sort_values("key")
    monkeypatch.setattr(train, "_arrays", None)  # what makes arrays of a whole group
    got = train.merge_shards(train.client_update(placed, FEATURES, start, cfg))
    got = {r["client"]: r["value"] for r in got.filter("layer = 0 AND pos = 0").collect()}
    for client in ("a", None):
        mine = pdf[pdf["client"].isna() if client is None else pdf["client"] == client]
        want = 0.0
        for shard, part in mine.groupby("shard"):
            if batch:
                found, _ = train.fit_arrays(
                    start, part[FEATURES].to_numpy(), part["label"].to_numpy(), cfg,
                    train.shard_seed(cfg.seed, 1, client, shard, 0))
            else:
                _, grads, _ = mlp.gradients(start, part[FEATURES].to_numpy(), part["label"].to_numpy())
                found = [t - cfg.lr * g for t, g in zip(start, grads)]
            want += found[0].ravel()[0] * len(part) / len(mine)
        assert got[client] == pytest.approx(want, abs=1e-12)


def test_order_of_an_epoch_takes_eight_bytes_a_row():
    """The order is that of a permutation, drawn without its eight-byte numbers."""
    import tracemalloc

    n = 3_000_000
    tracemalloc.start()
    place = train._places(n, 7)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 11 * n and place.nbytes == 4 * n
    for size in (0, 1, 5, n):
        order = np.random.default_rng(7).permutation(size)
        assert (train._places(size, 7)[order] == np.arange(size)).all()


def values_of(source, start, cfg):
    out = train.merge_shards(train.client_update(source, FEATURES, start, cfg))
    return out.orderBy("client", "layer", "pos").toPandas()


def test_rows_of_a_client_are_dealt_to_shards_and_repeatable(spark):
    df = rows(spark, clients=("a", "a", "a", "b"))
    cfg = CFG.with_(shards=3)
    shards = train.to_shards(df, FEATURES, "label", "client", "key", 3)
    sizes = {(r["client"], r["shard"]): r["count"] for r in shards.groupBy("client", "shard").count().collect()}
    assert sum(sizes.values()) == 400 and {s for _, s in sizes} == {0, 1, 2}
    start = mlp.init(3, CFG.hidden, 1)
    a = values_of(shards, start, cfg)
    b = values_of(train.to_shards(df.repartition(9), FEATURES, "label", "client", "key", 3), start, cfg)
    np.testing.assert_allclose(a["value"], b["value"], atol=1e-12)
    assert a.groupby("client")["weight"].first().to_dict() == {"a": 300, "b": 100}
    batches = train.merge_shards(
        train.client_update(shards, FEATURES, start, cfg), weight_unit="batches", batch_size=32
    )
    assert {r["weight"] for r in batches.select("weight").distinct().collect()} == {10, 4}
    with pytest.raises(ValueError):
        train.to_shards(df, FEATURES, "label", "client", "key", 0)


@pytest.mark.parametrize(
    "change", [{}, {"optimizer": "sgd", "momentum": 0.9, "mu": 0.5}, {"delta": 0.1, "lam": 0.3}]
)
def test_full_batches_do_not_depend_on_shards(spark, change):
    df = rows(spark, clients=("a", "a", "b", None))
    cfg = CFG.with_(batch_size=None, epochs=3, weight_decay=0.1, **change)
    start, own = mlp.init(3, CFG.hidden, 1), None
    if "delta" in change:
        own = score.model_rows(spark, mlp.init(3, CFG.hidden, 2)).selectExpr("'a' AS client", "*")

    def values(shards):
        placed = train.to_shards(df, FEATURES, "label", "client", "key", shards)
        trained = train.client_update(placed, FEATURES, start, cfg.with_(shards=shards), 1, own)
        log = train.train_log(trained).orderBy("client", "epoch").toPandas()
        merged = train.merge_shards(trained).orderBy("client", "layer", "pos").toPandas()
        return merged["client"].tolist(), merged["value"], log["loss"]

    one, many = values(1), values(4)
    assert one[0] == many[0] and len(set(one[0])) == 3
    np.testing.assert_allclose(one[1], many[1], atol=1e-9)
    np.testing.assert_allclose(one[2], many[2], atol=1e-9)


def test_train_log(spark):
    shards = train.to_shards(rows(spark), FEATURES, "label", "client", "key", 1)
    log = train.train_log(train.client_update(shards, FEATURES, mlp.init(3, CFG.hidden, 1), CFG)).toPandas()
    assert sorted(log["epoch"].unique()) == [0, 1]
    for _, one in log.groupby("client"):
        one = one.sort_values("epoch")
        assert one["loss"].iloc[1] < one["loss"].iloc[0]


def test_score_columns_array_and_bad_rows(spark):
    model = demo_network()
    data = [(1, 0.1, 0.2, 0.3, 0.4), (2, 1.0, None, 0.0, 0.0)]
    df = spark.createDataFrame(data, "id int, a double, b double, c double, d double")
    cols = ["a", "b", "c", "d"]
    by_columns = {r["id"]: r["logit"] for r in score.score(df, model, cols).collect()}
    want = mlp.logits(model, np.array([[0.1, 0.2, 0.3, 0.4]]))[0]
    assert by_columns[1] == pytest.approx(want) and by_columns[2] is None
    vectors = df.select("id", F.array(*cols).alias("v")).union(
        spark.createDataFrame([(3, [1.0]), (4, None)], "id int, v array<double>")
    )
    by_array = {r["id"]: r["logit"] for r in score.score(vectors, model, "v").collect()}
    assert by_array[1] == pytest.approx(want)
    assert by_array[2] is None and by_array[3] is None and by_array[4] is None


def test_model_rows_round_trip(spark):
    model = demo_network()
    shapes = mlp.shapes(4, (6, 4))
    back = score.load_models(score.model_rows(spark, model), shapes)[""]
    for a, b in zip(model, back):
        np.testing.assert_array_equal(a, b)
    with pytest.raises(ValueError):
        score.load_models(score.model_rows(spark, model).limit(10), shapes)


def test_evaluation_in_groups_of_models(spark, monkeypatch):
    df = rows(spark)
    models = {f"m{i}": mlp.init(3, (5,), i) for i in range(5)}
    one = score.evaluate_models(df, models, FEATURES, "label", "client").toPandas()
    monkeypatch.setattr(score, "MAX_PARAMETERS", 60)
    two = score.evaluate_models(df, models, FEATURES, "label", "client").toPandas()
    keys = ["model", "client"]
    a, b = one.sort_values(keys).reset_index(drop=True), two.sort_values(keys).reset_index(drop=True)
    assert len(a) == 10
    np.testing.assert_allclose(a.drop(columns=keys).to_numpy(float), b.drop(columns=keys).to_numpy(float))


# --- aggregation rules --------------------------------------------------------------------------


def client_params(spark, values, weights=None):
    data = [(1, str(i), 0, 0, float(v), int((weights or [1] * len(values))[i])) for i, v in enumerate(values)]
    return spark.createDataFrame(data, "round int, client string, layer int, pos int, value double, weight long")


def only(df):
    return df.first()["value"]


def test_rules(spark):
    assert only(fed.fed_avg(client_params(spark, [2.0, 2.0, 2.0]))) == 2.0
    assert only(fed.fed_avg(client_params(spark, [0.0, 1.0], [1, 3]))) == 0.75
    assert only(fed.fed_median(client_params(spark, [1.0, 9.0, 2.0, 4.0]))) == 3.0
    ten = [float(v) for v in (100, 1, 2, 3, 4, 5, 6, 7, 8, -50)]
    assert only(fed.fed_trimmed(client_params(spark, ten))) == pytest.approx(np.mean([2, 3, 4, 5, 6, 7]))
    assert only(fed.fed_trimmed(client_params(spark, [1.0, 2.0, 9.0]))) == 4.0
    assert only(fed.fed_trimmed(client_params(spark, ten), 0.0)) == pytest.approx(np.mean(ten))
    tied = client_params(spark, [1.0] * 4 + [5.0] * 6)
    assert only(fed.fed_trimmed(tied)) == pytest.approx((2 * 1 + 4 * 5) / 6)
    with pytest.raises(ValueError):
        fed.fed_trimmed(tied, 0.5)


def test_registry(spark):
    assert fed.strategy("fedadam", eta=0.5).settings["eta"] == 0.5
    assert fed.strategy("fedadagrad").client_settings() == {"lr": 0.1}
    for bad in (lambda: fed.strategy("qfedavg"), lambda: fed.strategy("fedavg", eta=1.0)):
        with pytest.raises(ValueError):
            bad()


@pytest.mark.parametrize("name", ["fedadagrad", "fedadam", "fedyogi"])
def test_adaptive_step_by_hand(spark, name):
    state = spark.createDataFrame([(1, 0, 0, 1.0, 0.2, 0.3)], "round int, layer int, pos int, value double, m double, v double")
    s = fed.strategy(name)
    got = s.aggregate(client_params(spark, [2.0, 4.0]), state).first()
    d, c = 2.0, s.settings
    m, v = {
        "fedadagrad": (d, 0.3 + d * d),
        "fedadam": (0.9 * 0.2 + 0.1 * d, 0.99 * 0.3 + 0.01 * d * d),
        "fedyogi": (0.9 * 0.2 + 0.1 * d, 0.3 + 0.01 * d * d),
    }[name]
    assert got["m"] == pytest.approx(m) and got["v"] == pytest.approx(v)
    assert got["value"] == pytest.approx(1 + c["eta"] * m / (v**0.5 + c["tau"]))


def test_distance(spark):
    a = spark.createDataFrame([(0, 0, 3.0), (0, 1, 4.0), (1, 0, 1.0)], "layer int, pos int, value double")
    zero = a.withColumn("value", F.lit(0.0))
    assert fed.param_distance(a, zero).first()["distance"] == 6.0
    assert fed.param_distance(a, a).first()["equal"] is True


# --- runs ---------------------------------------------------------------------------------------


def run(spark, name, **kw):
    df = rows(spark, 600)
    extra = {k: kw.pop(k) for k in ("fit_clients", "eval_clients", "config_fn", "on_round", "models") if k in kw}
    return rounds.federated_run(
        df.filter("key % 5 <> 0"), df.filter("key % 5 = 0"), FEATURES, "label", "client", "key", 2,
        fed.strategy(name, **kw), CFG.with_(lr=1e-2, epochs=3), **extra,
    ).toPandas()


def test_federated_run_learns(spark):
    seen = []
    log = run(spark, "fedavg", on_round=lambda r, m: seen.append((r, m.count())))
    assert len(log) == 2 * 2 * 5 and seen == [(1, 10), (2, 10)]
    loss = log[log["metric"] == "final_loss"].groupby("round")["value"].mean()
    assert loss[2] < loss[1]


@pytest.mark.parametrize("name", ["fedmedian", "fedtrimmed", "fedavgplus", "fedyogi"])
def test_other_strategies_run(spark, name):
    log = run(spark, name)
    assert log["value"].notna().all() and len(log) == 20


def test_chosen_clients_and_round_settings(spark):
    used = []

    def config(r):
        used.append(r)
        return {"epochs": r}

    log = run(spark, "fedavg", fit_clients=1, eval_clients=1, config_fn=config, models=2)
    assert used == [1, 2, 1, 2]
    assert log.groupby(["model", "round"])["client"].nunique().eq(1).all()


def test_saved_run(spark, tmp_path):
    df = rows(spark, 300)
    rounds.federated_run(
        df, df, FEATURES, "label", "client", "key", 2, fed.strategy("fedavg"), CFG, out=str(tmp_path / "run")
    )
    last = spark.read.parquet(str(tmp_path / "run/params")).filter("round = 2")
    model = score.load_models(last, mlp.shapes(3, CFG.hidden))[""]
    assert [t.shape for t in model] == mlp.shapes(3, CFG.hidden)
    history = spark.read.parquet(str(tmp_path / "run/history")).toPandas()
    assert len(history) == 2 and (history["n"] == 300).all()


def test_local_run_in_groups_of_models(spark, monkeypatch):
    df = rows(spark, 600, ("a", "b", "c", "d"))

    def result():
        log = rounds.local_run(df, df, FEATURES, "label", "client", "key", CFG).toPandas()
        return log.sort_values(["model", "client", "metric"]).reset_index(drop=True)

    whole = result()
    size = sum(int(np.prod(s)) for s in mlp.shapes(3, CFG.hidden))
    monkeypatch.setattr(score, "MAX_PARAMETERS", 4 * size)
    parts = result()
    assert len(whole) == 4 * 4 * 5
    np.testing.assert_allclose(whole["value"], parts["value"], atol=1e-9)


def test_local_and_central_runs(spark):
    df = rows(spark, 600)
    train_rows, test_rows = df.filter("key % 5 <> 0"), df.filter("key % 5 = 0")
    local = rounds.local_run(
        train_rows, test_rows, FEATURES, "label", "client", "key", CFG.with_(epochs=20), runs=2
    ).toPandas()
    assert len(local) == 2 * 2 * 2 * 5
    central = rounds.central_run(
        train_rows, test_rows, FEATURES, "label", "client", "key", CFG.with_(epochs=20)
    ).toPandas()
    accuracy = central[central["metric"] == "accuracy"]["value"]
    assert len(accuracy) == 2 and (accuracy > 0.8).all()


def test_grid_search_prefers_a_working_rate(spark):
    shards = train.to_shards(rows(spark, 500, ("all",)), FEATURES, "label", "client", "key", None)
    grid = [CFG.with_(lr=1e-6, batch_size=200), CFG.with_(lr=0.2, batch_size=100)]
    summary = train.grid_summary(train.grid_search(shards, FEATURES, grid)).toPandas()
    best = summary[summary["best"]]
    assert list(best["candidate"]) == [1] and best["mean_score"].iloc[0] > 0.8 and not set(summary["candidate"]) - {0, 1}


def test_scorer_in_sql(spark):
    """Each row names its model; what cannot be scored is NULL, and no row ends the query."""
    from flowspark.operators import mlp, score

    nets = {"a": mlp.init(3, (4,), 1), "line": mlp.init(2, (), 2)}
    score.register_scorer(spark, "test_score", nets)
    rows = [("a", [1.0, 2.0, 3.0]), ("line", [0.5, -1.0]), ("a", [1.0, 2.0]), ("a", [1.0, None, 3.0]),
            ("none", [1.0, 2.0, 3.0]), (None, [1.0, 2.0, 3.0]), ("line", None), ("line", [])]
    df = spark.createDataFrame(rows, "model string, v array<double>").coalesce(1)
    got = [r["z"] for r in spark.sql("SELECT test_score(model, v) AS z FROM {df}", df=df).collect()]
    assert got[0] == pytest.approx(float(mlp.logits(nets["a"], np.array([[1.0, 2.0, 3.0]]))[0]))
    assert got[1] == pytest.approx(float(mlp.logits(nets["line"], np.array([[0.5, -1.0]]))[0]))
    assert got[2:] == [None] * 6
    assert spark.sql("SELECT test_score(model, v) AS z FROM {df}", df=df.limit(0)).count() == 0
