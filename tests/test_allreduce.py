import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowspark.operators import allreduce, mlp, score, train

FEATURES = ["a", "b", "c"]
CFG = train.TrainConfig(hidden=(4,), epochs=2, lr=1e-2, weight_decay=0.05, batch_size=60, seed=3, tasks=1)
SCHEMA = "client string, key long, a double, b double, c double, label double"


def data(n=240, clients=("x", "x", "y", None)):
    r = np.random.default_rng(n)
    x = r.normal(size=(n, 3))
    y = (x.sum(1) + r.normal(0, .3, n) > 0).astype(float)
    return [(clients[i % len(clients)], i, *map(float, x[i]), float(y[i])) for i in range(n)]


def trained(spark, rows, cfg, local=None, parts=5):
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    start = mlp.init(3, cfg.hidden, 1)
    out = train.client_update(train.to_shards(df, FEATURES, "label", "client", "key", cfg.groups), FEATURES, start, cfg,
                              local=local)
    return {(r["client"], r["layer"]): (r["n"], np.array(r["values"]), r["losses"]) for r in out.collect()}


def by_hand(rows, cfg, own=None):
    """Plain mini-batches of one client in memory, batches by the stated rule."""
    n, start = len(rows), mlp.init(3, cfg.hidden, 1)
    steps = max(1, -(-n // (cfg.batch_size or n)))
    params, losses = train.begin(start, own, cfg), []
    opt = mlp.Optimizer(cfg.optimizer, cfg.lr, cfg.momentum, cfg.weight_decay)
    for epoch in range(cfg.epochs):
        at = [int(hashlib.md5(f"{cfg.seed}:1:{epoch}:{r[1]}".encode()).hexdigest()[:8], 16) * steps >> 32 for r in rows]
        total = 0.0
        for s in range(steps):
            mine = np.array([r[2:] for r, b in zip(rows, at) if b == s])
            if len(mine):
                loss, grads, _ = mlp.gradients(params, mine[:, :3], mine[:, 3])
                total += (loss + train.pull(params, start, cfg)) * len(mine)
                params = train.advance(opt, params, grads, start, own, cfg)
        losses.append(total / n)
    return params, losses


@pytest.mark.parametrize("tasks", [1, 3, 4])
@pytest.mark.parametrize("change", [{}, {"optimizer": "sgd", "mu": 0.5}, {"delta": 0.1, "lam": 0.3, "batch_size": None}])
def test_any_number_of_tasks_trains_as_one_does(spark, tasks, change):
    rows, cfg = data(), CFG.with_(tasks=tasks, **change)
    own = local = None
    if "delta" in change:
        own = mlp.init(3, cfg.hidden, 2)
        local = score.model_rows(spark, own)
        local = local.selectExpr("'x' AS client", "*").union(local.selectExpr("CAST(NULL AS STRING)", "*"))
    got = trained(spark, rows, cfg, local)
    for client in ("x", "y", None):
        mine = [r for r in rows if r[0] == client]
        params, losses = by_hand(mine, cfg, None if client == "y" else own)
        for layer, want in enumerate(params):
            n, values, seen = got[client, layer]
            assert n == len(mine)
            np.testing.assert_allclose(values, want.ravel(), atol=1e-9)
            np.testing.assert_allclose(seen, losses, atol=1e-9)


@pytest.mark.parametrize("change", [{}, {"delta": 0.1, "lam": 0.3}])
def test_steps_by_exchange(spark, monkeypatch, change):
    rows, cfg = data(), CFG.with_(tasks=3, **change)
    monkeypatch.setattr(allreduce, "EXCHANGE_WORK", 0)
    monkeypatch.setattr(allreduce, "_chained", None)
    got = trained(spark, rows, cfg)
    for client in ("x", "y", None):
        params, losses = by_hand([r for r in rows if r[0] == client], cfg)
        for layer, want in enumerate(params):
            np.testing.assert_allclose(got[client, layer][1], want.ravel(), atol=1e-9)
            np.testing.assert_allclose(got[client, layer][2], losses, atol=1e-9)


@pytest.mark.parametrize("tasks", [1, 3])
def test_small_steps_follow_each_other_without_an_exchange(spark, monkeypatch, tasks):
    """Stretches that end inside batches hand their sums over; no step waits for other tasks."""
    rows, cfg = data(400), CFG.with_(tasks=tasks, batch_size=30, optimizer="sgd")
    monkeypatch.setattr(allreduce, "_epoch", None)
    monkeypatch.setattr(allreduce, "STRETCH_ROWS", 60)
    got = trained(spark, rows, cfg)
    for client in ("x", "y", None):
        params, losses = by_hand([r for r in rows if r[0] == client], cfg)
        for layer, want in enumerate(params):
            np.testing.assert_allclose(got[client, layer][1], want.ravel(), atol=1e-9)
            np.testing.assert_allclose(got[client, layer][2], losses, atol=1e-9)


def test_which_steps_are_worth_an_exchange():
    def job(rows, batch, params):
        return allreduce.Job("j", 0, False, rows, batch, [np.zeros(params)], None, None, [], None, None)

    assert not allreduce._exchanges([job(3_000_000, 8192, 5)])
    assert allreduce._exchanges([job(200_000_000, None, 5)]) and allreduce._exchanges([job(10**7, 65536, 200_000)])


def test_more_tasks_than_rows_and_one_client_of_all_rows(spark):
    few = [("x", 1, .1, .2, .3, 1.0)]
    got = trained(spark, few, CFG.with_(tasks=4))
    np.testing.assert_allclose(got["x", 0][1], by_hand(few, CFG)[0][0].ravel(), atol=1e-12)
    assert trained(spark, [], CFG.with_(tasks=4)) == {}
    hot = data(400, ("x",)) + [("rare", 1000 + i, 1.0, 2.0, 3.0, float(i % 2)) for i in range(3)]
    got = trained(spark, hot, CFG.with_(tasks=4, batch_size=200))
    for client, n in (("x", 400), ("rare", 3)):
        want = by_hand([r for r in hot if r[0] == client], CFG.with_(batch_size=200))[0]
        assert got[client, 0][0] == n
        np.testing.assert_allclose(got[client, 4][1], want[4].ravel(), atol=1e-9)


def test_full_batches_equal_those_of_shards(spark):
    rows, cfg = data(), CFG.with_(batch_size=None)
    one, other = trained(spark, rows, cfg.with_(tasks=3)), trained(spark, rows, cfg.with_(tasks=None, shards=4))
    assert set(one) == set(other)
    for k, (n, values, losses) in one.items():
        assert n == other[k][0]
        np.testing.assert_allclose(values, other[k][1], atol=1e-9)
        np.testing.assert_allclose(losses, other[k][2], atol=1e-9)


def test_models_are_trained_in_groups_that_fit(spark, monkeypatch):
    rows = data()
    want = trained(spark, rows, CFG)
    size = sum(t.size for t in mlp.init(3, CFG.hidden, 1))
    monkeypatch.setattr(train, "MAX_PARAMETERS", 4 * size)  # one client at a time
    got = trained(spark, rows, CFG)
    assert set(got) == set(want) and all(np.allclose(got[k][1], want[k][1]) for k in want)


def test_long_messages_are_cut(spark, monkeypatch):
    class Echo:
        sent = []

        def allGather(self, text):  # noqa: N802
            self.sent.append(text)
            return [text, text]

    monkeypatch.setattr(allreduce, "MESSAGE_BYTES", 2 * 8 * 10)
    values = np.arange(25.0)
    np.testing.assert_array_equal(allreduce._gathered(Echo(), values, 2), 2 * values)
    assert len(Echo.sent) == 4


def test_grid_search_by_hand(spark):
    rows = data(300, ("all",))
    grid = [CFG.with_(batch_size=None, lr=lr, epochs=e) for lr, e in ((.05, 3), (.3, 3), (.05, 2))]
    df = train.to_shards(spark.createDataFrame(rows, SCHEMA), FEATURES, "label", "client", "key", None)
    got = {(r["candidate"], r["fold"]): (r["score"], r["n"])
           for r in train.grid_search(df, FEATURES, grid, 3, tasks=3).collect()}
    fold = [int(hashlib.md5(f"fold:{r[1]}".encode()).hexdigest()[:8], 16) % 3 for r in rows]
    for c, cfg in enumerate(grid):
        for f in range(3):
            inside, outside = ([r for r, g in zip(rows, fold) if (g == f) == side] for side in (True, False))
            x = np.array([r[2:] for r in outside])
            params, opt = mlp.init(3, cfg.hidden, cfg.seed), mlp.Optimizer("adamw", cfg.lr, .9, cfg.weight_decay)
            for _ in range(cfg.epochs):
                params = opt.step(params, mlp.gradients(params, x[:, :3], x[:, 3])[1])
            t = np.array([r[2:] for r in inside])
            right = (mlp.logits(params, t[:, :3]) > 0) == (t[:, 3] > .5)
            assert got[c, f] == (pytest.approx(right.mean()), len(inside))


def test_stratified_folds(spark):
    """No fold has more than one row more than another, in all or in a class, and all rows are dealt."""
    rows = [(None, i % 70, float(i), 0.0, 0.0, label) for i, label in enumerate([1.0] * 41 + [0.0] * 98 + [None] * 4)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for k in (1, 3, 5, 200):
        folds, sizes = train.stratified_folds(df, FEATURES, k)
        got = [(r["part"], r["label"], r["a"]) for r in folds.collect()]
        assert sorted(a for _, _, a in got) == [float(i) for i in range(143)]
        assert [sum(p == f for p, _, _ in got) for f in range(k)] == sizes and max(sizes) - min(sizes) <= 1
        for label in (1.0, 0.0, None):
            mine = [sum((p, y) == (f, label) for p, y, _ in got) for f in range(k)]
            assert max(mine) - min(mine) <= 1
    folds, sizes = train.stratified_folds(df.limit(0), FEATURES, 3)
    assert folds.count() == 0 and sizes == [0, 0, 0]


def test_stratified_search_and_its_refit_by_hand(spark):
    rows = data(300, ("all",))
    df = train.to_shards(spark.createDataFrame(rows, SCHEMA), FEATURES, "label", "client", "key", None)
    base = CFG.with_(batch_size=None, epochs=3)
    grid = train.settings(base, optimizer=("sgd", "adam"), momentum=(0.0, 0.9), lr=(1e-6, 0.2))
    assert [(c.optimizer, c.momentum, c.lr) for c in grid[:3]] == [("sgd", 0, 1e-6), ("sgd", 0, .2), ("sgd", .9, 1e-6)]
    scores = train.grid_search(df, FEATURES, grid, 3, tasks=3, stratified=True)
    got = {(r["candidate"], r["fold"]): (r["score"], r["n"]) for r in scores.collect()}
    fold = {r["key"]: r["part"] for r in train.stratified_folds(df, FEATURES, 3)[0].collect()}

    def fit(cfg, outside):
        x = np.array([r[2:] for r in outside])
        params = mlp.init(3, cfg.hidden, cfg.seed)
        opt = mlp.Optimizer(cfg.optimizer, cfg.lr, cfg.momentum, cfg.weight_decay)
        for _ in range(cfg.epochs):
            loss, grads, _ = mlp.gradients(params, x[:, :3], x[:, 3])
            params = opt.step(params, grads)
        return params, loss

    for c, cfg in enumerate(grid):
        for f in range(3):
            t = np.array([r[2:] for r in rows if fold[r[1]] == f])
            params, _ = fit(cfg, [r for r in rows if fold[r[1]] != f])
            right = (mlp.logits(params, t[:, :3]) > 0) == (t[:, 3] > .5)
            assert got[c, f] == (pytest.approx(right.mean()), 100)
    summary = train.grid_summary(scores)
    best = summary.filter("best").first()["candidate"]
    refit = train.refit_best(df, FEATURES, grid, summary, tasks=2).collect()
    params, loss = fit(grid[best], rows)
    assert [(r["candidate"], r["n"]) for r in refit] == [(best, 300)] and refit[0]["loss"] == pytest.approx(loss)
    for got_, want in zip(refit[0]["model"], params, strict=True):
        np.testing.assert_allclose(got_, want.ravel(), atol=1e-9)
    assert train.refit_best(df, FEATURES, grid, summary.withColumn("mean_score", F.lit(None))).count() == 0


def test_the_search_tries_every_published_setting(spark):
    from flowspark.plans.model_queries import grid_search

    rows = grid_search(spark, "/root/testdata/sf0.001").collect()
    tried = {(r["optimizer"], r["batch_size"], r["lr"], r["momentum"], r["weight_decay"]) for r in rows}
    assert len(tried) == len(rows) == 144
    assert {(o, b, lr, None, w) for o in ("adamw", "adam") for b in (256, 512, 1024) for lr in (1e-3, 1e-4)
            for w in (0.1, 0.01, 0.001)} < tried
    assert {("sgd", b, lr, m, w) for b in (64, 128, 512, 1024) for lr in (0.1, 0.02, 1e-4) for m in (0.0, 0.6, 0.9)
            for w in (0.01, 0.001, 1e-4)} < tried
    best = [r for r in rows if r["best"]]
    assert len(best) == 1 and [len(t) for t in best[0]["model"]] == [32, 8, 8, 8, 8, 1]
    assert best[0]["mean_score"] == max(r["mean_score"] for r in rows)
    assert all(r["model"] is None for r in rows if not r["best"])


def test_a_fold_without_rows_has_no_score(spark):
    df = train.to_shards(spark.createDataFrame(data(4), SCHEMA), FEATURES, "label", "client", "key", None)
    got = train.grid_search(df, FEATURES, [CFG.with_(batch_size=None, epochs=1)], 40, tasks=2)
    assert got.count() == 40 and got.where("score IS NULL AND n = 0").count() >= 36
    one = train.grid_search(df, FEATURES, [CFG.with_(batch_size=None, epochs=1)], 1, tasks=2).collect()
    assert [(r["score"], r["n"]) for r in one] == [(None, 0)]


def test_places_cut_the_line_in_equal_steps(spark):
    df = spark.range(2000).withColumn("p", allreduce.place("s", 0, F.col("id")))
    got = [r["p"] for r in df.collect()]
    for steps in (1, 3, 7):
        bounds = [allreduce._bound(s, steps) for s in range(steps + 1)]
        assert bounds[0] == 0 and bounds[-1] == allreduce.POINTS
        for p in got[:300]:
            s = p * steps >> 32
            assert bounds[s] <= p < bounds[s + 1]


def test_plain_models_of_the_same_batches_step_together(spark, monkeypatch):
    """Stacked gradients are those of each model, and a search comes out as that of one model at a time."""
    r = np.random.default_rng(5)
    for hidden in ((), (4,), (5, 3)):
        nets = [[t + r.normal(size=t.shape) for t in mlp.init(3, hidden, s)] for s in range(4)]
        x, y = r.normal(size=(40, 3)), (r.random(40) > .5).astype(float)
        for stack in (1, 500, 1 << 15):
            monkeypatch.setattr(mlp, "_STACK", stack)
            losses, grads = mlp.stacked_gradients([np.stack(t) for t in zip(*nets)], x, y)
            for m, net in enumerate(nets):
                loss, want, _ = mlp.gradients(net, x, y)
                assert losses[m] == pytest.approx(loss)
                for got, g in zip(grads, want, strict=True):
                    np.testing.assert_allclose(got[m], g, atol=1e-12)
    rows = data(400, ("all",))
    df = train.to_shards(spark.createDataFrame(rows, SCHEMA), FEATURES, "label", "client", "key", None)
    grid = train.settings(CFG, optimizer=("sgd", "adam", "adamw"), lr=(.01, .1), batch_size=(30, 50))
    grid.append(CFG.with_(batch_size=30, mu=0.5))
    kept, train_, apart = [], allreduce.train, False

    def keep(rows, features, jobs, *rest):
        for job in jobs if apart else ():
            job.plain = False
        kept.append(train_(rows, features, jobs, *rest))
        return kept[-1]

    monkeypatch.setattr(allreduce, "train", keep)
    monkeypatch.setattr(allreduce, "STRETCH_ROWS", 90)
    sizes = {len(g) for g in allreduce._groups([allreduce.Job(
        "j", 0, True, 300, b, nets[0], None, None, nets[0], None, mlp.Optimizer("sgd", .1, 0, 0), plain=p)
        for b, p in ((30, True), (50, True), (30, True), (30, False))])}
    assert sizes == {1, 2}
    for tasks in (1, 3):
        train.grid_search(df, FEATURES, grid, 3, tasks=tasks, stratified=True).count()
    apart = True
    train.grid_search(df, FEATURES, grid, 3, tasks=1, stratified=True).count()
    for got in kept[:2]:
        for a, b in zip(got, kept[2], strict=True):
            assert a.name == b.name and a.opt.step_no == b.opt.step_no > 0
            np.testing.assert_allclose(a.losses, b.losses, atol=1e-9)
            for s, t in zip(a.params, b.params, strict=True):
                np.testing.assert_allclose(s, t, atol=1e-8)
