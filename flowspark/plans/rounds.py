"""Whole runs: federated, local and central training with evaluation on every client.

Scaled rows are written once; what is persisted on executors is their copy dealt to shards, which a lost
executor rebuilds from that table by one scan and shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, functions as F

from flowspark.operators import mlp, params as fed, score, train
from flowspark.operators.metrics import rates
from flowspark.operators.prep import union_clients
from flowspark.operators.scaling import apply_minmax, fit_minmax
from flowspark.operators.score import (
    METRICS, as_metric_log, evaluate_models, load_models, model_rows, scaler_arrays,
)
from flowspark.operators.train import TrainConfig
from flowspark.session import scratch_path, settle

Hook = Callable[[int, DataFrame], None]


def _some_clients(clients: DataFrame, n: int | None, seed: str) -> DataFrame:
    """The clients taking part in a round: the first ``n`` in hash order."""
    if n is None:
        return clients
    if n <= 0:
        raise ValueError("at least one client must take part")
    return clients.orderBy(F.md5(F.concat_ws(":", F.lit(seed), "client"))).limit(n)


def federated_run(
    data: DataFrame, test: DataFrame, features: list[str], label: str, client: str, key: str,
    rounds: int, strategy: fed.Strategy, cfg: TrainConfig, models: int = 1,
    fit_clients: int | None = None, eval_clients: int | None = None,
    config_fn: Callable[[int], dict] | None = None, on_round: Hook | None = None,
    weight_unit: str = "rows", out: str | None = None,
) -> DataFrame:
    """Federated training; rows (model, round, client, metric, value).

    Rows are scaled per client by the fit on its own training rows and placed in shards once. A
    round trains all taking-part clients, combines them and evaluates the new global model; its
    parameters and metrics are written to shared scratch, so no round depends on an earlier plan.
    ``config_fn`` may change settings per round, save the number of shards or tasks; ``on_round`` sees the metrics of each round.

    ``out`` (by default a scratch folder) receives ``params`` (layer, pos, value), ``metrics`` and
    ``history`` (loss and accuracy over clients, weighted by rows), by model and round; with Fed+ also
    ``personal``, the metrics of :func:`own_scores` for every client's own model.
    """
    if rounds <= 0 or models <= 0:
        raise ValueError("at least one round and one model are needed")
    spark = data.sparkSession
    base = out or scratch_path(spark, "federated")
    scaler = settle(fit_minmax(data, features, [client]), "scalers")
    scaled_test = apply_minmax(test, scaler, features, [client]).select(client, *features, label)
    scaled_test = settle(scaled_test, "scaled_test")
    scaled = settle(apply_minmax(data, scaler, features, [client]), "scaled")
    shards = train.to_shards(scaled, features, label, client, key, cfg.groups)
    shards = shards.persist(StorageLevel.MEMORY_AND_DISK)
    clients = settle(shards.select("client").distinct(), "clients")
    shapes = mlp.shapes(len(features), cfg.hidden)
    cfg = cfg.with_(**strategy.client_settings())
    personal = cfg.delta is not None
    try:
        for number in range(1, models + 1):
            start = mlp.init(len(features), cfg.hidden, cfg.seed + number)
            state = model_rows(spark, start).select(
                F.lit(0).alias("round"), "*", F.lit(0.0).alias("m"), F.lit(0.0).alias("v")
            )
            local = None
            for r in range(1, rounds + 1):
                step = cfg.with_(**(config_fn(r) if config_fn else {}))
                chosen = _some_clients(clients, fit_clients, f"fit:{cfg.seed}:{number}:{r}")
                rows = shards if fit_clients is None else shards.join(chosen, "client", "left_semi")
                trained = train.client_update(rows, features, start, step, r, local)
                merged = settle(
                    train.merge_shards(trained, r, weight_unit, step.batch_size), "client_models"
                )
                if personal:
                    own = merged.select("client", "layer", "pos", "value")
                    if local is not None and fit_clients is not None:
                        own = own.unionByName(local.join(own, "client", "left_anti"))
                    local = settle(own, "personal")
                state = state.withColumn("round", F.lit(r))
                state = settle(strategy.aggregate(merged, state), "state")
                start = load_models(state, shapes)[""]
                state.select("layer", "pos", "value").write.parquet(
                    f"{base}/params/model={number}/round={r}"
                )
                seen = scaled_test
                if eval_clients is not None:
                    some = _some_clients(clients, eval_clients, f"eval:{cfg.seed}:{number}:{r}")
                    seen = scaled_test.join(
                        some.withColumnRenamed("client", client), client, "left_semi"
                    )
                scored = evaluate_models(seen, {str(number): start}, features, label, client)
                scored = settle(scored, "scored")
                weighted_history(scored).write.parquet(f"{base}/history/model={number}/round={r}")
                log = as_metric_log(scored, client).select("client", "metric", "value")
                path = f"{base}/metrics/model={number}/round={r}"
                log.write.parquet(path)
                if personal:
                    own_scores(scaled_test, local, shapes, features, label, client).write.parquet(
                        f"{base}/personal/model={number}/round={r}"
                    )
                if on_round:
                    on_round(r, spark.read.parquet(path))
    finally:
        shards.unpersist()
    return spark.read.parquet(f"{base}/metrics").select("model", "round", "client", "metric", "value")


def _model_groups(models: DataFrame, size: int) -> list[Callable[[str], Column]]:
    """Conditions on a client column that part the models into groups small enough to ship: one
    group unless the models together are too large. A name and its scaler get the same group."""
    clients = models.select("client").distinct().count()
    groups = max(1, math.ceil(2 * clients * size / score.MAX_PARAMETERS))

    def mine(g: int) -> Callable[[str], Column]:
        return lambda c: F.pmod(F.xxhash64(F.col(c).cast("string")), F.lit(groups)) == g

    return [mine(g) for g in range(groups)]


def own_scores(
    test: DataFrame, models: DataFrame, shapes: list[tuple[int, ...]], features: list[str],
    label: str, client: str,
) -> DataFrame:
    """Each client's own model on its own test set and on the central one, which is all test sets
    together: rows (client, test, metric, value). ``models`` is (client, layer, pos, value)."""
    size = sum(math.prod(shape) for shape in shapes)
    parts = []
    for mine in _model_groups(models, size):
        nets = load_models(models.filter(mine("client")), shapes, "client")
        scored = evaluate_models(test, nets, features, label, client)
        parts.append(scored.withColumnRenamed(client, "_test"))
    scored = settle(union_clients(parts), "own_scores")
    n = F.expr("tp + fp + fn + tn")
    counts = ["tp", "fp", "fn", "tn"]

    def total(rows: DataFrame, name: str) -> DataFrame:
        sums = rows.groupBy(F.col("model").alias("client")).agg(
            *[F.sum(c).alias(c) for c in counts], F.sum(F.col("final_loss") * n).alias("_loss")
        )
        return rates(sums).withColumn("final_loss", F.try_divide("_loss", n)).select(
            "client", F.lit(name).alias("test"), *METRICS
        )

    both = total(scored.filter("model = _test"), "own").unionByName(total(scored, "central"))
    return both.unpivot(["client", "test"], METRICS, "metric", "value")


def weighted_history(scored: DataFrame) -> DataFrame:
    """Loss and accuracy over the clients of a round, weighted by their rows."""
    rows = scored.withColumn("n", F.expr("tp + fp + fn + tn"))
    return rows.agg(
        (F.sum(F.col("final_loss") * F.col("n")) / F.sum("n")).alias("loss"),
        (F.sum(F.col("accuracy") * F.col("n")) / F.sum("n")).alias("accuracy"),
        F.sum("n").alias("n"),
    )


def _train_and_save(shards, features, start, cfg, run: int, base: str) -> DataFrame:
    """Train every client once; keep the training output, the models and the epoch losses."""
    trained = settle(train.client_update(shards, features, start, cfg, run), "trained")
    path = f"{base}/params/run={run}"
    train.merge_shards(trained, run).select("client", "layer", "pos", "value").write.parquet(path)
    train.train_log(trained).write.parquet(f"{base}/train_log/run={run}")
    return shards.sparkSession.read.parquet(path)


def local_run(
    data: DataFrame, test: DataFrame, features: list[str], label: str, client: str, key: str,
    cfg: TrainConfig, runs: int = 1, out: str | None = None,
) -> DataFrame:
    """One model per client, each evaluated on all clients with its own scaler.

    Rows (run, model, client, metric, value); all clients train in one job. ``out`` receives
    ``params``, ``train_log`` and ``metrics`` by run.
    """
    spark = data.sparkSession
    scaler = settle(fit_minmax(data, features, [client]), "scalers")
    scaled = settle(apply_minmax(data, scaler, features, [client]), "scaled")
    shards = train.to_shards(scaled, features, label, client, key, cfg.groups)
    shards = shards.persist(StorageLevel.MEMORY_AND_DISK)
    shapes = mlp.shapes(len(features), cfg.hidden)
    size = sum(math.prod(shape) for shape in shapes)
    base = out or scratch_path(spark, "local")
    try:
        for run in range(1, runs + 1):
            step = cfg.with_(seed=cfg.seed + run)
            start = mlp.init(len(features), cfg.hidden, step.seed)
            merged = _train_and_save(shards, features, start, step, run, base)
            for mine in _model_groups(merged, size):
                models = load_models(merged.filter(mine("client")), shapes, "client")
                scalers = scaler_arrays(scaler.filter(mine(client)), features, client)
                scored = evaluate_models(test, models, features, label, client, scalers)
                log = as_metric_log(scored, client)
                log.write.mode("append").parquet(f"{base}/metrics/run={run}")
    finally:
        shards.unpersist()
    return spark.read.parquet(f"{base}/metrics").select("run", "model", "client", "metric", "value")


def central_run(
    data: DataFrame, test: DataFrame, features: list[str], label: str, client: str, key: str,
    cfg: TrainConfig, runs: int = 1, out: str | None = None,
) -> DataFrame:
    """One model on the distinct rows of all clients, evaluated per client with its scaler.

    Rows (run, client, metric, value). ``out`` receives ``params``, ``train_log`` and ``metrics``
    by run.
    """
    spark = data.sparkSession
    pooled = data.groupBy(*features, label).agg(F.min(key).alias(key))
    scaler = settle(fit_minmax(pooled, features), "scaler")
    scaled = settle(apply_minmax(pooled, scaler, features).withColumn("_central", F.lit("central")), "scaled")
    shards = train.to_shards(scaled, features, label, "_central", key, cfg.groups)
    shards = shards.persist(StorageLevel.MEMORY_AND_DISK)
    scalers = {"central": scaler_arrays(scaler, features)[""]}
    shapes = mlp.shapes(len(features), cfg.hidden)
    base = out or scratch_path(spark, "central")
    try:
        for run in range(1, runs + 1):
            step = cfg.with_(seed=cfg.seed + run)
            start = mlp.init(len(features), cfg.hidden, step.seed)
            merged = _train_and_save(shards, features, start, step, run, base)
            models = load_models(merged, shapes, "client")
            scored = evaluate_models(test, models, features, label, client, scalers)
            as_metric_log(scored, client).drop("model").write.parquet(f"{base}/metrics/run={run}")
    finally:
        shards.unpersist()
    return spark.read.parquet(f"{base}/metrics").select("run", "client", "metric", "value")
