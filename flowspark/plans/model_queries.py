"""Queries over models: scoring, evaluation, training and tuning."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from flowspark.operators import mlp, params as fed, sampling, scaling, score, train
from flowspark.plans import rounds
from flowspark.plans.prepare_queries import r6
from flowspark.plans.registry import query
from flowspark.plans.standins import (
    FLOW_FEATURES, FLOWS, LINEAR_BIAS, LINEAR_WEIGHTS, flows, table, training_flows,
)
from flowspark.schemas import FEATURES
from flowspark.session import settle, spread

SMALL = train.TrainConfig(hidden=(16, 8), epochs=2, lr=1e-3, weight_decay=1e-2, batch_size=512)

# --- scoring ------------------------------------------------------------------------------------

_LOGIT = " + ".join(
    f"{w}e0 * ({c} - lo{i}) / (hi{i} - lo{i})" for i, (c, w) in enumerate(zip(FLOW_FEATURES, LINEAR_WEIGHTS))
)
_RANGE = ", ".join(f"min({c}) AS lo{i}, max({c}) AS hi{i}" for i, c in enumerate(FLOW_FEATURES))


@query(
    "score_linear",
    f"""WITH f AS (SELECT {_RANGE} FROM lineitem), z AS (
      SELECT l_orderkey, l_linenumber, l_extendedprice, {LINEAR_BIAS}e0 + {_LOGIT} AS logit FROM lineitem, f)
    SELECT l_orderkey, l_linenumber, l_extendedprice, round(logit, 6) AS logit,
      round(1 / (1 + exp(-logit)), 6) AS p, logit > 0 AS positive FROM z""",
)
def score_linear(spark, sf):
    line = table(spark, sf, "lineitem")
    fit = scaling.fit_minmax(line, FLOW_FEATURES)
    scaled = scaling.apply_minmax(line, fit, FLOW_FEATURES, suffix="_s")
    logit = score.linear_logit([f"{c}_s" for c in FLOW_FEATURES], LINEAR_WEIGHTS, LINEAR_BIAS)
    rows = scaled.withColumn("logit", logit)
    p = 1 / (1 + F.exp(-F.col("logit")))
    return rows.select(
        "l_orderkey", "l_linenumber", "l_extendedprice", r6("logit"), r6(p, "p"),
        (F.col("logit") > 0).alias("positive"),
    )


def demo_network(hidden: tuple[int, ...] = (6, 4)) -> list[np.ndarray]:
    """A layered model with weights from a rule, so that SQL can repeat it."""
    model = []
    for i, shape in enumerate(mlp.shapes(len(FLOW_FEATURES), hidden)):
        wave = np.sin(np.arange(1, math.prod(shape) + 1) * (1.7 + 0.3 * i)).round(3)
        is_gain = i % 4 == 2 and i < 4 * len(hidden)
        model.append((wave * 0.5 + 1 if is_gain else wave).round(4).reshape(shape))
    return model


def network_sql(model: list[np.ndarray], key: str, source: str, features: list[str]) -> str:
    """The same forward pass as SQL, one CTE per step."""
    steps = [f"h0 AS (SELECT {key}, {', '.join(f'CAST({c} AS DOUBLE) AS x{i}' for i, c in enumerate(features))} FROM {source})"]
    level, width = 0, len(features)

    def dot(w, b, j, n):
        return f"{b[j]}e0 + " + " + ".join(f"x{i} * ({w[i, j]}e0)" for i in range(n))

    for at in range(0, len(model) - 2, 4):
        w, b, gain, shift = model[at : at + 4]
        n = w.shape[1]
        linear = ", ".join(f"{dot(w, b, j, width)} AS a{j}" for j in range(n))
        mean = "(" + " + ".join(f"a{j}" for j in range(n)) + f") / {n}"
        var = "(" + " + ".join(f"(a{j} - mu) * (a{j} - mu)" for j in range(n)) + f") / {n}"
        out = ", ".join(
            f"greatest((a{j} - mu) / sqrt(var + 1e-5) * {gain[j]}e0 + ({shift[j]}e0), 0) AS x{j}"
            for j in range(n)
        )
        steps += [
            f"l{level} AS (SELECT {key}, {linear} FROM h{level})",
            f"m{level} AS (SELECT *, {mean} AS mu FROM l{level})",
            f"v{level} AS (SELECT *, {var} AS var FROM m{level})",
            f"h{level + 1} AS (SELECT {key}, {out} FROM v{level})",
        ]
        level, width = level + 1, n
    w, b = model[-2:]
    return f"WITH {', '.join(steps)} SELECT {key}, round({dot(w, b, 0, width)}, 6) AS logit FROM h{level}"


def packet_vector():
    """A vector as wide as a real packet, from the four flow features."""
    return [
        (F.col(FLOW_FEATURES[i % 4]) / (50.0, 100000.0, 0.1, 0.1)[i % 4] * (1 + i / 10)).alias(f"p{i}")
        for i in range(len(FEATURES))
    ]


def _waves(layer: int, rows: int, cols: int) -> np.ndarray:
    return np.sin(np.arange(1, rows * cols + 1) * (1.7 + 0.3 * layer)).round(3).reshape(rows, cols)


def wide_network() -> list[np.ndarray]:
    """The published layers (39 features to 512-256-128-96-48-1) with weights from a rule, for SQL to repeat.

    Per layer and unit, the weights of the inputs and then the bias are the next values of a wave.
    """
    widths, model = [len(FEATURES), *train.TrainConfig().hidden, 1], []
    for layer, (n, m) in enumerate(zip(widths, widths[1:])):
        units = _waves(layer, m, n + 1)
        model += [np.ascontiguousarray(units[:, :n].T), units[:, n].copy()]
        if layer < len(widths) - 2:
            wave = _waves(layer, 1, m)[0]
            model += [1 + wave / 2, wave / 4]
    return model


def wide_network_sql(key: str, source: str) -> str:
    """SQL, as common table expressions up to ``z`` (key, logit), of the wide network over packet vectors."""
    widths = [len(FEATURES), *train.TrainConfig().hidden, 1]
    packet = ", ".join(
        f"CAST({FLOW_FEATURES[i % 4]} AS DOUBLE) / {(50, 100000, 0.1, 0.1)[i % 4]}e0 * {1 + i / 10}e0"
        for i in range(len(FEATURES))
    )
    steps = [f"h0 AS (SELECT {key}, [{packet}, 1] AS x FROM {source})"]
    for i, (n, m) in enumerate(zip(widths, widths[1:])):
        turn = f"{1.7 + 0.3 * i}e0"
        wave = f"round(sin(j * {turn}), 3)"
        steps += [
            f"""w{i} AS MATERIALIZED (SELECT [[round(sin((u * {n + 1} + v + 1) * {turn}), 3)
              for v in range({n + 1})] for u in range({m})] AS w)""",
            f"""a{i} AS MATERIALIZED (SELECT {key}, [list_dot_product(x, u) for u in w] AS a
              FROM h{i}, w{i})""",
        ]
        if i < len(widths) - 2:
            steps += [
                f"""c{i} AS (SELECT {key}, [y - mu for y in a] AS c
                  FROM (SELECT *, list_avg(a) AS mu FROM a{i}))""",
                f"""h{i + 1} AS MATERIALIZED (SELECT {key}, list_append(list_transform(c, lambda y, j:
                  greatest(y / dev * (1 + {wave} / 2) + {wave} / 4, 0)), 1) AS x
                  FROM (SELECT *, sqrt(list_dot_product(c, c) / {m} + 1e-5) AS dev FROM c{i}))""",
            ]
    return f"{', '.join(steps)}, z AS (SELECT {key}, a[1] AS logit FROM a{len(widths) - 2})"


@query(
    "score_mlp_full",
    f"""WITH {wide_network_sql('l_orderkey, l_linenumber', 'lineitem')}
    SELECT l_orderkey, l_linenumber, round(logit, 6) AS logit FROM z""",
)
def score_mlp_full(spark, sf):
    """The published network, 39 features to 512-256-128-96-48-1, over every row."""
    line = spread(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *FLOW_FEATURES))
    rows = line.select("l_orderkey", "l_linenumber", *packet_vector())
    scored = score.score(rows, wide_network(), [f"p{i}" for i in range(len(FEATURES))])
    return scored.select("l_orderkey", "l_linenumber", r6("logit"))


_SCALED = [f"{c} / {d}" for c, d in zip(FLOW_FEATURES, ("50", "100000", "0.1e0", "0.1e0"))]


@query("score_mlp", network_sql(demo_network(), "l_orderkey, l_linenumber", "lineitem", _SCALED))
def score_mlp(spark, sf):
    line = spread(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *FLOW_FEATURES))
    scaled = line.select(
        "l_orderkey", "l_linenumber",
        *[(F.col(c) / d).alias(c) for c, d in zip(FLOW_FEATURES, (50.0, 100000.0, 0.1, 0.1))],
    )
    rows = score.score(scaled, demo_network(), FLOW_FEATURES)
    return rows.select("l_orderkey", "l_linenumber", r6("logit"))


@query("sql_score", network_sql(demo_network(), "l_orderkey, l_linenumber", "lineitem", _SCALED))
def sql_score(spark, sf):
    """The network as a function of SQL, its parameters read from a table of rows."""
    net = demo_network()
    rows = settle(score.model_rows(spark, net).withColumn("model", F.lit("demo")), "model")
    score.register_scorer(spark, "net_score", score.load_models(rows, [t.shape for t in net], "model"))
    vector = ", ".join(f"{c} / {d}D" for c, d in zip(FLOW_FEATURES, (50.0, 100000.0, 0.1, 0.1)))
    return spark.sql(
        f"""SELECT l_orderkey, l_linenumber, round(net_score('demo', array({vector})), 6) AS logit
        FROM {{line}}""",
        line=spread(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *FLOW_FEATURES)),
    )


_FIT = ", ".join(f"min({c}) AS lo{i}, max({c}) AS hi{i}" for i, c in enumerate(FLOW_FEATURES))


@query(
    "eval_grid",
    f"""WITH {FLOWS}, f AS (SELECT client_id AS model, {_FIT} FROM flows GROUP BY client_id),
    z AS (SELECT model, client_id, label, {LINEAR_BIAS}e0 + {_LOGIT} AS logit FROM flows CROSS JOIN f),
    c AS (SELECT model, client_id, count(*) FILTER (WHERE logit > 0 AND label = 1) AS tp,
      count(*) FILTER (WHERE logit > 0 AND label = 0) AS fp,
      count(*) FILTER (WHERE logit <= 0 AND label = 1) AS fn,
      count(*) FILTER (WHERE logit <= 0 AND label = 0) AS tn,
      avg(greatest(logit, 0) - logit * label + ln(1 + exp(-abs(logit)))) AS final_loss
      FROM z GROUP BY model, client_id)
    SELECT model, client_id, tp, fp, fn, tn, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy,
      round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1_score,
      round(final_loss, 6) AS final_loss FROM c""",
)
def eval_grid(spark, sf):
    rows = flows(spark, sf, client=True)
    scalers = score.scaler_arrays(
        scaling.fit_minmax(rows, FLOW_FEATURES, ["client_id"]), FLOW_FEATURES, "client_id"
    )
    linear = [np.array(LINEAR_WEIGHTS)[:, None], np.array([LINEAR_BIAS])]
    grid = score.evaluate_models(
        rows, {name: linear for name in scalers}, FLOW_FEATURES, "label", "client_id", scalers
    )
    return grid.select(
        "model", "client_id", "tp", "fp", "fn", "tn", r6("accuracy"), r6("f1_score"), r6("final_loss")
    )


# --- training -----------------------------------------------------------------------------------


def _shards(spark, sf, shards: int):
    data, _ = training_flows(spark, sf)
    scaler = scaling.fit_minmax(data, FLOW_FEATURES, ["client_id"])
    scaled = scaling.apply_minmax(data, scaler, FLOW_FEATURES, ["client_id"])
    return train.to_shards(scaled, FLOW_FEATURES, "label", "client_id", "key", shards)


@query("local_training")
def local_training(spark, sf):
    start = mlp.init(len(FLOW_FEATURES), SMALL.hidden, SMALL.seed)
    cfg = SMALL.with_(shards=4)
    trained = train.client_update(_shards(spark, sf, cfg.shards), FLOW_FEATURES, start, cfg)
    return train.merge_shards(trained)


@query("train_log")
def train_log(spark, sf):
    start = mlp.init(len(FLOW_FEATURES), SMALL.hidden, SMALL.seed)
    return train.train_log(train.client_update(_shards(spark, sf, SMALL.groups), FLOW_FEATURES, start, SMALL))


@query(
    "gradient_step",
    f"""WITH {FLOWS}, f AS (SELECT {_FIT} FROM flows),
    x AS (SELECT client_id, label, {', '.join(f'({c} - lo{i}) / (hi{i} - lo{i}) AS x{i}' for i, c in enumerate(FLOW_FEATURES))}
      FROM flows CROSS JOIN f)
    """ + " UNION ALL ".join(
        f"""SELECT client_id AS client, {layer} AS layer, {i} AS pos,
        round(-0.5e0 * avg((0.5e0 - label) * {x}), 6) AS value, count(*) AS weight FROM x GROUP BY client_id"""
        for layer, i, x in [*[(0, i, f"x{i}") for i in range(4)], (1, 0, "1")]
    ),
)
def gradient_step(spark, sf):
    """One full-batch step of a logistic regression from zero, per client."""
    rows = flows(spark, sf, client=True).withColumn("key", F.xxhash64("*"))
    scaled = scaling.apply_minmax(rows, scaling.fit_minmax(rows, FLOW_FEATURES), FLOW_FEATURES)
    shards = train.to_shards(scaled, FLOW_FEATURES, "label", "client_id", "key", 3)
    cfg = train.TrainConfig(
        hidden=(), epochs=1, lr=0.5, momentum=0.0, weight_decay=0.0, optimizer="sgd", batch_size=None, shards=3
    )
    start = [np.zeros((len(FLOW_FEATURES), 1)), np.zeros(1)]
    merged = train.merge_shards(train.client_update(shards, FLOW_FEATURES, start, cfg))
    return merged.select("client", "layer", "pos", r6("value"), "weight")


def _federated(spark, sf, name: str, cfg: train.TrainConfig, rounds_: int = 2, **overrides):
    data, test = training_flows(spark, sf)
    return rounds.federated_run(
        data, test, FLOW_FEATURES, "label", "client_id", "key", rounds_,
        fed.strategy(name, **overrides), cfg,
    )


@query("federated_run")
def federated_run(spark, sf):
    return _federated(spark, sf, "fedavg", SMALL)


@query("fedprox_round")
def fedprox_round(spark, sf):
    return _federated(spark, sf, "fedprox", SMALL.with_(epochs=1), 1, mu=0.5)


@query("fedplus_round")
def fedplus_round(spark, sf):
    return _federated(spark, sf, "fedavgplus", SMALL.with_(epochs=1), 2)


@query("fedadam_round")
def fedadam_round(spark, sf):
    return _federated(spark, sf, "fedadam", SMALL.with_(epochs=1), 1, eta_l=1e-3)


@query("local_run")
def local_run(spark, sf):
    data, test = training_flows(spark, sf)
    return rounds.local_run(data, test, FLOW_FEATURES, "label", "client_id", "key", SMALL)


@query("central_run")
def central_run(spark, sf):
    data, test = training_flows(spark, sf)
    return rounds.central_run(data, test, FLOW_FEATURES, "label", "client_id", "key", SMALL)


def tuning_rows(spark, sf, share: float):
    """A share of the training rows of all clients, scaled together."""
    data, _ = training_flows(spark, sf)
    sample = sampling.hash_sample(data, "key", share, 69)
    scaled = scaling.apply_minmax(sample, scaling.fit_minmax(sample, FLOW_FEATURES), FLOW_FEATURES)
    pooled = scaled.withColumn("_all", F.lit("all"))
    return settle(train.to_shards(pooled, FLOW_FEATURES, "label", "_all", "key", None), "tuning")


#: Share of the training rows that settings are tuned on, as published.
TUNING_SHARE = 0.1


#: The published searches: AdamW and Adam, and SGD with momentum.
TUNING_GRIDS = [
    {"optimizer": ("adamw", "adam"), "batch_size": (256, 512, 1024), "lr": (1e-3, 1e-4),
     "weight_decay": (0.1, 0.01, 0.001)},
    {"optimizer": ("sgd",), "batch_size": (64, 128, 512, 1024), "lr": (0.1, 0.02, 1e-4), "momentum": (0.0, 0.6, 0.9),
     "weight_decay": (0.01, 0.001, 1e-4)},
]


@query("grid_search")
def grid_search(spark, sf):
    """Both published grids, scored on five stratified folds; the best setting is trained again on all rows."""
    base = SMALL.with_(hidden=(8,), epochs=2)
    grid = [cfg for axes in TUNING_GRIDS for cfg in train.settings(base, **axes)]
    rows = tuning_rows(spark, sf, TUNING_SHARE)
    scores = train.grid_search(rows, FLOW_FEATURES, grid, stratified=True)
    summary = settle(train.grid_summary(scores), "summary")
    listed = [
        (c, cfg.optimizer, cfg.batch_size, cfg.lr, cfg.momentum if cfg.optimizer == "sgd" else None, cfg.weight_decay)
        for c, cfg in enumerate(grid)
    ]
    tried = spark.createDataFrame(
        listed, "candidate int, optimizer string, batch_size int, lr double, momentum double, weight_decay double"
    )
    model = train.refit_best(rows, FLOW_FEATURES, grid, summary).select("candidate", "loss", "model")
    return tried.join(summary, "candidate").join(model, "candidate", "left")


@query(
    "grid_summary",
    """WITH s AS (SELECT CAST(user_id % 12 AS INTEGER) AS candidate, avg(value / 1000) AS score
      FROM events GROUP BY user_id % 12, event_id % 5),
    g AS (SELECT candidate, avg(score) AS mean_score, stddev_pop(score) AS std_score FROM s GROUP BY candidate)
    SELECT candidate, round(mean_score, 6) AS mean_score, round(std_score, 6) AS std_score,
      row_number() OVER (ORDER BY mean_score DESC, candidate) = 1 AS best FROM g""",
)
def grid_summary(spark, sf):
    scores = table(spark, sf, "events").groupBy(
        (F.col("user_id") % 12).cast("int").alias("candidate"), (F.col("event_id") % 5).alias("fold")
    ).agg(F.avg(F.col("value") / 1000).alias("score"))
    rows = train.grid_summary(scores)
    return rows.select("candidate", r6("mean_score"), r6("std_score"), "best")
