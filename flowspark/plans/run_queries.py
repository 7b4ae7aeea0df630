"""Whole training runs small enough in form for SQL to repeat.

The model is a logistic regression trained by full-batch gradient steps, so that every step, the
combination of the clients and the evaluation are sums over the whole tables.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from flowspark.operators import mlp, params as fed, train
from flowspark.operators.scaling import apply_minmax, fit_minmax
from flowspark.plans import rounds
from flowspark.plans.model_queries import TUNING_SHARE, tuning_rows
from flowspark.plans.prepare_queries import r6
from flowspark.plans.registry import query
from flowspark.plans.standins import FLOW_FEATURES, TRAINING, training_flows
from flowspark.session import scratch_path

LINEAR = train.TrainConfig(
    hidden=(), epochs=2, lr=0.5, momentum=0.0, weight_decay=0.0, optimizer="sgd", batch_size=None
)
_N = len(FLOW_FEATURES)
_W = range(_N + 1)


def _number(v: float) -> str:
    text = repr(float(v))
    return text if "e" in text else text + "e0"


def _start() -> list[float]:
    """Initial weights and bias of run or model 1."""
    w, b = mlp.init(_N, (), LINEAR.seed + 1)
    return [*map(float, w[:, 0]), float(b[0])]


_RANGES = ", ".join(f"min({c}) AS lo{i}, max({c}) AS hi{i}" for i, c in enumerate(FLOW_FEATURES))
_SCALED = ", ".join(f"({c} - lo{i}) / (hi{i} - lo{i}) AS x{i}" for i, c in enumerate(FLOW_FEATURES))
_Z = f"(w.w{_N} + " + " + ".join(f"w.w{i} * x.x{i}" for i in range(_N)) + ")"

PER_CLIENT = f"""{TRAINING},
fit AS (SELECT client_id, {_RANGES} FROM training WHERE NOT held GROUP BY client_id),
x AS (SELECT client_id, held, label, {_SCALED} FROM training JOIN fit USING (client_id)),
start AS (SELECT {', '.join(f'{_number(v)} AS w{i}' for i, v in enumerate(_start()))})"""


def _gradient(name: str, weights: str) -> str:
    """Mean gradient of each client at its weights."""
    error = f"(1 / (1 + exp(-{_Z})) - x.label)"
    parts = [f"avg({error} * x.x{i}) AS g{i}" for i in range(_N)] + [f"avg({error}) AS g{_N}"]
    return f"""{name} AS (SELECT x.client_id, count(*) AS n, {', '.join(parts)}
      FROM x JOIN {weights} w ON x.client_id = w.client_id WHERE NOT held GROUP BY x.client_id)"""


def _each(expr: str) -> str:
    return ", ".join(f"{expr.format(i=i)} AS w{i}" for i in _W)


def _metrics(select: str, rows: str) -> str:
    """Metric rows from (…, z, label), by the selected keys."""
    return f"""SELECT {select}, metric, round(value, 6) AS value FROM (
      SELECT {select}, (tp + tn) / (tp + fp + fn + tn) AS accuracy,
        coalesce(tp / nullif(tp + fp, 0), 0) AS "precision", coalesce(tp / nullif(tp + fn, 0), 0) AS recall,
        coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1_score, final_loss
      FROM (SELECT {select}, count(*) FILTER (WHERE z > 0 AND label = 1) AS tp,
        count(*) FILTER (WHERE z > 0 AND label = 0) AS fp, count(*) FILTER (WHERE z <= 0 AND label = 1) AS fn,
        count(*) FILTER (WHERE z <= 0 AND label = 0) AS tn,
        avg(greatest(z, 0) - z * label + ln(1 + exp(-abs(z)))) AS final_loss
        FROM ({rows}) GROUP BY ALL))
      UNPIVOT (value FOR metric IN (accuracy, "precision", recall, f1_score, final_loss))"""


def federated_sql(
    n_rounds: int, epochs: int, mu: float = 0.0, delta: float | None = None, adam: dict | None = None,
    personal: bool = False, schedule: list[dict] | None = None,
) -> str:
    """SQL of a federated run with weights by rows; ``personal`` evaluates the clients' own models.

    ``schedule`` holds epochs and lr of each round where they change.
    """
    schedule = schedule or [{"epochs": epochs, "lr": LINEAR.lr}] * n_rounds
    ctes, evals = [PER_CLIENT], []
    ctes.append(f"global0 AS (SELECT {_each('w{i}')} FROM start)")
    ctes.append("own0 AS (SELECT client_id, global0.* FROM fit CROSS JOIN global0)")
    for r in range(1, n_rounds + 1):
        g = f"global{r - 1}"
        begin = f"own{r - 1}" if delta is not None else f"begin{r}"
        if delta is None:
            ctes.append(f"begin{r} AS (SELECT client_id, {g}.* FROM fit CROSS JOIN {g})")
        now, lr = begin, _number(schedule[r - 1]["lr"])
        for e in range(schedule[r - 1]["epochs"]):
            ctes.append(_gradient(f"g{r}_{e}", now))
            step = f"p.w{{i}} - {lr} * (d.g{{i}} + {_number(mu)} * (p.w{{i}} - {g}.w{{i}}))"
            if delta is not None:
                theta = f"(o.w{{i}} - {g}.w{{i}}) / {_number(1 + delta)}"
                step = f"0.9e0 * ({step}) + 0.1e0 * ({g}.w{{i}} + {theta})"
            ctes.append(
                f"""w{r}_{e} AS (SELECT p.client_id, d.n, {_each(step)} FROM {now} p
                JOIN g{r}_{e} d ON p.client_id = d.client_id JOIN {begin} o ON p.client_id = o.client_id
                CROSS JOIN {g})"""
            )
            now = f"w{r}_{e}"
        ctes.append(f"own{r} AS (SELECT client_id, {_each('w{i}')} FROM {now})")
        mean = "(sum(w{i} * n) / sum(n))"
        if adam:
            d = f"({mean} - max(old.w{{i}}))"
            b1, b2 = 1 - adam["beta_1"], 1 - adam["beta_2"]
            moved = (
                f"max(old.w{{i}}) + {_number(adam['eta'])} * ({_number(b1)} * {d})"
                f" / (sqrt({_number(b2)} * {d} * {d}) + {_number(adam['tau'])})"
            )
            moved = moved.replace("sum(w{i}", "sum(t.w{i}")
            ctes.append(f"global{r} AS (SELECT {_each(moved)} FROM {now} t CROSS JOIN {g} old)")
        else:
            ctes.append(f"global{r} AS (SELECT {_each(mean)} FROM {now})")
        if personal:
            both = " UNION ALL ".join(
                f"""SELECT {r} AS round, w.client_id AS client, '{test}' AS test, x.label, {_Z} AS z
                FROM x JOIN own{r} w ON {match} WHERE held"""
                for test, match in (("own", "x.client_id = w.client_id"), ("central", "true"))
            )
            evals.append(_metrics("round, client, test", both))
            continue
        scored = f"""SELECT 1 AS model, {r} AS round, x.client_id AS client, x.label, {_Z} AS z
          FROM x CROSS JOIN global{r} w WHERE held"""
        evals.append(_metrics("model, round, client", scored))
    return f"WITH {', '.join(ctes)} " + " UNION ALL ".join(evals)


def _federated(spark, sf, name: str, n_rounds: int, epochs: int, shards: int = LINEAR.shards, **settings):
    data, test = training_flows(spark, sf)
    log = rounds.federated_run(
        data, test, FLOW_FEATURES, "label", "client_id", "key", n_rounds,
        fed.strategy(name, **settings), LINEAR.with_(epochs=epochs, shards=shards),
    )
    return log.select("model", "round", "client", "metric", r6("value"))


@query("fedavg_linear", federated_sql(2, 2))
def fedavg_linear(spark, sf):
    return _federated(spark, sf, "fedavg", 2, 2)


@query("fedavg_linear_shards", federated_sql(2, 2))
def fedavg_linear_shards(spark, sf):
    """As ``fedavg_linear``, the rows of each client shared by seven tasks."""
    return _federated(spark, sf, "fedavg", 2, 2, shards=7)


#: Settings of each round: one epoch with large steps, then two with smaller ones.
_SCHEDULE = [{"epochs": 1, "lr": 0.8}, {"epochs": 2, "lr": 0.2}]


@query(
    "fedavg_schedule",
    f"""SELECT round, client, metric, value FROM ({federated_sql(2, 2, schedule=_SCHEDULE)})""",
)
def fedavg_schedule(spark, sf):
    """Settings that change from round to round; the rows are those the callback of each round saw."""
    data, test = training_flows(spark, sf)
    seen = []
    rounds.federated_run(
        data, test, FLOW_FEATURES, "label", "client_id", "key", 2, fed.strategy("fedavg"), LINEAR,
        config_fn=lambda r: _SCHEDULE[r - 1],
        on_round=lambda r, metrics: seen.append(metrics.withColumn("round", F.lit(r))),
    )
    first, second = seen
    return first.unionByName(second).select("round", "client", "metric", r6("value"))


@query("fedprox_linear", federated_sql(1, 3, mu=0.8))
def fedprox_linear(spark, sf):
    return _federated(spark, sf, "fedprox", 1, 3, mu=0.8)


@query("fedplus_linear", federated_sql(2, 1, delta=0.1))
def fedplus_linear(spark, sf):
    return _federated(spark, sf, "fedavgplus", 2, 1)


@query("fedplus_personal", federated_sql(2, 1, delta=0.1, personal=True))
def fedplus_personal(spark, sf):
    """The clients' own models after each round, on their own test sets and on the central one."""
    data, test = training_flows(spark, sf)
    out = scratch_path(spark, "federated")
    rounds.federated_run(
        data, test, FLOW_FEATURES, "label", "client_id", "key", 2, fed.strategy("fedavgplus"),
        LINEAR.with_(epochs=1), out=out,
    )
    return spark.read.parquet(f"{out}/personal").select("round", "client", "test", "metric", r6("value"))


@query("fedplus_linear_shards", federated_sql(2, 1, delta=0.1))
def fedplus_linear_shards(spark, sf):
    return _federated(spark, sf, "fedavgplus", 2, 1, shards=7)


@query(
    "fedadam_linear",
    federated_sql(1, 1, adam={"eta": 0.1, "tau": 1e-3, "beta_1": 0.9, "beta_2": 0.99}),
)
def fedadam_linear(spark, sf):
    return _federated(spark, sf, "fedadam", 1, 1, eta_l=LINEAR.lr, tau=1e-3)


#: Step rules by optimizer: the new moments, then the new weight, from weight w, moments m and v and
#: gradient g of step t.
_RULES = {
    "sgd": ("{momentum} * m{i} + g{i} + {decay} * w{i}", "0e0", "w{i} - {lr} * m{i}"),
    "adamw": (
        "0.9e0 * m{i} + 0.1e0 * g{i}", "0.999e0 * v{i} + 0.001e0 * g{i} * g{i}",
        "w{i} * (1 - {lr} * {decay}) - {lr} * (m{i} / (1 - 0.9e0 ** {t})) / (sqrt(v{i} / (1 - 0.999e0 ** {t})) + 1e-8)",
    ),
}


def _steps(cfg: train.TrainConfig, begin: str, gradient) -> tuple[list[str], str]:
    """CTEs of full-batch steps from the weights of CTE ``begin``; the name of the last one."""
    m, v, w = _RULES[cfg.optimizer]
    zeros = ", ".join(f"0e0 AS m{i}, 0e0 AS v{i}" for i in _W)
    ctes, now = [f"s0 AS (SELECT *, {zeros} FROM {begin})"], "s0"
    for t in range(1, cfg.epochs + 1):
        fixed = {"lr": _number(cfg.lr), "decay": _number(cfg.weight_decay),
                 "momentum": _number(cfg.momentum), "t": t}
        moments = ", ".join(f"{m.format(i=i, **fixed)} AS m{i}, {v.format(i=i, **fixed)} AS v{i}" for i in _W)
        weights = ", ".join(f"{w.format(i=i, **fixed)} AS w{i}" for i in _W)
        ctes += [
            gradient(f"g{t}", now),
            f"""a{t} AS (SELECT client_id, {', '.join(f'w{i}' for i in _W)}, {moments}
              FROM {now} JOIN g{t} USING (client_id))""",
            f"s{t} AS (SELECT client_id, {weights}, {', '.join(f'm{i}, v{i}' for i in _W)} FROM a{t})",
        ]
        now = f"s{t}"
    return ctes, now


def local_sql(cfg: train.TrainConfig) -> str:
    steps, now = _steps(
        cfg, f"(SELECT client_id, {_each('w{i}')} FROM fit CROSS JOIN start)", _gradient
    )
    z = f"(w.w{_N} + " + " + ".join(
        f"w.w{i} * (t.{c} - lo{i}) / (hi{i} - lo{i})" for i, c in enumerate(FLOW_FEATURES)
    ) + ")"
    scored = f"""SELECT 1 AS run, w.client_id AS model, t.client_id AS client, t.label, {z} AS z
      FROM training t CROSS JOIN {now} w JOIN fit ON fit.client_id = w.client_id WHERE t.held"""
    return f"WITH {', '.join([PER_CLIENT, *steps])} {_metrics('run, model, client', scored)}"


def _local(spark, sf, cfg: train.TrainConfig):
    data, test = training_flows(spark, sf)
    log = rounds.local_run(data, test, FLOW_FEATURES, "label", "client_id", "key", cfg)
    return log.select("run", "model", "client", "metric", r6("value"))


@query("local_linear", local_sql(LINEAR))
def local_linear(spark, sf):
    return _local(spark, sf, LINEAR)


@query("local_linear_shards", local_sql(LINEAR))
def local_linear_shards(spark, sf):
    return _local(spark, sf, LINEAR.with_(shards=7))


MOMENTUM = LINEAR.with_(epochs=3, momentum=0.9, weight_decay=0.1)
ADAMW = LINEAR.with_(epochs=3, lr=0.05, weight_decay=0.1, optimizer="adamw")


@query("momentum_linear", local_sql(MOMENTUM))
def momentum_linear(spark, sf):
    return _local(spark, sf, MOMENTUM)


@query("adamw_linear", local_sql(ADAMW))
def adamw_linear(spark, sf):
    return _local(spark, sf, ADAMW)


@query("adamw_linear_shards", local_sql(ADAMW))
def adamw_linear_shards(spark, sf):
    return _local(spark, sf, ADAMW.with_(shards=5))


def central_sql(cfg: train.TrainConfig) -> str:
    steps, now = _steps(cfg, "(SELECT 'central' AS client_id, start.* FROM start)", _gradient)
    return f"""WITH {TRAINING},
    pooled AS (SELECT DISTINCT {', '.join(FLOW_FEATURES)}, label FROM training WHERE NOT held),
    fit AS (SELECT {_RANGES} FROM pooled),
    x AS (SELECT 'central' AS client_id, false AS held, label, {_SCALED} FROM pooled CROSS JOIN fit),
    start AS (SELECT {', '.join(f'{_number(v)} AS w{i}' for i, v in enumerate(_start()))}),
    {', '.join(steps)},
    t AS (SELECT client_id, label, {_SCALED} FROM training CROSS JOIN fit WHERE held)
    {_metrics('run, client', f"SELECT 1 AS run, x.client_id AS client, x.label, {_Z} AS z FROM t x CROSS JOIN {now} w")}"""


def _central(spark, sf, cfg: train.TrainConfig):
    data, test = training_flows(spark, sf)
    log = rounds.central_run(data, test, FLOW_FEATURES, "label", "client_id", "key", cfg)
    return log.select("run", "client", "metric", r6("value"))


@query("central_linear", central_sql(LINEAR))
def central_linear(spark, sf):
    return _central(spark, sf, LINEAR)


@query("central_linear_shards", central_sql(LINEAR))
def central_linear_shards(spark, sf):
    return _central(spark, sf, LINEAR.with_(shards=7))


MINIBATCH = LINEAR.with_(epochs=2, batch_size=8192, momentum=0.9, lr=0.2)


def minibatch_sql(cfg: train.TrainConfig) -> str:
    """SQL of mini-batch training of the central model: one recursion step per batch.

    A row's batch follows from md5(seed:run:epoch:key); the key of a distinct row is its smallest one.
    """
    key = "l_orderkey || '-' || l_partkey || '-' || l_suppkey || '-' || l_linenumber"
    error = f"(1 / (1 + exp(-{_Z})) - x.label)"
    grads = [f"coalesce(avg({error} * x.x{i}), 0)" for i in range(_N)] + [f"coalesce(avg({error}), 0)"]
    m = [f"({_number(cfg.momentum)} * any_value(w.m{i}) + {g})" for i, g in enumerate(grads)]
    step = ", ".join([f"any_value(w.w{i}) - {_number(cfg.lr)} * {m[i]}" for i in _W] + m)
    scored = f"""SELECT 1 AS run, x.client_id AS client, x.label, {_Z} AS z
      FROM t x CROSS JOIN (SELECT * FROM w ORDER BY s DESC LIMIT 1) w"""
    return f"""WITH RECURSIVE {TRAINING},
    keyed AS (SELECT {', '.join(FLOW_FEATURES)}, CAST(l_returnflag = 'R' AS INTEGER) AS label, {key} AS key
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
    pooled AS MATERIALIZED (SELECT {', '.join(FLOW_FEATURES)}, label, min(key) AS key FROM keyed
      WHERE substr(md5(key), 1, 2) >= '33' GROUP BY {', '.join(FLOW_FEATURES)}, label),
    fit AS (SELECT {_RANGES} FROM pooled),
    steps AS (SELECT CAST(ceil(count(*) / {cfg.batch_size}e0) AS BIGINT) AS n FROM pooled),
    x AS MATERIALIZED (SELECT label, {_SCALED}, e * n
        + ((CAST('0x' || substr(md5('{cfg.seed + 1}:1:' || e || ':' || key), 1, 8) AS BIGINT) * n) >> 32) AS s
      FROM pooled CROSS JOIN fit CROSS JOIN steps CROSS JOIN range({cfg.epochs}) r(e)),
    w AS (SELECT CAST(0 AS BIGINT) AS s, {', '.join(f'{_number(v)} AS w{i}' for i, v in enumerate(_start()))},
        {', '.join(f'0e0 AS m{i}' for i in _W)}
      UNION ALL SELECT w.s + 1, {step} FROM w LEFT JOIN x ON x.s = w.s
      WHERE w.s < (SELECT {cfg.epochs} * n FROM steps) GROUP BY w.s),
    t AS (SELECT client_id, label, {_SCALED} FROM training CROSS JOIN fit WHERE held)
    {_metrics('run, client', scored)}"""


@query("central_minibatch", minibatch_sql(MINIBATCH))
def central_minibatch(spark, sf):
    """Ordinary mini-batches of the whole central table, with up to seven tasks at work."""
    return _central(spark, sf, MINIBATCH.with_(tasks=min(7, spark.sparkContext.defaultParallelism)))


@query("central_minibatch_one", minibatch_sql(MINIBATCH))
def central_minibatch_one(spark, sf):
    """As ``central_minibatch``, in one task: the result is the same."""
    return _central(spark, sf, MINIBATCH.with_(tasks=1))


def _log_sql(cfg: train.TrainConfig) -> str:
    steps, _ = _steps(
        cfg, f"(SELECT client_id, {_each('w{i}')} FROM fit CROSS JOIN start)", _gradient
    )
    losses = " UNION ALL ".join(
        f"""SELECT x.client_id AS client, {e} AS epoch, round(avg(greatest({_Z}, 0) - {_Z} * x.label
          + ln(1 + exp(-abs({_Z})))), 6) AS loss FROM x JOIN s{e} w ON x.client_id = w.client_id
          WHERE NOT held GROUP BY x.client_id""" for e in range(cfg.epochs)
    )
    return f"WITH {', '.join([PER_CLIENT, *steps])} {losses}"


@query("train_log_linear", _log_sql(MOMENTUM))
def train_log_linear(spark, sf):
    """The training log that a local run leaves, read back."""
    data, test = training_flows(spark, sf)
    out = scratch_path(spark, "local")
    cfg = MOMENTUM.with_(shards=3)
    rounds.local_run(data, test, FLOW_FEATURES, "label", "client_id", "key", cfg, out=out)
    log = spark.read.parquet(f"{out}/train_log/run=1")
    return log.select("client", "epoch", r6("loss"))


_HIDDEN = 3


def layered_sql(start: list) -> str:
    """One full-batch plain step of a network with one normalised hidden layer, per client."""
    w, b, gain, shift, out, bias = (t.tolist() for t in start)
    js, ins = range(_HIDDEN), range(_N)
    pre = ", ".join(
        " + ".join([*(f"{_number(w[i][j])} * x{i}" for i in ins), _number(b[j])]) + f" AS p{j}" for j in js
    )
    mean = "(" + " + ".join(f"p{j}" for j in js) + f") / {_HIDDEN}"
    var = "(" + " + ".join(f"(p{j} - mu) ** 2" for j in js) + f") / {_HIDDEN}"
    n = ", ".join(f"(p{j} - mu) * inv AS n{j}" for j in js)
    o = ", ".join(f"{_number(gain[j])} * n{j} + {_number(shift[j])} AS o{j}" for j in js)
    z = " + ".join([*(f"{_number(out[j][0])} * greatest(o{j}, 0)" for j in js), _number(bias[0])])
    do = ", ".join(f"CASE WHEN o{j} > 0 THEN dz * {_number(out[j][0])} ELSE 0 END AS do{j}" for j in js)
    dn = ", ".join(f"do{j} * {_number(gain[j])} AS dn{j}" for j in js)
    dm = "(" + " + ".join(f"dn{j}" for j in js) + f") / {_HIDDEN} AS dm"
    dnn = "(" + " + ".join(f"dn{j} * n{j}" for j in js) + f") / {_HIDDEN} AS dnn"
    dp = ", ".join(f"inv * (dn{j} - dm - n{j} * dnn) AS dp{j}" for j in js)
    grads = [
        *((0, i * _HIDDEN + j, w[i][j], f"dp{j} * x{i}") for i in ins for j in js),
        *((1, j, b[j], f"dp{j}") for j in js), *((2, j, gain[j], f"do{j} * n{j}") for j in js),
        *((3, j, shift[j], f"do{j}") for j in js),
        *((4, j, out[j][0], f"dz * greatest(o{j}, 0)") for j in js), (5, 0, bias[0], "dz"),
    ]
    rows = " UNION ALL ".join(
        f"""SELECT client_id AS client, {layer} AS layer, {pos} AS pos,
        round({_number(value)} - {_number(LINEAR.lr)} * avg({g}), 6) AS value FROM e GROUP BY client_id"""
        for layer, pos, value, g in grads
    )
    return f"""WITH {PER_CLIENT}, a AS (SELECT *, {pre} FROM x WHERE NOT held),
    b AS (SELECT *, {mean} AS mu, 1 / sqrt({var} + 1e-5) AS inv FROM a), c AS (SELECT *, {n} FROM b),
    d0 AS (SELECT *, {o} FROM c), d1 AS (SELECT *, 1 / (1 + exp(-({z}))) - label AS dz FROM d0),
    d2 AS (SELECT *, {do} FROM d1), d3 AS (SELECT *, {dn} FROM d2), d4 AS (SELECT *, {dm}, {dnn} FROM d3),
    e AS (SELECT *, {dp} FROM d4) {rows}"""


_LAYERED = mlp.init(_N, (_HIDDEN,), LINEAR.seed)


@query("layered_step", layered_sql(_LAYERED))
def layered_step(spark, sf):
    data, _ = training_flows(spark, sf)
    scaled = apply_minmax(data, fit_minmax(data, FLOW_FEATURES, ["client_id"]), FLOW_FEATURES, ["client_id"])
    cfg = LINEAR.with_(hidden=(_HIDDEN,), epochs=1, shards=2)
    shards = train.to_shards(scaled, FLOW_FEATURES, "label", "client_id", "key", cfg.shards)
    merged = train.merge_shards(train.client_update(shards, FLOW_FEATURES, _LAYERED, cfg))
    return merged.select("client", "layer", "pos", r6("value"))


_RATES = (0.5, 2.0)


def grid_sql(k: int = 5) -> str:
    """SQL of a k-fold search over two rates, one full-batch step from the initial weights."""
    w, b = mlp.init(_N, (), LINEAR.seed)
    start = ", ".join(f"{_number(v)} AS w{i}" for i, v in enumerate([*map(float, w[:, 0]), float(b[0])]))
    key = "l_orderkey || '-' || l_partkey || '-' || l_suppkey || '-' || l_linenumber"
    rates = ", ".join(f"({i}, {_number(r)})" for i, r in enumerate(_RATES))
    error = f"(1 / (1 + exp(-{_Z})) - x.label)"
    grads = ", ".join([f"avg({error} * x.x{i}) AS g{i}" for i in range(_N)] + [f"avg({error}) AS g{_N}"])
    return f"""WITH keyed AS (SELECT *, {key} AS key, CAST(l_returnflag = 'R' AS INTEGER) AS label
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
    picked AS (SELECT * FROM keyed WHERE substr(md5(key), 1, 2) >= '33'
      AND substr(md5('69:' || key), 1, 8) < '19999999'),
    fit AS (SELECT {_RANGES} FROM picked),
    x AS (SELECT label, CAST('0x' || substr(md5('fold:' || key), 1, 8) AS BIGINT) % {k} AS fold, {_SCALED}
      FROM picked CROSS JOIN fit),
    start AS (SELECT {start}),
    folds AS (SELECT unnest(range({k})) AS f),
    g AS (SELECT f, {grads} FROM folds JOIN x ON x.fold <> f CROSS JOIN start w GROUP BY f),
    rates(candidate, lr) AS (VALUES {rates}),
    w AS (SELECT candidate, f, {_each('w{i} - lr * g{i}')} FROM rates CROSS JOIN g CROSS JOIN start),
    scores AS (SELECT w.candidate, f, avg(CAST(({_Z} > 0) = (x.label = 1) AS DOUBLE)) AS score
      FROM w JOIN x ON x.fold = f GROUP BY w.candidate, f)
    SELECT candidate, round(avg(score), 6) AS mean_score, round(stddev_pop(score), 6) AS std_score,
      row_number() OVER (ORDER BY avg(score) DESC, candidate) = 1 AS best FROM scores GROUP BY candidate"""


@query("grid_linear", grid_sql())
def grid_linear(spark, sf):
    grid = [LINEAR.with_(epochs=1, lr=lr) for lr in _RATES]
    rows = train.grid_summary(train.grid_search(tuning_rows(spark, sf, TUNING_SHARE), FLOW_FEATURES, grid))
    return rows.select("candidate", r6("mean_score"), r6("std_score"), "best")
