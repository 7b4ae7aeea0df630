"""Training on each client's rows, which many tasks share.

``TrainConfig.shards`` says into how many groups the rows of a client are dealt; it never follows from the
data. With full batches (``batch_size=None``) the gradients of the shards are summed before every step, so
the result is the same for any number. Mini-batches run inside a shard, and the shards' parameters
and moments are averaged by rows after every epoch; one shard is ordinary mini-batch training.
Choose as many shards as it takes for a share of the largest client to fit in a task.

``TrainConfig.tasks`` asks for ordinary mini-batch training of all rows instead (``allreduce``), with at most that
many tasks at work; results do not depend on their number. Large steps are shared by the tasks; small ones follow
each other through stretches of the rows, and tasks divide the models.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, replace
from functools import partial, reduce
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from flowspark.operators import allreduce, mlp, sampling
from flowspark.operators.joins import key_join
from flowspark.operators.score import MAX_PARAMETERS, load_models
from flowspark.session import scratch_path, settle


@dataclass(frozen=True)
class TrainConfig:
    """Settings of a client update (defaults are the published ones)."""

    hidden: tuple[int, ...] = (512, 256, 128, 96, 48)
    epochs: int = 5
    lr: float = 1e-4
    momentum: float = 0.9
    weight_decay: float = 0.1
    optimizer: str = "adamw"
    batch_size: int | None = 512  # None: all rows of a client in every step
    shards: int = 8  # groups that share the rows of a client
    tasks: int | None = None  # if given: plain mini-batches over all rows, with that many tasks at work
    seed: int = 69
    mu: float | None = None  # proximal term, pulls towards the global model
    delta: float | None = None  # smoothing of the personal model, mixes with the global model
    lam: float = 0.0  # share of the global model in the start of the personal model

    def with_(self, **changes) -> TrainConfig:
        return replace(self, **changes)

    @property
    def groups(self) -> int | None:
        """Shards to deal rows to; None where training deals them to its tasks."""
        return None if self.tasks else self.shards


def begin(start: list[np.ndarray], own: list[np.ndarray] | None, cfg: TrainConfig) -> list[np.ndarray]:
    """Where a client starts: the global model, or its mix with the client's own (Fed+)."""
    if cfg.delta is None or own is None:
        return [t.copy() for t in start]
    return [(1 - cfg.lam) * w + cfg.lam * g for w, g in zip(own, start)]


def advance(
    opt: mlp.Optimizer, params: list[np.ndarray], grads: list[np.ndarray], start: list[np.ndarray],
    own: list[np.ndarray] | None, cfg: TrainConfig,
) -> list[np.ndarray]:
    """One step; every rule works element by element, so it may be given any part of the tensors."""
    if cfg.mu is not None:
        grads = [d + cfg.mu * (p - g) for d, p, g in zip(grads, params, start)]
    params = opt.step(params, grads)
    if cfg.delta is None:
        return params
    sigma = (1 - 0.9) / (cfg.lr * 0.9)
    k = 1 / (1 + cfg.lr * sigma)
    theta = [(w - g) / (1 + cfg.delta) for w, g in zip(own or start, start)]
    return [k * p + (1 - k) * (g + t) for p, g, t in zip(params, start, theta)]


def pull(params: list[np.ndarray], start: list[np.ndarray], cfg: TrainConfig) -> float:
    """The proximal part of the loss."""
    return 0.0 if cfg.mu is None else (
        cfg.mu / 2 * float(sum(((p - g) ** 2).sum() for p, g in zip(params, start)))
    )


def fit_arrays(
    start: list[np.ndarray], x: np.ndarray, y: np.ndarray, cfg: TrainConfig, seed: int,
    local: list[np.ndarray] | None = None, params: list[np.ndarray] | None = None,
    opt: mlp.Optimizer | None = None,
) -> tuple[list[np.ndarray], list[float]]:
    """Training from ``start``; returns the tensors and the mean loss of each epoch.

    ``params`` and ``opt`` resume a training that has begun.
    """
    rng = np.random.default_rng(seed)
    opt = opt or mlp.Optimizer(cfg.optimizer, cfg.lr, cfg.momentum, cfg.weight_decay)
    params = begin(start, local, cfg) if params is None else params
    size, losses = cfg.batch_size or max(len(y), 1), []
    for _ in range(cfg.epochs):
        order, total = rng.permutation(len(y)), 0.0
        for i in range(0, len(y), size):
            pick = order[i : i + size]
            loss, grads, _ = mlp.gradients(params, x[pick], y[pick])
            total += (loss + pull(params, start, cfg)) * len(pick)
            params = advance(opt, params, grads, start, local, cfg)
        losses.append(total / max(len(y), 1))
    return params, losses


def shard_seed(*parts) -> int:
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:8], 16)


def to_shards(
    df: DataFrame, features: list[str], label: str, client: str, key: str, shards: int | None
) -> DataFrame:
    """Rows (client, shard, key, features, label), the rows of a client dealt to ``shards`` by key.

    Without ``shards`` (None) rows stay where they are: training deals them to its tasks.
    """
    if shards is not None and shards < 1:
        raise ValueError("at least one shard is needed")
    rows = df.select(
        F.col(client).cast("string").alias("client"),
        F.pmod(F.xxhash64(F.lit("shard"), key), F.lit(shards or 1)).cast("int").alias("shard"),
        F.col(key).alias("key"), *[F.col(f).cast("double").alias(f) for f in features],
        F.col(label).cast("double").alias("label"),
    )
    return rows.repartition("client", "shard") if shards else rows


_OUT = "client string, shard int, n long, layer int, values array<double>, losses array<double>"
_STATE = (
    "client string, layer int, n long, step int, values array<double>, m array<double>,"
    " v array<double>, own array<double>, losses array<double>"
)


_ARROW_STATE = pa.schema([
    ("client", pa.string()), ("layer", pa.int32()), ("n", pa.int64()), ("step", pa.int32()),
    *((c, pa.list_(pa.float64())) for c in ("values", "m", "v", "own", "losses")),
])


def _arrays(pdf: pd.DataFrame, features: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels in an order that does not depend on how rows arrived."""
    pdf = pdf.sort_values(["key", *features, "label"])
    return pdf[features].to_numpy(dtype=float), pdf["label"].to_numpy(dtype=float)


def _name(pdf: pd.DataFrame):
    client = pdf["client"].iloc[0]
    return None if pd.isna(client) else client


def _own_tensors(local: DataFrame) -> DataFrame:
    """Personal models (client, layer, pos, value) as one array per tensor."""
    return local.groupBy("client", "layer").agg(
        F.sort_array(F.collect_list(F.struct("pos", "value")))["value"].alias("own")
    )


def client_update(
    shards: DataFrame, features: list[str], start: list[np.ndarray], cfg: TrainConfig,
    round_: int = 1, local: DataFrame | None = None,
) -> DataFrame:
    """Train every client from ``start``; rows (client, shard, n, layer, values, losses).

    ``shards`` comes from :func:`to_shards` with ``cfg.shards``. ``local`` (client, layer, pos, value)
    holds the personal models of the Fed+ update; with shards it is matched to the rows by a cogroup, so
    the models of many clients never meet in one place. With one shard all epochs run in one stage;
    with several, every epoch is one, and the result has one row per client and tensor (shard 0), as it has
    with ``cfg.tasks``.
    """
    if sum(t.size for t in start) > MAX_PARAMETERS:
        raise ValueError("the model is too large to ship to tasks")
    if cfg.tasks is not None:
        return _together(shards, features, start, cfg, round_, local)
    if cfg.shards > 1:
        return _shared_update(shards, features, start, cfg, round_, local)
    shared = shards.sparkSession.sparkContext.broadcast(start)

    def fit(pdf: pd.DataFrame, own=None) -> pd.DataFrame:
        client, shard = _name(pdf), int(pdf["shard"].iloc[0])
        seed = shard_seed(cfg.seed, round_, client, shard)
        params, losses = fit_arrays(shared.value, *_arrays(pdf, features), cfg, seed, own)
        return pd.DataFrame(
            {
                "client": client, "shard": shard, "n": len(pdf), "layer": range(len(params)),
                "values": [t.ravel() for t in params], "losses": [losses] * len(params),
            }
        )

    if local is None:
        return shards.groupBy("client", "shard").applyInPandas(lambda pdf: fit(pdf), _OUT)
    placed = _own_tensors(local).withColumn("shard", F.lit(0))

    def run(pdf: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        if pdf.empty:
            return pd.DataFrame(columns=["client", "shard", "n", "layer", "values", "losses"])
        return fit(pdf, _tensors(own, "own", shared.value) if len(own) else None)

    return (
        shards.groupBy("client", "shard").cogroup(placed.groupBy("client", "shard"))
        .applyInPandas(run, _OUT)
    )


def _together(rows, features, start, cfg: TrainConfig, round_: int, local) -> DataFrame:
    """All clients by summed gradients, as many at a time as may be shipped together."""
    spark = rows.sparkSession
    clients = settle(rows.groupBy("client").agg(F.count(F.lit(1)).alias("n")), "clients")
    size = sum(t.size for t in start) * (1 if local is None else 2)
    at_once = max(1, MAX_PARAMETERS // (4 * size))  # a model comes with its two moments
    listed = sorted(((r["client"], r["n"]) for r in clients.collect()), key=lambda r: (r[0] is None, r[0] or ""))
    path, shapes = scratch_path(spark, "trained"), [t.shape for t in start]
    for at in range(0, max(1, len(listed)), at_once):
        some = listed[at: at + at_once]
        codes = spark.createDataFrame([(c, i) for i, (c, _) in enumerate(some)], "client string, part int")
        own = {}
        if local is not None:
            mine = key_join(local, codes.select("client"), ["client"])
            own = load_models(mine.withColumn("client", F.coalesce("client", F.lit("\0"))), shapes, "client")
        jobs = []
        for i, (client, n) in enumerate(some):
            mine = own.get("\0" if client is None else client)
            jobs.append(allreduce.Job(
                client, i, False, n, cfg.batch_size, begin(start, mine, cfg),
                partial(advance, cfg=cfg), partial(pull, cfg=cfg), start, mine,
                mlp.Optimizer(cfg.optimizer, cfg.lr, cfg.momentum, cfg.weight_decay)))
        placed = key_join(rows.drop("shard"), codes, ["client"])
        allreduce.train(placed, features, jobs, cfg.epochs, f"{cfg.seed}:{round_}", cfg.tasks)
        out = [(j.name, 0, j.rows, layer, t.ravel().tolist(), j.losses)
               for j in jobs for layer, t in enumerate(j.params)]
        spark.createDataFrame(out, _OUT).write.mode("append").parquet(path)
    return spark.read.schema(_OUT).parquet(path)


def _tensors(rows: pd.DataFrame, col: str, like: list[np.ndarray]) -> list[np.ndarray]:
    found = rows.sort_values("layer")[col]
    return [np.array(v, dtype=float).reshape(t.shape) for v, t in zip(found, like)]


def _resumed(cfg: TrainConfig, step: int, m: list[np.ndarray], v: list[np.ndarray]) -> mlp.Optimizer:
    opt = mlp.Optimizer(cfg.optimizer, cfg.lr, cfg.momentum, cfg.weight_decay)
    opt.step_no, opt.m, opt.v = step, m, v
    return opt


def _ranked(shards: DataFrame, features: list[str]) -> DataFrame:
    """Rows (client, shard, rank, features, label) of mini-batch training, written once; ranks from 0 by key."""
    order = [F.col(c).asc_nulls_last() for c in ("key", *features, "label")]
    rank = F.row_number().over(W.partitionBy("client", "shard").orderBy(*order)) - 1
    return settle(shards.select("client", "shard", rank.alias("rank"), *features, "label"), "ranked")


def _in_turn(ranked: DataFrame, sizes: DataFrame, seed_of) -> DataFrame:
    """The rows of each shard in a random order of ``seed_of(client, shard)``, as rows (client, shard, features, label).

    A task holds the order of a shard (four bytes a row, eight while it is drawn), never its rows, which Spark sorts.
    """
    rows = key_join(ranked, sizes, ["client", "shard"])
    rest = [c for c in ranked.columns if c != "rank"]

    def deal(batches):
        last, place = None, None
        for batch in batches:
            clients, found = batch.column("client").to_pylist(), batch.column("shard").to_numpy()
            ranks, n = batch.column("rank").to_numpy(), batch.column("n").to_numpy()
            at = np.empty(len(ranks), np.int64)
            for lo, hi in _runs(clients, found):
                if last != (clients[lo], int(found[lo])):
                    last, place = (clients[lo], int(found[lo])), None
                    place = _places(int(n[lo]), seed_of(*last))
                at[lo:hi] = place[ranks[lo:hi]]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(at)], [*rest, "_at"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.select(*rest).schema.fields)
    rows = rows.mapInArrow(deal, f"{fields}, _at bigint").repartition("client", "shard")
    return rows.sortWithinPartitions("client", "shard", "_at").drop("_at")


def _places(n: int, seed: int) -> np.ndarray:
    """The place of each rank in ``permutation(n)`` of the seed, drawn in the smallest type that serves."""
    order = np.arange(n, dtype=np.uint32 if n < 2**32 else np.int64)
    np.random.default_rng(seed).shuffle(order)
    place = np.empty_like(order)
    for at in range(0, n, 1 << 20):
        some = order[at : at + (1 << 20)]
        place[some] = np.arange(at, at + len(some), dtype=order.dtype)
    return place


def _runs(clients: list, shards: np.ndarray) -> list[tuple[int, int]]:
    """Where rows of the same client and shard begin and end."""
    codes, _ = pd.factorize(np.array(clients, dtype=object), use_na_sentinel=False)
    edges = np.flatnonzero((np.diff(codes) != 0) | (np.diff(shards) != 0)) + 1
    return list(zip([0, *edges], [*edges, len(clients)])) if clients else []


def _shared_update(shards, features, start, cfg: TrainConfig, round_: int, local) -> DataFrame:
    """Epoch by epoch: every shard works from its client's state, and a task per client and tensor
    combines what the shards found (one tensor per shard of the client, bounded by ``cfg.shards``).

    Rows stream through the tasks: full batches as they lie, mini-batches in the order of the epoch. States are
    shipped for as many clients at a time as ``MAX_PARAMETERS`` allows; the others wait for a scan of their own.
    """
    spark = shards.sparkSession
    shared, whole = spark.sparkContext.broadcast(start), cfg.batch_size is None
    if whole:
        rows = shards.select("client", "shard", *features, "label")
        slots = settle(rows.select("client").distinct(), "slots")
    else:
        ranked = _ranked(shards, features)
        sizes = settle(ranked.groupBy("client", "shard").agg(F.count(F.lit(1)).alias("n")), "slots")
        slots = sizes.select("client").distinct()
    groups = -(-slots.count() * 4 * sum(t.size for t in start) // MAX_PARAMETERS)
    tensors = slots.withColumn("layer", F.explode(F.sequence(F.lit(0), F.lit(len(start) - 1))))
    if local is None:
        tensors = tensors.withColumn("own", F.lit(None).cast("array<double>"))
    else:
        tensors = key_join(tensors, _own_tensors(local), ["client", "layer"], "left")

    def first(batches):
        for pdf in batches:
            out = []
            for client, layer, own in zip(pdf["client"], pdf["layer"], pdf["own"]):
                g = shared.value[layer].ravel()
                mine = g if own is None else np.asarray(own, dtype=float)
                zero = np.zeros_like(g)
                out.append((client, layer, 0, 0, begin([g], [mine], cfg)[0], zero, zero, mine, []))
            yield pd.DataFrame(out, columns=_names(_STATE))

    def epoch(rows: DataFrame, old: DataFrame) -> DataFrame:
        """What the shards of the clients in ``old`` make of an epoch."""
        states: dict = {}
        for r in old.collect():
            states.setdefault(r["client"], []).append(r)
        sent = {}
        for client, own in states.items():
            own.sort(key=lambda r: r["layer"])
            sent[client] = own[0]["step"], *(
                [np.array(r[c], dtype=float).reshape(t.shape) for r, t in zip(own, start)]
                for c in ("values", "m", "v", "own"))
        models = spark.sparkContext.broadcast(sent)

        def found(client, n, step, loss, values, m, v, own) -> pd.DataFrame:
            return pd.DataFrame({
                "client": client, "layer": range(len(values)), "n": n, "step": step,
                "values": [t.ravel() for t in values], "m": [t.ravel() for t in m], "v": [t.ravel() for t in v],
                "own": [t.ravel() for t in own], "losses": [[loss]] * len(values),
            })[_names(_STATE)]

        def blocks(batches):
            for batch in batches:
                x = np.stack([batch.column(f).to_numpy(zero_copy_only=False) for f in features], 1)
                y = batch.column("label").to_numpy(zero_copy_only=False)
                clients, of = batch.column("client").to_pylist(), batch.column("shard").to_numpy()
                if whole:  # rows lie in any order
                    codes, names = pd.factorize(np.array(clients, dtype=object), use_na_sentinel=False)
                    for code, name in enumerate(names):
                        name = None if pd.isna(name) else name
                        if name in models.value:
                            yield name, 0, x[codes == code], y[codes == code]
                    continue
                for lo, hi in _runs(clients, of):
                    if clients[lo] in models.value:
                        yield clients[lo], int(of[lo]), x[lo:hi], y[lo:hi]

        def sums(batches):
            totals: dict = {}
            for client, _, x, y in blocks(batches):
                n, total, grads = totals.get(client, (0, 0.0, None))
                loss, more, _ = mlp.gradients(models.value[client][1], x, y)
                more = [g * len(y) for g in more]
                totals[client] = (n + len(y), total + loss * len(y),
                                  more if grads is None else [a + b for a, b in zip(grads, more)])
            for client, (n, total, grads) in totals.items():
                step, params, m, v, own = models.value[client]
                loss = total / n + pull(params, shared.value, cfg)
                yield found(client, n, step, loss, [g / n for g in grads], m, v, own)

        def steps(batches):
            now, waiting = None, []

            def take(size: int) -> None:
                nonlocal waiting
                x, y = (np.concatenate(part) for part in zip(*waiting))
                cut = len(y) - len(y) % size if size else len(y)
                for i in range(0, cut, size or max(cut, 1)):
                    pick = slice(i, i + size) if size else slice(None)
                    loss, grads, _ = mlp.gradients(run["params"], x[pick], y[pick])
                    run["loss"] += (loss + pull(run["params"], shared.value, cfg)) * len(y[pick])
                    run["params"] = advance(run["opt"], run["params"], grads, shared.value, run["own"], cfg)
                    run["n"] += len(y[pick])
                waiting = [(x[cut:], y[cut:])] if cut < len(y) else []

            def end():
                if waiting:
                    take(0)
                opt, m, v, own = run["opt"], run["m"], run["v"], run["own"]
                return found(now[0], run["n"], opt.step_no, run["loss"] / run["n"], run["params"],
                             opt.m or m, opt.v or v, own)

            run: dict = {}
            for client, shard, x, y in blocks(batches):
                if now != (client, shard):
                    if now is not None:
                        yield end()
                    now = client, shard
                    step, params, m, v, own = models.value[client]
                    run = {"params": params, "opt": _resumed(cfg, step, m, v), "m": m, "v": v, "own": own,
                           "loss": 0.0, "n": 0}
                waiting.append((x, y))
                if sum(len(part) for _, part in waiting) >= cfg.batch_size:
                    take(cfg.batch_size)
            if now is not None:
                yield end()

        def arrow(batches):
            for pdf in (sums if whole else steps)(batches):
                yield pa.RecordBatch.from_pandas(pdf, schema=_ARROW_STATE, preserve_index=False)

        return rows.mapInArrow(arrow, _STATE)

    def combine(parts: pd.DataFrame, old: pd.DataFrame) -> pd.DataFrame:
        if parts.empty:
            return old
        n = int(parts["n"].sum())
        order = np.argsort([tuple(v) for v in parts["losses"]], axis=0).ravel()  # sums in a fixed order

        def mean(col: str) -> np.ndarray:
            return sum(np.asarray(parts[col].iloc[i]) * (parts["n"].iloc[i] / n) for i in order)

        now = old.iloc[0]
        values, m, v, step = mean("values"), mean("m"), mean("v"), int(parts["step"].max())
        if whole:
            opt = _resumed(cfg, step, [m], [v])
            g = shared.value[int(now["layer"])].ravel()
            own = [np.asarray(now["own"], dtype=float)]
            values = advance(opt, [np.asarray(now["values"], dtype=float)], [values], [g], own, cfg)[0]
            step, m, v = opt.step_no, opt.m[0], opt.v[0]
        losses = [*now["losses"], float(mean("losses")[0])]
        row = (_name(parts), int(now["layer"]), n, step, values, m, v, now["own"], losses)
        return pd.DataFrame([row], columns=_names(_STATE))

    state = settle(tensors.select("client", "layer", "own").mapInPandas(first, _STATE), "begun")
    for number in range(cfg.epochs):
        if not whole:
            rows = _in_turn(ranked, sizes, lambda client, shard, number=number: shard_seed(
                cfg.seed, round_, client, shard, number))
        parts = []
        for g in range(groups):
            mine = F.pmod(F.xxhash64("client"), F.lit(groups)) == g
            parts.append(epoch(rows if groups == 1 else rows.filter(mine), state.filter(mine)))
        if not parts:
            break
        found = reduce(DataFrame.unionByName, parts)
        both = found.groupBy("client", "layer").cogroup(state.groupBy("client", "layer"))
        state = settle(both.applyInPandas(combine, _STATE), "epoch")
    return state.select("client", F.lit(0).alias("shard"), "n", "layer", "values", "losses")


def _names(ddl: str) -> list[str]:
    return [field.split()[0] for field in ddl.split(", ")]


def merge_shards(
    trained: DataFrame, round_: int = 1, weight_unit: str = "rows", batch_size: int | None = 512
) -> DataFrame:
    """Client models as parameter rows: the mean of the shards of a client, weighted by rows.

    The tensors are opened in the stage that trained them, so they are summed up map-side.
    """
    rows = trained.select("client", "n", "layer", F.posexplode("values").alias("pos", "value"))
    merged = rows.groupBy("client", "layer", "pos").agg(
        (F.sum(F.col("value") * F.col("n")) / F.sum("n")).alias("value"), F.sum("n").alias("n")
    )
    if weight_unit == "batches":
        weight = F.ceil(F.col("n") / batch_size).cast("long") if batch_size else F.lit(1).cast("long")
    elif weight_unit == "rows":
        weight = F.col("n")
    else:
        raise ValueError(f"unknown weight unit {weight_unit!r}")
    return merged.select(
        F.lit(round_).alias("round"), "client", "layer", "pos", "value", weight.alias("weight")
    )


def train_log(trained: DataFrame) -> DataFrame:
    """Mean training loss by client and epoch (from 0)."""
    rows = trained.filter("layer = 0").select(
        "client", "n", F.posexplode("losses").alias("epoch", "loss")
    )
    return rows.groupBy("client", "epoch").agg(
        (F.sum(F.col("loss") * F.col("n")) / F.sum("n")).alias("loss")
    )


def settings(base: TrainConfig, **axes) -> list[TrainConfig]:
    """Every combination of the values of ``axes``, the last axis fastest."""
    return [base.with_(**dict(zip(axes, values))) for values in product(*axes.values())]


def stratified_folds(rows: DataFrame, features: list[str], k: int) -> tuple[DataFrame, list[int]]:
    """Rows (key, label, features, part) in ``k`` folds, and the rows of each fold.

    The rows of a class (label above one half, or not, or missing) follow each other by a hash of the key; each fold
    takes the next stretch of them. Folds differ by one row at most, in all and in each class.
    """
    kind = F.col("label") > 0.5
    rows = rows.select("key", "label", *features)
    order = [kind.asc_nulls_first(), F.md5(F.concat(F.lit("fold:"), F.col("key").cast("string"))).asc_nulls_first()]
    order += [F.col(c).asc_nulls_first() for c in ("key", *features, "label")]
    counts = {r["kind"]: r["n"] for r in rows.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n")).collect()}
    sizes, ends, at = [0] * k, [], 0
    for found in (None, False, True):
        end, n = at, counts.get(found, 0)
        for f in range(k):
            share = (at + n - f + k - 1) // k - (at - f + k - 1) // k  # places from at to at + n that leave f
            sizes[f], end = sizes[f] + share, end + share
            ends.append(end)
        at += n
    passed = F.aggregate(
        F.array(*[F.lit(e).cast("long") for e in ends]), F.lit(0), lambda p, e: p + (F.col("_rank") > e).cast("int")
    )
    placed = sampling.ranked(rows, order, "_rank").withColumn("part", (passed % k).cast("int")).drop("_rank")
    return settle(placed, "folds"), sizes


def grid_search(
    rows: DataFrame, features: list[str], grid: list[TrainConfig], k: int = 5, tasks: int | None = None,
    stratified: bool = False,
) -> DataFrame:
    """k-fold score of every setting: rows (candidate, fold, score, n).

    Folds come from a hash of the key, or are ``stratified`` (:func:`stratified_folds`). ``rows`` (key, features, label; see :func:`to_shards`) are read by each of
    ``tasks``, stretch by stretch, for its share of the models (see ``allreduce``, also for large steps): those of
    all settings and folds are trained side by side, each on the rows outside its fold, and then score the rows
    inside it in one scan.
    A fold with no rows, or with all of them, has score NULL and n 0.
    """
    spark, total = rows.sparkSession, rows.count()
    if stratified:
        folds, inside = stratified_folds(rows, features, k)
        outside = [total - n for n in inside]
    else:
        digits = F.substring(F.md5(F.concat(F.lit("fold:"), F.col("key").cast("string"))), 1, 8)
        part = (F.conv(digits, 16, 10).cast("long") % k).cast("int")
        folds, outside = rows.select("key", "label", *features, part.alias("part")), [total * (k - 1) // k] * k
    runs = [(c, f) for c in range(len(grid)) for f in range(k)]
    models = {}
    for epochs, seed in sorted({(cfg.epochs, cfg.seed) for cfg in grid}):
        own = [(c, f) for c, f in runs if (grid[c].epochs, grid[c].seed) == (epochs, seed)]
        starts = {c: mlp.init(len(features), grid[c].hidden, seed) for c, _ in own}
        size = max(sum(t.size for t in s) for s in starts.values())
        at_once = max(1, MAX_PARAMETERS // (4 * size))
        for at in range(0, len(own), at_once):
            jobs = [allreduce.Job(
                f"{c}:{f}", f, True, max(1, outside[f]), grid[c].batch_size, begin(starts[c], None, grid[c]),
                partial(advance, cfg=grid[c]), partial(pull, cfg=grid[c]), starts[c], None,
                mlp.Optimizer(grid[c].optimizer, grid[c].lr, grid[c].momentum, grid[c].weight_decay),
                plain=grid[c].mu is None and grid[c].delta is None,
            ) for c, f in own[at: at + at_once]]
            allreduce.train(folds, features, jobs, epochs, str(seed), tasks)
            models |= {pair: job.params for pair, job in zip(own[at: at + at_once], jobs)}
    shared = spark.sparkContext.broadcast(models)

    def judge(batches):
        right: dict = {}
        for pdf in batches:
            x, y = pdf[features].to_numpy(dtype=float), pdf["label"].to_numpy(dtype=float) > 0.5
            part = pdf["part"].to_numpy()
            for (c, f), params in shared.value.items():
                inside = part == f
                if inside.any():
                    hits, n = right.get((c, f), (0, 0))
                    good = (mlp.logits(params, x[inside]) > 0) == y[inside]
                    right[c, f] = hits + int(good.sum()), n + int(inside.sum())
        yield pd.DataFrame([(c, f, *v) for (c, f), v in right.items()], columns=["candidate", "fold", "hits", "n"])

    counts = folds.mapInPandas(judge, "candidate int, fold int, hits long, n long")
    counts = counts.groupBy("candidate", "fold").agg(F.sum("hits").alias("hits"), F.sum("n").alias("n"))
    every = spark.createDataFrame(runs, "candidate int, fold int").join(counts, ["candidate", "fold"], "left")
    known = F.col("n") < total  # a fold of all rows leaves nothing to train on
    return every.select(
        "candidate", "fold", F.when(known, F.col("hits") / F.col("n")).alias("score"),
        F.coalesce(F.when(known, F.col("n")), F.lit(0)).alias("n"),
    )


def grid_summary(scores: DataFrame) -> DataFrame:
    """Mean and population deviation of the fold scores, and which setting is best."""
    summary = scores.groupBy("candidate").agg(
        F.avg("score").alias("mean_score"), F.stddev_pop("score").alias("std_score")
    )
    best = summary.agg(F.max_by("candidate", F.struct("mean_score", -F.col("candidate"))).alias("b"))
    return summary.withColumn("best", F.col("candidate") == best.scalar())


def refit_best(
    rows: DataFrame, features: list[str], grid: list[TrainConfig], summary: DataFrame, tasks: int | None = None
) -> DataFrame:
    """The best setting trained on all rows: rows (candidate, n, loss, model), the tensors of the model as lists.

    ``summary`` is that of :func:`grid_summary`; without a score there is no best setting and no row.
    """
    found = summary.filter("best AND mean_score IS NOT NULL").first()
    if found is None:
        return rows.sparkSession.createDataFrame([], "candidate int, n long, loss double, model array<array<double>>")
    cfg = grid[found["candidate"]].with_(tasks=tasks or rows.sparkSession.sparkContext.defaultParallelism)
    pooled = rows.withColumn("client", F.lit("all"))
    trained = client_update(pooled, features, mlp.init(len(features), cfg.hidden, cfg.seed), cfg)
    tensors = F.sort_array(F.collect_list(F.struct("layer", "values")))["values"]
    return trained.groupBy("n").agg(
        F.element_at(F.max("losses"), -1).alias("loss"), tensors.alias("model")
    ).select(F.lit(found["candidate"]).alias("candidate"), "n", "loss", "model")
