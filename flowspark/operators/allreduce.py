"""Mini-batch training of models over the rows of a whole table.

Which rows form a batch is a rule about the row alone. A hash of seed, epoch and key places each row on a
line of ``2^32`` points, and a model with ``n`` steps cuts that line in ``n`` equal stretches, so batches hold
``batch_size`` rows on average. Tasks read rows sorted by their place, once, and keep none, however many models with
different numbers of steps are trained side by side: gradients are summed up as rows come, ``CHUNK`` rows at a time.

Steps follow each other, so many tasks can work at once on one step or on several models only. There are two ways:

* *Exchange.* Every epoch is one barrier stage. Tasks hold shares of all rows; before each step they send the sums
  of their gradients to each other (``allGather``) and all take the same step. Spark polls once a second in that,
  so this is for steps of more work than that (``EXCHANGE_WORK``): full batches, and large ones of large models.
* *Chain.* The line is cut into stretches of about ``STRETCH_ROWS`` rows, which follow each other as jobs. A task
  takes a share of the models through one stretch and hands over the models and the sums of open batches. No task has
  more than a stretch, and a step costs no more than its gradient. Plain models whose batches have the same rows go to
  one task, which takes their steps together.

Both train a model as if one task held its rows: results differ by the order in which sums are added.

A model is trained on the rows of one part (a client) or on all rows but those of one part (a fold). What
tasks exchange is bounded by the models, which are limited by ``MAX_PARAMETERS`` together; messages are cut so that
those of a step fit into ``MESSAGE_BYTES``. A task that is lost repeats the epoch or stretch, which begins from what
the driver sent.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator, Sequence
from copy import copy
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark import BarrierTaskContext, TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from flowspark.operators import mlp
from flowspark.session import scratch_path, settle

POINTS = 1 << 32
MESSAGE_BYTES = 32 << 20
#: Rows per call of the gradient.
CHUNK = 4096
#: Rows of a stretch of a chain, on average.
STRETCH_ROWS = 2_000_000
#: Rows times parameters of a step that take a core about as long as an exchange, and as long as what any step costs.
EXCHANGE_WORK, STEP_WORK = 500_000_000, 250_000


@dataclass
class Job:
    """One model in training: the rows of ``part``, or all others if ``without`` is set."""

    name: str | None
    part: int
    without: bool
    rows: int
    batch_size: int | None
    params: list[np.ndarray]
    advance: Callable  # (optimizer, params, gradients, start, own) -> params; can be pickled, like the next
    penalty: Callable  # (params, start) -> part of the loss
    start: list[np.ndarray]
    own: list[np.ndarray] | None
    opt: mlp.Optimizer
    losses: list[float] = field(default_factory=list)
    open: np.ndarray | None = None  # sums of the batch that a stretch left open
    plain: bool = False  # advance is a step of the optimizer and there is no penalty

    @property
    def steps(self) -> int:
        return max(1, -(-self.rows // (self.batch_size or max(1, self.rows))))


def _copy(job: Job) -> Job:
    """For one attempt of a task: what was sent stays as it is (steps replace arrays, they write to none)."""
    return replace(job, opt=copy(job.opt))


def _groups(jobs: Sequence[Job]) -> list[list[int]]:
    """Jobs whose steps can be taken together: plain ones of the same rows, batches, shapes and kind of optimizer."""
    found: dict = {}
    for j, job in enumerate(jobs):
        shapes = tuple(t.shape for t in job.params)
        like = (job.part, job.without, job.steps, shapes, job.opt.kind, job.opt.step_no, job.open is None)
        found.setdefault(like if job.plain else j, []).append(j)
    return list(found.values())


def _shares(jobs: Sequence[Job], tasks: int) -> list[list[int]]:
    """Jobs of each of at most ``tasks`` tasks: groups stay whole, and the next goes where least work is."""
    def work(group: list[int]) -> int:
        job = jobs[group[0]]
        return job.steps * STEP_WORK + job.rows * len(group) * sum(t.size for t in job.params)

    groups = sorted(_groups(jobs), key=lambda g: (-work(g), g))
    shares, loads = [[] for _ in range(min(tasks, len(groups)))], [0] * min(tasks, len(groups))
    for group in groups:
        least = loads.index(min(loads))
        shares[least] += group
        loads[least] += work(group)
    return shares


def place(seed: str, epoch: int, key: Column) -> Column:
    """Point of a row on the line of batches: the first 32 bits of md5(seed:epoch:key)."""
    text = F.concat(F.lit(f"{seed}:{epoch}:"), F.coalesce(key.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def _bound(step: int, steps: int) -> int:
    """First point of a step."""
    return -(-step * POINTS // steps)


class _Rows:
    """The rows of a task, read once in the order of their points."""

    def __init__(self, batches: Iterator[pa.RecordBatch]):
        self._batches, self._left = batches, np.zeros((0, 3))

    def upto(self, end: int) -> Iterator[np.ndarray]:
        """Blocks of the rows before ``end`` that have not been read."""
        while True:
            cut = int(np.searchsorted(self._left[:, 0], end))
            if cut:
                yield self._left[:cut]
            self._left = self._left[cut:]
            if len(self._left):
                return
            batch = next(self._batches, None)
            if batch is None:
                return
            self._left = np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns], 1)


class _Sums:
    """What a task adds to the open batch of the models of a group: rows, loss and gradients of each.

    More than one model are held as one array, a row per model, and so are their moments.
    """

    def __init__(self, jobs: list[Job]):
        self.jobs, self._waiting, self._n = jobs, [], 0
        first = jobs[0]
        size = sum(t.size for t in first.params)
        self._total = np.zeros((len(jobs), 2 + size)) if first.open is None else np.stack([j.open for j in jobs])
        if len(jobs) > 1:
            rates = [np.array([[getattr(j.opt, c)] for j in jobs]) for c in ("lr", "momentum", "decay")]
            self._opt, self._flat = mlp.Optimizer(first.opt.kind, *rates), self._stacked(lambda j: j.params)
            self._opt.step_no = first.opt.step_no
            self._opt.m, self._opt.v = (
                None if getattr(first.opt, c) is None else [self._stacked(lambda j, c=c: getattr(j.opt, c))]
                for c in "mv")

    def _stacked(self, of: Callable) -> np.ndarray:
        return np.stack([np.concatenate([t.ravel() for t in of(job)]) for job in self.jobs])

    def _opened(self, flat: np.ndarray) -> list[np.ndarray]:
        """Tensors, with the leading axes of ``flat``."""
        out, at = [], 0
        for t in self.jobs[0].params:
            out.append(flat[..., at: at + t.size].reshape(*flat.shape[:-1], *t.shape))
            at += t.size
        return out

    def add(self, block: np.ndarray) -> None:
        mine = block[(block[:, 1] == self.jobs[0].part) != self.jobs[0].without]
        self._waiting.append(mine)
        self._n += len(mine)
        if self._n >= CHUNK:
            self._work()

    def _work(self) -> None:
        if self._n:
            rows = np.concatenate(self._waiting)
            x, y, n = rows[:, 3:], rows[:, 2], len(self.jobs)
            if n == 1:
                loss, grads, _ = mlp.gradients(self.jobs[0].params, x, y)
            else:
                loss, grads = mlp.stacked_gradients(self._opened(self._flat), x, y)
            self._total[:, 0] += self._n
            self._total[:, 1] += loss * self._n
            self._total[:, 2:] += np.concatenate([g.reshape(n, -1) for g in grads], axis=1) * self._n
        self._waiting, self._n = [], 0

    def take(self) -> np.ndarray:
        self._work()
        out, self._total = self._total.ravel(), np.zeros_like(self._total)
        return out

    def step(self, total: np.ndarray) -> np.ndarray:
        """Take the step; returns the sum of the losses of its rows for each model."""
        if len(self.jobs) == 1:
            return np.array([_step(self.jobs[0], total)])
        total = total.reshape(len(self.jobs), -1)
        if total[0, 0]:
            self._flat = self._opt.step([self._flat], [total[:, 2:] / total[:, :1]])[0]
        return total[:, 1]

    def close(self) -> None:
        """Models, moments and the sums of the open batch back to the jobs."""
        for job, total in zip(self.jobs, self.take().reshape(len(self.jobs), -1)):
            job.open = total
        if len(self.jobs) > 1:
            opt = self._opt
            for i, job in enumerate(self.jobs):
                job.opt.m, job.opt.v = (None if c is None else self._opened(c[0][i]) for c in (opt.m, opt.v))
                job.params, job.opt.step_no = self._opened(self._flat[i]), opt.step_no


def _gathered(context: BarrierTaskContext, own: np.ndarray, tasks: int) -> np.ndarray:
    """Sum over all tasks, in the order of the tasks."""
    if tasks == 1:
        return own
    size = max(1, MESSAGE_BYTES * 3 // 4 // 8 // tasks)
    out = np.zeros_like(own)
    for at in range(0, len(own), size):
        sent = base64.b64encode(own[at: at + size].tobytes()).decode()
        for text in context.allGather(sent):
            out[at: at + size] += np.frombuffer(base64.b64decode(text))
    return out


def _step(job: Job, total: np.ndarray) -> float:
    """Take the step; returns the sum of the losses of its rows."""
    n = total[0]
    if not n:
        return 0.0
    loss = total[1] + job.penalty(job.params, job.start) * n
    grads, at = [], 2
    for t in job.params:
        grads.append((total[at: at + t.size] / n).reshape(t.shape))
        at += t.size
    job.params = job.advance(job.opt, job.params, grads, job.start, job.own)
    return loss


def _events(jobs: Sequence[Job], first: int = 0, last: int = POINTS) -> list[tuple[int, list[int]]]:
    """(end point, jobs) of the batches that end after ``first``, up to ``last``, in the order in which they end."""
    ends: dict[int, list[int]] = {}
    for j, job in enumerate(jobs):
        for s in range(first * job.steps // POINTS, min(job.steps, last * job.steps // POINTS + 1)):
            if first < _bound(s + 1, job.steps) <= last:
                ends.setdefault(_bound(s + 1, job.steps), []).append(j)
    return sorted(ends.items())


_EPOCH = "job int, layer int, step long, loss double, value array<double>, m array<double>, v array<double>"


def _advanced(batches: Iterator[pa.RecordBatch], jobs: list[Job], first: int, last: int, total_of) -> list[float]:
    """Take ``jobs`` through the rows from point ``first`` up to ``last``; returns the sums of their losses.
    ``total_of`` makes the sums of a step from those of this task."""
    groups, losses, reader = _groups(jobs), np.zeros(len(jobs)), _Rows(batches)
    open_ = [_Sums([jobs[j] for j in group]) for group in groups]

    def read(end: int) -> None:
        for block in reader.upto(end):
            for sums in open_:
                sums.add(block)

    for end, ending in _events([jobs[group[0]] for group in groups], first, last):
        read(end)
        parts = [open_[g].take() for g in ending]
        total, at = total_of(np.concatenate(parts)), 0
        for g, part in zip(ending, parts):
            losses[groups[g]] += open_[g].step(total[at: at + len(part)])
            at += len(part)
    read(last)
    for sums in open_:
        sums.close()
    return losses.tolist()


def _trained(numbers: Sequence[int], jobs: list[Job], losses: list[float]) -> Iterator[pa.RecordBatch]:
    """What the driver needs of each job: a row per tensor, and one of the open sums as layer -1."""
    for j, job, loss in zip(numbers, jobs, losses):
        n, kind = len(job.params), pa.list_(pa.float64())
        flat = [pa.array([t.ravel() for t in part] if part else [None] * n, kind)
                for part in (job.params, job.opt.m, job.opt.v)]
        flat = [pa.concat_arrays([pa.array([end], kind), a]) for end, a in zip((job.open, None, None), flat)]
        n += 1
        yield pa.RecordBatch.from_arrays(
            [pa.array([j] * n, pa.int32()), pa.array(range(-1, n - 1), pa.int32()),
             pa.array([job.opt.step_no] * n, pa.int64()), pa.array([loss] * n, pa.float64()), *flat],
            ["job", "layer", "step", "loss", "value", "m", "v"])


def _epoch(rows: DataFrame, jobs: list[Job]) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(jobs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = BarrierTaskContext.get()
        tasks, own = len(context.getTaskInfos()), [_copy(job) for job in shared.value]
        losses = _advanced(batches, own, 0, POINTS, lambda part: _gathered(context, part, tasks))
        if context.partitionId() == 0:
            yield from _trained(range(len(own)), own, losses)

    return rows.mapInArrow(run, _EPOCH, barrier=True)


def _stretch(rows: DataFrame, jobs: list[Job], shares: list[list[int]], first: int, last: int) -> DataFrame:
    """The jobs after a stretch, of which each partition has all rows and trains its share of the jobs."""
    shared = rows.sparkSession.sparkContext.broadcast(jobs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = shares[TaskContext.get().partitionId()]
        own = [_copy(shared.value[j]) for j in numbers]
        yield from _trained(numbers, own, _advanced(batches, own, first, last, lambda part: part))

    return rows.mapInArrow(run, _EPOCH)


def _take(jobs: list[Job], done: DataFrame) -> list[float]:
    """Models, moments and open sums back into ``jobs``; the sums of the losses."""
    found: dict[int, list] = {}
    for r in done.collect():
        found.setdefault(r["job"], []).append(r)
    losses = []
    for j, job in enumerate(jobs):  # the models, as large as what was sent
        if j not in found:  # no rows, so no task
            losses.append(0.0)
            continue
        end, *own = sorted(found[j], key=lambda r: r["layer"])
        like = job.params
        job.params, job.opt.m, job.opt.v = (
            None if own[0][c] is None else [np.array(r[c]).reshape(t.shape) for r, t in zip(own, like)]
            for c in ("value", "m", "v"))
        job.opt.step_no, job.open = end["step"], np.array(end["value"])
        losses.append(end["loss"])
    return losses


def _chained(placed: DataFrame, jobs: list[Job], tasks: int) -> list[float]:
    """An epoch, stretch after stretch."""
    spark = placed.sparkSession
    known = {job.part: job.rows for job in jobs if not job.without}
    total = sum(known.values()) or 2 * max(job.rows for job in jobs)
    cuts, shares = max(1, -(-total // STRETCH_ROWS)), _shares(jobs, tasks)
    tasks = len(shares)
    stretch = F.floor(F.col("_place") * cuts / F.lit(float(POINTS))).cast("int")
    order = [c for c in placed.columns if c != "_place"]
    placed = placed.withColumn("_cut", stretch).repartition("_cut")
    path = scratch_path(spark, "stretches")
    placed.sortWithinPartitions("_cut", "_place", *order).write.partitionBy("_cut").parquet(path)
    placed = spark.read.schema(placed.schema).parquet(path)
    losses = [0.0] * len(jobs)
    for cut in range(cuts):
        mine = placed.filter(F.col("_cut") == cut).drop("_cut")
        if tasks > 1:
            mine = mine.withColumn("_task", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))))
            mine = mine.repartitionById(tasks, F.col("_task")).drop("_task")
        else:
            mine = mine.coalesce(1)
        mine = mine.sortWithinPartitions("_place", *order)
        after = _stretch(mine, jobs, shares, _bound(cut, cuts), _bound(cut + 1, cuts))
        losses = [a + b for a, b in zip(losses, _take(jobs, after))]
    return losses


def _exchanges(jobs: Sequence[Job]) -> bool:
    """Whether steps are worth an exchange each."""
    work = sum(job.rows * sum(t.size for t in job.params) for job in jobs)
    return work >= EXCHANGE_WORK * len(_events(jobs))


def train(
    rows: DataFrame, features: list[str], jobs: list[Job], epochs: int, seed: str, tasks: int | None = None
) -> list[Job]:
    """Train all ``jobs`` for ``epochs`` on ``rows`` (part int, key, label and features).

    At most ``tasks`` work at once; by default as many as the session has. In an exchange they hold shares of all
    rows, by key, and must find free slots; in a chain each takes its share of the models through the rows.
    """
    if not jobs:
        return jobs
    tasks = tasks or rows.sparkSession.sparkContext.defaultParallelism
    if tasks < 1:
        raise ValueError("at least one task is needed")
    exchange = tasks > 1 and _exchanges(jobs)
    for epoch in range(epochs):
        placed = rows.withColumn("_place", place(seed, epoch, F.col("key")))
        if exchange:
            placed = placed.repartition(tasks, F.xxhash64("key"))
            placed = placed.sortWithinPartitions("_place", "key", *features, "label")
        placed = placed.select("_place", "part", "label", *features)
        losses = _take(jobs, settle(_epoch(placed, jobs), "epoch")) if exchange else _chained(placed, jobs, tasks)
        for job, loss in zip(jobs, losses):
            job.losses.append(loss / max(1, job.rows))
            job.open = None
    return jobs
