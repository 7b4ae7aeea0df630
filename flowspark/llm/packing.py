"""Packing of token pieces into sequences of fixed capacity by large-item matching.

Only documents longer than the capacity are cut; all their pieces but the first are full. Pieces above a
third of the capacity are large: at most two fit a sequence, so they are matched in pairs, each large
piece, longest first, with the longest partner that still fits beside it. Smaller pieces then go, longest
first, to the sequence whose gap they fill best; a new sequence is opened when no gap is large enough.

The plan depends only on how many pieces there are of each length. Spark counts them (one number per
length, ``capacity`` numbers in all), the driver computes the plan for whole classes of equal sequences,
and Spark gives each piece its place by its rank among the pieces of its length. Ranks are local to a
task plus the counts of the tasks before it, so a length that a third of all pieces have is not
gathered anywhere. The plan that tasks receive has a few entries per length, whatever the table size.

Edge cases: a null or empty text is the end token alone; repeated rows are packed each on its own; an
empty table packs nothing. A row with a null id is packed like any other; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from flowspark.llm import common, tokens
from flowspark.llm.registry import query, table

CAPACITY = 2048
END_TOKEN = 0
_PIECES = ("doc_id long, piece int, start long, length int, ids_crc32 long, task int, rank long, "
           "ids binary")


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int | None = END_TOKEN,
                 text: str = "text", key: str = "doc_id", keep_ids: bool = True) -> DataFrame:
    """Pieces of every whole text: ``doc_id, piece, start, length, ids_crc32, task, rank, ids``.

    ``rank`` counts the pieces of one length within the task that made them; ``ids`` are
    little-endian 32-bit numbers (null without ``keep_ids``). The result is written and read back.
    """
    tail = np.array([] if end is None else [end], np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for lo, hi, ids, first in tokens.encoded(batch.column(1), path):
                out: list[list] = [[], [], [], [], [], [], []]
                for d in range(hi - lo):
                    own = np.concatenate([ids[first[d]: first[d + 1]], tail]).astype("<u4")
                    head = (len(own) - 1) % capacity + 1 if len(own) else 0
                    cuts = [0, *range(head, len(own) + 1, capacity)] if len(own) else []
                    for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
                        raw = own[a:b].tobytes()
                        row = (lo + d, i, a, b - a, zlib.crc32(raw), int(seen[b - a]),
                               raw if keep_ids else None)
                        seen[b - a] += 1
                        for column, value in zip(out, row):
                            column.append(value)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(out[0], pa.int64())), pa.array(out[1], pa.int32()),
                     pa.array(out[2], pa.int64()), pa.array(out[3], pa.int32()),
                     pa.array(out[4], pa.int64()), pa.array([task] * len(out[0]), pa.int32()),
                     pa.array(out[5], pa.int64()), pa.array(out[6], pa.binary())],
                    ["doc_id", "piece", "start", "length", "ids_crc32", "task", "rank", "ids"])

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return common.settle(rows.mapInArrow(run, _PIECES), "pieces")


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Where the pieces of each length go: (length, first rank, pieces, first sequence, pieces per
    sequence, offset); ranks are consecutive within a length."""
    left = {n: c for n, c in counts.items() if c > 0}
    used: dict[int, int] = {}
    out: list[tuple[int, int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}   # gap -> [(first sequence, sequences)]
    order: list[int] = []                         # gaps in use, ascending
    opened = 0

    def put(n: int, pieces: int, sequence: int, each: int, offset: int) -> None:
        out.append((n, used.get(n, 0), pieces, sequence, each, offset))
        used[n] = used.get(n, 0) + pieces

    def free(gap: int, sequence: int, count: int) -> None:
        if gap and count:
            if gap not in gaps:
                gaps[gap] = []
                insort(order, gap)
            gaps[gap].append((sequence, count))

    large = sorted((n for n in left if 3 * n > capacity), reverse=True)
    partners = sorted(large)
    for n in large:
        while left.get(n):
            at = bisect_left(partners, capacity - n + 1) - 1
            while at >= 0 and not left.get(partners[at]):
                partners.pop(at)
                at -= 1
            other = partners[at] if at >= 0 else None
            if other == n and left[n] == 1:  # no second one of its own length
                at -= 1
                while at >= 0 and not left.get(partners[at]):
                    partners.pop(at)
                    at -= 1
                other = partners[at] if at >= 0 else None
            pairs = left[n] if other is None else left[n] // 2 if other == n else min(left[n], left[other])
            put(n, pairs, opened, 1, 0)
            left[n] -= pairs
            if other is not None:
                put(other, pairs, opened, 1, n)
                left[other] -= pairs
            free(capacity - n - (other or 0), opened, pairs)
            opened += pairs

    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[n]:
            at = bisect_left(order, n)
            if at == len(order):
                count = -(-left[n] // (capacity // n))
                free(capacity, opened, count)
                opened += count
                continue
            gap = order[at]
            sequence, count = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap]
                order.pop(at)
            each = gap // n
            full = min(count, left[n] // each)
            if full:
                put(n, full * each, sequence, each, capacity - gap)
                left[n] -= full * each
                free(gap - each * n, sequence, full)
                free(gap, sequence + full, count - full)
            else:  # fewer than one sequence could take
                put(n, left[n], sequence, left[n], capacity - gap)
                free(gap - left[n] * n, sequence, 1)
                free(gap, sequence + 1, count - 1)
                left[n] = 0
    return out


def _place(entries: list[tuple[int, int, int, int, int, int]]):
    """Looks up (length, rank) in the plan: ``sequence_id`` and ``offset``."""
    table_ = np.array(sorted(entries), np.int64).reshape(-1, 6)
    bound = np.searchsorted(table_[:, 0], np.arange(table_[:, 0].max(initial=0) + 2))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy().astype(np.int64)
            rank = batch.column("rank").to_numpy()
            at = np.zeros(len(rank), np.int64)
            for n in np.unique(length):
                own = np.flatnonzero(length == n)
                first = table_[bound[n]: bound[n + 1], 1]
                at[own] = bound[n] + np.searchsorted(first, rank[own], "right") - 1
            _, first, _, sequence, each, offset = table_[at].T
            within = rank - first
            names = [c for c in batch.schema.names if c != "rank"]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in names]
                + [pa.array(sequence + within // each), pa.array(offset + within % each * length)],
                [*names, "sequence_id", "offset"])
    return run


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (a written table of ``token_pieces``) with ``sequence_id`` and ``offset``."""
    by_task = pieces.groupBy("task", "length").agg(F.count("*").alias("n"))
    before = W.partitionBy("length").orderBy("task").rowsBetween(W.unboundedPreceding, -1)
    by_task = common.settle(by_task.withColumn(
        "before", F.coalesce(F.sum("n").over(before), F.lit(0))), "ranks")
    counts = by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()  # one row per length
    entries = plan({r["length"]: r["n"] for r in counts}, capacity)
    rows = pieces.join(by_task.select("task", "length", "before"), ["task", "length"])
    rows = rows.withColumn("rank", F.col("rank") + F.col("before")).drop("task", "before")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "rank")
    return rows.mapInArrow(_place(entries), schema + ", sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, length, ids, pieces) of every sequence: its ids as little-endian 32-bit numbers.

    A sequence has a bounded number of pieces, so gathering one is gathering ``capacity`` ids.
    """
    part = F.struct("offset", "doc_id", "piece", "length", "ids")
    rows = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(part)).alias("p"))
    joined = F.aggregate("p", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"]))
    return rows.select("sequence_id", F.aggregate("p", F.lit(0), lambda a, x: a + x["length"]).alias("length"),
                       joined.alias("ids"),
                       F.transform("p", lambda x: F.struct(x["doc_id"].alias("doc_id"),
                                                           x["piece"].alias("piece"),
                                                           x["offset"].alias("offset"))).alias("pieces"))


def placed(docs: DataFrame) -> DataFrame:
    """Placement of all pieces of ``docs``, with check sums in place of the ids."""
    pieces = token_pieces(docs, tokens.vocabulary(), keep_ids=False).drop("ids")
    return pack(pieces).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query("op8_packing")
def packing(spark, sf_dir: str) -> DataFrame:
    return placed(table(spark, sf_dir, "documents"))
