"""Approximate nearest neighbours by a forest of random-projection trees.

Each tree halves the space again and again at the median of a random projection. The trees are fitted on
a bounded sample (``SAMPLE_ROWS`` rows by hash of the id); every row is then put into its leaf of every
tree. A query descends all trees through one priority queue: the branch whose boundaries it is least far
beyond comes next, whichever tree it is in, until the leaves reached hold ``share`` of the table, or
``budget`` rows if that is given, counted over all trees. Leaves are searched where their rows are: a task gets a block of a leaf and the queries that
reached it, and returns the best of each query by exact distance on the original vectors.

A leaf with very many rows (equal vectors all share their leaves) is searched in blocks of
``BLOCK_ROWS``, and so are the queries of a leaf, so no group grows with the table. The forest that tasks
receive has ``trees * 2^depth`` nodes; depth grows with the logarithm of the table, as far as the sample
supports it.

Recall depends on the data: vectors without structure in 64 dimensions need a large share. ``SHARE`` is
set for a recall above 0.9 on such vectors; lower it for vectors that cluster.

Edge cases: null vectors, zero vectors, vectors with null or non-finite components, and vectors whose
length is not the most common one take no part. Ties go to the smaller id. Rows are told apart by a number of
their own: rows that share an id, equal ones too, are candidates each, and queries each; a query's own id is never
among its neighbours. Extra columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from flowspark.llm import common
from flowspark.llm.registry import query, table

TREES = 8
SAMPLE_ROWS = 16_384
LEAF_ROWS = 2048
#: Levels of a tree of a small table, as far as its rows support them.
LEAST_DEPTH = 3
SHARE = 1.3
BLOCK_ROWS = 4096
BLOCK_QUERIES = 2048


class Forest(NamedTuple):
    """Node i of a tree has the children 2i + 1 and 2i + 2; the leaves follow the inner nodes."""

    normals: np.ndarray      # trees x inner nodes x dimensions
    cuts: np.ndarray         # trees x inner nodes
    depth: int


def usable(vectors: DataFrame, vector: str, key: str) -> DataFrame:
    """(row, id, v) of the rows that take part; a written table, in which ``row`` is fixed."""
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = rows.where(F.col("id").isNotNull() & F.col("v").isNotNull() & finite
                      & F.exists("v", lambda x: x != 0))
    rows = common.settle(rows.select(F.monotonically_increasing_id().alias("row"), "id", "v"), "usable")
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.where(F.size("v") == (sizes["d"] if sizes else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(n, -1) if n else np.zeros((0, 0))


def fit(sample: np.ndarray, rows: int, trees: int = TREES, seed: int = 7) -> Forest:
    """Trees over a sample (not empty) of a table of ``rows`` rows."""
    most = max(0, int(math.log2(max(1, len(sample) // 16))))
    depth = min(most, max(LEAST_DEPTH, math.ceil(math.log2(max(1, rows / LEAF_ROWS)))))
    inner = (1 << depth) - 1
    rng = np.random.default_rng(seed)
    normals = rng.standard_normal((trees, inner, sample.shape[1]))
    normals /= np.linalg.norm(normals, axis=2, keepdims=True)
    cuts = np.zeros((trees, inner))
    for t in range(trees):
        node = np.zeros(len(sample), np.int64)
        for level in range(depth):
            height = np.einsum("ij,ij->i", sample, normals[t, node])
            for i in range((1 << level) - 1, (2 << level) - 1):
                own = height[node == i]
                cuts[t, i] = np.median(own) if len(own) else 0.0
            node = 2 * node + 1 + (height > cuts[t, node])
    return Forest(normals, cuts, depth)


def leaves(forest: Forest, points: np.ndarray) -> np.ndarray:
    """Leaf of every point in every tree."""
    out = np.zeros((len(forest.cuts), len(points)), np.int64)
    for t in range(len(forest.cuts)):
        node = out[t]
        for _ in range(forest.depth):
            height = np.einsum("ij,ij->i", points, forest.normals[t, node])
            node = 2 * node + 1 + (height > forest.cuts[t, node])
        out[t] = node - ((1 << forest.depth) - 1)
    return out


def reach(forest: Forest, counts: np.ndarray, point: np.ndarray, enough: float) -> list[tuple[int, int]]:
    """Leaves (tree, leaf) by the shared queue until they hold ``enough`` rows."""
    inner = (1 << forest.depth) - 1
    height = forest.normals @ point - forest.cuts
    queue = [(0.0, t, 0) for t in range(len(forest.cuts))]
    found, held = [], 0
    while queue and held < enough:
        beyond, t, node = heapq.heappop(queue)
        while node < inner:
            side = height[t, node] > 0
            heapq.heappush(queue, (max(beyond, abs(height[t, node])), t, 2 * node + 1 + (not side)))
            node = 2 * node + 1 + side
        if counts[t, node - inner]:
            found.append((t, node - inner))
            held += counts[t, node - inner]
    return found


_FOUND = "query long, row long, query_id long, vec_id long, score double"


def _search(k: int):
    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        out = [[np.zeros(0, np.int64)] for _ in range(4)] + [[np.zeros(0)]]
        if len(rows) and len(queries):
            points = _matrix(rows["v"].combine_chunks())
            ids, numbers = rows["id"].to_numpy(), rows["row"].to_numpy()
            square = np.einsum("ij,ij->i", points, points)
            wanted = _matrix(queries["v"].combine_chunks())
            for number, q, point in zip(queries["row"].to_numpy(), queries["id"].to_numpy(), wanted):
                rough = square - 2 * (points @ point)
                rough[ids == q] = np.inf
                at = np.arange(len(ids))
                if len(ids) > k:
                    limit = np.partition(rough, k - 1)[k - 1]
                    at = np.flatnonzero(rough <= limit + 1e-9 * (1 + abs(limit) + point @ point))
                at = at[ids[at] != q]
                score = np.sqrt(((points[at] - point) ** 2).sum(1))
                best = np.lexsort((numbers[at], ids[at], score))[:k]
                near = at[best]
                for column, values in zip(out, (np.full(len(near), number), numbers[near], np.full(len(near), q),
                                                ids[near], score[best])):
                    column.append(values)
        return pa.table([pa.array(np.concatenate(c)) for c in out], names=["query", "row", "query_id", "vec_id", "score"])
    return run


def nearest(vectors: DataFrame, queries, k: int = 10, vector: str = "embedding", key: str = "vec_id",
            trees: int = TREES, share: float = SHARE, budget: int | None = None) -> DataFrame:
    """``query_id, rank, vec_id, score`` (Euclidean distance) of the ``k`` nearest rows found for every
    row of ``vectors`` that meets the condition ``queries`` (a column over ``id``).

    With a ``budget`` of rows per query the work grows with the queries, not with queries times rows; what it
    does to the recall is for the caller to measure.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, vector, key)
    total = rows.count()
    below = float(SAMPLE_ROWS << 31) / max(1, total)
    drawn = F.xxhash64("id", "row").bitwiseAND((1 << 31) - 1)
    sample = rows.where(drawn < below).select("v").toArrow()["v"]
    if total and not len(sample):  # a table of a few rows
        sample = rows.select("v").limit(SAMPLE_ROWS).toArrow()["v"]
    if not len(sample):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    forest = fit(_matrix(sample.combine_chunks()), total, trees)
    shared = spark.sparkContext.broadcast(forest)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = leaves(shared.value, _matrix(batch.column(1)))
            for t in range(len(own)):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(batch), t), pa.int32()), pa.array(own[t], pa.int32()),
                     batch.column(0)], ["tree", "leaf", "row"])

    index = common.settle(rows.select("row", "v").mapInArrow(place, "tree int, leaf int, row long"), "forest")
    sizes = index.groupBy("tree", "leaf").agg(F.count("*").alias("n"))
    counts = np.zeros((trees, 1 << forest.depth), np.int64)
    for r in sizes.collect():  # one entry per leaf, bounded by the sample
        counts[r["tree"], r["leaf"]] = r["n"]
    reached = spark.sparkContext.broadcast(counts)
    enough = share * total if budget is None else budget

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, q, point in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(),
                                        _matrix(batch.column(2))):
                own = np.array(reach(shared.value, reached.value, point, enough), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number] * len(own), pa.int64()), pa.array([q] * len(own), pa.int64()),
                     pa.array(own[:, 0], pa.int32()), pa.array(own[:, 1], pa.int32()),
                     pa.array([point] * len(own), pa.list_(pa.float64()))], ["row", "id", "tree", "leaf", "v"])

    asked = rows.where(queries).repartition("row")
    probes = common.settle(asked.mapInArrow(probe, "row long, id long, tree int, leaf int, v array<double>"), "probes")
    need = probes.groupBy("tree", "leaf").agg(F.ceil(F.count("*") / BLOCK_QUERIES).cast("int").alias("parts"))
    blocks = need.join(sizes, ["tree", "leaf"]).select(
        "tree", "leaf", "parts", F.ceil(F.col("n") / BLOCK_ROWS).cast("int").alias("blocks"))

    def part(of: str) -> F.Column:
        return F.pmod(F.xxhash64("row"), F.col(of)).cast("int")

    def every(of: str) -> F.Column:
        return F.explode(F.sequence(F.lit(0), F.col(of) - 1))

    columns = ["tree", "leaf", "row", "id", "v"]
    placed = index.join(rows, "row").join(blocks, ["tree", "leaf"])
    placed = placed.select(*columns, part("blocks").alias("block"), every("parts").alias("part"))
    probes = probes.join(blocks, ["tree", "leaf"])
    probes = probes.select(*columns, every("blocks").alias("block"), part("parts").alias("part"))
    where = ["tree", "leaf", "block", "part"]
    found = placed.groupBy(*where).cogroup(probes.groupBy(*where)).applyInArrow(_search(k), _FOUND)
    found = found.distinct()  # a row is met once in every tree
    order = W.partitionBy("query").orderBy("score", "vec_id", "row")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


@query("op3_nearest")
def op3(spark, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)
