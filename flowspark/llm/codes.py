"""Vector codes by product quantisation, assigned through slice-and-intersect bitmasks.

Vectors become integers and are cut into equal parts; every part has a codebook of at most 64 entries, and
a vector's code names the nearest entry of each part. To find it, each dimension of a codebook is sorted
once and keeps, for every rank, the 64-bit mask of the entries below it. A query starts from a radius that
is known to hold an entry (its distance to the entry next to it in one of the dimensions). In every
dimension the coordinates within the radius are a range of ranks; the exclusive-or of the masks at both
ends is the set of entries in that slice, and the AND over the dimensions leaves the entries in the box.
Whatever is nearer than the radius is in the box, so comparing the exact distances of those few entries is
an exact search. All arithmetic is in integers: results do not depend on batches, tasks or retries.

A round of training is one scan: tasks add up counts and sums per entry, the driver gets one small table
whose size is that of the codebooks. Codebooks start from the rows of the smallest ids.

Edge cases: rows whose vector is null, or holds null or non-finite components, take no part, nor do
vectors whose length is not a multiple of the number of parts or not the most common one (ties: the
smaller), nor components beyond ``2^26`` after scaling, whose squares would not fit. Equal distances go to
the smaller index. Null ids come last and equal ids are ordered by their vectors when the first entries
are chosen; repeated rows are coded each on its own. With fewer rows than entries the codebooks are
smaller. An empty table gives no rows. Further columns are carried along if named in ``keep``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowspark.llm import common
from flowspark.llm.registry import query, table

PARTS = 16
#: Entries of a codebook: one bit each in a 64-bit mask.
ENTRIES = 64
ROUNDS = 2
SCALE = 256
LARGEST = 1 << 26
_U = np.uint64


class Slices(NamedTuple):
    """A codebook with its sorted coordinates and, per dimension, the entries below every rank."""

    entries: np.ndarray    # entries x dimensions
    ordered: np.ndarray    # dimensions x entries: sorted coordinates
    ranked: np.ndarray     # dimensions x entries: entry at every rank
    below: np.ndarray      # dimensions x (entries + 1): mask of the entries of smaller rank


def sliced(entries: np.ndarray) -> Slices:
    ranked = np.argsort(entries.T, axis=1, kind="stable")
    below = np.zeros((entries.shape[1], len(entries) + 1), _U)
    below[:, 1:] = np.bitwise_or.accumulate(_U(1) << ranked.astype(_U), axis=1)
    return Slices(entries, np.take_along_axis(entries.T, ranked, 1), ranked, below)


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((a - b) ** 2).sum(1)


def candidates(book: Slices, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(mask of the entries in the box, squared radius) of every point."""
    radius = None
    for j in range(points.shape[1]):
        near = np.minimum(np.searchsorted(book.ordered[j], points[:, j]), len(book.entries) - 1)
        far = _distance(points, book.entries[book.ranked[j, near]])
        radius = far if radius is None else np.minimum(radius, far)
    reach = np.floor(np.sqrt(radius.astype(np.float64))).astype(np.int64) + 1  # one more than enough
    mask = np.full(len(points), ~_U(0))
    for j in range(points.shape[1]):
        lo = np.searchsorted(book.ordered[j], points[:, j] - reach, "left")
        hi = np.searchsorted(book.ordered[j], points[:, j] + reach, "right")
        mask &= book.below[j, hi] ^ book.below[j, lo]
    return mask, radius


def nearest_entry(book: Slices, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of the nearest entry of every point; ties to the smaller index."""
    mask, _ = candidates(book, points)
    best = np.full(len(points), -1)
    least = np.full(len(points), np.iinfo(np.int64).max)
    open_ = np.flatnonzero(mask)
    while len(open_):
        own = mask[open_]
        bit = own & (~own + _U(1))
        entry = np.bitwise_count(bit - _U(1)).astype(np.int64)
        far = _distance(points[open_], book.entries[entry])
        nearer = far < least[open_]  # entries come in ascending order
        best[open_[nearer]], least[open_[nearer]] = entry[nearer], far[nearer]
        mask[open_] = own ^ bit
        open_ = open_[mask[open_] != 0]
    return best, least


def _whole(column: pa.Array) -> np.ndarray:
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(n, -1) if n else np.zeros((0, 0), np.int64)


def integers(vectors: DataFrame, vector: str, key: str, parts: int, scale: int,
             keep: Sequence[str] = ()) -> DataFrame:
    """``_id``, ``_v`` (array of integers) and the columns to keep as ``_c0, _c1, ...`` of the rows that take part."""
    rows = vectors.select(F.col(key).alias("_id"), F.col(vector).cast("array<double>").alias("_v"),
                          *[F.col(c).alias(f"_c{i}") for i, c in enumerate(keep)])
    finite = F.forall("_v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x * scale) <= LARGEST))
    rows = rows.where(F.col("_v").isNotNull() & finite & (F.size("_v") > 0) & (F.size("_v") % parts == 0))
    rows = common.settle(rows.withColumn("_v", F.transform("_v", lambda x: F.floor(x * scale).cast("int"))), "vectors")
    most = rows.groupBy(F.size("_v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.where(F.size("_v") == (most["d"] if most else 0))


def _assigned(books: Sequence[Slices], points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance), rows x parts."""
    cut = np.split(points, len(books), axis=1)
    both = [nearest_entry(b, p) for b, p in zip(books, cut)]
    return np.stack([b[0] for b in both], 1), np.stack([b[1] for b in both], 1)


def _round(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """Codebooks (parts x entries x width) after one more round."""
    parts, entries, width = books.shape
    shared = rows.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices = [sliced(b) for b in shared.value]
        count = np.zeros((parts, entries), np.int64)
        total = np.zeros((parts, entries, width), np.int64)
        for batch in batches:
            points = _whole(batch.column(0))
            if not len(points):
                continue
            entry, _ = _assigned(slices, points)
            for p, own in enumerate(np.split(points, parts, axis=1)):
                count[p] += np.bincount(entry[:, p], minlength=entries)
                np.add.at(total[p], entry[:, p], own)
        part, used = np.nonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(part, pa.int32()), pa.array(used, pa.int32()), pa.array(count[part, used]),
             pa.array(list(total[part, used]), pa.list_(pa.int64()))], ["part", "entry", "n", "total"])

    sums = rows.select("_v").mapInArrow(run, "part int, entry int, n long, total array<long>")
    sums = (sums.select("part", "entry", "n", F.posexplode("total").alias("at", "x"))
            .groupBy("part", "entry", "at").agg(F.sum("x").alias("x"), F.sum("n").alias("n")))
    out = books.copy()
    for r in sums.collect():  # as many rows as the codebooks have numbers
        out[r["part"], r["entry"], r["at"]] = r["x"] // r["n"]
    return out


def train(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks, parts x entries x width, of the rows of ``integers``."""
    if not 0 < entries <= 64:
        raise ValueError("a codebook has 1 to 64 entries, one per bit of a mask")
    first = rows.orderBy(F.col("_id").asc_nulls_last(), "_v").select("_v").limit(entries).collect()
    if not first:
        return np.zeros((parts, 0, 0), np.int64)
    books = np.array([r["_v"] for r in first], np.int64)
    books = books.reshape(len(first), parts, -1).transpose(1, 0, 2)
    for _ in range(rounds):
        books = _round(rows, books)
    return books


def encoded(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """``rows`` with ``code`` (two hex digits per part) and ``error`` in place of ``_v``; a written table."""
    rest = [f for f in rows.schema.fields if f.name != "_v"]
    schema = T.StructType([*rest, T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    if not books.shape[1]:
        return rows.sparkSession.createDataFrame([], schema)
    shared = rows.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices = [sliced(b) for b in shared.value]
        for batch in batches:
            points = _whole(batch.column(0))
            code, error = [], np.zeros(0, np.int64)
            if len(points):
                entry, far = _assigned(slices, points)
                text = entry.astype(np.uint8).tobytes().hex()
                size = 2 * entry.shape[1]
                code = [text[i: i + size] for i in range(0, len(text), size)]
                error = far.sum(1)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array(code, pa.string()), pa.array(error, pa.int64())],
                [*batch.schema.names[1:], "code", "error"])

    return common.settle(rows.select("_v", *[f.name for f in rest]).mapInArrow(run, schema), "codes")


def compress(vectors: DataFrame, vector: str = "embedding", key: str = "vec_id", parts: int = PARTS,
             entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
             keep: Sequence[str] = ()) -> tuple[DataFrame, np.ndarray]:
    """(``key``, the columns to ``keep``, ``code`` and ``error`` of every row that takes part; codebooks)."""
    clash = set(keep) & {key, "code", "error"}
    if clash:
        raise ValueError(f"columns named like the result: {sorted(clash)}")
    rows = integers(vectors, vector, key, parts, scale, keep)
    books = train(rows, parts, entries, rounds)
    out = encoded(rows, books)
    return out.select(F.col("_id").alias(key), *[F.col(f"_c{i}").alias(c) for i, c in enumerate(keep)],
                      "code", "error"), books


def decoded(codes: DataFrame, books: np.ndarray, scale: int = SCALE, code: str = "code",
            into: str = "vector") -> DataFrame:
    """``codes`` with the vector that each code stands for; null codes give null vectors."""
    parts, _, width = books.shape
    flat = books.reshape(-1)
    shared = codes.sparkSession.sparkContext.broadcast(flat / scale)
    rest = [c for c in codes.columns if c != into]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = books.shape[1] * width
        for batch in batches:
            made = []
            for c in batch.column(0).to_pylist():
                entry = None if c is None else np.frombuffer(bytes.fromhex(c), np.uint8).astype(int)
                made.append(None if c is None else np.concatenate(
                    [shared.value[p * size + e * width: p * size + (e + 1) * width] for p, e in enumerate(entry)]))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array(made, pa.list_(pa.float64()))], [*batch.schema.names[1:], "_made"])

    inner = codes.select(F.col(code).alias("_code"), *[F.col(c).alias(f"_c{i}") for i, c in enumerate(rest)])
    schema = T.StructType([*inner.schema.fields[1:], T.StructField("_made", T.ArrayType(T.DoubleType()))])
    return inner.mapInArrow(run, schema).select(
        *[F.col(f"_c{i}").alias(c) for i, c in enumerate(rest)], F.col("_made").alias(into))


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components as decimal numbers, by part, entry and position, comma-joined."""
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def with_group_error(codes: DataFrame, group: str) -> DataFrame:
    """``codes`` with ``<group>_error``: the error summed over the rows of the same group, nulls together.

    Sums are made map-side; they come back by a join whose one side has a row per group, so that a group
    of a third of all rows is neither gathered nor, where the join shuffles, left in one partition.
    """
    sums = common.settle(codes.groupBy(F.col(group).alias("_g")).agg(F.sum("error").alias("_sum")), "group_errors")
    return codes.join(sums, F.col(group).eqNullSafe(F.col("_g")), "left").select(
        *codes.columns, F.col("_sum").alias(f"{group}_error"))


def _oracle() -> str:
    def assign(book: str) -> str:
        return f"""(SELECT vec_id, label, p, arg_min(e, d * 64 + e) AS e, min(d) AS d FROM (
          SELECT k.vec_id, k.label, p, c.e, list_sum(list_transform(list_zip(part, c.v),
              lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
          FROM k JOIN {book} c USING (p)) GROUP BY vec_id, label, p)"""

    def moved(n: int) -> str:
        return f"""a{n} AS MATERIALIZED {assign(f'b{n}')},
m{n} AS (SELECT p, e, list(x ORDER BY i) AS v FROM (
       SELECT a.p, e, i, floor(sum(part[i]) / count(*))::BIGINT AS x
       FROM a{n} a JOIN k USING (vec_id, p), range(1, len(part) + 1) r(i) GROUP BY a.p, e, i) GROUP BY p, e),
b{n + 1} AS MATERIALIZED (SELECT p, e, coalesce(m{n}.v, b{n}.v) AS v FROM b{n} LEFT JOIN m{n} USING (p, e))"""

    return f"""
WITH kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
k AS MATERIALIZED (SELECT vec_id, label, p, v[p * len(v) // {PARTS} + 1: (p + 1) * len(v) // {PARTS}] AS part
  FROM kept, range({PARTS}) r(p)),
b0 AS MATERIALIZED (SELECT p, e, part AS v FROM k JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e
  FROM kept) USING (vec_id) WHERE e < {ENTRIES}),
{", ".join(moved(n) for n in range(ROUNDS))},
last AS MATERIALIZED {assign(f'b{ROUNDS}')},
r AS (SELECT vec_id, label, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error
      FROM last GROUP BY vec_id, label)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) FROM b{ROUNDS}) AS codebooks_sha256
FROM r"""


@query("op11_vector_codes", _oracle())
def vector_codes(spark, sf_dir: str) -> DataFrame:
    codes, books = compress(table(spark, sf_dir, "embeddings"), keep=["label"])
    return with_group_error(codes, "label").select(
        "vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
