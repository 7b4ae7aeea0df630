"""Shared pieces of the training-data operators: written intermediate tables and word arrays.

Words are found on the UTF-8 bytes of an Arrow column, so a batch is a handful of numpy passes; no
Python object is made per word. A batch is worked through in slices of about ``SLICE`` bytes, which
bounds the memory of a task; a longer document is a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowspark.session import scratch_path

SLICE = 1 << 18

_U = np.uint64


def settle(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` below the shared scratch folder and read it back.

    Cuts the lineage: what an executor held is on shared storage, and a retried task sees the same
    rows. Needed wherever a column was numbered by task (``row_key``).
    """
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (splitmix64)."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def noise(n: int, seed: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit numbers."""
    return mix((np.arange(1, n + 1, dtype=_U) + _U(seed << 32)) * _U(0x9E3779B97F4A7C15))


_BASE = 0xD6E8FEB86659FD93


@lru_cache(maxsize=1)
def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    def powers(b: int) -> np.ndarray:
        out = np.full(n, b, _U)
        out[0] = 1
        return np.cumprod(out, dtype=_U)

    return powers(_BASE), powers(pow(_BASE, -1, 1 << 64))


def power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2^64 and of its inverse, at least ``n`` of each."""
    return _power_tables(1 << max(SLICE, n).bit_length())


def span_hash(weights: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit polynomial hash of ``weights[start:end]`` for every span, independent of its place."""
    up, down = power_tables(len(weights))
    total = np.zeros(len(weights) + 1, _U)
    np.cumsum(weights * up[: len(weights)], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(_U))


def byte_class(*excluded: tuple[int, int]) -> np.ndarray:
    """Table of bytes that belong to words: all but the ranges given (both ends included)."""
    table = np.ones(256, bool)
    for lo, hi in excluded:
        table[lo: hi + 1] = False
    return table


#: Words of letters and digits: every byte above ASCII counts as a letter.
ALNUM = byte_class((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
#: Words between white space.
NON_SPACE = byte_class((0x20, 0x20), (0x09, 0x0D))

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_NOISE = noise(256, 1)


class Words(NamedTuple):
    """Words of the documents ``lo .. hi-1`` of a batch, in order."""

    lo: int
    hi: int
    data: np.ndarray    # bytes of these documents
    start: np.ndarray   # of each word in data
    end: np.ndarray
    first: np.ndarray   # number of the first word of each document; one more entry at the end
    key: np.ndarray     # 64-bit hash of each word

    def docs(self) -> np.ndarray:
        """Document of each word, counted from ``lo``."""
        return np.repeat(np.arange(self.hi - self.lo), np.diff(self.first))

    def text(self, i: int) -> str:
        return self.data[self.start[i]: self.end[i]].tobytes().decode("utf-8")


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a text column; null counts as empty."""
    if pa.types.is_null(column.type):
        column = pa.array([""] * len(column))
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    if len(column) == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(offsets, np.int64)[column.offset: column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8), offsets


def slices(sizes_upto: np.ndarray, limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Consecutive runs (lo, hi) of rows with at most ``limit`` in total, or one row."""
    lo, n = 0, len(sizes_upto) - 1
    while lo < n:
        hi = int(np.searchsorted(sizes_upto, sizes_upto[lo] + limit, "right")) - 1
        hi = min(n, max(lo + 1, hi))
        yield lo, hi
        lo = hi


def words(column: pa.Array, members: np.ndarray, lower: bool) -> Iterator[Words]:
    """Words of every text: maximal runs of member bytes, A-Z lower-cased if asked for."""
    data, offsets = utf8(column)
    for lo, hi in slices(offsets):
        part = data[offsets[lo]: offsets[hi]]
        if lower:
            part = _LOWER[part]
        bounds = offsets[lo: hi + 1] - offsets[lo]
        inside = np.zeros(len(part) + 2, np.int8)
        inside[1:-1] = members[part]
        step = np.diff(inside)
        start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        cut = np.unique(bounds[(bounds > 0) & (bounds < len(part))])
        cut = cut[(inside[cut + 1] == 1) & (inside[cut] == 1)]
        if len(cut):  # two documents that touch without a separator
            start = np.sort(np.concatenate([start, cut]))
            end = np.sort(np.concatenate([end, cut]))
        first = np.searchsorted(start, bounds)
        yield Words(lo, hi, part, start, end, first, span_hash(_BYTE_NOISE[part], start, end))


def ngram_keys(key: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Hash of ``n`` consecutive word keys, for every start at which ``n`` follow."""
    m = len(key) - n + 1
    if m <= 0:
        return np.zeros(0, _U)
    out = np.full(m, seed, _U)
    for j in range(n):
        out *= _U(_BASE)
        out += key[j: j + m]
    return mix(out)


def whole_windows(first: np.ndarray, n: int) -> np.ndarray:
    """For each of the ``total - n + 1`` window starts: does the window lie in one document?"""
    total = int(first[-1])
    m = max(0, total - n + 1)
    ends = np.repeat(first[1:], np.diff(first))[:m]
    return np.arange(m) + n <= ends


def pack_u64(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values, "<u8").tobytes()


def has_row(df: DataFrame) -> bool:
    return bool(df.take(1))


def with_document_key(docs: DataFrame, name: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` with a key per document in column ``name``: rows that agree in id and text are one document.

    The key is the id itself where it names one text. Documents without an id, and those that share theirs
    with another text, get a number below all usual ids from a 62-bit hash of id and text instead, so that they are
    judged on their own.
    """
    number = F.col(key).cast("long")
    own = F.lit(-(1 << 62)) - F.xxhash64(number, number.isNull(), text).bitwiseAND((1 << 62) - 1)
    hashed = docs.select(number.alias("_id"), F.xxhash64(text).alias("_h")).where("_id is not null")
    shared = settle(hashed.groupBy("_id").agg(F.min("_h").alias("lo"), F.max("_h").alias("hi"))
                    .where("lo <> hi").select("_id"), "shared_ids")
    if not has_row(shared):
        return docs.withColumn(name, F.coalesce(number, own))
    flagged = docs.join(shared.withColumn("_shared", F.lit(True)), number == F.col("_id"), "left")
    return flagged.withColumn(name, F.when(F.col("_shared").isNull(), number).otherwise(own)).withColumn(
        name, F.coalesce(name, own)).select(*docs.columns, name)
