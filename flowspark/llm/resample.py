"""Importance resampling towards a target distribution, cut off by a distributed quickselect.

Every text is a bag of hashed features (runs of 1 to ``max_n`` words). The raw table and the target are
counted per bucket; the log ratio of the two smoothed shares is the bucket's gain, and the gains of a
text's features add up to its weight. Gumbel noise, fixed by the id, is added to the weight, so that the
rows of highest score are a sample without replacement in proportion to the weights.

What tasks receive is one array with a gain per bucket, so a score is an array lookup. The k-th score is
found without sorting the table: pivot keys are drawn at random from the rows still in question, one
aggregation counts exactly how many rows are less than, equal to and greater than each of them, and the
interval that holds the k-th row is searched on. A composite key (score, id, text hash, row) makes every
row distinct, so a score that a third of all rows share narrows like any other. Only the winners are
sorted, by range over many tasks, and ranked by adding the sizes of the ranges before.

Edge cases: a null or empty text and one without words have no features and weight 0; they are scored,
and drawn only if ``least_words`` allows it. A null id is hashed as the empty text and loses ties.
Repeated rows are scored and drawn each on its own. An empty target gives each bucket the smoothed share
of nothing; an empty table gives no rows. Further columns are carried along if named in ``keep``, under
any names but those of the result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowspark.llm import common
from flowspark.llm.registry import query, table

BUCKETS = 10_000
LEAST_WORDS = 20
PERCENT = 10
SEED = "2024"
#: Pivots per round: the interval shrinks by about as many times with each scan.
PIVOTS = 15
RESULT = ["n_words", "n_features", "weight", "score", "rank"]
#: Bytes of a word that are worked through for all words at once; the rest of a longer word follows singly.
_TOGETHER = 64


def _crc_table() -> np.ndarray:
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = (out >> np.uint32(1)) ^ (np.uint32(0xEDB88320) * (out & np.uint32(1)))
    return out


_CRC = _crc_table()
_ONES = np.uint32(0xFFFFFFFF)


def _crc_on(state: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Inner CRC-32 states after the bytes ``data[start:end]`` of every span."""
    length = end - start
    order = np.argsort(-length, kind="stable")
    state, begin, length = state[order], start[order], length[order]
    for j in range(min(_TOGETHER, int(length[0]) if len(length) else 0)):
        on = int(np.searchsorted(-length, -j, "left"))  # spans longer than j come first
        now = state[:on]
        state[:on] = _CRC[(now ^ data[begin[:on] + j]) & np.uint32(255)] ^ (now >> np.uint32(8))
    for i in range(int(np.searchsorted(-length, -_TOGETHER, "left"))):
        rest = data[begin[i] + _TOGETHER: begin[i] + length[i]].tobytes()
        state[i] = np.uint32(zlib.crc32(rest, int(state[i] ^ _ONES))) ^ _ONES
    out = np.empty_like(state)
    out[order] = state
    return out


def _features(found: common.Words, max_n: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, document) of every feature of a slice of texts."""
    doc = found.docs()
    state = _crc_on(np.full(len(doc), _ONES), found.data, found.start, found.end)
    hashes, owners, first = [state ^ _ONES], [doc], np.arange(len(doc))
    for n in range(2, max_n + 1):
        good = first + n - 1 < found.first[doc[first] + 1]
        first, state = first[good], state[good]
        state = _CRC[(state ^ np.uint32(32)) & np.uint32(255)] ^ (state >> np.uint32(8))
        state = _crc_on(state, found.data, found.start[first + n - 1], found.end[first + n - 1])
        hashes.append(state ^ _ONES)
        owners.append(doc[first])
    return (np.concatenate(hashes) % np.uint32(buckets)).astype(np.int64), np.concatenate(owners)


def bucket_counts(texts: DataFrame, text: str = "text", max_n: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all texts per bucket. Each task sends one row per bucket, the driver gets ``buckets``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for found in common.words(batch.column(0), common.ALNUM, lower=True):
                total += np.bincount(_features(found, max_n, buckets)[0], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    rows = texts.select(F.col(text).alias("text")).mapInArrow(run, "bucket long, n long")
    out = np.zeros(buckets, np.int64)
    for r in rows.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most one per bucket
        out[r["bucket"]] = r["n"]
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of the ratio of the smoothed shares of every bucket, target over raw."""
    n = float(len(raw))
    ratio = (target + 1.0) * (float(raw.sum()) + n) / ((raw + 1.0) * (float(target.sum()) + n))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def scored(docs: DataFrame, gain: np.ndarray, text: str = "text", key: str = "doc_id", max_n: int = 1,
           seed: str = SEED, keep: Sequence[str] = ()) -> DataFrame:
    """``key``, the columns to ``keep``, ``n_words, n_features, weight, score`` and the key columns
    ``_tie, _row`` of every row; a written table, so that every later scan sees the same rows."""
    rest = [key, *keep]
    shared = docs.sparkSession.sparkContext.broadcast(gain)
    carried = [F.col(c).alias(f"_c{i}") for i, c in enumerate(rest)]
    rows = docs.select(F.col(text).cast("string").alias("_text"), F.xxhash64(text).alias("_tie"), *carried)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            n_words, n_features, weight = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for found in common.words(batch.column(0), common.ALNUM, lower=True):
                own, n = _features(found, max_n, len(shared.value)), found.hi - found.lo
                n_words.append(np.diff(found.first))
                n_features.append(np.bincount(own[1], minlength=n))
                order = np.argsort(own[1], kind="stable")
                upto = np.concatenate([[0], np.cumsum(shared.value[own[0][order]])])
                edge = np.concatenate([[0], np.cumsum(n_features[-1])])
                weight.append(np.diff(upto[edge]))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], *(pa.array(np.concatenate(c), pa.int64()) for c in (n_words, n_features, weight)),
                 pa.array(np.arange(row, row + len(batch)))],
                [*batch.schema.names[1:], "n_words", "n_features", "weight", "_row"])
            row += len(batch)

    schema = T.StructType([*rows.schema.fields[1:], *(
        T.StructField(c, T.LongType()) for c in ("n_words", "n_features", "weight", "_row"))])
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("_c0").cast("string"), F.lit(""))),
                                  256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    out = rows.mapInArrow(run, schema)
    return common.settle(out.select(
        *[F.col(f"_c{i}").alias(c) for i, c in enumerate(rest)], "n_words", "n_features", "weight",
        (F.col("weight") + noise).cast("long").alias("score"), "_tie", "_row"), "scored")


def kth_key(rows: DataFrame, by: Sequence[Column], k: int, pivots: int = PIVOTS) -> tuple | None:
    """The ``k``-th smallest (from 1) of the composite keys ``by``; None if there are fewer.

    Each round draws ``pivots`` random keys from the open interval still in question and counts, in one
    aggregation, the rows below and at each of them. Keys must not hold nulls.
    """
    names = [f"k{i}" for i in range(len(by))]
    keys = rows.select(*[c.alias(n) for c, n in zip(by, names)])
    whole = F.struct(*names)

    def fixed(p: tuple) -> Column:
        return F.struct(*[F.lit(v).cast(keys.schema[n].dataType).alias(n) for v, n in zip(p, names)])

    low = high = None
    below, turn = 0, 0
    while True:
        left = keys
        if low is not None:
            left = left.where(whole > fixed(low))
        if high is not None:
            left = left.where(whole < fixed(high))
        drawn = left.orderBy(F.xxhash64(F.lit(turn), *names)).limit(pivots).collect()
        drawn = sorted({tuple(r) for r in drawn})
        if not drawn:
            return None
        ways = [F.count_if(f(fixed(p))) for p in drawn for f in (whole.__lt__, whole.eqNullSafe)]
        counts = list(left.agg(*[c.alias(f"c{i}") for i, c in enumerate(ways)]).first())
        start = below
        for p, less, same in zip(drawn, counts[::2], counts[1::2]):
            if start + less >= k:
                high = p
                break
            if start + less + same >= k:
                return p
            low, below = p, start + less + same
        turn += 1


def _key() -> list[Column]:
    return [-F.col("score"), F.col("_id").isNull().cast("int"), F.coalesce("_id", F.lit(0)),
            F.col("_tie"), F.col("_row")]


def _ranked(winners: DataFrame) -> DataFrame:
    """``winners`` with ``rank``: sorted by range, numbered within each range, sizes before added."""
    schema = T.StructType([*winners.schema.fields, T.StructField("_range", T.IntegerType()),
                           T.StructField("_at", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 1
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([part] * len(batch), pa.int32()),
                 pa.array(np.arange(at, at + len(batch)), pa.int64())], [*batch.schema.names, "_range", "_at"])
            at += len(batch)

    by = _key()
    rows = common.settle(winners.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(run, schema), "winners")
    sizes = {r["_range"]: r["n"] for r in rows.groupBy("_range").agg(F.max("_at").alias("n")).collect()}
    before, total = [], 0
    for part in range(max(sizes, default=-1) + 1):  # one number per task of the sort
        before.append(total)
        total += sizes.get(part, 0)
    place = F.get(F.array(*[F.lit(b) for b in before]).cast("array<bigint>"), F.col("_range"))
    return rows.withColumn("rank", F.col("_at") + place)


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS,
             max_n: int = 1, buckets: int = BUCKETS, seed: str = SEED, text: str = "text", key: str = "doc_id",
             target_text: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """Every row's ``key``, columns to ``keep``, ``n_words, n_features, weight, score`` and ``rank``: 1, 2,
    3, ... for the ``percent`` of the rows of ``least_words`` or more that are drawn, null for all others."""
    clash = set(keep) & {*RESULT, "_tie", "_row", "_id", "_range", "_at", key}
    if clash:
        raise ValueError(f"columns named like the result: {sorted(clash)}")
    gain = gains(bucket_counts(docs, text, max_n, buckets), bucket_counts(target, target_text, max_n, buckets))
    rows = scored(docs, gain, text, key, max_n, seed, keep).withColumn("_id", F.col(key))
    long = rows.where(F.col("n_words") >= least_words)
    k = percent * long.count() // 100
    names = [key, *keep, *RESULT]
    nobody = rows.withColumn("rank", F.lit(None).cast("long")).select(*names)
    cut = kth_key(long, _key(), k) if k else None
    if cut is None:
        return nobody
    own = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(_key())])
    kinds = long.select(*[c.alias(f"k{i}") for i, c in enumerate(_key())]).schema
    last = F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(cut, kinds)])
    drawn = (F.col("n_words") >= least_words) & (own <= last)
    rest = rows.where(~drawn).withColumn("rank", F.lit(None).cast("long"))
    return _ranked(rows.where(drawn)).select(*names).unionByName(rest.select(*names))


ORACLE = f"""
WITH entry AS (SELECT i, list_reduce([i::BIGINT] || range(8), lambda c, j: xor(c >> 1, 3988292384 * (c & 1))) AS v
               FROM range(256) r(i)),
crc AS MATERIALIZED (SELECT list(v ORDER BY i) AS t FROM entry),
d AS (SELECT doc_id, unnest(regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS word FROM documents),
b AS (SELECT unnest(regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS word FROM benchmark),
word AS (SELECT word, hex(encode(word)) AS h FROM (SELECT word FROM d UNION SELECT word FROM b)),
hashed AS (SELECT word, xor(list_reduce([4294967295] || list_transform(range(len(h) // 2),
             lambda i: ('0x' || substr(h, i * 2 + 1, 2))::BIGINT),
             lambda c, y: xor(c >> 8, t[(xor(c, y) & 255) + 1])), 4294967295) % {BUCKETS} AS bucket
           FROM word, crc),
s AS (SELECT bucket, count(*) AS s FROM d JOIN hashed USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM b JOIN hashed USING (word) GROUP BY bucket),
g AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM d) + {BUCKETS})::DOUBLE
        / ((s + 1)::DOUBLE * ((SELECT count(*) FROM b) + {BUCKETS})::DOUBLE)))::BIGINT AS gain
      FROM s LEFT JOIN t USING (bucket)),
w AS (SELECT doc_id, count(*) AS n, sum(gain) AS weight
      FROM d JOIN hashed USING (word) JOIN g USING (bucket) GROUP BY doc_id),
r AS (SELECT doc_id, coalesce(n, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
        ('0x' || substr(sha256('{SEED}:' || doc_id::VARCHAR), 1, 8))::BIGINT AS h
      FROM documents LEFT JOIN w USING (doc_id)),
z AS (SELECT doc_id, n_features, weight,
        weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score,
        n_features >= {LEAST_WORDS} AS long_enough FROM r),
o AS (SELECT *, row_number() OVER (PARTITION BY long_enough ORDER BY score DESC, doc_id) AS place FROM z)
SELECT doc_id, n_features, weight, score,
       CASE WHEN long_enough AND place <= {PERCENT} * (SELECT count(*) FROM z WHERE long_enough) // 100 THEN place END::BIGINT
         AS rank
FROM o"""


@query("op13_importance_resampling", ORACLE)
def importance_resampling(spark, sf_dir: str) -> DataFrame:
    out = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")
