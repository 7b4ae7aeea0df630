"""Substring dedup: words in runs of ``WINDOW`` words or more that an earlier text already has.

Anchors: the index holds the non-overlapping blocks of ``BLOCK`` words of every text (at word 0, BLOCK,
2 BLOCK, ...); every rolling window of BLOCK words probes it. A repeated run of 2 BLOCK - 1 words or more
contains a whole block of the earlier text, so the probe at that place hits. A hit is then extended: all
windows of ``WINDOW`` words around it are keyed (96 bits), the earliest place of each key is found, and
windows that start later than it, chained along the same distance from their source, are the maximal
exact repeats.

Keys travel as compressed columns, one row per task and bucket, never as rows: buckets and parts are as
many as the word count asks for, so that each stays small. Within a task equal keys are joined before
they are sent, so a passage that a third of all texts share reaches a bucket once per task. Blocks
decide only where to look; texts are read three times and shuffled twice (by parts of whole documents).

Edge cases: null texts have no words; texts shorter than a window lose nothing. Places are ordered by
(``doc_id``, word number); rows that share an id stand at the same places, so neither removes the
other's words, and a null id counts as the smallest. An empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowspark.llm import blobs, common
from flowspark.llm.registry import query, table

WINDOW = 20
BLOCK = 10
#: Keys per bucket and words per part, on average, and keys that a task gathers before it sends them.
BUCKET_KEYS = 2_000_000
PART_WORDS = 2_000_000
_FLUSH = 2_000_000
_U = np.uint64
_NULL_ID = -(1 << 63)
_MESSAGE = "target int, flag boolean, ids binary, which binary, at binary, key binary, more binary"
_PLACES = "part int, ids binary, which binary, at binary, src binary, src_at binary"


def part_of(ids: np.ndarray, parts: int) -> np.ndarray:
    """Part of a document; ``_PART`` is the same rule in SQL."""
    x = (ids & 0x7FFFFFFF) * 1664525 + ((ids >> 31) & 0x7FFFFFFF) * 22695477
    return (x ^ (x >> 23)) % parts


_PART = """cast(pmod(x ^ shiftright(x, 23), {parts}) as int)"""
_PART_X = "(doc_id & 2147483647L) * 1664525L + (shiftright(doc_id, 31) & 2147483647L) * 22695477L"


def _message(target: int, flag: bool, ids: np.ndarray, at: np.ndarray, key=None, more=None) -> dict:
    used, which = np.unique(ids, return_inverse=True)
    return {"target": target, "flag": flag, "ids": blobs.pack_sorted(used.view(_U)),
            "which": blobs.pack(which.astype(np.uint32)), "at": blobs.pack(at.astype(np.uint32)),
            "key": None if key is None else blobs.pack_sorted(key),
            "more": None if more is None else blobs.pack(more)}


def _read(row: dict) -> tuple[np.ndarray, np.ndarray]:
    ids = blobs.unpack_sorted(row["ids"], _U).view(np.int64)
    return ids[blobs.unpack(row["which"], np.uint32)], blobs.unpack(row["at"], np.uint32).astype(np.int64)


_SCHEMA = pa.schema([("target", pa.int32()), ("flag", pa.bool_()), ("ids", pa.binary()), ("which", pa.binary()),
                     ("at", pa.binary()), ("key", pa.binary()), ("more", pa.binary())])


def _groups(values: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(values, kind="stable")
    edge = np.append(np.flatnonzero(np.diff(values[order], prepend=-1)), len(order))
    for a, b in zip(edge[:-1], edge[1:]):
        yield int(values[order[a]]), order[a:b]


def _earliest(key: np.ndarray, more: np.ndarray, ids: np.ndarray, at: np.ndarray):
    """(order, first of its key?, number of the first) with entries sorted by key, then place."""
    order = np.lexsort((at, ids, more, key))
    new = ((np.diff(key[order], prepend=~key[order][:1]) != 0)
           | (np.diff(more[order], prepend=more[order][:1]) != 0))
    return order, new, np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))


def _probes(buckets: int):
    """Per run of texts and bucket: the distinct window keys with one place; ``more`` says whether one
    of the places is a block. Places whose key occurs again here are hits already and go as they are."""

    def rows(ids, at, key) -> Iterator[pa.RecordBatch]:
        ids, at, key = np.concatenate(ids), np.concatenate(at), np.concatenate(key)
        order = np.argsort(key, kind="stable")
        ids, at, key = ids[order], at[order], key[order]
        edge = np.flatnonzero(np.diff(key, prepend=~key[:1]))
        count = np.diff(np.append(edge, len(key)))
        block = np.maximum.reduceat((at % BLOCK == 0).astype(np.uint8), edge)
        local = np.repeat(count > 1, count)
        if local.any():
            yield pa.RecordBatch.from_pylist([_message(
                int(key[edge[0]] % _U(buckets)), True, ids[local], at[local])], _SCHEMA)
        target = (key[edge] & _U(0xFFFFFFFF)) % _U(buckets)
        for b, own in _groups(target.astype(np.int64)):
            e = edge[own]
            rest = (key[e] >> _U(32)).astype(np.uint32)
            by = np.argsort(rest, kind="stable")
            yield pa.RecordBatch.from_pylist([_message(
                b, False, ids[e][by], at[e][by], rest[by], block[own][by].astype(np.uint8))], _SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [[], [], []], 0
        for batch in batches:
            all_ids = batch.column(0).to_numpy()
            for found in common.words(batch.column(1), common.NON_SPACE, lower=False):
                key = common.ngram_keys(found.key, BLOCK)
                start = np.flatnonzero(common.whole_windows(found.first, BLOCK))
                if not len(start):
                    continue
                doc = found.docs()[start]
                for column, own in zip(held, (all_ids[found.lo + doc], start - found.first[doc], key[start])):
                    column.append(own)
                n += len(start)
                if n >= _FLUSH:
                    yield from rows(*held)
                    held, n = [[], [], []], 0
        if n:
            yield from rows(*held)
    return run


_PLACE_SCHEMA = pa.schema([("part", pa.int32()), ("ids", pa.binary()), ("which", pa.binary()), ("at", pa.binary()),
                           ("src", pa.binary()), ("src_at", pa.binary())])


def _by_part(parts: int, ids: np.ndarray, at: np.ndarray, src=None, src_at=None) -> Iterator[dict]:
    for p, own in _groups(part_of(ids, parts)):
        message = _message(p, False, ids[own], at[own])
        yield {"part": p, "ids": message["ids"], "which": message["which"], "at": message["at"],
               "src": None if src is None else blobs.pack(src[own].view(_U)),
               "src_at": None if src_at is None else blobs.pack(src_at[own].astype(np.uint32))}


def _hits(parts: int):
    """Places of one bucket whose window equals a block somewhere else, by part of their document."""

    def run(group: pa.Table) -> pa.Table:
        out, ids, at, rest, block = [], [], [], [], []
        for row in group.to_pylist():
            own, place = _read(row)
            if row["flag"]:
                out += _by_part(parts, own, place)
                continue
            ids.append(own)
            at.append(place)
            rest.append(blobs.unpack_sorted(row["key"], np.uint32))
            block.append(blobs.unpack(row["more"], np.uint8))
        if ids:
            ids, at, rest, block = map(np.concatenate, (ids, at, rest, block))
            order = np.argsort(rest, kind="stable")
            edge = np.flatnonzero(np.diff(rest[order], prepend=~rest[order][:1]))
            count = np.diff(np.append(edge, len(rest)))
            hit = (count > 1) & (np.maximum.reduceat(block[order], edge) > 0)
            own = order[np.repeat(hit, count)]
            out += _by_part(parts, ids[own], at[own])
        return pa.Table.from_pylist(out, _PLACE_SCHEMA)
    return run


class _Places:
    """Places (document, word number) sorted, for lookup by document."""

    def __init__(self, ids: np.ndarray, at: np.ndarray):
        self.order = np.lexsort((at, ids))
        self.ids, self.at = ids[self.order], at[self.order]

    def of(self, found: common.Words, ids: np.ndarray, reach: int) -> tuple[np.ndarray, ...]:
        """(word of the slice, document, number of the place) of the places in ``found`` from which
        ``reach`` words follow, in order."""
        lo, hi = np.searchsorted(self.ids, ids), np.searchsorted(self.ids, ids, "right")
        count = hi - lo
        doc = np.repeat(np.arange(len(ids)), count)
        which = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count - lo, count)
        word = found.first[doc] + self.at[which]
        ok = word + reach <= found.first[doc + 1]
        return word[ok], doc[ok], self.order[which[ok]]


def _extend(buckets: int, parts: int):
    """Keys of all whole windows around the hits of a part, distinct ones with their first place; other
    places of a key of this part are repeats already and go as they are, with their source."""

    def run(docs: pa.Table, hits: pa.Table) -> pa.Table:
        hits = [_read(r) for r in hits.to_pylist()]
        if not len(docs) or not hits:
            return _SCHEMA.empty_table()
        ids_of = docs["doc_id"].to_numpy()
        hits = _Places(np.concatenate([h[0] for h in hits]), np.concatenate([h[1] for h in hits]))
        held: list[list[np.ndarray]] = [[], [], [], []]
        for found in common.words(docs["text"].combine_chunks(), common.NON_SPACE, lower=False):
            own = ids_of[found.lo: found.hi]
            place, place_doc, _ = hits.of(found, own, BLOCK)
            near = np.zeros(int(found.first[-1]) + 1, np.int64)
            doc = found.docs()
            begin = np.maximum(place - (WINDOW - BLOCK), found.first[place_doc])
            np.add.at(near, begin, 1)
            np.add.at(near, place + 1, -1)
            whole = common.whole_windows(found.first, WINDOW)
            start = np.flatnonzero(whole & (np.cumsum(near)[: len(whole)] > 0))
            if len(start):
                key = common.ngram_keys(found.key, WINDOW, seed=1)[start]
                more = (common.ngram_keys(common.mix(found.key), WINDOW, seed=2)[start] >> _U(32)).astype(np.uint32)
                for column, x in zip(held, (key, more, own[doc[start]], start - found.first[doc[start]])):
                    column.append(x)
        if not held[0]:
            return _SCHEMA.empty_table()
        key, more, ids, at = map(np.concatenate, held)
        order, new, first = _earliest(key, more, ids, at)
        key, more, ids, at = key[order], more[order], ids[order], at[order]
        out = []
        later = ~new & ((ids != ids[first]) | (at != at[first]))
        edge = np.flatnonzero(new)
        for b, own in _groups((key[edge] % _U(buckets)).astype(np.int64)):
            e = edge[own]
            out.append(_message(b, False, ids[e], at[e], key[e], more[e]))
        if later.any():
            own = np.flatnonzero(later)
            out.append({**_message(int(key[0] % _U(buckets)), True, ids[own], at[own]),
                        "key": blobs.pack(ids[first[own]].view(_U)),
                        "more": blobs.pack(at[first[own]].astype(np.uint32))})
        return pa.Table.from_pylist(out, _SCHEMA)
    return run


def _repeats(parts: int):
    """Windows of one bucket that start later than the first place of their key."""

    def run(group: pa.Table) -> pa.Table:
        out, held = [], [[], [], [], []]
        for row in group.to_pylist():
            own, place = _read(row)
            if row["flag"]:
                out += _by_part(parts, own, place, blobs.unpack(row["key"], _U).view(np.int64),
                                blobs.unpack(row["more"], np.uint32).astype(np.int64))
                continue
            for column, x in zip(held, (blobs.unpack_sorted(row["key"], _U), blobs.unpack(row["more"], np.uint32),
                                        own, place)):
                column.append(x)
        if held[0]:
            key, more, ids, at = map(np.concatenate, held)
            order, new, first = _earliest(key, more, ids, at)
            ids, at = ids[order], at[order]
            own = np.flatnonzero(~new & ((ids != ids[first]) | (at != at[first])))
            out += _by_part(parts, ids[own], at[own], ids[first[own]], at[first[own]])
        return pa.Table.from_pylist(out, _PLACE_SCHEMA)
    return run


_OUT = ("doc_id long, n_words long, n_removed long, kept string, "
        "repeats array<struct<start: long, end: long, source_id: long, source_start: long>>")


def _text_column(found: common.Words, keep: np.ndarray) -> pa.Array:
    """Kept words of every document, joined by blanks (the byte after a word is white space)."""
    doc = found.docs()[keep]
    start, end = found.start[keep], found.end[keep]
    last = np.diff(doc, append=-1) != 0
    data = found.data.copy()
    data[end[~last]] = 32
    inside = np.zeros(len(data) + 2, np.int8)
    inside[start] += 1
    np.add.at(inside, end + ~last, -1)
    size = np.bincount(doc, (end - start) + ~last, found.hi - found.lo).astype(np.int64)
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    kept = np.ascontiguousarray(data[np.cumsum(inside)[: len(data)] > 0])
    return pa.LargeStringArray.from_buffers(
        found.hi - found.lo, pa.py_buffer(offsets), pa.py_buffer(kept)).cast(pa.string())


_KIND = pa.struct([(c, pa.int64()) for c in ("start", "end", "source_id", "source_start")])


def _remove():
    """Texts of a part without the words of their repeated windows, and the maximal repeats."""

    def run(docs: pa.Table, places: pa.Table) -> pa.Table:
        read = [(*_read(r), blobs.unpack(r["src"], _U).view(np.int64),
                 blobs.unpack(r["src_at"], np.uint32).astype(np.int64)) for r in places.to_pylist()]
        ids, at, src, src_at = (np.concatenate([np.zeros(0, np.int64), *[p[i] for p in read]])
                                for i in range(4))
        places = _Places(ids, at)
        all_ids = docs["doc_id"].to_numpy()
        n_words, n_removed, kept, repeats = [], [], [], []
        for found in common.words(docs["text"].combine_chunks(), common.NON_SPACE, lower=False):
            own = all_ids[found.lo: found.hi]
            word, doc, which = places.of(found, own, WINDOW)
            gone = np.zeros(int(found.first[-1]) + 1, np.int64)
            np.add.at(gone, word, 1)
            np.add.at(gone, word + WINDOW, -1)
            gone = np.cumsum(gone)[:-1] > 0
            n_words.append(np.diff(found.first))
            n_removed.append(np.diff(np.concatenate([[0], np.cumsum(gone)])[found.first]))
            kept.append(_text_column(found, np.flatnonzero(~gone)))
            new = ((np.diff(word, prepend=-9) != 1) | (np.diff(doc, prepend=-1) != 0)
                   | (np.diff(src[which], prepend=0) != 0) | (np.diff(src_at[which], prepend=-9) != 1))
            first = np.flatnonzero(new)
            final = np.append(first[1:], len(word)) - 1 if len(first) else first
            begin = found.first[doc[first]]
            spans = pa.StructArray.from_arrays(
                [pa.array(word[first] - begin), pa.array(word[final] + WINDOW - begin),
                 pa.array(src[which[first]], mask=src[which[first]] == _NULL_ID),
                 pa.array(src_at[which[first]])], fields=list(_KIND))
            offsets = np.searchsorted(doc[first], np.arange(len(own) + 1)).astype(np.int32)
            repeats.append(pa.ListArray.from_arrays(pa.array(offsets), spans))
        return pa.table({
            "doc_id": pa.array(all_ids, pa.int64(), mask=all_ids == _NULL_ID),
            "n_words": pa.array(np.concatenate([*n_words, np.zeros(0, np.int64)])),
            "n_removed": pa.array(np.concatenate([*n_removed, np.zeros(0, np.int64)])),
            "kept": pa.chunked_array(kept, pa.string()),
            "repeats": pa.chunked_array(repeats, pa.list_(_KIND))})
    return run


def remove_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``doc_id, n_words, n_removed, kept, repeats`` of every row: the words that are left, joined by
    blanks, and the maximal exact repeats (word numbers, end exclusive) with their sources."""
    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(_NULL_ID)).alias("doc_id"),
                       F.col(text).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    words = size / 4  # only the number of groups depends on it
    buckets, parts = max(1, math.ceil(words / BUCKET_KEYS)), max(1, math.ceil(words / PART_WORDS))

    def exchanged(sent: DataFrame, run) -> DataFrame:
        return sent.repartition(buckets, "target").groupBy("target").applyInArrow(run, _PLACES)

    by_part = rows.withColumn("x", F.expr(_PART_X)).select(
        F.expr(_PART.format(parts=parts)).alias("part"), "doc_id", "text")
    hits = common.settle(exchanged(rows.mapInArrow(_probes(buckets), _MESSAGE), _hits(parts)), "hits")
    sent = (by_part.groupBy("part").cogroup(hits.groupBy("part"))
            .applyInArrow(_extend(buckets, parts), _MESSAGE))
    repeated = common.settle(exchanged(sent, _repeats(parts)), "repeated")
    return by_part.groupBy("part").cogroup(repeated.groupBy("part")).applyInArrow(_remove(), _OUT)


ORACLE = f"""
WITH w AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM documents),
v AS (SELECT doc_id, s, w[s: s + {WINDOW} - 1] AS v
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW} + 2)) AS s FROM w)),
r AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY v ORDER BY doc_id, s) AS k FROM v)
      WHERE k > 1),
g AS (SELECT DISTINCT doc_id, unnest(range(s, s + {WINDOW})) AS i FROM r),
gone AS (SELECT doc_id, list(i) AS gone FROM g GROUP BY doc_id)
SELECT doc_id, coalesce(len(w), 0)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
       sha256(coalesce(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_transform(list_filter(
           list_zip(w, range(1, len(w) + 1)), lambda p: NOT list_contains(gone, p[2])), lambda p: p[1]) END, ' '), '')) AS kept_sha256
FROM w LEFT JOIN gone USING (doc_id)"""


@query("op5_substring_dedup", ORACLE)
def substring_dedup(spark, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
