"""Jaccard self-join of documents by parity sketches.

Every distinct shingle flips one bit of a sketch, so two sketches differ in at most as many bits as
the sets differ in shingles. Sets with a Jaccard similarity of t differ in at most
``(|A| + |B|) (1 - t) / (1 + t)`` shingles. Per size band that gives a number T of differences; the
sketch is cut into more than T segments, and by the pigeonhole principle linked documents agree in at
least one of them (in ``empty_allowance`` more, so that empty segments need not be joined on). A
document takes part in its own band and the next, which holds every size it can link with.

1. One scan gives every document its set size, a digest and a dense sketch. Documents of equal sets are
   one node, named by the smallest id. The texts of the nodes send the hashes of their segments, as
   compressed columns, to buckets of bounded size on average (a segment shared by very many different
   sets is still in one bucket). A bucket finds equal segments: groups of up to ``SMALL_GROUP`` nodes
   yield their pairs, larger ones the pairs with their first node, and their members.
2. Pairs are filtered by size and by the Hamming distance of the dense sketches.
3. Pairs are verified by exact intersection: first the best pair of each document, then those pairs
   that still join different components.
4. Larger groups that still hold several components are compared in full, in blocks of
   ``BLOCK`` x ``BLOCK`` documents per task, by sketch; the pairs that pass are verified. No link
   between different components is left out, and none within one is looked for.

Shingles are compared by a 48-bit hash. Edge cases: null, empty and blank texts have an empty set and
link with nothing; a text of fewer words than a shingle is one shingle. Rows of one ``doc_id`` are one
document (a link of any of its texts is its link). A null id gets a null component. An empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowspark.llm import blobs, common
from flowspark.llm.graph import components
from flowspark.llm.registry import query, table

SHINGLE = 5
PERCENT = 80
SMALL_GROUP = 16
BLOCK = 1024
#: Segment hashes per bucket, on average.
BUCKET_ENTRIES = 3_000_000
#: Segment hashes that a task gathers before it hands out a row per bucket.
_FLUSH = 2_000_000
_MASK48 = np.uint64((1 << 48) - 1)
_U = np.uint64


def max_difference(total: int, percent: int) -> int:
    """Largest symmetric difference of two sets of ``total`` elements together that link."""
    return total * (100 - percent) // (100 + percent)


@lru_cache(maxsize=8)
def bands(percent: int) -> np.ndarray:
    """Upper ends of the size bands: a set links with sets of its own band and of its neighbours."""
    ends = [1]
    while ends[-1] < 1 << 40:
        ends.append(max(ends[-1] + 1, ends[-1] * 100 // percent))
    return np.array(ends, np.int64)


@lru_cache(maxsize=8)
def segments(percent: int) -> np.ndarray:
    """Segments of the sketch of each band."""
    return np.array([t + 1 + empty_allowance(t) for t in
                     (max_difference(2 * int(r), percent) for r in bands(percent))], np.int64)


def empty_allowance(t: int) -> int:
    """Empty segments a document may have so that it can leave them out (0 if there is one)."""
    return math.ceil(0.06 * t + 1 + 2 * math.sqrt(0.05 * t)) if t else 0


def shingle_sets(column: pa.Array, n: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(lo, hi, first, hashes): distinct shingle hashes of rows lo .. hi-1, sorted within a row."""
    for found in common.words(column, common.NON_SPACE, lower=True):
        count = np.diff(found.first)
        whole = common.whole_windows(found.first, n)
        keys = common.ngram_keys(found.key, n)[whole]
        owner = found.docs()[: len(whole)][whole]
        short = np.flatnonzero((count > 0) & (count < n))
        if len(short):
            own = [common.ngram_keys(found.key[found.first[d]: found.first[d + 1]], int(count[d]),
                                     seed=int(count[d]))[0] for d in short]
            keys, owner = np.append(keys, np.array(own, _U)), np.append(owner, short)
        for lo in range(0, found.hi - found.lo, 1 << 16):  # row numbers of 16 bits
            hi = min(lo + (1 << 16), found.hi - found.lo)
            part = (owner >= lo) & (owner < hi)
            tagged = ((owner[part] - lo).astype(_U) << _U(48)) | (keys[part] >> _U(16))
            tagged.sort()
            tagged = tagged[np.diff(tagged, prepend=~tagged[:1]) != 0]
            first = np.searchsorted(tagged >> _U(48), np.arange(hi - lo + 1).astype(_U))
            yield found.lo + lo, found.lo + hi, first, tagged & _MASK48


def _sketch_bits(size: int) -> int:
    return 1 << max(6, (2 * size).bit_length())


def _describe(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests, sketches = [], [], []
            for lo, hi, first, h in shingle_sets(batch.column(1), n):
                total = [np.concatenate([[_U(0)], np.cumsum(common.mix(h ^ _U(s << 50)))])
                         for s in (1, 2)]
                digests += [(int(x[b]) - int(x[a]) & (1 << 64) - 1).to_bytes(8, "little")
                            + (int(y[b]) - int(y[a]) & (1 << 64) - 1).to_bytes(8, "little")
                            for x, y in [total] for a, b in zip(first[:-1], first[1:])]
                for a, b in zip(first[:-1], first[1:]):
                    bits = _sketch_bits(int(b - a))
                    flips = np.bincount((h[a:b] & _U(bits - 1)).astype(np.int64), minlength=bits)
                    sketches.append(np.packbits((flips & 1).astype(bool), bitorder="little").tobytes()
                                    if b > a else None)
                sizes.append(np.diff(first))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.concatenate([*sizes, np.zeros(0, int)]), pa.int64()),
                 pa.array(digests, pa.binary()), pa.array(sketches, pa.binary())],
                ["doc_id", "n_shingles", "digest", "sketch"])
    return run


def _segment_hashes(h: np.ndarray, first: np.ndarray, percent: int):
    """(row, hash) of the segments of every row, for its band and the next."""
    size = np.diff(first)
    row = np.repeat(np.arange(len(size)), size)
    own = np.searchsorted(bands(percent), size)
    spread = common.mix(h)
    bit = common.mix((spread >> _U(48)) + _U(1 << 20))  # which of 2^16 bits of its segment it flips
    out = []
    for band in (own, own + 1):
        m = segments(percent)[band]
        m[size == 0] = 0
        base = np.concatenate([[0], np.cumsum(m)])
        at = base[row] + ((spread & _MASK48) % m[row].astype(_U)).astype(np.int64)
        parity = np.zeros(base[-1], _U)
        np.bitwise_xor.at(parity, at, bit)
        owner = np.repeat(np.arange(len(size)), m)
        place = np.arange(base[-1]) - base[owner]
        empty = parity == 0
        allowed = m - 1 - np.array([max_difference(2 * int(r), percent) for r in bands(percent)])[band]
        drop = empty & (np.bincount(owner[empty], minlength=len(size)) <= allowed)[owner]
        code = (band[owner].astype(_U) << _U(40)) + place.astype(_U)
        keep = ~drop
        out.append((owner[keep], common.mix(parity + common.mix(code))[keep]))
    return np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])


def _send(n: int, percent: int, buckets: int):
    """Rows (bucket, ids, rest, which): the segment hashes of a run of documents in that bucket."""

    def rows(ids: list[np.ndarray], owners: list[np.ndarray], hashes: list[np.ndarray]):
        ids, owner, h = np.concatenate(ids), np.concatenate(owners), np.concatenate(hashes)
        place = (h & _U(0xFFFFFFFF)) % _U(buckets)
        order = np.lexsort((h >> _U(32), place.astype(np.int32)))
        owner, rest, place = owner[order], (h[order] >> _U(32)).astype(np.uint32), place[order]
        edge = np.append(np.flatnonzero(np.diff(place, prepend=_U(buckets))), len(place))
        out = []
        for a, b in zip(edge[:-1], edge[1:]):
            used, which = np.unique(owner[a:b], return_inverse=True)
            out.append((int(place[a]), blobs.pack(np.diff(ids[used], prepend=0).view(_U)),
                        blobs.pack_sorted(rest[a:b]), blobs.pack(which.astype(np.uint32))))
        return pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in out], pa.int32())]
            + [pa.array([r[i] for r in out], pa.binary()) for i in (1, 2, 3)],
            ["bucket", "ids", "rest", "which"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, owners, hashes, base, held = [], [], [], 0, 0
        for batch in batches:
            all_ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for lo, hi, first, h in shingle_sets(batch.column(1), n):
                owner, found = _segment_hashes(h, first, percent)
                ids.append(all_ids[lo:hi])
                owners.append(owner + base)
                hashes.append(found)
                base, held = base + hi - lo, held + len(found)
                if held >= _FLUSH:
                    yield rows(ids, owners, hashes)
                    ids, owners, hashes, base, held = [], [], [], 0, 0
        if held:
            yield rows(ids, owners, hashes)
    return run


_FOUND = "a long, b long, shared long, members binary"


def _match(group: pa.Table) -> pa.Table:
    """Equal segment hashes of one bucket: pairs of documents, and members of the larger groups."""
    ids, rest = [], []
    for i, r, w in zip(group["ids"], group["rest"], group["which"]):
        own = np.cumsum(blobs.unpack(i.as_py(), np.int64))
        ids.append(own[blobs.unpack(w.as_py(), np.uint32)])
        rest.append(blobs.unpack_sorted(r.as_py(), np.uint32))
    ids, rest = np.concatenate(ids), np.concatenate(rest)
    order = np.lexsort((ids, rest))
    ids, rest = ids[order], rest[order]
    new = (np.diff(rest, prepend=~rest[:1]) != 0) | (np.diff(ids, prepend=ids[:1]) != 0)
    ids, rest = ids[new], rest[new]
    edge = np.flatnonzero(np.diff(rest, prepend=~rest[:1]))
    size = np.diff(np.append(edge, len(rest)))
    of = np.repeat(np.arange(len(edge)), size)
    small = (size <= SMALL_GROUP)[of]
    a, b = [], []
    for d in range(1, SMALL_GROUP):
        pair = np.flatnonzero((rest[d:] == rest[:-d]) & small[d:])
        a.append(ids[pair])
        b.append(ids[pair + d])
    member = np.flatnonzero(~small)
    member = member[edge[of[member]] != member]
    a, b = np.concatenate([*a, ids[edge[of[member]]]]), np.concatenate([*b, ids[member]])
    tag = common.mix(common.mix(a.view(_U)) + b.view(_U))
    _, at, shared = np.unique(tag, return_index=True, return_counts=True)
    seen, members = set(), []
    for g in np.flatnonzero(size > SMALL_GROUP):
        blob = blobs.pack_sorted(ids[edge[g]: edge[g] + size[g]].view(_U))
        if blob not in seen:
            seen.add(blob)
            members.append(blob)
    n, k = len(at), len(members)
    return pa.table({
        "a": pa.array(list(a[at]) + [None] * k, pa.int64()),
        "b": pa.array(list(b[at]) + [None] * k, pa.int64()),
        "shared": pa.array(list(shared) + [None] * k, pa.int64()),
        "members": pa.array([None] * n + members, pa.binary())})


def hamming(a: bytes, b: bytes) -> int:
    """Differing bits of two sketches; the longer one is folded to the length of the other."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    while len(x) != len(y):
        if len(x) < len(y):
            x, y = y, x
        x = x[: len(x) // 2] ^ x[len(x) // 2:]
    return int(np.bitwise_count(x ^ y).sum())


def _near(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column("n_a").to_numpy() + batch.column("n_b").to_numpy()
            keep = [hamming(x.as_py(), y.as_py()) <= max_difference(int(t), percent) for x, y, t in
                    zip(batch.column("sketch_a"), batch.column("sketch_b"), n)]
            yield batch.select(["a", "b", "shared"]).filter(pa.array(keep, pa.bool_()))
    return run


def _sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for _, _, first, h in shingle_sets(batch.column(1), n):
                raw = h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
                out += [raw[a:b].tobytes() for a, b in zip(first[:-1], first[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())],
                                             ["id", "set"])
    return run


def _elements(blob: bytes) -> np.ndarray:
    wide = np.zeros((len(blob) // 6, 8), np.uint8)
    wide[:, :6] = np.frombuffer(blob, np.uint8).reshape(-1, 6)
    return wide.view("<u8").ravel()


def _linked(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("set_a"), batch.column("set_b")):
                x, y = _elements(x.as_py()), _elements(y.as_py())
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
    return run


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    left = sets.select(F.col("id").alias("a"), F.col("set").alias("set_a"))
    right = sets.select(F.col("id").alias("b"), F.col("set").alias("set_b"))
    rows = pairs.select("a", "b").join(left, "a").join(right, "b")
    return rows.select("a", "b", "set_a", "set_b").mapInArrow(_linked(percent), "a long, b long")


def _across(pairs: DataFrame, comps: DataFrame) -> DataFrame:
    """Pairs whose ends are not in one component yet."""
    comps = comps.select("id", "component_id")
    for end in ("a", "b"):
        own = comps.select(F.col("id").alias(end), F.col("component_id").alias(f"c_{end}"))
        pairs = pairs.join(own, end, "left")
    return pairs.where("coalesce(c_a, a) <> coalesce(c_b, b)").drop("c_a", "c_b")


def _block_pairs(percent: int):
    """Pairs of one block of a group that are in different components and whose sketches are near."""

    def run(group: pa.Table) -> pa.Table:
        one = group.filter(pc.equal(group["side"], 0))
        two = group.filter(pc.equal(group["side"], 1))
        names = ("id", "comp", "n_shingles")
        a_id, a_comp, a_n = (one[c].to_numpy() for c in names)
        b_id, b_comp, b_n = (two[c].to_numpy() for c in names)
        sketches = [[np.frombuffer(s.as_py(), np.uint64) for s in t["sketch"]] for t in (one, two)]
        width = min((len(s) for side in sketches for s in side), default=1)

        def folded(s: np.ndarray) -> np.ndarray:
            return np.bitwise_xor.reduce(s.reshape(-1, width), axis=0)

        right = np.array([folded(s) for s in sketches[1]], np.uint64).reshape(len(b_id), width)
        found_a, found_b = [], []
        for i in range(len(a_id)):
            limit = (a_n[i] + b_n) * (100 - percent) // (100 + percent)
            could = ((b_comp != a_comp[i]) & (b_id > a_id[i])
                     & (100 * np.minimum(a_n[i], b_n) >= percent * np.maximum(a_n[i], b_n)))
            could = np.flatnonzero(could)
            if len(could):
                apart = np.bitwise_count(right[could] ^ folded(sketches[0][i])).sum(1)
                could = could[apart <= limit[could]]
                found_a += [a_id[i]] * len(could)
                found_b += b_id[could].tolist()
        return pa.table({"a": pa.array(found_a, pa.int64()), "b": pa.array(found_b, pa.int64())})
    return run


def _open_groups(groups: DataFrame, nodes: DataFrame, comps: DataFrame, percent: int) -> DataFrame:
    """Pairs to verify from groups with members in several components."""

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for g, blob in zip(batch.column(0), batch.column(1)):
                ids = blobs.unpack_sorted(blob.as_py(), np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([g.as_py()] * len(ids), pa.binary()), pa.array(ids)], ["g", "id"])

    rows = (groups.select(F.unhex(F.md5("members")).alias("g"), "members").dropDuplicates(["g"])
            .mapInArrow(unpacked, "g binary, id long"))
    rows = rows.join(nodes.select("id", "node"), "id").select("g", F.col("node").alias("id"))
    rows = rows.join(comps.select("id", "component_id"), "id", "left").select(
        "g", "id", F.coalesce("component_id", "id").alias("comp")).distinct()
    rows = common.settle(rows, "groups")
    several = (rows.groupBy("g").agg(F.min("comp").alias("x"), F.max("comp").alias("y"),
                                     F.count("*").alias("n")).where("x <> y")
               .select("g", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")))
    rows = rows.join(several, "g").withColumn(
        "own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    rows = rows.join(nodes.where("id = node").select("id", "n_shingles", "sketch"), "id")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    each = [rows.select("g", "id", "comp", "n_shingles", "sketch", "own", other, F.lit(s).alias("side"))
            for s in (0, 1)]
    left = each[0].withColumnsRenamed({"own": "i", "other": "j"})
    right = each[1].withColumnsRenamed({"own": "j", "other": "i"})
    return left.unionByName(right).groupBy("g", "i", "j").applyInArrow(
        _block_pairs(percent), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", n: int = SHINGLE,
                    percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(documents, links): per document ``doc_id, n_shingles, component_id``; per verified link
    ``a, b``, enough of them to connect every component (documents of equal sets are not listed)."""
    texts = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    # One pass gives sizes and sketches, and from them the number of buckets.
    described = common.settle(texts.mapInArrow(
        _describe(n), "doc_id long, n_shingles long, digest binary, sketch binary"), "sets")
    total = described.agg(F.sum("n_shingles")).first()[0] or 0
    sent = 2 * total * segments(percent)[40] // bands(percent)[40]
    buckets = max(1, math.ceil(sent / BUCKET_ENTRIES))
    whole = described.where("doc_id is not null and n_shingles > 0")
    first = whole.groupBy("n_shingles", "digest").agg(F.min("doc_id").alias("node"))
    nodes = common.settle(whole.join(first, ["n_shingles", "digest"]).select(
        F.col("doc_id").alias("id"), "node", "n_shingles", "sketch"), "nodes")

    one = nodes.where("id = node").select(F.col("id").alias("doc_id"))
    found = (texts.join(one, "doc_id", "left_semi")  # of copies, only the node's text is sent
             .mapInArrow(_send(n, percent, buckets), "bucket int, ids binary, rest binary, which binary")
             .repartition(buckets, "bucket")
             .groupBy("bucket").applyInArrow(_match, _FOUND))
    found = common.settle(found, "found")
    pairs = found.where("members is null").groupBy("a", "b").agg(F.sum("shared").alias("shared"))
    for end in ("a", "b"):
        own = nodes.select(F.col("id").alias(end), F.col("node").alias(f"node_{end}"))
        pairs = pairs.join(own, end)
    pairs = (pairs.where("node_a <> node_b")
             .groupBy(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b"))
             .agg(F.max("shared").alias("shared")))
    for end in ("a", "b"):
        own = nodes.where("id = node").select(
            F.col("id").alias(end), F.col("n_shingles").alias(f"n_{end}"),
            F.col("sketch").alias(f"sketch_{end}"))
        pairs = pairs.join(own, end)
    pairs = pairs.where(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)")
    pairs = common.settle(pairs.mapInArrow(_near(percent), "a long, b long, shared long"), "pairs")

    groups = found.where("members is not null").select("members")
    wanted = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    sets = common.settle(texts.withColumnRenamed("doc_id", "id").join(wanted, "id", "left_semi")
                         .mapInArrow(_sets(n), "id long, set binary"), "elements")
    best = pairs.groupBy("b").agg(F.max_by("a", F.struct("shared", -F.col("a"))).alias("a"))
    links = common.settle(_verified(best, sets, percent), "links")
    comps = common.settle(components(links), "components")
    more = common.settle(_verified(_across(pairs, comps), sets, percent), "links")
    if common.has_row(more):
        links = links.union(more)
        comps = common.settle(components(links), "components")
    if common.has_row(groups):
        late = common.settle(_open_groups(groups, nodes, comps, percent), "late")
        late = common.settle(_across(late, comps).join(pairs, ["a", "b"], "left_anti"), "late")
        if common.has_row(late):
            wanted = late.select(F.col("a").alias("id")).union(late.select("b")).distinct()
            more_sets = (texts.withColumnRenamed("doc_id", "id").join(wanted, "id", "left_semi")
                         .mapInArrow(_sets(n), "id long, set binary"))
            links = links.union(common.settle(_verified(late, more_sets, percent), "links"))
            comps = common.settle(components(links), "components")
    of = (nodes.select("id", "node").distinct()
          .join(comps.withColumnRenamed("id", "node"), "node", "left")
          .groupBy("id").agg(F.min(F.coalesce("component_id", "node")).alias("component_id")))
    out = described.join(of, described["doc_id"] == of["id"], "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return out, links


@query("op6_near_duplicates")
def op6(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))[0]


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each group of near duplicates: that of the smallest id (null ids last), then text hash.

    Rows that agree in id and text are one document, of which one row stays; documents with a null id, or an id
    that several texts share, are compared like all others (``common.with_document_key``). Documents without
    words are in no group. All columns are kept as they are, under any names.
    """
    keyed = docs.select(F.struct(*docs.columns).alias("_all"), F.col("doc_id"), F.col("text"))
    keyed = common.with_document_key(keyed, "_key")
    names = keyed.select("_key", F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_h"))
    names = common.settle(names.groupBy("_key").agg(
        F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", "_h", "_key")).alias("_first"),
        F.count("*").alias("_rows")), "names")
    again = names.where("_rows > 1").select("_key")
    if common.has_row(again):  # rows that agree in id and text are one
        single = common.settle(keyed.join(again, "_key", "left_semi").dropDuplicates(["_key"]), "single")
        keyed = keyed.join(again, "_key", "left_anti").unionByName(single)
    found, _ = near_duplicates(keyed, key="_key")
    found = common.settle(found.select(F.col("doc_id").alias("_key"), "component_id"), "members")
    several = found.groupBy("component_id").agg(F.count("*").alias("n")).where("n > 1")
    members = found.join(several, "component_id", "left_semi").join(names, "_key")
    best = members.groupBy("component_id").agg(F.min("_first").alias("_best"))
    gone = common.settle(members.join(best, "component_id").where("_key <> _best._key").select("_key"), "gone")
    return keyed.join(gone, "_key", "left_anti").select("_all.*")
