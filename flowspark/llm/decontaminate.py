"""Benchmark decontamination with a distributed positional inverted index.

The words of benchmark items are the terms. One pass counts how often each term occurs in the training
texts. A second pass stores postings (term, document row, positions) as a Parquet table. For phrases it
leaves out occurrences that cannot be part of one: a phrase lies in a run of terms at least as long as
the shortest phrase, and that run holds the rarest term of some phrase.

A search starts from the two rarest terms of each phrase: their position lists, each shifted by the
term's offset in the phrase, are intersected, which leaves candidate starts. The remaining terms are
then looked up at their own offsets; a start that all of them confirm is an exact match. Terms are
compared as text, so no hash decides. A proximity search takes the rarest term's positions as centres
and keeps those that have every other term within a distance.

Item terms are a stated query set: they reach the scan in blocks of ``TERM_BLOCK`` terms, so what a
task receives is bounded whatever the size of the benchmark, and the scan is repeated per block.
Frequent terms are never joined on before a rare one has cut the candidates.

Edge cases: null texts have no words; an item without words is never found; an item shorter than a
window is one window; equal items count each under its own id, texts that share an id count once
under it, and a null id is listed as the empty one.
Every input row, repeated ones too, is judged on its own and gets its own row. Empty tables give
documents without hits, or no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from flowspark.llm import common
from flowspark.llm.registry import query, table

WINDOW = 13
#: Terms whose 64-bit keys go to every task at a time (32 MB).
TERM_BLOCK = 4_000_000
_U = np.uint64


def _terms_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for found in common.words(batch.column(1), common.ALNUM, lower=True):
            doc = found.docs()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(doc + found.lo)), batch.column(2).take(pa.array(doc + found.lo)),
                 pa.array(np.arange(len(doc)) - found.first[doc], pa.int32()),
                 pa.array([found.text(i) for i in range(len(doc))], pa.string()),
                 pa.array(found.key.view(np.int64))],
                ["item", "version", "offset", "term", "key"])


def item_terms(items: DataFrame, text: str, key: str) -> DataFrame:
    """(item, version, offset, term, key) of every word of every text of every item."""
    rows = items.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("item"),
                        F.col(text).alias("text"), F.md5(text).alias("version"))
    return rows.distinct().mapInArrow(
        _terms_of, "item string, version string, offset int, term string, key long")


def phrases(terms: DataFrame, size: int) -> DataFrame:
    """(phrase, item, n, words) of every window of ``size`` words; shorter items are one window.

    Equal windows of different items are looked for once.
    """
    lists = terms.groupBy("item", "version").agg(F.sort_array(F.collect_list(F.struct("offset", "term"))).alias("w"))
    lists = lists.select("item", F.col("w.term").alias("w"))
    start = F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - (size - 1))))
    windows = lists.select("item", "w", start.alias("s")).select(
        "item", F.slice("w", F.col("s"), size).alias("words"))
    return windows.groupBy("words").agg(F.collect_set("item").alias("items")).select(
        F.md5(F.array_join("words", " ")).alias("phrase"), "words", "items")


def _blocks(spark: SparkSession, keys: DataFrame) -> Iterator[np.ndarray]:
    """Distinct keys, sorted, ``TERM_BLOCK`` at a time."""
    keys = keys.select("key").distinct()
    parts = max(1, -(-keys.count() // TERM_BLOCK))
    for part in range(parts):
        own = keys.where(F.pmod(F.hash("key"), F.lit(parts)) == part).toArrow()["key"].to_numpy()
        yield np.sort(own.view(_U))


def _one_block(keys: DataFrame) -> np.ndarray:
    blocks = list(_blocks(keys.sparkSession, keys))
    if len(blocks) != 1:
        raise ValueError(f"more than {TERM_BLOCK} terms in one index: divide the items")
    return blocks[0]


def _members(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Which of ``keys`` are in the sorted ``wanted``; a bit table answers most of them."""
    if not len(wanted):
        return np.zeros(len(keys), bool)
    bits = max(16, (8 * len(wanted)).bit_length())
    table_ = np.zeros(1 << bits, bool)
    table_[wanted >> _U(64 - bits)] = True
    out = table_[keys >> _U(64 - bits)]
    at = np.flatnonzero(out)
    place = np.minimum(np.searchsorted(wanted, keys[at]), len(wanted) - 1)
    out[at] = wanted[place] == keys[at]
    return out


def term_counts(docs: DataFrame, text: str, terms: DataFrame) -> DataFrame:
    """(key, n): occurrences of every term in all texts, 0 for those that do not occur."""
    spark = docs.sparkSession
    texts = docs.select(F.col(text).alias("text"))
    counts = None
    for block in _blocks(spark, terms):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            wanted = shared.value
            total = np.zeros(len(wanted), np.int64)
            for batch in batches:
                for found in common.words(batch.column(0), common.ALNUM, lower=True):
                    hit = found.key[_members(found.key, wanted)]
                    total += np.bincount(np.searchsorted(wanted, hit), minlength=len(wanted))
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array(wanted[some].view(np.int64)), pa.array(total[some])], ["key", "n"])

        own = texts.mapInArrow(run, "key long, n long")
        counts = own if counts is None else counts.union(own)
    counts = counts.groupBy("key").agg(F.sum("n").alias("n"))
    return terms.select("key").distinct().join(counts, "key", "left").select(
        "key", F.coalesce("n", F.lit(0)).alias("n"))


def _runs_with(member: np.ndarray, anchor: np.ndarray, first: np.ndarray, least: int) -> np.ndarray:
    """Positions in runs of members of one document that are ``least`` long and hold an anchor."""
    edge = np.zeros(len(member) + 1, bool)
    edge[0] = edge[-1] = True
    edge[1:-1] = member[1:] != member[:-1]
    edge[first[(first > 0) & (first < len(member))]] = True
    edge = np.flatnonzero(edge)
    size = np.diff(edge)
    anchors = np.add.reduceat(anchor.astype(np.int64), edge[:-1]) if len(member) else size
    good = (size >= least) & (anchors > 0) & member[edge[:-1]] if len(member) else size > 0
    return np.repeat(good, size)


_INDEX = ("row long, doc_id long, n_words long, "
          "postings array<struct<term: string, positions: array<int>>>")


def build_index(docs: DataFrame, terms: DataFrame, anchors: DataFrame | None = None, least: int = 1,
                text: str = "text", key: str = "doc_id") -> DataFrame:
    """Positional index of the training texts: one row per input row, its postings nested.

    ``terms`` and ``anchors`` have a column ``key``. Without ``anchors`` every occurrence of a term
    is stored; with them only those in runs of ``least`` terms or more that hold an anchor.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    shared = spark.sparkContext.broadcast(
        (_one_block(terms), None if anchors is None else _one_block(anchors)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, rare = shared.value
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            n_words, postings = [], []
            for found in common.words(batch.column(1), common.ALNUM, lower=True):
                member = _members(found.key, wanted)
                if rare is not None:
                    member = _runs_with(member, _members(found.key, rare), found.first, least)
                n_words.append(np.diff(found.first))
                at = np.flatnonzero(member)
                place = np.searchsorted(at, found.first)
                for d in range(found.hi - found.lo):
                    lists: dict[str, list[int]] = {}
                    for i in at[place[d]: place[d + 1]]:
                        lists.setdefault(found.text(i), []).append(int(i - found.first[d]))
                    postings.append([{"term": t, "positions": p} for t, p in lists.items()] or None)
            n = len(postings)
            kind = pa.list_(pa.struct([("term", pa.string()), ("positions", pa.list_(pa.int32()))]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(row, row + n)), batch.column(0),
                 pa.array(np.concatenate([*n_words, np.zeros(0, int)]), pa.int64()),
                 pa.array(postings, kind)], ["row", "doc_id", "n_words", "postings"])
            row += n

    return common.settle(texts.mapInArrow(run, _INDEX), "index")


def postings(index: DataFrame) -> DataFrame:
    return index.where("postings is not null").select("row", F.explode("postings").alias("p")).select(
        "row", "p.term", "p.positions")


def rarest(found: DataFrame, terms: DataFrame, counts: DataFrame) -> DataFrame:
    """(phrase, offset, term, rank) of every word of every phrase, rarest first.

    A term that occurs twice in a phrase keeps both offsets, so that each one is checked.
    """
    keys = terms.select("term", "key").distinct().join(counts, "key").select("term", "key", "n")
    words = found.select("phrase", F.posexplode("words").alias("offset", "term")).join(keys, "term")
    order = W.partitionBy("phrase").orderBy("n", "term", "offset")
    return words.withColumn("rank", F.row_number().over(order))


def phrase_matches(index: DataFrame, ranked: DataFrame) -> DataFrame:
    """(phrase, row, start): every place where all words of a phrase stand in its order."""
    lists = postings(index)

    def starts(rank: int) -> DataFrame:
        """Position lists of the terms of this rank, shifted to the start of the phrase."""
        own = ranked.where(F.col("rank") == rank).select("phrase", "term", "offset")
        return (lists.join(own, "term").select("phrase", "row", F.explode("positions").alias("at"), "offset")
                .select("phrase", "row", (F.col("at") - F.col("offset")).alias("start"))
                .where("start >= 0"))

    length = ranked.groupBy("phrase").agg(F.count("*").alias("n"))
    one = ranked.where("rank = 1").select("phrase").join(length, "phrase")
    both = starts(1).join(starts(2), ["phrase", "row", "start"])
    single = starts(1).join(one.where("n = 1").select("phrase"), "phrase", "left_semi")
    found = common.settle(both.join(one.where("n = 2").select("phrase"), "phrase", "left_semi")
                          .union(single), "short")
    left = common.settle(both.join(one.where("n > 2"), "phrase"), "candidates")
    rest = ranked.where("rank > 2").select("phrase", "term", "offset")
    checks = (left.join(rest, "phrase")
              .select("phrase", "row", "start", "n", "term", (F.col("start") + F.col("offset")).alias("at")))
    here = lists.join(left.select("row").distinct(), "row", "left_semi")
    here = here.select("row", "term", F.explode("positions").alias("at"))
    confirmed = (checks.join(here, ["row", "term", "at"])
                 .groupBy("phrase", "row", "start", "n").agg(F.count("*").alias("ok"))
                 .where("ok = n - 2").select("phrase", "row", "start"))
    return found.union(confirmed)


def proximity_matches(index: DataFrame, ranked: DataFrame, distance: int) -> DataFrame:
    """(phrase, row, at): places of the rarest term of a phrase that have an occurrence of every other
    term within ``distance`` words, in any order. The index must hold all occurrences of the terms."""
    lists = postings(index)
    terms = ranked.groupBy("phrase", "term").agg(F.min("rank").alias("rank"))
    need = terms.groupBy("phrase").agg((F.count("*") - 1).alias("need"))
    centre = (lists.join(terms.where("rank = 1"), "term")
              .select("phrase", "row", F.explode("positions").alias("at")))
    centre = common.settle(centre, "centres")
    near = (centre.join(terms.where("rank > 1"), "phrase").join(lists, ["row", "term"])
            .where(F.exists("positions", lambda p: F.abs(p - F.col("at")) <= distance))
            .groupBy("phrase", "row", "at").agg(F.count("*").alias("have")))
    return (centre.join(need, "phrase").join(near, ["phrase", "row", "at"], "left")
            .where("coalesce(have, 0) = need").select("phrase", "row", "at"))


def contamination(docs: DataFrame, items: DataFrame, size: int = WINDOW, text: str = "text",
                  key: str = "doc_id", item_text: str = "text", item_key: str = "item_id",
                  ) -> tuple[DataFrame, DataFrame]:
    """(documents, matches). Documents: ``doc_id, n_words, n_hit, n_items, items, contaminated``, one
    row per input row; matches: ``row, phrase, start`` of every occurrence, for the rows of the index."""
    terms = common.settle(item_terms(items, item_text, item_key), "terms")
    wanted = common.settle(phrases(terms, size), "phrases")
    counts = common.settle(term_counts(docs, text, terms), "counts")
    ranked = common.settle(rarest(wanted, terms, counts), "ranked")
    alive = ranked.groupBy("phrase").agg(F.min("n").alias("n")).where("n > 0").select("phrase")
    ranked = ranked.join(alive, "phrase", "left_semi")
    least = wanted.agg(F.min(F.size("words"))).first()[0] or 1
    parts = max(1, -(-ranked.count() // TERM_BLOCK))  # no block can have more terms than words
    if parts > 1:  # rows are numbered by task: every block must scan the same files
        docs = common.settle(docs.select(key, text), "documents")
    matches = None
    for part in range(parts):
        own = ranked.where(F.pmod(F.hash("phrase"), F.lit(parts)) == part)
        index = build_index(docs, own, own.where("rank = 1"), least, text, key)
        some = common.settle(phrase_matches(index, own), "matches")
        matches = some if matches is None else matches.union(some)

    sized = matches.join(wanted.select("phrase", F.size("words").alias("n"), "items"), "phrase")
    hits = (sized.select("row", F.explode(F.sequence("start", F.col("start") + F.col("n") - 1)).alias("at"))
            .distinct().groupBy("row").agg(F.count("*").alias("n_hit")))
    named = (sized.select("row", F.explode("items").alias("item")).distinct()
             .groupBy("row").agg(F.sort_array(F.collect_set("item")).alias("items")))
    out = (index.select("row", "doc_id", "n_words").join(hits, "row", "left").join(named, "row", "left")
           .withColumn("n_hit", F.coalesce("n_hit", F.lit(0)))
           .withColumn("items", F.coalesce("items", F.array().cast("array<string>"))))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items",
                      F.expr("n_hit > 0 and 20 * n_hit >= n_words").alias("contaminated")), matches


ORACLE = f"""
WITH iw AS (SELECT DISTINCT item_id::VARCHAR AS item, regexp_extract_all(
      translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
dw AS (SELECT doc_id, regexp_extract_all(
      translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
iv AS (SELECT item, w[s: s + {WINDOW} - 1] AS v FROM (
      SELECT item, w, unnest(range(1, greatest(len(w) - {WINDOW} + 1, 1) + 1)) AS s FROM iw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT len(v) AS n FROM iv),
dv AS (SELECT doc_id, s, w[s: s + n - 1] AS v FROM (
      SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM dw, sizes WHERE len(w) >= n)),
m AS (SELECT doc_id, s, v, item FROM dv JOIN iv USING (v)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit
      FROM (SELECT doc_id, unnest(range(s, s + len(v))) AS p FROM m) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
      FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY doc_id)
SELECT doc_id, coalesce(len(w), 0)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
       coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated
FROM dw LEFT JOIN h USING (doc_id) LEFT JOIN n USING (doc_id)"""


@query("op1_decontamination", ORACLE)
def decontamination(spark, sf_dir: str) -> DataFrame:
    out, _ = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items",
                      F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def keep_clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Documents of which less than a twentieth of the words are in benchmark windows.

    Every document is judged and dropped by its own key (``common.with_document_key``): a null id, an id that
    several texts share and repeated rows change nothing. Rows with a null or empty text stay; without items all
    rows stay. All columns are kept as they are, under any names.
    """
    keyed = docs.select(F.struct(*docs.columns).alias("_all"), F.col("doc_id"), F.col("text"))
    keyed = common.with_document_key(keyed, "_key")
    out, _ = contamination(keyed, items, key="_key")
    gone = out.where("contaminated").select(F.col("doc_id").alias("_key")).distinct()
    return keyed.join(gone, "_key", "left_anti").select("_all.*")
