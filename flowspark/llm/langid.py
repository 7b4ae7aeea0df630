"""Language identification by word-first backoff.

A word that the training texts know adds its log frequency in each language. An unseen word falls
back to its character n-grams: the longest length of which at least one n-gram is known decides, and
adds the mean log frequency of the known ones. The language with the largest sum wins; ties go to
the smaller name.

The model is fitted by Spark on a bounded sample of labelled rows (``SAMPLE_DOCS`` per language,
chosen by a hash of id and text) and keeps every word and n-gram of the sample, so what tasks receive is
bounded by the sample. Prediction is one scan: no shuffle, no state, each text whole.

Edge cases: a null text, an empty text and a text without letters are ``und`` with score 0, as is
every text if no row is labelled. Rows with a null language are never learned from. Rows that agree in id,
text and language are learned from once, whether their id is null or not. Equal sums go to the smaller name.
Extra columns are kept in the result of ``predict``; columns of the names it gives its two are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowspark.llm import common
from flowspark.llm.registry import query, table

UNKNOWN = "und"
SAMPLE_DOCS = 2000
LENGTHS = (5, 4, 3, 2, 1)
#: Words from which on the score no longer grows with the length of a text.
FULL_EVIDENCE = 8
_SLICE_CHARS = 1 << 17
_SMOOTH = 0.5


class Model(NamedTuple):
    langs: list[str]
    keys: dict[int, np.ndarray]      # length (0 for words) -> sorted hashes
    scores: dict[int, np.ndarray]    # length -> log frequency, one column per language


class _Letters(NamedTuple):
    """Letter runs of a slice of lower-cased texts, each with a blank on both sides."""

    weights: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray


@lru_cache(maxsize=1)
def _letter_table() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def _letters(texts: list[str]) -> _Letters:
    """Texts are joined with a blank, so every word has a neighbour on both sides."""
    joined = " " + " ".join(texts) + " "
    codes = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
    inside = _letter_table()[codes].astype(np.int8)
    step = np.diff(inside)
    start, end = np.flatnonzero(step == 1) + 1, np.flatnonzero(step == -1) + 1
    codes = np.where(inside == 1, codes, np.uint32(32))  # every border looks the same
    upto = np.cumsum([1] + [len(t) + 1 for t in texts])
    doc = np.searchsorted(upto, start, "right") - 1
    return _Letters(common.mix(codes.astype(np.uint64) + np.uint64(1 << 40)), start, end, doc)


def _grams(words: _Letters, which: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(n-gram hashes, number of the word in ``which``); words of all lengths have borders."""
    start, end = words.start[which] - 1, words.end[which] + 1
    count = np.maximum(0, end - start - n + 1)
    owner = np.repeat(np.arange(len(which)), count)
    at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + start[owner]
    return common.span_hash(words.weights, at, at + n), owner


def _text_slices(column: pa.Array) -> Iterator[tuple[int, int, list[str]]]:
    texts = [(t or "").lower() for t in column.to_pylist()]
    upto = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    for lo, hi in common.slices(upto, _SLICE_CHARS):
        yield lo, hi, texts[lo:hi]


def _find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Row of each wanted key, -1 for those that are not there."""
    if not len(keys):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per batch and language: how often each word and each n-gram occurs."""
    for batch in batches:
        langs = batch.column(1).to_pylist()
        for lo, hi, texts in _text_slices(batch.column(0)):
            by_lang: dict[str, list[str]] = {}
            for text, lang in zip(texts, langs[lo:hi]):
                by_lang.setdefault(lang, []).append(text)
            for lang, own in by_lang.items():
                found = _letters(own)
                every = np.arange(len(found.start))
                for n in (0, *LENGTHS):
                    keys = (common.span_hash(found.weights, found.start, found.end) if n == 0
                            else _grams(found, every, n)[0])
                    keys, counts = np.unique(keys, return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(keys), n), pa.int32()), pa.array(keys.view(np.int64)),
                         pa.array([lang] * len(keys), pa.string()), pa.array(counts, pa.int64())],
                        ["n", "key", "lang", "count"])


def labelled_sample(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id",
                    per_lang: int = SAMPLE_DOCS) -> DataFrame:
    """About ``per_lang`` labelled documents of every language (all, if it has fewer), by hash of id and text.

    Documents, not rows, are drawn: rows that agree in both are one, so that copies cannot swell the sample.
    """
    rows = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang"),
                       F.xxhash64(F.col(key), F.col(key).isNull(), F.col(text)).alias("doc"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    share = rows.select("lang", "doc").distinct().groupBy("lang").agg(
        (F.lit(float(per_lang << 31)) / F.count("*")).alias("below"))
    share = common.settle(share, "shares")  # its true size, a row per language, lets texts stay in place
    drawn = rows.join(share, "lang").where(F.col("doc").bitwiseAND((1 << 31) - 1) < F.col("below"))
    return drawn.dropDuplicates(["lang", "doc"]).select("text", "lang")


def fit(labelled: DataFrame) -> Model:
    """Count words and n-grams of (text, lang) rows; the driver gets the counts of this sample."""
    counts = labelled.select("text", "lang").mapInArrow(
        _count, "n int, key long, lang string, count long")
    counts = common.settle(counts.groupBy("n", "key", "lang").agg(F.sum("count").alias("count")), "langid")
    totals = {(r["n"], r["lang"]): r["total"]
              for r in counts.groupBy("n", "lang").agg(F.sum("count").alias("total")).collect()}
    langs = sorted({lang for _, lang in totals})
    number = F.array_position(F.array(*[F.lit(lang) for lang in langs]).cast("array<string>"), F.col("lang")) - 1
    keys, scores = {}, {}
    for n in (0, *LENGTHS):
        own = counts.where(F.col("n") == n).select("key", number.cast("int").alias("lang"), "count").toArrow()
        found, row = np.unique(own["key"].to_numpy().view(np.uint64), return_inverse=True)
        table_ = np.full((len(found), len(langs)), _SMOOTH)
        table_[row, own["lang"].to_numpy()] += own["count"].to_numpy()
        norm = np.array([totals.get((n, lang), 0) + _SMOOTH * (len(found) + 1) for lang in langs])
        keys[n] = found
        scores[n] = np.log(table_ / norm).astype(np.float32)
    return Model(langs, keys, scores)


def _score(model: Model, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(sum of log frequencies, words that counted) of every text."""
    found = _letters(texts)
    each = np.zeros((len(found.start), len(model.langs)), np.float32)
    row = _find(model.keys[0], common.span_hash(found.weights, found.start, found.end))
    each[row >= 0] = model.scores[0][row[row >= 0]]
    counted = row >= 0
    for n in LENGTHS:
        left = np.flatnonzero(~counted)
        if not len(left):
            break
        grams, owner = _grams(found, left, n)
        row = _find(model.keys[n], grams)
        owner, row = owner[row >= 0], row[row >= 0]
        if not len(row):
            continue
        known = np.bincount(owner, minlength=len(left))
        edge = np.flatnonzero(np.diff(owner, prepend=-1))  # owners are in order
        sums = np.add.reduceat(model.scores[n][row], edge, axis=0)
        each[left[owner[edge]]] = sums / known[owner[edge], None]
        counted[left[known > 0]] = True
    doc = found.doc
    total = np.stack([np.bincount(doc, each[:, k], len(texts)) for k in range(each.shape[1])], 1)
    return total, np.bincount(doc, counted, len(texts)), np.bincount(doc, minlength=len(texts)) > 0


def predict(docs: DataFrame, model: Model, text: str = "text",
            keep: list[str] | None = None, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` (all columns, or those to ``keep``) with the language and its score (0 to 1: the winner's
    share of the likelihood, taken over at most ``FULL_EVIDENCE`` average words) in columns ``names``."""
    rest = [c for c in keep or docs.columns if c not in names]
    schema = T.StructType([docs.schema[c] for c in rest]
                          + [T.StructField(names[0], T.StringType()),
                             T.StructField(names[1], T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = [], []
            for lo, hi, texts in _text_slices(batch.column(batch.schema.get_field_index(_TEXT))):
                if not model.langs:
                    langs += [UNKNOWN] * (hi - lo)
                    scores += [0.0] * (hi - lo)
                    continue
                total, n, lettered = _score(model, texts)
                mean = total / np.maximum(1, n)[:, None] * np.minimum(n, FULL_EVIDENCE)[:, None]
                share = np.exp(mean - mean.max(1, keepdims=True))
                share /= share.sum(1, keepdims=True)
                best = mean.argmax(1)
                langs += [model.langs[b] if ok else UNKNOWN for b, ok in zip(best, lettered)]
                scores += np.where(lettered, share[np.arange(hi - lo), best], 0.0).tolist()
            kept = [batch.column(i) for i, c in enumerate(batch.schema.names) if c != _TEXT]
            others = [c for c in batch.schema.names if c != _TEXT]
            yield pa.RecordBatch.from_arrays(
                kept + [pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                others + list(names))

    return docs.select(*rest, F.col(text).alias(_TEXT)).mapInArrow(run, schema)


_TEXT = "_text_to_score"


def held_out(key: str = "doc_id"):
    """A third of the documents, by the CRC-32 of the id as text."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))


@query("op9_language_id")
def language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(labelled_sample(docs.where(~held_out())))
    out = predict(docs, model, keep=["doc_id"])
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


#: A document whose best language has less than this share of the likelihood is rejected.
MIN_SCORE = 0.3


def keep_identified(docs: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """Documents that have a language; those without letters or with no clear language go.

    Every row is judged on its own text, whatever its id. Where no row is labelled there is nothing to judge
    by, and all documents with a letter stay. All columns are kept as they are, under any names.
    """
    model = fit(labelled_sample(docs.where(~held_out())))
    if not model.langs:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    own = ("_lang_pred", "_lang_score")
    while set(own) & set(docs.columns):
        own = tuple("_" + c for c in own)
    found = predict(docs, model, names=own)
    return found.where((F.col(own[0]) != UNKNOWN) & (F.col(own[1]) >= min_score)).select(*docs.columns)
