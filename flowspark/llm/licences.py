"""License scans by diagonal voting.

Templates are license phrases and texts. All rolling word k-gram hashes of every text are joined by Spark to
the positions of the same k-grams in the templates. A hit at text position p and template position t votes
for the diagonal p - t: a copy of a template puts all its votes on one diagonal, and a word put in or taken
out moves the rest to a neighbouring one. Votes are aggregated by diagonal; neighbouring diagonals whose
stretches follow each other are merged into one span. Spans are then verified on the words themselves: the
share of the template's words that stand at their place on one of the span's diagonals must reach
``COVERAGE``. A template marked exact must be whole on a single diagonal.

Phrases are exact templates with bigrams, so the base phrases and the longer texts take the same way. The
template table is written first and is small, so Catalyst sees its size and broadcasts it; the k-grams of
the texts are then never shuffled, only the votes are. A diagonal has at most as many votes as its template
has words. Texts are scanned twice: for the k-grams, and to verify the spans that were found; the second
scan joins spans to texts by (id, text hash), which shuffles texts only where the spans are too many to be
broadcast. A word pair that stands in a third of all rows gives rows of votes, never a group of its own.

Edge cases: null and empty texts have no words, no places and score 0. Every row is judged on its own,
repeated ones and those with a null id too. An empty table gives no rows; an empty list of templates gives
rows without places. Further columns are carried along if named in ``keep``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowspark.llm import common
from flowspark.llm.registry import query, table

#: Words of a k-gram: of texts, and of exact phrases.
GRAM, PHRASE_GRAM = 5, 2
#: Least share of a template's words on the diagonals of a span.
COVERAGE = 0.8
#: Neighbouring stretches of a span are at most this many words, and their diagonals this far, apart.
NEAR = 16
#: K-grams of a text per row.
CHUNK = 1 << 16


class Template(NamedTuple):
    label: str
    text: str
    exact: bool = False
    base: bool = False


#: The base phrases and their labels.
PHRASES = [
    ("gpl", "gnu general public license"),
    ("apache", "apache license"),
    ("cc-by", "cc by"),
    ("mit", "mit license"),
]

#: Further names of licenses.
NAMES = [
    ("agpl", "gnu affero general public license"),
    ("apache-2.0", "apache license version 2 0"),
    ("bsd", "bsd license"),
    ("bsd-2-clause", "spdx license identifier bsd 2 clause"),
    ("bsd-3-clause", "spdx license identifier bsd 3 clause"),
    ("cc-by-nc", "cc by nc"),
    ("cc-by-nd", "cc by nd"),
    ("cc-by-sa", "cc by sa"),
    ("cc0", "cc0 1 0"),
    ("cc-by", "creative commons attribution"),
    ("gpl", "spdx license identifier gpl"),
    ("gpl-2.0", "gnu general public license version 2"),
    ("gpl-3.0", "gnu general public license version 3"),
    ("isc", "isc license"),
    ("lgpl", "gnu lesser general public license"),
    ("mit", "spdx license identifier mit"),
    ("mpl", "mozilla public license"),
    ("unlicense", "the unlicense"),
]

#: Notices as they stand at the head of files.
NOTICES = [
    ("mit", """
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and
this permission notice shall be included in all copies or substantial portions of the Software."""),
    ("apache-2.0", """
you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either
express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("gpl", """
This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later
version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the
implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more
details."""),
    ("bsd", """
Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: Redistributions of source code must retain the above copyright notice, this list of
conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this
list of conditions and the following disclaimer in the documentation and/or other materials provided with the
distribution."""),
    ("isc", """
Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies."""),
    ("mpl", """
This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."""),
    ("cc-by", """
This work is licensed under a Creative Commons Attribution 4.0 International License."""),
]

TEMPLATES = [*(Template(label, text, True, True) for label, text in PHRASES),
             *(Template(label, text, True) for label, text in NAMES),
             *(Template(label, text) for label, text in NOTICES)]


def _split(texts: Sequence[str | None]) -> list[list[str]]:
    out = []
    for found in common.words(pa.array(texts, pa.string()), common.ALNUM, lower=True):
        for d in range(found.hi - found.lo):
            out.append([found.text(i) for i in range(found.first[d], found.first[d + 1])])
    return out


class _Ready(NamedTuple):
    """A template with its words and the length of its k-grams."""

    label: str
    words: list[str]
    exact: bool
    base: bool
    k: int


def _ready(templates: Sequence[Template]) -> list[_Ready]:
    """Templates with words; those without say nothing about any text."""
    split = _split([t.text for t in templates])
    return [_Ready(t.label, w, t.exact, t.base, min(len(w), PHRASE_GRAM if t.exact else GRAM))
            for t, w in zip(templates, split) if w]


def template_positions(spark: SparkSession, ready: Sequence[_Ready]) -> DataFrame:
    """(key, template, offset) of every k-gram of every template; a written table."""
    rows = []
    for i, t in enumerate(ready):
        for found in common.words(pa.array([" ".join(t.words)]), common.ALNUM, lower=False):
            keys = common.ngram_keys(found.key, t.k, t.k).view(np.int64).tolist()
            rows += [(key, i, offset) for offset, key in enumerate(keys)]
    return common.settle(spark.createDataFrame(rows, "key long, template int, offset int"), "templates")


def grams(docs: DataFrame, sizes: Sequence[int], text: str, key: str) -> DataFrame:
    """(id, h, at, key): the hash of every run of each size in ``sizes`` at every word of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for found in common.words(batch.column(2), common.ALNUM, lower=True):
                for k in sizes:
                    keys = common.ngram_keys(found.key, k, k).view(np.int64)
                    docs_, firsts, lists = [], [], []
                    for d in range(found.hi - found.lo):
                        end = min(int(found.first[d + 1]) - k + 1, len(keys))
                        for lo in range(int(found.first[d]), end, CHUNK):
                            docs_.append(d + found.lo)
                            firsts.append(lo - int(found.first[d]))
                            lists.append(keys[lo: min(lo + CHUNK, end)])
                    if not docs_:
                        continue
                    edges = np.concatenate([[0], np.cumsum([len(c) for c in lists])]).astype(np.int32)
                    arrays = pa.ListArray.from_arrays(pa.array(edges), pa.array(np.concatenate(lists)))
                    own = pa.array(docs_)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(own), batch.column(1).take(own), pa.array(firsts, pa.int32()), arrays],
                        ["id", "h", "first", "keys"])

    rows = docs.select(F.col(key).alias("id"), F.xxhash64(text).alias("h"), F.col(text).cast("string").alias("text"))
    schema = T.StructType([rows.schema["id"], *T.StructType.fromDDL("h long, first int, keys array<long>").fields])
    return rows.mapInArrow(run, schema).select("id", "h", "first", F.posexplode("keys").alias("i", "key")).select(
        "id", "h", (F.col("first") + F.col("i")).alias("at"), "key")


def diagonals(found: DataFrame, positions: DataFrame) -> DataFrame:
    """(id, h, template, diagonal, lo, hi, votes): stretch of the template and number of votes per diagonal."""
    votes = found.join(positions, "key")
    out = votes.groupBy("id", "h", "template", (F.col("at") - F.col("offset")).alias("diagonal"))
    return out.agg(F.collect_set("offset").alias("o")).select(
        "id", "h", "template", "diagonal", F.array_min("o").alias("lo"), F.array_max("o").alias("hi"),
        F.size("o").alias("votes"))


def spans(lines: DataFrame, ready: Sequence[_Ready]) -> DataFrame:
    """(id, h, spans): per text the spans to verify, each a template and its merged diagonals."""
    facts = [(i, t.exact, len(t.words) - t.k + 1, t.k) for i, t in enumerate(ready)]
    known = lines.sparkSession.createDataFrame(facts, "template int, exact boolean, need int, k int")
    lines = lines.join(F.broadcast(known), "template")  # a row per template of the list given
    whole = lines.where("exact and votes = need").select(
        "id", "h", "template", F.array("diagonal").alias("diagonals"))
    order = W.partitionBy("id", "h", "template").orderBy("start", "diagonal")
    parts = lines.where("not exact").withColumns({
        "start": F.col("diagonal") + F.col("lo"), "end": F.col("diagonal") + F.col("hi") + F.col("k")})
    upto = F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1))
    apart = F.abs(F.col("diagonal") - F.lag("diagonal").over(order))
    parts = parts.withColumn("new", F.coalesce((F.col("start") > upto + NEAR) | (apart > NEAR), F.lit(True)).cast("int"))
    parts = parts.withColumn("span", F.sum("new").over(order))
    merged = parts.groupBy("id", "h", "template", "span").agg(
        F.sort_array(F.collect_set("diagonal")).alias("diagonals")).drop("span")
    return whole.unionByName(merged).groupBy("id", "h").agg(
        F.collect_list(F.struct("template", "diagonals")).alias("spans"))


_PLACES = "array<struct<label: string, base: boolean, start: long, end: long, coverage: double>>"


def _place(words: list[str], t: _Ready, diagonals_: Sequence[int]) -> dict | None:
    """The span as a place of the text, if its words bear it out."""
    here, ends = set(), []
    for d in diagonals_:
        own = [i for i in range(max(0, -d), min(len(t.words), len(words) - d)) if words[d + i] == t.words[i]]
        here.update(own)
        ends += [d + i for i in (own[:1] + own[-1:])]
    share = len(here) / len(t.words)
    if share < (1.0 if t.exact else COVERAGE):
        return None
    return {"label": t.label, "base": t.base, "start": min(ends), "end": max(ends) + 1, "coverage": share}


def scan(docs: DataFrame, templates: Sequence[Template] = TEMPLATES, text: str = "text", key: str = "doc_id",
         keep: Sequence[str] = ()) -> DataFrame:
    """``key``, the columns to ``keep``, ``n_words`` and ``places``: label, base or not, first word, end and
    coverage of every verified span, in order of the text."""
    clash = set(keep) & {key, "n_words", "places"}
    if clash:
        raise ValueError(f"columns named like the result: {sorted(clash)}")
    spark = docs.sparkSession
    ready = _ready(templates)
    positions = template_positions(spark, ready)
    votes = diagonals(grams(docs, sorted({t.k for t in ready}), text, key), positions)
    found = common.settle(spans(common.settle(votes, "diagonals"), ready), "spans")
    rest = [key, *keep]
    shared = spark.sparkContext.broadcast(ready)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, places = [np.zeros(0, np.int64)], []
            for slice_ in common.words(batch.column(0), common.ALNUM, lower=True):
                counts.append(np.diff(slice_.first))
                for d in range(slice_.hi - slice_.lo):
                    spans_ = batch.column(1)[slice_.lo + d].as_py() or []
                    words = ([slice_.text(i) for i in range(slice_.first[d], slice_.first[d + 1])] if spans_ else [])
                    own = [_place(words, shared.value[s["template"]], s["diagonals"]) for s in spans_]
                    places.append(sorted((p for p in own if p), key=lambda p: (p["start"], p["end"], p["label"])))
            kind = pa.list_(pa.struct([("label", pa.string()), ("base", pa.bool_()), ("start", pa.int64()),
                                       ("end", pa.int64()), ("coverage", pa.float64())]))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[2:], pa.array(np.concatenate(counts), pa.int64()), pa.array(places, kind)],
                [*batch.schema.names[2:], "n_words", "places"])

    rows = docs.select(F.col(text).cast("string").alias("_text"), F.xxhash64(text).alias("_h"),
                       *[F.col(c).alias(f"_c{i}") for i, c in enumerate(rest)])
    rows = rows.join(found, F.col("_c0").eqNullSafe(F.col("id")) & (F.col("_h") == F.col("h")), "left")
    rows = rows.select("_text", "spans", *[f"_c{i}" for i in range(len(rest))])
    schema = T.StructType([*rows.schema.fields[2:],
                           *T.StructType.fromDDL(f"n_words long, places {_PLACES}").fields])
    return rows.mapInArrow(run, schema).select(
        *[F.col(f"_c{i}").alias(c) for i, c in enumerate(rest)], "n_words", "places")


def _sql_text(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _oracle() -> str:
    values = ",\n".join(f"({i}, {_sql_text(t.label)}, {_sql_text(' '.join(t.words))}, {t.exact}, {t.base}, {t.k})"
                        for i, t in enumerate(_ready(TEMPLATES)))
    return f"""
WITH tpl AS (SELECT tid, label, string_split(words, ' ') AS w, exact, base, k
  FROM (VALUES {values}) v(tid, label, words, exact, base, k)),
pos AS (SELECT tid, k, o, w[o + 1: o + k] AS gram FROM (
  SELECT *, unnest(range(len(w) - k + 1)) AS o FROM tpl)),
d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
g AS (SELECT doc_id, p, w[p + 1: p + k] AS gram FROM (
  SELECT doc_id, w, k, unnest(range(len(w) - k + 1)) AS p
  FROM d, (SELECT DISTINCT k FROM tpl) WHERE len(w) >= k)),
vote AS MATERIALIZED (SELECT doc_id, tid, p - o AS diag, min(o) AS lo, max(o) AS hi, count(DISTINCT o) AS n
  FROM g JOIN pos USING (gram) GROUP BY ALL),
seg AS (SELECT *, diag + lo AS s, diag + hi + k AS e FROM vote JOIN tpl USING (tid) WHERE NOT exact),
cut AS (SELECT *, coalesce(s > max(e) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + {NEAR}
    OR abs(diag - lag(diag) OVER w) > {NEAR}, true) AS fresh
  FROM seg WINDOW w AS (PARTITION BY doc_id, tid ORDER BY s, diag)),
span AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY doc_id, tid ORDER BY s, diag) AS span FROM cut),
seen AS (SELECT doc_id, tid, span, o FROM span JOIN d USING (doc_id), unnest(range(len(span.w))) r(o)
  WHERE diag + o >= 0 AND d.w[diag + o + 1] = span.w[o + 1]),
long AS (SELECT doc_id, label, base, NULL::BIGINT AS s, share FROM (
  SELECT doc_id, tid, span, count(DISTINCT o) / any_value(len(w)) AS share
  FROM seen JOIN tpl USING (tid) GROUP BY doc_id, tid, span) JOIN tpl USING (tid) WHERE share >= {COVERAGE}),
place AS (SELECT * FROM long UNION ALL
  SELECT doc_id, label, base, diag AS s, 1.0 AS share FROM vote JOIN tpl USING (tid)
  WHERE exact AND n = len(w) - k + 1),
r AS (SELECT doc_id, count(*) FILTER (base) AS n_base, min(s) FILTER (base) AS first_word,
    max(s) FILTER (base) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels,
    string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share)::DOUBLE AS score FROM place GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word,
  last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  coalesce(score, 0)::DOUBLE AS score
FROM d LEFT JOIN r USING (doc_id)"""


@query("op12_license_scan", _oracle())
def license_scan(spark, sf_dir: str) -> DataFrame:
    out = scan(table(spark, sf_dir, "documents"))
    base = F.filter("places", lambda p: p["base"])
    labels = lambda places: F.array_join(F.array_sort(F.array_distinct(
        F.transform(places, lambda p: p["label"]))), ",")
    return out.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda p: p["start"])).alias("first_word"),
        F.array_max(F.transform(base, lambda p: p["start"])).alias("last_word"),
        labels(base).alias("base_labels"), labels("places").alias("labels"),
        F.coalesce(F.array_max(F.transform("places", lambda p: p["coverage"])), F.lit(0.0)).alias("score"))
