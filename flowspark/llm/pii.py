"""Personal data: four pattern kinds, widened by a linear-chain conditional random field.

The patterns find e-mail addresses, IP addresses, card numbers (Luhn) and phone numbers with a country
prefix; what they find stays. The random field reads the words around digits and ``@`` by their shape
(digits, letters, signs, lengths, neighbours) and labels them begin / inside of a kind or outside. It is
trained on the small table below by gradient steps on the exact likelihood (forward and backward sums)
and decoded by Viterbi for many sequences at once. Its spans are added where they do not touch a
pattern's span: local phone numbers, spelled-out addresses, grouped card numbers.

Prediction is one scan without a shuffle. Only the neighbourhood of words that hold a digit, ``@`` or a
spelled-out sign is labelled (``CONTEXT`` words on both sides); all other words are outside by definition. Sequences are
padded in groups of similar length with a bound on cells, so memory does not depend on the text.

Edge cases: null and empty texts have no spans. Positions are code points, ends exclusive. Repeated rows
are judged each on its own; extra columns are carried along by ``find``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowspark.llm.registry import query, table

KINDS = ("email", "ip", "card", "phone")
CONTEXT = 2
_CELLS = 200_000

#: The small labelled table; [kind|text] marks a span.
LABELLED = """
Please write to [email|anna.kunz@mail.example.org] before noon.
contact: [email|info@shop.example.com]. Thanks!
send it to [email|jo_smith99@uni.example.edu], please
mail [email|sales at firm dot example dot com] for prices
reach me under [email|j.doe (at) post (dot) example (dot) net] or later
his address is [email|maria at correo dot example dot es] now
the server [ip|10.0.0.17] answered twice
from [ip|192.168.4.20] to [ip|172.16.0.9] in one hop
login at [ip|8.8.4.4], then wait
host [ip|2001:db8:0:0:8:800:200c:417a] is down
paid with [card|4111 1111 1111 1111] today
card [card|5500-0000-0000-0004] expires soon
number [card|4012888888881881] was used
charge [card|3782 822463 10005] please
call [phone|+1 (212) 555-0142] now
telephone [phone|+49 30 1234567] or [phone|+33 1 70 18 99 00]
ring [phone|(212) 555-0187] after six
my number is [phone|555-867-5309], call
Tel. [phone|030 9876543] in the evening
call [phone|0171 2345678] or [phone|0049 171 2345678]
phone: [phone|555.010.7788] office
fax [phone|(030) 55 12 34 56] only
on 2023-04-17 we met 12 people
the year 1998 and 2004 were good
it costs 12.50 or 1,299.00 euro
version 1.2.3 of the tool, build 20231104
page 17 of 240, section 3.4.1
room 305 at 14:30 on 3 May
order 123456 has 3 items at 9.99 each
we are 7 at 12 and leave at 10
chapter 12 verse 7 line 3000
in 1984 about 25000 of 40000 voted
a ratio of 3:2 or 16:9 and 100% of 50
key a8f3c2d19b77e0 and hash 9c1d22ff08ab
ids x123y and abc99 or 7zip
"4fj29dk3l1m0q8" is not a number
meet at 5 dot or so, look at 3 things
take 10 at once and dot the i
"""


class Sequence(NamedTuple):
    words: list[str]
    spans: list[tuple[int, int]]
    tags: list[int] | None


_TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|\S")
_TAGS = ["O"] + [f"{p}-{k}" for k in KINDS for p in "BI"]


def _shape(word: str) -> str:
    if word.isascii() and word.isdigit():
        return f"d{min(len(word), 7)}"
    if word.isalpha():
        return ("x" if word.islower() else "X") + ("1" if len(word) == 1 else "+")
    return word


def _features(words: list[str], spans: list[tuple[int, int]]) -> list[list[str]]:
    """Names of the features of every word: shapes of it and its neighbours, and whether they touch."""
    shapes = ["^", "^", *map(_shape, words), "$", "$"]
    touch = [False] + [a[1] == b[0] for a, b in zip(spans[:-1], spans[1:])] + [False]
    low = [w.lower() if w.isalpha() and len(w) < 9 else "" for w in words]
    out = []
    for i in range(len(words)):
        s = shapes[i: i + 5]
        left, right = touch[i], touch[i + 1]
        out.append(["1", f"w{s[2]}", f"l{s[1]}{left:d}", f"r{s[3]}{right:d}", f"ll{s[0]}", f"rr{s[4]}",
                    f"lw{s[1]}|{s[2]}{left:d}", f"wr{s[2]}|{s[3]}{right:d}",
                    f"t{s[1]}|{s[2]}|{s[3]}{left:d}{right:d}", f"v{low[i]}"])
    return out


def _labelled() -> list[Sequence]:
    out = []
    for line in LABELLED.strip().splitlines():
        text, marks = "", []
        for part in re.split(r"(\[\w+\|[^\]]*\])", line):
            m = re.fullmatch(r"\[(\w+)\|([^\]]*)\]", part)
            if m:
                marks.append((m[1], len(text), len(text) + len(m[2])))
            text += m[2] if m else part
        found = list(_TOKEN.finditer(text))
        tags = []
        for t in found:
            own = [(k, a) for k, a, b in marks if a <= t.start() and t.end() <= b]
            tags.append(0 if not own else _TAGS.index(("B-" if own[0][1] == t.start() else "I-") + own[0][0]))
        out.append(Sequence([t[0] for t in found], [t.span() for t in found], tags))
    return out


class Field(NamedTuple):
    index: dict[str, int]     # feature -> row of weights
    weights: np.ndarray       # features x tags
    moves: np.ndarray         # tags x tags
    first: np.ndarray         # tags


def _allowed() -> tuple[np.ndarray, np.ndarray]:
    """Inside follows begin or inside of its kind only."""
    n = len(_TAGS)
    moves, first = np.zeros((n, n)), np.zeros(n)
    for j, tag in enumerate(_TAGS):
        if tag[0] == "I":
            first[j] = -1e9
            for i, before in enumerate(_TAGS):
                if before[1:] != tag[1:]:
                    moves[i, j] = -1e9
    return moves, first


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis)) + np.squeeze(top, axis)


def train(rows: list[Sequence], steps: int = 300, rate: float = 0.1, decay: float = 2e-3) -> Field:
    """Maximum likelihood with weight decay, by Adam on the whole table."""
    names = [_features(r.words, r.spans) for r in rows]
    index: dict[str, int] = {}
    for row in names:
        for word in row:
            for f in word:
                index.setdefault(f, len(index))
    n_tags, width, n = len(_TAGS), max(len(r.words) for r in rows), len(rows)
    each = len(names[0][0])
    which = np.full((n, width, each), len(index))
    tags, inside = np.zeros((n, width), int), np.zeros((n, width), bool)
    for i, r in enumerate(rows):
        which[i, : len(r.words)] = [[index[f] for f in w] for w in names[i]]
        tags[i, : len(r.words)], inside[i, : len(r.words)] = r.tags, True
    base_moves, base_first = _allowed()
    size = (len(index) + 1) * n_tags
    params = np.zeros(size + n_tags * n_tags + n_tags)
    m, v = np.zeros_like(params), np.zeros_like(params)
    one = np.eye(n_tags)
    for step in range(1, steps + 1):
        weights = params[:size].reshape(-1, n_tags)
        moves = params[size: size + n_tags ** 2].reshape(n_tags, n_tags) + base_moves
        first = params[size + n_tags ** 2:] + base_first
        score = weights[which].sum(2)
        ahead, back = np.zeros_like(score), np.zeros_like(score)
        ahead[:, 0] = first + score[:, 0]
        for t in range(1, width):
            new = score[:, t] + _lse(ahead[:, t - 1, :, None] + moves, 1)
            ahead[:, t] = np.where(inside[:, t, None], new, ahead[:, t - 1])
        for t in range(width - 2, -1, -1):
            new = _lse(moves + (score[:, t + 1] + back[:, t + 1])[:, None, :], 2)
            back[:, t] = np.where(inside[:, t + 1, None], new, 0)
        total = _lse(ahead[:, -1], 1)
        node = np.exp(ahead + back - total[:, None, None]) * inside[:, :, None]
        gap = one[tags] * inside[:, :, None] - node
        grad = np.zeros_like(params)
        by_weight = np.zeros((len(index) + 1, n_tags))
        np.add.at(by_weight, which.reshape(-1), np.repeat(gap.reshape(-1, n_tags), each, 0))
        edge = np.exp(ahead[:, :-1, :, None] + moves + (score + back)[:, 1:, None, :]
                      - total[:, None, None, None]) * inside[:, 1:, None, None]
        true = one[tags[:, :-1]][..., None] * one[tags[:, 1:]][:, :, None, :] * inside[:, 1:, None, None]
        grad[:size] = by_weight.ravel()
        grad[size: size + n_tags ** 2] = (true - edge).sum((0, 1)).ravel()
        grad[size + n_tags ** 2:] = gap[:, 0].sum(0)
        grad = grad / n - decay * params
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad ** 2
        params += rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    weights = params[:size].reshape(-1, n_tags)[:-1]
    return Field(index, weights, params[size: size + n_tags ** 2].reshape(n_tags, n_tags) + base_moves,
                 params[size + n_tags ** 2:] + base_first)


def viterbi(field: Field, scores: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Best tags of padded sequences: ``scores`` is sequences x words x tags."""
    n, width, n_tags = scores.shape
    best = field.first + scores[:, 0]
    back = np.zeros((n, width, n_tags), np.int8)
    back[:, 0] = np.arange(n_tags)
    for t in range(1, width):
        step = best[:, :, None] + field.moves
        back[:, t] = step.argmax(1)
        new = step.max(1) + scores[:, t]
        best = np.where((t < lengths)[:, None], new, best)
    tags = np.zeros((n, width), np.int8)
    at = best.argmax(1)
    for t in range(width - 1, -1, -1):
        here = t < lengths
        tags[here, t] = at[here]
        at = np.where(here, back[np.arange(n), t, at], at)
    return tags


def label(field: Field, rows: list[Sequence]) -> list[np.ndarray]:
    """Tags of every sequence; neighbours in length share a padded batch."""
    out: list[np.ndarray] = [np.zeros(0, np.int8)] * len(rows)
    order = sorted(range(len(rows)), key=lambda i: len(rows[i].words))
    at = 0
    while at < len(order):
        end = at + 1
        while end < len(order) and (end - at + 1) * len(rows[order[end]].words) <= _CELLS:
            end += 1
        part, at = order[at:end], end
        lengths = np.array([len(rows[i].words) for i in part])
        scores = np.zeros((len(part), max(1, lengths.max()), len(_TAGS)))
        for k, i in enumerate(part):
            rows_of = [[field.index[f] for f in w if f in field.index]
                       for w in _features(rows[i].words, rows[i].spans)]
            for t, which in enumerate(rows_of):
                scores[k, t] = field.weights[which].sum(0)
        tags = viterbi(field, scores, lengths)
        for k, i in enumerate(part):
            out[i] = tags[k, : lengths[k]]
    return out


_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def _digits(text: str) -> str:
    return re.sub(r"[^0-9]", "", text)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the patterns, by kind in the order of ``KINDS``, then by start. Linear in the text: an
    address is looked for around each ``@``, a dotted number from the start of its first digits."""
    out, upto = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > upto and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        host = _DOMAIN.match(text, at + 1) if start < at else None
        if host:
            out.append(("email", start, host.end()))
            upto = host.end()
        at = text.find("@", max(at + 1, upto))
    out += [("ip", *m.span()) for m in _IP.finditer(text)
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = _digits(m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return out


_MARKED = re.compile(r"[0-9@]")
#: The bare word "at" counts only before a word and a "dot", as it is in every other sentence.
_SPELLED = re.compile(r"(?i)\(at\)|\(dot\)|\bdot\b|\bat(?=\s+\S+\s+\(?dot\b)")


def islands(text: str) -> list[Sequence]:
    """Words around digits, ``@`` and spelled-out signs, as sequences to label."""
    if not (_MARKED.search(text) or _SPELLED.search(text)):
        return []
    blocks = [m.span() for m in re.finditer(r"\S+", text)]
    begin = [a for a, _ in blocks]
    near = np.zeros(len(blocks), bool)
    marks = {int(np.searchsorted(begin, m.start(), "right")) - 1
             for p in (_MARKED, _SPELLED) for m in p.finditer(text)}
    for i in marks:
        near[max(0, i - CONTEXT): i + CONTEXT + 1] = True
    edge = np.flatnonzero(np.diff(np.concatenate([[0], near.astype(np.int8), [0]])))
    out = []
    for a, b in zip(edge[::2], edge[1::2]):
        found = list(_TOKEN.finditer(text, blocks[a][0], blocks[b - 1][1]))
        if found:
            out.append(Sequence([t[0] for t in found], [t.span() for t in found], None))
    return out


def _field_spans(rows: list[Sequence], tags: list[np.ndarray]) -> list[tuple[str, int, int]]:
    out = []
    for row, own in zip(rows, tags):
        i = 0
        while i < len(own):
            if not own[i]:
                i += 1
                continue
            j = i + 1
            while j < len(own) and own[j] and _TAGS[own[j]][0] == "I":
                j += 1
            out.append((_TAGS[own[i]][2:], row.spans[i][0], row.spans[j - 1][1]))
            i = j
    return out


def _plausible(kind: str, text: str) -> bool:
    """What an added span must hold at least to be of its kind."""
    n = len(_digits(text))
    if kind == "email":
        return ("@" in text or " at " in text.lower() or "(at)" in text.lower()) and (
            "." in text or "dot" in text.lower())
    if kind == "ip":
        return text.count(":") >= 3 or all(
            p.isascii() and p.isdigit() and len(p) <= 3 and int(p) <= 255
            for p in text.split(".")) and text.count(".") == 3
    return 13 <= n <= 19 and luhn(_digits(text)) if kind == "card" else 7 <= n <= 15


@lru_cache(maxsize=1)
def default_field() -> Field:
    return train(_labelled())


_SPANS = T.ArrayType(T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()),
    T.StructField("end", T.LongType())]))


def find(docs: DataFrame, text: str = "text", field: Field | None = None,
         keep: list[str] | None = None) -> DataFrame:
    """``docs`` (all columns, or those to ``keep``) with ``base`` (spans of the patterns) and ``spans``
    (those and the added ones)."""
    field = field or default_field()
    rest = [c for c in keep or docs.columns if c not in ("base", "spans")]
    schema = T.StructType([docs.schema[c] for c in rest]
                          + [T.StructField("base", _SPANS), T.StructField("spans", _SPANS)])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def listed(spans: list[tuple[str, int, int]]) -> list[dict]:
        return [{"kind": k, "start": a, "end": b}
                for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(batch.schema.get_field_index(_TEXT)).to_pylist()]
            base = [base_spans(t) for t in texts]
            rows = [islands(t) for t in texts]
            tags = iter(label(shared.value, [r for own in rows for r in own]))
            every = []
            for text_, own, found in zip(texts, rows, base):
                added = _field_spans(own, [next(tags) for _ in own])
                taken = sorted((a, b) for _, a, b in found)
                begins = [a for a, _ in taken]
                highest = np.maximum.accumulate([b for _, b in taken]) if taken else []
                free = []
                for k, a, b in added:
                    i = int(np.searchsorted(begins, b)) - 1
                    if (i < 0 or highest[i] <= a) and _plausible(k, text_[a:b]):
                        free.append((k, a, b))
                every.append(found + free)
            names = [c for c in batch.schema.names if c != _TEXT]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in names]
                + [pa.array([listed(s) for s in base], kind), pa.array([listed(s) for s in every], kind)],
                [*names, "base", "spans"])

    return docs.select(*rest, F.col(text).alias(_TEXT)).mapInArrow(run, schema)


_TEXT = "_text_to_search"


def _written(spans: str) -> F.Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


@query("op10_personal_data")
def personal_data(spark, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"), keep=["doc_id"])
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in KINDS],
                        F.sha2(_written("base"), 256).alias("base_sha256"), _written("spans").alias("spans"))
