"""Token ids of whole texts by the ``tokenizers`` library, one call per distinct piece of text.

A byte-level BPE vocabulary first splits a text into pieces (a word with its leading blank, a number,
punctuation, white space) and merges within pieces only. The pieces are found here for a slice of
texts at once, on arrays of code points; every distinct piece is encoded by the library's model and
looked up for its other occurrences. The ids are those of encoding each text whole (tested against that).
The strings of the vocabulary's added tokens (``<|endoftext|>``) are one id each wherever they stand in a
text, as in the library; the parts between them are split into pieces as texts of their own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex

from flowspark.llm import common

SLICE_CHARS = 1 << 18
#: Pieces whose ids a Python worker keeps.
CACHE_PIECES = 800_000

_LETTER, _NUMBER, _OTHER, _SPACE = 1, 2, 3, 0
#: The code points with the Unicode property White_Space.
_WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F,
          0x205F, 0x3000]


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Class of every code point: letter, number, white space or other."""
    points = [*range(0xD800), *range(0xE000, 0x110000)]
    every = "".join(map(chr, points))
    out = np.full(0x110000, _OTHER, np.int8)
    for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+")):
        for m in regex.finditer(pattern, every):
            out[points[m.start()]: points[m.end() - 1] + 1] = kind
    out[_WHITE] = _SPACE
    return out


def _byte_signs() -> dict[int, str]:
    """The sign by which a byte-level vocabulary writes each byte: printable Latin-1 characters stand
    for themselves, the other bytes, in order, for the characters from 256 on."""
    own = [b for b in range(256) if 33 <= b < 127 or 161 <= b < 256 and b != 173]
    other = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(other)}


_BYTE_SIGNS = _byte_signs()


def piece_starts(codes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where pieces begin in texts laid end to end; text d is ``codes[bounds[d]:bounds[d + 1]]``.

    The rules are those of the vocabulary's split pattern (``public_tokenizers.PATTERN``): runs of one
    class with one blank before them; of a run of white space the last character is on its own or is
    that blank; ``'s 't 're 've 'm 'll 'd`` after something other than a blank.
    """
    n = len(codes)
    if not n:
        return np.zeros(0, np.int64)
    kind = _classes()[codes]
    edge = np.zeros(n + 1, bool)
    edge[bounds[bounds <= n]] = True
    change = edge.copy()
    change[1:n] |= kind[1:] != kind[:-1]
    change[n] = True
    run = np.flatnonzero(change)
    a, b = run[:-1], run[1:]
    white = kind[a] == _SPACE
    last = edge[b]  # the run ends its text
    start = np.zeros(n + 1, bool)
    start[a[white]] = True
    split = white & ~last
    start[b[split] - 1] = True
    solid = a[~white]
    blank = np.zeros(len(solid), bool)
    inner = ~edge[solid]
    blank[inner] = codes[solid[inner] - 1] == 32
    start[solid[~blank]] = True

    quote = solid[~blank & (codes[solid] == 39)]
    if len(quote):
        text_end = bounds[np.searchsorted(bounds, quote, "right")]
        one = np.where(quote + 1 < text_end, codes[np.minimum(quote + 1, n - 1)], 0)
        two = np.where(quote + 2 < text_end, codes[np.minimum(quote + 2, n - 1)], 0)
        size = np.zeros(len(quote), np.int64)
        size[np.isin(one, [ord(c) for c in "stmd"])] = 2
        size[np.isin(one, [ord(c) for c in "rv"]) & (two == ord("e"))] = 3
        size[(one == ord("l")) & (two == ord("l"))] = 3
        quote, size = quote[size > 0], size[size > 0]
        start[quote + 1] = False
        start[quote + size] = True
    return np.flatnonzero(start[:n])


_NOTHING = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
_RECENT = 50_000


def _joined(a: tuple, b: tuple) -> tuple[np.ndarray, np.ndarray]:
    keys, place = np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]])
    order = np.argsort(keys, kind="stable")
    return keys[order], place[order]


class Encoder:
    """Encodes slices of texts; keeps the ids of the pieces it has seen."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder()
        if any(t.single_word or t.lstrip or t.rstrip for t in added.values()):
            raise ValueError("added tokens that depend on their neighbours are not supported")
        self.added = {t.content: i for i, t in added.items()}
        longest = sorted(self.added, key=len, reverse=True)  # of those that begin at one place
        self.marks = re.compile(f"({'|'.join(map(re.escape, longest))})") if longest else None
        self.clear()

    def clear(self) -> None:
        self.known = [_NOTHING, _NOTHING]    # sorted (hash, place) of pieces: the old and the recent
        self.begin = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.uint32)

    def _learn(self, keys: np.ndarray, pieces: list[str]) -> None:
        merge = self.tokenizer.model.tokenize
        ids = [[t.id for t in merge(p.encode().decode("latin-1").translate(_BYTE_SIGNS))] for p in pieces]
        size = np.array([len(i) for i in ids], np.int64)
        flat = np.fromiter((t for i in ids for t in i), np.uint32, int(size.sum()))
        place = np.arange(len(keys)) + len(self.size)
        self.begin = np.concatenate([self.begin, len(self.pool) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.pool = np.concatenate([self.pool, flat])
        self.known[1] = _joined(self.known[1], (keys, place))
        if len(self.known[1][0]) > _RECENT:
            self.known = [_joined(*self.known), _NOTHING]

    def _find(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1)
        for known, place in self.known:
            if len(known):
                at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                hit = known[at] == keys
                out[hit] = place[at[hit]]
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts end to end, where each text begins; one more entry at the end)."""
        split = [self.marks.split(t) if self.marks else [t] for t in texts]
        ids, first = self._encode_plain([part for own in split for part in own[::2]])
        bounds = np.concatenate([[0], np.cumsum([len(own) // 2 + 1 for own in split])]).astype(np.int64)
        added = [self.added[mark] for own in split for mark in own[1::2]]
        if not added:
            return ids, first
        later = np.ones(len(first), bool)  # parts with a mark before them
        later[bounds] = False
        return (np.insert(ids, first[later], added),
                first[bounds] + np.concatenate([[0], np.cumsum(later)])[bounds])

    def _encode_plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        joined = "".join(texts)
        codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        start = piece_starts(codes, bounds)
        end = np.append(start[1:], len(codes))[: len(start)]
        weights = common.mix(codes.astype(np.uint64) + np.uint64(1))
        which, keys = pd.factorize(common.span_hash(weights, start, end))
        if len(self.size) > CACHE_PIECES:
            self.clear()
        place = self._find(keys)
        new = np.flatnonzero(place < 0)
        if len(new):
            seen = np.zeros(len(keys), np.int64)
            seen[which[::-1]] = np.arange(len(which))[::-1]  # first occurrence
            place[new] = np.arange(len(new)) + len(self.size)
            self._learn(keys[new], [joined[start[i]: end[i]] for i in seen[new]])
        place = place[which]
        size = self.size[place]
        upto = np.concatenate([[0], np.cumsum(size)])
        flat = self.pool[np.arange(upto[-1]) + np.repeat(self.begin[place] - upto[:-1], size)]
        return flat, upto[np.searchsorted(start, bounds)]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encoded(column: pa.Array, path: str) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(lo, hi, ids, first) of the rows lo .. hi-1 of a text column; null counts as empty."""
    tool = encoder(path)
    texts = [t or "" for t in column.to_pylist()]
    upto = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    for lo, hi in common.slices(upto, SLICE_CHARS):
        ids, first = tool.encode(texts[lo:hi])
        yield lo, hi, ids, first


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """Place of a public vocabulary file on this machine; tasks look it up on theirs."""
    import public_tokenizers

    return public_tokenizers.path(name)
