import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from flowspark.llm import codes

SCHEMA = "vec_id long, embedding array<float>, label int, code string, _v int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, g, "mine", 7) for i, v, g in rows], SCHEMA)


def brute(rows, parts, entries, rounds, scale=256):
    """The contract on lists: (id, code, error, error of the label), codebooks."""
    kept = [(i, [int(np.floor(scale * float(np.float32(x)))) for x in v], g) for i, v, g in rows
            if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    width = len(kept[0][1]) // parts if kept else 0
    cut = lambda v, p: v[p * width:(p + 1) * width]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[list(cut(v, p)) for _, v, _ in first] for p in range(parts)]

    def nearest(p, v):
        far = [sum((a - b) ** 2 for a, b in zip(cut(v, p), e)) for e in books[p]]
        return far.index(min(far)), min(far)

    for _ in range(rounds):
        chosen = [[nearest(p, v)[0] for _, v, _ in kept] for p in range(parts)]
        for p in range(parts):
            for e in range(len(books[p])):
                own = [cut(v, p) for (_, v, _), c in zip(kept, chosen[p]) if c == e]
                if own:
                    books[p][e] = [sum(xs) // len(own) for xs in zip(*own)]
    out = []
    for i, v, g in kept:
        found = [nearest(p, v) for p in range(parts)]
        out.append((i, "".join(f"{e:02x}" for e, _ in found), sum(d for _, d in found), g))
    sums = {}
    for _, _, error, g in out:
        sums[g] = sums.get(g, 0) + error
    return sorted(((i, c, e, sums[g]) for i, c, e, g in out), key=str), books


@pytest.mark.parametrize("n", [3, 200])
def test_codes(spark, n):
    r = np.random.default_rng(n)
    rows = [(i * 3, [float(x) for x in r.normal(0, .4, 8)], int(r.integers(0, 3)) or None) for i in range(n)]
    rows += [(7, None, 1), (8, [None] * 8, 1), (9, [float("nan")] + [0.0] * 7, 1), (10, [float("inf")] * 8, None),
             (11, [0.0] * 8, 1), (None, [0.25] * 8, 2), (0, [-0.5] * 8, 2), *[(5, [0.1] * 8, None)] * 40]
    out, books = codes.compress(vectors(spark, rows).repartition(5), parts=2, keep=["label", "_v"])
    assert out.columns == ["vec_id", "label", "_v", "code", "error"]
    out = codes.with_group_error(out, "label").select("vec_id", "code", "error", "label_error")
    want, own = brute(rows, 2, 64, 2)
    assert sorted(map(tuple, out.collect()), key=str) == want
    assert books.tolist() == own


def test_odd_vectors_take_no_part(spark):
    rows = [(1, [0.5] * 4, 1), (2, [0.5] * 6, 1), (3, [0.25] * 4, 1), (4, [0.5] * 3, 1), (5, [], 1), (6, [1e30] * 4, 1)]
    out, _ = codes.compress(vectors(spark, rows), parts=2)
    assert sorted(r["vec_id"] for r in out.collect()) == [1, 3]
    none, books = codes.compress(vectors(spark, []), parts=2, keep=["label"])
    assert codes.with_group_error(none, "label").count() == 0 and books.size == 0
    with pytest.raises(ValueError):
        codes.compress(vectors(spark, rows), keep=["code"])
    with pytest.raises(ValueError):
        codes.compress(vectors(spark, rows), parts=2, entries=65)


def test_decoded_vectors_are_their_entries(spark):
    rows = [(i, [i / 8, -i / 8, i / 4, 1.0], i) for i in range(6)]
    out, books = codes.compress(vectors(spark, rows), parts=2, rounds=0)
    back = codes.decoded(out.withColumn("vector", F.lit("old")), books)
    assert {r["vec_id"]: list(r["vector"]) for r in back.collect()} == {i: v for i, v, _ in rows}


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10 ** 6), st.integers(1, 64), st.integers(1, 5), st.integers(1, 40))
def test_masks_hold_every_nearest_entry(seed, entries, width, reach):
    r = np.random.default_rng(seed)
    book = codes.sliced(r.integers(-reach, reach + 1, (entries, width)))
    points = r.integers(-2 * reach, 2 * reach + 1, (50, width))
    far = ((points[:, None, :] - book.entries[None]) ** 2).sum(2)
    mask, radius = codes.candidates(book, points)
    inside = (mask[:, None] >> np.arange(entries).astype(np.uint64)) & np.uint64(1) == 1
    assert inside[far <= radius[:, None]].all() and (far.min(1) <= radius).all()
    best, least = codes.nearest_entry(book, points)
    assert (best == far.argmin(1)).all() and (least == far.min(1)).all()
