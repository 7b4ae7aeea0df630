import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowspark.llm import common, resample
from tests.llm.brute import LOWER


def features(text, max_n=1):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    return len(w), [" ".join(w[i:i + n]) for n in range(1, max_n + 1) for i in range(len(w) - n + 1)]


def brute(docs, target, percent=10, least=20, max_n=1, buckets=10_000):
    counts = [[0] * buckets, [0] * buckets]
    place = lambda f: zlib.crc32(f.encode()) % buckets
    for which, texts in enumerate(([t for _, t in docs], target)):
        for t in texts:
            for f in features(t, max_n)[1]:
                counts[which][place(f)] += 1
    (raw, aim), (s, t) = counts, map(sum, counts)
    gain = [math.floor(1000 * math.log((b + 1) * (s + buckets) / ((a + 1) * (t + buckets)))) for a, b in zip(raw, aim)]
    rows = []
    for key, text in docs:
        n, own = features(text, max_n)
        h = int(hashlib.sha256(f"2024:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[place(f)] for f in own)
        rows.append([key, n, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + .5) / 2 ** 32)))])
    long = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for i, r in enumerate(rows):
        rows[i] = (*r, None)
    drawn = {}
    for i, r in enumerate(long[:percent * len(long) // 100]):
        drawn.setdefault(tuple(r), []).append(i + 1)
    out = []
    for r in rows:
        left = drawn.get(r[:5])
        out.append((*r[:5], left.pop() if left else None))
    return sorted(out, key=str)


def made(seed, n):
    r = random.Random(seed)
    words = ["Und", "the", "Ärger", "x" * 90, "ab", "日本", "a1"] + [f"w{i}" for i in range(60)]
    sep = [" ", "\n", " - ", "\x00", "/"]
    return [(i, "".join(r.choice(words) + r.choice(sep) for _ in range(r.randint(0, 60)))) for i in range(n)]


@pytest.fixture(scope="module")
def rows():
    return (made(1, 150) + [(500, None), (501, ""), (502, "?!"), (503, "the ab " * 30_000), (None, "und the " * 15)]
            + [(700, "und the ab " * 9)] * 60 + [(700, "the ab " * 30)])


@pytest.mark.parametrize("max_n, percent, least", [(1, 10, 20), (3, 35, 0), (2, 100, 5)])
def test_resample(spark, rows, max_n, percent, least):
    target = [t for _, t in made(9, 20)] + [None, ""]
    docs = spark.createDataFrame([(*r, "mine") for r in rows], "doc_id long, text string, _tie string").repartition(7)
    aim = spark.createDataFrame([(t,) for t in target], "text string")
    out = resample.resample(docs.withColumn("rank", F.lit(0)), aim, percent, least, max_n)
    got = [tuple(r) for r in out.select("doc_id", *resample.RESULT).collect()]
    assert sorted(got, key=str) == brute(rows, target, percent, least, max_n)
    ranks = sorted(r[-1] for r in got if r[-1])
    assert ranks == list(range(1, len(ranks) + 1))


def test_columns_are_carried(spark, rows):
    docs = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, _text int")
    out = resample.resample(docs, docs.limit(0), keep=["_text", "text"])
    assert sorted(r["_text"] for r in out.collect()) == list(range(len(rows)))
    assert out.where("rank is not null").count() == 10 * out.where("n_words >= 20").count() // 100
    with pytest.raises(ValueError):
        resample.resample(docs.withColumn("score", F.lit(1)), docs, keep=["score"])


def test_without_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert resample.resample(none, none).count() == 0
    few = spark.createDataFrame([(1, None), (2, "ab")], "doc_id long, text string")
    assert {tuple(r) for r in resample.resample(few, none).select("doc_id", "n_features", "weight", "rank").collect()} \
        == {(1, 0, 0, None), (2, 1, -694, None)}  # 1000 ln(10001 / 20000)


def test_kth_key_of_ties(spark):
    r = random.Random(3)
    values = [(r.choice([5, 5, 5, 9, r.randint(-50, 50)]), i) for i in range(700)]
    rows = common.settle(spark.createDataFrame(values, "a int, b long"), "keys")
    for k in (1, 2, 350, 699, 700):
        assert resample.kth_key(rows, [F.col("a"), F.col("b")], k, pivots=3) == sorted(values)[k - 1]
    assert resample.kth_key(rows, [F.col("a")], 300) == (sorted(values)[299][0],)  # equal keys are counted
    assert resample.kth_key(rows, [F.col("a"), F.col("b")], 701) is None


def test_hashes_of_words_of_any_length():
    words = [b"", b"a", b"x" * 63, b"y" * 64, b"z" * 65, bytes(range(200)), b"q" * 5000]
    data = np.frombuffer(b"".join(words), np.uint8)
    end = np.cumsum([len(w) for w in words])
    state = resample._crc_on(np.full(len(words), 0xFFFFFFFF, np.uint32), data, end - [len(w) for w in words], end)
    assert (state ^ np.uint32(0xFFFFFFFF)).tolist() == [zlib.crc32(w) for w in words]
