import random
import re

import pytest
from pyspark.sql import functions as F

from flowspark.llm import licences
from flowspark.llm.licences import Template
from tests.llm.brute import LOWER


def split(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(text, templates):
    """Places of one text by the rule: votes per diagonal, spans of neighbours, words compared."""
    w, out = split(text), []
    for t in templates:
        own = split(t.text)
        k = min(len(own), licences.PHRASE_GRAM if t.exact else licences.GRAM)
        if not own:
            continue
        if t.exact:
            out += [(t.label, t.base, i, i + len(own), 1.0) for i in range(len(w) - len(own) + 1)
                    if w[i:i + len(own)] == own]
            continue
        lines = {}
        for i in range(len(w) - k + 1):
            for j in range(len(own) - k + 1):
                if w[i:i + k] == own[j:j + k]:
                    lines.setdefault(i - j, []).append(j)
        stretches = sorted((d + min(o), d, d + max(o) + k) for d, o in lines.items())
        groups, upto, last = [], None, None
        for start, d, end in stretches:
            if upto is None or start > upto + licences.NEAR or abs(d - last) > licences.NEAR:
                groups.append([])
            upto = end if upto is None else max(upto, end)
            groups[-1].append(d)
            last = d
        for g in groups:
            here = {(j, d + j) for d in g for j in range(len(own)) if 0 <= d + j < len(w) and w[d + j] == own[j]}
            share = len({j for j, _ in here}) / len(own)
            if share >= licences.COVERAGE:
                at = [i for _, i in here]
                out.append((t.label, t.base, min(at), max(at) + 1, share))
    return sorted(out, key=lambda p: (p[2], p[3], p[0]))


MIT = next(text for label, text in licences.NOTICES if label == "mit")


def edited(seed, text, each):
    r = random.Random(seed)
    w = text.split()
    for i in range(each, len(w), each):
        kind = r.randrange(3)
        w[i] = f"new{i}" if kind == 0 else "" if kind == 1 else f"{w[i]} put in"
    return " ".join(w)


@pytest.fixture(scope="module")
def rows():
    filler = "an ordinary text with words of no license "
    out = [None, "", " .. ", "MIT License", "mit\nlicense, MIT-LICENSE and Mit license!", "licensed under CC BY-NC 4.0",
           "GNU General Public License, version 2 or the Apache License", filler * 4 + MIT + filler * 3, MIT + " " + MIT,
           "of the " * 3000 + "cc by " * 2000, filler * 900 + MIT.upper(), " ".join(MIT.split()[:60])]
    out += [filler + edited(i, MIT, each) + filler for i, each in enumerate((40, 20, 12, 9, 7, 4))]
    out += [edited(70, text, 25) for _, text in licences.NOTICES]
    return [(i, t) for i, t in enumerate(out)] + [(None, MIT), (None, "cc by"), (3, "apache license"), (3, "MIT License"),
                                                  *[(90, "the cc by license")] * 30]


def test_scan(spark, rows):
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, places string").repartition(5)
    got = [(r["doc_id"], r["n_words"], [tuple(p) for p in r["places"]]) for r in licences.scan(docs).collect()]
    want = [(k, len(split(t)), brute(t, licences.TEMPLATES)) for k, t in rows]
    assert sorted(got, key=str) == sorted(want, key=str)
    found = {k: {p[0] for p in places} for k, _, places in want if k is not None and k != 3}
    assert found[7] == found[10] == {"mit"} and found[11] == set() and found[5] == {"cc-by", "cc-by-nc"}
    assert found[6] >= {"gpl", "gpl-2.0", "apache"}
    assert {"mit"} == found[12] == found[13] and found[17] == set()
    assert len([p for k, _, ps in want if k == 8 for p in ps]) == 2


def test_other_templates_and_columns(spark):
    templates = [Template("one", "Word"), Template("two", "a b a b", exact=True), Template("none", "..."),
                 Template("three", "x y z", exact=True, base=True)]
    rows = [(1, "word", 5), (2, "A b a b a B", 6), (3, "x y x y z", 7)]
    docs = spark.createDataFrame(rows, "k int, body string, template int")
    out = licences.scan(docs, templates, "body", "k", keep=["template", "body"])
    assert out.columns == ["k", "template", "body", "n_words", "places"]
    got = {r["k"]: (r["template"], [tuple(p) for p in r["places"]]) for r in out.collect()}
    assert got == {k: (n, brute(t, templates)) for k, t, n in rows}
    assert len(got[2][1]) == 2
    with pytest.raises(ValueError):
        licences.scan(docs.withColumn("places", F.lit(1)), templates, "body", "k", keep=["places"])


def test_without_rows_or_templates(spark):
    docs = spark.createDataFrame([(1, "mit license"), (2, None)], "doc_id long, text string")
    assert licences.scan(docs.limit(0)).count() == 0
    got = [tuple(r) for r in licences.scan(docs, []).collect()]
    assert sorted(got) == [(1, 2, []), (2, 0, [])]
