import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from flowspark.llm import catalog, common, decontaminate, jaccard, langid, lines
from tests.llm import brute

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language ID", "line dedup", "near duplicates", "decontamination", "packing"]
    tables = [docs]
    for name, stage in corpus_pipeline.STAGES:
        tables.append(common.settle(stage(spark, tables[-1], SF), "stage"))
    assert all(t.columns == docs.columns for t in tables[:-1])
    rows = [{r["doc_id"]: r for r in t.collect()} for t in tables[:-1]]
    assert set(rows[0]) - set(rows[1]) == {
        k for k, r in rows[0].items() if not re.search(r"[^\W\d_]", r["text"] or "")}
    assert all(r["text"] and r["n_chars"] == len(r["text"]) for r in rows[2].values())
    want = brute.components([(k, r["text"]) for k, r in rows[2].items()])
    assert set(rows[3]) == {k for k, _, c in want if k == c}
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    judged = brute.decontaminated([(k, r["text"]) for k, r in rows[3].items()], items)
    assert set(rows[4]) == {k for k, *_, bad in judged if not bad}
    packed = tables[-1].collect()
    assert {r["doc_id"] for r in packed} == set(rows[4])


def test_every_operator_has_its_query():
    assert {int(q[2:].split("_")[0]) for q in catalog.QUERIES} == set(range(1, 14))


CLASH = ["lang_pred", "score", "n_lines", "n_removed", "row", "node", "component_id", "_key", "_all", "n_chars"]
WIDE = "doc_id long, text string, lang string, source string, " + ", ".join(f"{c} int" for c in CLASH)


def wide(spark, rows):
    """Documents with nulls in their other columns and columns named like those the stages make."""
    return spark.createDataFrame([(k, t, None, None, *range(77, 77 + len(CLASH))) for k, t in rows], WIDE).repartition(3)


def kept(df):
    assert df.columns == [c.split()[0] for c in WIDE.split(", ")]
    rows = df.collect()
    assert all(tuple(r)[4:-1] == tuple(range(77, 76 + len(CLASH))) for r in rows)
    return sorted(((r["doc_id"], r["text"]) for r in rows), key=str)


def prose(seed, n=60):
    return " ".join(random.Random(seed).choices([f"w{i}" for i in range(500)], k=n))


def test_language_stage_by_row(spark):
    rows = [(None, prose(1)), (None, prose(1)), (3, "12 !"), (3, prose(2)), (4, None), (5, "")]
    want = sorted([r for r in rows if r[1] and "w" in r[1]], key=str)
    assert kept(langid.keep_identified(wide(spark, rows))) == want  # nothing is labelled
    labelled = wide(spark, rows).withColumn("lang", F.lit("xx"))
    assert kept(langid.keep_identified(labelled)) == want
    assert kept(langid.keep_identified(wide(spark, rows).limit(0))) == []


def test_line_stage_by_row(spark):
    shared = "\n".join(prose(i, 8) for i in range(40))
    rows = [(1, shared), (2, shared + "\nown end"), (None, "alone\nhere"), (None, None), (3, ""), (4, "x"), (4, "x")]
    got = kept(lines.drop_repeated_lines(wide(spark, rows)))
    assert [r for r in got if r[0] != 2] == sorted([r for r in rows if r[0] != 2], key=str)
    own = dict(got)[2]
    assert own.endswith("own end") and len(own) < len(shared) / 2
    assert kept(lines.drop_repeated_lines(wide(spark, []))) == []


def test_near_duplicate_stage_by_row(spark):
    near = prose(5).split()
    near[30] = "edited"
    rows = [(None, prose(5)), (None, prose(5)), (3, prose(5)), (3, prose(5)), (3, prose(6)), (7, " ".join(near)),
            (None, prose(8)), (9, None), (9, None), (10, ""), (11, ""), (12, prose(9)), (12, prose(10)), (13, prose(10))]
    want = [(3, prose(5)), (3, prose(6)), (None, prose(8)), (9, None), (10, ""), (11, ""), (12, prose(9)), (12, prose(10))]
    assert kept(jaccard.keep_one(wide(spark, rows))) == sorted(want, key=str)
    plain = [(1, prose(20)), (2, prose(20)), (3, prose(21)), (None, prose(20))]
    assert kept(jaccard.keep_one(wide(spark, plain))) == [(1, prose(20)), (3, prose(21))]
    assert kept(jaccard.keep_one(wide(spark, []))) == []


def test_decontamination_stage_by_row(spark):
    items = spark.createDataFrame([(1, prose(30, 40)), (2, None)], "item_id long, text string")
    bad = prose(31, 10) + " " + prose(30, 40)
    rows = [(None, bad), (None, prose(32)), (5, bad), (5, prose(33)), (5, prose(33)), (6, None), (7, ""), (8, bad)]
    assert kept(decontaminate.keep_clean(wide(spark, rows), items)) == sorted(
        [r for r in rows if r[1] != bad], key=str)
    assert kept(decontaminate.keep_clean(wide(spark, rows), items.limit(0))) == sorted(rows, key=str)
    assert kept(decontaminate.keep_clean(wide(spark, []), items)) == []


@pytest.mark.parametrize("stage", range(4))
def test_stages_of_the_pipeline_keep_their_columns(spark, stage):
    docs = wide(spark, [(None, prose(1)), (2, prose(2)), (2, prose(3))])
    out = corpus_pipeline.STAGES[stage][1](spark, docs, SF)
    assert out.columns == docs.columns and out.count() == 3
