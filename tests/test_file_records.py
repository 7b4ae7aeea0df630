"""The data source of files: what is found, how files are cut, what is no record, and streams of it."""

import json
import os

import pytest
from pyspark.sql import types as T

from flowspark.sources import register_file_records
from flowspark.sources.file_records import Slice, _Reader
from flowspark.streaming import finished, run_until_drained, save_batches


def put(root, name, text, changed=None):
    path = root / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text.encode() if isinstance(text, str) else text)
    if changed:
        os.utime(path, ns=(changed, changed))


def load(spark, root, schema, **options):
    register_file_records(spark)
    reader = spark.read.format("file_records").schema(schema).option("path", str(root))
    for key, value in options.items():
        reader = reader.option(key, value)
    return reader.load()


def test_files_by_prefix_and_extension(spark, tmp_path):
    line = '{"a": 1}\n'
    for name in ("w1.json", "deep/er/w2.json", "x.json", "w3.txt", ".w4.json", "_w5.json", "_gone/w6.json"):
        put(tmp_path, name, line)
    rows = load(spark, tmp_path, "a long, _file string", prefix="w")
    assert sorted(r["_file"] for r in rows.collect()) == ["deep/er/w2.json", "w1.json"]
    assert load(spark, f"file://{tmp_path}", "a long", prefix="w", extension=".txt").count() == 1
    assert load(spark, tmp_path, "a long", prefix="none").collect() == []


@pytest.mark.parametrize("block", [1, 2, 7, 40, 10_000])
@pytest.mark.parametrize("end", ["\n", ""])
def test_cuts_lose_and_repeat_no_line(tmp_path, block, end):
    """Blocks of any size, shorter than a line or right behind one, give each line once with its number."""
    texts = [json.dumps({"a": i, "s": "é" * (i % 9)}, ensure_ascii=False) for i in range(30)]
    texts[5] = texts[17] = ""
    put(tmp_path, "a.json", "\n".join(texts) + end)
    put(tmp_path, "b.json", '{"a": 100}\r\n{"a": 101}')
    put(tmp_path, "empty.json", "")
    schema = T.StructType.fromDDL("a long, s string, _file string, _line long")
    reader = _Reader(schema, {"path": str(tmp_path), "block": str(block)})
    rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    want = [(i, "é" * (i % 9), "a.json", i + 1) for i in range(30) if i not in (5, 17)]
    want += [(100, None, "b.json", 1), (101, None, "b.json", 2)]
    assert sorted(tuple(r.values()) for r in rows) == want
    for part in reader.partitions():
        assert isinstance(part, Slice) and sum(e - s for _, s, e in part.parts) <= block


def test_rejected_lines(spark, tmp_path):
    bad = [
        "{cut", "[1]", "7", '{"a": "1"}', '{"a": 1.5}', '{"a": true}', '{"a": 9223372036854775808}',
        '{"d": "2024-13-01"}', '{"v": [1, "x"]}', '{"m": {"k": 1}}', '{"s": "\\ud800"}', "[" * 100_000,
        '{"p": 1.234}', '{"p": Infinity}', '{"f": ' + "9" * 400 + "}", '{"b": 128}',
    ]
    good = '{"a": 1, "d": "2024-02-29", "v": [1, null, 2.5], "m": {"k": "x"}, "s": "", "p": 1.25, "more": 1}'
    put(tmp_path, "a.json", "\n".join([*bad, good, "{}", '{"a": null}', "  "]))
    put(tmp_path, "b.json", b'{"s": "\xff"}\n')
    fields = "a long, d date, v array<double>, m struct<k:string>, s string, p decimal(5,2), f double, b tinyint"
    rows = load(spark, tmp_path, fields + ", _bad string, _file string, _line long").collect()
    by_line = {(r["_file"], r["_line"]): r for r in rows}
    assert len(rows) == len(bad) + 4
    for i, text in enumerate(bad):
        row = by_line["a.json", i + 1]
        assert row["_bad"] == text and all(row[c] is None for c in "advmspfb")
    assert by_line["b.json", 1]["_bad"] == '{"s": "�"}'
    row = by_line["a.json", len(bad) + 1]
    assert (row["a"], str(row["d"]), row["v"], row["m"]["k"], row["s"], str(row["p"])) == (
        1, "2024-02-29", [1.0, None, 2.5], "x", "", "1.25"
    )
    with pytest.raises(Exception, match=r"a.json, line 1: "):
        load(spark, tmp_path, fields + ", _line long").collect()


def test_options(spark, tmp_path):
    for options in ({}, {"path": str(tmp_path), "block": "0"}):
        with pytest.raises(ValueError):
            _Reader(T.StructType(), options)
    with pytest.raises(Exception, match="gone"):
        load(spark, tmp_path / "gone", "a long").collect()
    with pytest.raises(Exception, match="schema"):
        register_file_records(spark)
        spark.read.format("file_records").option("path", str(tmp_path)).load()


def test_stream_takes_each_file_once(spark, tmp_path):
    """Over restarts, with files of one time, and after files taken before are removed."""
    src, out, ckpt = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "c")
    src.mkdir()
    register_file_records(spark)

    def drain():
        stream = spark.readStream.format("file_records").schema("a long").option("path", str(src)).load()
        run_until_drained(save_batches(stream, out, ckpt))
        return sorted(r["a"] for r in finished(spark, out).collect())

    put(src, "b.json", '{"a": 1}\n{"a": 2}', 1_000_000_000)
    put(src, "a.json", '{"a": 3}', 1_000_000_000)
    assert drain() == [1, 2, 3]
    assert drain() == [1, 2, 3]
    put(src, "c.json", '{"a": 4}', 1_000_000_000)
    put(src, "a2.json", '{"a": 5}', 2_000_000_000)
    assert drain() == [1, 2, 3, 4, 5]
    (src / "a2.json").unlink()
    assert drain() == [1, 2, 3, 4, 5]
    put(src, "d.json", '{"a": 6}', 3_000_000_000)
    assert drain() == [1, 2, 3, 4, 5, 6]
