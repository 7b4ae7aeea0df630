"""Streams give the result of the batch operator, survive restarts and keep bad rows apart."""

import json

import numpy as np
import pytest
from pyspark.sql import Window, functions as F

from flowspark.operators import monitor
from flowspark.operators.running_top import running_top
from flowspark.plans import stream_queries
from flowspark.plans.standins import alert_messages, alerts
from flowspark.plans.stream_queries import KEYED_ALERT
from flowspark.schemas import ALERT, REQUEST
from flowspark.sources import alert_stream, message_stream
from flowspark.streaming import (
    alert_snapshots, committed, current, dead_letter, finished, flat_alerts, latest_batch, live_latest,
    live_totals, live_workers, on_time, once, run_until_drained, save_batches, save_changes, save_closed,
    save_result, score_messages, score_stream, split_late, window_totals, write_alerts,
)

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def messages(spark):
    return alert_messages(spark, SF).persist()


@pytest.mark.parametrize("files,per_batch", [(1, None), (5, 2)])
def test_totals_for_any_arrival(spark, messages, tmp_path, files, per_batch):
    messages.repartition(files).write.json(str(tmp_path / "in"))
    stream = flat_alerts(alert_stream(spark, str(tmp_path / "in"), per_batch, KEYED_ALERT))
    run_until_drained(save_result(live_totals(stream), str(tmp_path / "out"), str(tmp_path / "c")))
    got = latest_batch(spark, str(tmp_path / "out")).first()
    want = monitor.alert_totals(alerts(spark, SF)).first()
    assert tuple(got) == pytest.approx(tuple(want))


def arrive(messages, tmp_path, part):
    messages.filter(F.col("event_id") % 1000 >= 500 if part else F.col("event_id") % 1000 < 500).write.json(
        str(tmp_path / "in" / f"part={part}")
    )


def test_restart_has_no_gaps_or_repeats(spark, messages, tmp_path):
    for part in (0, 1):
        arrive(messages, tmp_path, part)
        stream = alert_stream(spark, str(tmp_path / "in/*"), None, KEYED_ALERT)
        run_until_drained(write_alerts(stream, str(tmp_path / "out"), str(tmp_path / "c1")))
        flat = flat_alerts(stream)
        run_until_drained(save_changes(live_workers(flat), str(tmp_path / "w"), str(tmp_path / "c2"), ["key"]))
        run_until_drained(live_latest(flat, str(tmp_path / "l"), str(tmp_path / "c3")))
    out = spark.read.schema(KEYED_ALERT).json(str(tmp_path / "out"))
    assert out.count() == out.select("event_id").distinct().count() == messages.count()
    got = {r["key"]: r["value"] for r in current(spark, str(tmp_path / "w"), ["key"]).collect()}
    want = {r["key"]: r["value"] for r in monitor.worker_counts(alerts(spark, SF)).collect()}
    assert got == want
    newest = [r["event_id"] for r in latest_batch(spark, str(tmp_path / "l")).collect()]
    assert newest == [r["event_id"] for r in monitor.latest(alerts(spark, SF)).collect()]


def test_snapshots_over_batches(spark, messages, tmp_path):
    ordered = messages.withColumn("_part", F.ntile(5).over(Window.orderBy("event_id")))
    for part in range(1, 6):
        ordered.filter(F.col("_part") == part).drop("_part").write.json(str(tmp_path / "in" / f"part={part}"))
        stream = flat_alerts(alert_stream(spark, str(tmp_path / "in/*"), None, KEYED_ALERT))
        run_until_drained(
            alert_snapshots(stream, str(tmp_path / "out"), str(tmp_path / "state"), str(tmp_path / "c"))
        )
    kept = {f.name.split("=")[0] for f in (tmp_path / "state").iterdir()}
    assert kept == {"top", "totals"} and len(list((tmp_path / "state").iterdir())) == 4
    got = {r["event_id"]: r for r in finished(spark, str(tmp_path / "out")).collect()}
    batch = monitor.running_stats(alerts(spark, SF))
    want = {r["event_id"]: r for r in batch.collect()}
    tops = {r["event_id"]: r for r in running_top(
        alerts(spark, SF), {"malicious_ips": "src_ip", "targeted_ips": "dst_ip"}).collect()}
    assert set(got) == set(want)
    for key, r in got.items():
        assert r["total_packets"] == want[key]["total_packets"]
        assert r["total_malicious"] == want[key]["total_malicious"]
        assert r["avg_latency"] == pytest.approx(want[key]["avg_latency"])
        assert r["malicious_ips"] == tops[key]["malicious_ips"]
        assert r["targeted_ips"] == tops[key]["targeted_ips"]


def test_malformed_rows_go_to_dead_letters_only(spark, tmp_path):
    good = {
        "metadata": {"IPV4_SRC_ADDR": "a", "L4_SRC_PORT": 1, "IPV4_DST_ADDR": "b", "L4_DST_PORT": 2},
        "classification_time": 0.1, "latency": 0.2, "worker_name": "w", "is_malicious": True,
        "timestamp": 5,
    }
    lines = [json.dumps(good), "{broken", json.dumps({k: v for k, v in good.items() if k != "latency"})]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(lines))
    run_until_drained(
        dead_letter(message_stream(spark, str(tmp_path / "in")), ALERT, str(tmp_path / "good"),
                    str(tmp_path / "dead"), str(tmp_path / "c"))
    )
    assert spark.read.parquet(str(tmp_path / "good")).count() == 1
    dead = [r["value"] for r in spark.read.parquet(str(tmp_path / "dead")).collect()]
    assert sorted(dead) == sorted(lines[1:])


MODEL = [np.array([[1.0], [-1.0]]), np.array([0.0])]


def request(packet):
    meta = {"IPV4_SRC_ADDR": "a", "L4_SRC_PORT": 1, "IPV4_DST_ADDR": "b", "L4_DST_PORT": 2}
    return json.dumps({"send_timestamp": 0.0, "metadata": meta, "packet": packet})


def test_scored_messages(spark, tmp_path):
    lines = [request([2.0, 1.0]), request([1.0, 2.0]), request([1.0, 1.0]), request([1.0]), "nope"]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(lines))
    run_until_drained(
        score_messages(message_stream(spark, str(tmp_path / "in")), MODEL, [1.0, 1.0], [0.0, 0.0],
                       str(tmp_path / "out"), str(tmp_path / "dead"), str(tmp_path / "c"))
    )
    out = spark.read.schema(ALERT).json(str(tmp_path / "out")).toPandas()
    assert sorted(out["is_malicious"]) == [False, False, True]  # one half is not malicious
    assert out["worker_name"].str.startswith("worker-").all()
    assert (out["classification_time"] >= 0).all() and (out["latency"] > 1e9).all()
    dead = [r["value"] for r in spark.read.parquet(str(tmp_path / "dead")).collect()]
    assert sorted(dead) == sorted(lines[3:])


def test_request_files_follow_the_rows_and_are_compressed(spark, tmp_path, monkeypatch):
    """Neither a fixed number of files nor a shuffle of whole messages; alerts are compressed too."""
    monkeypatch.setattr(stream_queries, "FILE_ROWS", 500)
    path, per_batch = stream_queries._request_files(spark, SF)
    files = spark.read.text(path).inputFiles()
    assert len(files) >= 12 and per_batch == -(-len(files) // 2) and all(f.endswith(".json.gz") for f in files)
    assert spark.read.text(path).count() == spark.read.parquet(f"{SF}/lineitem.parquet").count()
    linear = [np.ones((4, 1)), np.zeros(1)]
    out = str(tmp_path / "out")
    run_until_drained(
        score_messages(message_stream(spark, path, per_batch), linear, [1.0] * 4, [0.0] * 4, out,
                       str(tmp_path / "dead"), str(tmp_path / "c"))
    )
    assert all(f.endswith(".gz") for f in spark.read.text(out).inputFiles())


def test_scaler_forms_differ(spark):
    df = spark.createDataFrame([(0.0, None, [1.0, 0.2])], REQUEST)
    scale, offset = [0.1, 1.0], [0.5, 0.0]
    right = score_stream(df, MODEL, scale, offset).first()["p"]
    legacy = score_stream(df, MODEL, scale, offset, "legacy_min").first()["p"]
    assert right == pytest.approx(1 / (1 + np.exp(-0.4))) and legacy == pytest.approx(1 / (1 + np.exp(0.15)))
    with pytest.raises(ValueError):
        score_stream(df, MODEL, scale, offset, "other")


def test_windows_close_once_and_late_alerts_stay_out(spark, tmp_path):
    """Out of order within the delay counts, beyond it does not; a null time is in no window."""
    schema = "ts timestamp_ntz, is_malicious boolean, latency double, classification_time double"

    def deliver(number, rows):
        made = [(f"2024-01-01 {t}" if t else None, bad, latency, 1.0) for t, bad, latency in rows]
        df = spark.createDataFrame(made, schema.replace("ts timestamp_ntz", "ts string"))
        df.coalesce(1).write.json(str(tmp_path / "in" / f"part={number}"))
        stream = spark.readStream.schema(schema).json(str(tmp_path / "in/*"))
        run_until_drained(save_closed(window_totals(stream, "1 hour", "1 hour"), str(tmp_path / "out"), str(tmp_path / "c")))
        rows = spark.read.parquet(str(tmp_path / "out")).orderBy("window_start").collect()
        return [(r["window_start"].hour, r["total_packets"], r["total_malicious"], r["avg_latency"]) for r in rows]

    deliver(0, [("00:10:00", True, 1.0), (None, True, 9.0), ("01:05:00", None, None)])
    deliver(1, [("00:50:00", False, 3.0), ("02:30:00", True, 5.0)])  # 00:50 is late, but within the hour
    got = deliver(2, [("00:20:00", True, 100.0), ("05:00:00", False, 2.0)])  # 00:20 comes after its window closed
    assert got == [(0, 2, 1, 2.0), (1, 1, 0, None), (2, 1, 1, 5.0)]
    whole = window_totals(spark.createDataFrame([], schema), "1 hour", "1 hour", "30 minutes")
    assert whole.count() == 0


def test_results_of_many_batches_stay_few(spark, messages, tmp_path):
    """Fifty batches leave the right answer, and a bounded number of folders to read."""
    files = messages.repartitionByRange(50, "event_id").drop("ts")
    files.write.json(str(tmp_path / "in"))
    stream = flat_alerts(alert_stream(spark, str(tmp_path / "in"), 1, KEYED_ALERT))
    w, r = str(tmp_path / "w"), str(tmp_path / "r")
    run_until_drained(save_changes(live_workers(stream), w, str(tmp_path / "c1"), ["key"], compact=7))
    run_until_drained(save_result(live_totals(stream), r, str(tmp_path / "c2"), retain=3))
    want = {x["key"]: x["value"] for x in monitor.worker_counts(alerts(spark, SF)).collect()}
    assert {x["key"]: x["value"] for x in current(spark, w, ["key"]).collect()} == want
    assert committed(spark, w, "base") == [41, 48] and committed(spark, w) == list(range(42, 50))
    assert committed(spark, r) == [47, 48, 49]
    assert latest_batch(spark, r).first()["total_packets"] == sum(want.values())


def test_repeated_base_is_the_same(spark, tmp_path):
    """A batch that is repeated after its base was written starts from the base before."""
    out = str(tmp_path)
    for n, rows in enumerate(([("a", 1), ("b", 1)], [("a", 2)], [("b", 3)])):
        spark.createDataFrame(rows, "key string, value long").write.parquet(f"{out}/batch={n}")
    for _ in range(2):
        current(spark, out, ["key"], 1).write.mode("overwrite").parquet(f"{out}/base=1")
        got = {r["key"]: r["value"] for r in current(spark, out, ["key"], 1).collect()}
        assert got == {"a": 2, "b": 1}
    assert {r["key"]: r["value"] for r in current(spark, out, ["key"]).collect()} == {"a": 2, "b": 3}


def test_replay_after_a_kill(spark, messages, tmp_path):
    """A batch is written, the stream dies before it commits: repeats and half-written folders do not count."""
    src, out, ckpt = (str(tmp_path / n) for n in ("in", "out", "c"))
    twice = messages.unionByName(messages.filter("event_id % 5 = 0"))
    twice.repartition(4, "event_id").write.json(src)
    flat = flat_alerts(alert_stream(spark, src, 2, KEYED_ALERT))

    def dies(batch, number):
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
        if number == 1:
            raise RuntimeError("killed before the commit")

    with pytest.raises(Exception, match="killed before the commit"):
        run_until_drained(
            once(flat, "event_id", "90 days").writeStream.foreachBatch(dies).option("checkpointLocation", ckpt)
        )
    assert committed(spark, out) == [0, 1]
    messages.limit(5).write.parquet(f"{out}/batch=77")  # an attempt without its marker
    (tmp_path / "out" / "batch=77" / "_SUCCESS").unlink()
    run_until_drained(save_batches(once(flat, "event_id", "90 days"), out, ckpt))
    rows = finished(spark, out)
    assert rows.count() == rows.select("event_id").distinct().count() == messages.count()
    batch = flat_alerts(twice)
    assert once(batch, "event_id", "1 day").count() == messages.count()


def test_nothing_finished_is_an_error(spark, tmp_path):
    for read in (latest_batch, finished, lambda s, p: current(s, p, ["key"])):
        with pytest.raises(FileNotFoundError):
            read(spark, str(tmp_path / "none"))
    with pytest.raises(ValueError):
        save_result(spark.readStream.format("rate").load(), "p", "c", retain=1)


def test_streamed_network_decides_as_in_batch(spark):
    from flowspark.operators import score
    from flowspark.plans.model_queries import packet_vector, wide_network
    from flowspark.plans.standins import table
    from flowspark.plans.stream_queries import stream_score_full
    from flowspark.schemas import FEATURES

    net = wide_network()
    assert [t.shape[0] for t in net[::4]] == [len(FEATURES), 512, 256, 128, 96, 48]
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    rows = score.score(
        table(spark, SF, "lineitem").select(*keys, F.array(*packet_vector()).alias("v")), net, "v"
    )
    want = sorted(
        (f"10.0.0.{r['l_suppkey']}", r["l_linenumber"], f"192.168.0.{r['l_partkey']}", r["l_orderkey"], r["logit"] > 0)
        for r in rows.collect()
    )
    assert sorted(map(tuple, stream_score_full(spark, SF).collect())) == want
    assert {w[-1] for w in want} == {True, False}


def deliver_late(spark, tmp_path, number, rows, slide=None):
    schema = "id long, ts string, is_malicious boolean, latency double, classification_time double"
    made = [(i, f"2024-01-01 {t}" if t else None, True, 1.0, 1.0) for i, t in rows]
    spark.createDataFrame(made, schema).coalesce(1).write.json(str(tmp_path / "in" / f"part={number}"))
    stream = spark.readStream.schema(schema.replace("ts string", "ts timestamp_ntz")).json(str(tmp_path / "in/*"))
    good, late, state, out = (str(tmp_path / n) for n in ("good", "late", "state", "out"))
    run_until_drained(split_late(stream, good, late, state, str(tmp_path / "c1"), "1 hour", "30 minutes", slide))
    windows = window_totals(
        on_time(spark, good, stream.schema), "1 hour", "30 minutes", slide, closed="_closed"
    )
    run_until_drained(save_closed(windows, out, str(tmp_path / "c2")))
    aside = {r["id"]: r["reason"] for r in finished(spark, late).collect()}
    closed = {
        r["window_start"].strftime("%H:%M"): r["total_packets"] for r in spark.read.parquet(out).collect()
    }
    return aside, closed


def test_late_alerts_are_kept_aside(spark, tmp_path):
    """Each alert is counted or kept aside; a window that ends exactly at the mark is closed."""
    aside, _ = deliver_late(spark, tmp_path, 0, [(1, "00:10:00"), (2, None), (3, "02:30:00"), (3, "02:30:00")])
    assert aside == {2: "no time"}  # nothing is late in the first batch, the mark is at 02:00 after it
    aside, _ = deliver_late(spark, tmp_path, 1, [(4, "01:59:59.999999"), (5, "02:00:00"), (6, "00:20:00")])
    assert aside == {2: "no time", 4: "closed", 6: "closed"}
    aside, closed = deliver_late(spark, tmp_path, 2, [(7, "09:00:00")])
    assert aside == {2: "no time", 4: "closed", 6: "closed"} and closed == {"00:00": 1, "02:00": 3}


def test_alert_late_for_some_of_its_windows(spark, tmp_path):
    """Windows of an hour, one every 20 minutes: an alert counts in those that are open."""
    deliver_late(spark, tmp_path, 0, [(1, "02:30:00")], "20 minutes")
    aside, _ = deliver_late(spark, tmp_path, 1, [(2, "01:45:00"), (3, "02:00:00")], "20 minutes")
    assert aside == {2: "partly closed"}  # the window from 01:00 is closed, those from 01:20 and 01:40 are open
    aside, closed = deliver_late(spark, tmp_path, 2, [(4, "09:00:00")], "20 minutes")
    assert aside == {2: "partly closed"}
    assert closed == {"01:20": 2, "01:40": 3, "02:00": 2, "02:20": 1}


def test_repeated_batch_judges_as_at_first(spark, tmp_path):
    """Without the commit of its last batch, a stream repeats it: nothing is written or lost twice."""
    deliver_late(spark, tmp_path, 0, [(1, "00:10:00"), (2, "03:00:00")])
    first, _ = deliver_late(spark, tmp_path, 1, [(3, "00:30:00"), (4, "03:10:00")])
    newest = max(int(f.name) for f in (tmp_path / "c1" / "commits").iterdir() if f.name.isdigit())
    (tmp_path / "c1" / "commits" / str(newest)).unlink()
    (tmp_path / "c1" / "commits" / f".{newest}.crc").unlink(missing_ok=True)
    again, closed = deliver_late(spark, tmp_path, 2, [(5, "09:00:00")])
    assert first == again == {3: "closed"}
    assert sorted(r["id"] for r in finished(spark, str(tmp_path / "good")).collect()) == [1, 2, 4, 5]
    assert closed == {"00:00": 1, "03:00": 2}


def test_late_split_of_nothing(spark, tmp_path):
    aside, closed = deliver_late(spark, tmp_path, 0, [(1, None)])
    assert aside == {1: "no time"} and closed == {}
    aside, closed = deliver_late(spark, tmp_path, 1, [(2, "00:10:00")])
    assert aside == {1: "no time"}  # no time came before, so no window is closed
