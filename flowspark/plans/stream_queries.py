"""Streaming queries. Each writes its input as message files, runs the job until the source is
drained and returns what the job wrote."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from flowspark.operators import scaling, score
from flowspark.operators.monitor import ranked
from flowspark.operators.running_top import running_top
from flowspark.plans.model_queries import _LOGIT, _RANGE, packet_vector, wide_network, wide_network_sql
from flowspark.plans.monitor_queries import TOTALS, _top
from flowspark.plans.prepare_queries import r6
from flowspark.plans.registry import query
from flowspark.plans.standins import (
    ALERTS, CUT_TEXT, FLOW_FEATURES, KEYED_ALERT, LINEAR_BIAS, LINEAR_WEIGHTS, alert_messages, alerts,
    message_texts, table,
)
from flowspark.schemas import ALERT, FEATURES, REQUEST, SNAPSHOT, parse_messages
from flowspark.session import scratch_path, spread
from flowspark.sources import alert_stream, message_stream, register_file_records, request_stream, write_json
from flowspark.streaming import (
    alert_snapshots, current, dead_letter, finished, flat_alerts, latest_batch, live_latest, live_top,
    live_totals, live_workers, on_time, once, run_until_drained, save_batches, save_changes, save_closed,
    save_result, score_messages, snapshot_messages, snapshots, split_late, window_totals, write_alerts,
)

def _alert_source(spark, sf, files: int = 6, per_batch: int = 2):
    """Alerts as files, read back as a stream of several batches."""
    path = scratch_path(spark, "alert_messages")
    write_json(alert_messages(spark, sf).repartitionByRange(files, "event_id"), path)
    return alert_stream(spark, path, per_batch, KEYED_ALERT)


#: Rows of a compressed file of messages, and files of a batch at most.
FILE_ROWS, BATCH_FILES = 50_000, 240


def _request_files(spark, sf, packet=FLOW_FEATURES) -> tuple[str, int]:
    """Requests as files, which follow the splits of the table and its rows; the folder, and how many of them make a
    batch (two batches or more). Rows stay where they are: messages are several times as large as their rows."""
    path = scratch_path(spark, "requests")
    write_json(_requests(spark, sf, packet), path, rows_per_file=FILE_ROWS)
    return path, min(BATCH_FILES, max(1, -(-len(spark.read.text(path).inputFiles()) // 2)))


def _requests(spark, sf, packet=FLOW_FEATURES):
    columns = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate", *FLOW_FEATURES]
    line = spread(table(spark, sf, "lineitem").select(*columns))
    metadata = F.struct(
        F.concat(F.lit("10.0.0."), F.col("l_suppkey").cast("string")).alias("IPV4_SRC_ADDR"),
        F.col("l_linenumber").alias("L4_SRC_PORT"),
        F.concat(F.lit("192.168.0."), F.col("l_partkey").cast("string")).alias("IPV4_DST_ADDR"),
        F.col("l_orderkey").cast("int").alias("L4_DST_PORT"),
    )
    sent = F.unix_micros(F.col("l_shipdate").cast("timestamp")) / 1e6
    return line.select(
        sent.alias("send_timestamp"), metadata.alias("metadata"),
        F.array(*packet).alias("packet"),
    )


REQUEST_KEY = """'10.0.0.' || l_suppkey AS src, l_linenumber AS sport,
  '192.168.0.' || l_partkey AS dst, CAST(l_orderkey AS INTEGER) AS dport"""


def _flat_key():
    names = {"src": "IPV4_SRC_ADDR", "sport": "L4_SRC_PORT", "dst": "IPV4_DST_ADDR", "dport": "L4_DST_PORT"}
    return [F.col(f"metadata.{path}").alias(name) for name, path in names.items()]


_VECTOR = ", ".join(f"{c} AS f{i}" for i, c in enumerate(FLOW_FEATURES))


@query("stream_requests", f"SELECT {REQUEST_KEY}, {_VECTOR} FROM lineitem")
def stream_requests(spark, sf):
    out, ckpt = scratch_path(spark, "out"), scratch_path(spark, "ckpt")
    stream = request_stream(spark, *_request_files(spark, sf))
    run_until_drained(
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", ckpt)
    )
    rows = spark.read.schema(REQUEST).parquet(out)
    return rows.select(
        *_flat_key(),
        *[F.get("packet", F.lit(i)).alias(f"f{i}") for i in range(len(FLOW_FEATURES))],
    )


@query("stream_alerts", f"WITH {ALERTS} SELECT event_id, src_ip, dst_ip, latency, worker FROM alerts")
def stream_alerts(spark, sf):
    out, ckpt = scratch_path(spark, "out"), scratch_path(spark, "ckpt")
    flat = flat_alerts(_alert_source(spark, sf))
    run_until_drained(
        flat.writeStream.format("parquet").option("path", out).option("checkpointLocation", ckpt)
    )
    return spark.read.parquet(out).select("event_id", "src_ip", "dst_ip", "latency", "worker")


@query("datasource_stream", f"WITH {ALERTS} SELECT event_id, src_ip, dst_ip, latency, worker FROM alerts")
def datasource_stream(spark, sf):
    """Alert files as a stream of the registered format, in two arrivals; the second run resumes."""
    path, out, ckpt = (scratch_path(spark, n) for n in ("alert_files", "out", "ckpt"))
    messages = alert_messages(spark, sf)
    register_file_records(spark)
    for odd in (0, 1):
        write_json(messages.filter(F.col("event_id") % 2 == odd), f"{path}/run={odd}")
        reader = spark.readStream.format("file_records").schema(KEYED_ALERT).option("path", path)
        run_until_drained(save_batches(flat_alerts(reader.load()), out, ckpt))
    return finished(spark, out).select("event_id", "src_ip", "dst_ip", "latency", "worker")


@query("stream_alert_sink", f"WITH {ALERTS} SELECT src_ip, dst_ip, worker, is_malicious FROM alerts")
def stream_alert_sink(spark, sf):
    out, ckpt = scratch_path(spark, "alerts"), scratch_path(spark, "ckpt")
    stream = _alert_source(spark, sf).drop("event_id", "ts")
    run_until_drained(write_alerts(stream, out, ckpt))
    rows = flat_alerts(spark.read.schema(ALERT).json(out))
    return rows.select("src_ip", "dst_ip", "worker", "is_malicious")


@query(
    "stream_score",
    f"""WITH f AS (SELECT {_RANGE} FROM lineitem)
    SELECT {REQUEST_KEY}, {LINEAR_BIAS}e0 + {_LOGIT} > 0 AS is_malicious FROM lineitem, f""",
)
def stream_score(spark, sf):
    out, dead, ckpt = (scratch_path(spark, n) for n in ("out", "dead", "ckpt"))
    fit = scaling.fit_minmax(table(spark, sf, "lineitem"), FLOW_FEATURES)
    scale, offset = score.scaler_arrays(fit, FLOW_FEATURES)[""]
    linear = [np.array(LINEAR_WEIGHTS)[:, None], np.array([LINEAR_BIAS])]
    messages = message_stream(spark, *_request_files(spark, sf))
    run_until_drained(score_messages(messages, linear, scale, offset, out, dead, ckpt))
    rows = spark.read.schema(ALERT).json(out)
    return rows.select(*_flat_key(), "is_malicious")


@query(
    "stream_score_full",
    f"""WITH keyed AS (SELECT {REQUEST_KEY}, {', '.join(FLOW_FEATURES)} FROM lineitem),
    {wide_network_sql('src, sport, dst, dport', 'keyed')}
    SELECT src, sport, dst, dport, logit > 0 AS is_malicious FROM z""",
)
def stream_score_full(spark, sf):
    """Messages of 39 features, classified by the published network."""
    out, dead, ckpt = (scratch_path(spark, n) for n in ("out", "dead", "ckpt"))
    one, zero = np.ones(len(FEATURES)), np.zeros(len(FEATURES))
    messages = message_stream(spark, *_request_files(spark, sf, packet_vector()))
    run_until_drained(score_messages(messages, wide_network(), one, zero, out, dead, ckpt))
    rows = spark.read.schema(ALERT).json(out)
    return rows.select(*_flat_key(), "is_malicious")


@query("stream_dead_letter", f"SELECT {CUT_TEXT} AS value FROM events WHERE event_id % 50 = 7")
def stream_dead_letter(spark, sf):
    path, good, dead, ckpt = (scratch_path(spark, n) for n in ("messages", "good", "dead", "ckpt"))
    texts = message_texts(spark, sf).repartitionByRange(4, "event_id").select("value")
    texts.write.text(path)
    run_until_drained(dead_letter(message_stream(spark, path, 2), ALERT, good, dead, ckpt))
    return spark.read.schema("value string").parquet(dead).select("value")


@query("stream_totals", f"WITH {ALERTS} {TOTALS}")
def stream_totals(spark, sf):
    out, ckpt = scratch_path(spark, "totals"), scratch_path(spark, "ckpt")
    run_until_drained(save_result(live_totals(flat_alerts(_alert_source(spark, sf))), out, ckpt))
    return latest_batch(spark, out).select(
        "total_packets", "total_malicious", r6("avg_latency"), r6("avg_classification_time")
    )


@query("stream_top", _top("src_ip"))
def stream_top(spark, sf):
    out, ckpt = scratch_path(spark, "top"), scratch_path(spark, "ckpt")
    top = live_top(flat_alerts(_alert_source(spark, sf)), "src_ip")
    run_until_drained(save_result(top, out, ckpt))
    return ranked(latest_batch(spark, out))


@query("stream_workers", f"WITH {ALERTS} SELECT worker AS key, count(*) AS value FROM alerts GROUP BY worker")
def stream_workers(spark, sf):
    out, ckpt = scratch_path(spark, "workers"), scratch_path(spark, "ckpt")
    run_until_drained(save_changes(live_workers(flat_alerts(_alert_source(spark, sf))), out, ckpt, ["key"]))
    return current(spark, out, ["key"])


@query(
    "stream_latest",
    f"""WITH {ALERTS} SELECT event_id, src_ip, dst_ip, is_malicious, latency FROM alerts
    ORDER BY ts DESC, event_id DESC LIMIT 8""",
)
def stream_latest(spark, sf):
    out, ckpt = scratch_path(spark, "latest"), scratch_path(spark, "ckpt")
    run_until_drained(live_latest(flat_alerts(_alert_source(spark, sf)), out, ckpt))
    return latest_batch(spark, out).select("event_id", "src_ip", "dst_ip", "is_malicious", "latency")


def _as_of(col: str) -> str:
    """SQL: the five top addresses after each alert, by rank (none before the first malicious one)."""
    return f"""placed AS (SELECT event_id, ts, is_malicious, {col} AS key,
      count(*) FILTER (WHERE is_malicious) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS nth FROM alerts),
    bad AS (SELECT * FROM placed WHERE is_malicious),
    names AS (SELECT DISTINCT key FROM bad),
    seen AS (SELECT bad.nth, names.key,
      sum(CAST(bad.key = names.key AS INTEGER)) OVER (PARTITION BY names.key ORDER BY bad.ts, bad.event_id
        ROWS UNBOUNDED PRECEDING) AS value FROM bad CROSS JOIN names),
    best AS (SELECT nth, key, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (
      PARTITION BY nth ORDER BY value DESC, key DESC) AS INTEGER) AS rank FROM seen WHERE value > 0
      QUALIFY rank <= 5),
    listed AS (SELECT event_id, best.key, value, rank FROM placed JOIN best USING (nth))"""


def _listed(rows, col: str):
    items = rows.select("event_id", F.posexplode(col).alias("_i", "_t"))
    return items.select("event_id", (F.col("_i") + 1).alias("rank"), "_t.key", "_t.value")


@query("running_top_sources", f"WITH {ALERTS}, {_as_of('src_ip')} SELECT event_id, rank, key, value FROM listed")
def running_top_sources(spark, sf):
    return _listed(running_top(alerts(spark, sf), {"top": "src_ip"}), "top")


@query(
    "stream_snapshots",
    f"""WITH {ALERTS}, r AS (SELECT event_id, row_number() OVER w AS total_packets,
      count(*) FILTER (WHERE is_malicious) OVER w AS total_malicious,
      round(sum(latency) OVER w, 6) / row_number() OVER w AS avg_latency,
      round(sum(classification_time) OVER w, 6) / row_number() OVER w AS avg_classification_time
      FROM alerts WINDOW w AS (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)), {_as_of('dst_ip')}
    SELECT r.*, listed.rank, listed.key, listed.value FROM r JOIN listed USING (event_id)""",
)
def stream_snapshots(spark, sf):
    path, out, state, ckpt = (
        scratch_path(spark, n) for n in ("alert_messages", "snapshots", "state", "ckpt")
    )
    messages = alert_messages(spark, sf)
    third = F.least(F.floor(F.dayofmonth("ts") / 11), F.lit(2))
    for part in range(3):  # three arrivals in time order; each run resumes from the checkpoint
        write_json(messages.filter(third == part), f"{path}/part={part}")
        stream = flat_alerts(alert_stream(spark, f"{path}/*", None, KEYED_ALERT))
        run_until_drained(alert_snapshots(stream, out, state, ckpt))
    rows = finished(spark, out)
    n = F.col("total_packets")
    means = ["avg_latency", "avg_classification_time"]
    stats = rows.select(
        "event_id", "total_packets", "total_malicious",
        *[(F.round(F.col(c) * n, 6) / n).alias(c) for c in means],
    )
    return stats.join(_listed(rows, "targeted_ips"), "event_id")


@query(
    "snapshot_messages",
    f"""WITH {ALERTS} SELECT event_id % 60000 AS port, true AS valid, row_number() OVER (ORDER BY ts, event_id) AS total_packets,
      dst_ip FROM alerts""",
)
def messages(spark, sf):
    rows = snapshots(flat_alerts(alert_messages(spark, sf)))
    sent = snapshot_messages(rows).select(F.to_json(F.struct("*")).alias("value"))
    back = parse_messages(sent, "value", SNAPSHOT)
    return back.select(
        (F.col("message.packet_info.metadata.L4_SRC_PORT") - 1024).cast("long").alias("port"), "valid",
        F.col("message.stats.total_packets").alias("total_packets"),
        F.col("message.packet_info.metadata.IPV4_DST_ADDR").alias("dst_ip"),
    )


def _closed_sql(hours: int, slide: int) -> str:
    """SQL of the windows (of ``hours``, one every ``slide`` hours) that end two days before the last alert."""
    first = f"time_bucket(INTERVAL {slide} HOUR, ts, TIMESTAMP '1970-01-01') - INTERVAL (k * {slide}) HOUR"
    return f"""WITH {ALERTS}, placed AS (SELECT *, {first} AS window_start FROM alerts, range({hours // slide}) r(k))
    SELECT window_start, window_start + INTERVAL {hours} HOUR AS window_end, count(*) AS total_packets,
      count(*) FILTER (WHERE is_malicious) AS total_malicious, round(avg(latency), 6) AS avg_latency,
      round(avg(classification_time), 6) AS avg_classification_time
    FROM placed GROUP BY window_start
    HAVING window_start + INTERVAL {hours} HOUR <= (SELECT max(ts) - INTERVAL 2 DAY FROM alerts)"""


def _closed(spark, sf, size: str, slide: str | None):
    """Alerts arrive up to a day late, in four deliveries; the stream is stopped and resumed between them."""
    path, out, ckpt = (scratch_path(spark, n) for n in ("alert_messages", "windows", "ckpt"))
    messages = alert_messages(spark, sf)
    late = F.pmod(F.xxhash64("event_id"), F.lit(86400))
    arrival = F.unix_micros(F.col("ts").cast("timestamp")) + late * 1_000_000
    ends = messages.agg(F.percentile_approx(arrival, [0.25, 0.5, 0.75]).alias("e")).first()["e"]
    part = sum(((arrival > e).cast("int") for e in ends[1:]), (arrival > ends[0]).cast("int"))
    for number in range(len(ends) + 1):
        write_json(messages.filter(part == number), f"{path}/part={number}")
        stream = flat_alerts(alert_stream(spark, f"{path}/*", None, KEYED_ALERT))
        run_until_drained(save_closed(window_totals(stream, size, "2 days", slide), out, ckpt))
    return spark.read.parquet(out).select(
        "window_start", "window_end", "total_packets", "total_malicious", r6("avg_latency"),
        r6("avg_classification_time"),
    )


@query("stream_window_totals", _closed_sql(24, 24))
def stream_window_totals(spark, sf):
    return _closed(spark, sf, "1 day", None)


@query("stream_sliding_totals", _closed_sql(24, 6))
def stream_sliding_totals(spark, sf):
    return _closed(spark, sf, "24 hours", "6 hours")


#: SQL: alerts, the delivery of each, up to when windows were closed for it, and the ends of its windows
#: (of 24 hours, one every 6 hours).
_DELIVERED = f"""{ALERTS}, sent AS (SELECT *, least((day(ts) - 1) // 8, 3) AS stretch FROM alerts),
    parts AS (SELECT *, least(stretch + CASE event_id % 10 WHEN 3 THEN 2 WHEN 5 THEN 1 ELSE 0 END, 3) AS part FROM sent),
    marks AS (SELECT part, max(max(ts)) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
      - INTERVAL 1 DAY AS closed FROM parts GROUP BY part),
    judged AS (SELECT parts.*, closed,
      time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') + INTERVAL 24 HOUR AS last_end
      FROM parts JOIN marks USING (part))"""


def _delivered(spark, sf):
    """Alerts come in four deliveries of about a week, one in ten a delivery late and one in ten two; the
    stream is stopped and resumed between them. Returns the folders of alerts on time and aside, and the
    totals of their windows."""
    path, good, late, state, out, c1, c2 = (
        scratch_path(spark, n) for n in ("alert_messages", "good", "late", "state", "windows", "c1", "c2")
    )
    messages = alert_messages(spark, sf)
    stretch = F.least(F.floor((F.dayofmonth("ts") - 1) / 8), F.lit(3))
    behind = F.when(F.col("event_id") % 10 == 3, 2).when(F.col("event_id") % 10 == 5, 1).otherwise(0)
    part = F.least(stretch + behind, F.lit(3))
    for number in range(4):
        write_json(messages.filter(part == number), f"{path}/part={number}")
        stream = flat_alerts(alert_stream(spark, f"{path}/*", None, KEYED_ALERT))
        run_until_drained(split_late(stream, good, late, state, c1, "24 hours", "1 day", "6 hours"))
        windows = window_totals(
            on_time(spark, good, stream.schema), "24 hours", "1 day", "6 hours", closed="_closed"
        )
        run_until_drained(save_closed(windows, out, c2))
    return good, late, out


@query(
    "stream_late",
    f"""WITH {_DELIVERED} SELECT event_id, closed, CASE WHEN last_end <= closed THEN 'closed'
      ELSE 'partly closed' END AS reason FROM judged WHERE last_end - INTERVAL 18 HOUR <= closed""",
)
def stream_late(spark, sf):
    """What came too late for a window, kept aside."""
    _, late, _ = _delivered(spark, sf)
    return finished(spark, late).select("event_id", F.col("_closed").cast("timestamp_ntz").alias("closed"), "reason")


@query(
    "stream_on_time_totals",
    f"""WITH {_DELIVERED} SELECT last_end - INTERVAL (24 + k * 6) HOUR AS window_start, count(*) AS total_packets,
      count(*) FILTER (WHERE is_malicious) AS total_malicious, round(avg(latency), 6) AS avg_latency
    FROM judged, range(4) r(k) WHERE closed IS NULL OR last_end - INTERVAL (k * 6) HOUR > closed
    GROUP BY window_start
    HAVING window_start + INTERVAL 24 HOUR <= (SELECT max(ts) - INTERVAL 1 DAY FROM alerts)""",
)
def stream_on_time_totals(spark, sf):
    """Sliding windows of the alerts on time: with those of ``stream_late``, no alert is lost."""
    _, _, out = _delivered(spark, sf)
    return spark.read.parquet(out).select("window_start", "total_packets", "total_malicious", r6("avg_latency"))


@query("stream_replay", f"WITH {ALERTS} SELECT event_id, src_ip, dst_ip, is_malicious, latency, worker FROM alerts")
def stream_replay(spark, sf):
    """Alerts are delivered in four stretches of days, those of a stretch whose number ends in 3 again in the
    same one and in the next. The stream is stopped and resumed between the stretches."""
    path, out, ckpt = (scratch_path(spark, n) for n in ("alert_messages", "alerts", "ckpt"))
    messages = alert_messages(spark, sf)
    stretch = F.least(F.floor((F.dayofmonth("ts") - 1) / 8), F.lit(3))
    again = messages.filter(F.col("event_id") % 10 == 3)
    for part in range(4):
        sent = messages.filter(stretch == part).unionByName(again.filter(stretch.isin(part, part - 1)))
        write_json(sent, f"{path}/part={part}")
        stream = flat_alerts(alert_stream(spark, f"{path}/*", None, KEYED_ALERT))
        run_until_drained(save_batches(once(stream, "event_id", "20 days"), out, ckpt))
    return finished(spark, out).select("event_id", "src_ip", "dst_ip", "is_malicious", "latency", "worker")
