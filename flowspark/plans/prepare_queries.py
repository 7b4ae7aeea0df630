"""Queries over sources, sinks, preparation, sampling and scaling."""

from __future__ import annotations

from pyspark.sql import functions as F, types as T

from flowspark.operators import prep, sampling, scaling
from flowspark.plans.registry import query
from flowspark.plans.standins import (
    ALERTS, CUT_TEXT, FLOW_FEATURES, FLOWS, KEYED, KEYED_ALERT, LOSSES, METRIC_LOG, WORKER_FILES,
    alert_messages, alerts, flows, keyed_flows, message_texts, metric_log, model_losses, table, worker_files,
)
from flowspark.schemas import ALERT, WORKER_FILE, check_width, parse_messages
from flowspark.session import scratch_path
from flowspark.sources import (
    read_clients, read_flows, read_flows_csv, read_json_glob, read_metric_log, read_packets, read_round_losses,
    read_scaler, read_train_log, register_file_records, write_csv, write_flows, write_json, write_metric_log, write_round_losses,
    write_scaler, write_train_log,
)
from flowspark.streaming import flat_alerts


def r6(c, name: str | None = None):
    col = F.col(c) if isinstance(c, str) else c
    return F.round(col, 6).alias(name or c)


# --- sources and sinks --------------------------------------------------------------------------

FLOW_ROWS = """SELECT l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus
FROM lineitem"""


@query(
    "scan_flows",
    "SELECT l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus FROM lineitem",
)
def scan_flows(spark, sf):
    return read_flows(
        spark, f"{sf}/lineitem.parquet",
        ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate"],
    )


@query("scan_csv", FLOW_ROWS)
def scan_csv(spark, sf):
    rows = scan_flows(spark, sf)
    path = scratch_path(spark, "flows_csv")
    write_csv(rows, path)
    return read_flows_csv(spark, path, rows.schema)


@query(
    "packets_from_csv",
    """SELECT '10.0.0.' || l_suppkey AS src,
      CASE WHEN l_linenumber = 3 THEN 0 ELSE CAST(l_partkey AS INTEGER) END AS sport,
      '192.168.0.' || l_linenumber AS dst, 443 AS dport,
      l_quantity AS f0, l_extendedprice AS f1,
      CASE WHEN l_linenumber = 5 THEN 0.0 ELSE l_tax END AS f2, 4 - 1 AS width
    FROM lineitem""",
)
def packets_from_csv(spark, sf):
    line = table(spark, sf, "lineitem")
    number = F.col("l_linenumber")
    raw = line.select(
        F.concat(F.lit("10.0.0."), F.col("l_suppkey").cast("string")).alias("IPV4_SRC_ADDR"),
        F.when(number == 3, "?").otherwise(F.col("l_partkey").cast("string")).alias("L4_SRC_PORT"),
        F.concat(F.lit("192.168.0."), number.cast("string")).alias("IPV4_DST_ADDR"),
        F.lit("443").alias("L4_DST_PORT"),
        "l_quantity", "l_extendedprice",
        F.when(number == 5, "x").otherwise(F.col("l_tax").cast("string")).alias("l_tax"),
    )
    path = scratch_path(spark, "packets_csv")
    write_csv(raw, path)
    packets = read_packets(spark, path)
    return packets.select(
        F.col("metadata.IPV4_SRC_ADDR").alias("src"), F.col("metadata.L4_SRC_PORT").alias("sport"),
        F.col("metadata.IPV4_DST_ADDR").alias("dst"), F.col("metadata.L4_DST_PORT").alias("dport"),
        *[F.get("packet", F.lit(i)).alias(f"f{i}") for i in range(3)],
        F.size("packet").alias("width"),
    )


@query(
    "client_union",
    f"""WITH {KEYED} SELECT key, price, class, client_id,
      CASE WHEN class = '1-URGENT' THEN 'TEST' ELSE 'TRAIN' END AS split FROM keyed""",
)
def client_union(spark, sf):
    rows = keyed_flows(spark, sf)
    path = scratch_path(spark, "clients")
    split = F.when(F.col("class") == "1-URGENT", "TEST").otherwise("TRAIN")
    rows = rows.withColumn("split", split)
    write_flows(rows, path, by=["client_id", "split"])
    registry = [
        (client, split, f"{path}/client_id={client}/split={split}")
        for client, split in rows.select("client_id", "split").distinct().collect()
    ]
    return read_clients(spark, registry)


@query(
    "metric_log_long",
    f"""WITH {METRIC_LOG}
    SELECT client, metric, model,
      CAST(row_number() OVER (PARTITION BY client, metric, model ORDER BY round) AS INTEGER) AS round,
      round(value, 6) AS value
    FROM metric_log""",
)
def metric_log_long(spark, sf):
    path = scratch_path(spark, "metric_log")
    write_metric_log(metric_log(spark, sf), path)
    docs = read_metric_log(spark, path)
    return docs.select("client", "metric", "model", "round", r6("value"))


@query(
    "metric_log_central",
    f"""WITH {METRIC_LOG} SELECT client, metric, CAST(row_number() OVER (PARTITION BY client, metric ORDER BY model)
      - 1 AS INTEGER) AS model, 1 AS round, round(max_by(value, round), 6) AS value
    FROM metric_log GROUP BY client, metric, metric_log.model""",
)
def metric_log_central(spark, sf):
    path = scratch_path(spark, "metric_log")
    write_metric_log(metric_log(spark, sf), path, setting="central")
    docs = read_metric_log(spark, path, "central")
    return docs.select("client", "metric", "model", "round", r6("value"))


@query(
    "metric_log_local",
    f"""WITH {METRIC_LOG} SELECT client, metric, 'net' || model AS model, CAST(row_number() OVER (
      PARTITION BY client, metric, model ORDER BY round) AS INTEGER) AS round, round(value, 6) AS value
    FROM metric_log""",
)
def metric_log_local(spark, sf):
    path = scratch_path(spark, "metric_log")
    log = metric_log(spark, sf).withColumn("model", F.concat(F.lit("net"), F.col("model").cast("string")))
    write_metric_log(log, path, setting="local")
    docs = read_metric_log(spark, path, "local")
    return docs.select("client", "metric", "model", "round", r6("value"))


@query(
    "train_log_read",
    f"""WITH {METRIC_LOG} SELECT client, round AS epoch, round(value, 6) AS loss FROM metric_log
    WHERE metric = 'final_loss' AND model = 1""",
)
def train_log_read(spark, sf):
    path = scratch_path(spark, "train_log")
    log = metric_log(spark, sf).filter("metric = 'final_loss' AND model = 1")
    write_train_log(log.select("client", F.col("round").alias("epoch"), F.col("value").alias("loss")), path)
    return read_train_log(spark, path).select("client", "epoch", r6("loss"))


@query("round_losses_read", f"WITH {LOSSES} SELECT model, round, round(loss, 6) AS loss FROM losses")
def round_losses_read(spark, sf):
    path = scratch_path(spark, "round_losses")
    write_round_losses(model_losses(spark, sf), path)
    return read_round_losses(spark, path).select("model", "round", r6("loss"))


@query("read_json_glob", f"WITH {WORKER_FILES} SELECT processed_packets, total_timer FROM worker_files")
def json_glob(spark, sf):
    path = scratch_path(spark, "workers")
    write_json(worker_files(spark, sf).drop("run"), f"{path}/runs/a")
    return read_json_glob(spark, path, "part-", WORKER_FILE)


@query(
    "datasource_files",
    f"WITH {ALERTS} SELECT event_id, ts, src_ip, dst_ip, is_malicious, latency, worker FROM alerts",
)
def datasource_files(spark, sf):
    """Alert files in two folders, by prefix and schema, through the registered format."""
    path = scratch_path(spark, "alert_files")
    messages = alert_messages(spark, sf)
    for odd in (0, 1):
        write_json(messages.filter(F.col("event_id") % 2 == odd), f"{path}/run={odd}")
    register_file_records(spark)
    schema = T.StructType([*KEYED_ALERT.fields, T.StructField("_file", T.StringType())])
    reader = spark.read.format("file_records").schema(schema).option("path", path)
    rows = reader.option("prefix", "part-").option("block", 1 << 20).load()
    return flat_alerts(rows.filter("_file LIKE 'run=_/part-%.json'")).select(
        "event_id", "ts", "src_ip", "dst_ip", "is_malicious", "latency", "worker"
    )


@query("datasource_rejects", f"SELECT {CUT_TEXT} AS value FROM events WHERE event_id % 50 = 7")
def datasource_rejects(spark, sf):
    """Lines that are no message of the schema, as they stand in the files."""
    path = scratch_path(spark, "messages")
    message_texts(spark, sf).select("value").write.text(path)
    register_file_records(spark)
    schema = T.StructType([*ALERT.fields, T.StructField("_bad", T.StringType())])
    reader = spark.read.format("file_records").schema(schema).option("path", path)
    return reader.option("extension", ".txt").load().filter("_bad IS NOT NULL").select(F.col("_bad").alias("value"))


@query("parquet_roundtrip", FLOW_ROWS)
def parquet_roundtrip(spark, sf):
    path = scratch_path(spark, "flows")
    write_flows(scan_flows(spark, sf), path)
    return read_flows(spark, path)


@query(
    "json_roundtrip",
    f"WITH {ALERTS} SELECT event_id, src_ip, dst_ip, is_malicious, latency, worker FROM alerts",
)
def json_roundtrip(spark, sf):
    rows = alerts(spark, sf).drop("ts", "classification_time")
    path = scratch_path(spark, "alerts_json")
    write_json(rows, path)
    return spark.read.schema(rows.schema).json(path)


@query("csv_roundtrip", f"WITH {ALERTS} SELECT event_id, latency FROM alerts")
def csv_roundtrip(spark, sf):
    rows = alerts(spark, sf).select("event_id", "latency")
    path = scratch_path(spark, "latencies_csv")
    write_csv(rows, path)
    return read_flows_csv(spark, path, rows.schema)


# --- projections, filters, predicates -----------------------------------------------------------


@query(
    "drop_identity",
    f"WITH {ALERTS} SELECT event_id, is_malicious, latency, classification_time, worker FROM alerts",
)
def drop_identity(spark, sf):
    return prep.drop_identity(alerts(spark, sf), ["src_ip", "dst_ip", "ts"])


@query(
    "features_label",
    f"""SELECT l_quantity AS f0, l_extendedprice AS f1, l_discount AS f2, l_tax AS f3,
      CAST(l_returnflag = 'R' AS INTEGER) AS label FROM lineitem""",
)
def features_label(spark, sf):
    rows = prep.features_label(flows(spark, sf), FLOW_FEATURES, "label")
    return rows.select(*[F.get("features", F.lit(i)).alias(f"f{i}") for i in range(4)], "label")


@query(
    "filter_malicious",
    f"WITH {ALERTS} SELECT event_id, src_ip, dst_ip FROM alerts WHERE is_malicious",
)
def filter_malicious(spark, sf):
    return prep.malicious(alerts(spark, sf)).select("event_id", "src_ip", "dst_ip")


@query("drop_outliers", f"WITH {ALERTS} SELECT event_id, latency FROM alerts WHERE abs(latency) <= 1.5")
def drop_outliers(spark, sf):
    return prep.drop_outliers(alerts(spark, sf).select("event_id", "latency"), "latency", 1.5)


@query("validate_alerts", "SELECT event_id, event_id % 50 <> 7 AS valid FROM events")
def validate_alerts(spark, sf):
    return parse_messages(message_texts(spark, sf), "value", ALERT).select("event_id", "valid")


@query(
    "check_width",
    "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_linenumber <> 2",
)
def width(spark, sf):
    line = table(spark, sf, "lineitem")
    short = F.array("l_quantity", "l_extendedprice")
    vector = F.when(F.col("l_linenumber") == 2, short).otherwise(F.array(*FLOW_FEATURES))
    rows = line.withColumn("packet", vector)
    return check_width(rows, "packet", 4).select("l_orderkey", "l_linenumber", "l_quantity")


# --- duplicates, distributions, unions ----------------------------------------------------------


@query(
    "class_counts",
    "SELECT l_returnflag AS class, count(*) AS n FROM lineitem GROUP BY ALL ORDER BY n DESC, class",
)
def class_counts(spark, sf):
    return prep.class_counts(flows(spark, sf), "class")


@query(
    "class_share",
    """SELECT l_returnflag AS class, count(*) AS n,
      round(count(*) / sum(count(*)) OVER (), 6) AS share FROM lineitem GROUP BY l_returnflag""",
)
def class_share(spark, sf):
    return prep.class_share(flows(spark, sf), "class").select("class", "n", r6("share"))


DUP_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(
    "duplicate_count",
    f"""WITH a AS (SELECT count(*) AS c FROM lineitem GROUP BY {', '.join(DUP_COLS)}, l_returnflag),
    b AS (SELECT count(*) AS c FROM lineitem GROUP BY {', '.join(DUP_COLS)})
    SELECT 'with class' AS kind, CAST(sum(c) AS BIGINT) AS n_rows, count(*) AS n_distinct,
      CAST(sum(c - 1) AS BIGINT) AS n_duplicates FROM a
    UNION ALL
    SELECT 'without class', CAST(sum(c) AS BIGINT), count(*), CAST(sum(c - 1) AS BIGINT) FROM b""",
)
def duplicate_count(spark, sf):
    rows = flows(spark, sf)
    both = prep.duplicate_count(rows, [*DUP_COLS, "class"]).withColumn("kind", F.lit("with class"))
    some = prep.duplicate_count(rows, DUP_COLS).withColumn("kind", F.lit("without class"))
    return both.unionByName(some)


@query(
    "dup_by_class",
    """SELECT event_type, count(*) AS duplicates FROM (
      SELECT event_type, row_number() OVER (PARTITION BY user_id, props ORDER BY event_id) AS i
      FROM events) WHERE i > 1 GROUP BY event_type""",
)
def dup_by_class(spark, sf):
    return prep.dup_by_class(
        table(spark, sf, "events"), ["user_id", "props"], "event_type", "event_id"
    )


@query(
    "dedup_central",
    "SELECT DISTINCT l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag AS class FROM lineitem",
)
def dedup_central(spark, sf):
    rows = flows(spark, sf, client=True).select(*DUP_COLS, "class", "client_id")
    return prep.central(rows)


@query(
    "n_largest",
    "SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 10",
)
def n_largest(spark, sf):
    return prep.n_largest(table(spark, sf, "events").select("event_id", "value"), "value", 10, ["event_id"])


# --- sampling and splitting ---------------------------------------------------------------------

HASH = "md5('{seed}:' || key)"


def _ranked(seed: int) -> str:
    h = HASH.format(seed=seed)
    return f"""{KEYED},
    sizes AS (SELECT class, count(*) AS n FROM keyed GROUP BY class),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY class ORDER BY {h}) AS i FROM keyed)"""


@query(
    "shuffled_head",
    f"WITH {KEYED} SELECT * FROM keyed ORDER BY {HASH.format(seed=1)} LIMIT 10000",
)
def shuffled_head(spark, sf):
    return sampling.shuffled_head(keyed_flows(spark, sf), "key", 10_000, 1)


@query(
    "stratified_sample",
    f"""WITH {_ranked(7)},
    quota AS (SELECT class, CAST(floor(2500.0 * n / sum(n) OVER () + 0.5) AS BIGINT) AS k FROM sizes)
    SELECT key, price, class, client_id FROM ranked JOIN quota USING (class) WHERE i <= k""",
)
def stratified_sample(spark, sf):
    return sampling.stratified_sample(keyed_flows(spark, sf), "class", "key", 2500, 7)


def _remainder(source: str, size: str, target: str, out: str) -> str:
    """SQL: divide a target over classes by largest remainder."""
    return f"""{out}_t AS (SELECT *, CAST({target} AS BIGINT) AS t,
      CAST({target} AS BIGINT) * CAST({size} AS DOUBLE) / sum({size}) OVER () AS ideal FROM {source}),
    {out}_f AS (SELECT *, CAST(floor(ideal) AS BIGINT) AS fl FROM {out}_t),
    {out}_q AS (SELECT * EXCLUDE (t, ideal, fl), fl + CASE WHEN
      row_number() OVER (ORDER BY ideal - fl DESC, class) <= t - sum(fl) OVER () THEN 1 ELSE 0 END
      AS {out} FROM {out}_f)"""


@query(
    "stratified_split",
    f"""WITH {_ranked(69)},
    {_remainder('sizes', 'n', 'ceil(CAST(0.2 AS DOUBLE) * sum(n) OVER ())', 'test')}
    SELECT key, price, class, client_id, CASE WHEN i <= test THEN 'test' ELSE 'train' END AS split
    FROM ranked JOIN test_q USING (class)""",
)
def stratified_split(spark, sf):
    return sampling.stratified_split(keyed_flows(spark, sf), "class", "key", 0.2, 69)


@query(
    "three_way_split",
    f"""WITH {_ranked(69)},
    {_remainder('sizes', 'n', 'ceil(CAST(0.4 AS DOUBLE) * sum(n) OVER ())', 'held')},
    {_remainder('held_q', 'held', 'ceil(CAST(0.5 AS DOUBLE) * sum(held) OVER ())', 'test')}
    SELECT key, price, class, client_id,
      CASE WHEN i <= test THEN 'test' WHEN i <= held THEN 'eval' ELSE 'train' END AS split
    FROM ranked JOIN test_q USING (class)""",
)
def three_way_split(spark, sf):
    return sampling.three_way_split(keyed_flows(spark, sf), "class", "key", 69)


@query(
    "hash_sample",
    f"WITH {KEYED} SELECT * FROM keyed WHERE substr({HASH.format(seed=3)}, 1, 8) < '19999999'",
)
def hash_sample(spark, sf):
    return sampling.hash_sample(keyed_flows(spark, sf), "key", 0.1, 3)


# --- scaling ------------------------------------------------------------------------------------


def _per_feature(select: str, source: str, by: str = "") -> str:
    """SQL: one SELECT per feature, with ``{c}`` for its name."""
    group = f" GROUP BY {by}" if by else ""
    lead = f"{by}, " if by else ""
    return " UNION ALL ".join(
        f"SELECT {lead}'{c}' AS feature, {select.format(c=c)} FROM {source}{group}"
        for c in FLOW_FEATURES
    )


MINMAX = """min({c}) AS data_min, max({c}) AS data_max,
  CASE WHEN max({c}) = min({c}) THEN 1.0 ELSE 1.0 / (max({c}) - min({c})) END AS scale"""


@query(
    "fit_minmax",
    f"""WITH {FLOWS}, fit AS ({_per_feature(MINMAX, 'flows', 'client_id')})
    SELECT client_id, feature, data_min, data_max, round(scale, 6) AS scale,
      round(-data_min * scale, 6) AS "offset" FROM fit""",
)
def fit_minmax(spark, sf):
    fit = scaling.fit_minmax(flows(spark, sf, client=True), FLOW_FEATURES, ["client_id"])
    return fit.select("client_id", "feature", "data_min", "data_max", r6("scale"), r6("offset"))


def _wide(source: str, by: str = "") -> str:
    """SQL: scale and offset of every feature in one row."""
    parts = ", ".join(
        f"""CASE WHEN max({c}) = min({c}) THEN 1.0 ELSE 1.0 / (max({c}) - min({c})) END AS s{i},
        -min({c}) * CASE WHEN max({c}) = min({c}) THEN 1.0 ELSE 1.0 / (max({c}) - min({c})) END AS o{i}"""
        for i, c in enumerate(FLOW_FEATURES)
    )
    return f"SELECT {by + ', ' if by else ''}{parts} FROM {source}" + (f" GROUP BY {by}" if by else "")


@query(
    "apply_minmax",
    f"""WITH {FLOWS}, benign AS (SELECT * FROM flows WHERE label = 0), fit AS ({_wide('benign', 'client_id')})
    SELECT client_id, class, label, {', '.join(f'round({c} * s{i} + o{i}, 6) AS {c}' for i, c in enumerate(FLOW_FEATURES))}
    FROM flows JOIN fit USING (client_id)""",
)
def apply_minmax(spark, sf):
    rows = flows(spark, sf, client=True)
    fit = scaling.fit_minmax(rows.filter("label = 0"), FLOW_FEATURES, ["client_id"])
    scaled = scaling.apply_minmax(rows, fit, FLOW_FEATURES, ["client_id"])
    return scaled.select("client_id", "class", "label", *[r6(c) for c in FLOW_FEATURES])


@query(
    "apply_minmax_legacy",
    f"""WITH fit AS ({_wide('lineitem')})
    SELECT l_returnflag AS class, {', '.join(f'round(({c} - o{i}) * s{i}, 6) AS {c}' for i, c in enumerate(FLOW_FEATURES))}
    FROM lineitem, fit""",
)
def apply_minmax_legacy(spark, sf):
    rows = flows(spark, sf)
    fit = scaling.fit_minmax(rows, FLOW_FEATURES)
    scaled = scaling.apply_minmax(rows, fit, FLOW_FEATURES, form="legacy_min")
    return scaled.select("class", *[r6(c) for c in FLOW_FEATURES])


@query(
    "scaler_roundtrip",
    f"""WITH fit AS ({_per_feature(MINMAX, 'lineitem')})
    SELECT feature, round(scale, 6) AS scale, round(-data_min * scale, 6) AS "offset" FROM fit""",
)
def scaler_roundtrip(spark, sf):
    path = scratch_path(spark, "scaler")
    write_scaler(scaling.fit_minmax(flows(spark, sf), FLOW_FEATURES), FLOW_FEATURES, path)
    return read_scaler(spark, path, FLOW_FEATURES).select("feature", r6("scale"), r6("offset"))


def _scaled_sql(center: str, spread: str) -> str:
    fits = ", ".join(
        f"{center.format(c=c)} AS c{i}, {spread.format(c=c)} AS s{i}" for i, c in enumerate(FLOW_FEATURES)
    )
    cols = ", ".join(f"round(({c} - c{i}) / s{i}, 6) AS {c}" for i, c in enumerate(FLOW_FEATURES))
    return f"""WITH fit AS (SELECT {fits} FROM lineitem)
    SELECT l_returnflag AS class, {cols} FROM lineitem, fit"""


@query("standard_scale", _scaled_sql("avg({c})", "stddev_pop({c})"))
def standard_scale(spark, sf):
    rows = flows(spark, sf)
    scaled = scaling.apply_standard(rows, scaling.fit_standard(rows, FLOW_FEATURES), FLOW_FEATURES)
    return scaled.select("class", *[r6(c) for c in FLOW_FEATURES])


@query(
    "robust_scale",
    _scaled_sql("median({c})", "(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25))"),
)
def robust_scale(spark, sf):
    rows = flows(spark, sf)
    scaled = scaling.apply_robust(rows, scaling.fit_robust(rows, FLOW_FEATURES), FLOW_FEATURES)
    return scaled.select("class", *[r6(c) for c in FLOW_FEATURES])
