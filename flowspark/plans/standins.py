"""Views of the test tables in the shape of the engine's inputs, and the same views as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from flowspark.schemas import ALERT
from flowspark.session import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        "event_id", "ts",
        F.concat(F.lit("10.0.0."), F.col("user_id").cast("string")).alias("src_ip"),
        F.concat(F.lit("192.168.0."), F.regexp_extract("props", "[0-9]+", 0)).alias("dst_ip"),
        (F.col("event_type") == "error").alias("is_malicious"),
        (F.col("value") / 100).alias("latency"),
        (F.col("value") / 10000).alias("classification_time"),
        F.concat(F.lit("worker"), (F.col("event_id") % 5 + 1).cast("string")).alias("worker"),
    )


ALERTS = """alerts AS (
  SELECT event_id, ts, '10.0.0.' || user_id AS src_ip,
         '192.168.0.' || regexp_extract(props, '[0-9]+', 0) AS dst_ip,
         event_type = 'error' AS is_malicious, value / 100 AS latency,
         value / 10000 AS classification_time, 'worker' || (event_id % 5 + 1) AS worker
  FROM events)"""

FLOW_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def flows(spark: SparkSession, sf_dir: str, client: bool = False) -> DataFrame:
    """Labelled flows; the client of a flow is looked up only where it is used."""
    line = table(spark, sf_dir, "lineitem")
    cols = [
        *FLOW_FEATURES, F.col("l_returnflag").alias("class"),
        (F.col("l_returnflag") == "R").cast("int").alias("label"),
    ]
    if not client:
        return line.select(*cols)
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderpriority").alias("client_id")
    )
    return line.join(orders, "l_orderkey").select(*cols, "client_id")


def training_flows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Train and test rows (about one in five, by hash) of all clients, with a row key."""
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderpriority").alias("client_id")
    )
    key = F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    line = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", *FLOW_FEATURES, "l_returnflag"
    )
    rows = spread(line).join(orders, "l_orderkey").select(
        "client_id", key.alias("key"), *FLOW_FEATURES,
        (F.col("l_returnflag") == "R").cast("int").alias("label"),
    )
    held = F.substring(F.md5("key"), 1, 2) < "33"
    return rows.filter(~held), rows.filter(held)


TRAINING = """training AS (
  SELECT o_orderpriority AS client_id, l_quantity, l_extendedprice, l_discount, l_tax,
         CAST(l_returnflag = 'R' AS INTEGER) AS label,
         substr(md5(l_orderkey || '-' || l_partkey || '-' || l_suppkey || '-' || l_linenumber), 1, 2)
           < '33' AS held
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""

FLOWS = """flows AS (
  SELECT l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag AS class,
         CAST(l_returnflag = 'R' AS INTEGER) AS label, o_orderpriority AS client_id
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def keyed_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("price"),
        F.col("o_orderpriority").alias("class"), F.col("o_orderstatus").alias("client_id"),
    )


KEYED = """keyed AS (
  SELECT o_orderkey AS key, o_totalprice AS price, o_orderpriority AS class,
         o_orderstatus AS client_id FROM orders)"""


def params(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    rows = e.select(
        F.col("vec_id").alias("client"), F.col("label").alias("round"),
        (F.col("vec_id") % 7 + 1).alias("weight"), F.posexplode("embedding").alias("pos", "_v"),
    )
    return rows.select(
        "round", "client", F.floor(F.col("pos") / 16).cast("int").alias("layer"), "pos",
        F.col("_v").cast("double").alias("value"), "weight",
    )


PARAMS = """params AS (
  SELECT label AS round, vec_id AS client, CAST(i // 16 AS INTEGER) AS layer,
         CAST(i AS INTEGER) AS pos, CAST(embedding[i + 1] AS DOUBLE) AS value,
         vec_id % 7 + 1 AS weight
  FROM (SELECT *, unnest(range(len(embedding))) AS i FROM embeddings))"""


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select(
        "doc_id", (F.col("doc_id") % 3).alias("client"), F.col("quality").alias("pred"),
        F.col("toxic").alias("label"),
    )


PREDICTIONS = """predictions AS (
  SELECT doc_id, doc_id % 3 AS client, quality AS pred, toxic AS label FROM labels)"""


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores with their truth, by worker and day."""
    e = table(spark, sf_dir, "events")
    return e.select(
        "event_id", F.dayofmonth("ts").alias("round"),
        F.concat(F.lit("worker"), (F.col("event_id") % 5 + 1).cast("string")).alias("client"),
        ((F.col("value") - 50) / 25).alias("logit"),
        (F.col("event_type") == "error").cast("int").alias("label"),
    )


LOGITS = """logits AS (
  SELECT event_id, CAST(day(ts) AS INTEGER) AS round, 'worker' || (event_id % 5 + 1) AS client,
         (value - 50) / 25 AS logit, CAST(event_type = 'error' AS INTEGER) AS label
  FROM events)"""


def metric_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metric values by client, model and round (days as rounds)."""
    e = table(spark, sf_dir, "events")
    cells = e.groupBy(
        F.col("event_type").alias("client"), (F.col("user_id") % 3).cast("int").alias("model"),
        F.dayofmonth("ts").alias("round"),
    ).agg(
        F.avg(F.col("value") / 1000).alias("score"),
        F.avg(1 / (1 + F.col("value"))).alias("final_loss"),
    )
    return cells.unpivot(
        ["client", "model", "round"], ["score", "final_loss"], "metric", "value"
    ).select("client", "metric", "model", "round", "value")


METRIC_LOG = """cells AS (
  SELECT event_type AS client, CAST(user_id % 3 AS INTEGER) AS model,
         CAST(day(ts) AS INTEGER) AS round, avg(value / 1000) AS score,
         avg(1 / (1 + value)) AS final_loss
  FROM events GROUP BY ALL),
metric_log AS (
  SELECT client, 'score' AS metric, model, round, score AS value FROM cells
  UNION ALL SELECT client, 'final_loss', model, round, final_loss FROM cells)"""


def model_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loss by model and round over all clients, weighted by rows."""
    e = table(spark, sf_dir, "events")
    return e.groupBy(
        (F.col("user_id") % 3).cast("int").alias("model"), F.dayofmonth("ts").alias("round")
    ).agg(F.avg(1 / (1 + F.col("value"))).alias("loss"))


LOSSES = """losses AS (
  SELECT CAST(user_id % 3 AS INTEGER) AS model, CAST(day(ts) AS INTEGER) AS round,
         avg(1 / (1 + value)) AS loss
  FROM events GROUP BY ALL)"""


def worker_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record per run (day) and worker."""
    e = table(spark, sf_dir, "events")
    return e.groupBy(
        F.dayofmonth("ts").alias("run"),
        F.concat(F.lit("worker"), (F.col("event_id") % 5 + 1).cast("string")).alias("worker"),
    ).agg(
        F.count(F.lit(1)).alias("processed_packets"),
        F.round(F.sum("value"), 2).alias("total_timer"),
    )


WORKER_FILES = """worker_files AS (
  SELECT CAST(day(ts) AS INTEGER) AS run, 'worker' || (event_id % 5 + 1) AS worker,
         count(*) AS processed_packets, round(sum(value), 2) AS total_timer
  FROM events GROUP BY ALL)"""


#: Alerts with their order key.
KEYED_ALERT = T.StructType(
    [T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()), *ALERT.fields]
)


def alert_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts as nested messages; ``event_id`` and ``ts`` travel along as the order key."""
    a = alerts(spark, sf_dir)
    return a.select(
        "event_id", "ts",
        F.struct(
            F.col("src_ip").alias("IPV4_SRC_ADDR"),
            (F.col("event_id") % 60000 + 1024).cast("int").alias("L4_SRC_PORT"),
            F.col("dst_ip").alias("IPV4_DST_ADDR"), F.lit(443).alias("L4_DST_PORT"),
        ).alias("metadata"),
        "classification_time", "latency", F.col("worker").alias("worker_name"), "is_malicious",
        F.unix_seconds(F.col("ts").cast("timestamp")).alias("timestamp"),
    )


def message_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alert messages as JSON text; one in 50 arrives cut short."""
    m = alert_messages(spark, sf_dir)
    whole = F.to_json(
        F.struct("metadata", "classification_time", "latency", "worker_name", "is_malicious", "timestamp")
    )
    cut = F.when(F.col("event_id") % 50 == 7, F.substring(whole, 1, 90)).otherwise(whole)
    return m.select("event_id", cut.alias("value"))


CUT_TEXT = """substr('{"metadata":{"IPV4_SRC_ADDR":"10.0.0.' || user_id || '","L4_SRC_PORT":'
  || (event_id % 60000 + 1024) || ',"IPV4_DST_ADDR":"192.168.0.'
  || regexp_extract(props, '[0-9]+', 0) || '","L4_DST_PORT":443}', 1, 90)"""

# A fixed linear model over the four flow features, applied after min-max scaling.
LINEAR_WEIGHTS = [0.731, -1.203, 0.417, 0.288]
LINEAR_BIAS = -0.0531
