"""Requests in, alerts out: parse, scale, classify, time; what cannot be scored is kept aside."""

from __future__ import annotations

import time

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.functions import arrow_udf
from pyspark.sql.streaming import DataStreamWriter

from flowspark.operators import mlp
from flowspark.operators.score import MAX_PARAMETERS
from flowspark.schemas import REQUEST, parse_messages
from flowspark.sources.sinks import FAST

_SCORED = T.StructType(
    [
        T.StructField("p", T.DoubleType()),
        T.StructField("seconds", T.DoubleType()),
        T.StructField("done", T.DoubleType()),
    ]
)


def _predictor(spark, model, scale, offset, form):
    if form not in ("offset", "legacy_min"):
        raise ValueError(f"unknown scaler form {form!r}")
    if sum(t.size for t in model) > MAX_PARAMETERS:
        raise ValueError("the model is too large to ship to tasks")
    shared = spark.sparkContext.broadcast((model, np.asarray(scale), np.asarray(offset)))
    width = len(scale)

    @arrow_udf(_SCORED)
    def predict(vectors: pa.Array) -> pa.Array:
        import pyarrow.compute as pc

        net, mul, add = shared.value
        begin = time.time()
        sizes = pc.fill_null(pc.list_value_length(vectors), -1).to_numpy(zero_copy_only=False)
        ok = sizes == width
        flat = vectors.filter(pa.array(ok)).flatten().to_numpy(zero_copy_only=False)
        x = flat.astype(float).reshape(-1, width)
        whole = ~np.isnan(x).any(axis=1)
        ok[np.flatnonzero(ok)[~whole]] = False
        x = x[whole]
        x = x * mul + add if form == "offset" else (x - add) * mul
        p = np.full(len(ok), np.nan)
        if ok.any():
            p[ok] = 1 / (1 + np.exp(-mlp.logits(net, x)))
        done = time.time()
        each = (done - begin) / max(len(ok), 1)
        n = len(ok)
        return pa.StructArray.from_arrays(
            [pa.array(p, mask=~ok), pa.array(np.full(n, each)), pa.array(np.full(n, done))],
            names=["p", "seconds", "done"],
        )

    return predict


def score_stream(
    requests: DataFrame, model: list[np.ndarray], scale, offset, form: str = "offset"
) -> DataFrame:
    """Alerts for request rows, batch or stream, plus ``p`` (NULL where a row cannot be scored).

    Rows are classified per Arrow batch; the time of a row is its share of the batch. The worker is
    the task that classified it. The decision is ``p > 0.5``.
    """
    predict = _predictor(requests.sparkSession, model, scale, offset, form)
    rows = requests.withColumn("_s", predict("packet"))
    return rows.select(
        "*",
        F.col("_s.seconds").alias("classification_time"),
        (F.col("_s.done") - F.col("send_timestamp")).alias("latency"),
        F.concat(F.lit("worker-"), F.spark_partition_id().cast("string")).alias("worker_name"),
        (F.col("_s.p") > 0.5).alias("is_malicious"),
        F.floor("_s.done").cast("long").alias("timestamp"),
        F.col("_s.p").alias("p"),
    ).drop("_s", "send_timestamp", "packet")


def write_alerts(alerts: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Append alerts as JSON files; exactly once through the checkpoint and the file log."""
    writer = alerts.writeStream.format("json").option("checkpointLocation", checkpoint)
    return writer.option("path", path).outputMode("append")


def dead_letter(
    messages: DataFrame, schema: T.StructType, good: str, dead: str, checkpoint: str
) -> DataStreamWriter:
    """Split raw messages: parsed rows to ``good``, malformed text to ``dead``.

    Each batch writes to its own folder, so a repeated batch replaces its first attempt.
    """

    def split(batch: DataFrame, number: int) -> None:
        parsed = parse_messages(batch, "value", schema).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            valid = parsed.filter("valid").select("message.*")
            valid.write.mode("overwrite").parquet(f"{good}/batch={number}")
            rejected = parsed.filter("NOT valid").select("value")
            rejected.write.mode("overwrite").parquet(f"{dead}/batch={number}")
        finally:
            parsed.unpersist()

    return messages.writeStream.foreachBatch(split).option("checkpointLocation", checkpoint)


def score_messages(
    messages: DataFrame, model: list[np.ndarray], scale, offset, out: str, dead: str,
    checkpoint: str, form: str = "offset",
) -> DataStreamWriter:
    """Raw request text to alerts (compressed JSON); malformed and unscorable messages to ``dead``.

    The input counts as read only when both folders of a batch are written. What is kept of a batch in between
    has the text of failed messages only.
    """

    def run(batch: DataFrame, number: int) -> None:
        parsed = parse_messages(batch, "value", REQUEST)
        requests = parsed.select("value", "valid", "message.*")
        failed = ~F.col("valid") | F.col("p").isNull()
        scored = score_stream(requests, model, scale, offset, form).withColumn("_failed", failed)
        scored = scored.withColumn("value", F.when(F.col("_failed"), F.col("value"))).drop("valid", "p")
        scored = scored.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            alerts = scored.filter("NOT _failed").drop("value", "_failed")
            alerts.write.mode("overwrite").options(**FAST).json(f"{out}/batch={number}")
            scored.filter("_failed").select("value").write.mode("overwrite").parquet(f"{dead}/batch={number}")
        finally:
            scored.unpersist()

    return messages.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
