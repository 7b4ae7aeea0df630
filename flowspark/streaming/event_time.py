"""Totals of windows of event time: final once a window closes, whatever the order of arrival."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import DataStreamWriter

from flowspark.streaming.live import _expire


def window_totals(
    alerts: DataFrame, size: str, delay: str, slide: str | None = None, order: str = "ts",
    closed: str | None = None,
) -> DataFrame:
    """Alerts, malicious alerts and mean times per window of event time, batch or stream.

    Windows are ``size`` long and start every ``slide`` (tumbling without it). A stream waits ``delay`` behind
    the newest alert before a window is closed; its state is one row per open window, and what arrives
    for a closed window is left out. Rows without a time are in no window. With ``closed``, the column of
    :func:`on_time`, a row counts in those windows alone that were open when it arrived.
    """
    timed = alerts.withColumn("_at", F.col(order).cast("timestamp")).withWatermark("_at", delay)
    timed = timed.withColumn("_window", F.window("_at", size, slide))
    if closed:
        timed = timed.filter(F.col(closed).isNull() | (F.col("_window.end") > F.col(closed)))
    rows = timed.groupBy("_window").agg(
        F.count(F.lit(1)).alias("total_packets"), F.count_if("is_malicious").alias("total_malicious"),
        F.avg("latency").alias("avg_latency"), F.avg("classification_time").alias("avg_classification_time"),
    )
    return rows.select(
        F.col("_window.start").cast("timestamp_ntz").alias("window_start"),
        F.col("_window.end").cast("timestamp_ntz").alias("window_end"),
        "total_packets", "total_malicious", "avg_latency", "avg_classification_time",
    )


def save_closed(windows: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Append every window once, when it closes; the file log makes a repeated batch leave one copy."""
    writer = windows.writeStream.format("parquet").outputMode("append")
    return writer.option("path", path).option("checkpointLocation", checkpoint)


def _micros(length: str) -> Column:
    """The microseconds of an interval such as ``6 hours``."""
    seconds = F.expr(f"CAST(CAST(INTERVAL {length} AS INTERVAL SECOND) AS DECIMAL(18, 6))")
    return (seconds * 1_000_000).cast("long")


def _ends(micros: Column, size: str, slide: str | None) -> tuple[Column, Column]:
    """The ends (microseconds) of the first and of the last window that a time is in."""
    step = _micros(slide or size)
    last = micros - F.pmod(micros, step) + _micros(size)  # of the window that starts latest
    return last - F.floor((last - micros - 1) / step) * step, last


def _write_once(rows: DataFrame, folder: str) -> None:
    """Write a folder unless it is finished: a repeated batch has the same rows, and readers may have them."""
    spark = rows.sparkSession
    marker = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
    if not marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker):
        rows.write.mode("overwrite").parquet(folder)


def split_late(
    alerts: DataFrame, path: str, late: str, state: str, checkpoint: str, size: str, delay: str,
    slide: str | None = None, order: str = "ts",
) -> DataStreamWriter:
    """Part a stream, before its windows are counted, into alerts on time and alerts too late for a window.

    A window is closed for a batch if it ends ``delay`` or more before the newest time of all batches before.
    Alerts with an open window go to ``path``, with ``_closed``, the time up to which windows were closed
    when they came (NULL in the first batch); those that miss a window go to ``late``, with ``reason``:
    ``closed`` if all of their windows were closed, ``partly closed`` if some were (these are in ``path``
    too, for the others), ``no time`` if they have none. So an alert is counted in a window or kept aside
    for it, never neither. Both are folders per batch, read with :func:`finished`; the one value carried
    from batch to batch is kept under the batch number, so a repeated batch decides as at first.

    Count ``path`` by :func:`on_time` and :func:`window_totals` with ``closed="_closed"``, the same windows
    and the same delay. Windows are of fixed length, counted from 1970 (no months).
    """

    def part(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{state}/input={number}")
        rows = spark.read.schema(batch.schema).parquet(f"{state}/input={number}")
        micros = F.unix_micros(F.col(order).cast("timestamp"))
        newest, seen = rows.select(micros.alias("newest")), None
        if number > 0:
            before = spark.read.schema("newest long").parquet(f"{state}/newest={number - 1}")
            newest, seen = newest.unionByName(before), before.first()["newest"]
        newest.agg(F.max("newest").alias("newest")).write.mode("overwrite").parquet(f"{state}/newest={number}")
        closed = F.lit(seen).cast("long") - _micros(delay)
        first, last = _ends(micros, size, slide)
        reason = (
            F.when(micros.isNull(), "no time").when(last <= closed, "closed")
            .when(first <= closed, "partly closed")
        )
        judged = rows.withColumns({"_closed": F.timestamp_micros(closed), "reason": reason})
        open_ = judged.filter("reason IS NULL OR reason = 'partly closed'").drop("reason")
        _write_once(judged.filter("reason IS NOT NULL"), f"{late}/batch={number}")
        _write_once(open_, f"{path}/batch={number}")
        _expire(spark, state, "input", number + 1)
        _expire(spark, state, "newest", number - 1)

    return alerts.writeStream.foreachBatch(part).option("checkpointLocation", checkpoint)


def on_time(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The alerts on time of :func:`split_late` as a stream; ``schema`` is that of the alerts.

    Files are taken in the order in which they were written, so no batch overtakes one before it.
    """
    fields = [*schema.fields, T.StructField("_closed", T.TimestampType())]
    return spark.readStream.schema(T.StructType(fields)).parquet(f"{path}/batch=*")
