"""Live answers of the monitor over an alert stream."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter

from flowspark.functions import alert_id
from flowspark.operators import monitor
from flowspark.operators.running_top import running_top
from flowspark.schemas import ALERT, STATISTICS


def flat_alerts(alerts: DataFrame) -> DataFrame:
    """Alert messages with the columns of the monitor operators added."""
    return alerts.select(
        "*", F.col("metadata.IPV4_SRC_ADDR").alias("src_ip"),
        F.col("metadata.IPV4_DST_ADDR").alias("dst_ip"), F.col("worker_name").alias("worker"),
    )


def live_totals(alerts: DataFrame) -> DataFrame:
    """Totals and means over all alerts so far (complete mode)."""
    return monitor.alert_totals(alerts)


def live_top(alerts: DataFrame, col: str, n: int = 5) -> DataFrame:
    """Top addresses so far (complete mode). State is one count per address."""
    return monitor.top_addresses(alerts, col, n)


def live_workers(alerts: DataFrame) -> DataFrame:
    """Classified packets per worker (update mode)."""
    return monitor.worker_counts(alerts)


def run_until_drained(writer: DataStreamWriter, timeout: int | None = None) -> None:
    """Process what the source holds, in batches of its size, then stop; raise what failed."""
    stream = writer.trigger(availableNow=True).start()
    if timeout is None:
        stream.awaitTermination()
    elif not stream.awaitTermination(timeout):
        stream.stop()
        raise TimeoutError(f"stream not drained in {timeout} s")


def _folders(spark: SparkSession, path: str, kind: str):
    """The file system of a result and its finished folders ``kind=N``, as numbers in order.

    A folder is finished once the job that wrote it left its success marker; a repeated batch takes the
    marker away before it writes again.
    """
    marker = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{kind}=*/_SUCCESS")
    files = marker.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath().getParent().getName() for f in files.globStatus(marker) or []]
    return files, sorted(int(n.split("=")[1]) for n in names)


def committed(spark: SparkSession, path: str, kind: str = "batch") -> list[int]:
    """Numbers of the finished batches of a result, in order."""
    return _folders(spark, path, kind)[1]


def _expire(spark: SparkSession, path: str, kind: str, before: int) -> None:
    """Remove the finished folders numbered less than ``before``."""
    files, numbers = _folders(spark, path, kind)
    for n in numbers:
        if n < before:
            files.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{kind}={n}"), True)


def _retained(retain: int) -> int:
    if retain < 2:
        raise ValueError("two batches at least are kept, as one may be repeated")
    return retain


def save_result(df: DataFrame, path: str, checkpoint: str, retain: int = 10) -> DataStreamWriter:
    """Keep the whole result of each batch (complete mode); read it with :func:`latest_batch`.

    The newest ``retain`` batches stay; a reader has to be done before that many more are written.
    """
    keep = _retained(retain)

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
        _expire(batch.sparkSession, path, "batch", number + 1 - keep)

    writer = df.writeStream.outputMode("complete").foreachBatch(save)
    return writer.option("checkpointLocation", checkpoint)


def save_changes(
    df: DataFrame, path: str, checkpoint: str, keys: list[str], compact: int = 10
) -> DataStreamWriter:
    """Keep the changed rows of each batch (update mode); read them with :func:`current`.

    Every ``compact`` batches, the newest row of each key is written as a base, and what lies before the
    base of the time before is removed. So a reader meets one base and fewer than ``2 * compact`` batches.
    """
    if compact < 1:
        raise ValueError("a base is written every batch at most")

    def save(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
        if (number + 1) % compact == 0:
            now = current(spark, path, keys, number)
            now.write.mode("overwrite").parquet(f"{path}/base={number}")
            _expire(spark, path, "batch", number + 1 - compact)
            _expire(spark, path, "base", number - compact)

    writer = df.writeStream.outputMode("update").foreachBatch(save)
    return writer.option("checkpointLocation", checkpoint)


def latest_batch(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the newest finished batch; no other folder is read."""
    done = committed(spark, path)
    if not done:
        raise FileNotFoundError(f"no finished batch in {path}")
    return spark.read.parquet(f"{path}/batch={done[-1]}")


def current(spark: SparkSession, path: str, keys: list[str], upto: int | None = None) -> DataFrame:
    """The newest row of each key over the changes so far: the last base and the batches after it.

    A base of batch ``upto`` itself is not used, so that a repeated batch can write it again.
    """
    bases = [n for n in committed(spark, path, "base") if upto is None or n < upto]
    start = bases[-1] if bases else -1
    later = [n for n in committed(spark, path) if n > start and (upto is None or n <= upto)]
    if not bases and not later:
        raise FileNotFoundError(f"no finished batch in {path}")
    parts = []
    if bases:
        parts.append(spark.read.parquet(f"{path}/base={start}").withColumn("batch", F.lit(-1)))
    if later:
        folders = [f"{path}/batch={n}" for n in later]
        parts.append(spark.read.option("basePath", path).parquet(*folders))
    rows = reduce(lambda a, b: a.unionByName(b), parts)
    values = [c for c in rows.columns if c not in [*keys, "batch"]]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("_v"))
    return newest.select(*keys, "_v.*")


def once(alerts: DataFrame, key: str, delay: str, order: str = "ts") -> DataFrame:
    """One alert per key, though messages are delivered again.

    A stream forgets a key ``delay`` after its event time, so repeats have to arrive within it; alerts
    older than ``delay`` behind the newest one are left out.
    """
    timed = alerts.withColumn("_at", F.col(order).cast("timestamp"))
    if not alerts.isStreaming:
        return alerts.dropDuplicates([key])
    return timed.withWatermark("_at", delay).dropDuplicatesWithinWatermark([key]).drop("_at")


def save_batches(df: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Append the rows of each batch in a folder under its number; read them with :func:`finished`.

    A batch that is repeated after a failure takes the place of its first attempt.
    """

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return df.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)


def finished(spark: SparkSession, path: str) -> DataFrame:
    """All rows of the finished batches of a result; half-written ones are not seen."""
    done = committed(spark, path)
    if not done:
        raise FileNotFoundError(f"no finished batch in {path}")
    return spark.read.parquet(*[f"{path}/batch={n}" for n in done])


def live_latest(
    alerts: DataFrame, path: str, checkpoint: str, n: int = 8, order: str = "ts",
    tie: str = "event_id", retain: int = 10,
) -> DataStreamWriter:
    """Keep the ``n`` newest alerts; batch k merges its own n newest with those of batch k - 1.

    The newest ``retain`` batches stay.
    """
    stay = _retained(retain)

    def keep(batch: DataFrame, number: int) -> None:
        newest = monitor.latest(batch, n, order, tie)
        if number > 0:
            kept = batch.sparkSession.read.schema(batch.schema).parquet(f"{path}/batch={number - 1}")
            newest = monitor.latest(newest.unionByName(kept), n, order, tie)
        newest.write.mode("overwrite").parquet(f"{path}/batch={number}")
        _expire(batch.sparkSession, path, "batch", number + 1 - stay)

    return alerts.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint)


_LISTED = {"src_ip": "malicious_ips", "dst_ip": "targeted_ips"}


def with_counts(alerts: DataFrame) -> DataFrame:
    """The alerts (kind NULL) and, as rows (kind, key, value), the malicious packets so far of every
    address that a batch changes. For update mode; Spark's state store keeps one count per address."""
    both = F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).alias("key")) for c in _LISTED])
    bad = alerts.filter("is_malicious").select(F.explode(both).alias("_k")).select("_k.*")
    counts = bad.filter("key IS NOT NULL").groupBy("kind", "key").agg(F.count(F.lit(1)).alias("value"))
    return alerts.unionByName(counts, allowMissingColumns=True)


def _means() -> dict:
    """The value summed up and whether it is known, by name of the mean."""
    return {
        name: (F.coalesce(F.col(c), F.lit(0.0)), F.col(c).isNotNull().cast("long"))
        for name, c in (("avg_latency", "latency"), ("avg_classification_time", "classification_time"))
    }


def snapshots(
    alerts: DataFrame, n: int = 5, carried: DataFrame | None = None, totals: DataFrame | None = None
) -> DataFrame:
    """Each alert with totals, means and top lists as they stand after it.

    ``carried`` (kind, key, value) and the one row ``totals`` hold what came before these alerts. A
    mean is over the known values so far, NULL where there are none yet.
    """
    sums = {
        "total_packets": F.lit(1).cast("long"),
        "total_malicious": F.col("is_malicious").cast("long"),
        **{name: value for name, (value, _) in _means().items()},
        **{f"{name}_known": known for name, (_, known) in _means().items()},
    }
    lists = {name: col for col, name in _LISTED.items()}
    rows = running_top(alerts, lists, n, sums=sums, base=carried)
    if totals is not None:
        start = totals.select(F.struct("*").alias("t")).scalar()
        for name in sums:
            rows = rows.withColumn(name, F.col(name) + start[name])
    return rows.select(
        *alerts.columns, "total_packets", "total_malicious",
        *[F.try_divide(F.col(name), F.col(f"{name}_known")).alias(name) for name in _means()], *lists,
    )


def snapshot_messages(rows: DataFrame, order: str = "ts", tie: str = "event_id") -> DataFrame:
    """Snapshots in the shape of the dashboard message: id, statistics and the alert itself."""
    return rows.select(
        alert_id(order, tie).alias("id"), F.struct(*STATISTICS.names).alias("stats"),
        F.struct(*ALERT.names).alias("packet_info"),
    )


def alert_snapshots(
    alerts: DataFrame, path: str, state: str, checkpoint: str, n: int = 5
) -> DataStreamWriter:
    """Every alert with running totals, means and top lists as of it.

    Rows are taken in the order (ts, event_id) within a batch; a late row counts in the batch in
    which it arrives. Counts per address are a streaming aggregation of their own in the same query;
    from batch to batch only the row of totals and ``n`` entries per list are carried, under the batch
    number, so a repeated batch starts from what the first attempt started from. Of what is carried, two
    batches stay. A batch is written once before it is used, so that a lost executor neither asks the
    state for it again nor repeats its reading; this copy goes when the batch is done. Read the rows with
    :func:`finished`.
    """
    columns = alerts.columns
    longs = ["total_packets", "total_malicious", *(f"{m}_known" for m in _means())]
    fields = [*(f"{c} bigint" for c in longs), *(f"{m} double" for m in _means())]
    total_cols, names = ", ".join(fields), [f.split()[0] for f in fields]

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        shape = batch.schema
        batch.write.mode("overwrite").parquet(f"{state}/input={number}")
        batch = spark.read.schema(shape).parquet(f"{state}/input={number}")
        new = batch.filter("kind IS NULL").select(columns)
        after = batch.filter("kind IS NOT NULL").select("kind", "key", "value")
        if number > 0:
            totals = spark.read.schema(total_cols).parquet(f"{state}/totals={number - 1}")
            top = spark.read.schema(after.schema).parquet(f"{state}/top={number - 1}")
        else:
            totals = spark.createDataFrame([(0,) * len(longs) + (0.0,) * len(_means())], total_cols)
            top = spark.createDataFrame([], after.schema)
        added = [monitor.address_counts(new, c).withColumn("kind", F.lit(c)) for c in _LISTED]
        added = reduce(lambda a, b: a.unionByName(b), added).withColumnRenamed("value", "_new")
        before = after.join(added, ["kind", "key"]).select(
            "kind", "key", (F.col("value") - F.col("_new")).alias("value")
        )
        carried = before.filter("value > 0").unionByName(top).distinct()
        carried.write.mode("overwrite").parquet(f"{state}/before={number}")  # read for both lists, twice
        carried = spark.read.schema(after.schema).parquet(f"{state}/before={number}")
        snapshots(new, n, carried, totals).write.mode("overwrite").parquet(f"{path}/batch={number}")
        now = after.unionByName(top).groupBy("kind", "key").agg(F.max("value").alias("value"))
        best = [
            now.filter(F.col("kind") == c).orderBy(F.desc("value"), F.desc("key")).limit(n)
            for c in _LISTED
        ]
        best = reduce(lambda a, b: a.unionByName(b), best)
        best.write.mode("overwrite").parquet(f"{state}/top={number}")
        sums = new.select(
            F.lit(1).cast("long").alias("total_packets"),
            F.coalesce(F.col("is_malicious").cast("long"), F.lit(0)).alias("total_malicious"),
            *[value.alias(m) for m, (value, _) in _means().items()],
            *[known.alias(f"{m}_known") for m, (_, known) in _means().items()],
        ).unionByName(totals)
        sums = sums.agg(*[F.sum(c).alias(c) for c in names])
        sums.write.mode("overwrite").parquet(f"{state}/totals={number}")
        for kind in ("input", "before"):
            _expire(spark, state, kind, number + 1)
        for kind in ("top", "totals"):
            _expire(spark, state, kind, number - 1)

    writer = with_counts(alerts).writeStream.outputMode("update").foreachBatch(run)
    return writer.option("checkpointLocation", checkpoint)
