"""Batch sinks. Files are as many as the partitions of the result; none is funnelled to one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Compression of messages: a third more bytes than at the usual level, in a quarter of its time.
FAST = {"compression": "gzip", "zlib.compress.level": "BEST_SPEED"}


def write_flows(df: DataFrame, path: str, mode: str = "error", by: list[str] = ()) -> None:
    """Parquet with gzip, optionally in a folder per value of ``by``."""
    df.write.mode(mode).option("compression", "gzip").partitionBy(*by).parquet(path)


def write_json(df: DataFrame, path: str, mode: str = "error", rows_per_file: int | None = None) -> None:
    """JSON lines, timestamps to the microsecond.

    With ``rows_per_file`` they are compressed (:data:`FAST`), in files of at most so many rows: a compressed file
    is read by one task.
    """
    writer = df.write.mode(mode).option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    if rows_per_file:
        writer = writer.options(**FAST).option("maxRecordsPerFile", rows_per_file)
    writer.option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").json(path)


def write_csv(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.mode(mode).csv(path, header=True)


def _series(log: DataFrame, by: list[str], order: str, value: str, out: str) -> DataFrame:
    """The values of each group as a list in order: its length is the number of rounds or models."""
    return log.groupBy(*by).agg(
        F.sort_array(F.collect_list(F.struct(order, value)))[value].alias(out)
    )


def _write_documents(docs: DataFrame, folder: str, body: Column, path: str, mode: str) -> None:
    writer = docs.select(F.col(folder).alias("log"), F.to_json(body).alias("value")).write
    writer.mode(mode).partitionBy("log").text(path)


def _under(name: str, body: Column) -> Column:
    return F.map_from_arrays(F.array(name), F.array(body))


def write_metric_log(log: DataFrame, path: str, mode: str = "error", setting: str = "federated") -> None:
    """Metric rows (client, metric, model, round, value) as nested JSON logs, in a folder per client.

    ``federated``: client -> metric -> a list of rounds per model. ``central``: client -> metric -> a value
    per model, that of its last round. ``local``: model -> client -> metric -> values by round.
    Models of the first two are told apart by their place in the list.
    """
    by = ["client", "metric"]
    if setting == "federated":
        lists = _series(log, [*by, "model"], "round", "value", "values")
        lists = _series(lists, by, "model", "values", "values")
    elif setting == "central":
        last = log.groupBy(*by, "model").agg(F.max_by("value", "round").alias("value"))
        lists = _series(last, by, "model", "value", "values")
    elif setting == "local":
        by = ["model", *by]
        lists = _series(log.withColumn("model", F.col("model").cast("string")), by, "round", "value", "values")
    else:
        raise ValueError(f"unknown setting {setting!r}")
    docs = lists.groupBy(*by[:-1]).agg(
        F.map_from_entries(F.collect_list(F.struct("metric", "values"))).alias("metrics")
    )
    body = _under("client", F.col("metrics"))
    if setting == "local":
        models = F.struct("model", body)
        docs = docs.groupBy("client").agg(F.map_from_entries(F.collect_list(models)).alias("models"))
        body = F.col("models")
    _write_documents(docs, "client", body, path, mode)


def write_train_log(log: DataFrame, path: str, mode: str = "error") -> None:
    """Training losses (client, epoch, loss) as JSON logs, a document per client: epoch_<n> -> loss."""
    epoch = F.struct(F.concat(F.lit("epoch_"), F.col("epoch").cast("string")), F.struct("loss"))
    docs = log.groupBy("client").agg(F.map_from_entries(F.sort_array(F.collect_list(epoch))).alias("_epochs"))
    _write_documents(docs, "client", _under("client", F.col("_epochs")), path, mode)


def write_round_losses(losses: DataFrame, path: str, mode: str = "error") -> None:
    """The weighted loss history (model, round, loss) of one run as one JSON document.

    It holds a list per model of its (round, loss) pairs: a row per model and round of a run.
    """
    pair = F.array(F.col("round").cast("double"), F.col("loss"))
    models = _series(losses.withColumn("_pair", pair), ["model"], "round", "_pair", "losses_distributed")
    name = F.concat(F.lit("model_"), (F.col("model") + 1).cast("string"))
    body = F.struct(F.expr("map() :: map<string, double>").alias("metrics_distributed"), "losses_distributed")
    entries = models.withColumn("_name", name).select("model", F.to_json(_under("_name", body)).alias("_m"))
    listed = _series(entries, [], "model", "_m", "_all")
    text = F.concat(F.lit('{"weighted_metrics":['), F.array_join("_all", ","), F.lit("]}"))
    listed.select(text.alias("value")).write.mode(mode).text(path)


def write_scaler(scaler: DataFrame, features: list[str], path: str, mode: str = "error") -> None:
    """A min-max scaler as one JSON document: lists ``min`` (the offsets) and ``scale``, in feature
    order."""
    by_name = scaler.agg(
        *[
            F.max(F.when(F.col("feature") == f, F.col(field))).alias(f"{f}__{field}")
            for f in features for field in ("offset", "scale")
        ]
    )
    lists = by_name.select(
        F.array(*[F.col(f"{f}__offset") for f in features]).alias("min"),
        F.array(*[F.col(f"{f}__scale") for f in features]).alias("scale"),
    )
    lists.write.mode(mode).json(path)
