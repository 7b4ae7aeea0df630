"""Batch and streaming sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from flowspark.functions import to_float, to_int
from flowspark.operators.prep import union_clients
from flowspark.schemas import ALERT, IDENTITY, REQUEST


def read_flows(spark: SparkSession, path: str, drop: list[str] = ()) -> DataFrame:
    """Flow records from parquet; dropped columns are never read."""
    return spark.read.parquet(path).drop(*drop)


def read_flows_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.csv(path, schema=schema, header=True)


def read_packets(spark: SparkSession, path: str, meta_cols: list[str] = IDENTITY) -> DataFrame:
    """Request rows from a raw packet CSV: the columns outside ``meta_cols``, in header order, form
    the feature vector. A feature or port that is not a number becomes 0."""
    raw = spark.read.csv(path, header=True)
    features = [c for c in raw.columns if c not in meta_cols]
    metadata = F.struct(
        F.col("IPV4_SRC_ADDR"), to_int("L4_SRC_PORT").alias("L4_SRC_PORT"),
        F.col("IPV4_DST_ADDR"), to_int("L4_DST_PORT").alias("L4_DST_PORT"),
    )
    return raw.select(
        metadata.alias("metadata"), F.array(*[to_float(c) for c in features]).alias("packet")
    )


def read_clients(spark: SparkSession, registry: list[tuple[str, str, str]]) -> DataFrame:
    """One table from many sources; ``registry`` lists (client, split, parquet path)."""
    return union_clients(
        [
            spark.read.parquet(path)
            .withColumn("client_id", F.lit(client)).withColumn("split", F.lit(split))
            for client, split, path in registry
        ]
    )


#: Levels below the document itself that a log may have.
_LEVELS = 7


def log_leaves(spark: SparkSession, path: str) -> DataFrame:
    """The values of JSON logs of any shape: rows (file, kinds, parts, value).

    ``parts`` leads from the document to the value, ``kinds`` has a letter per part: ``n`` for the name of
    an entry, ``i`` for the index of an item. Empty lists and objects have no rows, a null is a NULL; text, truth values
    and documents that are no JSON are errors that name the place. A file is one document, which is one row while
    it is taken apart and so has to fit a task; there may be any number of files.
    """
    docs = spark.read.text(path, wholetext=True)
    file = F.element_at(F.split(F.input_file_name(), "/"), -1)
    whole = F.try_parse_json("value")
    rows = docs.select(
        file.alias("file"), F.lit("").alias("kinds"), F.array().cast("array<string>").alias("parts"),
        F.when(whole.isNull(), F.raise_error(F.concat(F.lit("no JSON in "), file)))
        .otherwise(whole).alias("node"),
    )
    for _ in range(_LEVELS):
        children = spark.tvf.variant_explode_outer(F.col("node").outer())
        rows = rows.lateralJoin(children)
        inner, named = F.col("pos").isNotNull(), F.col("key").isNotNull()
        rows = rows.filter(inner | ~F.schema_of_variant("node").rlike("^(OBJECT|ARRAY)"))
        part = F.coalesce(F.col("key"), F.col("pos").cast("string"))
        rows = rows.select(
            "file",
            F.when(~inner, F.col("kinds")).otherwise(
                F.concat("kinds", F.when(named, F.lit("n")).otherwise(F.lit("i")))
            ).alias("kinds"),
            F.when(inner, F.array_append("parts", part)).otherwise(F.col("parts")).alias("parts"),
            F.when(inner, F.col("value")).otherwise(F.col("node")).alias("node"),
        )
    number = F.schema_of_variant("node").rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")
    place = F.concat(F.lit("no number at "), F.col("file"), F.lit(": "), F.array_join("parts", " / "))
    value = F.when(number, F.try_variant_get("node", "$", "double")).when(
        ~F.is_variant_null("node"), F.raise_error(place).cast("double")
    )
    return rows.select("file", "kinds", "parts", value.alias("value"))


def _of_shape(leaves: DataFrame, kinds: str) -> DataFrame:
    """The leaves, all of which have to lie at a place of the given kinds."""
    place = F.concat(F.lit("unknown log shape at "), F.col("file"), F.lit(": "), F.array_join("parts", " / "))
    known = F.col("kinds") == kinds
    return leaves.withColumn("parts", F.when(known, F.col("parts")).otherwise(
        F.raise_error(place).cast("array<string>")
    ))


def _part(i: int) -> Column:
    return F.get("parts", F.lit(i))


def _number(i: int) -> Column:
    return _part(i).cast("int")


#: Per shape of metric log: the kinds of its places, and where client, metric, model and round are in it.
_METRIC_LOGS = {
    "federated": ("nnii", ["parts[0]", "parts[1]", "int(parts[2])", "int(parts[3]) + 1"]),
    "central": ("nni", ["parts[0]", "parts[1]", "int(parts[2])", "1"]),
    "local": ("nnni", ["parts[1]", "parts[2]", "parts[0]", "int(parts[3]) + 1"]),
}


def read_metric_log(spark: SparkSession, path: str, setting: str = "federated") -> DataFrame:
    """Metric logs as rows (file, client, metric, model, round, value).

    ``federated`` logs hold a list of rounds per model; ``central`` logs one value per model, which
    becomes round 1. ``local`` logs are held by model, client and metric; their ``model`` is a name.
    The weighted history (:func:`read_round_losses`) is left out; any other shape is an error that names
    the place.
    """
    if setting not in _METRIC_LOGS:
        raise ValueError(f"unknown setting {setting!r}")
    kinds, places = _METRIC_LOGS[setting]
    leaves = log_leaves(spark, path).filter(~_part(0).eqNullSafe("weighted_metrics"))
    rows = _of_shape(leaves, kinds)
    names = ("client", "metric", "model", "round")
    return rows.select("file", *[F.expr(e).alias(n) for e, n in zip(places, names)], "value")


def read_round_losses(spark: SparkSession, path: str) -> DataFrame:
    """Weighted loss history of federated logs as rows (file, model, round, loss).

    A history is a list of models, each a name with lists of (round, value) pairs.
    """
    leaves = log_leaves(spark, path).filter(_part(0).eqNullSafe("weighted_metrics"))
    losses = leaves.filter(~_part(3).eqNullSafe("metrics_distributed"))
    pairs = _of_shape(losses, "ninnii").select(
        "file", _number(1).alias("model"), _part(3).alias("kind"), _number(4).alias("_pair"),
        _number(5).alias("_side"), "value",
    ).filter("kind = 'losses_distributed'")
    whole = pairs.groupBy("file", "model", "_pair").agg(
        F.max(F.when(F.col("_side") == 0, F.col("value"))).cast("int").alias("round"),
        F.max(F.when(F.col("_side") == 1, F.col("value"))).alias("loss"),
    )
    return whole.select("file", "model", "round", "loss")


def read_train_log(spark: SparkSession, path: str) -> DataFrame:
    """Training logs (client, epoch, loss) as rows (file, client, epoch, loss)."""
    rows = _of_shape(log_leaves(spark, path), "nnn").filter(_part(2) == "loss")
    epoch = F.regexp_extract(_part(1), r"(\d+)$", 1).cast("int")
    return rows.select("file", _part(0).alias("client"), epoch.alias("epoch"), F.col("value").alias("loss"))


def read_json_glob(
    spark: SparkSession, root: str, prefix: str, schema: T.StructType, multiline: bool = False
) -> DataFrame:
    """All JSON files below ``root`` whose name starts with ``prefix``."""
    return spark.read.json(
        root, schema=schema, pathGlobFilter=f"{prefix}*.json", recursiveFileLookup=True,
        multiLine=multiline,
    )


def read_scaler(spark: SparkSession, path: str, features: list[str]) -> DataFrame:
    """A scaler document as rows (feature, scale, offset); its ``min`` list holds the offsets."""
    doc = spark.read.json(path, schema="min array<double>, scale array<double>", multiLine=True)
    names = F.array(*[F.lit(f) for f in features])
    rows = doc.select(F.explode(F.arrays_zip(names.alias("feature"), "scale", "min")).alias("_s"))
    return rows.select("_s.feature", "_s.scale", F.col("_s.min").alias("offset"))


def message_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Raw message text of a folder of JSON-lines files (column ``value``)."""
    reader = spark.readStream.schema("value string").option("recursiveFileLookup", True)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.text(path)


def _json_stream(spark, path, schema, files_per_batch) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.json(path)


def request_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Request messages as they arrive in a folder."""
    return _json_stream(spark, path, REQUEST, files_per_batch)


def alert_stream(
    spark: SparkSession, path: str, files_per_batch: int | None = None,
    schema: T.StructType = ALERT,
) -> DataFrame:
    """Alert messages as they arrive in a folder."""
    return _json_stream(spark, path, schema, files_per_batch)
