"""Scoring rows with a linear or layered model, and scoring many models in one pass."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.functions import arrow_udf

from flowspark.operators import mlp
from flowspark.operators.metrics import rates
from flowspark.operators.prep import union_clients

#: Parameters the driver will hold or ship to a task at once (512 MB as arrays of doubles; several
#: times that while rows are being read into them).
MAX_PARAMETERS = 64_000_000

METRICS = ["accuracy", "precision", "recall", "f1_score", "final_loss"]


def linear_logit(features: list[Column | str], weights: list[float], bias: float) -> Column:
    """Weighted sum plus bias as one generated expression."""
    if len(features) != len(weights):
        raise ValueError("one weight per feature is needed")
    total = F.lit(float(bias))
    for f, w in zip(features, weights):
        total = total + (F.col(f) if isinstance(f, str) else f) * F.lit(float(w))
    return total


def score(
    df: DataFrame, model: list[np.ndarray], features: list[str] | str, out: str = "logit"
) -> DataFrame:
    """Add the logit of each row. ``features`` is a list of columns or one array column.

    The weights are broadcast once and rows travel as Arrow batches. A row with a missing feature,
    or a vector of the wrong width, gets NULL.
    """
    size = sum(t.size for t in model)
    if size > MAX_PARAMETERS:
        raise ValueError(f"model of {size} parameters is too large to broadcast")
    shared = df.sparkSession.sparkContext.broadcast(model)
    width = model[0].shape[0]

    def run(x: np.ndarray, ok: np.ndarray) -> pa.Array:
        z = np.full(len(ok), np.nan)
        if ok.any():
            z[ok] = mlp.logits(shared.value, x)
        return pa.array(z, mask=~ok)

    if isinstance(features, str):

        @arrow_udf(T.DoubleType())
        def predict(vectors: pa.Array) -> pa.Array:
            import pyarrow.compute as pc

            sizes = pc.fill_null(pc.list_value_length(vectors), -1).to_numpy(zero_copy_only=False)
            ok = sizes == width
            flat = vectors.filter(pa.array(ok)).flatten().to_numpy(zero_copy_only=False)
            x = flat.astype(float).reshape(-1, width)
            whole = ~np.isnan(x).any(axis=1)
            ok[np.flatnonzero(ok)[~whole]] = False
            return run(x[whole], ok)

        return df.withColumn(out, predict(features))

    @arrow_udf(T.DoubleType())
    def predict_columns(*cols: pa.Array) -> pa.Array:
        x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in cols])
        ok = ~np.isnan(x).any(axis=1)
        return run(x[ok], ok)

    return df.withColumn(out, predict_columns(*[F.col(f).cast("double") for f in features]))


def register_scorer(spark: SparkSession, name: str, models: dict[str, list[np.ndarray]]) -> None:
    """Make ``name(model, vector)`` callable from SQL: the logit of a vector by the model of that name.

    NULL where the vector is missing, of the wrong width or holds a missing value, and where no model has
    the name. Each row may name another model. Models come from :func:`load_models` or from arrays; they
    are shipped once, below the same size limit.
    """
    if sum(t.size for m in models.values() for t in m) > MAX_PARAMETERS:
        raise ValueError("the models are too large to broadcast: register them in groups")
    shared = spark.sparkContext.broadcast(models)

    @arrow_udf(T.DoubleType())
    def scorer(model: pa.Array, vectors: pa.Array) -> pa.Array:
        import pyarrow.compute as pc

        sizes = pc.fill_null(pc.list_value_length(vectors), -1).to_numpy(zero_copy_only=False)
        out, known = np.full(len(vectors), np.nan), np.zeros(len(vectors), bool)
        for key in model.unique().drop_null().to_pylist():
            net = shared.value.get(key)
            if net is None:
                continue
            mine = pc.fill_null(pc.equal(model, key), False).to_numpy(zero_copy_only=False)
            at = np.flatnonzero(mine & (sizes == net[0].shape[0]))
            if not len(at):
                continue
            flat = vectors.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False)
            x = flat.astype(float).reshape(len(at), -1)
            whole = ~np.isnan(x).any(axis=1)
            at = at[whole]
            if len(at):
                out[at], known[at] = mlp.logits(net, x[whole]), True
        return pa.array(out, mask=~known)

    spark.udf.register(name, scorer)


def model_rows(spark: SparkSession, model: list[np.ndarray]) -> DataFrame:
    """A model as rows (layer, pos, value)."""
    layer = np.concatenate([np.full(t.size, i) for i, t in enumerate(model)])
    pos = np.concatenate([np.arange(t.size) for t in model])
    value = np.concatenate([t.ravel() for t in model]).astype(float)
    frame = pd.DataFrame({"layer": layer.astype("int32"), "pos": pos.astype("int32"), "value": value})
    return spark.createDataFrame(frame, "layer int, pos int, value double")


def load_models(
    rows: DataFrame, shapes: list[tuple[int, ...]], by: str | None = None
) -> dict[str, list[np.ndarray]]:
    """Models from rows, by name. The size is known from the shapes and the number of models and is
    checked before anything is collected."""
    size = sum(int(np.prod(s)) for s in shapes)
    named = rows.withColumn("_name", F.col(by).cast("string") if by else F.lit(""))
    found = {r["_name"]: r["n"] for r in named.groupBy("_name").count()
             .withColumnRenamed("count", "n").limit(MAX_PARAMETERS // size + 1).collect()}
    if len(found) * size > MAX_PARAMETERS:
        raise ValueError("too many models for the driver: load them in groups")
    if any(n != size for n in found.values()):
        raise ValueError(f"a model has {size} parameters, found {found}")
    flat = named.select("_name", "layer", "pos", "value").toPandas()
    models = {}
    for name, one in flat.groupby("_name"):
        values = one.sort_values(["layer", "pos"])["value"].to_numpy()
        ends = np.cumsum([int(np.prod(s)) for s in shapes])[:-1]
        models[name] = [v.reshape(s) for v, s in zip(np.split(values, ends), shapes)]
    return models


def evaluate_models(
    df: DataFrame, models: dict[str, list[np.ndarray]], features: list[str], label: str, by: str,
    scalers: dict[str, tuple[np.ndarray, np.ndarray]] | None = None,
) -> DataFrame:
    """Every model on every test set: counts, rates and loss per (model, ``by``).

    Each row is read once and never multiplied: a task applies the models to its batches and emits
    one partial count per (model, test set). ``scalers`` holds the scale and offset of each model.
    Rows with a missing feature or label cannot be scored: they are counted under ``unscored`` and
    enter no rate and no loss. A missing test-set name is a test set of its own.
    """
    names = sorted(models)
    if len(names) > 1 and sum(t.size for m in models.values() for t in m) > MAX_PARAMETERS:
        half = len(names) // 2
        parts = [
            evaluate_models(df, {n: models[n] for n in some}, features, label, by, scalers)
            for some in (names[:half], names[half:])
        ]
        return union_clients(parts)
    shared = df.sparkSession.sparkContext.broadcast((models, scalers or {}))

    def partial(batches):
        nets, scales = shared.value
        sums: dict[tuple[str, str], np.ndarray] = {}

        def flush():
            out = pd.DataFrame(
                [(m, t, *(int(c) for c in v[:5]), float(v[5])) for (m, t), v in sums.items()],
                columns=["model", by, "tp", "fp", "fn", "tn", "unscored", "loss_sum"],
            )
            sums.clear()
            return out

        for pdf in batches:
            x = pdf[features].to_numpy(dtype=float)
            y = pdf[label].to_numpy(dtype=float)
            codes, tests = pd.factorize(pdf[by], use_na_sentinel=False)
            tests = [None if pd.isna(t) else t for t in tests]
            known = np.isfinite(x).all(axis=1) & np.isfinite(y)
            x, y = np.where(known[:, None], x, 0.0), np.where(known, y, 0.0)
            for name in names:
                scale, offset = scales.get(name, (1.0, 0.0))
                z = mlp.logits(nets[name], x * scale + offset)
                loss = np.maximum(z, 0) - z * y + np.log1p(np.exp(-np.abs(z)))
                p, t = z > 0, y > 0.5
                parts = [p & t & known, p & ~t & known, ~p & t & known, ~p & ~t & known, ~known,
                         np.where(known, loss, 0.0)]
                table = np.stack(
                    [np.bincount(codes, weights=q, minlength=len(tests)) for q in parts], axis=1
                )
                for test, row in zip(tests, table):
                    key = (name, test)
                    sums[key] = sums[key] + row if key in sums else row
            if len(sums) > 100_000:
                yield flush()
        if sums:
            yield flush()

    schema = f"model string, {by} string, tp long, fp long, fn long, tn long, unscored long, loss_sum double"
    rows = df.select(
        *[F.col(f).cast("double") for f in features], F.col(label).cast("double"),
        F.col(by).cast("string"),
    )
    parts = rows.mapInPandas(partial, schema)
    sums = parts.groupBy("model", by).agg(
        *[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn", "unscored", "loss_sum")]
    )
    n = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    return rates(sums).withColumn("final_loss", F.try_divide("loss_sum", n)).drop("loss_sum")


def as_metric_log(evaluated: DataFrame, client: str) -> DataFrame:
    """Evaluation as rows (model, client, metric, value)."""
    return evaluated.select("model", F.col(client).alias("client"), *METRICS).unpivot(
        ["model", "client"], METRICS, "metric", "value"
    )


def scaler_arrays(
    scaler: DataFrame, features: list[str], by: str | None = None
) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Scale and offset vectors by name, for shipping with models (one row per feature and name)."""
    named = scaler.withColumn("_name", F.col(by).cast("string") if by else F.lit(""))
    limit = MAX_PARAMETERS // 8
    rows = named.select("_name", "feature", "scale", "offset").limit(limit + 1).toPandas()
    if len(rows) > limit:
        raise ValueError("too many scalers for the driver: load them in groups")
    out = {}
    for name, one in rows.groupby("_name"):
        one = one.set_index("feature").loc[features]
        out[name] = (one["scale"].to_numpy(), one["offset"].to_numpy())
    return out
