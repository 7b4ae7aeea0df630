"""Queries of the live monitor in batch form, display functions and metric reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from flowspark import functions as fn
from flowspark.functions import normal
from flowspark.operators import hypothesis, joins, metrics, monitor, params as fed
from flowspark.plans.prepare_queries import r6
from flowspark.plans.registry import query
from flowspark.plans.standins import (
    ALERTS, LOGITS, LOSSES, METRIC_LOG, PARAMS, PREDICTIONS, WORKER_FILES, alerts, logits,
    metric_log, model_losses, params, predictions, table, worker_files,
)

# --- totals and rankings ------------------------------------------------------------------------

TOTALS = """SELECT count(*) AS total_packets,
  count(*) FILTER (WHERE is_malicious) AS total_malicious, round(avg(latency), 6) AS avg_latency,
  round(avg(classification_time), 6) AS avg_classification_time FROM alerts"""


@query(
    "monitor_snapshot",
    f"""WITH {ALERTS}, t AS ({TOTALS}),
    top AS (SELECT src_ip AS key, count(*) AS value FROM alerts WHERE is_malicious
      GROUP BY src_ip ORDER BY value DESC, key DESC LIMIT 5)
    SELECT CAST(row_number() OVER (ORDER BY value DESC, key DESC) AS INTEGER) AS rank, key, value,
      total_packets, total_malicious, avg_latency, avg_classification_time FROM top, t""",
)
def monitor_snapshot(spark, sf):
    rows = alerts(spark, sf)
    top = monitor.ranked(monitor.top_addresses(rows, "src_ip", 5))
    totals = monitor.alert_totals(rows).select(F.struct("*").alias("t")).scalar()
    return top.select(
        "rank", "key", "value", totals["total_packets"].alias("total_packets"),
        totals["total_malicious"].alias("total_malicious"), r6(totals["avg_latency"], "avg_latency"),
        r6(totals["avg_classification_time"], "avg_classification_time"),
    )


@query("alert_totals", f"WITH {ALERTS} {TOTALS}")
def alert_totals(spark, sf):
    return monitor.alert_totals(alerts(spark, sf)).select(
        "total_packets", "total_malicious", r6("avg_latency"), r6("avg_classification_time")
    )


@query(
    "malicious_pct",
    f"WITH {ALERTS} SELECT round(100.0 * count(*) FILTER (WHERE is_malicious) / count(*), 6) AS malicious_pct FROM alerts",
)
def malicious_pct(spark, sf):
    return monitor.malicious_pct(alerts(spark, sf)).select(r6("malicious_pct"))


@query(
    "traffic_mix",
    f"""WITH {ALERTS} SELECT CASE WHEN is_malicious THEN 'malicious' ELSE 'normal' END AS category,
      count(*) AS packets FROM alerts GROUP BY 1""",
)
def traffic_mix(spark, sf):
    return monitor.traffic_mix(alerts(spark, sf))


def _counts(col: str) -> str:
    return f"WITH {ALERTS} SELECT {col} AS key, count(*) AS value FROM alerts WHERE is_malicious GROUP BY {col}"


@query("source_counts", _counts("src_ip"))
def source_counts(spark, sf):
    return monitor.address_counts(alerts(spark, sf), "src_ip")


@query("dest_counts", _counts("dst_ip"))
def dest_counts(spark, sf):
    return monitor.address_counts(alerts(spark, sf), "dst_ip")


def _top(col: str) -> str:
    return f"""SELECT CAST(row_number() OVER (ORDER BY value DESC, key DESC) AS INTEGER) AS rank, key, value
    FROM ({_counts(col)}) QUALIFY rank <= 5"""


@query("top_malicious", _top("src_ip"))
def top_malicious(spark, sf):
    return monitor.ranked(monitor.top_addresses(alerts(spark, sf), "src_ip"))


@query("top_targeted", _top("dst_ip"))
def top_targeted(spark, sf):
    return monitor.ranked(monitor.top_addresses(alerts(spark, sf), "dst_ip"))


@query("worker_counts", f"WITH {ALERTS} SELECT worker AS key, count(*) AS value FROM alerts GROUP BY worker")
def worker_counts(spark, sf):
    return monitor.worker_counts(alerts(spark, sf))


@query(
    "worker_counts_filled",
    f"""WITH {ALERTS}, dim AS (SELECT DISTINCT 'worker' || (n_nationkey % 8) AS key FROM nation)
    SELECT key, count(worker) AS value FROM dim LEFT JOIN alerts ON worker = key GROUP BY key""",
)
def worker_counts_filled(spark, sf):
    dim = table(spark, sf, "nation").select(
        F.concat(F.lit("worker"), (F.col("n_nationkey") % 8).cast("string")).alias("key")
    ).distinct()
    return joins.fill_dimension(dim, monitor.worker_counts(alerts(spark, sf)), "key")


@query(
    "latest_alerts",
    f"""WITH {ALERTS} SELECT event_id, src_ip, dst_ip, is_malicious, latency FROM alerts
    ORDER BY ts DESC, event_id DESC LIMIT 8""",
)
def latest_alerts(spark, sf):
    rows = monitor.latest(alerts(spark, sf))
    return rows.select("event_id", "src_ip", "dst_ip", "is_malicious", "latency")


# --- timing -------------------------------------------------------------------------------------


def _timing(col: str, lead: str = "") -> str:
    quantiles = ", ".join(
        f"round(quantile_cont({col}, {q}), 6) AS {name}" for name, q in monitor.TIMING_POINTS.items()
    )
    return f"{lead} round(avg({col}), 6) AS mean, {quantiles}"


@query(
    "timing_metrics",
    f"""WITH {ALERTS} SELECT {_timing('latency', 'worker,')}, max(latency) AS max, min(latency) AS min
    FROM alerts GROUP BY worker
    UNION ALL SELECT {_timing('latency', "'all',")}, max(latency), min(latency) FROM alerts""",
)
def timing_metrics(spark, sf):
    rows = alerts(spark, sf)
    names = ["worker", r6("mean"), *[r6(p) for p in monitor.TIMING_POINTS], "max", "min"]
    return monitor.timing_metrics(rows, "latency", ["worker"], "all").select(*names)


@query(
    "run_rollup",
    f"""WITH {WORKER_FILES}, runs AS (SELECT run, count(*) AS total_files,
      CAST(sum(processed_packets) AS BIGINT) AS processed_packets, round(avg(total_timer), 6) AS mean
      FROM worker_files GROUP BY run)
    SELECT runs.*, CAST(row_number() OVER (PARTITION BY run ORDER BY total_timer) AS INTEGER) AS place,
      total_timer AS timer
    FROM runs JOIN worker_files USING (run)""",
)
def run_rollup(spark, sf):
    rows = monitor.run_rollup(worker_files(spark, sf), "run")
    timers = F.posexplode("timers").alias("place", "timer")
    rows = rows.select("run", "total_files", "processed_packets", r6("mean"), timers)
    return rows.withColumn("place", F.col("place") + 1)


@query(
    "throughput_summary",
    f"""WITH {WORKER_FILES},
    runs AS (SELECT run % 5 + 1 AS workers, avg(total_timer) AS timer FROM worker_files GROUP BY run)
    SELECT CAST(workers AS INTEGER) AS workers, {_timing('timer')} FROM runs GROUP BY workers""",
)
def throughput_summary(spark, sf):
    runs = monitor.run_rollup(worker_files(spark, sf), "run")
    runs = runs.select((F.col("run") % 5 + 1).alias("workers"), F.col("mean").alias("timer"))
    rows = monitor.throughput_summary(runs, "workers", "timer")
    return rows.select("workers", r6("mean"), *[r6(p) for p in monitor.TIMING_POINTS])


# --- running values -----------------------------------------------------------------------------


@query(
    "running_stats",
    f"""WITH {ALERTS} SELECT event_id,
      row_number() OVER w AS total_packets,
      count(*) FILTER (WHERE is_malicious) OVER w AS total_malicious,
      round(sum(latency) OVER w, 6) / row_number() OVER w AS avg_latency,
      round(sum(classification_time) OVER w, 6) / row_number() OVER w AS avg_classification_time
    FROM alerts WINDOW w AS (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""",
)
def running_stats(spark, sf):
    rows = monitor.running_stats(alerts(spark, sf))
    n = F.col("total_packets")
    # the sums are whole multiples of 1e-6: rounding them (not the means) removes summation noise
    means = ["avg_latency", "avg_classification_time"]
    return rows.select(
        "event_id", "total_packets", "total_malicious",
        *[(F.round(F.col(c) * n, 6) / n).alias(c) for c in means],
    )


@query(
    "running_source_counts",
    f"""WITH {ALERTS} SELECT event_id, src_ip,
      row_number() OVER (PARTITION BY src_ip ORDER BY ts, event_id) AS running_count
    FROM alerts WHERE is_malicious""",
)
def running_source_counts(spark, sf):
    rows = monitor.running_address_counts(alerts(spark, sf), "src_ip")
    return rows.select("event_id", "src_ip", "running_count")


# --- display and parsing functions --------------------------------------------------------------


@query(
    "fmt_duration",
    """WITH d AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN value / 500 WHEN 1 THEN value
        WHEN 2 THEN value * 30 ELSE value * 300 END AS s FROM events)
    SELECT event_id, CASE
      WHEN s < 1 THEN CAST(floor(s * 1000 + 0.5) AS BIGINT) || 'ms'
      WHEN s < 60 THEN CAST(floor(s + 0.5) AS BIGINT) || ' second' || CASE WHEN s = 1 THEN '' ELSE 's' END
      WHEN s < 3600 THEN CAST(floor(s / 60 + 0.5) AS BIGINT) || ' minute'
        || CASE WHEN floor(s / 60 + 0.5) = 1 THEN '' ELSE 's' END
      ELSE CAST(floor(s / 3600 + 0.5) AS BIGINT) || ' hour'
        || CASE WHEN floor(s / 3600 + 0.5) = 1 THEN '' ELSE 's' END END AS text FROM d""",
)
def fmt_duration(spark, sf):
    kind, v = F.col("event_id") % 4, F.col("value")
    seconds = F.when(kind == 0, v / 500).when(kind == 1, v).when(kind == 2, v * 30).otherwise(v * 300)
    return table(spark, sf, "events").select("event_id", fn.fmt_duration(seconds).alias("text"))


@query("fmt_seconds", "SELECT event_id, format('{:,.4f}', value * 100) || 's' AS text FROM events")
def fmt_seconds(spark, sf):
    return table(spark, sf, "events").select(
        "event_id", fn.fmt_seconds(F.col("value") * 100).alias("text")
    )


@query(
    "fmt_pct",
    """SELECT user_id, format('{:,.4f}', round(100.0 * count(*) FILTER (WHERE event_type = 'error')
      / count(*), 8)) AS text FROM events GROUP BY user_id""",
)
def fmt_pct(spark, sf):
    share = 100.0 * F.count_if(F.col("event_type") == "error") / F.count(F.lit(1))
    rows = table(spark, sf, "events").groupBy("user_id").agg(share.alias("share"))
    return rows.select("user_id", fn.fmt_pct("share").alias("text"))


@query(
    "fmt_compact",
    """WITH n AS (SELECT o_orderkey, CAST(floor(o_totalprice * CASE o_orderkey % 4 WHEN 0 THEN 0.001
        WHEN 1 THEN 0.1 WHEN 2 THEN 10 ELSE 100000 END) AS BIGINT) AS v FROM orders),
    u AS (SELECT *, CASE WHEN v < 1000 THEN 1 WHEN floor(v / 1000 + 0.5) < 1000 THEN 1000
        WHEN floor(v / 1000000 + 0.5) < 1000 THEN 1000000 ELSE 1000000000 END AS s FROM n)
    SELECT o_orderkey, CASE
      WHEN floor(v / s * 10 + 0.5) < 100 AND CAST(floor(v / s * 10 + 0.5) AS BIGINT) % 10 <> 0
      THEN CAST(floor(v / s * 10 + 0.5) AS BIGINT) // 10 || '.' || CAST(floor(v / s * 10 + 0.5) AS BIGINT) % 10
      ELSE CAST(CAST(floor(v / s + 0.5) AS BIGINT) AS VARCHAR) END
      || CASE s WHEN 1 THEN '' WHEN 1000 THEN 'K' WHEN 1000000 THEN 'M' ELSE 'B' END AS text FROM u""",
)
def fmt_compact(spark, sf):
    kind = F.col("o_orderkey") % 4
    factor = F.when(kind == 0, F.lit(0.001)).when(kind == 1, 0.1).when(kind == 2, 10.0).otherwise(1e5)
    n = F.floor(F.col("o_totalprice") * factor)
    return table(spark, sf, "orders").select("o_orderkey", fn.fmt_compact(n).alias("text"))


@query(
    "fmt_bool",
    f"WITH {ALERTS} SELECT event_id, CASE WHEN is_malicious THEN 'True' ELSE 'False' END AS text FROM alerts",
)
def fmt_bool(spark, sf):
    return alerts(spark, sf).select("event_id", fn.fmt_bool("is_malicious").alias("text"))


@query(
    "sigmoid_decide",
    f"WITH {LOGITS} SELECT event_id, round(1 / (1 + exp(-logit)), 6) AS p, logit > 0 AS positive FROM logits",
)
def sigmoid_decide(spark, sf):
    return logits(spark, sf).select(
        "event_id", r6(fn.sigmoid("logit"), "p"), fn.decide("logit").alias("positive")
    )


@query(
    "lenient_parse",
    """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 0.0 ELSE value END AS as_float,
      CASE WHEN event_id % 2 = 0 THEN 0 ELSE CAST(user_id AS INTEGER) END AS as_int FROM events""",
)
def lenient_parse(spark, sf):
    value = F.when(F.col("event_id") % 3 == 0, "n/a").otherwise(F.col("value").cast("string"))
    port = F.when(F.col("event_id") % 2 == 0, "").otherwise(F.col("user_id").cast("string"))
    return table(spark, sf, "events").select(
        "event_id", fn.to_float(value).alias("as_float"), fn.to_int(port).alias("as_int")
    )


@query(
    "parse_keys",
    """SELECT c_custkey, CAST(c_nationkey AS INTEGER) AS client_no, upper(c_mktsegment) AS dataset,
      c_nationkey || '_' || c_custkey AS run FROM customer""",
)
def parse_keys(spark, sf):
    c = table(spark, sf, "customer")
    number = F.col("c_nationkey").cast("string")
    client = F.concat(F.lit("client-"), number, F.lit(": "), F.lower("c_mktsegment"))
    file = F.concat(F.lit("metrics_"), number, F.lit("_"), F.col("c_custkey").cast("string"), F.lit(".json"))
    return c.select(
        "c_custkey", fn.client_no(client).alias("client_no"),
        fn.client_dataset(client).alias("dataset"), fn.run_key(file).alias("run"),
    )


@query(
    "latency_seconds",
    """SELECT event_id, date_diff('microsecond', ts, ts + to_microseconds(CAST(round(value * 1e4) AS BIGINT)))
      / 1e6 AS latency FROM events""",
)
def latency_seconds(spark, sf):
    sent = F.col("ts").cast("timestamp")
    now = F.timestamp_micros(F.unix_micros(sent) + F.round(F.col("value") * 1e4).cast("long"))
    return table(spark, sf, "events").select("event_id", fn.latency_s(sent, now).alias("latency"))


@query("alert_id", f"WITH {ALERTS} SELECT event_id, md5(event_id || ':' || src_ip || ':' || dst_ip) AS id FROM alerts")
def alert_id(spark, sf):
    return alerts(spark, sf).select("event_id", fn.alert_id("event_id", "src_ip", "dst_ip").alias("id"))


# --- model quality ------------------------------------------------------------------------------


@query(
    "last_round",
    f"""WITH {METRIC_LOG} SELECT client, metric, model, max(round) AS round,
      round(max_by(value, round), 6) AS value FROM metric_log GROUP BY client, metric, model""",
)
def last_round(spark, sf):
    return metrics.last_round(metric_log(spark, sf)).select(
        "client", "metric", "model", "round", r6("value")
    )


@query(
    "metric_report",
    f"""WITH {METRIC_LOG} SELECT client, metric, round(avg(value) * 100, 6) AS mean,
      round(var_samp(value), 6) AS variance, round(stddev_samp(value) * 100, 6) AS std,
      round(max(value), 6) AS max, round(min(value), 6) AS min, round(median(value), 6) AS median
    FROM metric_log GROUP BY client, metric""",
)
def metric_report(spark, sf):
    report = metrics.metric_report(metric_log(spark, sf))
    names = ["mean", "variance", "std", "max", "min", "median"]
    return report.select("client", "metric", *[r6(n) for n in names])


@query(
    "binary_metrics",
    f"""WITH {PREDICTIONS}, c AS (SELECT client,
      count(*) FILTER (WHERE pred = 1 AND label = 1) AS tp, count(*) FILTER (WHERE pred = 1 AND label = 0) AS fp,
      count(*) FILTER (WHERE pred = 0 AND label = 1) AS fn, count(*) FILTER (WHERE pred = 0 AND label = 0) AS tn
      FROM predictions GROUP BY client)
    SELECT client, tp, fp, fn, tn, round(coalesce((tp + tn) / (tp + fp + fn + tn), 0), 6) AS accuracy,
      round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision,
      round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall,
      round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1_score FROM c""",
)
def binary_metrics(spark, sf):
    rows = metrics.binary_metrics(predictions(spark, sf), "pred", "label", ["client"])
    rates = ["accuracy", "precision", "recall", "f1_score"]
    return rows.select("client", "tp", "fp", "fn", "tn", *[r6(r) for r in rates])


BCE = "greatest(logit, 0) - logit * label + ln(1 + exp(-abs(logit)))"


@query("bce_loss", f"WITH {LOGITS} SELECT client, round(avg({BCE}), 6) AS loss FROM logits GROUP BY client")
def bce_loss(spark, sf):
    rows = metrics.bce_loss(logits(spark, sf), "logit", "label", ["client"])
    return rows.select("client", r6("loss"))


@query(
    "weighted_metric",
    f"WITH {WORKER_FILES} SELECT round(sum(total_timer * processed_packets) / sum(processed_packets), 6) AS total_timer FROM worker_files",
)
def weighted_metric(spark, sf):
    rows = metrics.weighted_metric(worker_files(spark, sf), "total_timer", "processed_packets")
    return rows.select(r6("total_timer"))


BEST = """final AS (SELECT model, max_by(loss, round) AS loss FROM losses GROUP BY model),
best AS (SELECT model, loss FROM final ORDER BY loss, model LIMIT 1)"""


@query("best_model", f"WITH {LOSSES}, {BEST} SELECT model, round(loss, 6) AS loss FROM best")
def best_model(spark, sf):
    return metrics.best_model(model_losses(spark, sf)).select("model", r6("loss"))


@query(
    "metric_by_round",
    f"""WITH {METRIC_LOG}, {LOSSES}, {BEST} SELECT client, model,
      CAST(row_number() OVER (PARTITION BY client ORDER BY round) AS INTEGER) AS round,
      round(value, 6) AS value
    FROM metric_log JOIN best USING (model) WHERE metric = 'score'""",
)
def metric_by_round(spark, sf):
    rows = metrics.metric_by_round(metric_log(spark, sf), model_losses(spark, sf), "score")
    return rows.select("client", "model", "round", r6("value"))


@query(
    "loss_curve",
    f"""WITH {METRIC_LOG} SELECT CAST(length(client) AS DOUBLE) AS epochs, 0e0 AS mu, client,
      CAST(row_number() OVER (PARTITION BY client ORDER BY round) AS INTEGER) AS round,
      round(value, 6) AS loss
    FROM metric_log WHERE metric = 'final_loss' AND model = 0""",
)
def loss_curve(spark, sf):
    log = metric_log(spark, sf)
    file = F.concat(F.lit("metrics_"), F.length("client").cast("string"), F.lit("_0.json"))
    rows = metrics.loss_curve(log.withColumn("run", fn.run_key(file)), "fedprox")
    return rows.select("epochs", "mu", "client", "round", r6("loss"))


@query(
    "federated_eval",
    f"""WITH {LOGITS}, c AS (SELECT round, client, count(*) AS n, avg({BCE}) AS loss,
      avg(CAST((logit > 0) = (label = 1) AS DOUBLE)) AS accuracy FROM logits GROUP BY round, client)
    SELECT round, round(sum(loss * n) / sum(n), 6) AS loss,
      round(sum(accuracy * n) / sum(n), 6) AS accuracy, CAST(sum(n) AS BIGINT) AS n
    FROM c GROUP BY round""",
)
def federated_eval(spark, sf):
    rows = metrics.federated_eval(logits(spark, sf), "round", "client", "logit", "label")
    return rows.select("round", r6("loss"), r6("accuracy"), "n")


MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(
    "describe_feature",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS feature, count({c}) AS n, round(avg({c}), 6) AS mean,
        round(stddev_samp({c}), 6) AS std, min({c}) AS min, max({c}) AS max,
        round(quantile_cont({c}, 0.25), 6) AS q25, round(quantile_cont({c}, 0.5), 6) AS q50,
        round(quantile_cont({c}, 0.75), 6) AS q75 FROM lineitem"""
        for c in MEASURES
    ),
)
def describe_feature(spark, sf):
    rows = metrics.describe(table(spark, sf, "lineitem"), MEASURES)
    return rows.select(
        "feature", "n", r6("mean"), r6("std"), "min", "max", r6("q25"), r6("q50"), r6("q75")
    )


# --- significance tests -------------------------------------------------------------------------


def _ratio(parts: tuple[list[float], list[float]], r: str) -> str:
    def poly(coefficients):
        text = f"{coefficients[-1]!r}::DOUBLE"
        for c in reversed(coefficients[:-1]):
            text = f"({text} * {r} + {c!r}::DOUBLE)"
        return text

    return f"{poly(parts[0])} / {poly(parts[1])}"


# Normal quantile of p in SQL; q = p - 1/2, t = sqrt(-ln(min(p, 1 - p))) below 5.
_QUANTILE = f"""CASE WHEN abs(q) <= 0.425 THEN q * {_ratio(normal.QUANTILE_CENTRE, '(0.180625::DOUBLE - q * q)')}
  ELSE sign(q) * {_ratio(normal.QUANTILE_TAIL, '(t - 1.6::DOUBLE)')} END"""


def _tail_sql(z: str) -> str:
    """Upper tail of the standard normal in SQL, for |z| below 5.6."""
    x = f"(abs({z}) / sqrt(2::DOUBLE))"
    erfc = f"""CASE WHEN {x} <= 0.46875 THEN 1 - {x} * {_ratio(normal.ERF_SMALL, f'({x} * {x})')}
      ELSE exp(-{x} * {x}) * {_ratio(normal.ERFC_MIDDLE, x)} END"""
    return f"CASE WHEN {z} >= 0 THEN ({erfc}) / 2 ELSE 1 - ({erfc}) / 2 END"


RANK_TEST = f"""WITH {ALERTS},
    v AS (SELECT worker, latency, count(*) AS n, count(*) FILTER (WHERE is_malicious) AS c1
      FROM alerts GROUP BY worker, latency),
    r AS (SELECT *, sum(n) OVER (PARTITION BY worker ORDER BY latency) - n + (n + 1) / 2 AS ar FROM v),
    s AS (SELECT worker, sum(c1) AS n1, sum(n - c1) AS n2, sum(n) AS nn, sum(c1 * ar) AS r1,
      sum(CAST(n AS DOUBLE) ** 3 - n) AS ties FROM r GROUP BY worker),
    t AS (SELECT worker, n1, n2, r1 - n1 * (n1 + 1) / 2 AS u,
      sqrt(n1 * n2 / 12 * ((nn + 1) - ties / (nn * (nn - 1)))) AS sd FROM s),
    z AS (SELECT worker, CAST(n1 AS BIGINT) AS n1, CAST(n2 AS BIGINT) AS n2, u,
      (greatest(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5) / sd AS z FROM t)"""


@query("mann_whitney_u", f"{RANK_TEST} SELECT worker, n1, n2, u, round(z, 6) AS z FROM z")
def mann_whitney_u(spark, sf):
    rows = hypothesis.mann_whitney(alerts(spark, sf), "latency", "is_malicious", ["worker"])
    return rows.select("worker", "n1", "n2", "u", r6("z"))


@query(
    "mann_whitney_p",
    f"{RANK_TEST} SELECT worker, u, round(least(1, 2 * ({_tail_sql('z')})), 6) AS p FROM z",
)
def mann_whitney_p(spark, sf):
    rows = hypothesis.mann_whitney_p(alerts(spark, sf), "latency", "is_malicious", ["worker"])
    return rows.select("worker", "u", r6("p"))


SHAPIRO = f"""WITH r AS (SELECT event_type, value AS x, row_number() OVER (PARTITION BY event_type
        ORDER BY value, event_id) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events),
    q AS (SELECT *, (i - 0.375::DOUBLE) / (n + 0.25::DOUBLE) - 0.5::DOUBLE AS q,
      sqrt(-ln(least((i - 0.375::DOUBLE) / (n + 0.25::DOUBLE), 1 - (i - 0.375::DOUBLE) / (n + 0.25::DOUBLE)))) AS t
      FROM r),
    m AS (SELECT *, {_QUANTILE} AS m, 1 / sqrt(n) AS u FROM q),
    s AS (SELECT event_type, n, max(u) AS u, sum(m * m) AS mm, max(m) AS m1,
      max(CASE WHEN i = n - 1 THEN m END) AS m2, var_pop(x) * n AS ss,
      max(CASE WHEN i = n THEN x END) - max(CASE WHEN i = 1 THEN x END) AS d1,
      max(CASE WHEN i = n - 1 THEN x END) - max(CASE WHEN i = 2 THEN x END) AS d2,
      sum(CASE WHEN i > 2 AND i < n - 1 THEN m * x ELSE 0 END) AS mid FROM m GROUP BY event_type, n),
    a AS (SELECT *, 0.221157 * u - 0.147981 * u ** 2 - 2.071190 * u ** 3 + 4.434685 * u ** 4
        - 2.706056 * u ** 5 + m1 / sqrt(mm) AS a1,
      0.042981 * u - 0.293762 * u ** 2 - 1.752461 * u ** 3 + 5.682633 * u ** 4
        - 3.582633 * u ** 5 + m2 / sqrt(mm) AS a2 FROM s),
    w AS (SELECT event_type, n, (a1 * d1 + a2 * d2 + mid / sqrt((mm - 2 * m1 ** 2 - 2 * m2 ** 2)
      / (1 - 2 * a1 ** 2 - 2 * a2 ** 2))) ** 2 / ss AS w FROM a)"""


@query("shapiro_w", f"{SHAPIRO} SELECT event_type, n, round(w, 6) AS w FROM w")
def shapiro_w(spark, sf):
    rows = hypothesis.shapiro(table(spark, sf, "events"), "value", "event_id", ["event_type"])
    return rows.select("event_type", "n", r6("w"))


@query(
    "shapiro_by_group",
    f"""{SHAPIRO}, z AS (SELECT *, (ln(1 - w) - (-1.5861 - 0.31082 * ln(n) - 0.083751 * ln(n) ** 2
      + 0.0038915 * ln(n) ** 3)) / exp(-0.4803 - 0.082676 * ln(n) + 0.0030302 * ln(n) ** 2) AS z FROM w)
    SELECT event_type, n, round(w, 6) AS w, round({_tail_sql('z')}, 6) AS p FROM z""",
)
def shapiro_by_group(spark, sf):
    rows = hypothesis.shapiro(table(spark, sf, "events"), "value", "event_id", ["event_type"])
    return rows.select("event_type", "n", r6("w"), r6("p"))


# --- parameters ---------------------------------------------------------------------------------

AVG = "SELECT round, layer, pos, sum(value * weight) / sum(weight) AS value FROM params GROUP BY ALL"


@query("fed_avg", f"WITH {PARAMS} SELECT round, layer, pos, round(value, 6) AS value FROM ({AVG})")
def fed_avg(spark, sf):
    return fed.fed_avg(params(spark, sf)).select(*fed.KEY, r6("value"))


@query(
    "fed_median",
    f"WITH {PARAMS} SELECT round, layer, pos, round(median(value), 6) AS value FROM params GROUP BY ALL",
)
def fed_median(spark, sf):
    return fed.fed_median(params(spark, sf)).select(*fed.KEY, r6("value"))


@query(
    "fed_trimmed",
    f"""WITH {PARAMS}, r AS (SELECT *, row_number() OVER (PARTITION BY round, pos ORDER BY value) AS i,
      count(*) OVER (PARTITION BY round, pos) AS n FROM params)
    SELECT round, layer, pos, round(avg(value), 6) AS value FROM r
    WHERE i > floor(0.2 * n) AND i <= n - floor(0.2 * n) GROUP BY ALL""",
)
def fed_trimmed(spark, sf):
    return fed.fed_trimmed(params(spark, sf)).select(*fed.KEY, r6("value"))


_TRIM = 0.25  # a setting other than the rule's own
_BY_NAME = ["fedavg", "fedprox", "fedavgplus", "fedmedian", "fedtrimmed"]


@query(
    "fed_by_name",
    f"""WITH {PARAMS}, r AS (SELECT *, row_number() OVER (PARTITION BY round, pos ORDER BY value) AS i,
      count(*) OVER (PARTITION BY round, pos) AS n FROM params), rules AS (
    SELECT unnest(['fedavg', 'fedprox', 'fedavgplus']) AS strategy, * FROM ({AVG})
    UNION ALL SELECT 'fedmedian', round, layer, pos, median(value) FROM params GROUP BY ALL
    UNION ALL SELECT 'fedtrimmed', round, layer, pos, avg(value) FROM r
    WHERE i > floor({_TRIM} * n) AND i <= n - floor({_TRIM} * n) GROUP BY ALL)
    SELECT strategy, round, layer, pos, round(value, 6) AS value FROM rules""",
)
def fed_by_name(spark, sf):
    """The rules without a state, looked up by name; one with a setting of its own."""
    rows = params(spark, sf)
    out = []
    for name in _BY_NAME:
        rule = fed.strategy(name, **({"beta": _TRIM} if name == "fedtrimmed" else {}))
        out.append(rule.aggregate(rows).select(F.lit(name).alias("strategy"), *fed.KEY, r6("value")))
    return reduce(lambda a, b: a.unionByName(b), out)


STATE = """st AS (SELECT round, layer, pos, avg(value) AS value, avg(value) / 10 AS m,
  avg(value) * avg(value) AS v FROM params GROUP BY round, layer, pos)"""


def _adaptive_sql(m: str, v: str, eta: float, tau: float) -> str:
    return f"""WITH {PARAMS}, {STATE}, a AS ({AVG}),
    d AS (SELECT st.*, a.value - st.value AS d FROM st JOIN a USING (round, layer, pos)),
    n AS (SELECT round, layer, pos, value, {m} AS m, {v} AS v FROM d)
    SELECT round, layer, pos, round(value + {eta} * m / (sqrt(v) + {tau}), 6) AS value,
      round(m, 6) AS m, round(v, 6) AS v FROM n"""


def _adaptive(spark, sf, name: str):
    rows = params(spark, sf)
    mean = F.avg("value")
    state = rows.groupBy(*fed.KEY).agg(
        mean.alias("value"), (mean / 10).alias("m"), (mean * mean).alias("v")
    )
    stepped = fed.strategy(name).aggregate(rows, state)
    return stepped.select(*fed.KEY, r6("value"), r6("m"), r6("v"))


@query("fed_adagrad", _adaptive_sql("d", "v + d * d", 0.1, 1e-9))
def fed_adagrad(spark, sf):
    return _adaptive(spark, sf, "fedadagrad")


ADAM_M = "0.9e0 * m + (1 - 0.9e0) * d"


@query("fed_adam", _adaptive_sql(ADAM_M, "0.99e0 * v + (1 - 0.99e0) * d * d", 0.1, 1e-9))
def fed_adam(spark, sf):
    return _adaptive(spark, sf, "fedadam")


@query("fed_yogi", _adaptive_sql(ADAM_M, "v - (1 - 0.99e0) * d * d * sign(v - d * d)", 0.01, 1e-3))
def fed_yogi(spark, sf):
    return _adaptive(spark, sf, "fedyogi")


@query(
    "param_diff",
    f"""WITH {PARAMS}, a AS ({AVG}) SELECT client, params.round, params.layer, params.pos,
      round(params.value - a.value, 6) AS diff
    FROM params JOIN a ON params.round = a.round AND params.pos = a.pos""",
)
def param_diff(spark, sf):
    rows = params(spark, sf)
    pairs = fed.pair_params(rows, fed.fed_avg(rows), fed.KEY)
    return pairs.select("client", *fed.KEY, r6(F.col("value_a") - F.col("value_b"), "diff"))


@query(
    "param_distance",
    f"""WITH {PARAMS}, a AS ({AVG}),
    b AS (SELECT round, layer, pos, median(value) AS value FROM params GROUP BY ALL),
    l AS (SELECT a.round, a.layer, sqrt(sum((a.value - b.value) ** 2)) AS norm,
      count(*) FILTER (WHERE a.value <> b.value) AS unequal
      FROM a JOIN b ON a.round = b.round AND a.pos = b.pos GROUP BY ALL)
    SELECT round, round(sum(norm), 6) AS distance, sum(unequal) = 0 AS equal FROM l GROUP BY round""",
)
def param_distance(spark, sf):
    rows = params(spark, sf)
    gap = fed.param_distance(fed.fed_avg(rows), fed.fed_median(rows), ["round"])
    return gap.select("round", r6("distance"), "equal")


@query(
    "fedplus_mix",
    f"""WITH {PARAMS}, a AS ({AVG}) SELECT client, params.round, params.layer, params.pos,
      round(0.9e0 * params.value + 0.1e0 * (a.value + (params.value - a.value) / 1.1e0), 6) AS value
    FROM params JOIN a ON params.round = a.round AND params.pos = a.pos""",
)
def fedplus_mix(spark, sf):
    rows = params(spark, sf)
    mixed = fed.fedplus_mix(rows, fed.fed_avg(rows), lr=0.1)
    return mixed.select("client", *fed.KEY, r6("value"))
