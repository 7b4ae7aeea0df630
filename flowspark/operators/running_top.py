"""The top-n addresses as they stand after each alert.

The count of an address only grows, so the list after a row is the n best of the (address, count
so far) pairs seen up to it, each address taken at its largest count. That merge is associative and
needs n entries, so it works like a prefix sum: n entries per order bucket, carried forward over the
buckets, then one ordered pass through each bucket.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from flowspark.operators.joins import key_join
from flowspark.operators.order_stats import add_running, bucket_sums, order_buckets


def _best(top: dict[str, int], n: int) -> dict[str, int]:
    """The n best entries: count descending, then address descending."""
    return dict(sorted(top.items(), key=lambda kv: (kv[1], kv[0]), reverse=True)[:n])


def _base_counts(base: DataFrame, kind: str) -> DataFrame:
    return base.filter(F.col("kind") == kind).select("key", F.col("value").alias("_base"))


def _carry(rows: DataFrame, col: str, flag: str, n: int, base: DataFrame | None) -> list:
    """For each bucket with flagged rows, the list before it, and the list after the last one.

    At most n rows per bucket reach the driver.
    """
    bad = rows.filter(flag).select(F.col(col).alias("key"), "_bucket").filter("key IS NOT NULL")
    ends = bucket_sums(bad, ["key"], {"_count": F.lit(1).cast("long")})
    top: dict[str, int] = {}
    if base is not None:
        old = _base_counts(base, col)
        ends = key_join(ends, old, ["key"], "left").withColumn(
            "_count", F.col("_count") + F.coalesce(F.col("_base"), F.lit(0))
        )
        first = old.orderBy(F.desc("_base"), F.desc("key")).limit(n).collect()
        top = {r["key"]: r["_base"] for r in first}
    place = F.row_number().over(W.partitionBy("_bucket").orderBy(F.desc("_count"), F.desc("key")))
    best = ends.withColumn("_place", place).filter(F.col("_place") <= n)
    found = sorted((r["_bucket"], r["key"], r["_count"]) for r in
                   best.select("_bucket", "key", "_count").collect())
    starts, lists = [], []
    for bucket, key, count in found:
        if not starts or starts[-1] != bucket:
            starts.append(bucket)
            lists.append(_best(top, n))
            top = dict(lists[-1])
        top[key] = max(count, top.get(key, 0))
    return [starts, [*lists, _best(top, n)]]


def _lists(buckets, flags, keys, counts, carry, state, n: int):
    """The list after each row of a batch, as an Arrow array, and the state after the batch.

    Only rows that can enter the list (flagged, with a count no lower than the lowest one listed)
    are looked at one by one; the lists between two changes are repeated by index.
    """
    import numpy as np
    import pyarrow as pa

    starts, before = carry
    bucket, now = state
    shown, changed = [list(now.items())], np.zeros(len(buckets), dtype=np.int64)
    valid = keys.is_valid().to_numpy(zero_copy_only=False)
    edges = np.flatnonzero(np.diff(buckets)) + 1
    for lo, hi in zip([0, *edges], [*edges, len(buckets)]):
        if buckets[lo] != bucket:
            bucket = buckets[lo]
            now = before[int(np.searchsorted(starts, bucket))]
            shown.append(list(now.items()))
            changed[lo] += 1
        floor = min(now.values()) if len(now) == n else 0
        spots = lo + np.flatnonzero(flags[lo:hi] & valid[lo:hi] & (counts[lo:hi] >= floor))
        for at, key in zip(spots, keys.take(pa.array(spots)).to_pylist()):
            now = _best({**now, key: int(counts[at])}, n)
            shown.append(list(now.items()))
            changed[at] += 1
    items = [item for entry in shown for item in entry]
    pairs = pa.StructArray.from_arrays(
        [pa.array([k for k, _ in items], pa.string()), pa.array([c for _, c in items], pa.int64())],
        names=["key", "value"],
    )
    ends = np.concatenate([[0], np.cumsum([len(entry) for entry in shown])])
    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)
    return lists.take(pa.array(np.cumsum(changed))), (bucket, now)


def running_top(
    df: DataFrame, cols: dict[str, str], n: int = 5, order: str = "ts", tie: str = "event_id",
    flag: str = "is_malicious", sums: dict | None = None, base: DataFrame | None = None,
    buckets: int | None = None,
) -> DataFrame:
    """For each entry ``name: column`` of ``cols``, add ``name``: the n values of the column with
    most flagged rows so far, as (key, value) pairs. ``sums`` adds running sums in the same pass.

    ``base`` (kind, key, value; the kind is the column name) holds counts from before the first row.
    """
    rows = order_buckets(df, order, tie, buckets)
    rows = rows.withColumn("_flag", F.coalesce(F.col(flag).cast("boolean"), F.lit(False)))
    one = F.col("_flag").cast("long")
    carries = [_carry(rows, col, "_flag", n, base) for col in cols.values()]
    out = rows
    for i, col in enumerate(cols.values()):
        old = None
        if base is not None:
            old = _base_counts(base, col).select(F.col("key").alias(col), F.col("_base").alias(f"_count{i}"))
        out = add_running(out, rows, order, tie, [col], {f"_count{i}": one}, old)
    # the sums come last: their window already leaves each bucket whole in one partition
    out = add_running(out, rows, order, tie, [], sums) if sums else out.repartition("_bucket")
    keep = [*df.columns, *(sums or {})]
    shared = df.sparkSession.sparkContext.broadcast(carries)
    fields = list(cols.items())

    def scan(batches):
        import pyarrow as pa

        states: list = [(None, {})] * len(fields)
        for batch in batches:
            buckets = batch.column("_bucket").to_numpy(zero_copy_only=False)
            flags = batch.column("_flag").to_numpy(zero_copy_only=False)
            arrays = [batch.column(c) for c in keep]
            for i, (_, col) in enumerate(fields):
                counts = batch.column(f"_count{i}").to_numpy(zero_copy_only=False)
                lists, states[i] = _lists(
                    buckets, flags, batch.column(col), counts, shared.value[i], states[i], n
                )
                arrays.append(lists)
            yield pa.RecordBatch.from_arrays(arrays, names=[*keep, *cols])

    ordered = out.sortWithinPartitions("_bucket", F.asc_nulls_last(order), tie)
    fields_ddl = [f"`{f.name}` {f.dataType.simpleString()}" for f in out.select(*keep).schema.fields]
    lists_ddl = [f"`{name}` array<struct<key:string,value:bigint>>" for name in cols]
    return ordered.mapInArrow(scan, ", ".join([*fields_ddl, *lists_ddl]))
