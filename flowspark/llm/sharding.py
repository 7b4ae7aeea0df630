"""Placement of rows on shards through a permutation-filled lookup table.

Every shard has its own order of preference over the slots of a table of prime size (an offset and a
step, both hashes of its name). Shards take turns; each claims its first free slot, until the table is
full. Slot counts differ by one at most, and a shard that leaves hands over little more than its own
slots. A row goes to the shard of the slot its key hashes to, in constant time: the table has a fixed
number of rows (``SLOTS``), so it is broadcast.

Built-in functions only. The table is filled once, on the driver (``SLOTS`` claims); rows are not
shuffled, so a hot key costs nothing. Edge cases: a null key hashes like the empty text; equal keys go
to one shard; an empty table gives an empty result; extra columns are kept, columns named ``slot`` or
``shard`` are replaced.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowspark.llm.registry import query, table

#: A prime, well above a hundred times the number of shards.
SLOTS = 65_537
SHARDS = [f"shard-{i:03d}" for i in range(256)]


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def fill(shards: list[str], slots: int = SLOTS) -> list[int]:
    """Shard number of every slot."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be named, each once")
    if len(shards) > slots:
        raise ValueError("more shards than slots")
    place = [_number(f"{s}:offset") % slots for s in shards]
    step = [_number(f"{s}:step") % (slots - 1) + 1 for s in shards]
    owner = [-1] * slots
    left = slots
    while left:
        for i in range(len(shards)):
            while owner[place[i]] >= 0:
                place[i] = (place[i] + step[i]) % slots
            owner[place[i]] = i
            left -= 1
            if not left:
                break
    return owner


def lookup_table(spark: SparkSession, shards: list[str], slots: int = SLOTS) -> DataFrame:
    """(slot, shard) with one row per slot."""
    owners = F.split(F.lit(",".join(map(str, fill(shards, slots)))), ",")
    names = F.split(F.lit("\n".join(shards)), "\n")
    return spark.range(slots).select(
        F.col("id").alias("slot"), F.get(names, F.get(owners, F.col("id").cast("int")).cast("int")).alias("shard"))


def place(df: DataFrame, key: str, shards: list[str] = SHARDS, slots: int = SLOTS) -> DataFrame:
    """``df`` with ``slot`` and ``shard``."""
    text = F.coalesce(F.col(key).cast("string"), F.lit(""))
    slot = F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint") % slots
    rows = df.drop("shard").withColumn("slot", slot)
    return rows.join(F.broadcast(lookup_table(df.sparkSession, shards, slots)), "slot").select(
        *[c for c in rows.columns if c != "slot"], "slot", "shard")


def moved(df: DataFrame, key: str, before: list[str], after: list[str], slots: int = SLOTS) -> DataFrame:
    """Rows whose shard changes when the list of shards does: ``from_shard`` and ``to_shard``."""
    old = place(df, key, before, slots).withColumnRenamed("shard", "from_shard")
    return (place(old, key, after, slots).withColumnRenamed("shard", "to_shard")
            .where("from_shard <> to_shard"))


def _oracle() -> str:
    owners = ",".join(map(str, fill(SHARDS, SLOTS)))
    return f"""
WITH s AS (SELECT doc_id, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT % {SLOTS} AS slot
           FROM documents),
t AS (SELECT unnest([{owners}]) AS owner, unnest(range({SLOTS})) AS slot)
SELECT doc_id, slot, printf('shard-%03d', owner) AS shard FROM s JOIN t USING (slot)"""


@query("op7_sharding", _oracle())
def sharding(spark, sf_dir: str) -> DataFrame:
    return place(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")
