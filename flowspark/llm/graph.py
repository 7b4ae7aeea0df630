"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowspark.llm.common import settle


def components(links: DataFrame) -> DataFrame:
    """(id, component_id) of every id in ``links`` (a, b); the component is its smallest id.

    Alternates two steps until nothing changes: every id tells its larger neighbours, then its
    smaller ones, the smallest id it knows. The number of edges never grows and the number of rounds
    grows with the logarithm of the longest chain. Neighbourhoods are reduced by ``min`` before they
    are joined back, so an id with very many links is never gathered in one place.
    """
    edges = settle(links.where("a <> b").select(F.greatest("a", "b").alias("v"),
                                                F.least("a", "b").alias("u")).distinct(), "edges")
    seen = None
    while True:
        both = edges.union(edges.select("u", "v"))  # (v, u): v is a neighbour of u
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select("v", F.col("m").alias("u"))
        large = large.where("v <> u").distinct()
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(least, "v")
        small = (small.select(F.col("u").alias("v"), F.col("m").alias("u"))
                 .union(least.select("v", F.col("m").alias("u"))).where("v <> u").distinct())
        edges = settle(small, "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(20,0)"))).first()
        if now == seen:
            break
        seen = now
    return edges.select(F.col("v").alias("id"), F.col("u").alias("component_id")).union(
        edges.select(F.col("u").alias("id"), F.col("u").alias("component_id")).distinct())
