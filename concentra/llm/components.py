"""Connected components of an edge table, by alternating large and small stars.

Every round is two aggregations and two joins over the edges and ends in a
stored table; labels never come to the driver. A hub's edges are aggregated
before the shuffle, and its join rows can be split by adaptive execution."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .folders import stored


def _fingerprint(edges: DataFrame):
    return edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node with an edge in ``edges`` (u, v bigint);
    the component is its smallest node. Loops and repeated edges are allowed,
    nulls are not; no edges give an empty table."""
    pairs = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct()
    pairs = stored(pairs, "components")
    before = _fingerprint(pairs)
    while before[0]:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        pairs = stored(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "components")
        now = _fingerprint(pairs)
        if now == before:
            break
        before = now
    roots = pairs.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
