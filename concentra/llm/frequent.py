"""The most frequent keys of a count table, as a bounded pair of arrays."""

from __future__ import annotations

import gc

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .folders import stored


def most_frequent(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Of (token bigint, n bigint) rows, all whose n is at or above the least level
    that leaves at most ``most`` of them: ascending tokens (as uint64) and counts."""
    counts = stored(counts, "frequent")
    levels = counts.groupBy("n").agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("n")).limit(10_000).collect()
    total, least = 0, None
    for r in levels:
        if total + r.c > most:
            break
        total, least = total + r.c, r.n
    if not total:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    table = counts.where(F.col("n") >= least).toArrow()
    tokens = table.column("token").to_numpy().view(np.uint64)
    order = np.argsort(tokens)
    return tokens[order], table.column("n").to_numpy()[order]


def release(spark: SparkSession) -> None:
    """Have the driver collect its garbage, so that Spark removes the shuffle files
    of phases that are over (it would else wait for spark.cleaner.periodicGC)."""
    gc.collect()
    if hasattr(spark, "_jvm"):
        spark._jvm.System.gc()
