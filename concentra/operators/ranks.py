"""Average ranks over a whole table without a single-partition window.

Input is a value-count table (one row per distinct value and partition key,
so a hot value is one row whatever its count). Ranks are computed as:

1. a stored run of the keys and values in order (``ordinal.in_order``), whose ranges
   follow the number of distinct values;
2. per (key, range) totals -> running offset over the ranges inside each key
   (a table of keys x ranges rows);
3. inside each (key, range) the running count of smaller values;
4. average rank = offset + smaller + (count + 1) / 2, ties share it.

The rank of a row is then looked up on its value; tests that only need rank
sums per group (Kruskal-Wallis, Mann-Whitney) join the group x value counts,
never the raw rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordinal import ROWS_PER_RANGE, in_order


def average_ranks(
    counts: DataFrame, value: str, count: str = "cnt", by: Sequence[str] = (), name: str = "rank", values_per_range: int = ROWS_PER_RANGE
) -> DataFrame:
    """Add ``name`` = average (mid) rank of ``value`` within ``by``, weighted by ``count``.

    ``counts`` must hold each (by, value) once. Values are normalised so that
    -0.0 and 0.0 are one value.
    """
    by = list(by)
    v = (F.col(value).cast("double") + F.lit(0.0)).alias(value)
    run = in_order(counts.select(*by, v, F.col(count).cast("bigint").alias(count)), [*by, value], values_per_range)
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # without keys: one row per range
    totals = run.groupBy(*by, "_range").agg(F.sum(count).alias("_t"))
    offsets = totals.select(*by, "_range", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_off"))
    inside = Window.partitionBy(*by, "_range").orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
    smaller = run.withColumn("_before", F.coalesce(F.sum(count).over(inside), F.lit(0)))
    joined = smaller.join(offsets, [*by, "_range"])
    rank = (F.col("_off") + F.col("_before")).cast("double") + (F.col(count).cast("double") + F.lit(1.0)) / F.lit(2.0)
    return joined.select(*by, value, count, rank.alias(name))


def value_counts(df: DataFrame, value: str, by: Sequence[str] = (), count: str = "cnt") -> DataFrame:
    """(by, value, cnt) for non-null values; hot values collapse map-side."""
    return (
        df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
        .groupBy(*by, value)
        .agg(F.count(F.lit(1)).alias(count))
    )


def pair_ranks(pairs: DataFrame, x: str, y: str, by: Sequence[str]) -> DataFrame:
    """``pairs`` with the average ranks ``rx`` and ``ry`` of both columns within ``by``: one run of
    values for both (the side is one more key), joined back on the values. ``pairs`` is read
    three times: a stored table."""
    by = list(by)
    sides = F.explode(F.array(*[F.struct(F.lit(i).alias("_side"), (F.col(c).cast("double") + F.lit(0.0)).alias("_v")) for i, c in enumerate((x, y))]))
    values = pairs.select(*by, sides.alias("_s")).select(*by, "_s.*").where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    ranks = average_ranks(values.groupBy(*by, "_side", "_v").agg(F.count(F.lit(1)).alias("cnt")), "_v", by=[*by, "_side"])
    out = pairs
    for i, (c, name) in enumerate(((x, "rx"), (y, "ry"))):
        side = ranks.where(F.col("_side") == i).select(*by, F.col("_v").alias(f"_{name}"), F.col("rank").alias(name))
        out = out.withColumn(f"_{name}", F.col(c).cast("double") + F.lit(0.0)).join(side, [*by, f"_{name}"])
    return out.drop("_rx", "_ry")


def rank_rows(df: DataFrame, value: str, name: str = "rank", by: Sequence[str] = ()) -> DataFrame:
    """Attach the average rank of ``value`` to every row (join on the value).

    A hot value is one row on the rank side; AQE's skew-join split handles
    the many rows on the other side.
    """
    vc = value_counts(df, value, by)
    ranks = average_ranks(vc, value, by=by, name=name).drop("cnt")
    keyed = df.withColumn("_v", F.col(value).cast("double") + F.lit(0.0))
    return keyed.join(
        ranks.withColumnRenamed(value, "_v"), [*by, "_v"], "left"
    ).drop("_v")
