"""Global ordinals and ranges of an order without a single-partition window.

``Window.orderBy(...)`` with no ``partitionBy`` moves every row to one task.
The helpers here store the rows once in the order asked for, as a run of ranges: the
input is evaluated once (into a table), range-partitioned from that table by
Spark's own sampled cut points, sorted within the partitions and written with the number
of the range and the place in it. Everything else is read from that run:

* ``in_order``: the run, with ``_range`` and ``_place``.
* ``global_ordinal``: rows per range (a small table) give every range its offset, the
  place the rest; no window over the rows, and no second evaluation of the input, whose
  keys may be sums of doubles that differ from one evaluation to the next.
* ``running_starts``: running sums in the order.

Any cut points give a right order; they only decide how even the ranges are. The number
of ranges follows the number of rows. Lost executors cost the tasks that they ran: both
tables lie in the shared folder.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path

ROWS_PER_RANGE = 1_000_000
_PLACE_BITS = 33  # monotonically_increasing_id: the partition above, the row in it below


def materialize(df: DataFrame, name: str = "materialized") -> DataFrame:
    """Write a reused intermediate (aggregated counts, token tables) once as
    parquet under the shared folder and read it back, so that its several
    consumers do not each rescan the raw input; lineage is cut there."""
    path = scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_order(df: DataFrame, keys: Sequence[str], rows_per_range: int = ROWS_PER_RANGE, stored: bool = False) -> DataFrame:
    """The rows of ``df`` as a stored run in the order ``keys``, with ``_range`` (ascending in
    the order; equal keys share one) and ``_place`` (from 0 in each range). ``stored``
    says that ``df`` is a table already."""
    rows = df if stored else materialize(df, "to-order")
    ranges = max(1, -(-rows.count() // rows_per_range))  # the count comes from the files' footers
    at = F.monotonically_increasing_id()
    run = rows.repartitionByRange(ranges, *keys).sortWithinPartitions(*keys).withColumn("_run_at", at)
    run = materialize(run, "run")
    place = F.col("_run_at").bitwiseAND((1 << _PLACE_BITS) - 1)
    return run.select(*df.columns, F.shiftright("_run_at", _PLACE_BITS).cast("int").alias("_range"), place.alias("_place"))


def global_ordinal(
    df: DataFrame,
    order_cols: Sequence[str],
    name: str = "ordinal",
    by: Sequence[str] = (),
    rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """0-based row number in ``order_cols`` order (within ``by`` groups).

    Hot ``by`` groups are split over ranges like any other rows: a group has its
    rows of earlier ranges and its first place in each range from one small
    aggregation. Ties in ``order_cols`` are broken arbitrarily, as with
    ``row_number``, but once: the numbers are those of the stored run.
    """
    by = list(by)
    run = in_order(df, [*by, *order_cols], rows_per_range)
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = run.groupBy(*by, "_range").agg(F.count(F.lit(1)).alias("_cnt"), F.min("_place").alias("_first"))  # ranges (x groups) rows
    offsets = counts.select(
        *[F.col(c).alias(f"_by_{c}") for c in by], F.col("_range").alias("_r"), (F.coalesce(F.sum("_cnt").over(before), F.lit(0)) - F.col("_first")).alias("_off")
    )
    same = F.col("_range") == F.col("_r")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    return run.join(offsets, same).select(*df.columns, (F.col("_off") + F.col("_place")).cast("bigint").alias(name))


def running_starts(df: DataFrame, keys: Sequence[str], count: str, name: str = "start", rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """``df`` with the sum of ``count`` over all rows before the row in the order
    ``keys`` (unique): range totals, and running sums inside the ranges."""
    run = in_order(df, keys, rows_per_range)
    before = Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    totals = run.groupBy(F.col("_range").alias("_r")).agg(F.sum(count).alias("_t"))  # one row per range
    offsets = totals.select("_r", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_off"))
    inside = Window.partitionBy("_range").orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
    out = run.withColumn("_in", F.coalesce(F.sum(count).over(inside), F.lit(0))).join(offsets, F.col("_range") == F.col("_r"))
    return out.select(*df.columns, (F.col("_off") + F.col("_in")).alias(name))
