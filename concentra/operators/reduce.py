"""Reductions of the metric."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.metric import _bind
from .ordinal import materialize


def multiplicities(items: Column, item: str | None = "item", count: str = "cnt") -> Column:
    """The distinct elements of an array with their counts, as (item, cnt) structs; without
    ``item`` the counts alone. The sorted array's runs are told by their ends, so that the work
    and the memory follow the array; NULL and empty arrays give NULL."""

    def runs(s: Column) -> Column:
        ends = F.filter(F.sequence(F.lit(1), F.size(s)), lambda i: F.coalesce(F.get(s, i - 1) != F.get(s, i), F.lit(True)))
        n = lambda end, start: (end - start).cast("bigint").alias(count)
        one = lambda end, start: F.struct(F.get(s, end - 1).alias(item), n(end, start)) if item else n(end, start)
        return F.when(F.size(s) > 0, _bind(ends, lambda e: F.zip_with(e, F.concat(F.array(F.lit(0)), F.slice(e, 1, F.size(e) - 1)), one)))

    return _bind(F.sort_array(items), runs)


def item_counts(df: DataFrame, keys: Sequence[str], items: Column, item: str | None = "item", count: str = "cnt") -> DataFrame:
    """(keys, item, cnt): how often every element of the array ``items`` (no NULLs in it) occurs
    over the rows of a key; without ``item`` (keys, cnt), still one row per distinct element.

    A key of one row is counted inside that row: its elements are not shuffled. Only
    the elements of keys with several rows (NULL is a key) are grouped."""
    keys = list(keys)
    rows = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).where("_rows > 1")
    twice = materialize(rows.select(*[F.col(k).alias(f"_key_{k}") for k in keys]), "repeated-keys")
    runs = multiplicities(items, item, count)
    inside = lambda d: d.select(*keys, F.inline(runs) if item else F.explode(runs).alias(count))
    if twice.isEmpty():
        return inside(df)
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    many = df.join(twice, same, "left_semi").select(*keys, F.explode_outer(items).alias("_item")).where(F.col("_item").isNotNull())
    many = many.groupBy(*keys, "_item").agg(F.count(F.lit(1)).alias(count))
    many = many.select(*keys, *([] if item is None else [F.col("_item").alias(item)]), count)
    return inside(df.join(twice, same, "left_anti")).unionByName(many)


def reduce_generation(positions: DataFrame, keys: Sequence[str], value: str = "ned") -> DataFrame:
    """Per generation mean and population std of the metric, seq_len = positions.

    Partial aggregation runs map-side; one position gives std 0.
    """
    return positions.groupBy(*keys).agg(
        F.avg(value).alias("ned_mean"),
        F.stddev_pop(value).alias("ned_std"),
        F.count(F.lit(1)).cast("bigint").alias("seq_len"),
    )


def ned_from_counts(
    counts: DataFrame,
    keys: Sequence[str],
    count: str = "cnt",
    temp=None,
    vocab_size=None,
) -> DataFrame:
    """The metric of a frequency table in long form (no arrays).

    With weights w = count^(1/temp), S = sum w and Q = sum w ln w:
    sum p ln p = Q / S - ln S and ned = 1 + (Q / S - ln S) / ln V, where V is
    ``vocab_size`` (literal or column) or else the number of distinct items.
    One aggregation; hot keys combine map-side.
    """
    c = F.col(count).cast("double")
    if temp is None:
        inv_t = F.lit(1.0)
    else:
        inv_t = F.lit(1.0) / (F.col(temp) if isinstance(temp, str) else F.lit(float(temp)))
    lnw = F.log(c) * inv_t
    w = F.exp(lnw)
    agg = counts.where(F.col(count) > 0).groupBy(*keys).agg(
        F.sum(count).cast("bigint").alias("n_total"),
        F.count(F.lit(1)).cast("bigint").alias("n_items"),
        F.sum(w).alias("_s"),
        F.sum(w * lnw).alias("_q"),
    )
    if vocab_size is None:
        v = F.col("n_items").cast("double")
    elif isinstance(vocab_size, str):
        v = F.col(vocab_size).cast("double")
    else:
        v = F.lit(float(vocab_size))
    ned = F.lit(1.0) + (F.col("_q") / F.col("_s") - F.log(F.col("_s"))) / F.nullif(
        F.log(v), F.lit(0.0)
    )
    return agg.withColumn("ned", ned).drop("_s", "_q")


def ned_from_counts_temps(
    counts: DataFrame, keys: Sequence[str], count: str = "cnt", temps=(0.7, 1.0, 1.3), vocab_size=None
) -> DataFrame:
    """C7 at several temperatures in ONE aggregation: the sums for every
    temperature are computed side by side, and the rows are multiplied by the
    temperatures only after the shuffle (one output row per key and temp)."""
    c = F.col(count).cast("double")
    lnc = F.log(c)
    aggs = [
        F.sum(count).cast("bigint").alias("n_total"),
        F.count(F.lit(1)).cast("bigint").alias("n_items"),
    ]
    for i, t in enumerate(temps):
        lnw = lnc / F.lit(float(t))
        aggs += [F.sum(F.exp(lnw)).alias(f"_s{i}"), F.sum(F.exp(lnw) * lnw).alias(f"_q{i}")]
    agg = counts.where(F.col(count) > 0).groupBy(*keys).agg(*aggs)
    if vocab_size is None:
        v = F.col("n_items").cast("double")
    else:
        v = F.col(vocab_size).cast("double") if isinstance(vocab_size, str) else F.lit(float(vocab_size))
    ln_v = F.nullif(F.log(v), F.lit(0.0))
    per_t = F.array(
        *[
            F.struct(
                F.lit(float(t)).alias("temp"),
                (F.lit(1.0) + (F.col(f"_q{i}") / F.col(f"_s{i}") - F.log(F.col(f"_s{i}"))) / ln_v).alias("ned"),
            )
            for i, t in enumerate(temps)
        ]
    )
    return agg.select(*keys, "n_total", "n_items", F.inline(per_t))


def profile(df: DataFrame, dims: Sequence[str], value: str = "ned_mean", margins: str | None = None) -> DataFrame:
    """Mean / sample std / n by dimensions; ``margins`` = 'rollup' or 'cube'
    adds all margins in the same aggregation (grouping id in ``level``)."""
    aggs = [
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"),
        F.count(value).cast("bigint").alias("n"),
    ]
    if margins == "rollup":
        g = df.rollup(*dims)
    elif margins == "cube":
        g = df.cube(*dims)
    else:
        return df.groupBy(*dims).agg(*aggs)
    return g.agg(*aggs, F.grouping_id().cast("bigint").alias("level"))


def runs_from_bundles(
    scores: DataFrame,
    model_name: str,
    meta: Sequence[str] = ("prompt",),
    gen: str = "gen_id",
    temp=None,
    processed_at: bool = False,
) -> DataFrame:
    """Offline reduction of score bundles into run rows (the metric per
    position, mean/std per generation, then the run attributes).

    ``scores`` holds one row per position with ``bundle_id``, ``gen`` and the
    per-generation ``meta`` columns. Rank restarts inside each bundle and
    chkpt_id is the bundle number (offline path); model and model size come
    from ``model_name``; domain is parsed from the prompt only when it holds
    a ':'. ``processed_at`` adds the processing time (not reproducible).
    """
    from pyspark.sql import functions as F

    from ..functions import metric
    from ..functions.parsers import domain_of, model_size
    from .grid import with_rank_offline

    pos = scores.select("bundle_id", gen, *meta, metric.ned("scores", temp).alias("ned"))
    runs = reduce_generation(pos, ["bundle_id", gen, *meta], "ned")
    runs = runs.withColumn("model", F.lit(model_name)).withColumn("model_size", model_size(F.lit(model_name)))
    if "prompt" in meta:
        runs = runs.withColumn("domain", domain_of("prompt"))
    out = with_rank_offline(runs, "bundle_id", (gen,))
    if processed_at:
        out = out.withColumn("timestamp_processed", F.current_timestamp())
    return out
