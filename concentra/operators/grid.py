"""Run grid preparation (B1-B3, B9-B12): combinations, order, resume, trimming."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordinal import global_ordinal, materialize

DEFAULT_TEMPS = (0.7, 1.0, 1.3)


def run_grid(prompts: DataFrame, prompt_id: str = "prompt_id", temps=DEFAULT_TEMPS) -> DataFrame:
    """B1: every temperature x every prompt, temp-major ``combo_id``.

    The temperatures are a literal array exploded per prompt row (a generator,
    not a join), so the grid is built where the prompts are.
    """
    temp_arr = F.array(
        *[F.struct(F.lit(i).alias("temp_idx"), F.lit(float(t)).alias("temp")) for i, t in enumerate(temps)]
    )
    grid = prompts.select("*", F.inline(temp_arr))
    return global_ordinal(grid, ["temp_idx", prompt_id], name="combo_id").drop("temp_idx")


def shuffle_key(seed, *cols):
    """Reproducible pseudo-random order key: md5 of seed and key text."""
    parts = [F.lit(str(seed))] + [F.col(c).cast("string") for c in cols]
    return F.md5(F.concat_ws("|", *parts))


def shuffle_grid(grid: DataFrame, seed=42, key: str = "combo_id", name: str = "run_order") -> DataFrame:
    """B2: fixed pseudo-random order of the grid, independent of temp."""
    keyed = grid.withColumn("_h", shuffle_key(seed, key))
    return global_ordinal(keyed, ["_h", key], name=name).drop("_h")


def pending(grid: DataFrame, done: DataFrame, key: str = "combo_id") -> DataFrame:
    """Combinations not yet done (anti-join on the combination id, not on text)."""
    return grid.join(done.select(key).distinct(), key, "left_anti")


def generated_only(positions: DataFrame, gen, pos: str, prompt_n: str) -> DataFrame:
    """Drop the first ``prompt_n`` positions only when the generation is longer.

    The per-generation count is an aggregation (combined map-side) joined back
    on the generation key, so AQE can split an oversized generation; call it
    on narrow rows (after the metric), not on score vectors.
    """
    keys = [gen] if isinstance(gen, str) else list(gen)
    totals = positions.groupBy(*keys).agg(F.count(F.lit(1)).alias("_total"))
    return (
        positions.join(totals, keys)
        .where((F.col(pos) >= F.col(prompt_n)) | (F.col("_total") <= F.col(prompt_n)))
        .drop("_total")
    )


def with_rank_and_chkpt(
    runs: DataFrame, order_cols: Sequence[str], save_interval: int = 20, by: Sequence[str] = ()
) -> DataFrame:
    """rank = 0-based order, chkpt_id = floor(rank / save_interval)."""
    ranked = global_ordinal(runs, list(order_cols), name="rank", by=by)
    return ranked.withColumn("chkpt_id", F.floor(F.col("rank") / save_interval).cast("bigint"))


def with_rank_offline(scores_runs: DataFrame, bundle: str = "bundle_id", order=("gen_id",)) -> DataFrame:
    """B12, offline path: rank restarts inside every bundle and chkpt_id is the
    bundle number (so F5 and F8 differ from the online path)."""
    ranked = global_ordinal(scores_runs, list(order), name="rank", by=[bundle])
    return ranked.withColumn("chkpt_id", F.col(bundle).cast("bigint"))


def distinct_prompts(df: DataFrame, keys: Sequence[str] = ("language", "prompt"), order: Sequence[str] = (), name: str = "first_seen") -> DataFrame:
    """Distinct prompts per language (undoes the x temps repetition). The last
    key is the text: rows are grouped by its hash, not by the text itself.

    With ``order`` (the columns of the row order) each prompt also has ``name``, its number from
    0 within its language in order of first occurrence: the least order key of a text
    comes from the same aggregation, and only the distinct prompts are numbered.
    """
    *groups, text = keys
    hashed = df.select(*keys, F.md5(F.col(text)).alias("_md5"), *([F.struct(*order).alias("_at")] if order else []))
    if not order:
        return hashed.dropDuplicates([*groups, "_md5"]).select(*keys)
    first = hashed.groupBy(*groups, "_md5").agg(F.min_by(text, "_at").alias(text), F.min("_at").alias("_at"))
    return global_ordinal(first, ["_at"], name=name, by=groups).select(*keys, name)


HASH_BINS = 4096


def hash_draw(df: DataFrame, group: str, n: int, seed, *keys: str, name: str = "draw") -> DataFrame:
    """The first ``n`` rows of every group in the order of md5(seed, keys), numbered
    from 1; ``keys`` are unique within a group.

    The hash's leading digits are bins of even size. Their counts (a table of
    HASH_BINS rows a group) tell which bins the draw reaches and at which
    number each starts; only rows of those bins are ranked, bin by bin. The
    work is the same for every ``n``, and no group is sorted as a whole. The rows are
    stored with their hashes first: counts and draw read them, and the input is
    evaluated once.
    """
    hashed = df.withColumn("_h", shuffle_key(seed, *keys))
    hashed = materialize(hashed, "to-draw").withColumn("_bin", F.conv(F.substring("_h", 1, 3), 16, 10).cast("int"))
    before = Window.partitionBy(group).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    counts = hashed.groupBy(group, "_bin").agg(F.count(F.lit(1)).alias("_c"))
    reach = counts.withColumn("_off", F.coalesce(F.sum("_c").over(before), F.lit(0))).where(F.col("_off") < n)
    reach = reach.select(F.col(group).alias("_g"), F.col("_bin").alias("_b"), "_off")
    few = hashed.join(reach, hashed[group].eqNullSafe(reach["_g"]) & (hashed["_bin"] == reach["_b"]))
    inside = F.row_number().over(Window.partitionBy(group, "_bin").orderBy("_h", *keys))
    out = few.withColumn(name, (F.col("_off") + inside).cast("bigint")).where(F.col(name) <= n)
    return out.select(*df.columns, name)


def sample_per_group(
    df: DataFrame, group: str, item: str, n: int, seed=42, name: str = "draw"
) -> DataFrame:
    """min(n, available) distinct items per group, without replacement, in
    the order of md5(seed, item). Duplicates are found by the item's hash."""
    items = df.select(group, item, F.md5(F.col(item)).alias("_md5")).dropDuplicates([group, "_md5"]).drop("_md5")
    return hash_draw(items, group, n, seed, item, name=name)
