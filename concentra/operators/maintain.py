"""Maintenance of run tables (M1-M3)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordinal import global_ordinal


def backfill_rank(
    df: DataFrame, batch: int = 20, order: Sequence[str] = ("gen_time",), model: str = "model"
) -> DataFrame:
    """M1: keep complete rank/chkpt_id; otherwise rank = 0-based order
    (per model when the table holds more than one), chkpt_id = floor(rank / batch).

    The two decisions read bounded answers (does an incomplete row exist, are
    there two models) with ``limit``-style actions.
    """
    cols = set(df.columns)
    if {"rank", "chkpt_id"} <= cols:
        incomplete = df.where(F.col("rank").isNull() | F.col("chkpt_id").isNull()).limit(1).count() > 0
        if not incomplete:
            return df
    base = df.drop(*[c for c in ("rank", "chkpt_id") if c in cols])
    combined = model in cols and base.select(model).distinct().limit(2).count() > 1
    ranked = global_ordinal(base, list(order), name="rank", by=[model] if combined else [])
    return ranked.withColumn("chkpt_id", F.floor(F.col("rank") / batch).cast("bigint"))


def audit_columns(frames: dict[str, DataFrame]) -> DataFrame:
    """M2: per input: presence of rank/chkpt_id and their NULL counts; changes nothing."""
    out = None
    for name, df in frames.items():
        cols = set(df.columns)
        has_r, has_c = "rank" in cols, "chkpt_id" in cols
        row = df.agg(
            F.count(F.lit(1)).cast("bigint").alias("n_rows"),
            (F.count_if(F.col("rank").isNull()) if has_r else F.lit(None)).cast("bigint").alias("null_rank"),
            (F.count_if(F.col("chkpt_id").isNull()) if has_c else F.lit(None)).cast("bigint").alias("null_chkpt"),
        ).select(
            F.lit(name).alias("source"),
            F.lit(has_r).alias("has_rank"),
            F.lit(has_c).alias("has_chkpt"),
            "n_rows",
            "null_rank",
            "null_chkpt",
        )
        out = row if out is None else out.unionByName(row)
    return out.withColumn(
        "needs_fix",
        ~(F.col("has_rank") & F.col("has_chkpt"))
        | (F.coalesce(F.col("null_rank"), F.lit(0)) + F.coalesce(F.col("null_chkpt"), F.lit(0)) > 0),
    )


def progress(
    df: DataFrame, total: int, time: str = "gen_time", value: str = "ned_mean", by: Sequence[str] = (),
    tiebreak: Sequence[str] = (),
) -> DataFrame:
    """M3: done, percent, elapsed, rate, remaining time and last value, from the
    data itself (right also after a resume). ``time`` is epoch seconds."""
    t = F.col(time).cast("double")
    last_key = F.struct(t, *[F.col(c) for c in tiebreak]) if tiebreak else t
    s = df.groupBy(*by).agg(
        F.count(F.lit(1)).cast("bigint").alias("done"),
        F.min(t).alias("first_time"),
        F.max(t).alias("last_time"),
        F.max_by(F.col(value), last_key).alias("last_value"),
    )
    elapsed = F.col("last_time") - F.col("first_time")
    rate = F.col("done") / F.nullif(elapsed, F.lit(0.0))
    return s.select(
        *by,
        "done",
        (F.col("done") * 100.0 / F.lit(total)).alias("pct"),
        elapsed.alias("elapsed_s"),
        rate.alias("rate_per_s"),
        ((F.lit(total) - F.col("done")) / rate).alias("remaining_s"),
        "last_value",
    )
