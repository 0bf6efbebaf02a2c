"""Registered queries of run-table maintenance (M1-M3) and streaming."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from ..operators import maintain as mt
from ..operators import stats as st
from ..session import table
from ..sources import fixtures as fx
from ..sources.io import scratch_dir
from ..streaming import streams as ss
from . import sqlstats as q
from .registry import register, rounded
from .sqlparts import DOC_WORDS, POS_NED, RUNS_DOCS, runs_vec_sql, with_ctes

RUNS_CTES = (POS_NED, runs_vec_sql())
TS_FMT = "yyyy-MM-dd HH:mm:ss"
TS_FMT_SQL = "%Y-%m-%d %H:%M:%S"


# ---------------------------------------------------------------- M1-M3


@register(
    "m1_backfill_rank",
    with_ctes(
        *RUNS_CTES,
        body="""
SELECT gen_id, temp, model,
       CAST(row_number() OVER (PARTITION BY model ORDER BY temp, gen_id) - 1 AS BIGINT) AS rank,
       CAST((row_number() OVER (PARTITION BY model ORDER BY temp, gen_id) - 1) // 20 AS BIGINT) AS chkpt_id
FROM runs""",
    ),
    doubles=["temp"],
)
def m1_backfill_rank(spark, sf_dir):
    """A combined run table that lost rank/chkpt_id: ranks restart per model."""
    runs = fx.runs_vec(spark, sf_dir)
    fixed = mt.backfill_rank(runs, 20, order=("temp", "gen_id"))
    return rounded(fixed.select("gen_id", "temp", "model", "rank", "chkpt_id"))


@register(
    "m1_backfill_keep",
    with_ctes(*RUNS_CTES, body="SELECT gen_id, temp, rank, chkpt_id FROM runs"),
    doubles=["temp"],
)
def m1_backfill_keep(spark, sf_dir):
    """A complete table is returned unchanged."""
    runs = fx.runs_vec(spark, sf_dir, ranked=True)
    return rounded(mt.backfill_rank(runs, 20, order=("temp", "gen_id")).select("gen_id", "temp", "rank", "chkpt_id"))


@register(
    "m2_audit_columns",
    with_ctes(
        *RUNS_CTES,
        DOC_WORDS,
        RUNS_DOCS,
        body="""
SELECT 'runs_vec' AS source, true AS has_rank, true AS has_chkpt, CAST(count(*) AS BIGINT) AS n_rows,
       CAST(count(*) - count(rank) AS BIGINT) AS null_rank, CAST(count(*) - count(chkpt_id) AS BIGINT) AS null_chkpt,
       (count(*) - count(rank)) + (count(*) - count(chkpt_id)) > 0 AS needs_fix FROM runs
UNION ALL
SELECT 'runs_docs', true, true, CAST(count(*) AS BIGINT), CAST(count(*) - count(rank) AS BIGINT),
       CAST(count(*) - count(chkpt_id) AS BIGINT), (count(*) - count(rank)) + (count(*) - count(chkpt_id)) > 0 FROM runs_docs
UNION ALL
SELECT 'runs_vec_without_rank', false, false, CAST(count(*) AS BIGINT), NULL, NULL, true FROM runs
UNION ALL
SELECT 'events', false, false, CAST(count(*) AS BIGINT), NULL, NULL, true FROM events""",
    ),
)
def m2_audit_columns(spark, sf_dir):
    vec = fx.runs_vec(spark, sf_dir, ranked=True)
    return mt.audit_columns(
        {
            "runs_vec": vec,
            "runs_docs": fx.runs_docs(spark, sf_dir, ranked=True),
            "runs_vec_without_rank": vec.drop("rank", "chkpt_id"),
            "events": table(spark, sf_dir, "events"),
        }
    )


@register(
    "m3_progress",
    """
SELECT user_id, CAST(done AS BIGINT) AS done, done * 100.0 / 100 AS pct, last_time - first_time AS elapsed_s,
       done / nullif(last_time - first_time, 0) AS rate_per_s,
       (100 - done) / (done / nullif(last_time - first_time, 0)) AS remaining_s, last_value
FROM (
  SELECT user_id, count(*) AS done, min(t) AS first_time, max(t) AS last_time, max(lv) AS last_value
  FROM (SELECT user_id, epoch_us(ts) / 1e6 AS t,
               first_value(value) OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS lv
        FROM events)
  GROUP BY user_id)""",
    doubles=["pct", "elapsed_s", "rate_per_s", "remaining_s", "last_value"],
)
def m3_progress(spark, sf_dir):
    """Events per user read as finished generations of a run of 100."""
    ev = ss.event_time(table(spark, sf_dir, "events")).withColumn("gen_time", F.unix_micros("ts") / 1e6)
    return rounded(mt.progress(ev, 100, "gen_time", "value", by=["user_id"], tiebreak=["event_id"]))


# ---------------------------------------------------------------- S1-S5


def _scratch(spark, name):
    base = scratch_dir(spark, name)
    return os.path.join(base, "out"), os.path.join(base, "checkpoint")


@register(
    "s1_stream_runs",
    with_ctes(
        POS_NED,
        body="SELECT gen_id, temp, avg(ned) AS ned_mean, stddev_pop(ned) AS ned_std, count(*) AS seq_len FROM pos_ned GROUP BY gen_id, temp",
    ),
    doubles=["temp", "ned_mean", "ned_std"],
)
def s1_stream_runs(spark, sf_dir):
    src = ss.parquet_stream(spark, sf_dir, "embeddings.parquet")
    pos = src.select(
        F.floor(F.col("vec_id") / fx.POSITIONS_PER_GEN).cast("bigint").alias("gen_id"),
        F.transform("embedding", lambda x: x.cast("double") * F.lit(fx.GAIN)).alias("scores"),
    )
    out, ckpt = _scratch(spark, "s1")
    res = ss.run_available(pos, out, ckpt, transform=ss.stream_runs(pos, temps=fx.TEMPS))
    return rounded(res.drop("batch_id"))


@register(
    "s2_monitor",
    f"""
SELECT strftime(time_bucket(INTERVAL 1 day, ts), '{TS_FMT_SQL}') AS window_start, event_type,
       avg(value) AS mean, stddev_samp(value) AS std, CAST(count(*) AS BIGINT) AS n,
       avg(CASE WHEN value > 10.0 THEN 1.0 ELSE 0.0 END) AS share_above
FROM events GROUP BY ALL""",
    doubles=["mean", "std", "share_above"],
)
def s2_monitor(spark, sf_dir):
    src = ss.parquet_stream(ss.state_session(spark), sf_dir, "events.parquet")
    mon = ss.monitor(src, "event_type", "value", window="1 day", watermark="1 hour", limit=10.0)
    out, ckpt = _scratch(spark, "s2")
    sink = ss.run_available(mon, out, ckpt, mode="update")
    final = ss.latest_per_key(sink, ["window_start", "window_end", "event_type"])
    return rounded(
        final.select(
            F.date_format(ss.wall_clock("window_start"), TS_FMT).alias("window_start"), "event_type", "mean", "std", "n", "share_above"
        )
    )


@register(
    "s2_monitor_sliding",
    f"""
SELECT strftime(w, '{TS_FMT_SQL}') AS window_start, event_type,
       avg(value) AS mean, stddev_samp(value) AS std, CAST(count(*) AS BIGINT) AS n,
       avg(CASE WHEN value > 10.0 THEN 1.0 ELSE 0.0 END) AS share_above
FROM (SELECT event_type, value, unnest([time_bucket(INTERVAL 12 hour, ts), time_bucket(INTERVAL 12 hour, ts) - INTERVAL 12 hour]) AS w
      FROM events)
GROUP BY ALL""",
    doubles=["mean", "std", "share_above"],
)
def s2_monitor_sliding(spark, sf_dir):
    """1-day windows sliding every 12 hours: every event counts in two windows."""
    src = ss.parquet_stream(ss.state_session(spark), sf_dir, "events.parquet")
    mon = ss.monitor(src, "event_type", "value", window="1 day", slide="12 hours", watermark="1 hour", limit=10.0)
    out, ckpt = _scratch(spark, "s2s")
    sink = ss.run_available(mon, out, ckpt, mode="update")
    final = ss.latest_per_key(sink, ["window_start", "window_end", "event_type"])
    return rounded(
        final.select(
            F.date_format(ss.wall_clock("window_start"), TS_FMT).alias("window_start"), "event_type", "mean", "std", "n", "share_above"
        )
    )


def _moments_sink(spark, sf_dir):
    src = ss.parquet_stream(spark, sf_dir, "events.parquet").withColumn("hour", F.hour("ts")).withColumn("weekday", F.weekday("ts"))
    out, ckpt = _scratch(spark, "s3")
    return ss.run_available(
        src, out, ckpt, transform=lambda b, i: ss.day_moments(b, i, "value", "ts", covariates=["hour", "weekday"])
    )


_S3_SRC = "(SELECT value, hour(ts) AS hour, isodow(ts) - 1 AS weekday FROM events)"


@register(
    "s3_rolling_battery",
    "\nUNION ALL\n".join(
        f"({x})"
        for x in (
            q.f1("events", "value", "S3"),
            q.f4(_S3_SRC, "value", "hour", "S3r"),
            q.f3(_S3_SRC, "value", "hour", "S3o"),
            q.f8(_S3_SRC, "value", "hour", "weekday", "S3p"),
        )
    ),
)
def s3_rolling_battery(spark, sf_dir):
    """F1, a Pearson test and a slope (value ~ hour), and the partial slope given the
    weekday, from moments kept per day by the stream and merged exactly."""
    m = ss.merge_moments(_moments_sink(spark, sf_dir), covariates=["hour", "weekday"])
    n = F.col("n")
    t = F.col("mean") / F.nullif(F.col("sd") / F.sqrt(n), F.lit(0.0))
    note = F.when(n < 2, F.lit("fewer than 2 values")).when(F.col("sd") == 0, F.lit("zero variance"))
    f1 = m.select(*st._row("S3", F.when(n >= 2, t), n - 1, st._null(), F.col("mean"), n, note))
    pair = m.select("n", F.col("m2_hour").alias("sxx"), F.col("m2").alias("syy"), F.col("c_hour").alias("sxy"))
    dof = F.col("n") - 1
    both = m.select(
        "n", *[(F.col(c) / dof).alias(k) for c, k in (
            ("m2_hour", "c11"), ("c_hour", "c1y"), ("m2", "cyy"), ("m2_weekday", "c22"), ("c_hour_weekday", "c12"), ("c_weekday", "c2y"))]
    )
    rows = f1.unionByName(pair.select(*st._row("S3r", *st._pearson_parts()))).unionByName(pair.select(*st._ols_cols("value", "hour", "S3o")))
    return rounded(rows.unionByName(both.select(*st._row("S3p", *st._partial_parts()))))


@register(
    "s3_day_moments",
    "SELECT strftime(CAST(ts AS DATE), '%Y-%m-%d') AS day, CAST(count(value) AS BIGINT) AS n, avg(value) AS mean, "
    "stddev_samp(value) AS sd, avg(hour(ts)) AS mean_hour, stddev_samp(hour(ts)) AS sd_hour, "
    "corr(value, hour(ts)) AS r_hour FROM events GROUP BY ALL",
    doubles=["mean", "sd", "mean_hour", "sd_hour", "r_hour"],
)
def s3_day_moments(spark, sf_dir):
    m = ss.merge_moments(_moments_sink(spark, sf_dir), by=["day"], covariates=["hour", "weekday"])
    return rounded(
        m.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "n", "mean", "sd", "mean_hour", "sd_hour", "r_hour")
    )


WINDOW_DAYS = 7


@register(
    "s3_rolling_window",
    f"""
WITH d AS (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events WHERE value IS NOT NULL),
m AS (SELECT d.day, count(*) AS n, avg(value) AS mean, stddev_samp(value) AS sd, corr(value, hour(ts)) AS r, regr_slope(value, hour(ts)) AS slope
      FROM d JOIN events e ON CAST(e.ts AS DATE) BETWEEN d.day - {WINDOW_DAYS - 1} AND d.day WHERE value IS NOT NULL GROUP BY d.day)
SELECT strftime(day, '%Y-%m-%d') AS day, CAST(n AS BIGINT) AS n, mean / nullif(sd / sqrt(n), 0) AS t_mean,
       r * sqrt((n - 2) / nullif(1 - r * r, 0)) AS t_hour, slope FROM m""",
    doubles=["t_mean", "t_hour", "slope"],
)
def s3_rolling_window(spark, sf_dir):
    """For every day the tests over the week up to it (mean against 0; value ~ hour), from the
    moments that the stream keeps per day: no event is read again for a window."""
    m = ss.merge_moments(_moments_sink(spark, sf_dir), covariates=["hour", "weekday"], last_days=WINDOW_DAYS)
    nz = lambda c: F.nullif(c, F.lit(0.0))
    r = F.col("r_hour")
    return rounded(m.select(
        F.date_format("day", "yyyy-MM-dd").alias("day"), "n",
        (F.col("mean") / nz(F.col("sd") / F.sqrt("n"))).alias("t_mean"),
        (r * F.sqrt((F.col("n") - 2) / nz(1.0 - r * r))).alias("t_hour"),
        (F.col("c_hour") / nz(F.col("m2_hour"))).alias("slope"),
    ))


@register(
    "s4_session_runs",
    f"""
SELECT user_id, strftime(min(ts), '{TS_FMT_SQL}') AS session_start,
       strftime(max(ts) + INTERVAL 30 MINUTE, '{TS_FMT_SQL}') AS session_end, CAST(count(*) AS BIGINT) AS n_events
FROM (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS sid
      FROM (SELECT user_id, ts, event_id,
                   CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL
                          OR ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 30 MINUTE
                        THEN 1 ELSE 0 END AS new
            FROM events))
GROUP BY user_id, sid""",
)
def s4_session_runs(spark, sf_dir):
    s = ss.session_runs(table(spark, sf_dir, "events"), "user_id", gap="30 minutes")
    return s.select(
        "user_id",
        F.date_format(ss.wall_clock("session_start"), TS_FMT).alias("session_start"),
        F.date_format(ss.wall_clock("session_end"), TS_FMT).alias("session_end"),
        "n_events",
    )


_S4_SQL = f"""
SELECT user_id, strftime(min(ts), '{TS_FMT_SQL}') AS session_start,
       strftime(max(ts) + INTERVAL 30 MINUTE, '{TS_FMT_SQL}') AS session_end, CAST(count(*) AS BIGINT) AS n_events
FROM (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS sid
      FROM (SELECT user_id, ts, event_id,
                   CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL
                          OR ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 30 MINUTE
                        THEN 1 ELSE 0 END AS new
            FROM events))
GROUP BY user_id, sid
HAVING max(ts) + INTERVAL 30 MINUTE <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR"""


@register("s4_session_stream", _S4_SQL)
def s4_session_stream(spark, sf_dir):
    """The sessions as a stream: those that the watermark (an hour behind the last
    event) has closed are out, the others are still open."""
    src = ss.parquet_stream(ss.state_session(spark), sf_dir, "events.parquet")
    out, ckpt = _scratch(spark, "s4")
    s = ss.run_available(ss.session_runs(src, "user_id", gap="30 minutes", watermark="1 hour"), out, ckpt)
    return s.select(
        "user_id",
        F.date_format(ss.wall_clock("session_start"), TS_FMT).alias("session_start"),
        F.date_format(ss.wall_clock("session_end"), TS_FMT).alias("session_end"),
        "n_events",
    )


@register(
    "s5_stream_dedup",
    "SELECT event_type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY event_type",
)
def s5_stream_dedup(spark, sf_dir):
    """Every event is delivered twice (two sources); each counts once."""
    own = ss.state_session(spark)  # the keys of a watermark's span lie on disk
    a = ss.parquet_stream(own, sf_dir, "events.parquet")
    b = ss.parquet_stream(own, sf_dir, "events.parquet")
    d = ss.stream_dedup(a.unionByName(b), ["event_id"])
    out, ckpt = _scratch(spark, "s5")
    sink = ss.run_available(d.select("event_id", "event_type", "ts"), out, ckpt)
    return sink.groupBy("event_type").agg(F.count(F.lit(1)).cast("bigint").alias("n"))
