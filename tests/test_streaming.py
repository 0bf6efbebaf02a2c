"""Streaming operators against their batch equivalents."""

import os

import pytest

from pyspark.sql import functions as F

from concentra.session import table
from concentra.sources.io import scratch_dir
from concentra.streaming import streams as ss

from conftest import SF_SMALL


def test_session_stream_emits_subset_of_batch(spark):
    batch = {tuple(r) for r in ss.session_runs(table(spark, SF_SMALL, "events"), "user_id").collect()}
    src = ss.parquet_stream(spark, SF_SMALL, "events.parquet")
    base = scratch_dir(spark, "t-s4")
    out = ss.run_available(
        ss.session_runs(src, "user_id", watermark="1 hour"), os.path.join(base, "o"), os.path.join(base, "c")
    )
    got = {tuple(r) for r in out.drop("batch_id").collect()}
    assert got and got <= batch


def test_dedup_counts_each_event_once(spark):
    a = ss.parquet_stream(spark, SF_SMALL, "events.parquet")
    b = ss.parquet_stream(spark, SF_SMALL, "events.parquet")
    base = scratch_dir(spark, "t-s5")
    out = ss.run_available(
        ss.stream_dedup(a.unionByName(b), ["event_id"]).select("event_id"),
        os.path.join(base, "o"),
        os.path.join(base, "c"),
    )
    assert out.count() == table(spark, SF_SMALL, "events").count()
    assert out.select(F.countDistinct("event_id")).first()[0] == out.count()


def test_merged_moments_equal_batch(spark):
    ev = table(spark, SF_SMALL, "events")
    m = ss.day_moments(ev, 0, "value", "ts").unionByName(ss.day_moments(ev, 1, "value", "ts"))
    merged = ss.merge_moments(m).first()
    full = ev.agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd")).first()
    # two identical copies: n doubles, mean equal, sd slightly smaller
    assert merged.n == 2 * full.n
    assert abs(merged.mean - full.mean) < 1e-9


def test_merged_comoments_equal_batch(spark):
    ev = table(spark, SF_SMALL, "events").withColumn("hour", F.hour(F.col("ts").cast("timestamp")))
    halves = [ev.where(F.col("event_id") % 2 == k) for k in (0, 1)]
    m = ss.day_moments(halves[0], 0, "value", "ts", ["hour"]).unionByName(
        ss.day_moments(halves[1], 1, "value", "ts", ["hour"])
    )
    merged = ss.merge_moments(m, covariates=["hour"]).first()
    full = ev.agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"),
        F.corr("value", "hour").alias("r"),
    ).first()
    assert merged.n == full.n
    assert abs(merged.mean - full.mean) < 1e-9
    assert abs(merged.sd - full.sd) < 1e-9
    assert abs(merged.r_hour - full.r) < 1e-9


def _folder(spark, name):
    """The events as a table of four part files, in event order."""
    base = scratch_dir(spark, name)
    ev = table(spark, SF_SMALL, "events")
    ev.repartitionByRange(4, "event_id").sortWithinPartitions("event_id").write.parquet(os.path.join(base, "events.parquet"))
    return base, ev


def test_streams_read_folder_tables_in_micro_batches(spark):
    base, ev = _folder(spark, "t-folder")
    src = ss.parquet_stream(spark, base, "events.parquet", max_files=1)
    out = ss.run_available(src.select("event_id"), os.path.join(base, "o"), os.path.join(base, "c"))
    assert out.count() == ev.count() and out.select("batch_id").distinct().count() == 4
    # The copies arrive in different batches
    twice = ss.parquet_stream(spark, base, "events.parquet", max_files=1).unionByName(ss.parquet_stream(spark, base, "events.parquet", max_files=2))
    d = ss.run_available(ss.stream_dedup(twice, ["event_id"], watermark="3650 days").select("event_id"), os.path.join(base, "o5"), os.path.join(base, "c5"))
    assert d.count() == ev.count() == d.select("event_id").distinct().count()
    # S3: moments of the batches merge to those of the table
    m = ss.run_available(ss.parquet_stream(spark, base, "events.parquet", max_files=1), os.path.join(base, "o3"), os.path.join(base, "c3"),
                         transform=lambda b, i: ss.day_moments(b, i, "value", "ts"))
    full = ev.agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd")).first()
    got = ss.merge_moments(m).first()
    assert got.n == full.n and abs(got.mean - full.mean) < 1e-9 and abs(got.sd - full.sd) < 1e-9


def test_late_rows_are_dropped(spark):
    """A row behind the watermark of an earlier batch does not count; one within it does."""
    base = scratch_dir(spark, "t-late")
    path = os.path.join(base, "events.parquet")
    def part(rows, i):
        df = spark.createDataFrame(rows, "t string, k string, v double").selectExpr("cast(t as timestamp_ntz) as ts", "k", "v")
        df.coalesce(1).write.mode("append").parquet(path)
    for i, rows in enumerate((
        [("2024-01-01 10:00:00", "a", 1.0), ("2024-01-03 00:00:00", "a", 2.0)],
        [("2024-01-03 01:00:00", "a", 5.0)],
        [("2024-01-01 11:00:00", "a", 9.0), ("2024-01-02 23:30:00", "a", 4.0)],
    )):
        part(rows, i)
    src = ss.parquet_stream(spark, base, "events.parquet", max_files=1)
    mon = ss.monitor(src, "k", "v", window="1 day", watermark="2 hours")
    sink = ss.run_available(mon, os.path.join(base, "o"), os.path.join(base, "c"), mode="update")
    final = {r.window_start.strftime("%d"): r.n for r in ss.latest_per_key(sink, ["window_start", "window_end", "k"]).collect()}
    assert final.get("02") == 1 and final.get("03") == 2
    assert final["01"] == 1  # the row of 11:00 came a day too late


def test_empty_source_gives_an_empty_frame(spark):
    base = scratch_dir(spark, "t-empty")
    table(spark, SF_SMALL, "events").limit(0).write.parquet(os.path.join(base, "events.parquet"))
    for name, f in {
        "s1": None,
        "s3": lambda b, i: ss.day_moments(b, i, "value", "ts"),
    }.items():
        out = ss.run_available(ss.parquet_stream(spark, base, "events.parquet"), os.path.join(base, name), os.path.join(base, name + "c"), transform=f)
        assert out.count() == 0 and "batch_id" in out.columns
    mon = ss.monitor(ss.parquet_stream(spark, base, "events.parquet"), "event_type", "value")
    assert ss.run_available(mon, os.path.join(base, "s2"), os.path.join(base, "s2c"), mode="update").count() == 0


def test_event_time_is_utc_in_any_session_zone(spark):
    ev = table(spark, SF_SMALL, "events").orderBy("event_id").limit(5)
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        got = []
        for zone in ("UTC", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            e = ss.event_time(ev)
            got.append([(r.m, r.w) for r in e.select(F.unix_micros("ts").alias("m"), ss.wall_clock("ts").cast("string").alias("w")).collect()])
        assert got[0] == got[1]
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_state_lies_in_rocksdb_and_late_rows_are_reported(spark, tmp_path):
    import datetime as dt

    own = ss.state_session(spark)
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") != ss.ROCKSDB
    day = dt.datetime(2024, 1, 1)
    for i, hours in enumerate(([0, 1, 1, 30], [2, 31, 31])):  # hour 2 is late by the second file
        rows = [(f"{h}", day + dt.timedelta(hours=h)) for h in hours]
        spark.createDataFrame(rows, "k string, ts timestamp").coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    report = []
    stream = ss.parquet_stream(own, str(tmp_path), "events.parquet", max_files=1)
    out = ss.run_available(ss.stream_dedup(stream, ["k"], watermark="1 hour"), f"{tmp_path}/out", f"{tmp_path}/ckpt", report=report)
    kept = sorted(r.k for r in out.collect())
    assert kept.count("1") == 1 and kept.count("31") == 1
    assert report and all(r["rocksdb"] for r in report) and any(r["state_rows"] > 0 for r in report)
    assert sum(r["late_rows"] for r in report) == len([0, 1, 1, 30, 2, 31, 31]) - 2 - len(kept)


@pytest.mark.parametrize("days", [1, 3, 7])
def test_rolling_moments_equal_a_pass_per_window(spark, days):
    import datetime as dt

    import numpy as np

    rng = np.random.default_rng(days)
    start = dt.date(2023, 12, 28)
    rows = [(start + dt.timedelta(days=int(d)), float(v), float(h)) for d, v, h in zip(rng.choice([0, 1, 2, 5, 6, 7, 8, 20, 21], 300), rng.normal(size=300) + 1e6, rng.integers(0, 24, 300))]
    events = spark.createDataFrame(rows, "day date, value double, hour double")
    # two batches a day
    parts = [ss.day_moments(events.where(c), 0, ts="day", covariates=["hour"]) for c in ("hour < 9", "hour >= 9")]
    got = {r.day: r for r in ss.merge_moments(parts[0].unionByName(parts[1]), covariates=["hour"], last_days=days).collect()}
    assert set(got) == {r[0] for r in rows}
    for day, r in got.items():
        mine = np.array([(v, h) for d, v, h in rows if day - dt.timedelta(days=days - 1) <= d <= day])
        assert r.n == len(mine) and r["mean"] == pytest.approx(mine[:, 0].mean())
        assert r.sd == pytest.approx(mine[:, 0].std(ddof=1)) and r.r_hour == pytest.approx(np.corrcoef(mine.T)[0, 1])
