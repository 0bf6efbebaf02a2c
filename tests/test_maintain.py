"""Run-table maintenance: backfill, audit, progress."""

from pyspark.sql import functions as F

from concentra.operators import maintain as mt


def test_backfill_per_model_and_keep(spark):
    rows = [("a", 1.0), ("b", 2.0), ("a", 3.0), ("b", 4.0), ("a", 5.0)]
    df = spark.createDataFrame(rows, "model string, gen_time double")
    got = mt.backfill_rank(df, batch=2).orderBy("gen_time").collect()
    assert [(r.model, r.rank, r.chkpt_id) for r in got] == [("a", 0, 0), ("b", 0, 0), ("a", 1, 0), ("b", 1, 0), ("a", 2, 1)]
    complete = df.withColumn("rank", F.lit(7)).withColumn("chkpt_id", F.lit(3))
    assert mt.backfill_rank(complete) is complete


def test_audit_and_progress(spark):
    df = spark.createDataFrame([(1.0, 0.5, 0, 0), (3.0, 0.7, None, 0)], "gen_time double, ned_mean double, rank int, chkpt_id int")
    a = mt.audit_columns({"x": df, "y": df.drop("rank")}).orderBy("source").collect()
    assert a[0].null_rank == 1 and a[0].needs_fix
    assert not a[1].has_rank and a[1].needs_fix
    p = mt.progress(df, total=4).first()
    assert p.done == 2 and p.pct == 50.0 and p.elapsed_s == 2.0 and p.rate_per_s == 1.0
    assert p.remaining_s == 2.0 and p.last_value == 0.7
