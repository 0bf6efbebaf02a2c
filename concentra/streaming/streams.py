"""Structured Streaming operators.

Every stream writes through ``foreachBatch`` into a parquet table keyed by
the micro-batch id, overwriting that batch's folder, so a replayed batch
(after a failure, from the checkpoint) replaces itself: exactly-once results
on shared storage. ``run_available`` drives a stream with the
``availableNow`` trigger and returns the sink table as a batch frame.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import metric
from ..operators.reduce import reduce_generation


def parquet_stream(spark: SparkSession, folder: str, name: str, max_files: int | None = None) -> DataFrame:
    """Stream the parquet table ``name`` of ``folder``, a file or a folder of part
    files (schema from the table). The path is given as a pattern that only the
    table matches, because the file source takes a plain path for a folder."""
    schema = spark.read.parquet(os.path.join(folder, name)).schema
    r = spark.readStream.schema(schema)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.parquet(os.path.join(folder, f"{name[:-1]}[{name[-1]}]"))


_EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def event_time(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Watermarks need TIMESTAMP. A wall-clock time (TIMESTAMP_NTZ) is taken as UTC,
    whatever the session's time zone."""
    if dict(df.dtypes)[ts] != "timestamp_ntz":
        return df.withColumn(ts, F.col(ts).cast("timestamp"))
    return df.withColumn(ts, F.expr(f"timestamp_micros(timestampdiff(MICROSECOND, {_EPOCH}, `{ts}`))"))


def wall_clock(c: str) -> Column:
    """The UTC wall-clock time of an instant, whatever the session's time zone."""
    return F.expr(f"timestampadd(MICROSECOND, unix_micros(`{c}`), {_EPOCH})")


def _batch_writer(out: str, transform: Callable[[DataFrame, int], DataFrame] | None = None):
    def write(batch: DataFrame, batch_id: int) -> None:
        res = batch if transform is None else transform(batch, batch_id)
        res.withColumn("batch_id", F.lit(batch_id).cast("bigint")).write.mode("overwrite").parquet(
            os.path.join(out, f"batch_id={batch_id}")
        )

    return write


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def state_session(spark: SparkSession) -> SparkSession:
    """A session for streams with state (S2, S4, S5): their state lies in RocksDB on the
    executors' disks and in the checkpoint folder, not on the JVM heap, and is stored by
    changes. Tables, temporary views aside, are those of ``spark``, whose own
    settings stay as they are."""
    own = spark.newSession()
    for key in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone", "spark.sql.ansi.enabled"):
        own.conf.set(key, spark.conf.get(key))
    own.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    own.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
    return own


def state_report(progress) -> list[dict]:
    """Per micro-batch and stateful operator of a query's progress: rows and bytes of state,
    rows dropped as later than the watermark, and whether RocksDB holds the state."""
    out = []
    for p in progress:
        for op in p.stateOperators:
            custom = dict(op.customMetrics)
            out.append({
                "batch_id": p.batchId, "operator": op.operatorName, "state_rows": op.numRowsTotal, "state_bytes": op.memoryUsedBytes,
                "late_rows": op.numRowsDroppedByWatermark, "rocksdb": any(k.startswith("rocksdb") for k in custom),
            })
    return out


def run_available(stream: DataFrame, out: str, checkpoint: str, mode: str = "append",
                  transform: Callable[[DataFrame, int], DataFrame] | None = None, report: list | None = None) -> DataFrame:
    """Process everything available now, then read the sink back (batch). When
    nothing arrived the result is an empty frame of the sink's schema. ``report`` takes the
    rows of ``state_report``; a query of a ``state_session`` whose state is not in
    RocksDB is an error."""
    spark = stream.sparkSession
    q = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .foreachBatch(_batch_writer(out, transform))
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    states = state_report(q.recentProgress)
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass") == ROCKSDB and not all(s["rocksdb"] for s in states):
        raise RuntimeError("the state of the query is not in RocksDB")
    if report is not None:
        report.extend(states)
    empty = spark.createDataFrame([], stream.schema)
    empty = empty if transform is None else transform(empty, 0)
    schema = T.StructType([*[T.StructField(f.name, f.dataType) for f in empty.schema.fields], T.StructField("batch_id", T.LongType())])
    if q.lastProgress is None and not any(p.numInputRows for p in q.recentProgress):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", out).parquet(out)


# S1
def stream_runs(positions: DataFrame, keys: Sequence[str] = ("gen_id",), temps=(1.0,)) -> Callable:
    """Per micro-batch: metric per position at every temperature (one
    projection, vectors never copied per temperature), reduced per
    generation and temperature.

    Bundles hold whole generations, so a generation never spans batches and
    the reduction is stateless (no state store, no watermark needed).
    """
    per_t = F.array(
        *[F.struct(F.lit(float(t)).alias("temp"), metric.ned("scores", float(t)).alias("ned")) for t in temps]
    )

    def transform(batch: DataFrame, _bid: int) -> DataFrame:
        pos = batch.select(*keys, F.inline(per_t))
        return reduce_generation(pos, [*keys, "temp"], "ned")

    return transform


# S2
def monitor(events: DataFrame, key: str, value: str, ts: str = "ts", window: str = "1 day",
            slide: str | None = None, watermark: str = "1 hour", limit: float = 10.0) -> DataFrame:
    """Mean, std, n and share above ``limit`` per key and event-time window;
    rows later than the watermark are dropped (update mode keeps state bounded)."""
    win = F.window(ts, window, slide) if slide else F.window(ts, window)
    return (
        event_time(events, ts).withWatermark(ts, watermark)
        .groupBy(win.alias("w"), key)
        .agg(
            F.avg(value).alias("mean"),
            F.stddev_samp(value).alias("std"),
            F.count(F.lit(1)).cast("bigint").alias("n"),
            F.avg(F.when(F.col(value) > limit, 1.0).otherwise(0.0)).alias("share_above"),
        )
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), key, "mean", "std", "n", "share_above")
    )


def latest_per_key(sink: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Final state of an update-mode sink: the row of the last batch per key."""
    cols = [c for c in sink.columns if c not in (*keys, "batch_id")]
    return sink.groupBy(*keys).agg(
        *[F.max_by(F.col(c), F.col("batch_id")).alias(c) for c in cols]
    )


# S3
def day_moments(batch: DataFrame, _bid: int, value: str = "value", ts: str = "ts",
                covariates: Sequence[str] = ()) -> DataFrame:
    """Mergeable moments of one micro-batch per day: n, mean and M2 of the
    value, for every covariate x its mean, M2 and the co-moment C_xy, and the
    co-moments of the covariates (rows with a NULL value or covariate are left out)."""
    ok = F.col(value).isNotNull()
    for x in covariates:
        ok = ok & F.col(x).isNotNull()
    b = batch.where(ok)
    aggs = [
        F.count(F.lit(1)).cast("bigint").alias("n"),
        F.avg(value).alias("mean"),
        (F.var_pop(value) * F.count(F.lit(1))).alias("m2"),
    ]
    for x in covariates:
        aggs += [
            F.avg(F.col(x).cast("double")).alias(f"mean_{x}"),
            (F.var_pop(F.col(x).cast("double")) * F.count(F.lit(1))).alias(f"m2_{x}"),
            (F.covar_pop(F.col(x).cast("double"), F.col(value)) * F.count(F.lit(1))).alias(f"c_{x}"),
        ]
    for i, p in enumerate(covariates):
        for q in covariates[i + 1 :]:
            aggs.append((F.covar_pop(F.col(p).cast("double"), F.col(q).cast("double")) * F.count(F.lit(1))).alias(f"c_{p}_{q}"))
    return b.groupBy(F.to_date(ts).alias("day")).agg(*aggs)


def _adder(variables: Sequence[str], pairs: Sequence[tuple[str, str]]) -> Callable[[Column, Column], Column]:
    """Merge of two moment structs (Chan et al.)."""

    def add(acc: Column, x: Column) -> Column:
        n = acc["n"] + x["n"]
        part = F.when(n > 0, acc["n"] * x["n"] / F.nullif(n, F.lit(0.0))).otherwise(0.0)
        delta = {v: x[f"mean_{v}"] - acc[f"mean_{v}"] for v in variables}
        out = [n.alias("n")]
        out += [(acc[f"mean_{v}"] + F.when(n > 0, delta[v] * x["n"] / F.nullif(n, F.lit(0.0))).otherwise(0.0)).alias(f"mean_{v}") for v in variables]
        out += [(acc[f"m2_{v}"] + x[f"m2_{v}"] + part * delta[v] * delta[v]).alias(f"m2_{v}") for v in variables]
        out += [(acc[f"c_{a}_{b}"] + x[f"c_{a}_{b}"] + part * delta[a] * delta[b]).alias(f"c_{a}_{b}") for a, b in pairs]
        return F.struct(*out)

    return add


def _merge_step(m: DataFrame, keys: Sequence[str], variables: Sequence[str], pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Merge moment rows that agree in ``keys`` (Chan et al.), as one fold over each
    group's rows: n, mean_v, m2_v and c_v_w of variables and pairs."""
    fields = ["n", *[f"mean_{v}" for v in variables], *[f"m2_{v}" for v in variables], *[f"c_{a}_{b}" for a, b in pairs]]
    rows = F.collect_list(F.struct(*[F.col(f).cast("double").alias(f) for f in fields]))
    zero = F.struct(*[F.lit(0.0).alias(f) for f in fields])

    merged = m.where(F.col("n") > 0).groupBy(*keys).agg(F.aggregate(rows, zero, _adder(variables, pairs)).alias("_m"))
    return merged.select(*keys, *[F.col(f"_m.{f}").alias(f) for f in fields])


MERGE_FAN = 256


def merge_all(moments: DataFrame, variables: Sequence[str], pairs: Sequence[tuple[str, str]], by: Sequence[str] = ()) -> DataFrame:
    """Exact merge of moment rows per ``by``, in two steps: first within MERGE_FAN
    shares of the rows, then the shares; no task sees all rows."""
    share = F.pmod(F.xxhash64(*moments.columns), F.lit(MERGE_FAN))
    first = _merge_step(moments.withColumn("_share", share), [*by, "_share"], variables, pairs)
    return _merge_step(first, list(by), variables, pairs)


def _last_days(daily: DataFrame, days: int, variables: Sequence[str], pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """For every day of ``daily`` (one row a day) the merge of the last ``days`` calendar days.

    Moments cannot be taken out of a merge again, so days are cut into blocks of ``days`` and
    every block is folded twice, from its first day on and back from its last. A
    window is the tail of one block and the head of the next: two folds of a block and
    one merge a day, however long the window is.
    """
    fields = [c for c in daily.columns if c != "day"]
    add = _adder(variables, pairs)
    zero = F.struct(*[F.lit(0.0).alias(f) for f in fields])
    number = F.datediff("day", F.lit("1970-01-01").cast("date"))
    block = F.floor(number / days).cast("int")
    rows = daily.select(block.alias("_b"), F.pmod(number, F.lit(days)).alias("_p"), F.struct(*[F.col(f).cast("double").alias(f) for f in fields]).alias("_m"))
    blocks = rows.groupBy("_b").agg(F.collect_list(F.struct("_p", "_m")).alias("_rows"))  # at most ``days`` rows
    on = lambda p: F.coalesce(F.get(F.filter("_rows", lambda r: r["_p"] == p), F.lit(0))["_m"], zero)
    every = blocks.withColumn("_days", F.transform(F.sequence(F.lit(0), F.lit(days - 1)), on))
    fold = lambda c: F.slice(F.aggregate(c, F.array(zero), lambda acc, x: F.concat(acc, F.array(add(F.element_at(acc, -1), x)))), 2, days)
    folds = every.select("_b", fold(F.col("_days")).alias("_heads"), F.reverse(fold(F.reverse("_days"))).alias("_tails"))
    heads = folds.select("_b", F.posexplode("_heads").alias("_p", "_head"))
    # the tail from place p of a block goes before the head up to place p - 1 of the next
    tails = folds.select((F.col("_b") + 1).alias("_b"), F.posexplode("_tails").alias("_p", "_tail")).withColumn("_p", F.col("_p") - 1)
    ends = daily.select("day", block.alias("_b"), F.pmod(number, F.lit(days)).alias("_p"))
    both = ends.join(heads, ["_b", "_p"]).join(tails, ["_b", "_p"], "left")
    merged = both.select("day", add(F.coalesce("_tail", zero), F.col("_head")).alias("_m"))
    return merged.select("day", *[F.col(f"_m.{f}").alias(f) for f in fields])


def merge_moments(moments: DataFrame, by: Sequence[str] = (), covariates: Sequence[str] = (), last_days: int | None = None) -> DataFrame:
    """Exact merge of ``day_moments`` rows; with ``last_days`` one row for every day, over the
    calendar days up to it. Output: n, mean, sample sd of the value,
    and per covariate its mean, sd, sum of squares, co-moment and r; for two
    covariates also their co-moment."""
    named = moments.withColumnsRenamed({"mean": "mean_y", "m2": "m2_y", **{f"c_{x}": f"c_y_{x}" for x in covariates}})
    variables = ["y", *covariates]
    pairs = [("y", x) for x in covariates] + [(a, b) for i, a in enumerate(covariates) for b in covariates[i + 1 :]]
    if last_days is None:
        s = merge_all(named, variables, pairs, by)
    else:
        by = ["day"]
        s = _last_days(merge_all(named, variables, pairs, by), last_days, variables, pairs)
    n1 = F.nullif(F.col("n") - 1, F.lit(0.0))
    out = [*by, F.col("n").cast("bigint").alias("n"), F.col("mean_y").alias("mean"), F.sqrt(F.col("m2_y") / n1).alias("sd"), F.col("m2_y").alias("m2")]
    for x in covariates:
        out += [
            F.col(f"mean_{x}"),
            F.sqrt(F.col(f"m2_{x}") / n1).alias(f"sd_{x}"),
            (F.col(f"c_y_{x}") / F.nullif(F.sqrt(F.col("m2_y") * F.col(f"m2_{x}")), F.lit(0.0))).alias(f"r_{x}"),
            F.col(f"m2_{x}"),
            F.col(f"c_y_{x}").alias(f"c_{x}"),
        ]
    out += [F.col(f"c_{a}_{b}") for i, a in enumerate(covariates) for b in covariates[i + 1 :]]
    return s.select(*out)


# S4
def session_runs(events: DataFrame, key: str, ts: str = "ts", gap: str = "30 minutes",
                 watermark: str | None = None) -> DataFrame:
    """Runs of one key delimited by a gap in time (``session_window``); batch
    or stream (give a watermark when streaming)."""
    src = event_time(events, ts)
    src = src.withWatermark(ts, watermark) if watermark else src
    return (
        src.groupBy(key, F.session_window(ts, gap).alias("s"))
        .agg(F.count(F.lit(1)).cast("bigint").alias("n_events"))
        .select(key, F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "n_events")
    )


# S5
def stream_dedup(events: DataFrame, key: Sequence[str], ts: str = "ts", watermark: str = "1 hour") -> DataFrame:
    """A record that arrives twice within the watermark counts once."""
    return event_time(events, ts).withWatermark(ts, watermark).dropDuplicatesWithinWatermark(list(key))
