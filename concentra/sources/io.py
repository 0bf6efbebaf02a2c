"""Sources and sinks of run tables, prompt files and score bundles.

Score bundles are parquet (one row per position: ``gen_id, pos, scores``
plus meta columns) instead of pickled tensors. The bundle number is a
partition column (``chkpt=<n>``) when we write bundles, so that ordering and
pruning come from the file listing; foreign file names are parsed with the
bundle-index parsers (B6).
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.parsers import bundle_index_of_file, strip_ws
from ..operators.ordinal import in_order, running_starts
from ..session import scratch_path

# Run row (D4): the columns of a result table, with nullable optional columns.
RUN_SCHEMA = T.StructType(
    [
        T.StructField("prompt", T.StringType()),
        T.StructField("temp", T.DoubleType()),
        T.StructField("seq_len", T.LongType()),
        T.StructField("gen_time", T.DoubleType()),
        T.StructField("timestamp", T.StringType()),
        T.StructField("ned_mean", T.DoubleType()),
        T.StructField("ned_std", T.DoubleType()),
        T.StructField("model", T.StringType()),
        T.StructField("model_size", T.LongType()),
        T.StructField("domain", T.StringType()),
        T.StructField("rank", T.LongType()),
        T.StructField("chkpt_id", T.LongType()),
    ]
)

PROMPT_JSON = T.StructType(
    [
        T.StructField("domain", T.StringType()),
        T.StructField("prompt", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("len", T.LongType()),
    ]
)


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the session's shared checkpoint folder."""
    return scratch_path(spark, name)


# --- A1 / A1b: prompt files --------------------------------------------------


def parse_prompt_lines(lines: DataFrame, col: str = "value", keep_undomained: bool = False) -> DataFrame:
    """A1: lines -> prompts.

    Lines are stripped, blank ones dropped. A line starting with '{' is JSON:
    it becomes ``domain + ': ' + prompt``; malformed JSON or a missing key
    drops the line (A1b with ``keep_undomained``: a JSON line without domain
    keeps the bare prompt). Other lines are prompts as they are.
    Output: prompt, is_json.
    """
    s = lines.select(strip_ws(F.col(col)).alias("_line")).where(F.col("_line") != "")
    is_json = F.startswith(F.col("_line"), F.lit("{"))
    # The JSON reader stops after the first value and ignores the rest of a line.
    # Within brackets, and within a field, a rest makes the text malformed; no
    # rest closes both, so a line that reads in both is one object and no more.
    inside = F.from_json(F.concat(F.lit("["), F.col("_line"), F.lit("]")), T.ArrayType(PROMPT_JSON), {"mode": "PERMISSIVE"})
    whole = T.StructType([T.StructField("r", PROMPT_JSON)])
    rec = F.from_json(F.concat(F.lit('{"r":'), F.col("_line"), F.lit("}")), whole, {"mode": "PERMISSIVE"}).getField("r")
    with_rec = s.select("_line", is_json.alias("is_json"), F.when(is_json & (F.size(inside) == 1), rec).alias("_r"))
    joined = F.concat(F.col("_r.domain"), F.lit(": "), F.col("_r.prompt"))
    json_prompt = joined
    if keep_undomained:
        json_prompt = F.when(F.col("_r.domain").isNull(), F.col("_r.prompt")).otherwise(joined)
    prompt = F.when(F.col("is_json"), json_prompt).otherwise(F.col("_line"))
    return with_rec.select(prompt.alias("prompt"), "is_json").where(F.col("prompt").isNotNull())


def read_prompts(spark: SparkSession, path: str, keep_undomained: bool = False) -> DataFrame:
    """A1 from a text / JSONL file or folder."""
    return parse_prompt_lines(spark.read.text(path), "value", keep_undomained)


# --- A2 / A3: run tables -------------------------------------------------------


def read_runs(spark: SparkSession, path: str, fmt: str = "parquet", schema: T.StructType | None = None) -> DataFrame:
    """A2: run table. CSV: header, quoted multi-line prompts, blanks kept."""
    if fmt == "csv":
        return (
            spark.read.schema(schema or RUN_SCHEMA)
            .option("header", True)
            .option("multiLine", True)
            .option("escape", '"')
            .option("ignoreLeadingWhiteSpace", False)
            .option("ignoreTrailingWhiteSpace", False)
            .csv(path)
        )
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def append_runs(df: DataFrame, path: str, fmt: str = "parquet", partition_by: str | None = "model") -> bool:
    """A3: append; an empty input writes nothing. Returns True if written."""
    if df.isEmpty():
        return False
    w = df.write.mode("append")
    if fmt == "csv":
        w = (
            w.option("header", True)
            .option("escape", '"')
            .option("ignoreLeadingWhiteSpace", False)
            .option("ignoreTrailingWhiteSpace", False)
        )
        if partition_by and partition_by in df.columns:
            w = w.partitionBy(partition_by)
        w.csv(path)
    else:
        if partition_by and partition_by in df.columns:
            w = w.partitionBy(partition_by)
        w.parquet(path)
    return True


# --- A4 / A5: score bundles -------------------------------------------------------


def write_bundles(positions: DataFrame, path: str, bundle: Column | str = "chkpt") -> None:
    """Write score rows as bundles, one folder per bundle number (``chkpt=<n>``)."""
    b = F.col(bundle) if isinstance(bundle, str) else bundle
    positions.withColumn("chkpt", b.cast("bigint")).write.mode("overwrite").partitionBy("chkpt").parquet(path)


def read_scores(spark: SparkSession, path: str, skip_bad: bool = False) -> DataFrame:
    """A4: bundles with their number in ``bundle_id`` (NULL = unnumbered, sorts last).

    Our bundles carry it as the ``chkpt`` partition column; otherwise it is
    parsed from the name of the bundle (``..._chkpt_<n>.pt``, a file or a folder
    of files). With ``skip_bad`` unreadable files are passed over; ``bad_files``
    lists them.
    """
    df = spark.read.option("ignoreCorruptFiles", skip_bad).parquet(path)
    if "chkpt" in df.columns:
        return df.withColumn("bundle_id", F.col("chkpt").cast("bigint")).drop("chkpt")
    return df.withColumn("bundle_id", bundle_index_of_file(F.col("_metadata.file_path")))


def bad_files(spark: SparkSession, path: str) -> DataFrame:
    """The files under ``path`` of which no row can be read (path, length): corrupt
    ones, and empty ones. Reads names on one side and file footers on the other."""
    names = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    data = names.where(~F.regexp_extract("path", r"([^/]*)$", 1).rlike("^[._]")).select("path", "length")
    df = spark.read.option("ignoreCorruptFiles", True).option("recursiveFileLookup", True).parquet(path)
    read = df.select(F.col("_metadata.file_path").alias("path")).distinct()
    key = lambda c: F.regexp_replace(c, "^file:/+", "file:/")
    return data.withColumn("_k", key(F.col("path"))).join(read.select(key(F.col("path")).alias("_k")), "_k", "left_anti").drop("_k")


def merge_bundles(scores: DataFrame, order_in_bundle=("gen_id", "pos")) -> DataFrame:
    """A5: concatenate bundles in number order (no dedup), numbering rows
    globally in ``merged_pos``; unnumbered bundles go last.

    Only the keys are ordered: one row per generation with its sorted positions
    (a generation is bounded, a bundle is not) gets the number of its first
    row from running counts, and the score rows take theirs by an equi-join on
    the generation. The vectors are neither sorted nor copied.
    """
    gen, pos = order_in_bundle
    last = F.lit(9223372036854775807)
    keyed = scores.withColumn("_b", F.coalesce(F.col("bundle_id"), last))
    gens = keyed.groupBy("_b", gen).agg(F.count(F.lit(1)).alias("_n"), F.sort_array(F.collect_list(pos)).alias("_at"))
    starts = running_starts(gens, ["_b", gen], "_n", "_start").select("_b", F.col(gen).alias("_gen"), "_start", "_at")
    j = keyed.join(starts, (keyed["_b"] == starts["_b"]) & keyed[gen].eqNullSafe(starts["_gen"]))
    # equal positions within a generation: the first of them, then by chance
    ordinal = F.col("_start") + F.array_position("_at", F.col(pos)) - 1
    return j.select(*scores.columns, ordinal.cast("bigint").alias("merged_pos"))


def write_merged(scores: DataFrame, path: str, order_in_bundle=("gen_id", "pos"), rows_per_range: int = 4096) -> None:
    """A5 as a compaction job: one merged table in merged-position order
    (nothing is written when no bundle matched). The vectors cross one shuffle, to their
    range of (bundle, generation, position), and are sorted there; their
    number is the offset of the range (a small table) and their place in it, so no
    join moves them again. ``rows_per_range`` bounds a file: fewer for wider vectors."""
    if scores.isEmpty():
        return
    keyed = scores.withColumn("_b", F.coalesce(F.col("bundle_id"), F.lit(9223372036854775807)))
    run = in_order(keyed, ["_b", *order_in_bundle], rows_per_range, stored=True)
    counts = run.groupBy(F.col("_range").alias("_r")).agg(F.count(F.lit(1)).alias("_n"))  # one row per range
    before = Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_r", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    numbered = run.join(F.broadcast(offsets), F.col("_range") == F.col("_r"))
    merged = numbered.select(*scores.columns, (F.col("_off") + F.col("_place")).cast("bigint").alias("merged_pos"))
    merged.write.mode("overwrite").parquet(path)


# --- A6 / A7 / A8 / A9 -------------------------------------------------------------


def combine_runs(frames: dict[str, DataFrame]) -> DataFrame:
    """Union by name (missing columns NULL) with a ``run_id`` per input."""
    out = None
    for run_id, df in frames.items():
        d = df.withColumn("run_id", F.lit(run_id))
        out = d if out is None else out.unionByName(d, allowMissingColumns=True)
    return out


def write_report(report: DataFrame, path: str, posthoc: DataFrame | None = None) -> None:
    """Test rows in F1..F8 order in one CSV file; post-hoc pairs beside it."""
    order = F.substring(F.col("test_id"), 2, 2).cast("int")
    (
        report.withColumn("test_no", order)
        .orderBy("test_no")
        .drop("test_no")
        .coalesce(1)  # eight rows
        .write.mode("overwrite")
        .option("header", True)
        .csv(os.path.join(path, "report"))
    )
    if posthoc is not None:
        posthoc.coalesce(1).write.mode("overwrite").option("header", True).csv(os.path.join(path, "posthoc"))


def write_prompts(prompts: DataFrame, path: str) -> None:
    """JSON lines; non-ASCII text is written as is."""
    prompts.write.mode("overwrite").json(path)


def write_split(scores: DataFrame, path: str, col: str = "scores") -> DataFrame:
    """Write good and bad rows in one pass, as ``status=good`` and ``status=bad``
    of one table, and return their counts (from the written files)."""
    flagged = scores.withColumn("status", F.when(_bad_flag(col), F.lit("bad")).otherwise(F.lit("good")))
    flagged.write.mode("overwrite").partitionBy("status").parquet(path)
    back = scores.sparkSession.read.schema(flagged.schema).parquet(path)
    return back.groupBy("status").agg(F.count(F.lit(1)).cast("bigint").alias("n"))


def _bad_flag(col: str) -> Column:
    x = F.col(col)
    bad = x.isNull() | (F.size(x) == 0) | F.exists(x, lambda v: F.isnan(v))
    return F.coalesce(bad, F.lit(True))


def split_bad(scores: DataFrame, col: str = "scores") -> tuple[DataFrame, DataFrame]:
    """(good, bad) rows; bad = NULL scores, empty vector or any NaN."""
    flagged = scores.withColumn("_bad", _bad_flag(col))
    return flagged.where(~F.col("_bad")).drop("_bad"), flagged.where(F.col("_bad")).drop("_bad")
