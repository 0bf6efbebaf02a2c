import pytest
"""Sources and sinks: prompt lines, bundles, run tables, reports."""

import os

from pyspark.sql import functions as F

from concentra.operators import stats as st
from concentra.sources import io
from concentra.sources.fixtures import runs_vec

from conftest import SF_SMALL


def _lines(spark, lines):
    return spark.createDataFrame([(x,) for x in lines], "value string")


def test_prompt_lines_json_text_blank_malformed(spark):
    lines = [
        '{"domain": "wiki", "prompt": "The cat sat"}',
        "   plain prompt with blanks   ",
        "",
        "   ",
        "{bad json",
        '{"prompt": "no domain here"}',
    ]
    got = [r.prompt for r in io.parse_prompt_lines(_lines(spark, lines)).collect()]
    assert got == ["wiki: The cat sat", "plain prompt with blanks"]
    keep = [r.prompt for r in io.parse_prompt_lines(_lines(spark, lines), keep_undomained=True).collect()]
    assert keep == ["wiki: The cat sat", "plain prompt with blanks", "no domain here"]


def test_read_prompts_from_file(spark, tmp_path):
    p = tmp_path / "prompts.jsonl"
    p.write_text('{"domain": "news", "prompt": "Héllo wörld"}\n\nline two\n', encoding="utf-8")
    got = [r.prompt for r in io.read_prompts(spark, str(p)).collect()]
    assert got == ["news: Héllo wörld", "line two"]


def test_bundles_merge_in_number_order(spark):
    rows = [(g, p, [float(g), float(p)]) for g in range(6) for p in range(2)]
    df = spark.createDataFrame(rows, "gen_id long, pos int, scores array<double>")
    path = io.scratch_dir(spark, "t-bundles")
    # bundle 10 holds the first generations, bundle 5 the later ones: order follows the number
    io.write_bundles(df, path, F.when(F.col("gen_id") < 3, 10).otherwise(5))
    merged = io.merge_bundles(io.read_scores(spark, path)).orderBy("merged_pos").collect()
    assert [r.bundle_id for r in merged[:6]] == [5] * 6
    assert [r.merged_pos for r in merged] == list(range(12))
    assert merged[0].gen_id == 3


def test_unnumbered_bundle_goes_last(spark):
    rows = [(1, 0, [1.0], 7), (2, 0, [1.0], None)]
    df = spark.createDataFrame(rows, "gen_id long, pos int, scores array<double>, bundle_id long")
    got = io.merge_bundles(df).orderBy("merged_pos").collect()
    assert [r.gen_id for r in got] == [1, 2]


def test_csv_round_trip_keeps_newlines_quotes_blanks(spark):
    rows = [('line one\nline "two"  ', 1.0, 3), ("  lead", 0.7, 5)]
    df = spark.createDataFrame(rows, "prompt string, temp double, seq_len long")
    path = io.scratch_dir(spark, "t-csv")
    assert io.append_runs(df, path, fmt="csv", partition_by=None)
    assert not io.append_runs(df.where(F.lit(False)), path, fmt="csv", partition_by=None)
    back = io.read_runs(spark, path, fmt="csv").orderBy("seq_len").collect()
    assert [r.prompt for r in back] == [rows[0][0], rows[1][0]]


def test_split_bad(spark):
    rows = [([1.0, 2.0],), ([],), (None,), ([1.0, float("nan")],)]
    good, bad = io.split_bad(spark.createDataFrame(rows, "scores array<double>"))
    assert good.count() == 1 and bad.count() == 3


def test_report_and_posthoc_files(spark):
    runs = runs_vec(spark, SF_SMALL)
    path = io.scratch_dir(spark, "t-report")
    io.write_report(st.battery(runs), path, st.tukey_hsd(runs))
    rep = spark.read.option("header", True).csv(os.path.join(path, "report")).collect()
    assert [r.test_id for r in rep] == [f"F{i}" for i in range(1, 9)]
    assert spark.read.option("header", True).csv(os.path.join(path, "posthoc")).count() == 3


def test_write_split_reports_counts(spark):
    rows = [([1.0, 2.0],), ([],), ([float("nan")],)]
    base = io.scratch_dir(spark, "t-split")
    counts = {r.status: r.n for r in io.write_split(spark.createDataFrame(rows, "scores array<double>"),
                                                     base).collect()}
    assert counts == {"good": 1, "bad": 2}
    assert spark.read.parquet(base + "/status=bad").count() == 2


def test_write_merged_files_are_in_order(spark):
    import pandas as pd

    rows = [(g, p, [float(g)]) for g in range(40) for p in range(3)]
    df = spark.createDataFrame(rows, "gen_id long, pos int, scores array<double>")
    path = io.scratch_dir(spark, "t-merged")
    io.write_bundles(df, path + "_b", F.floor(F.col("gen_id") / 7))
    io.write_merged(io.read_scores(spark, path + "_b"), path)
    # reading the part files one after another gives the merged order
    import glob

    local = path[len("file:"):] if path.startswith("file:") else path
    parts = sorted(glob.glob(local + "/part-*.parquet"))
    assert len(parts) >= 1
    pos = pd.concat([pd.read_parquet(p, columns=["merged_pos"]) for p in parts])["merged_pos"].tolist()
    assert pos == list(range(len(rows)))


def test_bundles_as_folders_are_numbered_by_the_folder(spark):
    base = io.scratch_dir(spark, "t-a4")
    for n in (5, 12):
        spark.range(n, numPartitions=2).selectExpr("id as gen_id", "0 as pos", "array(1.0, 2.0) as scores").write.parquet(f"{base}/x_chkpt_{n}.pt")
    got = {r.bundle_id: r["count"] for r in io.read_scores(spark, f"{base}/x_chkpt_*.pt").groupBy("bundle_id").count().collect()}
    assert got == {5: 5, 12: 12}


def test_bad_bundle_files_are_listed(spark):
    base = io.scratch_dir(spark, "t-bad")
    spark.range(4, numPartitions=1).selectExpr("id as gen_id", "array(1.0) as scores").write.parquet(f"{base}/x_chkpt_1.pt")
    local = base.removeprefix("file:") + "/x_chkpt_2.pt"
    os.makedirs(local)
    with open(f"{local}/part-0.parquet", "wb") as f:
        f.write(b"PAR1 this is no parquet file PAR1")
    bad = io.bad_files(spark, base).collect()
    assert [os.path.basename(r.path) for r in bad] == ["part-0.parquet"]
    good = io.read_scores(spark, f"{base}/x_chkpt_*.pt", skip_bad=True)
    assert [r.bundle_id for r in good.select("bundle_id").distinct().collect()] == [1]


def test_json_line_with_a_rest_is_dropped(spark):
    lines = ['{"domain":"a","prompt":"b"}', '{"domain":"a","prompt":"b"} trailing', '{"domain":"a","prompt":"b"}} x', '{"domain":"a","prompt":"b"}] x',
             '{"domain":"a","prompt":"b"},{"domain":"c","prompt":"d"}', '\u3000plain\u00a0']
    got = [r.prompt for r in io.parse_prompt_lines(spark.createDataFrame([(x,) for x in lines], "value string")).collect()]
    assert got == ["a: b", "plain"]


def test_long_bundle_number_is_null(spark):
    from concentra.functions import parsers as ps

    df = spark.createDataFrame([("x_chkpt_12345678901234567890.pt",), ("x_chkpt_7.pt",)], "p string")
    assert [r.b for r in df.select(ps.bundle_index("p").alias("b")).collect()] == [None, 7]


def test_shared_folder_must_be_named_on_a_cluster():
    from concentra.session import shared_dir

    class Context:
        master, applicationId = "spark://host:7077", "x"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(key, default=None):
                return default

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(Session())
