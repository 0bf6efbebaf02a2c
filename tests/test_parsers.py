"""Parsers of run attributes, by tables of examples."""

import pytest
from pyspark.sql import functions as F

from concentra.functions import parsers as ps


def _one(spark, expr, value):
    return spark.createDataFrame([(value,)], "s string").select(expr(F.col("s")).alias("r")).first().r


@pytest.mark.parametrize(
    "path,label",
    [
        ("/models/Llama-3.3-70B-Instruct-Q4_K_M.gguf", "Llama-3.3-70B-Instruct"),
        ("gemma-2-27b-it_Q8_0.gguf", "gemma-2-27b-it"),
        ("plain-model.gguf", "plain-model"),
        ("dir/no_suffix", "no_suffix"),
    ],
)
def test_model_label(spark, path, label):
    assert _one(spark, ps.model_label, path) == label


@pytest.mark.parametrize(
    "name,size",
    [
        ("Llama-3.3-70B-Instruct", 70_000_000_000),
        ("mamba2-2.7b", 2_700_000_000),
        ("Qwen2.5-32B", 32_000_000_000),  # the first '<number> b' wins: 2.5 is not followed by b
        ("phi3base", 3_000_000_000),  # any digit followed by b counts
        ("model", None),
        ("x 7 B", 7_000_000_000),
    ],
)
def test_model_size(spark, name, size):
    assert _one(spark, ps.model_size, name) == size


@pytest.mark.parametrize(
    "prompt,domain",
    [
        ("wiki: The cat", "wiki"),
        ("  news :  text: more", "news"),
        ("empty: ", "empty"),
        ("no colon here", None),
        (": leading colon", None),
    ],
)
def test_domain(spark, prompt, domain):
    assert _one(spark, ps.domain_of, prompt) == domain


@pytest.mark.parametrize(
    "path,anchored,loose",
    [
        ("out/logits_x_chkpt_20.pt", 20, 20),
        ("out/logits_x_chkpt_5.pt.bak", None, 5),
        ("out/logits_x.pt", None, None),
        ("a_chkpt_1_chkpt_2.pt", 2, None),
        ("dir_chkpt_3/file.pt", None, None),
    ],
)
def test_bundle_index(spark, path, anchored, loose):
    assert _one(spark, ps.bundle_index, path) == anchored
    assert _one(spark, ps.bundle_index_loose, path) == loose


def test_strip_prefix_and_language(spark):
    df = spark.createDataFrame(
        [
            ("wiki_pl: wiki_pl: Zdanie.", "pl"),
            ("wiki_pl: Zdanie.", "pl"),
            ("wiki: wiki: Sentence.", "en"),
            ("wiki: Sentence.", "en"),
            ("news: Sentence.", "en"),
        ],
        "p string, lang string",
    )
    got = [r.s for r in df.select(ps.strip_prefix("p", "lang").alias("s")).collect()]
    assert got == ["Zdanie.", "Zdanie.", "Sentence.", "Sentence.", "news: Sentence."]
    lang = df.select(ps.language_of(F.lit("wiki_ja")).alias("l")).first().l
    assert lang == "ja"


def test_model_size_falls_back_to_path(spark):
    df = spark.createDataFrame([("custom-model", "/models/x-13b/custom-model.bin"), ("m-7b", "/p/70b/m.bin")], "l string, p string")
    got = [r.s for r in df.select(ps.model_size_or_path(F.col("l"), F.col("p")).alias("s")).collect()]
    assert got == [13_000_000_000, 7_000_000_000]
