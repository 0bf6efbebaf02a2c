"""Counting inside the rows: what has one row per key is not shuffled by its words."""

import io
from collections import Counter
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

from concentra.functions.parsers import BLANK_CHARS, lower_words
from concentra.operators import effects as ef
from concentra.operators.reduce import item_counts

TEXTS = [
    (1, "en", "a", "the cat The  dog\ncat"),
    (2, "en", "a", ""),
    (3, "en", "b", None),
    (4, "de", "a", "\u3000\u00c4pfel\u00a0\u00e4pfel\tx "),
    (4, "de", "a", "x y"),
    (5, None, "a", "one"),
    (None, "en", "a", "p q"),
    (None, "en", "a", "p"),
]
SCHEMA = "doc_id long, lang string, source string, text string"


def _plan(df) -> str:
    buf = io.StringIO()
    with redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def _brute(rows):
    n = Counter()
    for doc_id, lang, source, text in rows:
        for w in (text or "").lower().split():
            n[doc_id, lang, source, w] += 1
    return sorted(((*k, c) for k, c in n.items()), key=str)


def test_words_of_ascii_and_other_texts(spark):
    texts = ["".join(f"A{i}{c}" for i, c in enumerate(BLANK_CHARS)), "".join(f"B{c}{c}" for c in BLANK_CHARS if c < "\x80"), " ", "", "x", "\u00e9 \u2003x\x1f"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", lower_words("t").alias("w")).collect()
    assert {r.i: r.w for r in got} == {i: t.lower().split() for i, t in enumerate(texts)}


@pytest.mark.parametrize("rows", [TEXTS, TEXTS[:4], []])
def test_counts_with_repeated_null_and_single_keys(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    got = item_counts(docs, ["doc_id", "lang", "source"], lower_words("text"), item="token").collect()
    assert sorted(((r.doc_id, r.lang, r.source, r.token, r.cnt) for r in got), key=str) == _brute(rows)
    alone = item_counts(docs, ["doc_id", "lang", "source"], lower_words("text"), item=None).collect()
    assert sorted(((r.doc_id, r.lang, r.source, r.cnt) for r in alone), key=str) == sorted(((*k[:3], k[4]) for k in _brute(rows)), key=str)


def test_single_documents_are_counted_without_a_shuffle(spark):
    docs = spark.createDataFrame(TEXTS[:4], SCHEMA)
    assert "Exchange" not in _plan(item_counts(docs, ["doc_id"], lower_words("text"), item=None))


def test_residuals_evaluate_their_input_once(spark):
    df = spark.range(40).select((F.col("id") % 7).alias("g"), (F.col("id") % 5).cast("double").alias("y")).groupBy("g").agg(F.sum("y").alias("y"), F.count("y").alias("x"))
    out = ef.residualize(df, "y", "x")
    assert "Exchange" not in _plan(out) and out.count() == 7
