"""The token-count table of the language summary and its consumers."""

import io
from contextlib import redirect_stdout

from concentra.operators import vocab as vb

SCHEMA = "doc_id long, lang string, source string, text string"


def _plan(df) -> str:
    buf = io.StringIO()
    with redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def test_single_documents_are_tokenised_without_a_shuffle(spark):
    docs = spark.createDataFrame([(1, "en", "a", "the cat the"), (2, "de", "a", None)], SCHEMA)
    counts = vb.doc_token_counts(docs)
    assert "Exchange" not in _plan(counts)
    assert {tuple(r) for r in counts.collect()} == {(1, "en", "a", "the", 2), (1, "en", "a", "cat", 1)}


def test_first_copies_are_marked_by_id(spark):
    rows = [(1, "en", "a", "t u"), (2, "en", "a", "t u"), (3, "de", "a", "t u"), (None, "fr", "a", "z")]
    docs = spark.createDataFrame(rows, SCHEMA)
    marked = vb.mark_first_copies(docs, vb.first_copies(docs))
    assert {r.doc_id: r.first for r in marked.collect()} == {1: True, 2: False, 3: True, None: False}
    got = vb.distinct_prompt_token_counts(vb.doc_token_counts(marked, extra=("source", "first"))).collect()
    assert {(r.language, r.token): r.cnt for r in got} == {("en", "t"): 1, ("en", "u"): 1, ("de", "t"): 1, ("de", "u"): 1, ("fr", "z"): 0}


def test_allocation_counts_no_pairs_of_language_and_token(spark):
    vocab = spark.createDataFrame([("abc",), ("12",), ("x1",), ("",), (None,)], "token string")
    scripts = vb.token_scripts(vocab)
    got = vb.allocated_vocab(scripts, ["en", "ja"])
    assert {r.language: r.vocab_allocated for r in got.collect()} == {"en": 3, "ja": 1}
    assert "Expand" not in _plan(got) and "language#" not in "".join(x for x in _plan(got).splitlines() if "hashpartitioning" in x and "token" in x)
