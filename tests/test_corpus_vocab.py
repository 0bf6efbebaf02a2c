"""Sentence splitting, prompt builders, script classes and vocabulary usage."""

import pytest


from concentra.operators import corpus as cp
from concentra.operators import vocab as vb


def test_sentences_keep_cjk_arabic_delimiters(spark):
    rows = [
        (1, "zh", "今天天气很好。我们去公园！好吗？还有"),
        (2, "ja", "これはペンです。あれは本です！"),
        (3, "ar", "مرحبا بكم. كيف حالكم؟ شكرا"),
        (4, "en", "First one. Second one!  Third?"),
        (5, "fr", "Une phrase. Deux phrases.  "),
    ]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    got = {}
    for r in cp.split_sentences(df).orderBy("doc_id", "sent_no").collect():
        got.setdefault(r.doc_id, []).append(r.sentence)
    assert got[1] == ["今天天气很好。", "我们去公园！", "好吗？", "还有"]
    assert got[2] == ["これはペンです。", "あれは本です！"]
    assert got[3] == ["مرحبا بكم.", "كيف حالكم؟", "شكرا"]
    assert got[4] == ["First one.", "Second one!", "Third?"]
    assert got[5] == ["Une phrase", "Deux phrases"]


def test_valid_sentence_rules(spark):
    rows = [("zh", "短句"), ("zh", "这是一个足够长的句子"), ("en", "one two three four"), ("en", "one two three four five")]
    df = spark.createDataFrame(rows, "lang string, sentence string")
    got = [r.ok for r in df.select(cp.valid_sentence("sentence", "lang").alias("ok")).collect()]
    assert got == [False, True, False, True]


def test_qa_format_and_min_words(spark):
    rows = [(1, 0, "user", "What is the capital of France?"), (1, 1, "assistant", "Paris"),
            (2, 0, "user", "Too short?"), (2, 1, "assistant", "Yes")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = [r.prompt for r in cp.qa_prompts(df).collect()]
    assert got == ["What is the capital of France? (Answer: Paris)"]


def test_neutral_set(spark):
    items = spark.createDataFrame([(0, "red green blue"), (1, None), (5, "a b")], "item_id long, text string")
    templates = spark.createDataFrame(
        [("explicit", 0, "Say something."), ("explicit", 1, "Go."), ("neutral", 0, "So")], "category string, slot long, text string"
    )
    rows = cp.neutral_set(items, templates).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, cp.neutral_set(items, templates).collect()))
    got = {(r.item_id, r.domain): r.prompt for r in rows}
    assert len(rows) == 15 and {d for _, d in got} == set(cp.CATEGORIES)
    assert sorted(got[0, "random"]) == sorted("red green blue")
    assert sorted(got[0, "nonsense"].split()) == ["blue", "green", "red"]
    assert [got[1, d] for d in ("random", "nonsense", "empty")] == ["", "", ""]
    assert [got[i, "explicit"] for i in (0, 1, 5)] == ["Say something.", "Go.", "Go."]
    assert got[5, "neutral"] == "So"


@pytest.mark.parametrize(
    "token,script",
    [
        ("hello", "latin"), ("zażółć", "latin"), ("مرحبا", "arabic"), ("中文", "cjk"), ("ひらがな", "hiragana"),
        ("カタカナ", "katakana"), ("привет", "cyrillic"), ("123", "shared"), ("😀", "shared"), (" ", "control"),
        ("ªb", "other"),  # tie: the script seen first wins
    ],
)
def test_token_script(spark, token, script):
    df = spark.createDataFrame([(token,)], "token string")
    assert vb.token_scripts(df).first().script == script


def test_topk_share_histogram_equals_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    counts = rng.zipf(1.5, 3000).clip(max=500)
    rows = [("xx", f"t{i}", int(c)) for i, c in enumerate(counts)]
    df = spark.createDataFrame(rows, "language string, token string, cnt long")
    got = vb.topk_share(df, ks=(10, 100, 5000)).first()
    s = np.sort(counts)[::-1]
    assert got.share_top_10 == pytest.approx(s[:10].sum() / s.sum())
    assert got.share_top_100 == pytest.approx(s[:100].sum() / s.sum())
    assert got.share_top_5000 == pytest.approx(1.0)


def test_empty_source_gives_no_snippets(spark):
    empty = spark.createDataFrame([(1, "<html><body>no paragraph</body></html>")], "page_id long, html string")
    assert cp.snippet_prompts(empty).collect() == []
    assert cp.snippet_prompts(empty, n=3).collect() == []


@pytest.mark.parametrize("quota", [3, 334, 1001, 5000])
def test_draw_is_the_hash_order_at_any_size(spark, quota):
    import hashlib

    from concentra.operators.grid import hash_draw

    rows = [("a" if i % 3 else "b", i) for i in range(4000)] + [(None, i) for i in range(5)]
    df = spark.createDataFrame(rows, "g string, i long")
    got = {}
    for r in hash_draw(df, "g", quota, 42, "i").collect():
        got.setdefault(r.g, []).append((r.draw, r.i))
    for g in ("a", "b", None):
        order = sorted((i for h, i in rows if h == g), key=lambda i: (hashlib.md5(f"42|{i}".encode()).hexdigest(), i))
        assert [i for _, i in sorted(got[g])] == order[:quota]
        assert [d for d, _ in sorted(got[g])] == list(range(1, len(order[:quota]) + 1))


def test_unicode_blanks(spark):
    df = spark.createDataFrame([(1, "zh", "\u3000今天天气很好。\u3000我们。"), (2, "en", "one\u00a0two three\u2003four five six.\u00a0Next one.")], "doc_id long, lang string, text string")
    got = [r.sentence for r in cp.split_sentences(df).orderBy("doc_id", "sent_no").collect()]
    assert got == ["今天天气很好。", "我们。", "one\u00a0two three\u2003four five six.", "Next one."]
    words = spark.createDataFrame([("a\u00a0b\u3000c d",)], "s string").select(cp.word_count("s").alias("n")).first().n
    assert words == len("a\u00a0b\u3000c d".split()) == 4


def test_quota_strict_raises_when_short(spark):
    rows = [(1, "en", "One two three four five. Six seven eight nine ten.")]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    assert cp.quota_sample_docs(df, 5).count() == 2  # fewer than the quota: all kept
    with pytest.raises(ValueError):
        cp.quota_sample_docs(df, 5, strict=True)
