"""Prompt-set building (P1-P8) as Spark jobs over text tables.

Sentences are split with built-in regex functions (a marker is inserted after
each delimiter, then the text is split on the marker), sampled with md5
hash orders, and assembled with unions; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.parsers import BLANK, NON_BLANK, strip_ws
from ..operators.grid import hash_draw, shuffle_key

MARK = "\u0001"

# Sentence delimiters that stay with their sentence, per language.
KEEP_DELIMS = {"zh": "。！？；", "ja": "。！？", "ar": ".؟!،؛"}
# Latin-script rule (documented replacement for a sentence tokenizer):
# a sentence ends after . ! or ? followed by whitespace.
LATIN_RULE_LANGS = ("en", "pl")
CHAR_LENGTH_LANGS = ("zh", "ja")

# Prompt formats of the builders.
CODE_INSTRUCTION = "Explain what this code does:"


def _split_marked(marked: Column) -> Column:
    return F.split(marked, MARK)


def sentence_array(text, lang) -> Column:
    """Sentences of a text as an array (before dropping empty pieces).

    Newlines become blanks and the text is stripped first. zh/ja/ar keep the
    delimiter with the sentence and keep a trailing rest; en/pl split after
    [.!?] + whitespace; other languages split on '.', which is dropped.
    """
    t = strip_ws(F.translate(F.col(text) if isinstance(text, str) else text, "\n", " "))
    lg = F.col(lang) if isinstance(lang, str) else lang
    expr = None
    for code, delims in KEEP_DELIMS.items():
        arr = _split_marked(F.regexp_replace(t, f"([{delims}])", f"$1{MARK}"))
        expr = F.when(lg == code, arr) if expr is None else expr.when(lg == code, arr)
    latin = F.split(t, f"(?<=[.!?]){BLANK}+")
    expr = expr.when(lg.isin(*LATIN_RULE_LANGS), latin)
    return expr.otherwise(F.split(t, r"\."))


def split_sentences(df: DataFrame, text: str = "text", lang: str = "lang", keys=("doc_id",)) -> DataFrame:
    """One row per non-empty stripped sentence: keys, lang, sent_no, sentence."""
    # Pieces are stripped inside the array, so the filters below read a
    # generator output and never re-evaluate the regex; posexplode_outer,
    # because a plain posexplode makes Catalyst add a size(..) > 0 filter
    # that would split every text a second time.
    pieces = F.transform(sentence_array(text, lang), lambda x: strip_ws(x))
    exploded = df.select(*keys, lang, F.posexplode_outer(pieces).alias("sent_no", "sentence"))
    return exploded.where(F.col("sentence") != "")


def word_count(c) -> Column:
    """Whitespace-separated words (Python's ``len(s.split())``), one regex pass."""
    col = F.col(c) if isinstance(c, str) else c
    return F.regexp_count(col, F.lit(f"{NON_BLANK}+"))


def _within(x: Column, lo: int, hi: int) -> Column:
    """lo <= x <= hi with x evaluated once (``between`` expands to two comparisons)."""
    return F.abs(x * 2 - (lo + hi)) <= (hi - lo)


def valid_sentence(sentence, lang, min_words: int = 5, max_words: int = 40, stripped: bool = True) -> Column:
    """zh/ja 6 to 150 characters; other languages 5 to 40 words
    (the English builder: min_words=1). Sentences of ``split_sentences`` are
    already stripped."""
    s = F.col(sentence) if isinstance(sentence, str) else sentence
    if not stripped:
        s = strip_ws(s)
    lg = F.col(lang) if isinstance(lang, str) else lang
    return (s != "") & F.when(lg.isin(*CHAR_LENGTH_LANGS), _within(F.length(s), 6, 150)).otherwise(
        _within(word_count(s), min_words, max_words)
    )


def quota_sample(
    sentences: DataFrame, group: str, quota: int, seed=42, doc: str = "doc_id", pos: str = "sent_no", strict: bool = False
) -> DataFrame:
    """P3 on a sentence table: ``quota`` sentences per group without replacement, in
    hash order over ALL sentences of the group (the reference stops reading at
    three times the quota; a prefix of the corpus would not be a sample of it).

    A group with fewer sentences than the quota keeps them all; with ``strict``
    (the English builder's behaviour) that is an error.
    """
    if strict:
        short = sentences.groupBy(group).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") < quota)
        row = short.agg(F.count(F.lit(1)).alias("k"), F.min(F.struct("n", group)).alias("least")).first()
        if row.k:
            raise ValueError(f"{row.k} groups have fewer than {quota} candidates; the least is {row.least[1]} with {row.least[0]}")
    return hash_draw(sentences, group, quota, seed, doc, pos)


def valid_sentences(docs: DataFrame, text: str = "text", lang: str = "lang", keys=("doc_id",)) -> DataFrame:
    """P1 + P2: the valid sentences of a document table."""
    return split_sentences(docs, text, lang, keys).where(valid_sentence("sentence", lang))


def quota_sample_docs(docs: DataFrame, quota: int, seed=42, lang: str = "lang", doc: str = "doc_id",
                      text: str = "text", strict: bool = False) -> DataFrame:
    """P3 straight from documents: drawn over the valid sentences of all of them."""
    return quota_sample(valid_sentences(docs, text, lang, (doc,)), lang, quota, seed, doc, "sent_no", strict)


def _sampled(df: DataFrame, n: int, seed, *keys: str) -> DataFrame:
    """``n`` rows in hash order of the keys."""
    drawn = hash_draw(df.withColumn("_all", F.lit(0)), "_all", n, seed, *keys)
    return drawn.select(*df.columns)


def snippet_prompts(
    pages: DataFrame, html: str = "html", key: str = "page_id", n: int | None = None,
    instruction: str = CODE_INSTRUCTION, min_words: int = 3, max_words: int = 30, seed=42,
) -> DataFrame:
    """First line of the first <p> block (else of the <title>), 3 to 30
    words, with an instruction line in front; all of them, or with ``n`` that many
    in hash order of the key (a sample, not a prefix)."""
    h = F.col(html)
    block = F.regexp_extract(h, r"(?s)<p[^>]*>(.*?)</p>", 1)
    title = F.regexp_extract(h, r"(?s)<title[^>]*>(.*?)</title>", 1)
    src = F.when(block != "", block).otherwise(title)
    snippet = strip_ws(F.substring_index(strip_ws(src), "\n", 1))
    out = pages.select(key, snippet.alias("snippet")).where(
        (F.col("snippet") != "") & _within(word_count("snippet"), min_words, max_words)
    )
    out = out.select(key, F.concat(F.lit(instruction + "\n"), F.col("snippet")).alias("prompt"))
    return out if n is None else _sampled(out, n, seed, key)


def qa_prompts(conv: DataFrame, n: int | None = None, min_words: int = 5, seed=42) -> DataFrame:
    """P5: a user turn of more than 4 words followed by an assistant turn ->
    'question (Answer: answer)'; all of them, or with ``n`` that many in hash order.

    The next turn is found by an equi-join on (conv_id, turn + 1), which
    cannot skew the way a window over a long conversation could.
    """
    q = conv.where(F.col("role") == "user").select(
        "conv_id", "turn", strip_ws("text").alias("q")
    )
    a = conv.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), strip_ws("text").alias("a")
    )
    j = q.join(a, ["conv_id", "turn"]).where(
        (F.col("q") != "") & (F.col("a") != "") & (word_count("q") >= min_words)
    )
    out = j.select("conv_id", "turn", F.concat(F.col("q"), F.lit(" (Answer: "), F.col("a"), F.lit(")")).alias("prompt"))
    return out if n is None else _sampled(out, n, seed, "conv_id", "turn")


# --- P6: neutral prompt categories ---------------------------------------------

CATEGORIES = ("empty", "random", "explicit", "neutral", "nonsense")


def neutral_set(items: DataFrame, templates: DataFrame, key: str = "item_id", text: str = "text", seed=42) -> DataFrame:
    """Five prompts per item, one for each category.

    * ``empty``: the empty prompt;
    * ``random``: the characters of the item in a seeded order;
    * ``explicit`` and ``neutral``: the caller's ``templates`` (category, slot, text), taken
      in a cycle: the item's number modulo the category's number of templates;
    * ``nonsense``: the words of the item in a seeded order.

    The orders are md5 of (seed, category, item, position), so the set can be
    repeated in any engine. A NULL item text counts as empty; a category
    without templates yields no prompts.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    k = F.col(key).cast("string")

    def shuffled(category: str, parts: Column, glue: str) -> Column:
        order = F.transform(
            parts,
            lambda x, i: F.struct(F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(category), k, i.cast("string"))).alias("h"), x.alias("x")),
        )
        return F.array_join(F.transform(F.sort_array(order), lambda s: s["x"]), glue)

    chars = F.filter(F.split(t, ""), lambda x: x != "")
    words = F.filter(F.split(t, f"{BLANK}+"), lambda x: x != "")
    own = items.select(
        key,
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(c).alias("domain"), v.alias("prompt"))
                    for c, v in (("empty", F.lit("")), ("random", shuffled("random", chars, "")), ("nonsense", shuffled("nonsense", words, " ")))
                ]
            )
        ),
    )
    cycle = templates.select(F.col("category").alias("domain"), "slot", F.col("text").alias("prompt"))
    size = cycle.groupBy("domain").agg(F.count(F.lit(1)).alias("n"))  # one row per category
    slots = items.select(key, F.explode(F.array(F.lit("explicit"), F.lit("neutral"))).alias("domain")).join(size, "domain")
    taken = slots.withColumn("slot", F.pmod(F.col(key), F.col("n"))).join(cycle, ["domain", "slot"])
    return own.unionByName(taken.select(key, "domain", "prompt"))


def prompt_length(prompt, lang=None) -> Column:
    """0 for blank prompts, characters for zh/ja, else words."""
    p = F.col(prompt) if isinstance(prompt, str) else prompt
    words = F.when(strip_ws(p) == "", F.lit(0)).otherwise(word_count(p))
    if lang is None:
        return words.cast("bigint")
    lg = F.col(lang) if isinstance(lang, str) else lang
    return F.when(lg.isin(*CHAR_LENGTH_LANGS), F.length(p)).otherwise(words).cast("bigint")


def assemble(sets: dict[str, DataFrame], seed=42, key: str = "prompt_key") -> DataFrame:
    """Union of prompt sets (prompt, domain, lang, key) with a length
    column and a seeded shuffle order."""
    from .ordinal import global_ordinal

    out = None
    for name, df in sets.items():
        d = df.select(
            F.lit(name).alias("prompt_set"),
            "prompt",
            "domain",
            (F.col("lang") if "lang" in df.columns else F.lit(None).cast("string")).alias("lang"),
            F.col(key).cast("string").alias(key),
        )
        out = d if out is None else out.unionByName(d)
    out = out.withColumn("len", prompt_length("prompt", "lang"))
    keyed = out.withColumn("_h", shuffle_key(seed, "prompt_set", key, "domain"))
    return global_ordinal(keyed, ["_h", "prompt_set", key, "domain"], name="shuffle_pos").drop("_h")


def length_band(df: DataFrame, prompt: str = "prompt", center: int = 16, width: int = 4) -> DataFrame:
    """Prompts of center +- width words."""
    return df.where(_within(word_count(prompt), center - width, center + width))
