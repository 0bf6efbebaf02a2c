"""Vocabulary usage per language (G1-G11), on word tokens of the documents.

No tokenizer can be loaded offline, so a token is a lower-cased
whitespace-separated word and the vocabulary is the set of distinct words;
every ratio below is defined for that tokenisation.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.parsers import lower_words
from .ordinal import materialize
from .ranks import pair_ranks
from .reduce import item_counts

# Script classes and code-point ranges (checked in this order
# after the Unicode category tests; first match wins).
SCRIPT_RANGES = [
    ("arabic", [(0x0600, 0x06FF), (0x0750, 0x077F), (0x08A0, 0x08FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)]),
    (
        "cjk",
        [
            (0x4E00, 0x9FFF), (0x3400, 0x4DBF), (0x20000, 0x2A6DF), (0x2A700, 0x2B73F),
            (0x2B740, 0x2B81F), (0xF900, 0xFAFF), (0x2F800, 0x2FA1F),
        ],
    ),
    ("hiragana", [(0x3040, 0x309F)]),
    ("katakana", [(0x30A0, 0x30FF)]),
    (
        "latin",
        [
            (0x0041, 0x005A), (0x0061, 0x007A), (0x00C0, 0x024F), (0x1E00, 0x1EFF),
            (0x2C60, 0x2C7F), (0xA720, 0xA7FF),
        ],
    ),
    ("cyrillic", [(0x0400, 0x052F)]),
    ("greek", [(0x0370, 0x03FF)]),
    ("hangul", [(0x1100, 0x11FF), (0xAC00, 0xD7AF)]),
    ("devanagari", [(0x0900, 0x097F)]),
    ("thai", [(0x0E00, 0x0E7F)]),
]

# Which languages may use tokens of a script. 'shared' and
# 'control' serve every language; scripts not listed serve none.
SCRIPT_LANGS = {
    "latin": ["en", "fr", "de", "es", "pl"],
    "arabic": ["ar"],
    "cjk": ["zh", "ja"],
    "hiragana": ["ja"],
    "katakana": ["ja"],
}
ALL_SCRIPTS_LANGS = ["shared", "control"]

# Letters with diacritics that mark a language inside Latin tokens.
MARKS = {
    "pl": "ąćęłńóśźżĄĆĘŁŃÓŚŹŻ",
    "fr": "àâæçéèêëîïôœùûüÿÀÂÆÇÉÈÊËÎÏÔŒÙÛÜŸ",
    "de": "äöüßÄÖÜ",
    "es": "áéíñóúüÁÉÍÑÓÚÜ¿¡",
}


def _class(ranges) -> str:
    return "".join(f"\\x{{{lo:04X}}}-\\x{{{hi:04X}}}" for lo, hi in ranges)


def char_script(ch) -> Column:
    """G1: script class of one character (a one-character string column)."""
    c = F.col(ch) if isinstance(ch, str) else ch
    # fast path: ASCII letters are never separators, controls, punctuation,
    # symbols or numbers, so they can be decided before the regex chain
    ascii_letter = (F.length(c) == 1) & (
        ((c >= F.lit("a")) & (c <= F.lit("z"))) | ((c >= F.lit("A")) & (c <= F.lit("Z")))
    )
    expr = (
        F.when(ascii_letter, F.lit("latin"))
        .when(c.rlike(r"^[\p{Z}\p{C}]$"), F.lit("control"))
        .when(c.rlike(r"^[\p{P}\p{S}\p{N}]$"), F.lit("shared"))
    )
    for name, ranges in SCRIPT_RANGES:
        expr = expr.when(c.rlike(f"^[{_class(ranges)}]$"), F.lit(name))
    return expr.otherwise(F.lit("other"))


def token_scripts(vocab: DataFrame, token: str = "token") -> DataFrame:
    """Dominant script per token (ties: the script seen first; '' -> 'empty').

    Characters are exploded and classified (ASCII letters on a fast path),
    counted per (token, script) and reduced with ``max_by`` over
    (count, -first position): two code-generated aggregations. (A row-local
    version with ``transform``/``filter`` lambdas measured slower: lambdas
    are interpreted.) ``vocab`` holds each token once.
    """
    # tokens of ASCII letters alone (the fast path of char_script) are not taken apart
    plain = F.col(token).rlike("^[A-Za-z]+$")
    latin = vocab.where(plain).select(token, F.lit("latin").alias("script"))
    chars = vocab.where(~plain).select(token, F.posexplode_outer(F.split(F.col(token), "")).alias("pos", "ch")).where(
        F.col("ch") != ""
    )
    per = chars.groupBy(token, char_script("ch").alias("script")).agg(
        F.count(F.lit(1)).alias("n"), F.min("pos").alias("first")
    )
    best = per.groupBy(token).agg(
        F.max_by("script", F.struct(F.col("n"), (-F.col("first")).alias("nf"))).alias("script")
    )
    empty = vocab.where(F.col(token) == "").select(token, F.lit("empty").alias("script"))
    return best.unionByName(latin).unionByName(empty)


def script_shares(scripts: DataFrame) -> DataFrame:
    """Tokens per script and percent of the vocabulary (a handful of rows)."""
    counts = scripts.groupBy("script").agg(F.count(F.lit(1)).cast("bigint").alias("n_tokens"))
    total = F.sum("n_tokens").over(Window.partitionBy())  # one row per script class
    return counts.withColumn("pct", F.col("n_tokens") * 100.0 / total)


def _script_lang_table(spark, languages: Sequence[str]) -> DataFrame:
    rows = []
    for script, langs in SCRIPT_LANGS.items():
        rows += [(script, lang) for lang in langs if lang in languages]
    for script in ALL_SCRIPTS_LANGS:
        rows += [(script, lang) for lang in languages]
    return spark.createDataFrame(rows, "script string, language string")


def allocated_vocab(scripts: DataFrame, languages: Sequence[str]) -> DataFrame:
    """Tokens a language may use (its scripts plus shared and control). ``scripts``
    holds each token once, so the tokens are counted per script and the counts added up."""
    m = _script_lang_table(scripts.sparkSession, languages)  # fixed small table
    counts = scripts.groupBy("script").agg(F.count("token").alias("n"))
    return counts.join(F.broadcast(m), "script").groupBy("language").agg(F.sum("n").cast("bigint").alias("vocab_allocated"))


def marked_tokens(scripts: DataFrame, marks: dict[str, str] = MARKS) -> DataFrame:
    """Latin tokens holding a diacritic of the language."""
    latin = scripts.where(F.col("script") == "latin")
    one = latin.agg(*[F.count_if(F.col("token").rlike(f"[{chars}]")).cast("bigint").alias(lang) for lang, chars in marks.items()])
    rows = [F.struct(F.lit(lang).alias("language"), F.col(lang).alias("n_marked")) for lang in marks]
    return one.select(F.inline(F.array(*rows)))


def prompt_tokens(prompts: DataFrame, text: str = "text") -> Column:
    return lower_words(text)


def usage(prompts: DataFrame, lang: str = "lang", text: str = "text") -> DataFrame:
    """Over distinct prompts per language: distinct tokens, mean tokens per
    prompt, mean fertility (tokens / characters, non-empty prompts)."""
    # equal texts are found by their hash; the text is no shuffle key
    d = prompts.select(F.col(lang).alias("language"), F.col(text).alias("text"), F.md5(F.col(text)).alias("text_md5"))
    d = d.dropDuplicates(["language", "text_md5"])
    per = d.select("language", F.size(prompt_tokens(d, "text")).alias("n_tok"), F.length("text").alias("n_chr"))
    stats = per.groupBy("language").agg(
        F.avg("n_tok").alias("mean_prompt_tokens"),
        F.avg(F.when(F.col("n_chr") > 0, F.col("n_tok") / F.col("n_chr"))).alias("mean_fertility"),
        F.count(F.lit(1)).cast("bigint").alias("n_prompts"),
    )
    used = (
        d.select("language", F.explode_outer(prompt_tokens(d, "text")).alias("token"))
        .where(F.col("token").isNotNull())
        .groupBy("language")
        .agg(F.countDistinct("token").cast("bigint").alias("vocab_used"))
    )
    return stats.join(used, "language", "left")


def doc_token_counts(docs: DataFrame, lang: str = "lang", text: str = "text", key: str = "doc_id",
                     extra: Sequence[str] = ("source",)) -> DataFrame:
    """One tokenisation pass: (key, language, extra..., token, cnt).

    Top-k shares, the vocabulary and the per-document metric all read this table.
    A document is counted inside its row (``reduce.item_counts``), no token moves.
    """
    rows = docs.select(key, F.col(lang).alias("language"), *extra, F.col(text).alias("_text"))
    return item_counts(rows, [key, "language", *extra], prompt_tokens(rows, "_text"), item="token")


def first_copies(docs: DataFrame, lang: str = "lang", text: str = "text", key: str = "doc_id") -> DataFrame:
    """One document id per distinct (language, text): copies of a prompt count once."""
    return (
        docs.select(key, F.col(lang).alias("language"), F.md5(F.col(text)).alias("text_md5"))
        .groupBy("language", "text_md5")
        .agg(F.min(key).alias(key))
        .select(key)
    )


def mark_first_copies(docs: DataFrame, firsts: DataFrame, key: str = "doc_id", name: str = "first") -> DataFrame:
    """``docs`` with ``name``: whether the document is in ``firsts`` (see ``first_copies``). The join is
    with the other documents' ids, the copies, and comes before any text is split."""
    copies = docs.select(key).distinct().join(firsts, key, "left_anti")
    copies = materialize(copies.select(key, F.lit(True).alias("_copy")), "copies")
    first = F.col(key).isNotNull() & F.col("_copy").isNull()
    return docs.join(copies, key, "left").select(*docs.columns, first.alias(name))


def usage_from_tokens(docs: DataFrame, token_counts: DataFrame, lang: str = "lang", text: str = "text") -> DataFrame:
    """G6 from a shared table of (language, token), each once: per-prompt sizes from one
    scan of the texts (no explode), distinct tokens from the table."""
    d = docs.select(
        F.col(lang).alias("language"),
        F.md5(F.col(text)).alias("text_md5"),
        F.when(F.col(text).isNotNull(), F.size(prompt_tokens(docs, text))).alias("n_tok"),
        F.length(F.col(text)).alias("n_chr"),
    ).dropDuplicates(["language", "text_md5"])
    stats = d.groupBy("language").agg(
        F.avg("n_tok").alias("mean_prompt_tokens"),
        F.avg(F.when(F.col("n_chr") > 0, F.col("n_tok") / F.col("n_chr"))).alias("mean_fertility"),
        F.count(F.lit(1)).cast("bigint").alias("n_prompts"),
    )
    used = token_counts.groupBy("language").agg(F.count("token").cast("bigint").alias("vocab_used"))
    return stats.join(used, "language", "left")


def distinct_prompt_token_counts(token_counts: DataFrame, first: str = "first") -> DataFrame:
    """(language, token, cnt) of every token, with its count over distinct prompts (the rows
    marked ``first``: copies of a text count once; 0 for a token of other rows only)."""
    return token_counts.groupBy("language", "token").agg(F.sum(F.when(F.col(first), F.col("cnt")).otherwise(0)).alias("cnt"))


def usage_approx(prompts: DataFrame, lang: str = "lang", text: str = "text", rsd: float = 0.02) -> DataFrame:
    """Distinct tokens per language from HyperLogLog++ sketches (over all
    texts: copies add no token)."""
    d = prompts.select(F.col(lang).alias("language"), F.explode_outer(prompt_tokens(prompts, text)).alias("token"))
    return d.where(F.col("token").isNotNull()).groupBy("language").agg(F.approx_count_distinct("token", rsd).cast("bigint").alias("vocab_used_approx"))


LG_K = 12  # 2^12 registers a sketch: a standard error of 1.04 / 64


def usage_sketches(prompts: DataFrame, by: Sequence[str], lang: str = "lang", text: str = "text", lg_k: int = LG_K) -> DataFrame:
    """G6a as a table that can be kept: ``by`` (e.g. the day), language and the sketch of
    its distinct tokens, a few KB however many tokens there were."""
    d = prompts.select(*by, F.col(lang).alias("language"), F.explode_outer(prompt_tokens(prompts, text)).alias("token"))
    return d.where(F.col("token").isNotNull()).groupBy(*by, "language").agg(F.hll_sketch_agg("token", F.lit(lg_k)).alias("sketch"))


def store_sketches(sketches: DataFrame, path: str, by: Sequence[str]) -> None:
    """Keep sketches as one folder per value of ``by``; what is stored again for a value
    replaces it, so a repeated delivery counts once."""
    sketches.write.option("partitionOverwriteMode", "dynamic").partitionBy(*by).mode("overwrite").parquet(path)


def merged_usage(sketches: DataFrame, by: Sequence[str] = ("language",)) -> DataFrame:
    """Distinct tokens per ``by`` over all given sketches (select days before): their union,
    which is the sketch of all their tokens; no text is read."""
    union = F.hll_union_agg("sketch")
    return sketches.groupBy(*by).agg(F.hll_sketch_estimate(union).alias("vocab_used_approx"))


def topk_share(token_counts: DataFrame, ks: Sequence[int] = (100, 1000, 5000), lang: str = "language",
               cnt: str = "cnt") -> DataFrame:
    """Share of all token occurrences held by the k most frequent tokens.

    Works on the count-of-counts histogram (one row per distinct frequency,
    about sqrt(2 N) rows per language), so no window runs over the tokens.
    The tokens tied at the k-th frequency contribute the same count whichever
    of them is picked, so the share is exact.
    """
    hist = token_counts.groupBy(lang, cnt).agg(F.count(F.lit(1)).alias("ntok"))
    w = Window.partitionBy(lang).orderBy(F.col(cnt).desc()).rowsBetween(Window.unboundedPreceding, -1)
    h = hist.withColumn("tok_before", F.coalesce(F.sum("ntok").over(w), F.lit(0)))
    aggs = [F.sum(F.col("ntok") * F.col(cnt)).alias("_total")]
    for k in ks:
        take = F.least(F.greatest(F.lit(k) - F.col("tok_before"), F.lit(0)), F.col("ntok"))
        aggs.append(F.sum(take * F.col(cnt)).alias(f"_sum_top_{k}"))
    s = h.groupBy(lang).agg(*aggs)
    return s.select(
        lang,
        *[(F.col(f"_sum_top_{k}") / F.nullif(F.col("_total"), F.lit(0))).alias(f"share_top_{k}") for k in ks],
    )


def spearman(df: DataFrame, y: str, columns: Sequence[str]) -> DataFrame:
    """Spearman rho of ``y`` with each column (average ranks, Pearson of
    ranks), one row per column, with n and t for the tail.

    Rows are unpivoted and ranked per column by the distributed rank helper;
    the ranks are joined back on (column, value).
    """
    # read by the ranking and its joins: the input is evaluated once
    stacked = materialize(df.select(
        F.col(y).cast("double").alias("_y"),
        F.explode(
            F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("_x")) for c in columns])
        ).alias("_s"),
    ).select("_y", "_s.column", "_s._x").where(F.col("_y").isNotNull() & F.col("_x").isNotNull()))
    r = pair_ranks(stacked, "_x", "_y", ["column"])
    m = r.groupBy("column").agg(
        F.count(F.lit(1)).cast("bigint").alias("n"),
        F.regr_sxx("ry", "rx").alias("sxx"),
        F.regr_syy("ry", "rx").alias("syy"),
        F.regr_sxy("ry", "rx").alias("sxy"),
    )
    rho = F.col("sxy") / F.nullif(F.sqrt(F.col("sxx") * F.col("syy")), F.lit(0.0))
    t = rho * F.sqrt((F.col("n") - 2) / F.nullif(1.0 - rho * rho, F.lit(0.0)))
    return m.select(
        "column",
        "n",
        rho.alias("rho"),
        F.when((F.col("n") > 2) & (F.abs(rho) < 1), t).alias("statistic"),
        (F.col("n") - 2).cast("double").alias("df1"),
    )
