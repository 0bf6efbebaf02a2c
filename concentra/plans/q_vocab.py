"""Registered queries of vocabulary usage (G1-G11) on the documents table."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import vocab as vb
from ..operators.grid import generated_only
from ..operators.ordinal import materialize
from ..functions import metric
from ..functions.parsers import BLANK
from ..functions.tails import with_p_value
from ..session import scratch_path, table
from ..sources import fixtures as fx
from .registry import register, round_sql, rounded
from .sqlparts import DOC_WORDS, RUNS_DOCS, TEMPS_SQL, with_ctes
from .sqltails import exact, with_p

LANGS = ["de", "en", "es", "fr"]


def _char_script_sql(c: str) -> str:
    whens = [
        f"WHEN regexp_matches({c}, '^[\\p{{Z}}\\p{{C}}]$') THEN 'control'",
        f"WHEN regexp_matches({c}, '^[\\p{{P}}\\p{{S}}\\p{{N}}]$') THEN 'shared'",
    ]
    for name, ranges in vb.SCRIPT_RANGES:
        whens.append(f"WHEN regexp_matches({c}, '^[{vb._class(ranges)}]$') THEN '{name}'")
    return "CASE " + " ".join(whens) + " ELSE 'other' END"


_VOCAB_SQL = f"""
vocab AS (SELECT DISTINCT word AS token FROM doc_words),
vchars AS (SELECT token, unnest(range(1, length(token) + 1)) AS pos, unnest(string_split(token, '')) AS ch FROM vocab WHERE token <> ''),
vclass AS MATERIALIZED (SELECT ch, {_char_script_sql('ch')} AS script FROM (SELECT DISTINCT ch FROM vchars)),
vper AS (SELECT token, script, count(*) AS n, min(pos) AS first
         FROM vchars JOIN vclass USING (ch) GROUP BY ALL),
scripts AS (
  SELECT v.token, coalesce(b.script, 'empty') AS script
  FROM vocab v LEFT JOIN (
    SELECT token, script FROM (
      SELECT token, script, row_number() OVER (PARTITION BY token ORDER BY n DESC, first) AS rn FROM vper)
    WHERE rn = 1) b ON v.token = b.token)"""


def _vocab(spark, sf_dir):
    return fx.doc_words(spark, sf_dir).select(F.col("word").alias("token")).distinct()


def _scripts(spark, sf_dir):
    return vb.token_scripts(_vocab(spark, sf_dir))


@register(
    "g1_char_script",
    with_ctes(
        DOC_WORDS,
        """
chars AS (SELECT DISTINCT ch FROM (SELECT unnest(string_split(text, '')) AS ch FROM documents) WHERE ch <> '')""",
        body=f"SELECT ch, {_char_script_sql('ch')} AS script FROM chars",
    ),
)
def g1_char_script(spark, sf_dir):
    """Every distinct character of the documents with its script class."""
    docs = table(spark, sf_dir, "documents")
    chars = docs.select(F.explode(F.split("text", "")).alias("ch")).where(F.col("ch") != "").distinct()
    return chars.select("ch", vb.char_script("ch").alias("script"))


@register("g2_token_script", with_ctes(DOC_WORDS, _VOCAB_SQL, body="SELECT token, script FROM scripts"))
def g2_token_script(spark, sf_dir):
    return _scripts(spark, sf_dir)


@register(
    "g3_script_shares",
    with_ctes(
        DOC_WORDS,
        _VOCAB_SQL,
        body="""
SELECT script, CAST(count(*) AS BIGINT) AS n_tokens, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) + 0.0 AS pct
FROM scripts GROUP BY script""",
    ),
)
def g3_script_shares(spark, sf_dir):
    return rounded(vb.script_shares(_scripts(spark, sf_dir)))


def _script_lang_values() -> str:
    rows = []
    for script, langs in vb.SCRIPT_LANGS.items():
        rows += [f"('{script}', '{lang}')" for lang in langs if lang in LANGS]
    for script in vb.ALL_SCRIPTS_LANGS:
        rows += [f"('{script}', '{lang}')" for lang in LANGS]
    return "(VALUES " + ", ".join(rows) + ") m(script, language)"


_ALLOC_SQL = f"""
alloc AS (SELECT m.language, CAST(count(DISTINCT s.token) AS BIGINT) AS vocab_allocated
          FROM scripts s JOIN {_script_lang_values()} ON s.script = m.script GROUP BY m.language)"""


@register(
    "g4_allocated_vocab",
    with_ctes(DOC_WORDS, _VOCAB_SQL, _ALLOC_SQL, body="SELECT language, vocab_allocated FROM alloc"),
)
def g4_allocated_vocab(spark, sf_dir):
    return vb.allocated_vocab(_scripts(spark, sf_dir), LANGS)


@register(
    "g5_marked_tokens",
    with_ctes(
        DOC_WORDS,
        _VOCAB_SQL,
        body="\nUNION ALL\n".join(
            f"SELECT '{lang}' AS language, CAST(count(*) AS BIGINT) AS n_marked FROM scripts "
            f"WHERE script = 'latin' AND regexp_matches(token, '[{chars}]')"
            for lang, chars in vb.MARKS.items()
        ),
    ),
)
def g5_marked_tokens(spark, sf_dir):
    return vb.marked_tokens(_scripts(spark, sf_dir))


_USAGE_SQL = f"""
dp AS (SELECT DISTINCT lang AS language, text FROM documents),
dtok AS (SELECT language, text, list_filter(regexp_split_to_array(lower(text), '{BLANK}+'), lambda w: w <> '') AS toks FROM dp),
usage AS (
  SELECT u.language, u.mean_prompt_tokens, u.mean_fertility, u.n_prompts, v.vocab_used FROM
    (SELECT language, avg(len(toks)) AS mean_prompt_tokens,
            avg(CASE WHEN length(text) > 0 THEN len(toks) / length(text) END) AS mean_fertility,
            CAST(count(*) AS BIGINT) AS n_prompts
     FROM dtok GROUP BY language) u
  LEFT JOIN (SELECT language, CAST(count(DISTINCT t) AS BIGINT) AS vocab_used
             FROM (SELECT language, unnest(toks) AS t FROM dtok) GROUP BY language) v
  ON u.language = v.language),
tokc AS (SELECT language, t AS token, count(*) AS cnt FROM (SELECT language, unnest(toks) AS t FROM dtok) GROUP BY ALL),
topk AS (
  SELECT language,
         sum(CASE WHEN rn <= 100 THEN cnt END) / sum(cnt) AS share_top_100,
         sum(CASE WHEN rn <= 1000 THEN cnt END) / sum(cnt) AS share_top_1000,
         sum(CASE WHEN rn <= 5000 THEN cnt END) / sum(cnt) AS share_top_5000
  FROM (SELECT *, row_number() OVER (PARTITION BY language ORDER BY cnt DESC) AS rn FROM tokc)
  GROUP BY language)"""


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


@register(
    "g6_usage",
    with_ctes(_USAGE_SQL, body="SELECT language, mean_prompt_tokens, mean_fertility, n_prompts, vocab_used FROM usage"),
    doubles=["mean_prompt_tokens", "mean_fertility"],
)
def g6_usage(spark, sf_dir):
    return rounded(vb.usage(_docs(spark, sf_dir)))


@register("g6a_usage_approx")
def g6a_usage_approx(spark, sf_dir):
    return vb.usage_approx(_docs(spark, sf_dir))


RSD = 0.02


@register(
    "g6a_usage_approx_check",
    with_ctes(_USAGE_SQL, body="SELECT language, vocab_used, true AS within_3_rsd FROM usage"),
)
def g6a_usage_approx_check(spark, sf_dir):
    """The sketch within three relative standard deviations of the exact count."""
    exact = vb.usage(_docs(spark, sf_dir)).select("language", "vocab_used")
    j = exact.join(vb.usage_approx(_docs(spark, sf_dir), rsd=RSD), "language")
    ok = F.abs(F.col("vocab_used_approx") - F.col("vocab_used")) <= 3 * RSD * F.col("vocab_used")
    return j.select("language", "vocab_used", ok.alias("within_3_rsd"))


@register(
    "g6a_usage_sketches",
    with_ctes(_USAGE_SQL, body="SELECT language, vocab_used, true AS within_3_se, true AS same_as_one_pass FROM usage"),
)
def g6a_usage_sketches(spark, sf_dir):
    """Sketches kept per source and language, merged over the sources: within three
    standard errors of the exact count, and the same as of one pass over all texts."""
    docs = _docs(spark, sf_dir)
    path = scratch_path(spark, "usage-sketches")
    vb.store_sketches(vb.usage_sketches(docs, ["source"]), path, ["source"])
    merged = vb.merged_usage(spark.read.parquet(path))
    # merged with itself, so that it is estimated from its registers as every merge is
    one = materialize(vb.usage_sketches(docs, []))
    once = vb.merged_usage(one.unionByName(one)).withColumnRenamed("vocab_used_approx", "once")
    exact = vb.usage(docs).select("language", "vocab_used")
    j = exact.join(merged, "language").join(once, "language")
    ok = F.abs(F.col("vocab_used_approx") - F.col("vocab_used")) <= 3 * 1.04 / 2 ** (vb.LG_K / 2) * F.col("vocab_used")
    return j.select("language", "vocab_used", ok.alias("within_3_se"), (F.col("vocab_used_approx") == F.col("once")).alias("same_as_one_pass"))


def _token_counts(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    d = docs.select("doc_id", F.col("lang").alias("language"), "text").join(vb.first_copies(docs), "doc_id", "left_semi")
    toks = d.select("language", F.explode_outer(vb.prompt_tokens(d, "text")).alias("token")).where(F.col("token").isNotNull())
    return toks.groupBy("language", "token").agg(F.count(F.lit(1)).alias("cnt"))


@register(
    "g7_topk_share",
    with_ctes(_USAGE_SQL, body="SELECT language, share_top_100, share_top_1000, share_top_5000 FROM topk"),
    doubles=["share_top_100", "share_top_1000", "share_top_5000"],
)
def g7_topk_share(spark, sf_dir):
    return rounded(vb.topk_share(_token_counts(spark, sf_dir)))


@register(
    "g8_generated_usage",
    with_ctes(
        f"""
v1 AS (
  SELECT CAST(floor(vec_id / 5) AS BIGINT) AS gen_id,
         list_transform(embedding, lambda x: CAST(x AS DOUBLE) * 20.0) AS scores
  FROM embeddings),
v1t AS (SELECT gen_id, t.temp, scores, list_max(scores) AS m FROM v1, {TEMPS_SQL} t(temp)),
v1s AS (SELECT gen_id, temp, scores, m,
               list_reduce(scores, lambda acc, v: acc + exp((v - m) / temp), 0.0::DOUBLE) AS s FROM v1t),
v1p AS (SELECT gen_id, temp, list_position(scores, list_max(scores)) - 1 AS am,
               list_reverse_sort(list_transform(scores, lambda v: exp((v - m) / temp) / s)) AS p FROM v1s),
per_gen AS (
  SELECT gen_id, temp, count(*) AS seq_len,
         avg(list_reduce(list_slice(p, 1, 1), lambda a, b: a + b, 0.0::DOUBLE)) AS m1,
         avg(list_reduce(list_slice(p, 1, 5), lambda a, b: a + b, 0.0::DOUBLE)) AS m5,
         avg(list_reduce(list_slice(p, 1, 20), lambda a, b: a + b, 0.0::DOUBLE)) AS m20
  FROM v1p GROUP BY gen_id, temp)""",
        body="""
SELECT a.temp, a.vocab_used_argmax, b.mass_top_1, b.mass_top_5, b.mass_top_20, b.mean_gen_tokens,
       b.total_gen_tokens, b.n_generations
FROM (SELECT temp, CAST(count(DISTINCT am) AS BIGINT) AS vocab_used_argmax FROM v1p GROUP BY temp) a
JOIN (SELECT temp, avg(m1) AS mass_top_1, avg(m5) AS mass_top_5, avg(m20) AS mass_top_20,
             avg(seq_len) AS mean_gen_tokens, CAST(sum(seq_len) AS BIGINT) AS total_gen_tokens,
             CAST(count(*) AS BIGINT) AS n_generations
      FROM per_gen GROUP BY temp) b ON a.temp = b.temp""",
    ),
    doubles=["temp", "mass_top_1", "mass_top_5", "mass_top_20", "mean_gen_tokens"],
)
def g8_generated_usage(spark, sf_dir):
    """Usage on the generation side: distinct argmax tokens and top-k mass per temp."""
    per_pos = fx.score_positions(spark, sf_dir).select(
        "gen_id", metric.argmax_token("scores").alias("am"), F.inline(metric.topk_masses("scores", (1, 5, 20), fx.TEMPS))
    )
    per_gen = per_pos.groupBy("gen_id", "temp").agg(
        F.count(F.lit(1)).alias("seq_len"), *[F.avg(f"m{k}").alias(f"m{k}") for k in (1, 5, 20)]
    )
    a = per_pos.groupBy("temp").agg(F.countDistinct("am").cast("bigint").alias("vocab_used_argmax"))
    b = per_gen.groupBy("temp").agg(
        *[F.avg(f"m{k}").alias(f"mass_top_{k}") for k in (1, 5, 20)],
        F.avg("seq_len").alias("mean_gen_tokens"),
        F.sum("seq_len").cast("bigint").alias("total_gen_tokens"),
        F.count(F.lit(1)).cast("bigint").alias("n_generations"),
    )
    return rounded(a.join(b, "temp"))


@register(
    "g8_generated_usage_by_language",
    """
WITH v1 AS (
  SELECT label AS language, CAST(floor(vec_id / 5) AS BIGINT) AS gen_id, vec_id % 5 AS pos, vec_id % 64 AS sampled,
         list_transform(embedding, lambda x: CAST(x AS DOUBLE) * 20.0) AS scores
  FROM embeddings),
kept AS (
  SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY language, gen_id) AS total FROM v1)
  WHERE pos >= gen_id % 3 OR total <= gen_id % 3),
p AS (
  SELECT language, gen_id, sampled, list_position(scores, list_max(scores)) - 1 AS am,
         list_reverse_sort(list_transform(scores, lambda v: exp(v - list_max(scores)))) AS w
  FROM kept),
m AS (
  SELECT *, list_sum(w[1:5]) / list_sum(w) AS m5, list_sum(w[1:20]) / list_sum(w) AS m20 FROM p),
g AS (SELECT language, gen_id, count(*) AS n, avg(m5) AS m5, avg(m20) AS m20 FROM m GROUP BY language, gen_id)
SELECT a.*, b.mass_top_5, b.mass_top_20, b.mean_gen_tokens, b.n_generations
FROM (SELECT language, CAST(count(DISTINCT am) AS BIGINT) AS vocab_used_argmax, CAST(count(DISTINCT sampled) AS BIGINT) AS vocab_used_sampled,
             CAST(count(*) AS BIGINT) AS total_gen_tokens FROM m GROUP BY language) a
JOIN (SELECT language, avg(m5) AS mass_top_5, avg(m20) AS mass_top_20, avg(n) AS mean_gen_tokens, CAST(count(*) AS BIGINT) AS n_generations
      FROM g GROUP BY language) b ON a.language = b.language""",
    doubles=["mass_top_5", "mass_top_20", "mean_gen_tokens"],
)
def g8_generated_usage_by_language(spark, sf_dir):
    """G8 per language, with the prompt positions dropped first and a column of
    sampled token ids counted (the label plays the language, an id derived from
    the vector's number the sampled token)."""
    emb = table(spark, sf_dir, "embeddings").select((F.col("vec_id") % 64).alias("sampled"), F.col("label").alias("language"), "vec_id", "embedding")
    pos = emb.select(
        "language", "sampled",
        F.floor(F.col("vec_id") / fx.POSITIONS_PER_GEN).cast("bigint").alias("gen_id"),
        (F.col("vec_id") % fx.POSITIONS_PER_GEN).cast("int").alias("pos"),
        F.transform("embedding", lambda x: x.cast("double") * F.lit(fx.GAIN)).alias("scores"),
    )
    # the vectors are reduced before anything moves
    narrow = pos.select(
        "language", "sampled", "gen_id", "pos", metric.argmax_token("scores").alias("am"), F.inline(metric.topk_masses("scores", (5, 20)))
    ).withColumn("prompt_n", fx.prompt_positions())
    kept = generated_only(narrow, ["language", "gen_id"], "pos", "prompt_n")
    per_gen = kept.groupBy("language", "gen_id").agg(F.count(F.lit(1)).alias("n"), F.avg("m5").alias("m5"), F.avg("m20").alias("m20"))
    a = kept.groupBy("language").agg(
        F.countDistinct("am").cast("bigint").alias("vocab_used_argmax"),
        F.countDistinct("sampled").cast("bigint").alias("vocab_used_sampled"),
        F.count(F.lit(1)).cast("bigint").alias("total_gen_tokens"),
    )
    b = per_gen.groupBy("language").agg(
        F.avg("m5").alias("mass_top_5"), F.avg("m20").alias("mass_top_20"), F.avg("n").alias("mean_gen_tokens"),
        F.count(F.lit(1)).cast("bigint").alias("n_generations"),
    )
    return rounded(a.join(b, "language"))


_SUMMARY_SQL = """
metric AS (SELECT language, avg(ned_mean) AS ned_mean FROM runs_docs WHERE temp = 1.0 GROUP BY language),
summary AS (
  SELECT m.language, round(m.ned_mean, 4) AS ned_mean, a.vocab_allocated, u.vocab_used,
         round(k.share_top_100, 4) AS share_top_100, round(k.share_top_1000, 4) AS share_top_1000,
         round(k.share_top_5000, 4) AS share_top_5000, round(u.mean_fertility, 4) AS mean_fertility,
         round(u.mean_prompt_tokens, 1) AS mean_prompt_tokens
  FROM metric m JOIN alloc a ON m.language = a.language JOIN usage u ON m.language = u.language
       JOIN topk k ON m.language = k.language)"""

_SUMMARY_CTES = (DOC_WORDS, RUNS_DOCS, _VOCAB_SQL, _ALLOC_SQL, _USAGE_SQL, _SUMMARY_SQL)


def language_summary(spark, sf_dir):
    """One row per language: metric mean (temp 1.0), allocation, usage, top-k shares.

    The documents are tokenised once into a stored token-count table, which feeds the
    metric. Its sums per language and token are stored too: every token once per
    language, they feed the vocabulary, usage and the top-k shares.
    """
    docs = _docs(spark, sf_dir)
    marked = vb.mark_first_copies(docs, vb.first_copies(docs))
    tc = materialize(vb.doc_token_counts(marked, extra=("source", "first")))
    runs = fx.runs_docs(spark, sf_dir, token_counts=tc, temps=(1.0,))
    m = runs.groupBy("language").agg(F.avg("ned_mean").alias("ned_mean"))
    by_language = materialize(vb.distinct_prompt_token_counts(tc))
    vocab = by_language.select("token").distinct()
    alloc = vb.allocated_vocab(vb.token_scripts(vocab), LANGS)
    use = vb.usage_from_tokens(docs, by_language)
    top = vb.topk_share(by_language.where("cnt > 0"))
    j = m.join(alloc, "language").join(use, "language").join(top, "language")
    return j.select(
        "language",
        F.round("ned_mean", 4).alias("ned_mean"),
        "vocab_allocated",
        "vocab_used",
        F.round("share_top_100", 4).alias("share_top_100"),
        F.round("share_top_1000", 4).alias("share_top_1000"),
        F.round("share_top_5000", 4).alias("share_top_5000"),
        F.round("mean_fertility", 4).alias("mean_fertility"),
        F.round("mean_prompt_tokens", 1).alias("mean_prompt_tokens"),
    )


@register(
    "g9_language_summary",
    with_ctes(*_SUMMARY_CTES, body="SELECT * FROM summary"),
    doubles=["ned_mean", "share_top_100", "share_top_1000", "share_top_5000", "mean_fertility", "mean_prompt_tokens"],
)
def g9_language_summary(spark, sf_dir):
    return rounded(language_summary(spark, sf_dir))


SPEARMAN_COLS = ["vocab_allocated", "vocab_used", "share_top_100", "share_top_1000", "mean_fertility", "mean_prompt_tokens"]


def _spearman_sql(src: str, y: str, cols) -> str:
    unp = "\nUNION ALL\n".join(
        f"SELECT '{c}' AS col, CAST({y} AS DOUBLE) AS y, CAST({c} AS DOUBLE) AS x FROM {src} "
        f"WHERE {y} IS NOT NULL AND {c} IS NOT NULL"
        for c in cols
    )
    return f"""
SELECT col AS "column", CAST(count(*) AS BIGINT) AS n, round(rho, 6) + 0.0 AS rho,
       round(CASE WHEN count(*) > 2 AND abs(rho) < 1 THEN rho * sqrt((count(*) - 2) / nullif(1 - rho * rho, 0)) END, 6) + 0.0 AS statistic,
       CAST(count(*) - 2 AS DOUBLE) AS df1
FROM (
  SELECT col, rx, ry, regr_sxy(ry, rx) OVER w / nullif(sqrt(regr_sxx(ry, rx) OVER w * regr_syy(ry, rx) OVER w), 0) AS rho
  FROM (
    SELECT col,
           rank() OVER (PARTITION BY col ORDER BY x) + (count(*) OVER (PARTITION BY col, x) - 1) / 2.0 AS rx,
           rank() OVER (PARTITION BY col ORDER BY y) + (count(*) OVER (PARTITION BY col, y) - 1) / 2.0 AS ry
    FROM ({unp}))
  WINDOW w AS (PARTITION BY col))
GROUP BY col, rho"""


@register("g10_spearman_stat", with_ctes(*_SUMMARY_CTES, body=_spearman_sql("summary", "ned_mean", SPEARMAN_COLS)))
def g10_spearman_stat(spark, sf_dir):
    return rounded(vb.spearman(language_summary(spark, sf_dir), "ned_mean", SPEARMAN_COLS))


@register(
    "g10_spearman_p",
    with_ctes(*_SUMMARY_CTES, body=round_sql(with_p(exact(_spearman_sql("summary", "ned_mean", SPEARMAN_COLS)), "'t'", df2="NULL"), ["rho", "statistic", "p_value", "log10_p"])),
)
def g10_spearman_p(spark, sf_dir):
    s = vb.spearman(language_summary(spark, sf_dir), "ned_mean", SPEARMAN_COLS)
    return rounded(with_p_value(s, "t", stat="statistic", df1="df1", df2=None))


@register(
    "g10_spearman_runs_stat",
    with_ctes(
        DOC_WORDS,
        RUNS_DOCS,
        "runs_r AS (SELECT round(ned_mean, 9) AS ned_mean, seq_len, temp, rank FROM runs_docs)",
        body=_spearman_sql("runs_r", "ned_mean", ["seq_len", "temp", "rank"]),
    ),
)
def g10_spearman_runs_stat(spark, sf_dir):
    """Spearman on the whole documents run table (3 columns, ties in temp).

    The computed metric is rounded to 9 decimals before ranking, so that
    copies of a document (same value up to summation order) tie."""
    runs = fx.runs_docs(spark, sf_dir, ranked=True).withColumn("ned_mean", F.round("ned_mean", 9))
    return rounded(vb.spearman(runs, "ned_mean", ["seq_len", "temp", "rank"]))


@register(
    "g11_verdict",
    with_ctes(
        *_SUMMARY_CTES,
        body=f"""
SELECT CAST(max(CASE WHEN language = 'en' THEN vocab_allocated END) AS BIGINT) AS en_allocated,
       CAST(sum(CASE WHEN language <> 'en' AND vocab_allocated = en_alloc AND ned_mean <> en_ned THEN 1 ELSE 0 END) AS BIGINT) AS same_alloc_other_metric,
       CASE WHEN sum(CASE WHEN language <> 'en' AND vocab_allocated = en_alloc AND ned_mean <> en_ned THEN 1 ELSE 0 END) > 0
            THEN 'allocation alone does not explain the metric' ELSE 'not decided by allocation' END AS allocation_verdict,
       (SELECT rho FROM ({_spearman_sql("summary", "ned_mean", ["vocab_allocated"])})) AS rho_allocated,
       CASE WHEN (SELECT rho FROM ({_spearman_sql("summary", "ned_mean", ["vocab_allocated"])})) < -0.5
            THEN 'partial support' ELSE 'no support' END AS vocab_verdict
FROM (SELECT *, max(CASE WHEN language = 'en' THEN vocab_allocated END) OVER () AS en_alloc,
                max(CASE WHEN language = 'en' THEN ned_mean END) OVER () AS en_ned FROM summary)""",
    ),
)
def g11_verdict(spark, sf_dir):
    """Does allocation explain the metric? (one row)"""
    s = materialize(language_summary(spark, sf_dir))  # read twice
    rho = vb.spearman(s, "ned_mean", ["vocab_allocated"]).select(F.col("rho").alias("rho_allocated"))
    # the summary holds one row per language: a window over it is tiny
    w = Window.partitionBy()
    en_alloc = F.max(F.when(F.col("language") == "en", F.col("vocab_allocated"))).over(w)
    en_ned = F.max(F.when(F.col("language") == "en", F.col("ned_mean"))).over(w)
    hit = F.when(
        (F.col("language") != "en") & (F.col("vocab_allocated") == en_alloc) & (F.col("ned_mean") != en_ned), 1
    ).otherwise(0)
    agg = s.select(en_alloc.alias("en_alloc"), hit.alias("hit")).agg(
        F.max("en_alloc").cast("bigint").alias("en_allocated"),
        F.sum("hit").cast("bigint").alias("same_alloc_other_metric"),
    )
    # two one-row frames side by side without a join
    out = agg.unionByName(rho, allowMissingColumns=True).agg(
        F.max("en_allocated").alias("en_allocated"),
        F.max("same_alloc_other_metric").alias("same_alloc_other_metric"),
        F.max("rho_allocated").alias("rho_allocated"),
    )
    return rounded(
        out.select(
            "en_allocated",
            "same_alloc_other_metric",
            F.when(F.col("same_alloc_other_metric") > 0, F.lit("allocation alone does not explain the metric"))
            .otherwise(F.lit("not decided by allocation"))
            .alias("allocation_verdict"),
            "rho_allocated",
            F.when(F.col("rho_allocated") < -0.5, F.lit("partial support")).otherwise(F.lit("no support")).alias(
                "vocab_verdict"
            ),
        )
    )

