"""Registered queries of prompt-set building."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.parsers import BLANK, strip_ws
from ..operators import corpus as cp
from ..operators import grid
from ..session import table
from .registry import register
from .sqlparts import with_ctes

# the reference's own quota: sentences drawn per language (the size of the sample is the feature)
QUOTA = 400


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '\\A{BLANK}+|{BLANK}+\\z', '', 'g')"


def _words(x: str) -> str:
    return f"len(list_filter(regexp_split_to_array({x}, '{BLANK}+'), lambda w: w <> ''))"


def _keep(delims: str) -> str:
    return f"string_split(regexp_replace(t, '([{delims}])', '\\1' || chr(1), 'g'), chr(1))"


_SENT_SQL = f"""
dt AS (SELECT doc_id, lang, {_strip("replace(text, chr(10), ' ')")} AS t FROM documents),
darr AS (
  SELECT doc_id, lang,
         CASE {" ".join(f"WHEN lang = '{k}' THEN {_keep(v)}" for k, v in cp.KEEP_DELIMS.items())}
              WHEN lang IN ('en', 'pl') THEN string_split(regexp_replace(t, '([.!?]){BLANK}+', '\\1' || chr(1), 'g'), chr(1))
              ELSE string_split(t, '.') END AS a
  FROM dt),
sents AS (
  SELECT doc_id, lang, sent_no, {_strip('s')} AS sentence
  FROM (SELECT doc_id, lang, unnest(range(0, len(a))) AS sent_no, unnest(a) AS s FROM darr)
  WHERE {_strip('s')} <> ''),
valid AS (
  SELECT * FROM sents
  WHERE CASE WHEN lang IN ('zh', 'ja') THEN length(sentence) BETWEEN 6 AND 150
             ELSE {_words('sentence')} BETWEEN 5 AND 40 END)"""


def _sentences(spark, sf_dir):
    return cp.split_sentences(table(spark, sf_dir, "documents"))


def _valid(spark, sf_dir):
    return cp.valid_sentences(table(spark, sf_dir, "documents"))


@register(
    "p1_split_sentences",
    with_ctes(_SENT_SQL, body="SELECT doc_id, lang, CAST(sent_no AS INTEGER) AS sent_no, sentence FROM sents"),
)
def p1_split_sentences(spark, sf_dir):
    return _sentences(spark, sf_dir).withColumn("sent_no", F.col("sent_no").cast("int"))


@register(
    "p2_valid_sentences",
    with_ctes(_SENT_SQL, body="SELECT lang, CAST(count(*) AS BIGINT) AS n_valid FROM valid GROUP BY lang"),
)
def p2_valid_sentences(spark, sf_dir):
    return _valid(spark, sf_dir).groupBy("lang").agg(F.count(F.lit(1)).cast("bigint").alias("n_valid"))


_DRAW_SQL = f"""
drawn AS (
  SELECT * FROM (
    SELECT lang, doc_id, sent_no, sentence,
           CAST(row_number() OVER (PARTITION BY lang ORDER BY md5('42|' || CAST(doc_id AS VARCHAR) || '|' || CAST(sent_no AS VARCHAR)), doc_id, sent_no) AS BIGINT) AS draw
    FROM valid)
  WHERE draw <= {QUOTA})"""


@register(
    "p3_quota_sample",
    with_ctes(_SENT_SQL, _DRAW_SQL, body="SELECT lang, doc_id, CAST(sent_no AS INTEGER) AS sent_no, draw FROM drawn"),
)
def p3_quota_sample(spark, sf_dir):
    s = cp.quota_sample_docs(table(spark, sf_dir, "documents"), QUOTA, seed=42)
    return s.select("lang", "doc_id", F.col("sent_no").cast("int").alias("sent_no"), "draw")


_SNIPPET_SQL = f"""
snip0 AS (
  SELECT page_id, regexp_extract(html, '(?s)<p[^>]*>(.*?)</p>', 1) AS b,
         regexp_extract(html, '(?s)<title[^>]*>(.*?)</title>', 1) AS ti
  FROM pages),
snip AS (
  SELECT page_id, {_strip(f"split_part({_strip('CASE WHEN b <> ' + chr(39) + chr(39) + ' THEN b ELSE ti END')}, chr(10), 1)")} AS snippet
  FROM snip0),
snippets AS (
  SELECT page_id, '{cp.CODE_INSTRUCTION}' || chr(10) || snippet AS prompt FROM snip
  WHERE snippet <> '' AND {_words('snippet')} BETWEEN 3 AND 30)"""


@register("p4_snippet_prompts", with_ctes(_SNIPPET_SQL, body="SELECT page_id, prompt FROM snippets"))
def p4_snippet_prompts(spark, sf_dir):
    return cp.snippet_prompts(table(spark, sf_dir, "pages"))


_QA_SQL = f"""
qa AS (
  SELECT q.conv_id, q.turn, q.q || ' (Answer: ' || a.a || ')' AS prompt
  FROM (SELECT conv_id, turn, {_strip('text')} AS q FROM conversations WHERE role = 'user') q
  JOIN (SELECT conv_id, turn - 1 AS turn, {_strip('text')} AS a FROM conversations WHERE role = 'assistant') a
    ON q.conv_id = a.conv_id AND q.turn = a.turn
  WHERE q.q <> '' AND a.a <> '' AND {_words('q.q')} >= 5)"""


@register("p5_qa_prompts", with_ctes(_QA_SQL, body="SELECT conv_id, turn, prompt FROM qa"))
def p5_qa_prompts(spark, sf_dir):
    return cp.qa_prompts(table(spark, sf_dir, "conversations"))


_WORD_LIST = f"list_filter(regexp_split_to_array(coalesce(text, ''), '{BLANK}+'), lambda w: w <> '')"


def _shuffled(category: str, parts: str, glue: str) -> str:
    order = f"list_transform({parts}, lambda x, i: {{'h': md5('42|{category}|' || CAST(item_id AS VARCHAR) || '|' || CAST(i - 1 AS VARCHAR)), 'x': x}})"
    return f"coalesce(array_to_string(list_transform(list_sort({order}), lambda s: s.x), '{glue}'), '')"


# Templates from the tables: user questions, and the first two words of documents, in
# hash order; their number is the caller's choice of a prompt set.
N_TEMPLATES = 20

_NEUTRAL_SQL = f"""
t_explicit AS (
  SELECT text, CAST(row_number() OVER (ORDER BY md5('42|' || text), text) - 1 AS BIGINT) AS slot
  FROM (SELECT DISTINCT {_strip('text')} AS text FROM conversations WHERE role = 'user') WHERE text <> ''),
t_neutral AS (
  SELECT text, CAST(row_number() OVER (ORDER BY md5('42|' || text), text) - 1 AS BIGINT) AS slot
  FROM (SELECT DISTINCT array_to_string({_WORD_LIST}[1:2], ' ') AS text FROM documents) WHERE text <> ''),
templates AS (
  SELECT 'explicit' AS category, slot, text FROM t_explicit WHERE slot < {N_TEMPLATES}
  UNION ALL SELECT 'neutral', slot, text FROM t_neutral WHERE slot < {N_TEMPLATES}),
neutral AS (
  SELECT item_id, 'empty' AS domain, '' AS prompt FROM benchmark
  UNION ALL SELECT item_id, 'random', {_shuffled('random', "list_filter(string_split(coalesce(text, ''), ''), lambda c: c <> '')", '')} FROM benchmark
  UNION ALL SELECT item_id, 'nonsense', {_shuffled('nonsense', _WORD_LIST, ' ')} FROM benchmark
  UNION ALL SELECT item_id, t.category, t.text
    FROM benchmark, (SELECT *, count(*) OVER (PARTITION BY category) AS n FROM templates) t WHERE t.slot = item_id % t.n)"""


def _templates(spark, sf_dir):
    """(category, slot, text): what the caller of P6 supplies, taken from the tables."""
    user = table(spark, sf_dir, "conversations").where(F.col("role") == "user").select(strip_ws("text").alias("text"))
    # two words, perhaps behind a leading blank: no more of the text is split
    first = F.slice(F.filter(F.slice(F.split("text", f"{BLANK}+", 4), 1, 3), lambda w: w != ""), 1, 2)
    stubs = table(spark, sf_dir, "documents").select(F.array_join(first, " ").alias("text"))
    both = user.withColumn("category", F.lit("explicit")).unionByName(stubs.withColumn("category", F.lit("neutral")))
    drawn = grid.sample_per_group(both.where(F.col("text") != ""), "category", "text", N_TEMPLATES, seed=42)
    return drawn.select("category", (F.col("draw") - 1).alias("slot"), "text")


def _neutral(spark, sf_dir):
    return cp.neutral_set(table(spark, sf_dir, "benchmark").select("item_id", "text"), _templates(spark, sf_dir))


@register("p6_neutral_set", with_ctes(_NEUTRAL_SQL, body="SELECT item_id, domain, prompt FROM neutral"))
def p6_neutral_set(spark, sf_dir):
    """Five neutral prompts per benchmark item, from its own text and from
    templates taken out of the conversations and documents."""
    return _neutral(spark, sf_dir)


def _assembled(spark, sf_dir):
    neutral = _neutral(spark, sf_dir).select(
        "prompt", "domain", F.col("item_id").alias("prompt_key")
    )
    qa = cp.qa_prompts(table(spark, sf_dir, "conversations")).select(
        "prompt", F.lit("qa").alias("domain"), F.concat_ws("-", "conv_id", "turn").alias("prompt_key")
    )
    snip = cp.snippet_prompts(table(spark, sf_dir, "pages")).select(
        "prompt", F.lit("snippet").alias("domain"), F.col("page_id").alias("prompt_key")
    )
    wiki = cp.quota_sample_docs(table(spark, sf_dir, "documents"), QUOTA, seed=42).select(
        F.col("sentence").alias("prompt"),
        F.concat(F.lit("wiki_"), F.col("lang")).alias("domain"),
        "lang",
        F.concat_ws("-", "doc_id", "sent_no").alias("prompt_key"),
    )
    return cp.assemble({"neutral": neutral, "qa": qa, "snippet": snip, "multilingual": wiki})


_ASSEMBLE_SQL = with_ctes(
    _SENT_SQL,
    _SNIPPET_SQL,
    _QA_SQL,
    _NEUTRAL_SQL,
    _DRAW_SQL,
    f"""
wiki AS (SELECT * FROM drawn),
sets AS (
  SELECT 'neutral' AS prompt_set, prompt, domain, NULL::VARCHAR AS lang, CAST(item_id AS VARCHAR) AS prompt_key FROM neutral
  UNION ALL SELECT 'qa', prompt, 'qa', NULL, CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) FROM qa
  UNION ALL SELECT 'snippet', prompt, 'snippet', NULL, CAST(page_id AS VARCHAR) FROM snippets
  UNION ALL SELECT 'multilingual', sentence, 'wiki_' || lang, lang, CAST(doc_id AS VARCHAR) || '-' || CAST(sent_no AS VARCHAR) FROM wiki),
assembled AS (
  SELECT prompt_set, domain, lang, prompt_key, prompt,
         CAST(CASE WHEN lang IN ('zh', 'ja') THEN length(prompt)
                   WHEN {_strip('prompt')} = '' THEN 0 ELSE {_words('prompt')} END AS BIGINT) AS len,
         CAST(row_number() OVER (ORDER BY md5('42|' || prompt_set || '|' || prompt_key || '|' || domain), prompt_set, prompt_key, domain) - 1 AS BIGINT) AS shuffle_pos
  FROM sets)""",
    body="SELECT prompt_set, domain, lang, prompt_key, len, shuffle_pos FROM assembled",
)


@register("p7_assemble", _ASSEMBLE_SQL)
def p7_assemble(spark, sf_dir):
    a = _assembled(spark, sf_dir)
    return a.select("prompt_set", "domain", "lang", "prompt_key", "len", "shuffle_pos")


@register(
    "p7_assemble_counts",
    _ASSEMBLE_SQL.replace(
        "SELECT prompt_set, domain, lang, prompt_key, len, shuffle_pos FROM assembled",
        "SELECT domain, lang, CAST(count(*) AS BIGINT) AS n FROM assembled GROUP BY domain, lang",
    ),
)
def p7_assemble_counts(spark, sf_dir):
    return _assembled(spark, sf_dir).groupBy("domain", "lang").agg(F.count(F.lit(1)).cast("bigint").alias("n"))


@register(
    "p8_length_band",
    with_ctes(
        _SENT_SQL,
        body=f"SELECT doc_id, CAST(sent_no AS INTEGER) AS sent_no, CAST({_words('sentence')} AS BIGINT) AS n_words FROM sents WHERE {_words('sentence')} BETWEEN 12 AND 20",
    ),
)
def p8_length_band(spark, sf_dir):
    s = _sentences(spark, sf_dir)
    b = cp.length_band(s, "sentence")
    return b.select("doc_id", F.col("sent_no").cast("int").alias("sent_no"), cp.word_count("sentence").cast("bigint").alias("n_words"))
