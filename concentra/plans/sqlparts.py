"""DuckDB SQL of the derived inputs, mirroring ``sources.fixtures`` (oracle side)."""

from ..functions.parsers import BLANK

TEMPS_SQL = "unnest([0.7::DOUBLE, 1.0::DOUBLE, 1.3::DOUBLE])"

# V1 positions with the metric per position and temperature
POS_NED = f"""
v1 AS (
  SELECT CAST(floor(vec_id / 5) AS BIGINT) AS gen_id, CAST(vec_id % 5 AS INTEGER) AS pos,
         list_transform(embedding, lambda x: CAST(x AS DOUBLE) * 20.0) AS scores
  FROM embeddings),
v1t AS (
  SELECT gen_id, pos, t.temp, scores, list_max(scores) AS m
  FROM v1, {TEMPS_SQL} t(temp)),
v1s AS (
  SELECT gen_id, pos, temp,
         list_reduce(scores, lambda acc, v: acc + exp((v - m) / temp), 0.0::DOUBLE) AS s,
         list_reduce(scores, lambda acc, v: acc + exp((v - m) / temp) * ((v - m) / temp), 0.0::DOUBLE) AS q,
         len(scores) AS w
  FROM v1t),
pos_ned AS (
  SELECT gen_id, pos, temp, 1 + (q / s - ln(s)) / nullif(ln(w), 0) AS ned FROM v1s),
pos_trim AS (
  SELECT gen_id, pos, temp, ned FROM (
    SELECT *, count(*) OVER (PARTITION BY gen_id, temp) AS total, CAST(gen_id % 3 AS INTEGER) AS prompt_n
    FROM pos_ned)
  WHERE pos >= prompt_n OR total <= prompt_n)"""


def runs_vec_sql(source: str = "pos_ned", name: str = "runs") -> str:
    return f"""
{name}_agg AS (
  SELECT gen_id, temp, avg(ned) AS ned_mean, stddev_pop(ned) AS ned_std, count(*) AS seq_len
  FROM {source} GROUP BY gen_id, temp),
{name}_attr AS (
  SELECT gen_id, temp, seq_len, ned_mean, ned_std,
         ['alpha-7b', 'beta-27b', 'gamma-70b'][CAST(gen_id % 3 AS INTEGER) + 1] AS model,
         ['wiki', 'news', 'fiction', 'code'][CAST(CAST(floor(gen_id / 3) AS BIGINT) % 4 AS INTEGER) + 1] AS domain
  FROM {name}_agg),
{name} AS (
  SELECT gen_id, temp, seq_len, ned_mean, ned_std, model, domain,
         CAST(floor(CAST(nullif(regexp_extract(model, '(\\d+(?:\\.\\d+)?)\\s*[Bb]', 1), '') AS DOUBLE) * 1e9) AS BIGINT) AS model_size,
         domain || ': generation ' || CAST(gen_id AS VARCHAR) AS prompt,
         CAST(row_number() OVER (ORDER BY temp, gen_id) - 1 AS BIGINT) AS rank,
         CAST((row_number() OVER (ORDER BY temp, gen_id) - 1) // 20 AS BIGINT) AS chkpt_id
  FROM {name}_attr)"""


def with_ctes(*parts: str, body: str) -> str:
    parts = [p.strip() for p in parts if p and p.strip()]
    if not parts:
        return body
    return "WITH " + ",\n".join(parts) + "\n" + body


def r6(expr: str, alias: str) -> str:
    """Final rounding of a double column, as Spark's ``rounded`` does (no -0.0)."""
    return f"round(CAST({expr} AS DOUBLE), 6) + 0.0 AS {alias}"


RUNS = with_ctes  # alias for readability in plans

# V3: documents as word-count distributions, one run row per (doc, temp)
DOC_WORDS = f"""
doc_words AS (
  SELECT doc_id, lang, source, word
  FROM (SELECT doc_id, lang, source, unnest(regexp_split_to_array(lower(text), '{BLANK}+')) AS word FROM documents)
  WHERE word <> ''),
doc_wc AS (
  SELECT doc_id, lang, source, word, count(*) AS cnt FROM doc_words GROUP BY ALL)"""

RUNS_DOCS = f"""
doc_wct AS (
  SELECT doc_id, lang, source, cnt, t.temp FROM doc_wc, {TEMPS_SQL} t(temp)),
doc_ned AS (
  SELECT doc_id, lang, source, temp, sum(cnt) AS n_total, count(*) AS n_items,
         sum(exp(ln(cnt) / temp)) AS s, sum(exp(ln(cnt) / temp) * (ln(cnt) / temp)) AS q
  FROM doc_wct GROUP BY doc_id, lang, source, temp),
runs_docs AS (
  SELECT doc_id, temp, CAST(n_total AS BIGINT) AS seq_len,
         1 + (q / s - ln(s)) / nullif(ln(CAST(n_items AS DOUBLE)), 0) AS ned_mean,
         0.0::DOUBLE AS ned_std, source AS domain, lang AS language,
         CAST(row_number() OVER (ORDER BY temp, doc_id) - 1 AS BIGINT) AS rank,
         CAST((row_number() OVER (ORDER BY temp, doc_id) - 1) // 20 AS BIGINT) AS chkpt_id
  FROM doc_ned)"""
