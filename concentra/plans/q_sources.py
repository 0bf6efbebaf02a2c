"""Registered queries of sources, sinks and run-grid preparation."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from ..functions import parsers as ps
from ..functions.parsers import BLANK
from ..operators import grid
from ..operators import stats as st
from ..session import table
from ..sources import fixtures as fx
from ..sources import io
from .q_tests import battery_sql, p_sql
from .registry import register, rounded
from .sqlparts import POS_NED, RUNS_DOCS, DOC_WORDS, runs_vec_sql, with_ctes

RUNS_CTES = (POS_NED, runs_vec_sql())
RUNS_T_CTES = (POS_NED, runs_vec_sql("pos_trim", "runs_t"))

# ---------------------------------------------------------------- A1 / A1b

_LINES_SQL = f"""
lines AS (
  SELECT CAST(json_object('domain', CASE WHEN role = 'user' THEN role END, 'prompt', text) AS VARCHAR) AS value
  FROM conversations
  UNION ALL
  SELECT unnest(string_split(text, chr(10))) AS value FROM conversations),
stripped AS (
  SELECT regexp_replace(value, '\\A{BLANK}+|{BLANK}+\\z', '', 'g') AS line FROM lines),
parsed AS (
  SELECT line, starts_with(line, '{{') AS is_json,
         CASE WHEN starts_with(line, '{{') AND json_valid(line) THEN json_extract_string(line, '$.domain') END AS d,
         CASE WHEN starts_with(line, '{{') AND json_valid(line) THEN json_extract_string(line, '$.prompt') END AS p
  FROM stripped WHERE line <> '')"""


def _lines(spark, sf_dir):
    """V7 with a domain on user turns only: assistant turns are domain-less JSON."""
    return fx.prompt_lines(spark, sf_dir, domain_roles=("user",))


@register(
    "a1_read_prompts",
    with_ctes(
        _LINES_SQL,
        body="""
SELECT prompt, is_json FROM (
  SELECT CASE WHEN is_json THEN d || ': ' || p ELSE line END AS prompt, is_json FROM parsed)
WHERE prompt IS NOT NULL""",
    ),
)
def a1_read_prompts(spark, sf_dir):
    return io.parse_prompt_lines(_lines(spark, sf_dir))


@register(
    "a1b_read_prompts_undomained",
    with_ctes(
        _LINES_SQL,
        body="""
SELECT prompt, is_json FROM (
  SELECT CASE WHEN is_json THEN (CASE WHEN d IS NULL THEN p ELSE d || ': ' || p END) ELSE line END AS prompt, is_json
  FROM parsed)
WHERE prompt IS NOT NULL""",
    ),
)
def a1b_read_prompts_undomained(spark, sf_dir):
    return io.parse_prompt_lines(_lines(spark, sf_dir), keep_undomained=True)


# ---------------------------------------------------------------- A2 / A3


@register(
    "a2_read_runs_csv",
    """
SELECT text AS prompt, CAST(length(text) AS BIGINT) AS seq_len, role AS domain,
       CAST(conv_id AS BIGINT) AS rank, CAST(turn AS BIGINT) AS chkpt_id
FROM conversations""",
)
def a2_read_runs_csv(spark, sf_dir):
    """Run rows whose prompts hold newlines and quotes survive a CSV round trip."""
    conv = table(spark, sf_dir, "conversations")
    runs = conv.select(
        *[
            (
                F.col("text") if f.name == "prompt"
                else F.length("text").cast("bigint") if f.name == "seq_len"
                else F.col("role") if f.name == "domain"
                else F.col("conv_id").cast("bigint") if f.name == "rank"
                else F.col("turn").cast("bigint") if f.name == "chkpt_id"
                else F.lit("conversations") if f.name == "model"
                else F.lit(None).cast(f.dataType)
            ).alias(f.name)
            for f in io.RUN_SCHEMA.fields
        ]
    )
    path = io.scratch_dir(spark, "a2")
    io.append_runs(runs, path, fmt="csv", partition_by=None)
    back = io.read_runs(spark, path, fmt="csv")
    return back.select("prompt", "seq_len", "domain", "rank", "chkpt_id")


@register(
    "a3_append_runs",
    with_ctes(*RUNS_CTES, body="SELECT model, CAST(2 * count(*) AS BIGINT) AS n_rows FROM runs GROUP BY model"),
)
def a3_append_runs(spark, sf_dir):
    """Two appends into a model-partitioned table, then an empty append."""
    runs = fx.runs_vec(spark, sf_dir)
    path = io.scratch_dir(spark, "a3")
    io.append_runs(runs, path)
    io.append_runs(runs, path)
    io.append_runs(runs.where(F.lit(False)), path)
    back = io.read_runs(spark, path)
    return back.groupBy("model").agg(F.count(F.lit(1)).cast("bigint").alias("n_rows"))


# ---------------------------------------------------------------- A4 / A5 / A9

_BUNDLES_SQL = """
bundles AS (
  SELECT CAST(floor(vec_id / 5) AS BIGINT) AS gen_id, CAST(vec_id % 5 AS INTEGER) AS pos,
         CAST(floor(floor(vec_id / 5) / 20) AS BIGINT) AS bundle_id
  FROM embeddings)"""


def _bundles(spark, sf_dir):
    path = io.scratch_dir(spark, "bundles")
    io.write_bundles(fx.score_positions(spark, sf_dir), path, F.floor(F.col("gen_id") / 20))
    return io.read_scores(spark, path)


@register(
    "a4_read_scores",
    with_ctes(
        _BUNDLES_SQL,
        body="""
SELECT bundle_id, CAST(count(*) AS BIGINT) AS n_positions, CAST(count(DISTINCT gen_id) AS BIGINT) AS n_generations,
       min(gen_id) AS first_gen, max(gen_id) AS last_gen
FROM bundles GROUP BY bundle_id""",
    ),
)
def a4_read_scores(spark, sf_dir):
    b = _bundles(spark, sf_dir)
    return b.groupBy("bundle_id").agg(
        F.count(F.lit(1)).cast("bigint").alias("n_positions"),
        F.countDistinct("gen_id").cast("bigint").alias("n_generations"),
        F.min("gen_id").alias("first_gen"),
        F.max("gen_id").alias("last_gen"),
    )


@register(
    "a5_merge_bundles",
    with_ctes(
        _BUNDLES_SQL,
        body="SELECT gen_id, pos, bundle_id, CAST(row_number() OVER (ORDER BY bundle_id, gen_id, pos) - 1 AS BIGINT) AS merged_pos FROM bundles",
    ),
)
def a5_merge_bundles(spark, sf_dir):
    m = io.merge_bundles(_bundles(spark, sf_dir))
    return m.select("gen_id", "pos", "bundle_id", "merged_pos")


@register(
    "a9_split_bad",
    """
SELECT status, CAST(count(*) AS BIGINT) AS n FROM (
  SELECT CASE WHEN scores IS NULL OR len(scores) = 0 OR list_bool_or(list_transform(scores, lambda v: isnan(v))) THEN 'bad' ELSE 'good' END AS status
  FROM (SELECT CASE vec_id % 10 WHEN 7 THEN NULL WHEN 8 THEN []
                    WHEN 9 THEN list_append(list_transform(embedding, lambda x: CAST(x AS DOUBLE)), 'nan'::DOUBLE)
                    ELSE list_transform(embedding, lambda x: CAST(x AS DOUBLE)) END AS scores FROM embeddings))
GROUP BY status""",
)
def a9_split_bad(spark, sf_dir):
    """Of ten vectors one is made NULL, one empty, one holds a NaN: written in one
    pass by status, counted from the files."""
    emb = table(spark, sf_dir, "embeddings")
    v = F.transform("embedding", lambda x: x.cast("double"))
    kind = F.col("vec_id") % 10
    scores = (
        F.when(kind == 8, F.array().cast("array<double>"))
        .when(kind == 9, F.concat(v, F.array(F.lit(float("nan")))))
        .when(kind != 7, v)
    )
    return io.write_split(emb.select("vec_id", scores.alias("scores")), io.scratch_dir(spark, "a9"))


@register(
    "a5_write_merged",
    with_ctes(
        _BUNDLES_SQL,
        body="""
SELECT bundle_id, CAST(count(*) AS BIGINT) AS n, min(merged_pos) AS first_pos, max(merged_pos) AS last_pos FROM (
  SELECT bundle_id, CAST(row_number() OVER (ORDER BY bundle_id, gen_id, pos) - 1 AS BIGINT) AS merged_pos FROM bundles)
GROUP BY bundle_id""",
    ),
)
def a5_write_merged(spark, sf_dir):
    """The merged table written by the compaction job, read back."""
    path = io.scratch_dir(spark, "a5")
    io.write_merged(_bundles(spark, sf_dir), path)
    m = spark.read.parquet(path)
    return m.groupBy("bundle_id").agg(
        F.count(F.lit(1)).cast("bigint").alias("n"),
        F.min("merged_pos").alias("first_pos"),
        F.max("merged_pos").alias("last_pos"),
    )


@register(
    "b12_rank_offline",
    with_ctes(
        _BUNDLES_SQL,
        body="""
SELECT gen_id, bundle_id,
       CAST(row_number() OVER (PARTITION BY bundle_id ORDER BY gen_id) - 1 AS BIGINT) AS rank, bundle_id AS chkpt_id
FROM (SELECT DISTINCT gen_id, bundle_id FROM bundles)""",
    ),
)
def b12_rank_offline(spark, sf_dir):
    """One run row per generation of each bundle, ranked inside its bundle."""
    gens = _bundles(spark, sf_dir).select("gen_id", "bundle_id").distinct()
    return grid.with_rank_offline(gens).select("gen_id", "bundle_id", "rank", "chkpt_id")


@register(
    "a4_runs_from_bundles",
    with_ctes(
        POS_NED,
        """
bpos AS (SELECT gen_id, CAST(floor(gen_id / 20) AS BIGINT) AS bundle_id,
                ['wiki', 'news', 'fiction', 'code'][CAST(CAST(floor(gen_id / 3) AS BIGINT) % 4 AS INTEGER) + 1]
                  || ': generation ' || CAST(gen_id AS VARCHAR) AS prompt, ned
         FROM pos_ned WHERE temp = 1.0)""",
        body="""
SELECT bundle_id, gen_id, prompt, avg(ned) AS ned_mean, stddev_pop(ned) AS ned_std, CAST(count(*) AS BIGINT) AS seq_len,
       'beta-27b' AS model, CAST(27000000000 AS BIGINT) AS model_size,
       CASE WHEN instr(prompt, ':') > 0 THEN nullif(regexp_replace(split_part(prompt, ':', 1), '\\A""" + BLANK + """+|""" + BLANK + """+\\z', '', 'g'), '') END AS domain,
       CAST(row_number() OVER (PARTITION BY bundle_id ORDER BY gen_id) - 1 AS BIGINT) AS rank, bundle_id AS chkpt_id
FROM bpos GROUP BY bundle_id, gen_id, prompt""",
    ),
    doubles=["ned_mean", "ned_std"],
)
def a4_runs_from_bundles(spark, sf_dir):
    """Score bundles with a prompt per generation reduced into run rows
    (offline path: rank per bundle, chkpt_id = bundle number)."""
    from ..operators.reduce import runs_from_bundles

    domains = F.array(*[F.lit(d) for d in fx.DOMAINS])
    pos = fx.score_positions(spark, sf_dir).withColumn(
        "prompt",
        F.concat(
            F.element_at(domains, (F.floor(F.col("gen_id") / 3) % 4 + 1).cast("int")),
            F.lit(": generation "),
            F.col("gen_id").cast("string"),
        ),
    )
    path = io.scratch_dir(spark, "bundles-meta")
    io.write_bundles(pos, path, F.floor(F.col("gen_id") / 20))
    runs = runs_from_bundles(io.read_scores(spark, path), "beta-27b", meta=("prompt",), temp=1.0)
    return rounded(
        runs.select("bundle_id", "gen_id", "prompt", "ned_mean", "ned_std", "seq_len", "model", "model_size",
                    "domain", "rank", "chkpt_id")
    )


# ---------------------------------------------------------------- A6 / A7 / A8


@register(
    "a6_combine_runs",
    with_ctes(
        *RUNS_CTES,
        DOC_WORDS,
        RUNS_DOCS,
        body="""
SELECT run_id, CAST(count(*) AS BIGINT) AS n, CAST(count(model) AS BIGINT) AS n_model,
       CAST(count(language) AS BIGINT) AS n_language, round(avg(ned_mean), 6) + 0.0 AS mean_ned
FROM (SELECT 'vec' AS run_id, model, NULL AS language, ned_mean FROM runs
      UNION ALL SELECT 'docs' AS run_id, NULL AS model, language, ned_mean FROM runs_docs)
GROUP BY run_id""",
    ),
)
def a6_combine_runs(spark, sf_dir):
    c = io.combine_runs({"vec": fx.runs_vec(spark, sf_dir), "docs": fx.runs_docs(spark, sf_dir)})
    return rounded(
        c.groupBy("run_id").agg(
            F.count(F.lit(1)).cast("bigint").alias("n"),
            F.count("model").cast("bigint").alias("n_model"),
            F.count("language").cast("bigint").alias("n_language"),
            F.avg("ned_mean").alias("mean_ned"),
        )
    )


@register("a7_write_report", with_ctes(*RUNS_T_CTES, body=p_sql(battery_sql("runs_t"))))
def a7_write_report(spark, sf_dir):
    runs = fx.runs_vec(spark, sf_dir, trim_prompt=True, ranked=True)
    path = io.scratch_dir(spark, "a7")
    io.write_report(st.battery(runs), path, st.tukey_hsd(runs))
    report = st.with_p(st.anova(runs)).schema  # the columns of a report
    return rounded(spark.read.option("header", True).schema(report).csv(os.path.join(path, "report")))


@register(
    "a8_write_prompts",
    """
SELECT text AS prompt, role AS domain,
       CAST(len(list_filter(regexp_split_to_array(text, '""" + BLANK + """+'), lambda w: w <> '')) AS BIGINT) AS len
FROM conversations""",
)
def a8_write_prompts(spark, sf_dir):
    conv = table(spark, sf_dir, "conversations")
    prompts = conv.select(
        F.col("text").alias("prompt"),
        F.col("role").alias("domain"),
        F.size(F.filter(F.split("text", f"{BLANK}+"), lambda w: w != "")).cast("bigint").alias("len"),
    )
    path = io.scratch_dir(spark, "a8")
    io.write_prompts(prompts, path)
    return spark.read.schema(io.PROMPT_JSON).json(path).select("prompt", "domain", "len")


# ---------------------------------------------------------------- B1-B3

_GRID_SQL = """
grid0 AS (
  SELECT doc_id, t.temp_idx, t.temp
  FROM documents, (VALUES (0, 0.7::DOUBLE), (1, 1.0::DOUBLE), (2, 1.3::DOUBLE)) t(temp_idx, temp)),
grid AS (
  SELECT doc_id, temp, CAST(row_number() OVER (ORDER BY temp_idx, doc_id) - 1 AS BIGINT) AS combo_id FROM grid0)"""


def _grid(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return grid.run_grid(docs, "doc_id")


@register("b1_run_grid", with_ctes(_GRID_SQL, body="SELECT doc_id, temp, combo_id FROM grid"), doubles=["temp"])
def b1_run_grid(spark, sf_dir):
    return rounded(_grid(spark, sf_dir).select("doc_id", "temp", "combo_id"))


@register(
    "b2_shuffle_grid",
    with_ctes(
        _GRID_SQL,
        body="""
SELECT doc_id, temp, combo_id,
       CAST(row_number() OVER (ORDER BY md5('42|' || CAST(combo_id AS VARCHAR)), combo_id) - 1 AS BIGINT) AS run_order
FROM grid""",
    ),
    doubles=["temp"],
)
def b2_shuffle_grid(spark, sf_dir):
    return rounded(grid.shuffle_grid(_grid(spark, sf_dir), 42).select("doc_id", "temp", "combo_id", "run_order"))


@register(
    "b3_pending",
    with_ctes(
        _GRID_SQL,
        body="""
SELECT doc_id, temp, combo_id FROM grid
WHERE combo_id NOT IN (SELECT g.combo_id FROM grid g JOIN labels l ON g.doc_id = l.doc_id WHERE g.temp = 1.0)""",
    ),
    doubles=["temp"],
)
def b3_pending(spark, sf_dir):
    """Combinations not done yet; done = labelled documents run at temp 1.0."""
    g = _grid(spark, sf_dir)
    labels = table(spark, sf_dir, "labels").select("doc_id")
    done = g.where(F.col("temp") == 1.0).join(labels, "doc_id", "left_semi")
    return rounded(grid.pending(g, done).select("doc_id", "temp", "combo_id"))


# ---------------------------------------------------------------- B4-B8

_STRIP = "regexp_replace({x}, '\\A" + BLANK + "+|" + BLANK + "+\\z', '', 'g')"


def _domain_sql(x: str) -> str:
    inner = _STRIP.replace("{x}", f"split_part({x}, ':', 1)")
    return f"CASE WHEN instr({x}, ':') > 0 THEN nullif({inner}, '') END"


@register("b4_domain_pages", f"SELECT page_id, {_domain_sql('url')} AS domain FROM pages")
def b4_domain_pages(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", ps.domain_of("url").alias("domain"))


@register("b4_domain_docs", f"SELECT doc_id, {_domain_sql('text')} AS domain FROM documents")
def b4_domain_docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", ps.domain_of("text").alias("domain"))


_SIZE_SQL = "CAST(floor(CAST(nullif(regexp_extract({x}, '(\\d+(?:\\.\\d+)?)\\s*[Bb]', 1), '') AS DOUBLE) * 1e9) AS BIGINT)"


@register(
    "b5_model_pages",
    """
SELECT page_id,
       regexp_replace(regexp_replace(regexp_extract(url, '([^/]*)$', 1), '\\.gguf$', ''), '[-_]Q[0-9].*', '') AS label,
       """ + _SIZE_SQL.format(x="url") + """ AS size,
       coalesce(""" + _SIZE_SQL.format(x="regexp_replace(regexp_replace(regexp_extract(url, '([^/]*)$', 1), '\\.gguf$', ''), '[-_]Q[0-9].*', '')") + """, """ + _SIZE_SQL.format(x="url") + """) AS size_or_path
FROM pages""",
)
def b5_model_pages(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    label = ps.model_label("url")
    return p.select(
        "page_id",
        label.alias("label"),
        ps.model_size("url").alias("size"),
        ps.model_size_or_path(label, F.col("url")).alias("size_or_path"),
    )


@register("b5_model_size_docs", "SELECT doc_id, " + _SIZE_SQL.format(x="text") + " AS size FROM documents")
def b5_model_size_docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", ps.model_size("text").alias("size"))


def _bundle_sql(x: str) -> str:
    return f"CAST(nullif(regexp_extract({x}, '_chkpt_(\\d+)\\.pt$', 1), '') AS BIGINT)"


def _bundle_loose_sql(x: str) -> str:
    base = f"regexp_extract({x}, '([^/]*)$', 1)"
    return (
        f"CASE WHEN len(string_split({base}, '_chkpt_')) = 2 "
        f"THEN TRY_CAST(trim(split_part(string_split({base}, '_chkpt_')[2], '.pt', 1)) AS BIGINT) END"
    )


@register(
    "b6_bundle_index",
    with_ctes(
        *RUNS_CTES,
        """
paths AS (SELECT rank, 'runs/' || model || '_chkpt_' || CAST(chkpt_id AS VARCHAR) || '.pt' AS path FROM runs)""",
        body=f"""
SELECT rank, {_bundle_sql('path')} AS idx, {_bundle_loose_sql('path')} AS idx_loose,
       {_bundle_sql("path || '.bak'")} AS idx_bak, {_bundle_loose_sql("path || '.bak'")} AS idx_loose_bak
FROM paths""",
    ),
)
def b6_bundle_index(spark, sf_dir):
    runs = fx.runs_vec(spark, sf_dir, ranked=True)
    path = F.concat(F.lit("runs/"), F.col("model"), F.lit("_chkpt_"), F.col("chkpt_id").cast("string"), F.lit(".pt"))
    bak = F.concat(path, F.lit(".bak"))
    return runs.select(
        "rank",
        ps.bundle_index(path).alias("idx"),
        ps.bundle_index_loose(path).alias("idx_loose"),
        ps.bundle_index(bak).alias("idx_bak"),
        ps.bundle_index_loose(bak).alias("idx_loose_bak"),
    )


_VARIANTS = [
    ("double_lang", "'wiki_' || lang || ': wiki_' || lang || ': ' || text"),
    ("lang", "'wiki_' || lang || ': ' || text"),
    ("double_wiki", "'wiki: wiki: ' || text"),
    ("wiki", "'wiki: ' || text"),
    ("none", "text"),
]


def _strip_prefix_sql(p: str) -> str:
    pf = [
        "'wiki_' || lang || ': wiki_' || lang || ': '",
        "'wiki_' || lang || ': '",
        "'wiki: wiki: '",
        "'wiki: '",
    ]
    whens = " ".join(f"WHEN starts_with({p}, {x}) THEN substr({p}, length({x}) + 1)" for x in pf)
    return f"CASE {whens} ELSE {p} END"


@register(
    "b7_strip_prefix",
    "\nUNION ALL\n".join(
        f"SELECT doc_id, '{name}' AS variant, length({_strip_prefix_sql(expr)}) AS n_chars, "
        f"({_strip_prefix_sql(expr)}) = text AS restored FROM documents"
        for name, expr in _VARIANTS
    ),
)
def b7_strip_prefix(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    lang, text = F.col("lang"), F.col("text")
    exprs = {
        "double_lang": F.concat(F.lit("wiki_"), lang, F.lit(": wiki_"), lang, F.lit(": "), text),
        "lang": F.concat(F.lit("wiki_"), lang, F.lit(": "), text),
        "double_wiki": F.concat(F.lit("wiki: wiki: "), text),
        "wiki": F.concat(F.lit("wiki: "), text),
        "none": text,
    }
    out = None
    for name, e in exprs.items():
        s = ps.strip_prefix(e, "lang")
        d = docs.select(
            "doc_id",
            F.lit(name).alias("variant"),
            F.length(s).cast("bigint").alias("n_chars"),
            (s == text).alias("restored"),
        )
        out = d if out is None else out.unionByName(d)
    return out


@register("b8_with_language", "SELECT doc_id, replace('wiki_' || lang, 'wiki_', '') AS language FROM documents")
def b8_with_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", ps.language_of(F.concat(F.lit("wiki_"), F.col("lang"))).alias("language"))


# ---------------------------------------------------------------- B9-B12


@register(
    "b9_distinct_prompts",
    """
SELECT DISTINCT lang AS language, md5(text) AS prompt_md5
FROM documents, (VALUES (0.7), (1.0), (1.3)) t(temp)""",
)
def b9_distinct_prompts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    # only hashes are needed here, so the texts are neither multiplied nor moved
    hashes = docs.select(F.col("lang").alias("language"), F.md5("text").alias("prompt_md5"))
    runs = hashes.select("*", fx.temps_col().alias("temp"))
    return grid.distinct_prompts(runs, ("language", "prompt_md5"))


@register(
    "b9_first_seen",
    """
SELECT language, prompt_md5, CAST(row_number() OVER (PARTITION BY language ORDER BY first_at) - 1 AS BIGINT) AS first_seen
FROM (SELECT lang AS language, md5(text) AS prompt_md5, min(doc_id) AS first_at FROM documents GROUP BY ALL)""",
)
def b9_first_seen(spark, sf_dir):
    """Distinct prompts with their number in order of first occurrence, per language."""
    docs = table(spark, sf_dir, "documents")
    hashes = docs.select("doc_id", F.col("lang").alias("language"), F.md5("text").alias("prompt_md5"))
    runs = hashes.select("*", fx.temps_col().alias("temp"))
    return grid.distinct_prompts(runs, ("language", "prompt_md5"), order=["doc_id", "temp"])


@register(
    "b10_sample_per_group",
    """
SELECT lang, md5(text) AS item_md5, draw FROM (
  SELECT lang, text, CAST(row_number() OVER (PARTITION BY lang ORDER BY md5('42|' || text), text) AS BIGINT) AS draw
  FROM (SELECT DISTINCT lang, text FROM documents))
WHERE draw <= 50""",
)
def b10_sample_per_group(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    s = grid.sample_per_group(docs, "lang", "text", 50, seed=42)
    return s.select("lang", F.md5("text").alias("item_md5"), "draw")


@register(
    "b11_generated_only",
    with_ctes(POS_NED, body="SELECT gen_id, temp, CAST(count(*) AS BIGINT) AS seq_len FROM pos_trim GROUP BY gen_id, temp"),
    doubles=["temp"],
)
def b11_generated_only(spark, sf_dir):
    pos = fx.position_metrics(spark, sf_dir, trim_prompt=True)
    return rounded(pos.groupBy("gen_id", "temp").agg(F.count(F.lit(1)).cast("bigint").alias("seq_len")))


@register(
    "b12_rank_chkpt",
    with_ctes(*RUNS_CTES, body="SELECT gen_id, temp, rank, chkpt_id FROM runs"),
    doubles=["temp"],
)
def b12_rank_chkpt(spark, sf_dir):
    return rounded(fx.runs_vec(spark, sf_dir, ranked=True).select("gen_id", "temp", "rank", "chkpt_id"))


@register(
    "b12_rank_chkpt_by_model",
    with_ctes(
        *RUNS_CTES,
        body="""
SELECT gen_id, temp, model,
       CAST(row_number() OVER (PARTITION BY model ORDER BY temp, gen_id) - 1 AS BIGINT) AS rank,
       CAST((row_number() OVER (PARTITION BY model ORDER BY temp, gen_id) - 1) // 20 AS BIGINT) AS chkpt_id
FROM runs""",
    ),
    doubles=["temp"],
)
def b12_rank_chkpt_by_model(spark, sf_dir):
    runs = fx.runs_vec(spark, sf_dir)
    r = grid.with_rank_and_chkpt(runs, ["temp", "gen_id"], 20, by=["model"])
    return rounded(r.select("gen_id", "temp", "model", "rank", "chkpt_id"))
