"""Inputs derived from the shared test tables (score bundles, run tables, series).

No tokenizer or model can be loaded here, so the score vectors and run tables
of the engine are derived from the given tables by arithmetic that DuckDB can
repeat exactly:

* ``score_positions`` (V1): embeddings as positions of generations.
* ``runs_vec`` (V2): V1 tempered at three temperatures and reduced per
  generation into run rows with model / domain / rank attributes.
* ``runs_docs`` (V3): documents as word-count distributions, one run row per
  document and temperature; grows with the documents table.
* ``series`` (V5): event values per user in time order.
* ``token_counts`` (V6): word counts per language.
* ``prompt_lines`` (V7): conversation turns as JSON and plain prompt lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import metric
from ..functions.parsers import lower_words, model_size
from ..operators.ordinal import global_ordinal
from ..session import table

# Fixed values of the derived run tables (shared with the oracle SQL).
TEMPS = (0.7, 1.0, 1.3)
GAIN = 20.0
POSITIONS_PER_GEN = 5
MODELS = ("alpha-7b", "beta-27b", "gamma-70b")
DOMAINS = ("wiki", "news", "fiction", "code")
SAVE_INTERVAL = 20


def temps_col(temps=TEMPS):
    return F.explode(F.array(*[F.lit(float(t)) for t in temps]))


def ned_per_temp(scores: str, temps=TEMPS):
    """(temp, ned) rows for every temperature, from one pass over the row."""
    return F.inline(
        F.array(*[F.struct(F.lit(float(t)).alias("temp"), metric.ned(scores, float(t)).alias("ned")) for t in temps])
    )


def score_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V1: gen_id, pos, prompt_n, scores (double, scaled by GAIN)."""
    emb = table(spark, sf_dir, "embeddings")
    return emb.select(
        F.floor(F.col("vec_id") / POSITIONS_PER_GEN).cast("bigint").alias("gen_id"),
        (F.col("vec_id") % POSITIONS_PER_GEN).cast("int").alias("pos"),
        F.transform("embedding", lambda x: x.cast("double") * F.lit(GAIN)).alias("scores"),
    )


def prompt_positions(gen_id_col="gen_id"):
    """Number of leading prompt positions of a generation (0, 1 or 2)."""
    return (F.col(gen_id_col) % 3).cast("int")


def position_metrics(spark: SparkSession, sf_dir: str, trim_prompt: bool = False) -> DataFrame:
    """V1 x temps with the metric per position (C3 + C2), optionally B11-trimmed."""
    v1 = score_positions(spark, sf_dir)
    # reduce each vector to one number per temperature in ONE projection and
    # explode only those numbers: the vector itself is never copied per
    # temperature, and later steps move narrow rows only
    pos = v1.select("gen_id", "pos", ned_per_temp("scores", TEMPS))
    if trim_prompt:
        from ..operators.grid import generated_only

        pos = generated_only(
            pos.withColumn("prompt_n", prompt_positions()), ["gen_id", "temp"], "pos", "prompt_n"
        ).drop("prompt_n")
    return pos


def with_rank(runs: DataFrame, order) -> DataFrame:
    """rank = 0-based order of the run rows, chkpt_id = floor(rank / SAVE_INTERVAL)."""
    ranked = global_ordinal(runs, order, name="rank")
    return ranked.withColumn("chkpt_id", F.floor(F.col("rank") / SAVE_INTERVAL).cast("bigint"))


def runs_vec(spark: SparkSession, sf_dir: str, trim_prompt: bool = False, ranked: bool = False) -> DataFrame:
    """V2: one run row per (generation, temp).

    Columns: gen_id, prompt, temp, seq_len, ned_mean, ned_std, model,
    model_size, domain; with ``ranked`` also rank and chkpt_id (an ordering of
    the whole table, so only for those who read it).
    """
    from ..operators.reduce import reduce_generation

    pos = position_metrics(spark, sf_dir, trim_prompt)
    runs = reduce_generation(pos, ["gen_id", "temp"], "ned")
    models = F.array(*[F.lit(m) for m in MODELS])
    domains = F.array(*[F.lit(d) for d in DOMAINS])
    runs = runs.select(
        "gen_id",
        "temp",
        "seq_len",
        "ned_mean",
        "ned_std",
        F.element_at(models, (F.col("gen_id") % 3 + 1).cast("int")).alias("model"),
        F.element_at(
            domains, (F.floor(F.col("gen_id") / 3) % 4 + 1).cast("int")
        ).alias("domain"),
    )
    runs = runs.withColumn("model_size", model_size("model")).withColumn(
        "prompt", F.concat(F.col("domain"), F.lit(": generation "), F.col("gen_id").cast("string"))
    )
    return with_rank(runs, ["temp", "gen_id"]) if ranked else runs


def doc_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents split into lower-case words: doc_id, lang, source, word."""
    docs = table(spark, sf_dir, "documents")
    return (
        docs.select(
            "doc_id",
            "lang",
            "source",
            # explode_outer: no inferred size(split(..)) filter splitting twice
            F.explode_outer(lower_words("text")).alias("word"),
        )
        .where(F.col("word").isNotNull())
    )


def doc_word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, word, cnt): the per-document distribution."""
    return doc_words(spark, sf_dir).groupBy("doc_id", "lang", "source", "word").agg(
        F.count(F.lit(1)).alias("cnt")
    )


def runs_docs(
    spark: SparkSession, sf_dir: str, token_counts: DataFrame | None = None, ranked: bool = False, temps=TEMPS
) -> DataFrame:
    """V3: one run row per (document, temp); rank and chkpt_id with ``ranked``.

    The word counts of a document are its distribution, ln(count) its scores;
    tempering gives p ~ count^(1/temp). ned uses the number of distinct words
    as the width (one-word documents: NULL).
    """
    from ..operators.reduce import item_counts, ned_from_counts_temps

    if token_counts is None:
        # the words are counted inside the documents and only the counts go on; lang
        # and source are attached to the per-document result (one row per document
        # and temperature). Rows without id find no document there
        docs = table(spark, sf_dir, "documents")
        wc = item_counts(docs.where(F.col("doc_id").isNotNull()), ["doc_id"], lower_words("text"), item=None)
        per_doc = ned_from_counts_temps(wc, ["doc_id"], "cnt", temps).join(
            docs.select("doc_id", "lang", "source"), "doc_id"
        )
    else:  # shared tokenisation (see operators.vocab.doc_token_counts)
        wc = token_counts.select("doc_id", F.col("language").alias("lang"), "source", "cnt")
        per_doc = ned_from_counts_temps(wc, ["doc_id", "lang", "source"], "cnt", temps)
    runs = per_doc.select(
        "doc_id",
        "temp",
        F.col("n_total").alias("seq_len"),
        F.col("ned").alias("ned_mean"),
        F.lit(0.0).alias("ned_std"),
        F.col("source").alias("domain"),
        F.col("lang").alias("language"),
    )
    return with_rank(runs, ["temp", "doc_id"]) if ranked else runs


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V5: user_id, ts, event_id, value."""
    return table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value")


def prompt_lines(spark: SparkSession, sf_dir: str, domain_roles=None) -> DataFrame:
    """V7: each turn as a JSON prompt line and as plain text lines, in ``value``.

    The role is the domain; with ``domain_roles`` only those roles carry one
    (the other JSON lines are domain-less, which A1 drops and A1b keeps).
    """
    conv = table(spark, sf_dir, "conversations")
    domain = F.col("role") if domain_roles is None else F.when(F.col("role").isin(*domain_roles), F.col("role"))
    as_json = conv.select(
        F.to_json(F.struct(domain.alias("domain"), F.col("text").alias("prompt"))).alias("value")
    )
    as_text = conv.select(F.explode(F.split(F.col("text"), "\n")).alias("value"))
    return as_json.unionByName(as_text)
