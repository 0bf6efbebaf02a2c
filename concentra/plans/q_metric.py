"""Registered queries of the metric and its reductions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import metric
from ..operators.reduce import ned_from_counts, profile, reduce_generation
from ..sources import fixtures as fx
from .registry import register, rounded
from .sqlparts import DOC_WORDS, POS_NED, TEMPS_SQL, runs_vec_sql, with_ctes

_V1T = f"""
v1 AS (
  SELECT CAST(floor(vec_id / 5) AS BIGINT) AS gen_id, CAST(vec_id % 5 AS INTEGER) AS pos,
         list_transform(embedding, lambda x: CAST(x AS DOUBLE) * 20.0) AS scores
  FROM embeddings),
v1t AS (
  SELECT gen_id, pos, t.temp, scores, list_max(scores) AS m
  FROM v1, {TEMPS_SQL} t(temp)),
v1s AS (
  SELECT gen_id, pos, temp, scores, m,
         list_reduce(scores, lambda acc, v: acc + exp((v - m) / temp), 0.0::DOUBLE) AS s
  FROM v1t)"""


def _v1t(spark, sf_dir):
    return fx.score_positions(spark, sf_dir).select(
        "gen_id", "pos", fx.temps_col().alias("temp"), "scores"
    )


@register(
    "c1_softmax",
    doubles=["temp", "p_max", "p_sum"],
    sql=    with_ctes(
        _V1T,
        body="""
SELECT gen_id, pos, temp,
       list_max(list_transform(scores, lambda v: exp((v - m) / temp) / s)) AS p_max,
       list_reduce(list_transform(scores, lambda v: exp((v - m) / temp) / s), lambda a, b: a + b, 0.0::DOUBLE) AS p_sum
FROM v1s""",
    ),
)
def c1_softmax(spark, sf_dir):
    d = _v1t(spark, sf_dir).withColumn("p", metric.softmax("scores", "temp"))
    return rounded(
        d.select(
            "gen_id",
            "pos",
            "temp",
            F.array_max("p").alias("p_max"),
            F.aggregate("p", F.lit(0.0), lambda a, b: a + b).alias("p_sum"),
        )
    )


@register(
    "c2_ned",
    doubles=["temp", "ned"],
    sql=    with_ctes(POS_NED, body="SELECT gen_id, pos, temp, ned FROM pos_ned"),
)
def c2_ned(spark, sf_dir):
    return rounded(fx.position_metrics(spark, sf_dir))


@register(
    "c3_temper",
    doubles=["temp", "t_max", "t_sum"],
    sql=    with_ctes(
        _V1T,
        body="""
SELECT gen_id, pos, temp,
       list_max(list_transform(scores, lambda v: v / temp)) AS t_max,
       list_reduce(list_transform(scores, lambda v: v / temp), lambda a, b: a + b, 0.0::DOUBLE) AS t_sum
FROM v1t""",
    ),
)
def c3_temper(spark, sf_dir):
    d = _v1t(spark, sf_dir).withColumn("t", metric.temper("scores", "temp"))
    return rounded(
        d.select(
            "gen_id",
            "pos",
            "temp",
            F.array_max("t").alias("t_max"),
            F.aggregate("t", F.lit(0.0), lambda a, b: a + b).alias("t_sum"),
        )
    )


@register(
    "c4_argmax",
    sql=    with_ctes(
        _V1T,
        body="SELECT gen_id, pos, CAST(list_position(scores, list_max(scores)) - 1 AS BIGINT) AS token_id FROM v1",
    ),
)
def c4_argmax(spark, sf_dir):
    v1 = fx.score_positions(spark, sf_dir)
    return v1.select("gen_id", "pos", metric.argmax_token("scores").alias("token_id"))


@register(
    "c5_topk_mass",
    doubles=["temp", "mass_top_1", "mass_top_5", "mass_top_20"],
    sql=    with_ctes(
        _V1T,
        """
v1p AS (
  SELECT gen_id, pos, temp,
         list_reverse_sort(list_transform(scores, lambda v: exp((v - m) / temp) / s)) AS p
  FROM v1s),
v1k AS (
  SELECT gen_id, temp,
         avg(list_reduce(list_slice(p, 1, 1), lambda a, b: a + b, 0.0::DOUBLE)) AS m1,
         avg(list_reduce(list_slice(p, 1, 5), lambda a, b: a + b, 0.0::DOUBLE)) AS m5,
         avg(list_reduce(list_slice(p, 1, 20), lambda a, b: a + b, 0.0::DOUBLE)) AS m20
  FROM v1p GROUP BY gen_id, temp)""",
        body="SELECT temp, avg(m1) AS mass_top_1, avg(m5) AS mass_top_5, avg(m20) AS mass_top_20 FROM v1k GROUP BY temp",
    ),
)
def c5_topk_mass(spark, sf_dir):
    """Mean over positions, then over generations (unweighted), per temperature."""
    d = fx.score_positions(spark, sf_dir).select("gen_id", F.inline(metric.topk_masses("scores", (1, 5, 20), fx.TEMPS)))
    per_gen = d.groupBy("gen_id", "temp").agg(*[F.avg(f"m{k}").alias(f"m{k}") for k in (1, 5, 20)])
    return rounded(
        per_gen.groupBy("temp").agg(*[F.avg(f"m{k}").alias(f"mass_top_{k}") for k in (1, 5, 20)])
    )


@register(
    "c6_reduce_generation",
    doubles=["temp", "ned_mean", "ned_std"],
    sql=    with_ctes(
        POS_NED,
        body="SELECT gen_id, temp, avg(ned) AS ned_mean, stddev_pop(ned) AS ned_std, count(*) AS seq_len FROM pos_ned GROUP BY gen_id, temp",
    ),
)
def c6_reduce_generation(spark, sf_dir):
    return rounded(reduce_generation(fx.position_metrics(spark, sf_dir), ["gen_id", "temp"]))


@register(
    "c7_ned_from_counts",
    doubles=["ned"],
    sql=    with_ctes(
        DOC_WORDS,
        """
lang_wc AS (SELECT lang, word, count(*) AS cnt FROM doc_words GROUP BY lang, word)""",
        body="""
SELECT lang, CAST(sum(cnt) AS BIGINT) AS n_total, CAST(count(*) AS BIGINT) AS n_items,
       1 + (sum(cnt * ln(cnt)) / sum(cnt) - ln(sum(cnt))) / nullif(ln(CAST(count(*) AS DOUBLE)), 0) AS ned
FROM lang_wc GROUP BY lang""",
    ),
)
def c7_ned_from_counts(spark, sf_dir):
    """Corpus baseline: the metric of each language's word-frequency table."""
    words = fx.doc_words(spark, sf_dir)
    counts = words.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("cnt"))
    return rounded(ned_from_counts(counts, ["lang"], "cnt"))


@register(
    "c8_perplexity",
    doubles=["temp", "entropy", "perplexity"],
    sql=    with_ctes(
        POS_NED,
        runs_vec_sql(),
        body="""
SELECT gen_id, temp, (1 - ned_mean) * ln(64.0) AS entropy, exp((1 - ned_mean) * ln(64.0)) AS perplexity
FROM runs""",
    ),
)
def c8_perplexity(spark, sf_dir):
    runs = reduce_generation(fx.position_metrics(spark, sf_dir), ["gen_id", "temp"])
    return rounded(
        runs.select(
            "gen_id",
            "temp",
            metric.entropy_from_ned("ned_mean", 64).alias("entropy"),
            metric.perplexity_from_ned("ned_mean", 64).alias("perplexity"),
        )
    )


@register(
    "c9_profile",
    doubles=["temp", "mean", "std"],
    sql=    with_ctes(
        POS_NED,
        runs_vec_sql(),
        body="""
SELECT temp, domain, avg(ned_mean) AS mean, stddev_samp(ned_mean) AS std, CAST(count(ned_mean) AS BIGINT) AS n,
       CAST(GROUPING(temp, domain) AS BIGINT) AS level
FROM runs GROUP BY ROLLUP (temp, domain)""",
    ),
)
def c9_profile(spark, sf_dir):
    return rounded(profile(fx.runs_vec(spark, sf_dir), ["temp", "domain"], margins="rollup"))


@register(
    "c9_profile_model",
    doubles=["mean", "std"],
    sql=    with_ctes(
        POS_NED,
        runs_vec_sql(),
        body="""
SELECT model, model_size, avg(ned_mean) AS mean, stddev_samp(ned_mean) AS std, CAST(count(ned_mean) AS BIGINT) AS n
FROM runs GROUP BY model, model_size""",
    ),
)
def c9_profile_model(spark, sf_dir):
    return rounded(profile(fx.runs_vec(spark, sf_dir), ["model", "model_size"]))


@register(
    "c9_profile_cube",
    sql=with_ctes(
        POS_NED,
        runs_vec_sql(),
        body="""
SELECT temp, model, avg(ned_mean) AS mean, stddev_samp(ned_mean) AS std, CAST(count(ned_mean) AS BIGINT) AS n,
       CAST(GROUPING(temp, model) AS BIGINT) AS level
FROM runs GROUP BY CUBE (temp, model)""",
    ),
    doubles=["temp", "mean", "std"],
)
def c9_profile_cube(spark, sf_dir):
    """All margins of temperature x model in one aggregation."""
    return rounded(profile(fx.runs_vec(spark, sf_dir), ["temp", "model"], margins="cube"))


@register(
    "c2_ned_arrow",
    with_ctes(POS_NED, body="SELECT gen_id, pos, temp, ned FROM pos_ned"),
    doubles=["temp", "ned"],
)
def c2_ned_arrow(spark, sf_dir):
    """C2 through the Arrow/numpy path (the one for 32K-256K wide vectors)."""
    d = _v1t(spark, sf_dir)
    return rounded(d.select("gen_id", "pos", "temp", metric.ned_arrow(F.col("scores"), F.col("temp")).alias("ned")))


@register(
    "c5_topk_mass_arrow",
    doubles=["temp", "mass_top_1", "mass_top_5", "mass_top_20"],
    sql=with_ctes(
        _V1T,
        """
v1p AS (
  SELECT gen_id, pos, temp,
         list_reverse_sort(list_transform(scores, lambda v: exp((v - m) / temp) / s)) AS p
  FROM v1s),
v1k AS (
  SELECT gen_id, temp,
         avg(list_reduce(list_slice(p, 1, 1), lambda a, b: a + b, 0.0::DOUBLE)) AS m1,
         avg(list_reduce(list_slice(p, 1, 5), lambda a, b: a + b, 0.0::DOUBLE)) AS m5,
         avg(list_reduce(list_slice(p, 1, 20), lambda a, b: a + b, 0.0::DOUBLE)) AS m20
  FROM v1p GROUP BY gen_id, temp)""",
        body="SELECT temp, avg(m1) AS mass_top_1, avg(m5) AS mass_top_5, avg(m20) AS mass_top_20 FROM v1k GROUP BY temp",
    ),
)
def c5_topk_mass_arrow(spark, sf_dir):
    """C5 with a partial selection (numpy argpartition) on Arrow batches."""
    d = _v1t(spark, sf_dir).select(
        "gen_id",
        "temp",
        *[metric.topk_mass_arrow(F.col("scores"), F.col("temp"), F.lit(k)).alias(f"m{k}") for k in (1, 5, 20)],
    )
    per_gen = d.groupBy("gen_id", "temp").agg(*[F.avg(f"m{k}").alias(f"m{k}") for k in (1, 5, 20)])
    return rounded(per_gen.groupBy("temp").agg(*[F.avg(f"m{k}").alias(f"mass_top_{k}") for k in (1, 5, 20)]))
