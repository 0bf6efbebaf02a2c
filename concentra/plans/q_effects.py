"""Registered queries of the comparative statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.tails import with_p_value
from ..operators import effects as ef
from ..operators import stats as st
from ..session import table
from ..sources import fixtures as fx
from . import sqlstats as q
from .registry import register, rounded
from .q_tests import DOCS9, DOCS_BATTERY, KIND_SQL, battery_by_model_sql, battery_sql, docs_runs, p_sql
from .sqlparts import DOC_WORDS, POS_NED, RUNS_DOCS, runs_vec_sql, with_ctes
from .sqltails import exact, ks_log, phi, with_p

RUNS_CTES = (POS_NED, runs_vec_sql())
DOCS_CTES = (DOC_WORDS, RUNS_DOCS)

# Category of each run domain for E1 (the code domain plays the neutral set).
CATEGORIES = {"code": "neutral", "wiki": "semantic", "news": "semantic", "fiction": "semantic"}


def _runs(s, d, ranked=False):
    return fx.runs_vec(s, d, ranked=ranked)


@register(
    "e1_intrinsic_fraction",
    with_ctes(
        *RUNS_CTES,
        body="""
SELECT model, neutral_mean, semantic_mean, neutral_mean / nullif(semantic_mean, 0) AS intrinsic_fraction FROM (
  SELECT model, avg(CASE WHEN domain = 'code' THEN ned_mean END) AS neutral_mean,
         avg(CASE WHEN domain IN ('wiki', 'news', 'fiction') THEN ned_mean END) AS semantic_mean
  FROM runs GROUP BY model)""",
    ),
    doubles=["neutral_mean", "semantic_mean", "intrinsic_fraction"],
)
def e1_intrinsic_fraction(spark, sf_dir):
    return rounded(ef.intrinsic_fraction(_runs(spark, sf_dir), "ned_mean", "model", "domain", CATEGORIES))


def _spearman_pairs_sql(prof: str) -> str:
    return f"""
pairs AS (SELECT a.u AS u1, b.u AS u2, a.item, a.m AS x, b.m AS y FROM {prof} a JOIN {prof} b ON a.item = b.item AND a.u < b.u),
pr AS (SELECT u1, u2,
              rank() OVER (PARTITION BY u1, u2 ORDER BY x) + (count(*) OVER (PARTITION BY u1, u2, x) - 1) / 2.0 AS rx,
              rank() OVER (PARTITION BY u1, u2 ORDER BY y) + (count(*) OVER (PARTITION BY u1, u2, y) - 1) / 2.0 AS ry
       FROM pairs)"""


@register(
    "e2_profile_similarity",
    with_ctes(
        *RUNS_CTES,
        "prof AS (SELECT model AS u, domain AS item, round(avg(ned_mean), 9) AS m FROM runs GROUP BY model, domain)",
        _spearman_pairs_sql("prof"),
        body="""
SELECT u1 AS unit1, u2 AS unit2, CAST(count(*) AS BIGINT) AS n_items,
       regr_sxy(ry, rx) / nullif(sqrt(regr_sxx(ry, rx) * regr_syy(ry, rx)), 0) AS rho
FROM pr GROUP BY u1, u2""",
    ),
    doubles=["rho"],
)
def e2_profile_similarity(spark, sf_dir):
    return rounded(ef.profile_similarity(_runs(spark, sf_dir), "ned_mean", "model", "domain"))


@register(
    "e2_profile_similarity_baseline",
    with_ctes(
        *RUNS_CTES,
        "prof AS (SELECT model AS u, domain AS item, round(avg(ned_mean), 9) AS m FROM runs GROUP BY model, domain)",
        _spearman_pairs_sql("prof"),
        body=f"""
SELECT u1 AS unit1, u2 AS unit2, CAST(count(*) AS BIGINT) AS n_items,
       regr_sxy(ry, rx) / nullif(sqrt(regr_sxx(ry, rx) * regr_syy(ry, rx)), 0) AS rho
FROM pr WHERE u1 = '{fx.MODELS[0]}' GROUP BY u1, u2""",
    ),
    doubles=["rho"],
)
def e2_profile_similarity_baseline(spark, sf_dir):
    """One model against every other: linear in the models."""
    return rounded(ef.profile_similarity(_runs(spark, sf_dir), "ned_mean", "model", "domain", baseline=fx.MODELS[0]))


def _cohens_sql(src: str, y: str, by: str, base: str) -> str:
    return f"""
SELECT "group", CAST(n AS BIGINT) AS n, mean,
       (mean - bm) / nullif(sqrt(((n - 1) * var + (bn - 1) * bv) / nullif(n + bn - 2, 0)), 0) AS d
FROM (SELECT *, max(CASE WHEN "group" = '{base}' THEN mean END) OVER () AS bm,
                max(CASE WHEN "group" = '{base}' THEN n END) OVER () AS bn,
                max(CASE WHEN "group" = '{base}' THEN var END) OVER () AS bv
      FROM (SELECT {by} AS "group", count(*) AS n, avg({y}) AS mean, var_samp({y}) AS var
            FROM {src} WHERE {by} IS NOT NULL AND {y} IS NOT NULL AND NOT isnan({y}) GROUP BY {by}))"""


@register(
    "e3_cohens_d",
    with_ctes(*DOCS_CTES, body=_cohens_sql("runs_docs", "ned_mean", "language", "en")),
    doubles=["mean", "d"],
)
def e3_cohens_d(spark, sf_dir):
    return rounded(ef.cohens_d(fx.runs_docs(spark, sf_dir), "ned_mean", "language", "en"))


_MW_CTE = """
mw AS (SELECT language AS g, round(ned_mean, 9) AS v FROM runs_docs WHERE ned_mean IS NOT NULL AND language IS NOT NULL),
gp AS (SELECT a.g AS g1, b.g AS g2 FROM (SELECT DISTINCT g FROM mw) a JOIN (SELECT DISTINCT g FROM mw) b ON a.g < b.g),
pooled AS (SELECT gp.g1, gp.g2, mw.g, mw.v FROM mw JOIN gp ON mw.g = gp.g1 OR mw.g = gp.g2),
rk AS (SELECT *, rank() OVER (PARTITION BY g1, g2 ORDER BY v) + (count(*) OVER (PARTITION BY g1, g2, v) - 1) / 2.0 AS r FROM pooled),
ties AS (SELECT g1, g2, sum(CAST(t AS DOUBLE) * t * t - t) AS ties FROM (SELECT g1, g2, v, count(*) AS t FROM pooled GROUP BY ALL) GROUP BY g1, g2),
agg AS (SELECT rk.g1, rk.g2, sum(CASE WHEN g = rk.g1 THEN r END) AS r1,
               CAST(sum(CASE WHEN g = rk.g1 THEN 1 ELSE 0 END) AS DOUBLE) AS n1,
               CAST(sum(CASE WHEN g = rk.g2 THEN 1 ELSE 0 END) AS DOUBLE) AS n2
        FROM rk GROUP BY rk.g1, rk.g2)"""
_MW_BODY = """
SELECT a.g1 AS group1, a.g2 AS group2, CAST(n1 AS BIGINT) AS n1, CAST(n2 AS BIGINT) AS n2,
       r1 - n1 * (n1 + 1) / 2.0 AS u,
       CASE WHEN sigma > 0 THEN greatest((abs(r1 - n1 * (n1 + 1) / 2.0 - n1 * n2 / 2.0) - 0.5) / nullif(sigma, 0), 0.0) END AS z
FROM (SELECT agg.*, sqrt(n1 * n2 / 12.0 * ((n1 + n2 + 1) - ties.ties / nullif((n1 + n2) * (n1 + n2 - 1), 0))) AS sigma
      FROM agg JOIN ties ON agg.g1 = ties.g1 AND agg.g2 = ties.g2) a"""


@register("e4_mann_whitney", with_ctes(*DOCS_CTES, _MW_CTE, body=_MW_BODY), doubles=["u", "z"])
def e4_mann_whitney(spark, sf_dir):
    runs = fx.runs_docs(spark, sf_dir).withColumn("ned_mean", F.round("ned_mean", 9))
    return rounded(ef.mann_whitney(runs, "ned_mean", "language"))


@register(
    "e4_mann_whitney_p",
    with_ctes(*DOCS_CTES, _MW_CTE, body=with_p(_MW_BODY, "'z'", stat="z", df1="NULL", df2="NULL")),
    doubles=["u", "z", "p_value", "log10_p"],
)
def e4_mann_whitney_p(spark, sf_dir):
    runs = fx.runs_docs(spark, sf_dir).withColumn("ned_mean", F.round("ned_mean", 9))
    return rounded(with_p_value(ef.mann_whitney(runs, "ned_mean", "language"), "z", stat="z", df1=None, df2=None))


@register(
    "e5_residual_cohens_d",
    with_ctes(
        *DOCS_CTES,
        """
coef AS (SELECT regr_slope(ned_mean, seq_len) AS b, regr_intercept(ned_mean, seq_len) AS a
         FROM runs_docs WHERE ned_mean IS NOT NULL AND NOT isnan(ned_mean)),
res AS (SELECT language, ned_mean - (coef.a + coef.b * seq_len) AS residual FROM runs_docs, coef)""",
        body=_cohens_sql("res", "residual", "language", "en"),
    ),
    doubles=["mean", "d"],
)
def e5_residual_cohens_d(spark, sf_dir):
    r = ef.residualize(fx.runs_docs(spark, sf_dir), "ned_mean", "seq_len")
    return rounded(ef.cohens_d(r, "residual", "language", "en"))


@register(
    "e6_paired_ttest",
    with_ctes(
        *RUNS_CTES,
        """
diffs AS (SELECT avg(CASE WHEN temp = 0.7 THEN ned_mean END) - avg(CASE WHEN temp = 1.3 THEN ned_mean END) AS diff
          FROM runs GROUP BY gen_id)""",
        body=q.f1("(SELECT diff FROM diffs WHERE diff IS NOT NULL)", "diff", "E6"),
    ),
)
def e6_paired_ttest(spark, sf_dir):
    return rounded(ef.paired_ttest(_runs(spark, sf_dir), "ned_mean", ["gen_id"], "temp", 0.7, 1.3))


@register("e7_ols_log_size", with_ctes(*RUNS_CTES, body=q.f3("runs", "ned_mean", "model_size", "E7", transform="ln")))
def e7_ols_log_size(spark, sf_dir):
    return rounded(st.ols(_runs(spark, sf_dir), "ned_mean", "model_size", test_id="E7", transform="ln"))


@register("e7_ols_log_size_p", with_ctes(*RUNS_CTES, body=p_sql(q.f3("runs", "ned_mean", "model_size", "E7", transform="ln"))))
def e7_ols_log_size_p(spark, sf_dir):
    s = st.ols(_runs(spark, sf_dir), "ned_mean", "model_size", test_id="E7", transform="ln")
    return rounded(with_p_value(s, "t"))


def _dw_sql(src: str, y: str, by: str, order: str) -> str:
    return f"""
SELECT ssd / nullif(ssr, 0) AS dw, CAST(n_pairs AS BIGINT) AS n_pairs, CAST(n AS BIGINT) AS n FROM
  (SELECT sum((cur - prev) * (cur - prev)) AS ssd, count(*) AS n_pairs FROM (
     SELECT {y} AS cur, lag({y}) OVER (PARTITION BY {by} ORDER BY {order}) AS prev FROM {src})
   WHERE prev IS NOT NULL AND cur IS NOT NULL) a,
  (SELECT sum(vp * n) AS ssr, sum(n) AS n FROM (SELECT var_pop({y}) AS vp, count(*) AS n FROM {src} WHERE {y} IS NOT NULL GROUP BY {by})) b"""


@register("e8_durbin_watson_events", _dw_sql("events", "value", "user_id", "ts, event_id"), doubles=["dw"])
def e8_durbin_watson_events(spark, sf_dir):
    return rounded(ef.durbin_watson(fx.series(spark, sf_dir), "value", ["user_id"], ["ts", "event_id"]))


@register("e8_durbin_watson_runs", with_ctes(*RUNS_CTES, body=_dw_sql("runs", "ned_mean", "chkpt_id", "rank")), doubles=["dw"])
def e8_durbin_watson_runs(spark, sf_dir):
    return rounded(ef.durbin_watson(_runs(spark, sf_dir, ranked=True), "ned_mean", ["chkpt_id"], ["rank"]))


@register(
    "e9_temp_response",
    with_ctes(
        *RUNS_CTES,
        body="""
SELECT lo_temp, hi_temp, mean_lo, mean_hi, (mean_hi - mean_lo) / nullif(mean_lo, 0) * 100.0 AS pct_change, r FROM
  (SELECT min(temp) AS lo_temp, max(temp) AS hi_temp, arg_min(m, temp) AS mean_lo, arg_max(m, temp) AS mean_hi
   FROM (SELECT temp, avg(ned_mean) AS m FROM runs WHERE temp IS NOT NULL GROUP BY temp)) a,
  (SELECT regr_sxy(ned_mean, temp) / nullif(sqrt(regr_sxx(ned_mean, temp) * regr_syy(ned_mean, temp)), 0) AS r FROM runs) b""",
    ),
    doubles=["lo_temp", "hi_temp", "mean_lo", "mean_hi", "pct_change", "r"],
)
def e9_temp_response(spark, sf_dir):
    return rounded(ef.temp_response(_runs(spark, sf_dir)))


@register(
    "e10_spread_comparison",
    with_ctes(*RUNS_CTES, body="SELECT model, avg(ned_std) AS mean_spread, CAST(count(*) AS BIGINT) AS n FROM runs GROUP BY model"),
    doubles=["mean_spread"],
)
def e10_spread_comparison(spark, sf_dir):
    return rounded(ef.spread_comparison(_runs(spark, sf_dir)))


def _ks_sql(src: str, x: str, by: str) -> str:
    return f"""
ksv AS (SELECT {by} AS g, CAST({x} AS DOUBLE) AS v FROM {src} WHERE {x} IS NOT NULL AND NOT isnan(CAST({x} AS DOUBLE))),
ksm AS (SELECT g, count(*) AS n, avg(v) AS mu, stddev_pop(v) AS sd FROM ksv GROUP BY g),
ksr AS (SELECT g, v, cnt, lt FROM (
          SELECT g, v, count(*) OVER (PARTITION BY g, v) AS cnt, rank() OVER (PARTITION BY g ORDER BY v) - 1 AS lt FROM ksv)
        GROUP BY ALL),
ks AS (SELECT ksr.g, max(greatest((lt + cnt) / n - phi, phi - lt / n)) AS d, CAST(max(n) AS BIGINT) AS n FROM (
         SELECT *, {phi('z')} AS phi FROM (
           SELECT ksr.*, ksm.n, (v - mu) / nullif(sd, 0) AS z FROM ksr JOIN ksm ON ksr.g = ksm.g)) ksr
       GROUP BY ksr.g)"""


@register(
    "e11_ks_normal",
    with_ctes(_ks_sql("events", "value", "event_type"), body="SELECT g AS event_type, d, n FROM ks"),
    doubles=["d"],
)
def e11_ks_normal(spark, sf_dir):
    return rounded(ef.ks_normal(table(spark, sf_dir, "events"), "value", ["event_type"]))


@register(
    "e11_ks_normal_p",
    with_ctes(
        _ks_sql("events", "value", "event_type"),
        body=f"SELECT event_type, d, n, exp(lp) AS p_value, lp / ln(10.0) AS log10_p FROM (SELECT g AS event_type, d, n, {ks_log('d', 'n')} AS lp FROM ks)",
    ),
    doubles=["d", "p_value", "log10_p"],
)
def e11_ks_normal_p(spark, sf_dir):
    d = ef.ks_normal(table(spark, sf_dir, "events"), "value", ["event_type"])
    return rounded(with_p_value(d, "ks", stat="d", df1="n", df2=None))


@register(
    "e12_ks_vs_metric",
    with_ctes(
        _ks_sql("events", "value", "user_id"),
        "km AS (SELECT user_id AS g, avg(value) AS mean FROM events GROUP BY user_id)",
        body="""
SELECT CAST(count(*) AS BIGINT) AS n_groups,
       regr_sxy(mean, d) / nullif(sqrt(regr_sxx(mean, d) * regr_syy(mean, d)), 0) AS r
FROM ks JOIN km ON ks.g = km.g""",
    ),
    doubles=["r"],
)
def e12_ks_vs_metric(spark, sf_dir):
    return rounded(ef.ks_vs_metric(table(spark, sf_dir, "events"), "value", ["user_id"]))


def _reports(spark, sf_dir):
    vec = st.battery(fx.runs_vec(spark, sf_dir, trim_prompt=True, ranked=True)).withColumn("model", F.lit("vec"))
    docs = st.battery(docs_runs(spark, sf_dir)).withColumn("model", F.lit("docs"))
    return vec.unionByName(docs)


def _reports_sql() -> str:
    vec = with_p(exact(battery_sql("runs_t")), KIND_SQL)
    docs = with_p(exact(DOCS_BATTERY), KIND_SQL)
    return f"(SELECT 'vec' AS model, * FROM ({vec}) UNION ALL SELECT 'docs', * FROM ({docs}))"


_REPORT_CTES = (POS_NED, runs_vec_sql("pos_trim", "runs_t"), DOC_WORDS, RUNS_DOCS, DOCS9)


def _consensus_sql(src: str) -> str:
    return f"""
SELECT model, n_significant, n_tests,
       CASE WHEN n_significant >= 8 THEN 'strong' WHEN n_significant >= 6 THEN 'moderate' WHEN n_significant >= 4 THEN 'weak' ELSE 'none' END AS verdict
FROM (SELECT model, CAST(sum(CASE WHEN p_value < 0.01 THEN 1 ELSE 0 END) AS BIGINT) AS n_significant, CAST(count(*) AS BIGINT) AS n_tests
      FROM {src} GROUP BY model)"""


@register("e13_consensus", with_ctes(*_REPORT_CTES, body=_consensus_sql(_reports_sql())))
def e13_consensus(spark, sf_dir):
    return ef.consensus(_reports(spark, sf_dir))


@register(
    "e13_consensus_matrix",
    with_ctes(
        *_REPORT_CTES,
        body="SELECT test_id, bool_or(p_value < 0.01) FILTER (model = 'vec') AS vec, bool_or(p_value < 0.01) FILTER (model = 'docs') AS docs "
        f"FROM {_reports_sql()} GROUP BY test_id",
    ),
)
def e13_consensus_matrix(spark, sf_dir):
    return ef.consensus_matrix(_reports(spark, sf_dir), ["vec", "docs"])


@register(
    "e13_consensus_by_model",
    with_ctes(POS_NED, runs_vec_sql("pos_trim", "runs_t"), body=_consensus_sql(f"({with_p(exact(battery_by_model_sql('runs_t')), KIND_SQL)})")),
)
def e13_consensus_by_model(spark, sf_dir):
    """Consensus over the per-model batteries (one grouped battery)."""
    rep = st.battery(fx.runs_vec(spark, sf_dir, trim_prompt=True, ranked=True), groups=["model"])
    return ef.consensus(rep)


@register(
    "e14_effect_gate",
    with_ctes(
        POS_NED,
        runs_vec_sql("pos_trim", "runs_t"),
        body=f"""
SELECT test_id, estimate, p_value, coalesce(sig, false) AS significant, coalesce(eff, false) AS effect_ok, coalesce(sig AND eff, false) AS rejected
FROM (SELECT *, p_value < 0.01 AS sig,
             CASE WHEN test_id IN ('F4', 'F6') THEN abs(estimate) > 0.1 WHEN test_id IN ('F3', 'F8') THEN estimate > 0 ELSE true END AS eff
      FROM ({with_p(exact(battery_sql("runs_t")), KIND_SQL)}))""",
    ),
    doubles=["estimate", "p_value"],
)
def e14_effect_gate(spark, sf_dir):
    rep = st.battery(fx.runs_vec(spark, sf_dir, trim_prompt=True, ranked=True))
    return rounded(ef.effect_gate(rep).select("test_id", "estimate", "p_value", "significant", "effect_ok", "rejected"))


@register(
    "e15_pair_bias",
    """
SELECT user_id, CAST(n AS BIGINT) AS n, n_a / n AS share, abs(n_a / n - 0.5) > 2.576 * sqrt(0.25 / n) AS biased FROM (
  SELECT user_id, CAST(sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS DOUBLE) AS n_a,
         CAST(sum(CASE WHEN event_type IN ('click', 'view') THEN 1 ELSE 0 END) AS DOUBLE) AS n
  FROM events GROUP BY user_id)
WHERE n > 0""",
    doubles=["share"],
)
def e15_pair_bias(spark, sf_dir):
    return rounded(ef.pair_bias(table(spark, sf_dir, "events"), "user_id", "event_type", "click", "view"))


@register(
    "e16_entropy_slope",
    with_ctes(
        POS_NED,
        body="""
SELECT gen_id, temp, regr_slope(ned, CAST(pos AS DOUBLE)) AS slope, regr_r2(ned, CAST(pos AS DOUBLE)) AS r2,
       CAST(count(*) AS BIGINT) AS n
FROM pos_ned GROUP BY gen_id, temp""",
    ),
    doubles=["temp", "slope", "r2"],
)
def e16_entropy_slope(spark, sf_dir):
    return rounded(ef.entropy_slope(fx.position_metrics(spark, sf_dir), ["gen_id", "temp"]))


def _mi_sql(src: str, a: str, b: str) -> str:
    return f"""
SELECT mi, 2.0 * nn * mi AS g, CAST((r - 1) * (c - 1) AS DOUBLE) AS df1, CAST(nn AS BIGINT) AS n FROM (
  SELECT (sab - sa - sb) / nn + ln(nn) AS mi, nn, r, c FROM
    (SELECT sum(n * ln(n)) AS sab, CAST(sum(n) AS DOUBLE) AS nn FROM (SELECT count(*) AS n FROM {src} WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY {a}, {b})) j,
    (SELECT sum(n * ln(n)) AS sa, count(*) AS r FROM (SELECT count(*) AS n FROM {src} WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY {a})) ma,
    (SELECT sum(n * ln(n)) AS sb, count(*) AS c FROM (SELECT count(*) AS n FROM {src} WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY {b})) mb)"""


@register("e17_mutual_information_lineitem", _mi_sql("lineitem", "l_returnflag", "l_linestatus"), doubles=["mi", "g"])
def e17_mutual_information_lineitem(spark, sf_dir):
    return rounded(ef.mutual_information(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus"))


@register("e17_mutual_information_events", _mi_sql("events", "user_id", "event_type"), doubles=["mi", "g"])
def e17_mutual_information_events(spark, sf_dir):
    return rounded(ef.mutual_information(table(spark, sf_dir, "events"), "user_id", "event_type"))


@register(
    "e17_mutual_information_events_p",
    with_p(_mi_sql("events", "user_id", "event_type"), "'chi2'", stat="g", df2="NULL"),
    doubles=["mi", "g", "p_value", "log10_p"],
)
def e17_mutual_information_events_p(spark, sf_dir):
    m = ef.mutual_information(table(spark, sf_dir, "events"), "user_id", "event_type")
    return rounded(with_p_value(m, "chi2", stat="g", df1="df1", df2=None))


def _pca_ctes(k: int = 3, squarings: int = 14) -> list[str]:
    """Principal axes in SQL: the covariance is squared until it has the first axis in every
    column; then that axis is taken out and the rest squared again."""
    ctes = [
        "x AS (SELECT row_number() OVER () AS r, label, embedding FROM embeddings)",
        "e AS MATERIALIZED (SELECT r, label, unnest(range(1, len(embedding) + 1)) AS i, unnest(embedding)::DOUBLE AS v FROM x)",
        "mu AS (SELECT i, avg(v) AS m FROM e GROUP BY i)",
        "c AS MATERIALIZED (SELECT e.r, e.i, v - m AS v FROM e JOIN mu USING (i))",
        "cov0 AS MATERIALIZED (SELECT a.i, b.i AS j, sum(a.v * b.v) / ((SELECT count(*) FROM x) - 1) AS v FROM c a JOIN c b ON a.r = b.r GROUP BY a.i, b.i)",
    ]
    for q in range(k):
        src = f"cov{q}"
        for s in range(squarings):
            ctes.append(f"p{q}_{s} AS MATERIALIZED (SELECT a.i, b.j, sum(a.v * b.v) / any_value(t) AS v FROM {src} a JOIN {src} b ON a.j = b.i, (SELECT sqrt(sum(v * v)) AS t FROM {src}) GROUP BY a.i, b.j)")
            src = f"p{q}_{s}"
        # the column with the largest diagonal, of length 1, its largest loading positive
        ctes.append(f"col{q} AS (SELECT i, v FROM {src} WHERE j = (SELECT arg_max(i, v) FROM {src} WHERE i = j))")
        ctes.append(f"w{q} AS MATERIALIZED (SELECT i, v / (SELECT sqrt(sum(v * v)) FROM col{q}) * (SELECT sign(arg_max(v, abs(v))) FROM col{q}) AS v FROM col{q})")
        ctes.append(f"l{q} AS (SELECT sum(a.v * m.v * b.v) AS lam FROM cov{q} m JOIN w{q} a ON a.i = m.i JOIN w{q} b ON b.i = m.j)")
        ctes.append(f"cov{q + 1} AS MATERIALIZED (SELECT m.i, m.j, m.v - lam * a.v * b.v AS v FROM cov{q} m JOIN w{q} a ON a.i = m.i JOIN w{q} b ON b.i = m.j, l{q})")
    return ctes


@register(
    "e18_pca_fingerprint",
    with_ctes(
        *_pca_ctes(),
        body="SELECT label, avg(pc1) AS pc1, avg(pc2) AS pc2, avg(pc3) AS pc3, count(*) AS n FROM (SELECT r, label, "
        "sum(e.v * w0.v) AS pc1, sum(e.v * w1.v) AS pc2, sum(e.v * w2.v) AS pc3 FROM e JOIN w0 USING (i) JOIN w1 USING (i) JOIN w2 USING (i) GROUP BY r, label) GROUP BY label",
    ),
    doubles=["pc1", "pc2", "pc3"],
)
def e18_pca_fingerprint(spark, sf_dir):
    return rounded(ef.pca_fingerprint(table(spark, sf_dir, "embeddings"), "embedding", "label", tol=1e-9))


@register(
    "e18_pca_variance",
    with_ctes(
        *_pca_ctes(),
        "tr AS (SELECT sum(v) AS total FROM cov0 WHERE i = j)",
        body="SELECT component, lam AS variance, lam / total AS share FROM (SELECT 1 AS component, lam FROM l0 UNION ALL SELECT 2, lam FROM l1 UNION ALL SELECT 3, lam FROM l2), tr",
    ),
    doubles=["variance", "share"],
)
def e18_pca_variance(spark, sf_dir):
    return rounded(ef.pca_variance(table(spark, sf_dir, "embeddings"), "embedding", tol=1e-9))
