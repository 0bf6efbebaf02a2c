"""Registered queries of the test battery.

Each test has a ``<id>_stat`` query (statistic, df, estimate, n, note) with a
DuckDB oracle, and a ``<id>_p`` query that adds the p-value (the oracle sums the
same integrals, see ``sqltails``).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import regress
from ..operators import stats as st
from ..session import table
from ..sources import fixtures as fx
from . import sqlstats as q
from .registry import register, round_sql, rounded
from .sqlparts import DOC_WORDS, POS_NED, RUNS_DOCS, runs_vec_sql, with_ctes
from .sqltails import exact, range_quantile, range_tail, with_p

RUNS_CTES = (POS_NED, runs_vec_sql())
RUNS_T_CTES = (POS_NED, runs_vec_sql("pos_trim", "runs_t"))
DOCS_CTES = (DOC_WORDS, RUNS_DOCS)


def _runs(spark, sf_dir):
    return fx.runs_vec(spark, sf_dir)


def _runs_t(spark, sf_dir, ranked=False):
    return fx.runs_vec(spark, sf_dir, trim_prompt=True, ranked=ranked)


KIND_SQL = "CASE test_id " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in st.KIND.items()) + " ELSE 't' END"


def p_sql(stat_sql: str) -> str:
    """The oracle of a statistics query with p-values."""
    return round_sql(with_p(exact(stat_sql), KIND_SQL), ["statistic", "df1", "df2", "estimate", "p_value", "log10_p"])


def docs_runs(spark, sf_dir):
    runs = fx.runs_docs(spark, sf_dir, ranked=True)
    return runs.withColumn("ned_mean", F.round("ned_mean", 9))


def flagship(spark, sf_dir):
    """Does temperature change concentration? ANOVA of ned_mean by temp with p."""
    return rounded(st.with_p(st.anova(_runs(spark, sf_dir), "ned_mean", "temp")))


def _pair(name, sql_ctes, sql_body, build):
    """Register ``name_stat`` (oracle) and ``name_p`` (with p-value)."""

    @register(f"{name}_stat", with_ctes(*sql_ctes, body=sql_body))
    def _stat(spark, sf_dir):
        return rounded(build(spark, sf_dir))

    @register(f"{name}_p", with_ctes(*sql_ctes, body=p_sql(sql_body)))
    def _p(spark, sf_dir):
        return rounded(st.with_p(build(spark, sf_dir)))

    return _stat, _p


# F1
_pair("f1_ttest", RUNS_CTES, q.f1("runs", "ned_mean"), lambda s, d: st.ttest_1samp(_runs(s, d), "ned_mean"))
_pair(
    "f1_ttest_docs",
    DOCS_CTES,
    q.f1("runs_docs", "ned_mean"),
    lambda s, d: st.ttest_1samp(fx.runs_docs(s, d), "ned_mean"),
)
# F2
_pair("f2_anova", RUNS_CTES, q.f2("runs", "ned_mean", "temp"), lambda s, d: st.anova(_runs(s, d), "ned_mean", "temp"))
_pair(
    "f2_anova_docs_lang",
    DOCS_CTES,
    q.f2("runs_docs", "ned_mean", "language"),
    lambda s, d: st.anova(fx.runs_docs(s, d), "ned_mean", "language"),
)
# F3
_pair("f3_ols_size", RUNS_CTES, q.f3("runs", "ned_mean", "model_size"), lambda s, d: st.ols(_runs(s, d), "ned_mean", "model_size"))
# F3 with extra runs concatenated for this test only (here: the trimmed runs)
_pair(
    "f3_ols_size_extra",
    (POS_NED, runs_vec_sql(), runs_vec_sql("pos_trim", "runs_t")),
    q.f3("(SELECT ned_mean, model_size FROM runs UNION ALL SELECT ned_mean, model_size FROM runs_t)", "ned_mean", "model_size"),
    lambda s, d: st.ols(_runs(s, d), "ned_mean", "model_size", extra=_runs_t(s, d)),
)
# F4
_pair("f4_pearson_temp", RUNS_CTES, q.f4("runs", "ned_mean", "temp"), lambda s, d: st.pearson(_runs(s, d), "ned_mean", "temp"))
# events per user in time order, and runs per checkpoint in rank order
_pair(
    "f5_lag1_events",
    (),
    q.f5("events", "value", ["user_id"], ["ts", "event_id"]),
    lambda s, d: st.lag1_persistence(fx.series(s, d), "value", ["user_id"], ["ts", "event_id"]),
)
_pair(
    "f5_lag1_runs",
    RUNS_CTES,
    q.f5("runs", "ned_mean", ["model", "chkpt_id"], ["rank"]),
    lambda s, d: st.lag1_persistence(fx.runs_vec(s, d, ranked=True), "ned_mean", ["model", "chkpt_id"], ["rank"]),
)
# checkpoints of different models chained together, as the code does on a combined table
_pair(
    "f5_lag1_chkpt_only",
    RUNS_CTES,
    q.f5("runs", "ned_mean", ["chkpt_id"], ["rank"]),
    lambda s, d: st.lag1_persistence(fx.runs_vec(s, d, ranked=True), "ned_mean", ["chkpt_id"], ["rank"]),
)
# variable and constant seq_len (the second is the not-applicable branch)
_pair(
    "f6_pearson_len",
    RUNS_T_CTES,
    q.f4("runs_t", "ned_mean", "seq_len", "F6", gated=True),
    lambda s, d: st.pearson_gated(_runs_t(s, d), "ned_mean", "seq_len"),
)
_pair(
    "f6_pearson_len_const",
    RUNS_CTES,
    q.f4("runs", "ned_mean", "seq_len", "F6", gated=True),
    lambda s, d: st.pearson_gated(_runs(s, d), "ned_mean", "seq_len"),
)
# heavy ties on lineitem, domains on runs
_pair(
    "f7_kruskal_lineitem",
    (),
    q.f7("lineitem", "l_quantity", "l_returnflag"),
    lambda s, d: st.kruskal(table(s, d, "lineitem"), "l_quantity", "l_returnflag"),
)
_pair(
    "f7_kruskal_domain",
    RUNS_T_CTES,
    q.f7("runs_t", "ned_mean", "domain"),
    lambda s, d: st.kruskal(_runs_t(s, d), "ned_mean", "domain"),
)
# F8
_pair(
    "f8_partial_lineitem",
    (),
    q.f8("lineitem", "l_extendedprice", "l_quantity", "l_discount"),
    lambda s, d: st.ols_partial(table(s, d, "lineitem"), "l_extendedprice", "l_quantity", "l_discount"),
)
_pair(
    "f8_partial_rank",
    RUNS_T_CTES,
    q.f8("runs_t", "ned_mean", "rank", "temp"),
    lambda s, d: st.ols_partial(_runs_t(s, d, ranked=True), "ned_mean", "rank", "temp"),
)


# F2 post-hoc
@register(
    "f2p_tukey_stat",
    doubles=["group1", "group2", "meandiff", "q"],
    sql=with_ctes(
        *RUNS_CTES,
        """
gs AS (SELECT temp AS level, count(*) AS n, avg(ned_mean) AS mean, var_samp(ned_mean) AS v
       FROM runs WHERE temp IS NOT NULL AND ned_mean IS NOT NULL GROUP BY temp),
gk AS (SELECT count(*) AS k, sum(coalesce(v, 0) * (n - 1)) / (sum(n) - count(*)) AS msw FROM gs)""",
        body="""
SELECT a.level AS group1, b.level AS group2, b.mean - a.mean AS meandiff,
       abs(b.mean - a.mean) / sqrt(gk.msw / 2 * (1.0 / a.n + 1.0 / b.n)) AS q
FROM gs a JOIN gs b ON a.level < b.level, gk WHERE gk.k > 2""",
    ),
)
def f2p_tukey_stat(spark, sf_dir):
    return rounded(st.tukey_hsd(_runs(spark, sf_dir)).select("group1", "group2", "meandiff", "q"))


def _tukey_sql(by: str = "") -> str:
    """All pairs with tails and limits, per ``by`` (a column, or none)."""
    b, on = (f"{by}, ", f"a.{by} = b.{by} AND ") if by else ("", "")
    gk = f"JOIN gk ON gk.{by} = a.{by}" if by else ", gk"
    out = "group1, group2, meandiff, q, greatest(p, 0) AS p_adj, meandiff - q_crit * se AS lower, meandiff + q_crit * se AS upper, p < 0.05 AS reject"
    return with_ctes(
        *RUNS_CTES,
        f"""
gs AS (SELECT {b}temp AS level, count(*) AS n, avg(ned_mean) AS mean, var_samp(ned_mean) AS v
       FROM runs WHERE temp IS NOT NULL AND ned_mean IS NOT NULL GROUP BY {b}temp),
gk AS (SELECT {b}count(*)::DOUBLE AS k, (sum(n) - count(*))::DOUBLE AS df, sum(coalesce(v, 0) * (n - 1)) / (sum(n) - count(*)) AS msw FROM gs {f"GROUP BY {by}" if by else ""}),
pr AS (SELECT {f"a.{by}, " if by else ""}a.level AS group1, b.level AS group2, b.mean - a.mean AS meandiff, sqrt(gk.msw / 2 * (1.0 / a.n + 1.0 / b.n)) AS se, k, df
       FROM gs a JOIN gs b ON {on}a.level < b.level {gk} WHERE gk.k > 2),
pq AS (SELECT *, abs(meandiff) / se AS q FROM pr)""",
        f"tl AS MATERIALIZED ({range_tail('SELECT DISTINCT q, k, df FROM pq', 'q, k, df')})",
        *range_quantile("gk"),
        body=f"SELECT {b}{out} FROM pq JOIN tl USING (q, k, df) JOIN crit USING (k, df)",
    )


_TUKEY = ["group1", "group2", "meandiff", "q", "p_adj", "lower", "upper"]


@register("f2p_tukey", _tukey_sql(), doubles=_TUKEY)
def f2p_tukey(spark, sf_dir):
    return rounded(st.tukey_hsd(_runs(spark, sf_dir)))


# the battery, statistics with oracle, and with p-values
def battery_sql(src: str) -> str:
    parts = [
        q.f1(src, "ned_mean"),
        q.f2(src, "ned_mean", "temp"),
        q.f3(src, "ned_mean", "model_size"),
        q.f4(src, "ned_mean", "temp"),
        q.f5(src, "ned_mean", ["model", "chkpt_id"], ["rank"]),
        q.f4(src, "ned_mean", "seq_len", "F6", gated=True),
        q.f7(src, "ned_mean", "domain"),
        q.f8(src, "ned_mean", "rank", "temp"),
    ]
    return "\nUNION ALL\n".join(f"({p})" for p in parts)


@register("f9_battery_stat", with_ctes(*RUNS_T_CTES, body=battery_sql("runs_t")))
def f9_battery_stat(spark, sf_dir):
    b = st.battery(_runs_t(spark, sf_dir, ranked=True))
    return rounded(b.select(*st.STAT_COLS))


@register("f9_battery", with_ctes(*RUNS_T_CTES, body=p_sql(battery_sql("runs_t"))))
def f9_battery(spark, sf_dir):
    return rounded(st.battery(_runs_t(spark, sf_dir, ranked=True)))


# copies of a document have one metric up to the order of a sum: rounded, they tie
_ROUNDED = "runs_docs9"
DOCS9 = "runs_docs9 AS (SELECT * REPLACE (round(ned_mean, 9) AS ned_mean) FROM runs_docs)"
DOCS_BATTERY = battery_sql(_ROUNDED).replace(
    q.f3(_ROUNDED, "ned_mean", "model_size"),
    "SELECT 'F3' AS test_id, NULL::DOUBLE AS statistic, NULL::DOUBLE AS df1, NULL::DOUBLE AS df2, NULL::DOUBLE AS estimate, "
    "NULL::BIGINT AS n, 'missing column model_size' AS note",
).replace(q.f5(_ROUNDED, "ned_mean", ["model", "chkpt_id"], ["rank"]), q.f5(_ROUNDED, "ned_mean", ["chkpt_id"], ["rank"]))


@register("f9_battery_docs", with_ctes(*DOCS_CTES, DOCS9, body=p_sql(DOCS_BATTERY)))
def f9_battery_docs(spark, sf_dir):
    """Documents runs: no model_size column, so F3 reports a NULL row."""
    return rounded(st.battery(docs_runs(spark, sf_dir)))





# F9 per group: every model's battery in one set of keyed aggregations
def battery_by_model_sql(src: str) -> str:
    parts = []
    for m in fx.MODELS:
        sub = f"(SELECT * FROM {src} WHERE model = '{m}')"
        tests = [
            q.f1(sub, "ned_mean"),
            q.f2(sub, "ned_mean", "temp"),
            q.f3(sub, "ned_mean", "model_size"),
            q.f4(sub, "ned_mean", "temp"),
            q.f5(sub, "ned_mean", ["chkpt_id"], ["rank"]),
            q.f4(sub, "ned_mean", "seq_len", "F6", gated=True),
            q.f7(sub, "ned_mean", "domain"),
            q.f8(sub, "ned_mean", "rank", "temp"),
        ]
        parts += [f"(SELECT '{m}' AS model, * FROM ({t}))" for t in tests]
    return "\nUNION ALL\n".join(parts)


@register("f9_battery_by_model_stat", with_ctes(*RUNS_T_CTES, body=battery_by_model_sql("runs_t")))
def f9_battery_by_model_stat(spark, sf_dir):
    b = st.battery(_runs_t(spark, sf_dir, ranked=True), groups=["model"])
    return rounded(b.select("model", *st.STAT_COLS))


@register("f9_battery_by_model", with_ctes(*RUNS_T_CTES, body=p_sql(battery_by_model_sql("runs_t"))))
def f9_battery_by_model(spark, sf_dir):
    return rounded(st.battery(_runs_t(spark, sf_dir, ranked=True), groups=["model"]))


@register(
    "f2p_tukey_by_model_stat",
    doubles=["group1", "group2", "meandiff", "q"],
    sql=with_ctes(
        *RUNS_CTES,
        """
gs AS (SELECT model, temp AS level, count(*) AS n, avg(ned_mean) AS mean, var_samp(ned_mean) AS v
       FROM runs WHERE temp IS NOT NULL AND ned_mean IS NOT NULL GROUP BY model, temp),
gk AS (SELECT model, count(*) AS k, sum(coalesce(v, 0) * (n - 1)) / (sum(n) - count(*)) AS msw FROM gs GROUP BY model)""",
        body="""
SELECT a.model, a.level AS group1, b.level AS group2, b.mean - a.mean AS meandiff,
       abs(b.mean - a.mean) / sqrt(gk.msw / 2 * (1.0 / a.n + 1.0 / b.n)) AS q
FROM gs a JOIN gs b ON a.model = b.model AND a.level < b.level JOIN gk ON gk.model = a.model WHERE gk.k > 2""",
    ),
)
def f2p_tukey_by_model_stat(spark, sf_dir):
    t = st.tukey_hsd(_runs(spark, sf_dir), groups=["model"])
    return rounded(t.select("model", "group1", "group2", "meandiff", "q"))


@register("f2p_tukey_by_model", _tukey_sql("model"), doubles=_TUKEY)
def f2p_tukey_by_model(spark, sf_dir):
    return rounded(st.tukey_hsd(_runs(spark, sf_dir), groups=["model"]))


# F8 in general form: several covariates, and a dummy for every run of a combined table
_pair(
    "f8_partial_runs",
    RUNS_T_CTES,
    q.slope("runs_t", "ned_mean", "rank", ["temp"], ["model"]),
    lambda s, d: regress.ols_slope(_runs_t(s, d, ranked=True), "ned_mean", "rank", ["temp"], ["model"]),
)
_LINE = ["l_quantity", "l_discount", "l_tax"]


def _line_terms_sql() -> str:
    terms = []
    for x in _LINE:
        others = [c for c in _LINE if c != x]
        terms.append(f"(SELECT *, '{x}' AS term FROM ({q.slope('lineitem', 'l_extendedprice', x, others, ['l_returnflag', 'l_linestatus'])}))")
    return "\nUNION ALL\n".join(terms)


@register("f8_multi_lineitem", p_sql(_line_terms_sql()))
def f8_multi_lineitem(spark, sf_dir):
    """All slopes of one regression with three predictors and a dummy per flag and status."""
    t = regress.ols_table(table(spark, sf_dir, "lineitem"), "l_extendedprice", _LINE, ["l_returnflag", "l_linestatus"])
    return rounded(st.with_p(t))


# F3 with extra runs beside every group
def _extra_by_model_sql() -> str:
    parts = []
    for m in fx.MODELS:
        both = f"(SELECT ned_mean, model_size FROM runs WHERE model = '{m}' UNION ALL SELECT ned_mean, model_size FROM runs_t)"
        parts.append(f"(SELECT '{m}' AS model, * FROM ({q.f3(both, 'ned_mean', 'model_size')}))")
    return "\nUNION ALL\n".join(parts)


@register("f3_ols_size_extra_by_model", with_ctes(POS_NED, runs_vec_sql(), runs_vec_sql("pos_trim", "runs_t"), body=p_sql(_extra_by_model_sql())))
def f3_ols_size_extra_by_model(spark, sf_dir):
    extra = _runs_t(spark, sf_dir).drop("model")
    return rounded(st.with_p(st.ols(_runs(spark, sf_dir), "ned_mean", "model_size", extra=extra, groups=["model"])))


# F9 with nan_policy "propagate": one-word documents have no metric, so some languages are
# spoiled and others are not
LANGUAGES = ("de", "en", "es", "fr")


def _propagate_sql() -> str:
    parts = []
    for lang in LANGUAGES:
        src = f"(SELECT * FROM {_ROUNDED} WHERE language = '{lang}')"
        y = "ned_mean"
        tests = [
            q.propagated(q.f1(src, y), src, [y]),
            q.propagated(q.f2(src, y, "temp"), src, [y], "temp IS NOT NULL"),
            "SELECT 'F3' AS test_id, NULL::DOUBLE AS statistic, NULL::DOUBLE AS df1, NULL::DOUBLE AS df2, NULL::DOUBLE AS estimate, "
            "NULL::BIGINT AS n, 'missing column model_size' AS note",
            q.propagated(q.f4(src, y, "temp"), src, [y, "temp"]),
            q.f5(src, y, ["chkpt_id"], ["rank"]),
            q.propagated(q.f4(src, y, "seq_len", "F6", gated=True), src, [y, "seq_len"], applies="note IS DISTINCT FROM 'single value of x'"),
            q.propagated(q.f7(src, y, "domain"), src, [y], "domain IS NOT NULL"),
            q.f8(src, y, "rank", "temp"),
        ]
        parts += [f"(SELECT '{lang}' AS language, * FROM ({t}))" for t in tests]
    return "\nUNION ALL\n".join(parts)


@register("f9_battery_docs_propagate", with_ctes(*DOCS_CTES, DOCS9, body=p_sql(_propagate_sql())))
def f9_battery_docs_propagate(spark, sf_dir):
    return rounded(st.battery(docs_runs(spark, sf_dir), groups=["language"], nan_policy="propagate"))
