"""DuckDB SQL of the test statistics (oracle side of ``operators.stats``).

Each function returns a SELECT over a named source relation producing the
statistics row: test_id, statistic, df1, df2, estimate, n, note.
"""

from __future__ import annotations

from .sqlparts import r6


def _num(c: str) -> str:
    return f"CASE WHEN NOT isnan(CAST({c} AS DOUBLE)) THEN CAST({c} AS DOUBLE) END"


def _row(test_id, statistic, df1, df2, estimate, n, note) -> str:
    return (
        f"'{test_id}' AS test_id, {r6(statistic, 'statistic')}, "
        f"{r6(df1, 'df1')}, {r6(df2, 'df2')}, "
        f"{r6(estimate, 'estimate')}, CAST({n} AS BIGINT) AS n, CAST({note} AS VARCHAR) AS note"
    )


def f1(src: str, y: str, test_id: str = "F1", mu: float = 0.0) -> str:
    return f"""
SELECT {_row(test_id,
             f"CASE WHEN n >= 2 THEN (mean - {mu}) / nullif(sd / sqrt(n), 0) END",
             "n - 1", "NULL", "mean", "n",
             "CASE WHEN n < 2 THEN 'fewer than 2 values' WHEN sd = 0 THEN 'zero variance' END")}
FROM (SELECT count(y) AS n, avg(y) AS mean, stddev_samp(y) AS sd
      FROM (SELECT {_num(y)} AS y FROM {src}))"""


def f2(src: str, y: str, by: str, test_id: str = "F2") -> str:
    g = f"(SELECT {by} AS level, y FROM (SELECT {by}, {_num(y)} AS y FROM {src}) WHERE {by} IS NOT NULL AND y IS NOT NULL)"
    return f"""
SELECT {_row(test_id,
             "CASE WHEN k >= 2 AND NN > k THEN (ssb / nullif(k - 1, 0)) / nullif(ssw / nullif(NN - k, 0), 0) END",
             "k - 1", "NN - k", "NULL", "NN",
             "CASE WHEN k < 2 THEN 'fewer than 2 groups' WHEN NN <= k THEN 'no within-group df' "
             "WHEN ssw = 0 THEN 'zero within-group variance' END")}
FROM (SELECT count(*) AS k, coalesce(sum(n), 0) AS NN, sum(coalesce(v, 0) * (n - 1)) AS ssw, sum(n * (m - MM) * (m - MM)) AS ssb
      FROM (SELECT level, count(*) AS n, var_samp(y) AS v, avg(y) AS m FROM {g} GROUP BY level),
           (SELECT avg(y) AS MM FROM {g}))"""


def _moments(src: str, y: str, x: str) -> str:
    return f"""(SELECT regr_count(y, x) AS n, regr_sxx(y, x) AS sxx, regr_syy(y, x) AS syy, regr_sxy(y, x) AS sxy
      FROM (SELECT {_num(y)} AS y, {_num(x)} AS x FROM {src}) WHERE y IS NOT NULL AND x IS NOT NULL)"""


def f3(src: str, y: str, x: str, test_id: str = "F3", transform: str | None = None) -> str:
    if transform == "ln":
        src = f"(SELECT {y}, ln(CAST({x} AS DOUBLE)) AS {x} FROM {src} WHERE {x} > 0)"
    ok = "sxx > 0 AND n > 2"
    return f"""
SELECT {_row(test_id,
             f"CASE WHEN {ok} THEN slope / nullif(se, 0) END", "n - 2", "NULL",
             f"CASE WHEN {ok} THEN slope END", "n",
             "CASE WHEN NOT (sxx > 0) OR sxx IS NULL THEN 'single value of predictor' WHEN n <= 2 THEN 'fewer than 3 rows' END")}
FROM (SELECT *, sxy / nullif(sxx, 0) AS slope,
             sqrt((syy - sxy / nullif(sxx, 0) * sxy) / nullif(n - 2, 0) / nullif(sxx, 0)) AS se
      FROM {_moments(src, y, x)})"""


def f4(src: str, y: str, x: str, test_id: str = "F4", gated: bool = False) -> str:
    ok = "n > 2 AND r IS NOT NULL AND abs(r) < 1"
    note = ("CASE WHEN n <= 2 THEN 'fewer than 3 pairs' WHEN r IS NULL THEN 'constant column' "
            "WHEN abs(r) >= 1 THEN 'perfect correlation' END")
    if gated:
        ok += " AND sxx > 0"
        note = f"CASE WHEN NOT (sxx > 0) THEN 'single value of x' ELSE {note} END"
    return f"""
SELECT {_row(test_id, f"CASE WHEN {ok} THEN r * sqrt((n - 2) / nullif(1 - r * r, 0)) END",
             "n - 2", "NULL", "r", "n", note)}
FROM (SELECT *, sxy / nullif(sqrt(sxx * syy), 0) AS r FROM {_moments(src, y, x)})"""


def lag_coefficients(src: str, y: str, by: list[str], order: list[str]) -> str:
    b = ", ".join(by)
    o = ", ".join(order)
    return f"""(SELECT {b}, CASE WHEN n_pairs >= 2 THEN sxy / nullif(sqrt(sxx * syy), 0) END AS phi, n_pairs
  FROM (SELECT {b}, count(*) AS n_pairs, regr_sxx(cur, prev) AS sxx, regr_syy(cur, prev) AS syy, regr_sxy(cur, prev) AS sxy
        FROM (SELECT {b}, lag(y) OVER (PARTITION BY {b} ORDER BY {o}) AS prev, y AS cur
              FROM (SELECT {b}, {o}, {_num(y)} AS y FROM {src}))
        WHERE prev IS NOT NULL AND cur IS NOT NULL GROUP BY {b}))"""


def f5(src: str, y: str, by: list[str], order: list[str], test_id: str = "F5") -> str:
    coef = lag_coefficients(src, y, by, order)
    return f1(f"(SELECT phi FROM {coef} WHERE phi IS NOT NULL)", "phi", test_id)


def f7(src: str, y: str, by: str, test_id: str = "F7") -> str:
    kv = f"(SELECT g, v FROM (SELECT {by} AS g, {_num(y)} AS v FROM {src}) WHERE g IS NOT NULL AND v IS NOT NULL)"
    return f"""
SELECT {_row(test_id,
             "CASE WHEN k > 1 AND NN > 1 THEN (12.0 / (NN * (NN + 1)) * sr2n - 3.0 * (NN + 1)) / nullif(1 - ties / nullif(NN * NN * NN - NN, 0), 0) END",
             "k - 1", "NULL", "NULL", "NN",
             "CASE WHEN k <= 1 THEN 'fewer than 2 groups' WHEN (1 - ties / nullif(NN * NN * NN - NN, 0)) IS NULL "
             "OR (1 - ties / nullif(NN * NN * NN - NN, 0)) = 0 THEN 'all values equal' END")}
FROM (SELECT count(*) AS k, sum(R * R / n) AS sr2n
      FROM (SELECT g, sum(r0 + (t - 1) / 2.0) AS R, count(*) AS n
            FROM (SELECT g, v, rank() OVER (ORDER BY v) AS r0, count(*) OVER (PARTITION BY v) AS t FROM {kv})
            GROUP BY g)) a,
     (SELECT CAST(sum(t) AS DOUBLE) AS NN, sum(CAST(t AS DOUBLE) * t * t - t) AS ties
      FROM (SELECT v, count(*) AS t FROM {kv} GROUP BY v)) b"""


def f8(src: str, y: str, x: str, c: str | None, test_id: str = "F8") -> str:
    if c:
        data = (f"(SELECT * FROM (SELECT {_num(y)} AS y, {_num(x)} AS x, {_num(c)} AS c FROM {src}) "
                "WHERE y IS NOT NULL AND x IS NOT NULL AND c IS NOT NULL)")
        mom = (f"SELECT count(*) AS n, var_samp(x) AS c11, covar_samp(x, y) AS c1y, var_samp(y) AS cyy, "
               f"var_samp(c) AS c22, covar_samp(x, c) AS c12, covar_samp(c, y) AS c2y FROM {data}")
    else:
        data = f"(SELECT * FROM (SELECT {_num(y)} AS y, {_num(x)} AS x FROM {src}) WHERE y IS NOT NULL AND x IS NOT NULL)"
        mom = (f"SELECT count(*) AS n, var_samp(x) AS c11, covar_samp(x, y) AS c1y, var_samp(y) AS cyy, "
               f"0.0 AS c22, 0.0 AS c12, 0.0 AS c2y FROM {data}")
    return f"""
SELECT {_row(test_id,
             "CASE WHEN c11 > 0 AND dfr > 0 THEN b1 / nullif(sqrt(vb1), 0) END", "dfr", "NULL",
             "CASE WHEN c11 > 0 AND dfr > 0 THEN b1 END", "n",
             "CASE WHEN NOT (c11 > 0) OR c11 IS NULL THEN 'single value of predictor' WHEN dfr <= 0 THEN 'too few rows' END")}
FROM (
  SELECT *,
    CASE WHEN c22 > 0 THEN (c22 * c1y - c12 * c2y) / nullif(det, 0) ELSE c1y / nullif(c11, 0) END AS b1,
    CASE WHEN c22 > 0
         THEN (nn - 1) * (cyy - (c22 * c1y - c12 * c2y) / nullif(det, 0) * c1y - (c11 * c2y - c12 * c1y) / nullif(det, 0) * c2y)
              / nullif(nn - 3, 0) * c22 / nullif((nn - 1) * det, 0)
         ELSE (nn - 1) * (cyy - c1y / nullif(c11, 0) * c1y) / nullif(nn - 2, 0) / nullif((nn - 1) * c11, 0) END AS vb1,
    CASE WHEN c22 > 0 THEN nn - 3 ELSE nn - 2 END AS dfr
  FROM (SELECT *, CAST(n AS DOUBLE) AS nn, c11 * c22 - c12 * c12 AS det FROM ({mom})))"""


def propagated(sql: str, src: str, cols: list[str], where: str = "true", applies: str = "true") -> str:
    """A statistics query under nan_policy "propagate": NULLs and a note where a value of
    ``cols`` is missing in a row of ``src`` that the test reads."""
    missing = " OR ".join(f"{c} IS NULL OR isnan(CAST({c} AS DOUBLE))" for c in cols)
    kept = ", ".join(f"CASE WHEN bad AND {applies} THEN NULL ELSE {c} END AS {c}" for c in ("statistic", "df1", "df2", "estimate"))
    return f"""
SELECT test_id, {kept}, n, CASE WHEN bad AND {applies} THEN 'missing values' ELSE note END AS note
FROM ({sql}), (SELECT coalesce(bool_or({missing}), false) AS bad FROM {src} WHERE {where})"""


def slope(src: str, y: str, x: str, covariates: list[str], factor: list[str] = (), test_id: str = "F8") -> str:
    """Slope of x beside covariates and dummies of a factor, by residuals: means of the
    factor's levels are taken away, then every column is freed of one covariate after
    another. All covariates are taken to vary."""
    names = {c: f"c{i}" for i, c in enumerate(covariates)} | {x: "x", y: "y"}
    level = ", ".join(factor) if factor else "1"
    sql = (
        f"SELECT {', '.join(f'CAST({c} AS DOUBLE) AS {a}' for c, a in names.items())}, ({level if len(factor) < 2 else f'({level})'}) AS lev FROM {src} "
        f"WHERE {' AND '.join(f'{c} IS NOT NULL' for c in [*names, *factor])}"
    )
    cols = list(names.values())
    sql = f"SELECT lev, {', '.join(f'{a} - avg({a}) OVER (PARTITION BY lev) AS {a}' for a in cols)} FROM ({sql})"
    for i in range(len(covariates)):
        rest = cols[i + 1 :]
        sql = f"SELECT lev, {', '.join(f'{a} - c{i} * (sum({a} * c{i}) OVER () / sum(c{i} * c{i}) OVER ()) AS {a}' for a in rest)} FROM ({sql})"
    return f"""
SELECT {_row(test_id, "b / nullif(sqrt((syy - b * sxy) / df / sxx), 0)", "df", "NULL", "b", "n", "NULL")}
FROM (SELECT *, sxy / nullif(sxx, 0) AS b, n - levels - {len(covariates)} - 1 AS df
      FROM (SELECT count(*) AS n, count(DISTINCT lev) AS levels, sum(x * x) AS sxx, sum(x * y) AS sxy, sum(y * y) AS syy FROM ({sql})))"""
