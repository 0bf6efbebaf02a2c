"""DuckDB SQL of the tail probabilities (oracle side of ``functions.tails``).

The same integral of the F density in y = ln x, written with SQL lists; the
oracle engine has no log1p and expm1, so both are a short series near 0. The
normal cdf is summed with the same rule, where the operator uses a rational form.
"""

from __future__ import annotations

from ..functions import tukey
from ..functions.tails import FIRST, NODES, STEP

_T = f"({FIRST} + {STEP} * j)"
_U = f"exp({_T} - exp(-{_T}))"
_W = f"(1.0 + exp(-{_T})) * {STEP}"
LN10 = "ln(10.0::DOUBLE)"


def _log1p(x: str) -> str:
    return f"(CASE WHEN abs({x}) < 1e-4 THEN {x} * (1 - {x} / 2 + {x} * {x} / 3 - {x} * {x} * {x} / 4) ELSE ln(greatest(1 + {x}, 1e-300)) END)"


def _expm1(x: str) -> str:
    return f"(CASE WHEN abs({x}) < 1e-4 THEN {x} * (1 + {x} / 2 + {x} * {x} / 6 + {x} * {x} * {x} / 24) ELSE exp({x}) - 1 END)"


def _integral(at: str, sign: str, scale: str) -> str:
    """s * sum over nodes of exp(g(y + u) - g(y)); the columns d1, d2 (NULL: infinite)."""
    v = f"({sign}{_U} * {scale})"
    em = _expm1(v)
    share = f"(d1 * {at} / (d2 + d1 * {at}))"
    rest = f"CASE WHEN d2 IS NULL THEN d1 * {at} * {em} / 2 ELSE (d1 + d2) / 2 * {_log1p(f'({share} * {em})')} END"
    return f"{scale} * list_sum(list_transform(range(0, {NODES}), lambda j: exp(d1 / 2 * {v} - {rest}) * {_U} * {_W}))"


def _scale(at: str) -> str:
    share = f"(d1 * {at} / (d2 + d1 * {at}))"
    slope = f"CASE WHEN d2 IS NULL THEN d1 / 2 * (1 - {at}) ELSE d1 / 2 - (d1 + d2) / 2 * {share} END"
    curve = f"CASE WHEN d2 IS NULL THEN d1 * {at} / 2 ELSE (d1 + d2) / 2 * {share} * (1 - {share}) END"
    return f"1.0 / (abs({slope}) + sqrt({curve}))"


def with_p(src: str, kind: str, stat: str = "statistic", df1: str = "df1", df2: str = "df2") -> str:
    """SELECT over ``src`` (a query) with p_value and log10_p; ``kind`` is an SQL
    expression that gives t, f, chi2 or z."""
    gap = f"d1 / 2 * ln(x) - CASE WHEN d2 IS NULL THEN d1 / 2 * (x - 1) ELSE (d1 + d2) / 2 * {_log1p('(d1 * (x - 1) / (d1 + d2))')} END"
    return f"""
SELECT * EXCLUDE (_k, x, d1, d2, s, s1, lp), exp(lp) AS p_value, lp / {LN10} AS log10_p FROM (
  SELECT * EXCLUDE (side, norm, gap),
         CASE WHEN d1 IS NULL OR d2 IS NULL AND _k IN ('t', 'f') THEN NULL
              WHEN x >= 1 THEN least(gap + ln(side) - ln(norm), 0.0)
              WHEN x > 0 THEN ln(greatest(1 - least(exp(gap + ln(side) - ln(norm)), 1.0), 1e-300))
              WHEN x <= 0 THEN 0.0 END AS lp
  FROM (
    SELECT *, {_integral('1.0::DOUBLE', '', 's1')} + {_integral('1.0::DOUBLE', '-', 's1')} AS norm,
           CASE WHEN x >= 1 THEN {_integral('x', '', 's')} ELSE {_integral('x', '-', 's')} END AS side,
           CASE WHEN x > 0 THEN {gap} END AS gap
    FROM (
      SELECT *, CASE WHEN x > 0 THEN {_scale('x')} ELSE 1.0 END AS s, {_scale('1.0::DOUBLE')} AS s1 FROM (
        SELECT *,
               CAST(CASE _k WHEN 't' THEN {stat} * {stat} WHEN 'z' THEN {stat} * {stat} WHEN 'f' THEN {stat} WHEN 'chi2' THEN {stat} / nullif({df1}, 0) END AS DOUBLE) AS x,
               CAST(CASE WHEN _k IN ('t', 'z') THEN 1 WHEN {df1} > 0 THEN {df1} END AS DOUBLE) AS d1,
               CAST(CASE WHEN _k = 't' AND {df1} > 0 THEN {df1} WHEN _k = 'f' AND {df2} > 0 THEN {df2} END AS DOUBLE) AS d2
        FROM (SELECT *, {kind} AS _k FROM ({src})))
      WHERE true)))"""


def exact(sql: str) -> str:
    """A statistics query without its final rounding (a tail needs all digits)."""
    return sql.replace("round(", "(").replace(", 6) + 0.0 AS ", ") AS ")


def ks_log(d: str, n: str) -> str:
    lam = f"((sqrt({n}) + 0.12 + 0.11 / sqrt({n})) * {d})"
    more = " + ".join(f"{(-1) ** (j - 1)} * exp(-2.0 * {j * j - 1} * {lam} * {lam})" for j in range(2, 8))
    below = " + ".join(f"exp(-{(2 * j - 1) ** 2} * pi() * pi() / 8 / ({lam} * {lam}))" for j in range(1, 7))
    return f"CASE WHEN {lam} >= 1 THEN ln(2.0) - 2.0 * {lam} * {lam} + ln(1 + {more}) ELSE ln(1 - least(sqrt(2 * pi()) / {lam} * ({below}), 1 - 1e-300)) END"


def phi(z: str) -> str:
    """Normal cdf: phi(z) * Int exp(-|z| u - u^2 / 2) du is the tail beyond |z|."""
    x = f"abs({z})"
    tail = f"exp(-{x} * {x} / 2) / sqrt(2 * pi()) * list_sum(list_transform(range(0, {NODES}), lambda j: exp(-{x} * {_U} - {_U} * {_U} / 2) * {_U} * {_W}))"
    return f"CASE WHEN {z} > 0 THEN 1 - {tail} ELSE {tail} END"


def cdf(z: str) -> str:
    """Normal cdf from the rational form (z: a column)."""

    def poly(cs) -> str:
        out = str(cs[0])
        for k in cs[1:]:
            out = f"({out} * abs({z}) + {k})"
        return out

    tail = f"(CASE WHEN abs({z}) < 7 THEN exp(-{z} * {z} / 2) * {poly(tukey.TOP)} / {poly(tukey.BOTTOM)} ELSE 0.0 END)"
    return f"(CASE WHEN {z} > 0 THEN 1 - {tail} ELSE {tail} END)"


def range_tail(src: str, keys: str) -> str:
    """SELECT {keys}, p over ``src`` (keys, q, k, df): the upper tail of the studentized range as
    1 - cdf, by the double integral itself on fixed nodes of ln s and z."""
    return f"""
SELECT {keys}, 1 - sum(inside * weight) / sum(weight) AS p FROM (
  SELECT {keys}, j, any_value(weight) AS weight, k * 0.1 * sum(exp(-z * z / 2) / sqrt(2 * pi()) * (({cdf('z')}) - ({cdf('zw')})) ** (k - 1)) AS inside FROM (
    SELECT *, -8.0 + 0.1 * i AS z, -8.0 + 0.1 * i - q * exp(v) AS zw FROM (
      SELECT *, exp(df * (v - (exp(2 * v) - 1) / 2)) AS weight FROM (
        SELECT *, j / 4.0 / sqrt(2.0 * df) AS v FROM ({src}), (SELECT unnest(range(-40, 25)) AS j))),
      (SELECT unnest(range(0, 161)) AS i))
  GROUP BY {keys}, j, k) GROUP BY {keys}"""


def range_quantile(src: str) -> list[str]:
    """CTEs that end in crit (k, df, q_crit): the 95 % point for each (k, df) of ``src``, from three
    grids of q, each between two neighbours of the one before."""
    ctes = [f"g0 AS (SELECT DISTINCT CAST(k AS DOUBLE) AS k, CAST(df AS DOUBLE) AS df, 0.0::DOUBLE AS base FROM {src})"]
    for i, (step, n) in enumerate(((1.0, 40), (0.025, 42), (0.000625, 42))):
        grid = f"SELECT k, df, base + {step} * n AS q FROM g{i}, (SELECT unnest(range(0, {n})) AS n) WHERE base + {step} * n > 0"
        ctes.append(f"t{i} AS MATERIALIZED ({range_tail(grid, 'k, df, q')})")
        ctes.append(f"g{i + 1} AS (SELECT k, df, max(q) AS base FROM t{i} WHERE p >= 0.05 GROUP BY k, df)")
    ctes.append(
        "crit AS (SELECT a.k, a.df, a.q + (a.p - 0.05) / (a.p - b.p) * (b.q - a.q) AS q_crit FROM g3 JOIN t2 a ON a.k = g3.k AND a.df = g3.df AND a.q = g3.base "
        "JOIN t2 b ON b.k = a.k AND b.df = a.df AND b.q > a.q QUALIFY row_number() OVER (PARTITION BY a.k, a.df ORDER BY b.q) = 1)"
    )
    return ctes
