"""Least squares with any number of covariates from one aggregation (F3, F8 in general form).

All that a regression needs are the counts and the centred sums of products of its
columns, which combine over partitions. They are gathered in one aggregation and the
covariates are swept out of them one after another on the summary row: the pivot of a
column is what the columns before it leave of its variation, and a column of
which nothing is left (constant, or a combination of the others) is passed over and
takes no degree of freedom.

Dummies of a factor need no columns: ``absorb`` names the factor (e.g. the run a row comes
from), the sums are centred within its levels, and every level takes a degree of
freedom. That is the regression with one dummy per level, whatever their number; the
second aggregation has one row per level.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: a pivot below this share of its column's variation counts as nothing left
LEFT = 1e-10


def _double(c: str) -> Column:
    x = F.col(c).cast("double")
    return F.when(~F.isnan(x), x)


def squares(df: DataFrame, columns: Sequence[str], groups: Sequence[str] = (), absorb: Sequence[str] = ()) -> DataFrame:
    """Per ``groups``: n, levels (of ``absorb``; 1 without) and s_i_j (i <= j), the centred sums of
    products of the columns i and j over the complete rows. Rows whose factor is NULL are
    incomplete."""
    rows = df.select(*groups, *[F.col(a).alias(f"_a{i}") for i, a in enumerate(absorb)], *[_double(c).alias(f"_{i}") for i, c in enumerate(columns)])
    k = len(columns)
    complete = F.lit(True)
    for i in range(k):
        complete = complete & F.col(f"_{i}").isNotNull()
    factor = [f"_a{i}" for i in range(len(absorb))]
    for a in factor:
        complete = complete & F.col(a).isNotNull()
    names = [f"s_{i}_{j}" for i in range(k) for j in range(i, k)]
    n = F.count(F.when(complete, 1))
    # incomplete rows stay as NULLs, so that a group of such rows alone has its row too
    rows = rows.select(*groups, *factor, complete.alias("_ok"), *[F.when(complete, F.col(f"_{i}")).alias(f"_{i}") for i in range(k)])
    n = F.count_if("_ok")
    sums = [(n * F.covar_pop(f"_{i}", f"_{j}")).alias(f"s_{i}_{j}") for i in range(k) for j in range(i, k)]
    if not factor:
        return rows.groupBy(*groups).agg(n.alias("n"), F.lit(1).cast("bigint").alias("levels"), *sums)
    levels = rows.groupBy(*groups, *factor).agg(n.alias("n"), *sums)
    return levels.groupBy(*groups).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count_if(F.col("n") > 0).alias("levels"), *[F.sum(c).alias(c) for c in names]
    )


def swept(sums: DataFrame, order: Sequence[int], keep: Sequence[str]) -> DataFrame:
    """``keep``, n, levels, used (columns that took a degree of freedom before the last predictor)
    and, of the last predictor in ``order`` and of the outcome (the column after all
    predictors), what the predictors before leave: xx, xy, yy; ``whole`` is the
    predictor's own variation and ``total`` the outcome's."""
    y = len(order)
    at = lambda i, j: f"s_{min(i, j)}_{max(i, j)}"
    left = [*order, y]
    cur = sums.select(*keep, "n", "levels", F.lit(0).alias("used"), *[F.col(at(i, i)).alias(f"o_{i}") for i in left], *[at(i, j) for a, i in enumerate(left) for j in left[a:]])
    for a, p in enumerate(order[:-1]):
        rest = left[a + 1 :]
        ok = F.coalesce(F.col(at(p, p)) > LEFT * F.col(f"o_{p}"), F.lit(False))
        # the multiples of the pivot row stand as columns of their own before they are used
        cur = cur.select("*", ok.alias("_ok"), *[F.when(ok, F.col(at(i, p)) / F.nullif(F.col(at(p, p)), F.lit(0.0))).otherwise(0.0).alias(f"_f{i}") for i in rest])
        cur = cur.select(
            *keep, "n", "levels", (F.col("used") + F.col("_ok").cast("int")).alias("used"), *[f"o_{i}" for i in left],
            *[(F.col(at(i, j)) - F.col(f"_f{i}") * F.col(at(j, p))).alias(at(i, j)) for b, i in enumerate(rest) for j in rest[b:]],
        )
    x = order[-1]
    return cur.select(
        *keep, "n", "levels", "used", F.col(at(x, x)).alias("xx"), F.col(at(x, y)).alias("xy"), F.col(at(y, y)).alias("yy"),
        F.col(f"o_{x}").alias("whole"), F.col(f"o_{y}").alias("total"),
    )


def solved(frame: DataFrame, keep: Sequence[str], test_id: str) -> DataFrame:
    """Result rows (the columns of the battery) of a ``swept`` frame."""
    n = F.col("n").cast("double")
    df = n - F.col("levels") - F.col("used") - 1
    some = F.coalesce(F.col("whole") > 0, F.lit(False))
    own = some & (F.col("xx") > LEFT * F.col("whole"))
    slope = F.col("xy") / F.nullif(F.col("xx"), F.lit(0.0))
    rss = F.greatest(F.col("yy") - slope * F.col("xy"), F.lit(0.0))
    se = F.sqrt(rss / F.nullif(df, F.lit(0.0)) / F.nullif(F.col("xx"), F.lit(0.0)))
    ok = own & (df > 0)
    note = (
        F.when(~some, F.lit("single value of predictor"))
        .when(~own, F.lit("predictor given by the covariates"))
        .when(df <= 0, F.lit("too few rows"))
    )
    return frame.select(
        *keep,
        F.lit(test_id).alias("test_id"),
        F.when(ok, slope / F.nullif(se, F.lit(0.0))).cast("double").alias("statistic"),
        df.cast("double").alias("df1"),
        F.lit(None).cast("double").alias("df2"),
        F.when(ok, slope).cast("double").alias("estimate"),
        F.col("n").cast("bigint").alias("n"),
        note.alias("note"),
    )


def ols_slope(
    df: DataFrame, y: str, x: str, covariates: Sequence[str] = (), absorb: Sequence[str] = (), groups: Sequence[str] = (), test_id: str = "F8"
) -> DataFrame:
    """Slope t-test of x in y ~ x + covariates (+ a dummy per level of ``absorb``), per ``groups``."""
    columns = [*covariates, x, y]
    sums = squares(df, columns, groups, absorb)
    return solved(swept(sums, range(len(columns) - 1), list(groups)), list(groups), test_id)


def ols_table(df: DataFrame, y: str, predictors: Sequence[str], absorb: Sequence[str] = (), groups: Sequence[str] = (), test_id: str = "F8") -> DataFrame:
    """The slope test of every predictor in one regression: the columns of the battery with
    ``term``, from the same single aggregation."""
    groups = list(groups)
    sums = squares(df, [*predictors, y], groups, absorb)
    out = None
    for k, name in enumerate(predictors):
        order = [i for i in range(len(predictors)) if i != k] + [k]
        one = solved(swept(sums, order, groups), groups, test_id).withColumn("term", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out
