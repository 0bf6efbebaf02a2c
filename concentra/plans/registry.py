"""Registry of named queries: a Spark builder and, where SQL can say the same,
a DuckDB oracle over the shared tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
DIGITS = 6


def round_sql(sql: str, doubles) -> str:
    """Wrap an oracle query so that its double columns are rounded like ``rounded``."""
    if not doubles:
        return sql
    repl = ", ".join(f"round(CAST({c} AS DOUBLE), {DIGITS}) + 0.0 AS {c}" for c in doubles)
    return f"SELECT * REPLACE ({repl}) FROM (\n{sql}\n)"


def register(name: str, sql: str | None = None, doubles=()):
    """Register a query; ``doubles`` names the double columns the oracle must round."""

    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"query {name!r} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = round_sql(sql, list(doubles))
        return fn

    return deco


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Round every double column (results are compared after the last operation)."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            # + 0.0 turns -0.0 into 0.0, as on the oracle side
            cols.append((F.round(F.col(f.name).cast("double"), digits) + F.lit(0.0)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)
