"""Tables written once to the session's shared folder and read back: they cut
lineage and survive the loss of executors."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..session import scratch_path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` under the shared checkpoint folder and read it back."""
    path = scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
