"""Session helpers: sane defaults for local tests, nothing forced on a cluster."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings applied only by ``local_session`` (tests, bench). A cluster session
# keeps whatever its operator configured.
LOCAL_CONF = {
    "spark.sql.shuffle.partitions": "8",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.driver.memory": "16g",
}


def local_session(master: str = "local[8]", app: str = "concentra", **extra) -> SparkSession:
    builder = SparkSession.builder.master(master).appName(app)
    for k, v in {**LOCAL_CONF, **extra}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_OWN: dict[str, str] = {}  # application id -> folder made by us (local sessions only)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: the session's
    checkpoint folder (``spark.checkpoint.dir``), used as it is.

    Only a local session that names none gets a temporary folder, which is
    removed when the process ends; on a cluster that would be a different
    folder on every machine, so it is an error there.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    try:
        sc = spark.sparkContext
    except Exception:  # Spark Connect has no context; the setting is all there is
        sc = None
    if sc is not None:
        named = sc.getCheckpointDir() or named
    if named:
        return named
    if sc is None or not sc.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set: name a folder that the driver and all executors share"
        )
    if sc.applicationId not in _OWN:
        _OWN[sc.applicationId] = tempfile.mkdtemp(prefix="concentra-")
        atexit.register(shutil.rmtree, _OWN[sc.applicationId], ignore_errors=True)
    return _OWN[sc.applicationId]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the session's shared folder."""
    return os.path.join(shared_dir(spark), "scratch", f"{name}-{uuid.uuid4().hex[:12]}")


def table(spark: SparkSession, sf_dir: str, name: str):
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
