"""Spark session helpers.

Everything in the library runs on an existing ``SparkSession``; these helpers
only create one for tests/bench and find the shared folder used to cut lineage.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings that matter for every job of the library (AQE re-plans shuffles,
# coalesces small partitions and splits skewed join partitions at runtime).
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # the call site of every column expression is not recorded: building a plan is mostly that
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def on_workers(spark: SparkSession) -> None:
    """Let Python workers import this package when it is not installed there
    but lies at the same path (local mode, shared home).  Clusters ship it with
    ``--py-files``; then this changes nothing that matters."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if _ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([_ROOT, *paths])


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app: str = "webtext", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.master(master).appName(app)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.setdefault("spark.driver.memory", "16g")
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this must be set by the deployment (a shared file system).
    Only when it is unset and the session is local (tests) a scratch folder is
    created; on a cluster each executor would write to its own.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="webtext-ckpt-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", path)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path below the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex}"


def table(spark: SparkSession, sf_dir: str, name: str):
    """A driver table as it is stored.  Only where ``spark.webtext.spreadInput``
    is set (the benchmark, whose tables are one row group each) it is dealt over
    the cores."""
    df = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
    if spark.conf.get("spark.webtext.spreadInput", "false") != "true":
        return df
    want = spark.sparkContext.defaultParallelism
    return df.repartition(want) if df.rdd.getNumPartitions() < want else df
