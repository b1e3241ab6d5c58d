"""Session settings and the materialisation helpers every plan shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app_name: str = "loomgraph", master: str | None = None, **conf) -> SparkSession:
    """Session with adaptive execution, UTC and Arrow on; extra settings by keyword (dots as '__')."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    }
    settings.update({k.replace("__", "."): str(v) for k, v in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's spark.checkpoint.dir; fall back to a scratch folder only in local mode."""
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if configured:
        if current is None:
            sc.setCheckpointDir(configured)
        return configured
    if current is not None:
        return current
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder before running iterative plans")
    scratch = tempfile.mkdtemp(prefix="loomgraph-checkpoint-")
    sc.setCheckpointDir(scratch)
    return scratch


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` once as a table under the shared checkpoint folder and continue from it.

    Used where a result feeds several branches or an iteration must drop its lineage. The files
    outlive executors, keep column pruning for the readers, and are written in a single pass
    (``checkpoint()`` would compute the last stage twice). The folder belongs to the application.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/loomgraph-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def keep(df: DataFrame) -> DataFrame:
    """Cache with spill to disk. Lost blocks are recomputed from lineage, so this is only a speed-up."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)


MAX_CLIENT_ROWS = 100_000


def client_hint(df: DataFrame, key: str = "client_id", limit: int = MAX_CLIENT_ROWS):
    """Join hint for tables with one row per ``key``: broadcast once the key count of ``df`` is seen
    to be within ``limit``, otherwise leave the join to Spark."""
    few = df.select(key).distinct().limit(limit + 1).count() <= limit
    return F.broadcast if few else (lambda table: table)


def spread(df: DataFrame) -> DataFrame:
    """Use all cores on an input that arrives in fewer partitions than cores (one small file)."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
