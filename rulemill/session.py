"""Session settings and the shared folder that intermediate tables go to."""
from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A side is broadcast only after its row count was checked against this bound.
BROADCAST_ROWS = 1_000_000
# How text files are written: compressed, since their lines repeat names and texts, and in files of bounded length, since a
# compressed file is read by one task.
TEXT_FILES = {"compression": "gzip", "maxRecordsPerFile": "500000"}
# Intermediate tables hold texts of a few patterns too.
TABLE_FILES = {"compression": "zstd"}


def build_session(app_name: str = "rulemill", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables: the one the cluster names, or a local one for tests."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    local = tempfile.mkdtemp(prefix="rulemill-")
    spark.conf.set("spark.checkpoint.dir", local)
    return local


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder; nothing is ever overwritten or removed."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write a table once and read it back, so that later steps neither repeat nor depend on its lineage."""
    path = new_path(df.sparkSession, label)
    df.write.options(**TABLE_FILES).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only when a bounded count proves the side small; otherwise leave a shuffle join."""
    if df.limit(max_rows + 1).count() <= max_rows:
        return F.broadcast(df)
    return df
