"""Shared scratch storage for tables that cut lineage.

Two kinds of table are written here: range-ordered frame tables (see
``operators.ordering``) and small aggregates that a later join needs.  A written
aggregate has an exact size, so the planner broadcasts it only when it is below
``spark.sql.autoBroadcastJoinThreshold`` and otherwise falls back to a shuffled
join with adaptive skew handling.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_folder: str | None = None


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local session (tests, a laptop) may go without the setting.
    """
    global _local_folder
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    if _local_folder is None:
        _local_folder = tempfile.mkdtemp(prefix="canlake-")
    return _local_folder


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path for one table; never reused, so retries cannot mix runs."""
    app = spark.sparkContext.applicationId
    return f"{scratch_root(spark)}/canlake/{app}/{label}-{uuid.uuid4().hex}"


def settle(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once and read it back with a known size and fixed content."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
