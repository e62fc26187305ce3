"""Cluster-facing helpers: shared scratch storage, lineage cuts and size checks."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A side is broadcast only when an action has shown it is below both bounds.
BROADCAST_MAX_ROWS = 500_000
BROADCAST_MAX_BYTES = 64 * 1024 * 1024


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by the cluster in spark.checkpoint.dir."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return configured


def provide_folder(spark: SparkSession) -> None:
    """Name a folder for a local session, as in tests, that has none. Clusters name theirs."""
    if spark.conf.get("spark.checkpoint.dir", None) is None and re.match(r"local(\[|$)", spark.sparkContext.master):
        spark.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="prepwright-"))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Store as Parquet in the shared folder and read back.

    The rows survive the loss of any executor and later readers get columns, statistics
    and pruning.
    """
    path, schema = scratch_path(df.sparkSession, "step"), df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def is_broadcastable(df: DataFrame) -> bool:
    """Measure a materialised frame: rows and a text-length estimate of its bytes."""
    width = sum((F.coalesce(F.length(F.col(f"`{c}`").cast("string")), F.lit(0)) * 2 + 16
                 for c in df.columns), F.lit(0))
    row = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(width), F.lit(0)).alias("b")).first()
    return row["n"] <= BROADCAST_MAX_ROWS and row["b"] <= BROADCAST_MAX_BYTES


def attach(df: DataFrame, dim: DataFrame, on: list[str]) -> DataFrame:
    """Left-join a frame that has one row per key.

    The dimension is materialised and measured once. If it is provably small it is
    broadcast and the big side never moves; otherwise a plain equi-join is left to
    AQE, which splits a hot key of the big side by map output since the dimension
    holds a single row for it.
    """
    dim = cut_lineage(dim)
    return df.join(F.broadcast(dim) if is_broadcastable(dim) else dim, on, "left")
