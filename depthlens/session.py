"""Session settings shared by every operator."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

BLOCK_ROWS_CONF = "spark.depthlens.blockRows"
DEFAULT_BLOCK_ROWS = 65_536


def block_rows(spark: SparkSession) -> int:
    """Largest number of rows of one key that a single window task may hold."""
    return int(spark.conf.get(BLOCK_ROWS_CONF, str(DEFAULT_BLOCK_ROWS)))


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for written intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``.  Only a local master, where
    driver and executors share one disk, may fall back to a fresh temporary folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    path = tempfile.mkdtemp(prefix="depthlens-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def write_table(df, name: str):
    """Write ``df`` under the checkpoint folder and read it back (cuts lineage)."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)
