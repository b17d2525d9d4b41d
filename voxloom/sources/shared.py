"""Paths and tables in the folder that a cluster's machines share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Bytes of an Arrow batch that travels to Python: as Python objects, words take some fifteen times that, audio three times.
BATCH_BYTES = 4 << 20


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in spark.checkpoint.dir; a temporary folder stands in only where that is unset, in local mode."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("voxloom.scratch.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        found = "file://" + tempfile.mkdtemp(prefix="voxloom-")
        spark.conf.set("voxloom.scratch.dir", found)
    return f"{found.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: cuts the lineage and survives lost executors."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession | None = None) -> None:
    """Hold Spark's Arrow batches to BATCH_BYTES in this session (the active one); rows stay as they are set."""
    spark = spark or SparkSession.active()
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
