"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of an Arrow batch that travels to Python: long texts must not pile up in one batch.
BATCH_BYTES = 4 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Hold Spark's Arrow batches to BATCH_BYTES in this session; rows stay as they are set."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir); a temporary one only where that is unset, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("voxloom.shared.dir", None)
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="voxloom-")
        spark.conf.set("voxloom.shared.dir", found)
    return found.rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def maybe_broadcast(df: DataFrame, rows: int, max_rows: int) -> DataFrame:
    """Broadcast hint for a table that was counted; beyond max_rows the join stays a shuffle join that AQE can split."""
    return F.broadcast(df) if rows <= max_rows else df


def crc32_of_id(col: Column) -> Column:
    return F.crc32(col.cast("string"))


def free_name(df: DataFrame, base: str) -> str:
    """A column name that df doesn't have, in any case of letters."""
    taken, name = {c.lower() for c in df.columns}, f"__{base}"
    while name in taken:
        name += "_"
    return name
