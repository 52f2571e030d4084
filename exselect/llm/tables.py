"""Intermediate tables in the folder all executors share, and how many keys to deal work into."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from exselect.session import small_side


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir. Only a local session without that setting gets its own scratch folder."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="exselect-llm-"))
        root = spark.sparkContext.getCheckpointDir()
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> str:
    path = shared_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write once to the shared folder and read back: cuts lineage, survives lost executors."""
    return df.sparkSession.read.schema(df.schema).parquet(written(df, name))


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shuffled(df: DataFrame, *keys: str) -> DataFrame:
    """Deal rows by key into the full number of shuffle partitions, whatever their bytes: the work per byte is high."""
    return df.repartition(parts(df.sparkSession), *keys)


def measured_side(df: DataFrame, row_bytes: Column) -> DataFrame:
    """Hint a broadcast of a stored table only if its measured size, thrice over for the hash table, fits the limit."""
    found = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(row_bytes), F.lit(0))).first()
    return small_side(df, 1, 3 * (48 * found[0] + found[1]))
