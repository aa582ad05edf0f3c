"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from .config import ConfigError


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; ConfigError on a cluster where that is
    unset, for no other folder is known to be shared; on one machine a local folder is made and set."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and spark.sparkContext.master.split("[")[0] == "local":  # one machine: tests, a laptop
        root = "file://" + tempfile.mkdtemp(prefix="winnower-")
        spark.conf.set("spark.checkpoint.dir", root)
    if not root:
        raise ConfigError("spark.checkpoint.dir is not set: it names the folder that driver and executors share")
    return root.rstrip("/")


def dealt(df: DataFrame) -> DataFrame:
    """A scan dealt out to all cores where it has fewer partitions than there are cores; one of more partitions isn't moved."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table written once: what is read twice isn't computed twice, and a loss costs one task."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
