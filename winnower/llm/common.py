"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's ``spark.checkpoint.dir``. ValueError on a cluster where that
    is unset, for no other folder is known to be shared; on one machine a local folder is made and set."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and spark.sparkContext.master.split("[")[0] == "local":  # one machine: tests, a laptop
        root = "file://" + tempfile.mkdtemp(prefix="winnower-")
        spark.conf.set("spark.checkpoint.dir", root)
    if not root:
        raise ValueError("spark.checkpoint.dir is not set: it names the folder that driver and executors share")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


#: A group of this part of all rows or more is hot; there are not more than so many.
HOT = 1024


def joined_by_digest(rows: DataFrame, groups: DataFrame, key: str, size: str) -> DataFrame:
    """``rows`` with the columns of ``groups`` (a written table of one row for each value of ``key``, ``size`` the number of its rows);
    nulls where a row has no group.

    Groups of 1 / HOT of all rows or more are broadcast to their rows, HOT of them at most; other groups are joined by
    a shuffle, in which none of them is more than that."""
    total = groups.agg(F.sum(size)).first()[0] or 0
    hot = groups.filter(F.col(size) * HOT >= total)
    often = rows.join(F.broadcast(hot), key)
    seldom = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(groups.filter(F.col(size) * HOT < total), key, "left")
    return often.unionByName(seldom)


def with_column(df: DataFrame, text: str, name: str, kind: DataType, make: Callable[[list[bytes]], pa.Array]) -> DataFrame:
    """``df`` and a last column that is made of its text column's bytes, null texts as empty ones. All Python of a stage runs in
    one kind of worker, so that an executor holds one for each core."""
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = make([x or b"" for x in batch.column(at).cast(pa.binary()).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns, made], names=[*(f"c{i}" for i in range(batch.num_columns)), "made"])

    places = StructType([StructField(f"c{i}", f.dataType) for i, f in enumerate(df.schema)])
    found = df.toDF(*(f"c{i}" for i in range(len(df.columns)))).mapInArrow(run, StructType([*places, StructField("made", kind)]))
    return found.toDF(*df.columns, name)
