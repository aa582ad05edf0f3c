"""Duplicate flags of documents as they arrive.

A document is a duplicate if one that arrived before it, in an earlier batch or with a smaller index in its own, has an equal band. Of
each batch the bands that are new are kept; what was seen is never hashed again, and flagged documents make others
duplicates as well as unique ones do. A batch writes under its number and reads what stands under smaller ones, so one that is
repeated after a failure replaces its own rows and comes to the same flags.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import DUPLICATE, MinHashConfig
from ..operators.dedup import compute_bands, explode_bands, flags_of
from ..staging import written

SEEN = "bucket_idx int, bucket_value long, batch long"


def _seen(spark: SparkSession, path: str, batch: int) -> DataFrame:
    """Bands of the batches before one. Batches are folders, so those of other numbers aren't read."""
    if not batch:
        return spark.createDataFrame([], SEEN)
    return spark.read.schema(SEEN).parquet(f"{path}/seen").filter(F.col("batch") < batch)


def flag_batch(docs: DataFrame, batch: int, path: str, config: MinHashConfig, idx: str = "doc_id") -> None:
    """Writes the flags (idx, flag) and new bands of one batch of documents (idx, text)."""
    spark = docs.sparkSession
    banded = written(compute_bands(docs.select(idx, "text"), config), "bands")
    bands = explode_bands(banded, idx)
    seen = _seen(spark, path, batch)
    met = bands.join(seen.select("bucket_idx", "bucket_value"), ["bucket_idx", "bucket_value"], "left_semi")
    earlier = met.select(idx).distinct().withColumn("earlier", F.lit(True))
    flags = flags_of(banded, idx=idx).join(earlier, idx, "left")
    flags.select(idx, F.when(F.col("earlier"), DUPLICATE).otherwise(F.col("flag")).alias("flag")).write.mode("overwrite").parquet(f"{path}/flags/batch={batch}")
    own = bands.select("bucket_idx", "bucket_value").distinct()
    own.join(seen.select("bucket_idx", "bucket_value"), ["bucket_idx", "bucket_value"], "left_anti").write.mode("overwrite").parquet(f"{path}/seen/batch={batch}")


def flag_stream(docs: DataFrame, path: str, config: MinHashConfig = MinHashConfig(), *, idx: str = "doc_id", available_now: bool = True) -> StreamingQuery:
    """Starts a query that flags a stream of documents (idx, text). State, flags and the checkpoint lie under ``path``; a query that is
    started again there goes on where the last one stopped."""

    def step(batch: DataFrame, number: int) -> None:
        flag_batch(batch, number, path, config, idx)

    out = docs.select(idx, "text").writeStream.foreachBatch(step).option("checkpointLocation", f"{path}/checkpoint")
    return (out.trigger(availableNow=True) if available_now else out).start()


def stream_flags(spark: SparkSession, path: str, idx: str = "doc_id") -> DataFrame:
    """idx and flag of all that has been flagged."""
    return spark.read.parquet(f"{path}/flags").select(idx, "flag")
