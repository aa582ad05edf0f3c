"""The sources of a group: how many documents each holds and where its first stands in the group."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import ConfigError, InvalidFormat

MANIFEST = "source_idx int, item_count long, file_path string"


def with_offsets(sources: DataFrame) -> DataFrame:
    """source_idx, item_count, file_path, offset. One row for each source file, so one window is enough."""
    before = F.sum("item_count").over(Window.orderBy("source_idx").rowsBetween(Window.unboundedPreceding, -1))
    return sources.select("source_idx", "item_count", "file_path", F.coalesce(before, F.lit(0)).cast("long").alias("offset"))


def manifest(docs: DataFrame, order: list[str] | None = None) -> DataFrame:
    """The sources of documents (file_path, ...), in the order given or by path."""
    counts = docs.groupBy("file_path").agg(F.count("*").alias("item_count"))
    if order is None:
        numbered = counts.withColumn("source_idx", F.row_number().over(Window.orderBy("file_path")) - 1)
    else:
        places = docs.sparkSession.createDataFrame([(i, p) for i, p in enumerate(order)], "source_idx int, file_path string")
        numbered = places.join(counts, "file_path", "left").withColumn("item_count", F.coalesce("item_count", F.lit(0)))
    return with_offsets(numbered)


def source_offset(sources: DataFrame, target: str) -> int:
    """The offset of the first source whose path is ``target`` or ends with it."""
    found = sources.filter((F.col("file_path") == target) | F.col("file_path").endswith(target)).orderBy("source_idx").select("offset").first()
    if found is None:
        raise ConfigError(f"no source matches {target}")
    return found[0]


def read_path_list(spark: SparkSession, path: str) -> list[str]:
    """Paths listed one a line; white space around them and empty lines are dropped."""
    rows = spark.read.option("lineSep", "\n").text(path).select(F.trim(F.regexp_replace("value", r"^\s+|\s+$", "")).alias("p"), F.monotonically_increasing_id().alias("i"))
    return [r.p for r in rows.filter("p <> ''").orderBy("i").collect()]


def write_src(sources: DataFrame, path: str) -> None:
    """``item_count TAB file_path`` lines in source order."""
    line = F.concat_ws("\t", F.col("item_count").cast("string"), "file_path").alias("value")
    sources.orderBy("source_idx").select(line).coalesce(1).write.mode("overwrite").text(path)


def read_src(spark: SparkSession, path: str) -> DataFrame:
    """The manifest of write_src(); InvalidFormat where a line has no tab or no unsigned count."""
    rows = spark.read.option("lineSep", "\n").text(path).filter("value <> ''").withColumn("at", F.monotonically_increasing_id())
    parts = F.split("value", "\t", 2)
    split = rows.select("at", parts[0].alias("count"), F.when(F.size(parts) > 1, parts[1]).alias("file_path"))
    good = F.col("file_path").isNotNull() & F.col("count").rlike(r"^\+?[0-9]+$") & F.expr("try_cast(ltrim('+', count) as bigint)").isNotNull()
    bad = split.filter(~good).first()
    if bad is not None:
        raise InvalidFormat(f"bad source line: {bad['count']!r}")
    numbered = split.withColumn("source_idx", F.row_number().over(Window.orderBy("at")) - 1)
    return with_offsets(numbered.select("source_idx", F.expr("cast(ltrim('+', count) as bigint)").alias("item_count"), "file_path"))
