"""Duplicate flags within a group of sources by shared bands.

A document is a duplicate if another one with a smaller index (in reverse: a larger one) has an equal value in one of
its bands. That is no clustering: flagged documents still make others duplicates in other bands.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DUPLICATE, INDEX_SPLITS, UNIQUE, ConfigError, InvalidFormat, MinHashConfig
from ..functions.signature import band_values, split_of
from ..staging import written
from ..sources.manifest import manifest


@dataclass
class DedupResult:
    """``flags``: global_idx, flag. ``sources``: the manifest. ``index``: bands of unique documents."""

    flags: DataFrame
    sources: DataFrame
    index: DataFrame

    def stats(self) -> DataFrame:
        """total_documents, duplicate_count, duplicate_rate (percent; null where there is no document)."""
        return stats(self.flags)


def stats(flags: DataFrame) -> DataFrame:
    total, dups = F.count("*"), F.count_if(F.col("flag") == DUPLICATE)
    return flags.agg(total.alias("total_documents"), dups.alias("duplicate_count"), F.when(total > 0, dups / total * 100).alias("duplicate_rate"))


def number(docs: DataFrame, order: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Documents (file_path, item_number, ...) with source_idx and global_idx, and the manifest of their sources."""
    sources = manifest(docs, order)
    places = F.broadcast(sources.select("source_idx", "file_path", "offset")) if order is not None else sources.select("source_idx", "file_path", "offset")
    numbered = docs.join(places, "file_path").withColumn("global_idx", F.col("offset") + F.col("item_number")).drop("offset")
    return numbered, sources


def compute_bands(docs: DataFrame, config: MinHashConfig = MinHashConfig(), *, text_col: str = "text", partitions: int | None = None) -> DataFrame:
    """``docs`` with ``bands``, in place of the text.

    With ``partitions`` texts are dealt out anew first: hashing costs far more than moving them where a scan has few
    partitions. Null texts fail: every document must have one.
    """
    text = F.when(F.col(text_col).isNull(), F.raise_error(F.lit(f"MissingField: {text_col}")).cast("string")).otherwise(F.col(text_col))
    rows = docs.repartition(partitions) if partitions else docs
    return rows.withColumn("bands", band_values(text, config)).drop(text_col)


#: Columns that every row of a stored signature table has beside its document's place.
PARAMETERS = ["ngram_size", "num_buckets", "band_size"]


def write_bands(docs: DataFrame, path: str, config: MinHashConfig = MinHashConfig(), *, text_col: str = "text") -> int:
    """Band values of documents (file_path, item_number, text), and the parameters they were made with, as a table; how
    many documents there are. The parameters also stand beside the table, in a row of their own."""
    spark = docs.sparkSession
    rows = compute_bands(docs.select("file_path", "item_number", text_col), config, text_col=text_col)
    rows.select("*", *(F.lit(getattr(config, c)).alias(c) for c in PARAMETERS)).write.mode("overwrite").parquet(path)
    own = spark.createDataFrame([tuple(getattr(config, c) for c in PARAMETERS)], ", ".join(f"{c} int" for c in PARAMETERS))
    own.coalesce(1).write.mode("overwrite").parquet(_parameters(path))
    return spark.read.parquet(path).count()


def _parameters(path: str) -> str:
    return f"{path.rstrip('/')}/_parameters"


def _stored_parameters(spark: SparkSession, path: str) -> MinHashConfig | None:
    """What write_bands() has put down beside a table; None where there is nothing."""
    try:
        return MinHashConfig(*spark.read.parquet(_parameters(path)).select(*PARAMETERS).first())
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def read_bands(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, MinHashConfig]:
    """Stored signatures of one or more tables, and their one configuration.

    ConfigError where there is no table or the parameters differ, InvalidFormat where a table isn't laid out as
    write_bands() does or a row has another number of bands than its parameters say: at once where the parameters must be
    looked for in the rows, and else in the job that meets the row, for then no row is read here.
    """
    if not paths:
        raise ConfigError("no signature tables")
    rows, known = None, [_stored_parameters(spark, p) for p in paths]
    for p in paths:
        part = spark.read.parquet(p)
        if missing := {"file_path", "item_number", "bands", *PARAMETERS} - set(part.columns):
            raise InvalidFormat(f"{p} has no columns {sorted(missing)}")
        rows = part if rows is None else rows.unionByName(part)
    if all(known):
        config = check_same_config(known)
        wrong = F.raise_error(F.lit("InvalidFormat: a row has another number of bands than its parameters say")).cast("array<bigint>")
        right = (F.size("bands") == F.lit(config.num_buckets)) & (F.struct(*PARAMETERS) == F.struct(*(F.lit(getattr(config, c)) for c in PARAMETERS)))
        return rows.withColumn("bands", F.when(right, F.col("bands")).otherwise(wrong)).drop(*PARAMETERS), config
    found = rows.groupBy(*PARAMETERS).agg(F.bool_and(F.size("bands") == F.col("num_buckets")).alias("whole")).collect()
    config = check_same_config([MinHashConfig(*r[:3]) for r in found]) if found else MinHashConfig()
    if not all(r.whole for r in found):
        raise InvalidFormat("a row has another number of bands than its parameters say")
    return rows.drop(*PARAMETERS), config


def explode_bands(banded: DataFrame, *keep: str) -> DataFrame:
    """A row for each band: the columns of ``keep``, bucket_idx, bucket_value.

    The generator is an outer one, whose rows without a band are dropped after it: of the other kind Spark infers a filter on the
    array's size, pushes it below and evaluates what makes the array twice."""
    return banded.select(*keep, F.posexplode_outer("bands").alias("bucket_idx", "bucket_value")).filter("bucket_idx is not null")


def duplicates(bands: DataFrame, *, reverse: bool = False, idx: str = "global_idx") -> DataFrame:
    """The distinct indices that another document of an equal band makes duplicates.

    The keeper of a bucket is aggregated before the shuffle and joined back; no bucket is ever gathered.
    """
    keeper = (F.max if reverse else F.min)(idx)
    buckets = bands.groupBy("bucket_idx", "bucket_value").agg(keeper.alias("keeper"), F.count("*").alias("n")).filter("n > 1").drop("n")
    return bands.join(buckets, ["bucket_idx", "bucket_value"]).filter(F.col(idx) != F.col("keeper")).select(idx).distinct()


def flags_of(banded: DataFrame, *, reverse: bool = False, idx: str = "global_idx") -> DataFrame:
    """idx and flag of every document of ``banded`` (idx, bands).

    Documents of wholly equal bands are first collapsed to their keeper, which flags the others: what collides with
    one of them collides with the keeper too. Documents without a band collide with nothing.
    """
    keeper = (F.max if reverse else F.min)(idx)
    same = banded.filter(F.size("bands") > 0).groupBy("bands").agg(keeper.alias("keeper"))
    heads = same.select(F.col("keeper").alias(idx), "bands")
    dups = duplicates(explode_bands(heads, idx), reverse=reverse, idx=idx)
    unique = heads.select(idx).join(dups, idx, "left_anti").withColumn("unique", F.lit(True))
    every = banded.select(idx, (F.size("bands") == 0).alias("none")).join(unique, idx, "left")
    return every.select(idx, F.when(F.col("unique") | F.col("none"), UNIQUE).otherwise(DUPLICATE).alias("flag"))


def index_entries(banded: DataFrame, flags: DataFrame, *, idx: str = "global_idx") -> DataFrame:
    """Bands of unique documents: group (the source's index), item_number, bucket_value, split, bucket_idx, global_idx."""
    unique = flags.filter(F.col("flag") == UNIQUE).select(idx)
    rows = explode_bands(banded.join(unique, idx, "left_semi"), F.col("source_idx").alias("group"), "item_number", F.col(idx).alias("global_idx"))
    return rows.select(F.col("group").cast("int"), F.col("item_number").cast("int"), "bucket_value", split_of("bucket_value").alias("split"), "bucket_idx", "global_idx")


def write_index(index: DataFrame, path: str) -> None:
    """The index as a table partitioned by split, replacing what was there."""
    index.repartition("split").write.mode("overwrite").partitionBy("split").parquet(path)


INDEX = "group int, item_number int, bucket_value long, bucket_idx int, global_idx long, split int"


def read_index(spark: SparkSession, path: str, *, start: int = 0, end: int = INDEX_SPLITS - 1) -> DataFrame:
    """A written index, or its splits from ``start`` to ``end``: no other folder is read. Splits without a folder have no
    entry."""
    return spark.read.schema(INDEX).parquet(path).filter(F.col("split").between(start, end))


def split_histogram(index: DataFrame) -> DataFrame:
    return index.groupBy("split").agg(F.count("*").alias("entries"))


def dedup(docs: DataFrame, config: MinHashConfig = MinHashConfig(), *, order: list[str] | None = None, reverse: bool = False, text_col: str = "text") -> DedupResult:
    """Flags of documents (file_path, item_number, text). The order of sources, then of items, decides what is older."""
    rows = docs.select("file_path", "item_number", text_col)
    return dedup_bands(compute_bands(rows, config, text_col=text_col), order=order, reverse=reverse)


def dedup_bands(banded: DataFrame, *, order: list[str] | None = None, reverse: bool = False, stored: bool = False) -> DedupResult:
    """dedup() from band values (file_path, item_number, bands) on. They are numbered and written once, unless they are
    ``stored``, that is, read from a table already; and so are the flags."""
    if order is not None and not order:
        raise ConfigError("no sources")
    banded = banded if stored else written(banded, "bands")
    numbered, sources = number(banded, order)
    flags = written(flags_of(numbered, reverse=reverse), "flags")
    return DedupResult(flags, sources, index_entries(numbered, flags))


def check_same_config(configs: list[MinHashConfig]) -> MinHashConfig:
    """The one configuration of a group's signatures."""
    if not configs:
        raise ConfigError("no hash files")
    if len(set(configs)) > 1:
        raise ConfigError(f"different parameters: {sorted(map(str, set(configs)))}")
    return configs[0]


__all__ = ["INDEX_SPLITS", "DedupResult", "check_same_config", "compute_bands", "dedup", "dedup_bands", "duplicates", "explode_bands", "flags_of", "index_entries", "number", "read_bands", "read_index", "split_histogram", "stats", "write_bands", "write_index"]
