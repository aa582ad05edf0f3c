"""A stored index that grows group by group: a new group is flagged against it without a look at the old texts.

A folder holds generations, tombstones and a log:

* a generation has the entries of a group's unique documents, partitioned into slices of several splits, and a bitmap beside them: a bit
  for each place that bucket values of a slice fall on. It is written as a whole and never changed;
* tombstones are documents whose entries no longer keep anything;
* the log has a row for each step. What no row names isn't there: a job that dies leaves files and no generation.

A probe takes the new entries to the bitmaps first. Only those with their bit set go on, and only slices of generations that such
an entry leads to are read: the files of all others are skipped. A compaction writes what is alive into one generation; readers of
the folder as it was go on, for nothing is deleted.

There is one writer at a time. The driver holds the log alone: a row for each step.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..config import ConfigError, MinHashConfig
from ..staging import written
from .dedup import check_same_config
from .merge import MergeSource, with_marks

ENTRIES = "group int, item_number int, bucket_value long, bucket_idx int, global_idx long, split int, slice int"
TOMBSTONES = "group int, global_idx long"
LOG = "version long, action string, folder string, group int, entries long, bits long, ngram_size int, num_buckets int, band_size int"
#: Bits of a bitmap for each entry, and of one of its rows.
BITS_PER_ENTRY = 16
ROW_BITS = 32_768
#: Folders of a generation: few enough to be listed at once.
SLICES = 32


@dataclass
class State:
    """The log up to a version: what is alive and what has been dropped."""

    version: int
    config: MinHashConfig | None
    generations: list[Row]
    tombstones: list[str]
    next_group: int


def _steps(path: str) -> str:
    return f"{path}/log"


def create(spark: SparkSession, path: str, config: MinHashConfig) -> None:
    """A folder for groups of one configuration; ConfigError where it has another one already, and a place to go on where it has the same."""
    first = spark.createDataFrame([(0, "create", "", -1, 0, 0, config.ngram_size, config.num_buckets, config.band_size)], LOG)
    first.coalesce(1).write.mode("ignore").parquet(_steps(path))
    check_same_config([state(spark, path).config, config])


def state(spark: SparkSession, path: str) -> State:
    """What the log says. ConfigError where the folder has none."""
    rows = spark.read.schema(LOG).parquet(_steps(path)).orderBy("version").collect()
    if not rows:
        raise ConfigError(f"{path} is no index")
    alive: list[Row] = []
    dropped: list[str] = []
    for r in rows:
        if r.action == "compact":
            alive, dropped = [r], []
        elif r.action == "add":
            alive.append(r)
        elif r.action == "drop":
            dropped.append(r.folder)
    return State(rows[-1].version, MinHashConfig(rows[0].ngram_size, rows[0].num_buckets, rows[0].band_size), alive, dropped, 1 + max(r.group for r in rows))


def _step(spark: SparkSession, path: str, now: State, action: str, folder: str, group: int, entries: int = 0, bits: int = 0) -> None:
    c = now.config
    row = spark.createDataFrame([(now.version + 1, action, folder, group, entries, bits, c.ngram_size, c.num_buckets, c.band_size)], LOG)
    row.coalesce(1).write.mode("append").parquet(_steps(path))


def _slice() -> Column:
    return F.pmod(F.col("split"), F.lit(SLICES)).cast("int")


def _place(bits: int | Column) -> Column:
    """Of an entry among the bits of its slice: the value without what makes the split."""
    return F.pmod(F.shiftrightunsigned("bucket_value", 8), F.lit(bits) if isinstance(bits, int) else bits) + 1


def _write(spark: SparkSession, path: str, entries: DataFrame) -> tuple[str, int, int]:
    """A generation's folder, the number of its entries and the bits of each slice's bitmap."""
    folder = uuid.uuid4().hex
    # Slices are files of their own; large ones become several, small ones share a task.
    entries.drop("slice").withColumn("slice", _slice()).hint("rebalance", "slice").write.partitionBy("slice").parquet(f"{path}/generations/{folder}")
    stored = spark.read.schema(ENTRIES).parquet(f"{path}/generations/{folder}")
    n = stored.count()
    bits = max(ROW_BITS, 1 << (BITS_PER_ENTRY * n // SLICES).bit_length())
    place = _place(bits)
    rows = stored.select("slice", F.bitmap_bucket_number(place).alias("bucket"), F.bitmap_bit_position(place).alias("at"))
    rows.groupBy("slice", "bucket").agg(F.bitmap_construct_agg("at").alias("bitmap")).write.parquet(f"{path}/bitmaps/{folder}")
    return folder, n, bits


def append(spark: SparkSession, path: str, index: DataFrame) -> int:
    """Adds a group's entries, as index_entries() makes them, and returns the group's number. It is seen when all of it is there."""
    now = state(spark, path)
    group = now.next_group
    columns = [c.split()[0] for c in ENTRIES.split(", ")[:-1]]
    folder, n, bits = _write(spark, path, index.select(*(F.lit(group).alias(c) if c == "group" else F.col(c) for c in columns)))
    _step(spark, path, now, "add", folder, group, n, bits)
    return group


def drop_documents(spark: SparkSession, path: str, gone: DataFrame) -> None:
    """Documents (group, global_idx) whose entries are to keep nothing from now on."""
    now = state(spark, path)
    folder = uuid.uuid4().hex
    gone.select(F.col("group").cast("int"), F.col("global_idx").cast("long")).distinct().write.parquet(f"{path}/tombstones/{folder}")
    _step(spark, path, now, "drop", folder, -1)


def _alive(spark: SparkSession, path: str, now: State, entries: DataFrame) -> DataFrame:
    """Entries of documents that haven't been dropped."""
    if not now.tombstones:
        return entries
    gone = spark.read.schema(TOMBSTONES).parquet(*(f"{path}/tombstones/{f}" for f in now.tombstones))
    return entries.join(gone, ["group", "global_idx"], "left_anti")


def stored_entries(spark: SparkSession, path: str, only: dict[str, list[int]] | None = None) -> DataFrame:
    """What is alive in the index; with ``only``, the slices named for each generation's folder and no other file."""
    now = state(spark, path)
    found = spark.createDataFrame([], ENTRIES)
    for g in now.generations:
        slices = None if only is None else only.get(g.folder, [])
        if slices is None or slices:
            rows = spark.read.schema(ENTRIES).parquet(f"{path}/generations/{g.folder}")
            found = found.unionByName(rows if slices is None else rows.filter(F.col("slice").isin(slices)))
    return _alive(spark, path, now, found)


def candidates(spark: SparkSession, path: str, index: DataFrame) -> DataFrame:
    """``index`` with the folders of the generations in whose bitmaps an entry's bit is set, where there is one."""
    now = state(spark, path)
    found = None
    for g in now.generations:
        place = _place(g.bits)
        maps = spark.read.schema("slice int, bucket long, bitmap binary").parquet(f"{path}/bitmaps/{g.folder}")
        rows = index.withColumns({"slice": _slice(), "bucket": F.bitmap_bucket_number(place), "at": F.bitmap_bit_position(place)})
        byte = F.conv(F.hex(F.substring("bitmap", F.floor(F.col("at") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        is_set = F.getbit(byte, F.pmod("at", F.lit(8)).cast("int")) == 1
        hit = rows.join(maps, ["slice", "bucket"]).filter(is_set).select(*index.columns, F.lit(g.folder).alias("folder"))
        found = hit if found is None else found.unionByName(hit)
    return index.limit(0).withColumn("folder", F.lit("")) if found is None else found


def needed_slices(hits: DataFrame) -> dict[str, list[int]]:
    """Generations' folders and the slices of theirs that candidates lead to: SLICES for each generation at most."""
    return {r.folder: sorted(r.slices) for r in hits.groupBy("folder").agg(F.collect_set(_slice()).alias("slices")).collect()}


def probe(spark: SparkSession, path: str, index: DataFrame, *, compat: bool = True) -> DataFrame:
    """The slots (global_idx) of ``index`` that a living document of the stored groups makes duplicates.

    As in a merge buckets are keyed by value alone and slots are item numbers, or with ``compat=False`` band and value, and places in
    the group.
    """
    key = ["bucket_value"] if compat else ["bucket_idx", "bucket_value"]
    hits = written(candidates(spark, path, index.select("item_number", "global_idx", "split", "bucket_idx", "bucket_value")), "candidates")
    stored = stored_entries(spark, path, needed_slices(hits))
    # Both sides hold about one entry of a value, and no rows but those that have a partner are kept.
    slot = F.col("item_number" if compat else "global_idx").cast("long").alias("global_idx")
    return hits.join(stored.select(*key), key, "left_semi").select(slot).distinct()


def flag_group(spark: SparkSession, path: str, own: MergeSource, *, compat: bool = True) -> DataFrame:
    """global_idx and flag of a new group: its own flags, and duplicates of what is stored."""
    marks = probe(spark, path, own.index, compat=compat).select(F.lit(0).alias("group_idx"), "global_idx")
    return with_marks(own.flags.select(F.lit(0).alias("group_idx"), "global_idx", "flag"), marks).drop("group_idx")


def compact(spark: SparkSession, path: str) -> None:
    """One generation in place of all, without the entries of dropped documents. Old files stay for those who read them."""
    now = state(spark, path)
    folder, n, bits = _write(spark, path, stored_entries(spark, path))
    _step(spark, path, now, "compact", folder, now.next_group - 1, n, bits)
