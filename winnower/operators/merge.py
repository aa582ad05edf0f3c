"""Duplicates across groups from their indices.

With ``compat`` the rules of the original tool hold to the letter: buckets are keyed by value alone, an entry marks the
slot of its item number whatever its source, and every entry of a run across groups but the first (in reverse: the
last) is a mark, those of the keeper's own other bands included. Without it buckets are keyed by band and value, slots
are global indices, and a keeper is never marked by itself.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DUPLICATE, UNIQUE, ConfigError, InvalidFormat


@dataclass
class MergeSource:
    """One group: its index and its flags (global_idx, flag)."""

    index: DataFrame
    flags: DataFrame


@dataclass
class MergeResult:
    """``flags``: group_idx, global_idx, flag. ``cross``: one row, cross_duplicates, the number of marks."""

    flags: DataFrame
    cross: DataFrame

    def of(self, group: int) -> DataFrame:
        return self.flags.filter(F.col("group_idx") == group).drop("group_idx")


def merge(sources: list[MergeSource], *, start: int = 0, end: int = 255, reverse: bool = False, compat: bool = True) -> MergeResult:
    """Flags of all groups after marking what splits ``start`` to ``end`` share. An empty range marks nothing. A mark whose slot has no
    flag is InvalidFormat, raised by the job that meets it; slots that aren't marked may lie anywhere.

    Entries of a slot are counted before the shuffle, and a bucket's keeper is aggregated and joined back.
    """
    if not sources:
        raise ConfigError("no sources")
    key = ["bucket_value"] if compat else ["bucket_idx", "bucket_value"]
    slot = "item_number" if compat else "global_idx"
    entries = flags = None
    for g, s in enumerate(sources):
        own = s.index.filter(F.col("split").between(start, end)).select(F.lit(g).alias("group_idx"), F.col(slot).cast("long").alias("slot"), *key)
        mine = s.flags.select(F.lit(g).alias("group_idx"), "global_idx", "flag")
        entries, flags = (own, mine) if entries is None else (entries.unionByName(own), flags.unionByName(mine))
    slots = entries.groupBy(*key, "group_idx", "slot").agg(F.count("*").alias("times"))
    # The place of a slot in the order of groups and items as one number: at most 2^40 items, 2^23 groups.
    place = F.shiftleft(F.col("group_idx").cast("long"), 40) + F.col("slot")
    slots = slots.withColumn("place", place)
    pick = F.max if reverse else F.min
    runs = slots.groupBy(*key).agg(F.min("group_idx").alias("low"), F.max("group_idx").alias("high"), pick("place").alias("keeper"), F.sum("times").alias("n")).filter("low <> high")
    cross = runs.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("cross_duplicates"))
    again = (F.col("times") > 1) if compat else F.lit(False)
    marks = slots.join(runs.select(*key, "keeper"), key).filter((F.col("place") != F.col("keeper")) | again).select("group_idx", F.col("slot").alias("global_idx")).distinct()
    return MergeResult(with_marks(flags, marks), cross)


def write_index_table(index: DataFrame, name: str, *, buckets: int = 64) -> None:
    """The index as a table of the catalog, partitioned by split, whose files are dealt by bucket value: what is grouped and joined by
    value later isn't moved any more."""
    rows = index.select("group", "item_number", "bucket_value", "bucket_idx", "global_idx", "split")
    rows.repartition(buckets, "bucket_value").write.mode("overwrite").partitionBy("split").bucketBy(buckets, "bucket_value").sortBy("bucket_value").saveAsTable(name)


def merge_tables(spark: SparkSession, sources: list[tuple[str, DataFrame]], *, start: int = 0, end: int = 255, reverse: bool = False) -> MergeResult:
    """merge() from tables of write_index_table() and the groups' flags, by value and item number.

    Files of the splits asked for alone are read, and entries are counted, matched and marked in the buckets that they lie in; marks are
    all that is moved. Tables of unlike numbers of buckets work too, with a shuffle.
    """
    if not sources:
        raise ConfigError("no sources")
    runs = flags = None
    slots = []
    for g, (name, own) in enumerate(sources):
        entries = spark.table(name).filter(F.col("split").between(start, end)).select("bucket_value", F.col("item_number").cast("long").alias("slot"))
        slots.append(entries.groupBy("bucket_value", "slot").agg(F.count("*").alias("times")))
        ends = slots[-1].groupBy("bucket_value").agg((F.max if reverse else F.min)("slot").alias("slot"), F.sum("times").alias("n"))
        ends = ends.select("bucket_value", F.struct(F.lit(g).alias("g"), "slot").alias("keeper"), "n", F.lit(1).alias("groups"))
        mine = own.select(F.lit(g).alias("group_idx"), "global_idx", "flag")
        flags = mine if flags is None else flags.unionByName(mine)
        if runs is None:
            runs = ends
            continue
        # Groups come in order, so the keeper is the first that a value has, or in reverse the last.
        right = ends.select("bucket_value", F.col("keeper").alias("k"), F.col("n").alias("m"), F.col("groups").alias("h"))
        keeper = F.coalesce("k", "keeper") if reverse else F.coalesce("keeper", "k")
        total = lambda a, b: (F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))
        runs = runs.join(right, "bucket_value", "full").select("bucket_value", keeper.alias("keeper"), total("n", "m").alias("n"), total("groups", "h").alias("groups"))
    runs = runs.filter("groups > 1")
    cross = runs.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("cross_duplicates"))
    marks = None
    for g, own in enumerate(slots):
        other = (F.col("keeper.g") != g) | (F.col("keeper.slot") != F.col("slot")) | (F.col("times") > 1)
        found = own.join(runs.select("bucket_value", "keeper"), "bucket_value").filter(other).select(F.lit(g).alias("group_idx"), F.col("slot").alias("global_idx"))
        marks = found if marks is None else marks.unionByName(found)
    return MergeResult(with_marks(flags, marks.distinct()), cross)


def with_marks(flags: DataFrame, marks: DataFrame) -> DataFrame:
    """``flags`` (group_idx, global_idx, flag) with duplicates at the slots of ``marks``, which are distinct."""
    both = flags.join(marks.withColumn("mark", F.lit(True)), ["group_idx", "global_idx"], "full")
    unknown = F.raise_error(F.concat(F.lit("InvalidFormat: item "), F.col("global_idx").cast("string"), F.lit(" is out of bounds for group "), F.col("group_idx").cast("string"))).cast("string")
    flag = F.when(F.col("flag").isNull(), unknown).when(F.col("mark"), DUPLICATE).otherwise(F.col("flag"))
    return both.select("group_idx", "global_idx", flag.alias("flag"))


def check_range(sources: list[MergeSource], *, start: int = 0, end: int = 255, compat: bool = True) -> None:
    """InvalidFormat where an index entry of the splits has no flag, marked or not: a check of what is to be merged."""
    slot = "item_number" if compat else "global_idx"
    for s in sources:
        top = s.index.filter(F.col("split").between(start, end)).agg(F.max(slot)).first()[0]
        if top is not None and top >= s.flags.count():
            raise InvalidFormat(f"item {top} has no flag")


def either(a: DataFrame, b: DataFrame) -> DataFrame:
    """Flags that compose the results of two split ranges: duplicate in one is duplicate."""
    other = b.select("group_idx", "global_idx", F.col("flag").alias("other"))
    return a.join(other, ["group_idx", "global_idx"]).select("group_idx", "global_idx", F.when((F.col("flag") == UNIQUE) & (F.col("other") == UNIQUE), UNIQUE).otherwise(DUPLICATE).alias("flag"))
