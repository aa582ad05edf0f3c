"""Filtering the original lines by flags."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import UNIQUE, InvalidFormat
from ..sources.manifest import source_offset


def apply_flags(lines: DataFrame, flags: DataFrame, *, offset: int = 0, idx: str = "item_number", check: bool = True) -> DataFrame:
    """Lines whose flag at ``offset`` + idx is unique, with that place as global_idx; all other columns stay.

    Fewer lines than flags are fine. With ``check``, a line beyond the last flag is InvalidFormat before any work
    is done; without it the job fails at that line.
    """
    placed = lines.drop("global_idx").withColumn("global_idx", F.col(idx) + F.lit(offset))
    if check:
        top, n = placed.agg(F.max("global_idx")).first()[0], flags.count()
        if top is not None and top >= n:
            raise InvalidFormat(f"{top + 1} documents, but {n} flags")
    joined = placed.join(flags.select("global_idx", "flag"), "global_idx", "left")
    flag = F.when(F.col("flag").isNull(), F.raise_error(F.lit("InvalidFormat: more documents than flags")).cast("string")).otherwise(F.col("flag"))
    return joined.filter(flag == UNIQUE).select("global_idx", *(placed[c] for c in placed.columns if c != "global_idx"))


def apply_whole(lines: DataFrame, flags: DataFrame, *, check: bool = True) -> DataFrame:
    """Unique lines of a whole group, whose item_number is the global index."""
    return apply_flags(lines, flags, check=check)


def apply_each(lines: DataFrame, flags: DataFrame, sources: DataFrame, target: str, *, check: bool = True) -> DataFrame:
    """Unique lines of the one source that ``target`` names."""
    return apply_flags(lines, flags, offset=source_offset(sources, target), check=check)
