"""Places of rows within their key, however many rows a key has.

Rows are dealt by ranges of key and order together, so a key of very many rows lies in many tasks. Each task numbers the runs of
equal keys as they come, and for the one key that a task may have begun within, what earlier tasks have of it is added: a sum
over the tasks' ends, one row for each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..staging import written


def _codes(batch: pa.RecordBatch, at: list[int]) -> np.ndarray:
    """Whether each row but the first has another key than the row before it."""
    change = np.zeros(max(0, batch.num_rows - 1), bool)
    for i in at:
        codes = batch.column(i).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        change |= codes[1:] != codes[:-1]
    return change


def _numbered(at: list[int]):
    """Sorted rows and, last, their place within the run of their key in this task, from 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            starts = np.append(True, _codes(batch, at))
            begin = np.maximum.accumulate(np.where(starts, np.arange(len(starts)), 0))
            place = np.arange(len(starts)) - begin + 1
            if last is not None and last == [batch.column(i)[0].as_py() for i in at]:
                place[begin == 0] += held
            last, held = [batch.column(i)[-1].as_py() for i in at], int(place[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place)], names=[*batch.schema.names, "rank"])

    return run


def ranked(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """``rows`` with ``rank``: 1, 2, 3 ... within each key by ``order``, nulls first. Rows that are equal in both are ranked as they lie.

    Ranges are drawn from a sample, for which ``rows`` is run once more: what is costly to make should be a written table."""
    names = rows.columns
    plain = rows.toDF(*(f"c{i}" for i in range(len(names)))).withColumn("part", F.lit(0))
    keys, orders = ([f"c{names.index(c)}" for c in x] for x in (key, order))
    dealt = plain.repartitionByRange(*keys, *orders).sortWithinPartitions(*keys, *orders).withColumn("part", F.spark_partition_id())
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in dealt.schema)
    numbered = written(dealt.mapInArrow(_numbered([names.index(c) for c in key]), f"{kinds}, rank long"), "ranked")
    # The first and the last key of each task, how long the run of the last is, and whether it is all of the task: a row for each task.
    whole = F.struct(*keys)
    first, last = F.min_by(whole, F.struct(*keys, *orders)), F.max_by(F.struct(whole.alias("key"), "rank"), F.struct(*keys, "rank"))
    ends = numbered.groupBy("part").agg(first.alias("first"), last.alias("last"), F.count("*").alias("n")).orderBy("part").collect()
    carried, before = [], (None, 0)
    for r in ends:
        begun = before[1] if before[0] == r.first else 0
        if begun:
            carried.append((r.part, *r.first, begun))
        whole_task = r.last["key"] == r.first
        before = (r.last["key"], r.last["rank"] + (begun if whole_task else 0))
    kind = dict(numbered.dtypes)
    offsets = rows.sparkSession.createDataFrame(carried, ", ".join(["at int", *(f"k{i} {kind[k]}" for i, k in enumerate(keys)), "begun long"]))
    same = F.col("part") == F.col("at")
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"k{i}"))
    found = numbered.join(F.broadcast(offsets), same, "left")
    return found.select(*(F.col(f"c{i}").alias(n) for i, n in enumerate(names)), (F.col("rank") + F.coalesce("begun", F.lit(0))).alias("rank"))
