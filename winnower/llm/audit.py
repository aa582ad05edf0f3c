"""Filter interaction audit by truth-table survival words.

A document's failures are a mask of five filters, and its survival word has a bit for each of the 32 subsets of filters:
set where it fails none of the subset. Positional popcounts of these words, by carry-save adders over arrays of words, give
the survivors of every subset at once, for each part and label. All that can be asked about an order of filters, what it
removes at which step, what was removed before, what one filter alone removes, and the average over all orders, are
differences of these 32 counts, so the 120 orders cost nothing more.

Texts are read once, for a digest and four of the five filters. The fifth, a copy of a text of smaller id, comes from
digests: the least id is aggregated before the shuffle, and groups of 1 / HOT of all rows or more are broadcast to their rows.
Tasks count words in arrays, so 32 rows for each part leave a task, and a source of a third of all rows is no more than
any other.

Defined cases: null texts are empty, and a null source is the empty string. A row with a null id is a copy where its text has a row with
an id; rows of equal id and text are no copies of each other. Documents without a label count as neither
good nor toxic; of several labels of a document the largest counts. An empty table gives no rows. Columns beside id,
text and source aren't read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import joined_by_digest, staged, table

FILTERS = "ABCDE"
MIN_WORDS = 50
#: Of a hundred: least distinct words among words, most capitals among characters.
DISTINCT_PERCENT = 65
CAPITAL_PERCENT = 5
SYMBOLS = b"#$%&*|"
SUBSETS = 1 << len(FILTERS)
ALL = SUBSETS - 1
#: Parts that a task counts before it puts counts out.
MAX_PARTS = 1024
CLASSES = ["n_all", "n_good", "n_toxic"]


def failures(text: bytes) -> int:
    """The first four filters as bits: too few words, too few distinct ones, too many capitals, a symbol."""
    words = text.split()
    few = len(words) < MIN_WORDS
    same = 100 * len(set(words)) < DISTINCT_PERCENT * len(words)
    capitals = len(text) - len(text.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    characters = len(text) - len(text.translate(None, bytes(b for b in range(256) if b & 0xC0 != 0x80)))
    symbol = len(text.translate(None, SYMBOLS)) < len(text)
    return few | same << 1 | (100 * capitals > CAPITAL_PERCENT * characters) << 2 | symbol << 3


#: The survival word of each mask: bit T is set where the mask and the subset T have no filter in common.
SURVIVAL = np.array([sum(1 << t for t in range(SUBSETS) if not mask & t) for mask in range(SUBSETS)], np.uint32)


def _add(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Carry-save adder of three words, bit by bit: the sums and the carries."""
    half = a ^ b
    return half ^ c, a & b | half & c


def positional_popcount(words: np.ndarray) -> np.ndarray:
    """How many of the words have each of the 32 bits.

    Words of one weight are added three at a time: their sums stay at that weight, and their carries weigh twice as much. When at most
    two words of a weight are left, their bits are counted.
    """
    counts, weight = np.zeros(32, np.int64), 1
    level = np.ascontiguousarray(words, np.uint32)
    while len(level):
        carries = []
        while len(level) > 2:
            third = len(level) // 3
            sums, up = _add(level[:third], level[third : 2 * third], level[2 * third : 3 * third])
            carries.append(up)
            level = np.concatenate([sums, level[3 * third :]])
        for word in level:
            counts += weight * (int(word) >> np.arange(32, dtype=np.int64) & 1)
        level, weight = np.concatenate(carries) if carries else level[:0], 2 * weight
    return counts


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, part, text) to doc_id, part, the failures of the first four filters and the text's digest."""
    for batch in batches:
        texts = [t or b"" for t in batch.column(2).cast(pa.binary()).to_pylist()]
        masks, digests = pa.array([failures(t) for t in texts], pa.int32()), pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary())
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], masks, digests], names=["doc_id", "part", "mask", "digest"])


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """doc_id, part and the whole mask of failures of every row."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.col(text_col).alias("text"))
    own = staged(rows.mapInArrow(_judged, "doc_id long, part string, mask int, digest binary"), "judged")
    groups = own.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    found = joined_by_digest(own, staged(groups, "groups"), "digest", "n")
    later = F.col("first").isNotNull() & ~F.col("doc_id").eqNullSafe(F.col("first"))
    return found.select("doc_id", "part", (F.col("mask") + F.when(later, 16).otherwise(0)).alias("mask"))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, mask, good, toxic) to the survivors of every subset, for each part that the task has."""
    held: dict[str, np.ndarray] = {}

    def out() -> pa.RecordBatch:
        parts, counts = list(held), np.concatenate([*held.values(), np.zeros((0, 3), np.int64)])
        columns = [pa.array(np.repeat(np.array(parts, object), SUBSETS), pa.string()), pa.array(np.tile(np.arange(SUBSETS, dtype=np.int32), len(parts)))]
        return pa.RecordBatch.from_arrays([*columns, *(pa.array(counts[:, i].copy()) for i in range(3))], names=["part", "subset", *CLASSES])

    for batch in batches:
        codes = batch.column(0).dictionary_encode()
        names, code = codes.dictionary.to_pylist(), codes.indices.to_numpy()
        words = SURVIVAL[batch.column(1).to_numpy()]
        good, toxic = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
        order = np.argsort(code, kind="stable")
        bounds = np.searchsorted(code[order], np.arange(len(names) + 1))
        for name, low, high in zip(names, bounds, bounds[1:], strict=False):
            rows = order[low:high]
            found = np.stack([positional_popcount(words[r]) for r in (rows, rows[good[rows]], rows[toxic[rows]])], axis=1)
            held[name] = held[name] + found if name in held else found
            if len(held) >= MAX_PARTS:
                yield out()
                held.clear()
    if held:
        yield out()


def survivors(masks: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """part, subset, n_all, n_good and n_toxic: how many documents fail no filter of a subset, of rows (doc_id, part, mask)."""
    known = labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(*(F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(n) for c, n in (("quality", "good"), ("toxic", "toxic"))))
    rows = masks.join(known, "doc_id", "left").select("part", "mask", *(F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")))
    counts = rows.mapInArrow(_counted, "part string, subset int, n_all long, n_good long, n_toxic long")
    return counts.groupBy("part", "subset").agg(*(F.sum(c).alias(c) for c in CLASSES))


def _orders() -> list[tuple[str, list[tuple[int, int]]]]:
    """Every order of filters, and at each step the filter and the subset before it."""
    return [("".join(FILTERS[x] for x in order), [(x, sum(1 << y for y in order[:i])) for i, x in enumerate(order)]) for order in permutations(range(len(FILTERS)))]


def shapley_orders(filter_: int, counts: np.ndarray) -> int:
    """What a filter removes, summed over all orders: each subset before it stands in |P|! (4 - |P|)! of them."""
    rest = [p for p in range(SUBSETS) if not p >> filter_ & 1]
    return sum(math.factorial(p.bit_count()) * math.factorial(len(FILTERS) - 1 - p.bit_count()) * int(counts[p] - counts[p | 1 << filter_]) for p in rest)


AUDIT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def _audited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, all, good, toxic), lists of 32 counts, to a row for each order and step."""
    orders = _orders()
    names = [c.split()[0] for c in AUDIT.split(", ")]
    for batch in batches:
        for row in batch.to_pylist():
            s, good, toxic = (np.array(row[c], np.int64) for c in CLASSES)
            shapley = [shapley_orders(x, s) for x in range(len(FILTERS))]
            rows = []
            for order, steps in orders:
                for i, (x, before) in enumerate(steps):
                    after = before | 1 << x
                    removed = int(s[before] - s[after])
                    rows.append((row["part"], order, i + 1, int(s[after]), removed, int(s[0] - s[1 << x]) - removed, int(s[ALL ^ 1 << x] - s[ALL]), int(good[before] - good[after]), int(toxic[before] - toxic[after]), shapley[x]))
            yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema=_SCHEMA)


_SCHEMA = pa.schema([(c.split()[0], {"string": pa.string(), "int": pa.int32(), "long": pa.int64()}[c.split()[1]]) for c in AUDIT.split(", ")])


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """Every part, order of filters and step: what is kept after it, what it removes, and what that costs."""
    counts = survivors(judged(docs, id_col, text_col, part_col), labels)
    lists = [F.array_sort(F.collect_list(F.struct("subset", c)))[c].alias(c) for c in CLASSES]  # of 32
    return counts.groupBy("part").agg(*lists).mapInArrow(_audited, AUDIT)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders of five filters over ``documents``, for each source."""
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


SQL = rf"""
WITH base AS (
  SELECT d.doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, coalesce(quality = 1, false) AS good, coalesce(toxic = 1, false) AS toxic
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
), cut AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS first FROM base
), failed AS (
  SELECT part, good, toxic, CAST(len(words) < {MIN_WORDS} AS INTEGER) + 2 * CAST(100 * len(list_distinct(words)) < {DISTINCT_PERCENT} * len(words) AS INTEGER)
    + 4 * CAST(100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > {CAPITAL_PERCENT} * length(text) AS INTEGER) + 8 * CAST(regexp_matches(text, '[#$%&*|]') AS INTEGER) + 16 * CAST(doc_id > first AS INTEGER) AS mask
  FROM cut
), masks AS (SELECT part, mask, count(*) AS n, count_if(good) AS g, count_if(toxic) AS t FROM failed GROUP BY part, mask
), letter(f, name) AS (VALUES (0, 'A'), (1, 'B'), (2, 'C'), (3, 'D'), (4, 'E')
), orders AS (
  SELECT a.name || b.name || c.name || d.name || e.name AS filter_order, [a.f, b.f, c.f, d.f, e.f] AS f
  FROM letter a JOIN letter b ON b.f <> a.f JOIN letter c ON c.f NOT IN (a.f, b.f) JOIN letter d ON d.f NOT IN (a.f, b.f, c.f) JOIN letter e ON e.f NOT IN (a.f, b.f, c.f, d.f)
), steps AS (
  SELECT filter_order, step, 1 << f[step] AS bit, list_sum(list_transform(f[1:step - 1], lambda y: 1 << y)) AS earlier FROM (SELECT *, unnest([1, 2, 3, 4, 5]) AS step FROM orders)
), counted AS (
  SELECT part, filter_order, step, bit, sum(CASE WHEN mask & (coalesce(earlier, 0)::INTEGER | bit) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN mask & bit > 0 AND mask & coalesce(earlier, 0)::INTEGER = 0 THEN n ELSE 0 END) AS removed, sum(CASE WHEN mask & bit > 0 AND mask & coalesce(earlier, 0)::INTEGER > 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN mask & bit > 0 AND mask & coalesce(earlier, 0)::INTEGER = 0 THEN g ELSE 0 END) AS good_lost,
    sum(CASE WHEN mask & bit > 0 AND mask & coalesce(earlier, 0)::INTEGER = 0 THEN t ELSE 0 END) AS toxic_lost
  FROM masks, steps GROUP BY part, filter_order, step, bit
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM counted
"""
