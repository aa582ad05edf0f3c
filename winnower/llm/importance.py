"""Target-distribution importance resampling with exact ranks by parallel sorting.

Documents and the target are bags of hashed word n-grams. What a bucket gains is the logarithm of its smoothed share in the
target over its share in the documents; a document's weight is the sum over its features, and a keyed Gumbel noise added
to weights makes the highest scores a sample without replacement. Gains are one array of ``buckets`` numbers, whatever the input: the
tasks count into such arrays and score by indexing them.

Ranks come from parallel sorting by regular sampling. The scored rows are written as locally sorted runs; rows at regular places
of all runs are the sample, and its quantiles the splitters. Segments between splitters are counted in place, and the
prefix sums of the counts tell where each begins in the order of all rows. Segments that begin within the draw are exchanged, one a task, sorted
from their runs, and numbered from where they begin. The sample sets the sizes of segments alone, and no rank depends on it.
Of the rows only MAX_SAMPLES narrow ones and the splitters reach the driver.

Defined cases: null and empty texts have no feature, a weight of 0, and a score of their noise. A null id has the noise of
an empty one. Ties go to smaller ids, null ids last, then to the row that was read first, so equal rows have ranks of
their own and never share a segment for being equal. Empty tables give no rows; an empty target has a gain like any other,
from smoothing alone. Columns beside id and text aren't read.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import staged, table

WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")
NGRAM = 1
BUCKETS = 10_000
SEED = 2024
MIN_WORDS = 20
PERCENT = 10
#: Rows of a segment that are aimed at, and rows that are sampled for splitters at most.
SEGMENT_ROWS = 4_000_000
MAX_SAMPLES = 1 << 18
#: Features whose bucket a task remembers.
MAX_KNOWN = 1_000_000


class _Buckets(dict):
    """The bucket of a feature's bytes, remembered."""

    def __init__(self, buckets: int):
        super().__init__()
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= MAX_KNOWN:
            self.clear()
        found = self[feature] = zlib.crc32(feature) % self.buckets
        return found


def _features(text: bytes, ngram: int) -> list[bytes]:
    words = WORDS.findall(text.lower())
    if ngram == 1:
        return words
    return [b" ".join(words[i : i + n]) for n in range(1, ngram + 1) for i in range(len(words) - n + 1)]


def _places(batch: pa.RecordBatch, at: int, known: _Buckets, ngram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all features of a batch's texts, how many each text has, and how many words."""
    sizes, words, found = [], [], []
    for text in batch.column(at).cast(pa.binary()).to_pylist():
        features = _features(text or b"", ngram)
        sizes.append(len(features))
        words.append(len(features) if ngram == 1 else len(WORDS.findall((text or b"").lower())))
        found.append(np.fromiter(map(known.__getitem__, features), np.int64, len(features)))
    return np.concatenate(found or [np.zeros(0, np.int64)]), np.array(sizes, np.int64), np.array(words, np.int64)


def bucket_counts(texts: DataFrame, *, ngram: int = NGRAM, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of a table (text) fall on each bucket: every task adds up an array of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total = _Buckets(buckets), np.zeros(buckets, np.int64)
        for batch in batches:
            total += np.bincount(_places(batch, 0, known, ngram)[0], minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["bucket", "n"])

    counts = np.zeros(buckets, np.int64)
    for r in texts.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # of ``buckets`` rows at most
        counts[r.bucket] = r.n
    return counts


def gains(documents: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the smoothed share in the target over that in the documents) of each bucket."""
    s, t, k = float(documents.sum()), float(target.sum()), len(documents)
    return np.floor(1000 * np.log((target + 1.0) * (s + k) / ((documents + 1.0) * (t + k)))).astype(np.int64)


def noise(id_col: Column, seed: int = SEED) -> Column:
    """A Gumbel variable times 1000, rounded down, from a hash of the id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def scored(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", *, ngram: int = NGRAM, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, n_words, weight and score of every row."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    kinds = {"ngram": ngram, "buckets": buckets}
    gain = gains(bucket_counts(rows, **kinds), bucket_counts(target.select(F.col(target_col).alias("text")), **kinds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Buckets(buckets)
        for batch in batches:
            places, sizes, words = _places(batch, 1, known, ngram)
            ends = np.concatenate([[0], np.cumsum(sizes)])
            sums = np.concatenate([[0], np.cumsum(gain[places])])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), pa.array(words), pa.array(sums[ends[1:]] - sums[ends[:-1]])], names=["doc_id", "n_features", "n_words", "weight"])

    found = rows.mapInArrow(run, "doc_id long, n_features long, n_words long, weight long")
    return found.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))


#: The order of ranks: higher scores first, ties to smaller ids, null ids last, then as read.
KEY = ["down", "id", "at"]


def runs(rows: DataFrame) -> DataFrame:
    """Rows (doc_id, score, in_pool, ...) as a written table whose files are locally sorted runs: those in the pool first, in the order
    of KEY, whose columns are added."""
    keyed = rows.withColumn("down", -F.col("score")).withColumn("id", F.coalesce("doc_id", F.lit(2**63 - 1))).withColumn("at", F.monotonically_increasing_id())
    return staged(keyed.sortWithinPartitions(F.desc("in_pool"), *KEY), "runs")


def splitters(pool: DataFrame, parts: int, max_samples: int = MAX_SAMPLES) -> np.ndarray:
    """At most ``parts`` - 1 keys, in order, that cut a table of sorted runs into segments: quantiles of the rows that stand at
    regular places of the runs."""
    stride = max(1, -(-pool.count() // max_samples))
    place = F.col("_metadata.row_index")
    sample = pool.select(*KEY, place.alias("place")).filter(F.pmod(F.col("place"), F.lit(stride)) == stride // 2).select(*KEY).toPandas()
    keys = sample.sort_values(KEY).to_numpy(np.int64).reshape(-1, len(KEY))
    at = np.unique(np.arange(1, parts) * len(keys) // parts) if len(keys) else np.zeros(0, np.int64)
    return keys[at]


def _segments(cuts: np.ndarray, columns: list[str]):
    """Rows with ``segment``: how many splitters their key isn't below."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = np.stack([batch.column(columns.index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in KEY], axis=1)
            keys = np.concatenate([cuts, own])
            is_cut = np.concatenate([np.zeros(len(cuts), np.int64), np.ones(len(own), np.int64)])  # a splitter stands before its equals
            order = np.lexsort((is_cut, keys[:, 2], keys[:, 1], keys[:, 0]))
            below = np.empty(len(order), np.int64)
            below[order] = np.cumsum(is_cut[order] == 0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(below[len(cuts) :].astype(np.int32))], names=[*columns, "segment"])

    return run


def ranked(rows: DataFrame, draw, *, parts: int | None = None, max_samples: int = MAX_SAMPLES) -> DataFrame:
    """``rows`` (doc_id, score, in_pool, ...) with ``rank``: 1, 2, 3 ... of those that are drawn, null elsewhere. ``draw`` is a function of
    the number of rows in the pool to how many are drawn."""
    spark = rows.sparkSession
    every = runs(rows)
    pool = every.filter("in_pool")
    n = pool.count()
    parts = parts or max(1, -(-n // SEGMENT_ROWS), min(int(spark.conf.get("spark.sql.shuffle.partitions")), n // 1000))
    cuts = splitters(pool, parts, max_samples)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in every.schema)
    dealt = pool.mapInArrow(_segments(cuts, every.columns), f"{kinds}, segment int")
    counts = np.zeros(len(cuts) + 1, np.int64)
    for r in dealt.groupBy("segment").agg(F.count("*").alias("n")).collect():  # of ``parts`` rows at most
        counts[r.segment] = r.n
    begins = np.concatenate([[0], np.cumsum(counts)[:-1]])
    drawn = int(draw(n))
    used = int((begins < drawn).sum())  # segments that the draw reaches
    # One segment a task. A row's place in its task is what the generated id holds below the number of the task.
    sent = dealt.filter(F.col("segment") < used).repartitionById(max(1, used), "segment").sortWithinPartitions(*KEY)
    placed = sent.withColumn("inside", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    starts = spark.createDataFrame([(i, int(x)) for i, x in enumerate(begins)], "segment int, begin long")
    rank = F.col("begin") + F.col("inside") + 1
    placed = placed.join(F.broadcast(starts), "segment").withColumn("rank", F.when(rank <= drawn, rank)).drop("begin", "inside", "segment")
    rest = dealt.filter(F.col("segment") >= used).drop("segment").unionByName(every.filter("not in_pool"))
    return placed.unionByName(rest.withColumn("rank", F.lit(None).cast("long"))).drop(*KEY)


def resampled(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", *, percent: int = PERCENT, min_words: int = MIN_WORDS, ngram: int = NGRAM, buckets: int = BUCKETS, seed: int = SEED, parts: int | None = None, max_samples: int = MAX_SAMPLES) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every row: ``percent`` of the rows of at least ``min_words`` words are drawn."""
    found = scored(docs, target, id_col, text_col, target_col, ngram=ngram, buckets=buckets, seed=seed).withColumn("in_pool", F.col("n_words") >= min_words)
    return ranked(found, lambda n: math.floor(percent * n / 100), parts=parts, max_samples=max_samples).select("doc_id", "n_features", "weight", "score", "rank")


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``documents``, and the rank of those drawn to look like ``benchmark``."""
    return resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TOKENS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
SQL = f"""
WITH crc(crc_table) AS (
  SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) FROM range(1)
), doc_words AS (SELECT doc_id, unnest({_TOKENS}) AS word FROM documents
), target_words AS (SELECT unnest({_TOKENS}) AS word FROM benchmark
), buckets AS (
  SELECT word, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(strlen(word)), lambda i: CAST(('0x' || substr(h, 2 * i + 1, 2)) AS BIGINT))),
    lambda c, b: xor(c >> 8, crc_table[(xor(c, b) & 255) + 1])), 4294967295::BIGINT) % {BUCKETS} AS bucket
  FROM (SELECT word, hex(encode(word)) AS h FROM (SELECT DISTINCT word FROM (SELECT word FROM doc_words UNION ALL SELECT word FROM target_words))), crc
), s AS (SELECT bucket, count(*) AS n FROM doc_words JOIN buckets USING (word) GROUP BY bucket
), t AS (SELECT bucket, count(*) AS n FROM target_words JOIN buckets USING (word) GROUP BY bucket
), gain AS (
  SELECT bucket, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * (a.n + {BUCKETS}) / ((coalesce(s.n, 0) + 1)::DOUBLE * (b.n + {BUCKETS})))) AS BIGINT) AS gain
  FROM s FULL JOIN t USING (bucket), (SELECT count(*) AS n FROM doc_words) a, (SELECT count(*) AS n FROM target_words) b
), weighed AS (
  SELECT d.doc_id, coalesce(w.n, 0) AS n_features, coalesce(w.weight, 0) AS weight, CAST('0x' || substr(sha256('{SEED}:' || d.doc_id), 1, 8) AS BIGINT) AS h
  FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n, CAST(sum(gain) AS BIGINT) AS weight FROM doc_words JOIN buckets USING (word) JOIN gain USING (bucket) GROUP BY doc_id) w USING (doc_id)
), final AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5) / 4294967296.0::DOUBLE))) AS BIGINT) AS score FROM weighed
), pool AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM final WHERE n_features >= {MIN_WORDS})
SELECT f.doc_id, n_features, weight, score, CASE WHEN rank <= floor({PERCENT} * n / 100) THEN rank END AS rank FROM final f LEFT JOIN pool p USING (doc_id)
"""
