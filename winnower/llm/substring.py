"""Substring dedup by hashing normalised units: lines or paragraphs, and the clauses in them.

A unit that occurs more than once keeps its earliest occurrence, by document id and then by place; the rest are
removed. Passages that begin in the middle of a line never make a unit of their own, so the clauses of a line are hashed beside
it, into the same groups; ``clauses=False`` leaves lines or paragraphs alone. Removed units of a text that are fewer than ``unit_words``
words apart make one span, reported in code points of the original text. Every line or paragraph that has a word counts, whatever its
length; clauses, which are ours and not lines, need ``unit_words`` words. ``passage`` is 1 for spans of PASSAGE_WORDS words or
more: a greeting is no passage, and who wants to remove passages alone gives remove_spans() that floor.

Texts are read once for the groups and once for the spans, and only digests and offsets are shuffled. A digest's earliest
document is aggregated before the shuffle and joined back, so a line that stands in a third of all texts is split by the
adaptive skew join.

Defined cases: null and empty texts have no units. Null ids come last. Rows of equal ids are one rank: what they share
is not removed from either, and a row that is repeated as a whole is reported once.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .common import table

#: Tiles that cover a text: each ends with its break.
UNITS = {
    "line": r"[^\n]*\n+|[^\n]+",
    "paragraph": r"(?s:.+?)(?:\n\s*\n|\Z)",
}
CLAUSE = r"[^\n.,;:!?]*[\n.,;:!?]+|[^\n.,;:!?]+"
UNIT_WORDS = 3
PASSAGE_WORDS = 25
ROWS = "doc_id long, text_hash long, start int, end int, low int, high int, digest binary, first boolean"
SCHEMA = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("low", pa.int32()), ("high", pa.int32()), ("digest", pa.binary()), ("first", pa.bool_())])
LAST = 2**63 - 1


def text_units(text: str, pattern: re.Pattern, unit_words: int, clause: re.Pattern | None = re.compile(CLAUSE)) -> list[tuple[int, int, int, int, bytes]]:
    """(start, end, low, high, digest) of every line of a word or more and every clause of ``unit_words``, a line before its clauses. Words are lower-cased and
    cut at white space and ends of clauses; ``low`` and ``high`` are the places of a unit's words among all of the text."""
    out, at = [], 0
    for m in pattern.finditer(text):
        begin, end, low = m.start(), m.end(), at
        words = m[0].lower().encode().split()
        parts = []
        for c in clause.finditer(text, begin, end) if clause else ():
            own = c[0].lower().encode().split()
            if own:
                parts.append((c.start(), c.end(), at, at + len(own), own))
                at += len(own)
        if not clause:
            at += len(words)
        if words:
            out.append((begin, end, low, at, _digest(words)))
        # A clause of all the line's words is the line.
        out += [(a, b, x, y, _digest(own)) for a, b, x, y, own in parts if len(own) >= unit_words and own != words]
    return out


def _digest(words: list[bytes]) -> bytes:
    return hashlib.md5(b" ".join(words)).digest()


def units(docs: DataFrame, unit: str = "line", *, id_col: str = "doc_id", text_col: str = "text", unit_words: int = UNIT_WORDS, clauses: bool = True) -> DataFrame:
    """A row for each unit; ``first`` where the text has not had it before."""
    source = UNITS[unit]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern, clause = re.compile(source), re.compile(CLAUSE) if clauses else None
        for batch in batches:
            rows: list[list] = [[] for _ in SCHEMA]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen: set[bytes] = set()
                key = xxhash.xxh64_intdigest(text.encode()) - (1 << 63)
                for start, end, low, high, digest in text_units(text, pattern, unit_words, clause):
                    for column, value in zip(rows, (doc, key, start, end, low, high, digest, digest not in seen), strict=True):
                        column.append(value)
                    seen.add(digest)
                if len(rows[0]) > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, SCHEMA, strict=True)], schema=SCHEMA)
                    rows = [[] for _ in SCHEMA]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, SCHEMA, strict=True)], schema=SCHEMA)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(run, ROWS)


def repeated_spans(docs: DataFrame, unit: str = "line", *, id_col: str = "doc_id", text_col: str = "text", unit_words: int = UNIT_WORDS, min_words: int = 0, clauses: bool = True) -> DataFrame:
    """Spans of ``min_words`` words or more: id, start, end, n_units, n_words, passage, and the document that keeps the span's first unit."""
    found = units(docs, unit, id_col=id_col, text_col=text_col, unit_words=unit_words, clauses=clauses).withColumn("rank", F.coalesce("doc_id", F.lit(LAST)))
    groups = found.groupBy("digest").agg(F.min("rank").alias("kept"), F.count("*").alias("n")).filter("n > 1").drop("n")
    gone = found.join(groups, "digest").filter("rank <> kept or not first").select("doc_id", "text_hash", "start", "end", "low", "high", "kept")
    text = Window.partitionBy("doc_id", "text_hash").orderBy("low", F.desc("high"))
    so_far = F.max("high").over(text.rowsBetween(Window.unboundedPreceding, -1))
    # Rows of equal id and text have equal units: the second of each goes.
    before = F.lag(F.struct("low", "high")).over(text)
    marked = gone.select("*", so_far.alias("so_far"), before.alias("before")).filter(F.col("before").isNull() | (F.col("before") != F.struct("low", "high")))
    runs = marked.withColumn("run", F.sum(F.when(F.col("so_far").isNull() | (F.col("low") - F.col("so_far") >= unit_words), 1).otherwise(0)).over(text))
    spans = runs.groupBy("doc_id", "text_hash", "run").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n_units"), (F.max("high") - F.min("low")).cast("long").alias("n_words"), F.min_by("kept", F.struct("low", -F.col("high"))).alias("kept")
    )
    return spans.filter(F.col("n_words") >= min_words).select(
        F.col("doc_id").alias(id_col), "text_hash", "start", "end", "n_units", "n_words", (F.col("n_words") >= PASSAGE_WORDS).cast("int").alias("passage"), F.when(F.col("kept") != LAST, F.col("kept")).alias("kept_doc_id")
    )


def remove_spans(docs: DataFrame, spans: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_words: int = 0) -> DataFrame:
    """``docs`` without the text of spans of ``min_words`` words or more, and ``kept_spans`` (which replaces a column of that name): (start,
    end) in the original of each piece that stays. All other columns stay, whatever their names."""
    long = spans.filter(F.col("n_words") >= min_words)
    per = long.groupBy(F.col(id_col).alias("of"), F.col("text_hash").alias("of_hash")).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("gone")).withColumn("of_key", F.xxhash64("of"))

    @F.arrow_udf(LongType())
    def hash_of(text: pa.Array) -> pa.Array:
        return pa.array([xxhash.xxh64_intdigest((t or "").encode()) - (1 << 63) for t in text.to_pylist()], pa.int64())

    own = docs[id_col]
    both = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), own.alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("text"), F.xxhash64(own).alias("key"), hash_of(docs[text_col]).alias("hash"))
    joined = both.join(per, (F.col("key") == F.col("of_key")) & F.col("id").eqNullSafe(F.col("of")) & (F.col("hash") == F.col("of_hash")), "left")
    none = F.expr("cast(array() as array<struct<start:int,end:int>>)")
    size = F.length("text")
    edges = F.concat(F.array(F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"))), F.coalesce("gone", none), F.array(F.struct(size.alias("start"), size.alias("end"))))
    pieces = F.transform(F.sequence(F.lit(1), F.size(edges) - 1), lambda i: F.struct(F.element_at(edges, i)["end"].alias("start"), F.element_at(edges, i + 1)["start"].alias("end")))
    joined = joined.withColumn("kept", F.filter(pieces, lambda p: p["end"] > p["start"]))
    text = F.array_join(F.transform("kept", lambda p: F.substring("text", p["start"] + 1, p["end"] - p["start"])), "")
    left = F.when(F.col("gone").isNull(), F.col("row")[text_col]).otherwise(text)
    return joined.select(*((left if c == text_col else F.col("row")[c]).alias(c) for c in docs.columns if c != "kept_spans"), F.col("kept").alias("kept_spans"))


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated lines and passages of all ``documents``, each with the document that keeps it."""
    return repeated_spans(table(spark, sf_dir, "documents")).drop("text_hash")


SQL = rf"""
WITH cut AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\n]*\n+|[^\n]+') AS x FROM documents
), lines AS (
  SELECT doc_id, unnest(x) AS line, generate_subscripts(x, 1) AS n FROM cut
), tiles AS (
  SELECT doc_id, n, line, unnest(y) AS tile, generate_subscripts(y, 1) AS i
  FROM (SELECT *, regexp_extract_all(line, '[^\n.,;:!?]*[\n.,;:!?]+|[^\n.,;:!?]+') AS y FROM lines)
), placed AS (
  SELECT *, sum(length(tile)) OVER w - length(tile) AS start, sum(words) OVER w - words AS low FROM (
    SELECT *, CASE WHEN norm = '' THEN 0 ELSE len(string_split(norm, ' ')) END AS words FROM (
      SELECT doc_id, n, i, tile, trim(regexp_replace(lower(tile), '[\x20\x09-\x0D]+', ' ', 'g')) AS norm, trim(regexp_replace(lower(line), '[\x20\x09-\x0D]+', ' ', 'g')) AS whole FROM tiles))
  WINDOW w AS (PARTITION BY doc_id ORDER BY n, i)
), both_levels AS (
  SELECT doc_id, start, start + length(tile) AS "end", low, low + words AS high, norm FROM placed WHERE norm <> whole AND words >= {UNIT_WORDS}
  UNION ALL
  SELECT doc_id, min(start), max(start + length(tile)), min(low), max(low + words), any_value(whole) FROM placed
  GROUP BY doc_id, n HAVING any_value(whole) <> ''
), ranked AS (
  SELECT *, min(doc_id) OVER (PARTITION BY md5(norm)) AS kept, row_number() OVER (PARTITION BY doc_id, md5(norm) ORDER BY low, high DESC) AS nth FROM both_levels
), gone AS (
  SELECT *, max(high) OVER (PARTITION BY doc_id ORDER BY low, high DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS so_far FROM ranked WHERE doc_id <> kept OR nth > 1
), runs AS (
  SELECT *, sum(CASE WHEN so_far IS NULL OR low - so_far >= {UNIT_WORDS} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY low, high DESC ROWS UNBOUNDED PRECEDING) AS run FROM gone
)
SELECT doc_id, CAST(min(start) AS INTEGER) AS start, CAST(max("end") AS INTEGER) AS "end", count(*) AS n_units,
  CAST(max(high) - min(low) AS BIGINT) AS n_words, CAST(max(high) - min(low) >= {PASSAGE_WORDS} AS INTEGER) AS passage, arg_min(kept, low * 4294967296 - high) AS kept_doc_id
FROM runs GROUP BY doc_id, run
"""
