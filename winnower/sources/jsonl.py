"""Text lines and JSON lines with their positions.

A line's item number is its place among the non-empty lines of its file. It comes from two narrow steps: rows are
numbered within each file block as it is read, and blocks are counted and summed up in the order of their offsets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..config import IoError, JsonError, MissingField
from ..staging import written

LINE = ["file_path", "item_number", "value"]


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file_path, item_number (from 0) and value of each line that isn't empty. Lines end with a line feed; one
    carriage return before it is dropped. A line of white space is a line. A line that isn't UTF-8 fails the job: IoError."""
    bad = F.raise_error(F.lit("IoError: a line isn't valid UTF-8")).cast("string")
    return _lines(spark, path).withColumn("value", F.when(F.col("utf8"), F.col("value")).otherwise(bad)).drop("utf8")


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """read_lines() with ``utf8``: whether the line is."""
    raw = spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_block_start").alias("block"))
    # Text functions replace what isn't UTF-8, so the bytes are looked at first.
    rows = raw.withColumn("utf8", F.is_valid_utf8("value")).withColumn("value", F.regexp_replace("value", "\r\\z", "")).filter("value <> ''").withColumn("at", F.monotonically_increasing_id())
    before = F.sum("n").over(Window.partitionBy("file_path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    blocks = rows.groupBy("file_path", "block").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    blocks = blocks.select("file_path", "block", "first", F.coalesce(before, F.lit(0)).alias("before"))
    return rows.join(blocks, ["file_path", "block"]).select("file_path", (F.col("before") + F.col("at") - F.col("first")).alias("item_number"), "value", "utf8")


def _field(value: Column, name: str) -> tuple[Column, Column]:
    """A top-level field as a variant, by its plain name, and its type; both null where it is absent."""
    path = "$['" + name.replace("\\", "\\\\").replace("'", "\\'") + "']"
    found = F.try_variant_get(F.try_parse_json(value), path, "variant")
    return found, F.schema_of_variant(found)


def read_jsonl(spark: SparkSession, path: str | list[str], *, text_field: str = "text", id_field: str | None = None) -> DataFrame:
    """file_path, item_number, text and, where asked for, id of each line; ``value`` is the line as it was.

    One bad line fails the job: IoError where it isn't UTF-8, JsonError where it isn't JSON, MissingField where the text isn't
    a string. An id
    that is a string is taken as it is, other values as JSON text, and where it is absent the item number stands in.
    """
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    rows = read_lines(spark, path)
    value = F.col("value")
    text, kind = _field(value, text_field)
    parsed = F.try_parse_json(value)
    checked = (
        F.when(parsed.isNull(), F.raise_error(F.concat(F.lit("JsonError: not JSON: "), F.substring(value, 1, 80))).cast("string"))
        .when(kind.isNull() | (kind != "STRING"), F.raise_error(F.lit(f"MissingField: {text_field}")).cast("string"))
        .otherwise(text.cast("string"))
    )
    out = rows.withColumn("text", checked)
    if id_field is not None:
        found, id_kind = _field(value, id_field)
        rendered = F.when(id_kind == "STRING", found.cast("string")).when(id_kind.isNotNull(), F.to_json(found)).otherwise(F.col("item_number").cast("string"))
        out = out.withColumn("id", rendered)
    return out


def check_jsonl(spark: SparkSession, path: str | list[str], *, text_field: str = "text") -> int:
    """The number of lines; IoError, JsonError or MissingField where one of them is bad."""
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    value = F.col("value")
    _, kind = _field(value, text_field)
    row = (
        _lines(spark, path)
        .select(F.try_parse_json(value).isNull().alias("bad"), (kind.isNull() | (kind != "STRING")).alias("missing"), "utf8")
        .agg(F.count("*"), F.count_if("bad"), F.count_if(~F.col("bad") & F.col("missing")), F.count_if(~F.col("utf8")))
        .first()
    )
    if row[3]:
        raise IoError(f"{row[3]} lines aren't valid UTF-8")
    if row[1]:
        raise JsonError(f"{row[1]} lines aren't JSON")
    if row[2]:
        raise MissingField(text_field)
    return row[0]


def from_table(df: DataFrame, *, order_col: str, text_col: str | None = "text", source_col: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """A table as documents: file_path, item_number (dense from 0 in the order of ``order_col``), text and ``keep``.

    Rows are dealt by ranges of source and order and numbered within their partition, and counts of partitions are
    summed up, so a source of very many rows is numbered by many tasks. All that is kept is moved and written once: without
    a ``text_col`` that is narrow, such as band values and ids. Ranges are drawn from a sample, for which the input is run once more, so what is
    costly to make should be a written table.
    """
    source = F.col(source_col).cast("string") if source_col else F.lit("table")
    text = [F.col(text_col).alias("text")] if text_col else []
    rows = df.select(source.alias("file_path"), F.col(order_col).alias("_order"), *text, *keep)
    dealt = rows.repartitionByRange("file_path", "_order").sortWithinPartitions("file_path", "_order")
    dealt = written(dealt.withColumn("_at", F.monotonically_increasing_id()), "documents").withColumn("_part", F.shiftright("_at", 33))
    before = F.sum("n").over(Window.partitionBy("file_path").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    parts = dealt.groupBy("file_path", "_part").agg(F.min("_at").alias("first"), F.count("*").alias("n"))
    parts = parts.select(F.col("file_path").alias("_path"), F.col("_part").alias("_of"), "first", F.coalesce(before, F.lit(0)).alias("before"))
    same = F.col("file_path").eqNullSafe(F.col("_path")) & (F.col("_part") == F.col("_of"))
    return dealt.join(parts, same).select("file_path", (F.col("before") + F.col("_at") - F.col("first")).alias("item_number"), *(["text"] if text_col else []), *keep)


def write_lines(df: DataFrame, path: str, order_col: str = "global_idx") -> int:
    """The ``value`` column as text lines, in order over the part files; how many there are."""
    seen = Observation("lines")
    rows = df.repartitionByRange(order_col).sortWithinPartitions(order_col).observe(seen, F.count("*").alias("n"))
    rows.select("value").write.mode("overwrite").text(path)
    return seen.get["n"]
