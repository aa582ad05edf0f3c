"""Secret scan with multipart credential linking, by DataFrame and SQL functions alone.

Base patterns find assignments, access keys and hexadecimal secrets; they always stay. Weak parts are opaque tokens
that may be secrets and names that may be identifiers. They are reported only where complementary parts occur within a
scope of SCOPE code points: a weak secret beside an access key, or beside an identifier and an endpoint; a weak
identifier beside a secret (base or weak) and an endpoint. No part is its own complement: of parts that overlap, base spans
come before endpoints, endpoints before identifiers and these before weak secrets, and a part that overlaps one of an
earlier role is dropped.

The scan reads every text once and keeps the lengths of matches and of what lies between them, in time linear in the text; a
running sum over a text's matches, in a window, makes offsets of these. Parts then meet by an interval join: the
parts of a role are aggregated for each row and bin of SCOPE code points to their least and greatest start, and a weak part
looks at its own bin and those on both sides, so a dense text joins each part with at most three rows a role and no pairs
arise.

Defined cases: null and empty texts have no spans. Rows of equal ids are scanned each by itself. Columns beside id and text
aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import staged, table

# Base patterns, with the least length of what counts (of group 2 for assignments).
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_CHARS = 6
#: Runs shorter than asked for hold no match that begins later either, so the length is part of the pattern.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"

# Weak parts: opaque tokens that mix digits with letters, names with their values, and endpoints to the end of their path.
OPAQUE = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])(?=[0-9+/_=-]*[A-Za-z])[A-Za-z0-9+/_=-]{20,}"
IDENTIFIER = r"""(?i:(user|username|login|client_?id|account))["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@-]{3,})"""
ENDPOINT = r"""(?i:(https?|ftp|postgres|postgresql|mysql|mongodb|redis|amqp))(://[^\s"'<>?#]+)"""
SCOPE = 400

#: What spans are called, by rank; endpoints are never reported.
KINDS = ("assign", "access", "hex", "secret", "identifier")
ENDPOINT_RANK = 5
SPANS = "array<struct<start:int,rank:int,end:int>>"
NONE = f"cast(array() as {SPANS})"
#: Code points of the pieces that a text is cut into before parts of it are put together.
PIECE = 4096


def _matches(text: Column, pattern: str, rank: int, *, group: int = 0) -> Column:
    """(rank, nth, gap, size, value): of every match, the lengths of the piece before it, of itself and of its group."""
    hit = lambda k: F.regexp_extract_all(text, F.lit(pattern), F.lit(k))
    items = F.filter(F.arrays_zip(hit(0), hit(group), F.split(text, pattern, -1)), lambda x: x["0"].isNotNull())
    found = F.transform(items, lambda x, i: F.struct(F.lit(rank).alias("rank"), i.alias("nth"), F.length(x["2"]).alias("gap"), F.length(x["0"]).alias("size"), F.length(x["1"]).alias("value")))
    return F.when(F.rlike(text, F.lit(pattern)), found).otherwise(F.expr("cast(array() as array<struct<rank:int,nth:int,gap:int,size:int,value:int>>)"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A written table with a row for each document: row, id, text_hash, and ``matches`` of all patterns, without the text."""
    text = F.col("text")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = rows.select("doc_id", "text", _matches(text, ASSIGN, 0, group=2).alias("assign"), _matches(text, ACCESS, 1).alias("access"), _matches(text, HEX, 2).alias("hex"), _matches(text, IDENTIFIER, 4).alias("named"))
    none = F.filter("hex", lambda x: F.lit(False))
    found = found.withColumn("endpoint", F.when((F.size("access") > 0) | (F.size("named") > 0), _matches(text, ENDPOINT, ENDPOINT_RANK)).otherwise(none))
    linked = (F.size("access") > 0) | ((F.size("named") > 0) & (F.size("endpoint") > 0))
    found = found.withColumn("opaque", F.when(linked, _matches(text, OPAQUE, 3)).otherwise(none))
    matches = F.concat("assign", "access", "hex", "opaque", "named", "endpoint")
    return staged(found.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.xxhash64("text").alias("text_hash"), matches.alias("matches")), "secrets")


def parts_of(found: DataFrame) -> DataFrame:
    """A written table (row, rank, start, end) of all that scan() found and that is long enough, in code points."""
    each = found.select("row", F.explode("matches").alias("m")).select("row", "m.*")
    end = F.sum(F.col("gap") + F.col("size")).over(Window.partitionBy("row", "rank").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)).cast("int")
    placed = each.withColumn("end", end).filter((F.col("rank") != 0) | (F.col("value") >= ASSIGN_CHARS))
    return staged(placed.select("row", "rank", (F.col("end") - F.col("size")).alias("start"), "end"), "parts")


#: By rank, which parts come first where they overlap: base spans, endpoints, identifiers, weak secrets.
PLACES = (0, 0, 0, 3, 2, 1)


def _apart(parts: DataFrame) -> DataFrame:
    """Parts (row, rank, start, end) that overlap none of an earlier place: against those that begin before a part
    by their greatest end so far, and against those that begin in it by the least start from behind."""
    rows = parts.withColumn("place", F.element_at(F.array(*map(F.lit, PLACES)), F.col("rank") + 1))
    so_far = (Window.unboundedPreceding, -1)
    ahead = Window.partitionBy("row").orderBy("start", "place").rowsBetween(*so_far)
    behind = Window.partitionBy("row").orderBy(F.desc("start"), "place").rowsBetween(*so_far)
    ends = {k: F.max(F.when(F.col("place") < k, F.col("end"))).over(ahead) for k in (1, 2, 3)}
    starts = {k: F.min(F.when(F.col("place") < k, F.col("start"))).over(behind) for k in (1, 2, 3)}
    rows = rows.select("*", *(x.alias(f"end{k}") for k, x in ends.items()), *(x.alias(f"start{k}") for k, x in starts.items()))
    over = lambda k: (F.coalesce(F.col(f"end{k}"), F.lit(0)) > F.col("start")) | (F.coalesce(F.col(f"start{k}"), F.col("end")) < F.col("end"))
    return rows.filter(~F.when(F.col("place") == 1, over(1)).when(F.col("place") == 2, over(2)).when(F.col("place") == 3, over(3)).otherwise(False)).select(*parts.columns)


def link(parts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """The weak parts that have complementary parts within ``scope``."""
    some = parts.groupBy("row").agg(F.bool_or(F.col("rank").isin(3, 4)).alias("weak")).filter("weak").select("row")
    binned = _apart(parts.join(some, "row")).withColumn("bin", F.floor(F.col("start") / scope))
    sides = binned.groupBy("row", "bin", F.col("rank").alias("of")).agg(F.min("start").alias("low"), F.max("start").alias("high"))
    weak = binned.filter(F.col("rank").isin(3, 4)).select("row", "start", "rank", "end", F.explode(F.array(F.col("bin") - 1, F.col("bin"), F.col("bin") + 1)).alias("bin"))
    near = weak.join(sides, ["row", "bin"]).filter((F.abs(F.col("low") - F.col("start")) <= scope) | (F.abs(F.col("high") - F.col("start")) <= scope) | F.col("start").between(F.col("low"), F.col("high")))
    has = lambda *ranks: F.bool_or(F.col("of").isin(*ranks))
    seen = near.groupBy("row", "start", "rank", "end").agg(has(1).alias("access"), has(1, 4).alias("identifier"), has(ENDPOINT_RANK).alias("endpoint"), has(0, 2, 3).alias("secret"))
    kept = seen.filter((F.col("rank") == 3) & (F.col("access") | (F.col("identifier") & F.col("endpoint"))) | (F.col("rank") == 4) & F.col("secret") & F.col("endpoint"))
    return kept.select("row", "rank", "start", "end")


def with_links(found: DataFrame, scope: int = SCOPE) -> DataFrame:
    """row, doc_id and text_hash of scan(), with ``base`` and ``all``: the base spans and all spans in order."""
    parts = parts_of(found)
    spans = parts.filter("rank < 3").unionByName(link(parts, scope)).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "rank", "end"))).alias("all"))
    both = found.select("row", "doc_id", "text_hash").join(spans, "row", "left").withColumn("all", F.coalesce("all", F.expr(NONE)))
    return both.withColumn("base", F.filter("all", lambda s: s["rank"] < 3))


def _joined(column: str) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(column, lambda s: F.concat_ws(":", F.element_at(names, s["rank"] + 1), s["start"], s["end"])), ",")


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, scope: int = SCOPE) -> DataFrame:
    """Counts and digest of the base spans, and all spans as text, of every row."""
    both = with_links(scan(docs, id_col, text_col), scope)
    n = lambda rank: F.size(F.filter("all", lambda s: s["rank"] == rank)).cast("long")
    return both.select(
        F.col("doc_id").alias(id_col), n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"),
        F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("all").alias("spans"), (F.size("all") - F.size("base")).cast("long").alias("n_linked"),
    )


def masked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, scope: int = SCOPE) -> DataFrame:
    """``docs`` with each secret of its texts replaced by its kind in angle brackets, and n_chars, where there is such a
    column, the length of the new text. Overlapping spans are replaced once. Null texts stay null."""
    key = lambda c: F.coalesce(c.cast("string"), F.lit("null"))
    # Rows of equal id and text have equal spans: those of one of them.
    found = with_links(scan(docs, id_col, text_col), scope).filter(F.size("all") > 0)
    found = found.groupBy(key(F.col("doc_id")).alias("_key"), F.col("text_hash").alias("_hash")).agg(F.min_by("all", "row").alias("all"))
    each = found.select("_key", "_hash", F.explode("all").alias("s")).select("_key", "_hash", "s.*")
    covered = F.max("end").over(Window.partitionBy("_key", "_hash").orderBy("start", "rank", "end").rowsBetween(Window.unboundedPreceding, -1))
    # ``to`` is where the spans before end; what begins before it is gone with them.
    placed = each.withColumn("to", F.coalesce(covered, F.lit(0)))
    kept = F.when(F.col("start") >= F.col("to"), F.struct("start", "rank", "end", "to"))
    gone = placed.groupBy("_key", "_hash").agg(F.array_sort(F.collect_list(kept)).alias("_gone"), F.max("end").alias("_last"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.struct(*(F.col(c) for c in docs.columns)).alias("_row"), text.alias("_text"), key(F.col(id_col)).alias("_key"), F.xxhash64(text).alias("_hash"))
    both = rows.join(gone, ["_key", "_hash"], "left")
    names = F.array(*(F.lit(f"<{k}>") for k in KINDS))

    def piece(pieces: Column, low: Column, high: Column) -> Column:
        """Code points ``low`` to ``high`` of a text that was cut into pieces."""
        first = F.floor(low / PIECE).cast("int")
        some = F.slice(pieces, first + 1, F.floor((high - 1) / PIECE).cast("int") - first + 1)
        return F.when(high > low, F.substring(F.array_join(some, ""), low - first * PIECE + 1, high - low)).otherwise("")

    def rebuilt(pieces: Column) -> Column:
        parts = F.transform("_gone", lambda s: F.concat(piece(pieces, s["to"], s["start"]), F.element_at(names, s["rank"] + 1)))
        return F.concat(F.array_join(parts, ""), piece(pieces, F.col("_last"), F.length("_text")))

    cut = F.regexp_extract_all(F.col("_text"), F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    new = F.element_at(F.transform(F.array(cut), rebuilt), 1)
    both = both.withColumn("_new", F.when(F.col("_gone").isNotNull(), new).otherwise(F.col("_row")[text_col]))
    number = docs.schema["n_chars"].dataType if "n_chars" in docs.columns else None
    columns = {text_col: F.col("_new"), **({"n_chars": F.when(F.col("_gone").isNotNull(), F.length("_new").cast(number)).otherwise(F.col("_row")["n_chars"])} if number else {})}
    return both.select(*(columns.get(c, F.col("_row")[c]).alias(c) for c in docs.columns))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and linked spans of every whole text of ``documents``."""
    return find_secrets(table(spark, sf_dir, "documents"))
