"""Personal data by bootstrapped contextual extraction.

Base patterns find emails, IP addresses, card and phone numbers. Their matches seed a bipartite graph of lexical patterns
(kind, and the words beside a match) and instances (what stands there). Spark scores the graph in
rounds: an instance's belief is the noisy-or of its patterns' confidence, a pattern's confidence is the smoothed share of
belief among its instances. Its support is its base matches and the instances that a confident pattern found in the round
before, so what is found makes new patterns. Patterns of high confidence and support then find identifiers that no base pattern
matches but that have the shape of one (digits or an at sign). Base matches always stay.

Candidates are tokens with a digit or an at sign that no base match covers. Each match and candidate gives patterns of
its one or two words to the left, alone and with the word to the right. Graph rows are aggregated by hash-partitioned
group-bys; a pattern beside a third of all matches is summed before the shuffle. Confident patterns are broadcast if
there are at most ``max_patterns``. More are joined with the patterns of each text, by hash, so that none is dropped.

Defined cases: null and empty texts have no spans, and the digest of the empty string. Repeated rows give repeated
results. A found span never overlaps a base span or an earlier found span. Offsets count code points.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import staged, table

# The kinds in order and their base patterns.
KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

#: A token that may be an identifier: it has a digit or an at sign and at least six characters.
CANDIDATE = re.compile(r"(?<![^\s,;:()\[\]<>\"'|=])(?=[^\s,;:()\[\]<>\"'|=0-9@]*[0-9@])[^\s,;:()\[\]<>\"'|=]{6,}(?![^\s,;:()\[\]<>\"'|=])")
WORD = re.compile(r"[^\W\d_]+")
#: Characters beside a match in which its context words are looked for: a word further off isn't beside it.
REACH = 60

ROUNDS = 4
CONFIDENCE = 0.8
SUPPORT = 5
MAX_PATTERNS = 20_000


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def find_emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches of the email pattern, in linear time: its parts are looked for from each at
    sign, since the local part can only begin where its run of characters or the text after the last match does."""
    out, floor, at = [], 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > floor and text[begin - 1] in LOCAL_CHARS:
            begin -= 1
        m = DOMAIN.match(text, at + 1) if begin < at else None
        if m:
            out.append((begin, m.end()))
        floor = m.end() if m else at + 1
        at = text.find("@", floor)
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end) of every base match, in order."""
    out = [(a, 0, b) for a, b in find_emails(text)] if "@" in text else []
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def contexts(text: str, start: int, end: int) -> list[str]:
    """The lexical patterns around a span: left word; two left words; left and right word."""
    left = [w.lower() for w in WORD.findall(text[max(0, start - REACH) : start])]
    right = WORD.search(text, end, min(len(text), end + REACH))
    after = right[0].lower() if right else ""
    if not left:
        return [f" _ {after}"] if after else []
    out = [f"{left[-1]} _", f"{left[-1]} _ {after}"]
    if len(left) > 1:
        out.append(f"{left[-2]} {left[-1]} _")
    return out


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Tokens that may be identifiers and don't touch a base span."""
    out, taken = [], 0
    spans = sorted((a, b) for a, _, b in base)
    for m in CANDIDATE.finditer(text):
        while taken < len(spans) and spans[taken][1] <= m.start():
            taken += 1
        if taken == len(spans) or spans[taken][0] >= m.end():
            out.append((m.start(), m.end()))
    return out


def _observe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """texts to (pattern, instance, seed kind or -1, n): pattern beside instance, counted within a batch."""
    schema = pa.schema([("pattern", pa.string()), ("instance", pa.string()), ("seed", pa.int32()), ("n", pa.int64())])
    for batch in batches:
        seen: dict[tuple[str, str, int], int] = {}
        for text in batch.column(0).to_pylist():
            base = base_spans(text)
            for start, end, kind in [(a, b, k) for a, k, b in base] + [(a, b, -1) for a, b in candidates(text, base)]:
                value = text[start:end]
                for p in contexts(text, start, end):
                    key = (p, value if kind < 0 else hashlib.md5(value.encode()).hexdigest(), kind)
                    seen[key] = seen.get(key, 0) + 1
        yield pa.RecordBatch.from_pylist([{"pattern": p, "instance": i, "seed": k, "n": n} for (p, i, k), n in seen.items()], schema)


def learn(texts: DataFrame, *, rounds: int = ROUNDS, confidence: float = CONFIDENCE, support: int = SUPPORT) -> DataFrame:
    """(pattern, kind, score) of all confident patterns in the first column.

    Seeds have belief 1 in their own kind. Every round writes a small table, so that a loss costs one round.
    """
    texts = texts.select(F.coalesce(F.col(texts.columns[0]), F.lit("")).alias("text"))
    edges = staged(texts.mapInArrow(_observe, "pattern string, instance string, seed int, n long").groupBy("pattern", "instance", "seed").agg(F.sum("n").alias("n")), "pii-edges")
    scored = None
    for _ in range(rounds):
        # Confidence: the belief among a pattern's distinct instances, with one disbelieved instance added.
        if scored is None:
            belief = edges.select("pattern", "instance", "seed", F.lit(0.0).alias("belief"), F.lit(0.0).alias("best"), F.lit(None).cast("int").alias("of"))
        else:
            noisy = edges.filter("seed < 0").join(scored.select("pattern", "kind", "score"), "pattern")
            found = noisy.groupBy("instance", "kind").agg((1 - F.exp(F.sum(F.log(1 - F.least(F.col("score"), F.lit(0.999)))))).alias("belief"), F.max("score").alias("best"))
            belief = edges.join(found.withColumn("seed", F.lit(-1)), ["instance", "seed"], "left").select("pattern", "instance", "seed", F.coalesce("belief", F.lit(0.0)).alias("belief"), F.coalesce("best", F.lit(0.0)).alias("best"), F.col("kind").alias("of"))
        per = belief.groupBy("pattern", F.when(F.col("seed") >= 0, F.col("seed")).otherwise(F.col("of")).alias("kind")).agg(
            F.sum(F.when(F.col("seed") >= 0, 1.0).otherwise(F.col("belief"))).alias("good"), F.count(F.when((F.col("seed") >= 0) | (F.col("best") >= confidence), 1)).alias("support")
        )
        total = edges.groupBy("pattern").agg(F.count("*").alias("instances"))
        scored = staged(
            per.filter("kind is not null").join(total, "pattern").withColumn("score", F.col("good") / (F.col("instances") + 1)).filter(f"support >= {int(support)} and score > 0.05"),
            "pii-patterns",
        )
    return scored.filter(F.col("score") >= confidence).select("pattern", "kind", "score", "support")


def found_spans(text: str, base: list[tuple[int, int, int]], patterns: dict[str, tuple[int, float]]) -> list[tuple[int, int, int]]:
    """Candidates beside a confident pattern, with the kind of the best."""
    out = []
    for start, end in candidates(text, base):
        best = max((patterns[p][::-1] for p in contexts(text, start, end) if p in patterns), default=None)
        if best:
            out.append((start, best[1], end))
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


EXTRACT = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_found long"


def _extracted(text: str, patterns: dict[str, tuple[int, float]]) -> dict:
    base = base_spans(text)
    more = found_spans(text, base, patterns)
    counts = [sum(k == i for _, k, _ in base) for i in range(4)]
    return {"n_email": counts[0], "n_ip": counts[1], "n_card": counts[2], "n_phone": counts[3], "base_sha256": hashlib.sha256(joined(base).encode()).hexdigest(), "spans": joined(sorted(base + more)), "n_found": len(more)}


def _beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text_hash, text) to (text_hash, pattern): the distinct patterns of each text's candidates."""
    for batch in batches:
        rows = []
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            rows += [(key, x) for x in {p for a, b in candidates(text, base_spans(text)) for p in contexts(text, a, b)}]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int64()), pa.array([p for _, p in rows], pa.string())], names=["text_hash", "pattern"])


def extract(docs: DataFrame, patterns: DataFrame, text: str = "text", *, max_patterns: int = MAX_PATTERNS) -> DataFrame:
    """``docs`` with a struct column ``pii`` (which replaces one of that name) in place of its text: base counts and digest, all spans, number found.

    The best kind of each pattern is broadcast where there are at most ``max_patterns``, else joined by each text's hash: texts
    of equal hashes share their patterns, which are looked up by their words.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    known = patterns.groupBy("pattern").agg(F.max(F.struct("score", (-F.col("kind")).alias("less"))).alias("best")).select("pattern", (-F.col("best.less")).alias("kind"), "best.score")
    some = known.limit(max_patterns + 1).collect()
    arrow = pa.struct(list(to_arrow_schema(StructType.fromDDL(EXTRACT))))
    whole = F.coalesce(F.col(text), F.lit(""))
    if len(some) > max_patterns:

        def join(texts: pa.Array, found: pa.Array) -> pa.Array:
            sets = ({p["pattern"]: (p["kind"], p["score"]) for p in x or ()} for x in found.to_pylist())
            return pa.array([_extracted(t, x) for t, x in zip(texts.to_pylist(), sets, strict=True)], arrow)

        join.__annotations__ = {"texts": pa.Array, "found": pa.Array, "return": pa.Array}
        met = docs.select(F.xxhash64(whole).alias("text_hash"), whole.alias("text")).mapInArrow(_beside, "text_hash long, pattern string").distinct().join(known, "pattern")
        key, own = (f"{c}_{uuid.uuid4().hex}" for c in ("hash", "found"))  # no column of the input has these names
        per = met.groupBy(F.col("text_hash").alias(key)).agg(F.collect_list(F.struct("pattern", "kind", "score")).alias(own))
        both = docs.withColumn(key, F.xxhash64(whole)).join(per, key, "left")
        return both.withColumn("pii", F.arrow_udf(join, StructType.fromDDL(EXTRACT))(whole, F.col(own))).drop(key, own)
    held = docs.sparkSession.sparkContext.broadcast({r.pattern: (r.kind, r.score) for r in some})

    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in texts:
            yield pa.array([_extracted(t, held.value) for t in part.to_pylist()], arrow)

    run.__annotations__ = {"texts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return docs.withColumn("pii", F.arrow_udf(run, StructType.fromDDL(EXTRACT))(whole))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and found spans of every whole text of ``documents``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    patterns = learn(docs.select("text"))
    return extract(docs, patterns).select("doc_id", "pii.*")
