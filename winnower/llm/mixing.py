"""Mixing to target weights by soft membership, by DataFrame and SQL functions alone.

A multinomial naive Bayes classifier over hashed words is fitted on the labelled table and gives every document a
posterior over domains. Rates r >= 0 are then fitted by projected gradient so that the expected tokens of each domain,
the sum of rate x tokens x posterior, match the targets. The state of a round is one number for each domain: the
gradient at a document is a combination of its own posteriors, so a round is one map-side summed aggregate over a
narrow table, and rates are a column expression of that table, written now and then, and never joined.

The classifier's counts are at most ``buckets`` x domains, summed before the shuffle: a bound on what is broadcast. The
narrow table (id, tokens, posteriors) is written once and read in every round.

Defined cases: null and empty texts have no tokens, the prior as posterior, and rate 1. Without labels there is one domain
that holds everything. Null or repeated labels of an id: null ones are ignored, the largest domain counts. Targets
of domains that no document may belong to are left out and the others scaled up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import staged, table

BUCKETS = 4096
#: Labelled rows that the classifier is fitted on, in expectation.
FIT_ROWS = 50_000
ROUNDS = 40
#: Largest relative miss of a domain's total at which rounds end.
TOLERANCE = 1e-3
#: Rounds also end where a step along the projected gradient can't take this share off the squared miss: at the optimum that
#: the bounds leave.
GAIN = 1e-2
#: Rounds after which rates are written, so that their expression stays short.
WRITE_ROUNDS = 8
#: Domains of the labels table are quality + 2 x toxic; of the whole, these shares are wanted.
TARGETS = {0: 0.10, 1: 0.85, 2: 0.01, 3: 0.04}
#: After toxic documents are gone: two domains by quality, and little of what still looks toxic.
PIPELINE_TARGETS = {0: 0.20, 1: 0.80}
WORDS = r"[^\x20\x09-\x0D]+"


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORDS), F.lit(0))


def labelled_domains(labels: DataFrame) -> DataFrame:
    """doc_id and domain of each labelled document."""
    known = labels.filter("doc_id is not null and quality is not null and toxic is not null")
    return known.groupBy("doc_id").agg(F.max(F.col("quality") + 2 * F.col("toxic")).cast("int").alias("domain"))


def fit_classifier(docs: DataFrame, domains: DataFrame, *, buckets: int = BUCKETS, fit_rows: int = FIT_ROWS) -> tuple[list[int], DataFrame]:
    """The domains that have documents, and (bucket, weights): log odds of each domain against their mean."""
    n = domains.count()
    if n > fit_rows:
        domains = domains.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * fit_rows / n))
    # At most fit_rows ids in expectation, whatever the corpus: bounded, so they may be broadcast.
    rows = docs.select("doc_id", "text").join(F.broadcast(domains), "doc_id")
    counts = (
        rows.select("domain", F.explode(F.array_distinct(_words(F.coalesce("text", F.lit(""))))).alias("word"))
        .groupBy("domain", F.pmod(F.xxhash64("word"), F.lit(buckets)).alias("bucket"))
        .agg(F.count("*").alias("n"))
    )
    counts = staged(counts, "word-counts")
    totals = {r.domain: r.n for r in counts.groupBy("domain").agg(F.sum("n").alias("n")).collect()}
    names = sorted(totals)
    if not names:
        return [0], docs.sparkSession.range(buckets).select(F.col("id").alias("bucket"), F.array(F.lit(0.0)).alias("weights"))
    wide = counts.groupBy("bucket").agg(*(F.sum(F.when(F.col("domain") == d, F.col("n")).otherwise(0)).alias(f"n{d}") for d in names))
    logs = [F.log((F.col(f"n{d}") + 1.0) / float(totals[d] + buckets)) for d in names]
    mean = sum(logs[1:], logs[0]) / len(logs)
    return names, wide.select("bucket", F.array(*(x - mean for x in logs)).alias("weights"))


def posteriors(docs: DataFrame, names: list[int], weights: DataFrame, priors: list[float], *, buckets: int = BUCKETS) -> DataFrame:
    """A written table: doc_id, text_hash, tokens and p, the posteriors in the order of ``names``. ``weights`` and ``buckets`` are
    those of fit_classifier().

    The words' log odds are summed and divided by the root of their number, so that long texts don't saturate.
    """
    words = docs.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), _words(F.coalesce("text", F.lit(""))).alias("words")
    )
    each = words.select("row", "doc_id", "text_hash", F.size("words").cast("long").alias("tokens"), F.explode_outer(F.array_distinct("words")).alias("word"))
    each = each.withColumn("bucket", F.pmod(F.xxhash64("word"), F.lit(buckets)))
    # At most ``buckets`` rows, so they may be broadcast. A text's words are summed by the task that reads them.
    summed = each.join(F.broadcast(weights), "bucket", "left").groupBy("row", "doc_id", "text_hash", "tokens").agg(
        F.greatest(F.count("word"), F.lit(1)).alias("n"), *(F.coalesce(F.sum(F.col("weights")[i]), F.lit(0.0)).alias(f"s{i}") for i in range(len(names)))
    )
    logits = [F.col(f"s{i}") / F.sqrt("n") + F.log(F.lit(max(p, 1e-12))) for i, p in enumerate(priors)]
    peaked = summed.select("doc_id", "text_hash", "tokens", F.array(*logits).alias("z")).withColumn("e", F.transform("z", lambda z: F.exp(z - F.array_max("z"))))
    total = F.aggregate("e", F.lit(0.0), lambda a, x: a + x)
    return staged(peaked.select("doc_id", "text_hash", "tokens", F.transform("e", lambda x: x / total).alias("p")), "posteriors")


def fit_rates(rows: DataFrame, targets: list[float], *, least: float = 0.0, budget: float | None = None, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> tuple[DataFrame, list[float]]:
    """The rows of posteriors() with their ``rate``, and the totals that these give.

    Minimises the squared miss of ``budget`` x ``targets`` over rates of ``least`` or more, from rate 1. Each round
    steps along the gradient in the metric of the rows that may still move, and projects; where no such step comes closer, it
    steps along the projected gradient itself, and ends where that gains nothing more: what the totals leave is then the
    least miss that there is. Without a budget the tokens stay as many as they are; with a ``least`` above 0, the budget is what the
    scarcest target asks for.
    """
    k = len(targets)
    p = [F.col("p")[i] for i in range(k)]
    rows, rate = rows.withColumn("start", F.lit(1.0)), F.col("start")
    pairs = [(i, j) for i in range(k) for j in range(i, k)]

    def sums(rate: Column, every: bool = False) -> tuple[list[float], list[list[float]]]:
        moving = F.col("tokens") if every else F.when(F.col("rate") > least, F.col("tokens")).otherwise(F.lit(0))
        row = (
            rows.withColumn("rate", rate)
            .agg(*(F.coalesce(F.sum(F.col("rate") * F.col("tokens") * x), F.lit(0.0)) for x in p), *(F.coalesce(F.sum(moving * p[i] * p[j]), F.lit(0.0)) for i, j in pairs))
            .first()
        )
        gram = [[0.0] * k for _ in range(k)]
        for (i, j), v in zip(pairs, row[k:], strict=True):
            gram[i][j] = gram[j][i] = v
        return list(row[:k]), gram

    def slope(rate: Column, miss: list[float]) -> tuple[Column, float, float]:
        """The gradient at a row, the length of the best step along its projection, and what of the squared miss that takes off."""
        along = F.lit(0.0)
        for x, m in zip(p, miss, strict=True):
            along = along + F.col("tokens") * x * F.lit(m)
        free = F.when((F.col("rate") > least) | (F.col("along") < 0), F.col("along")).otherwise(F.lit(0.0))
        row = rows.withColumn("rate", rate).withColumn("along", along).withColumn("free", free).agg(F.coalesce(F.sum(F.col("free") * F.col("free")), F.lit(0.0)), *(F.coalesce(F.sum(F.col("free") * F.col("tokens") * x), F.lit(0.0)) for x in p)).first()
        length = row[0] / (sum(v * v for v in row[1:]) or 1.0)
        return along, length, length * row[0] / sum(m * m for m in miss)

    totals, gram = sums(rate, every=True)  # at the start every row may move
    natural = sum(totals)
    reachable = [t if m > 0 else 0.0 for t, m in zip(targets, totals, strict=True)]
    if not natural or not sum(reachable):
        return rows.withColumn("rate", rate).drop("start"), totals
    shares = [t / sum(reachable) for t in reachable]
    if budget is None:
        budget = max([m / s for m, s in zip(totals, shares, strict=True) if s], default=natural) if least > 0 else natural
    wanted = [budget * s for s in shares]

    def closer(changes: list[Column], miss: list[float]) -> tuple[Column, list[float], list[list[float]]] | None:
        for change in changes:  # shorter steps where projection makes the whole one overshoot
            tried = F.greatest(F.lit(least), rate - change)
            now, new_gram = sums(tried)
            if sum((m - t) ** 2 for m, t in zip(now, wanted, strict=True)) < (1 - 1e-3) * sum(x * x for x in miss):
                return tried, now, new_gram
        return None

    def combined(step: list[float]) -> Column:
        change = F.lit(0.0)
        for x, c in zip(p, step, strict=True):
            change = change + x * F.lit(c)
        return change

    for n in range(1, rounds + 1):
        miss = [m - t for m, t in zip(totals, wanted, strict=True)]
        if max(map(abs, miss)) <= tolerance * budget:
            break
        ridge = 1e-3 * max(gram[i][i] for i in range(k)) or 1.0
        step = solve([[v + (ridge if i == j else 0.0) for j, v in enumerate(r)] for i, r in enumerate(gram)], miss)
        better = closer([combined([c * part for c in step]) for part in (1.0, 0.25)], miss)
        if better is None:
            along, length, gain = slope(rate, miss)
            better = closer([along * F.lit(length * part) for part in (1.0, 0.2)], miss) if gain > GAIN else None
        if better is None:
            break
        rate, totals, gram = better
        if n % WRITE_ROUNDS == 0:
            rows, rate = staged(rows.withColumn("start", rate), "rates"), F.col("start")
    return rows.withColumn("rate", rate).drop("start"), totals


def solve(matrix: list[list[float]], right: list[float]) -> list[float]:
    """A small symmetric positive system, by Gauss-Jordan elimination with pivots."""
    n = len(right)
    rows = [[*r, b] for r, b in zip(matrix, right, strict=True)]
    for i in range(n):
        best = max(range(i, n), key=lambda r: abs(rows[r][i]))
        rows[i], rows[best] = rows[best], rows[i]
        pivot = rows[i][i]
        rows[i] = [x / pivot for x in rows[i]]
        for r in range(n):
            if r != i and rows[r][i]:
                factor = rows[r][i]
                rows[r] = [x - factor * y for x, y in zip(rows[r], rows[i], strict=True)]
    return [r[-1] for r in rows]


def mix(docs: DataFrame, labels: DataFrame, targets: dict[int, float] = TARGETS, *, least: float = 0.0, budget: float | None = None, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, text_hash, tokens, domain (the likeliest), p and rate of every document."""
    domains = labelled_domains(labels)
    names, weights = fit_classifier(docs, domains, buckets=buckets)
    seen = {r.domain: r.n for r in domains.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    counts = [seen.get(d, 0) + 1 for d in names]
    rows = posteriors(docs, names, weights, [c / sum(counts) for c in counts], buckets=buckets)
    rated, _ = fit_rates(rows, [targets.get(d, 0.0) for d in names], least=least, budget=budget)
    best = F.element_at(F.array(*(F.lit(d) for d in names)), F.array_position("p", F.array_max("p")).cast("int"))
    return rated.select("doc_id", "text_hash", "tokens", best.alias("domain"), "p", "rate")


def take(docs: DataFrame, mixed: DataFrame, *, seed: int = 7) -> DataFrame:
    """``docs`` with each row as often as its rate says; a fraction is decided by a hash of the document."""
    key = lambda c: F.coalesce(c, F.lit(-(2**63)))
    rates = mixed.groupBy(key(F.col("doc_id")).alias("key"), F.col("text_hash").alias("hash")).agg(F.max("rate").alias("rate"))
    keyed = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), key(docs["doc_id"]).alias("key"), F.xxhash64(F.coalesce(docs["text"], F.lit(""))).alias("hash"))
    luck = F.pmod(F.xxhash64("key", "hash", F.lit(seed)), F.lit(1_000_000)) / 1e6
    times = (F.floor("rate") + F.when(luck < F.col("rate") - F.floor("rate"), 1).otherwise(0)).cast("int")
    copies = keyed.join(rates, ["key", "hash"]).withColumn("times", times).filter("times > 0")
    return copies.select("row", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("copy")).select("row.*")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posteriors and rate of every row of ``documents`` for TARGETS of the domains of ``labels``."""
    mixed = mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return mixed.select("doc_id", "tokens", "domain", F.col("p").alias("posteriors"), "rate")
