"""Toxicity by a weighted finite-state grammar over clauses.

Five transducers, for insults, threats, targets, negation and reported speech, are composed into one automaton that reads
the classes of a text's words and marks and writes one event for each insult or threat: plain, aimed at someone, negated or
reported. It is a bimachine: targets and reports are also read from the right, so that a target counts after the verb and a
report after what it quotes. Commas, colons and semicolons end a clause; a report carries on across them to the end of its
sentence, or to the closing quotation mark. Lines are read each by itself. The lexicon has words, beginnings of words and phrases, and their weights come
from labelled rows; a logistic model weighs the events, so a word counts by the clause that it stands in.

The model is fitted on at most ``fit_rows`` labelled rows in expectation, chosen by a hash of their id, held-out rows
never among them; the lexicon's size is bounded by what these rows hold. An induced word must pass a likelihood-ratio test that
allows for the number of words tested, once by documents and once by distinct contexts (previous and next word), so that one
text and its copies can't make a word. It is a threat where most of its toxic contexts announce something (a word such as
"will" shortly before it), else an insult. Scoring then reads every whole text in one pass without a shuffle, in time linear
in its length.

Defined cases: null and empty texts score what a text without events scores. Without labelled rows of both kinds
the seed words and fixed event weights are used. Several labels of one id count as toxic if one does; null labels
count for nothing. Labels, lang, source and ids aren't inputs of a score.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .common import staged, table, text_or_empty, with_column

THRESHOLD = 0.3
FIT_ROWS = 50_000
#: Share of the induced words that may pass by luck, and the least likelihood ratio that is looked at.
ALPHA = 0.05
LEAST_EVIDENCE = 12.0
STEM_CHARS = (4, 5)
#: Words that one partition counts before it emits what it has, and whose class a task remembers.
COUNTER_WORDS = 200_000
#: Words within which a negation or an announcement reaches what it belongs to.
REACH = 3

# Seed words of each class, in English, German, French and Spanish; phrases are looked up before words.
INSULTS = "idiot moron stupid loser scum worthless pathetic disgusting imbecile clown dumbass asshole bastard dummkopf trottel abschaum idioten arschloch crétin imbécile ordure connard salaud imbécil estúpido escoria idiota gilipollas cabrón".split()
THREATS = "kill hurt destroy shoot stab töten umbringen vernichten tuer détruire frapper matar destruir golpear".split()
INSULT_PHRASES = ["piece of shit", "waste of space", "shut up", "go to hell", "halt die fresse", "ferme ta gueule", "hijo de puta"]
THREAT_PHRASES = ["beat you up", "watch your back", "i will find you", "ich mach dich fertig", "je vais te trouver", "te voy a encontrar"]
TARGETS = "you your u he she they him her them people du dich ihr euch er sie tu te toi vous il elle ils vosotros usted tú él ella ellos".split()
NEGATIONS = "not no never isn't aren't don't won't nicht kein keine nie pas jamais aucun non nunca jamás ni".split()
REPORTS = "said says told wrote claimed quoted sagte schrieb behauptete dit écrit affirmé dijo escribió afirmó".split()
INTENTS = "will i'll we'll gonna going shall werde werden vais allons voy vamos".split()

WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
#: Words, marks that end a sentence or a clause, and quotation marks.
TOKEN = re.compile(r"[^\W_]+(?:['’][^\W_]+)*|[.!?|,:;\"“”„«»]")
MARKS = {**dict.fromkeys(".!?|", "stop"), **dict.fromkeys(",:;", "pause"), **dict.fromkeys('"“”„«»', "quote")}

EVENTS = ("insult", "insult_aimed", "insult_negated", "insult_reported", "threat", "threat_aimed", "threat_negated", "threat_reported")
#: Event weights where nothing can be learned.
DEFAULT_WEIGHTS = np.array([-4.0, 1.0, 1.5, 0.2, 0.4, 0.7, 1.2, 0.2, 0.3, 1.0])
KINDS = ("word", "insult", "threat", "target", "negation", "report", "intent", "pause", "quote", "stop")
HITS = ("insult", "threat")


@dataclass(frozen=True)
class Transducer:
    """States from 0; (state, class) to (next state, factor). Classes without an arc stay, with factor 1."""

    states: int
    arcs: dict[tuple[int, str], tuple[int, float]] = field(default_factory=dict)

    def step(self, state: int, kind: str) -> tuple[int, float]:
        return self.arcs.get((state, kind), (state, 1.0))


def _arcs(states: Iterable[int], kinds: Iterable[str], to: int, factor: float = 1.0) -> dict[tuple[int, str], tuple[int, float]]:
    return {(s, k): (to, factor) for s in states for k in kinds}


ENDS = ("pause", "stop")


def _reaching(opener: str, touched: tuple[str, ...], factor: float) -> Transducer:
    """States 1 to REACH: so many words since the opener, within which it changes the weight of what it touches."""
    arcs = {(0, opener): (1, 1.0), **_arcs(range(1, REACH + 1), ENDS, 0)}
    for s in range(1, REACH + 1):
        arcs |= {(s, k): (0 if s == REACH else s + 1, factor if k in touched else 1.0) for k in ("word", "insult", "threat", "target", "report", "negation", "intent")}
        arcs[s, opener] = (1, 1.0)
    return Transducer(REACH + 1, arcs)


#: State 1: an insult stands in the clause, and the next one weighs more.
INSULT = Transducer(2, {(0, "insult"): (1, 1.0), (1, "insult"): (1, 1.25), **_arcs((1,), ENDS, 0)})
#: Something is announced, and a threat shortly after it weighs more.
THREAT = _reaching("intent", ("threat",), 1.5)
#: State 1: someone has been named in the clause, so a hit is aimed. Who reports is no target.
TARGET = Transducer(2, {(0, "target"): (1, 1.0), (1, "insult"): (1, 1.5), (1, "threat"): (1, 2.0), **_arcs((1,), (*ENDS, "report"), 0)})
NEGATION = _reaching("negation", HITS, 0.25)
#: State 1: reported speech, to the end of the sentence. State 2: a quotation in it, to its closing mark.
REPORT = Transducer(3, {(0, "report"): (1, 1.0), **{(s, k): (s, 0.5) for s in (1, 2) for k in HITS}, (1, "quote"): (2, 1.0), (2, "quote"): (0, 1.0), (1, "stop"): (0, 1.0)})
#: From the right, in the order of reading: what is quoted before the report. State 1: a report; state 2: a quotation that it follows.
REPORTED = Transducer(3, {(0, "report"): (1, 1.0), (1, "quote"): (2, 1.0), (2, "quote"): (0, 1.0), (1, "stop"): (0, 1.0), **{(2, k): (2, 0.5) for k in HITS}})


def compose(*parts: Transducer) -> list[dict[str, tuple[int, float, tuple[int, ...]]]]:
    """The product automaton, its reachable states numbered from 0: class to (state, factor, the parts' states before).
    Every part reads the class at once, and factors multiply."""
    number, order, out = {(0,) * len(parts): 0}, [(0,) * len(parts)], []
    for states in order:  # grows meanwhile
        arcs = {}
        for kind in KINDS:
            steps = [p.step(s, kind) for p, s in zip(parts, states, strict=True)]
            to = tuple(s for s, _ in steps)
            if to not in number:
                number[to] = len(order)
                order.append(to)
            arcs[kind] = (number[to], math.prod(f for _, f in steps), states)
        out.append(arcs)
    return out


#: From the left, and from the right.
GRAMMAR = compose(INSULT, THREAT, TARGET, NEGATION, REPORT)
BACKWARD = compose(TARGET, REPORTED)
FIXED_KINDS = {w: kind for kind, words in (("target", TARGETS), ("negation", NEGATIONS), ("report", REPORTS), ("intent", INTENTS)) for w in words} | MARKS


def words_of(text: str) -> list[str]:
    """Lower-case words in order."""
    return WORD.findall(text.lower())


@dataclass
class Model:
    """``terms`` and ``threats`` have the weight of whole words, phrases and, as 'stem*', beginnings; ``weights``: bias,
    events, peak."""

    terms: dict[str, float]
    threats: dict[str, float]
    weights: np.ndarray

    def __post_init__(self) -> None:
        self.memo: dict[str, tuple[str, float] | None] = {}
        #: Phrases by their first word, the longest first.
        self.phrases: dict[str, list[tuple[list[str], str, float]]] = {}
        for kind, known in (("insult", self.terms), ("threat", self.threats)):
            for term, weight in known.items():
                if " " in term:
                    self.phrases.setdefault(term.split(" ")[0], []).append((term.split(" "), kind, weight))
        for found in self.phrases.values():
            found.sort(key=lambda x: -len(x[0]))

    def kind(self, word: str) -> tuple[str, float] | None:
        """insult or threat and the word's weight."""
        for name in (word, *(word[:n] + "*" for n in STEM_CHARS if len(word) >= n)):
            for kind, known in (("threat", self.threats), ("insult", self.terms)):
                if (w := known.get(name)) is not None:
                    return kind, w
        return None

    def hits(self, words: set[str]) -> set[str]:
        """Those of the words that are in the lexicon or begin one of its phrases."""
        memo, out = self.memo, set()
        for w in words:
            if w not in memo:
                if len(memo) > COUNTER_WORDS:
                    memo.clear()
                memo[w] = None if w in FIXED_KINDS else self.kind(w)
            if memo[w] is not None or w in self.phrases:
                out.add(w)
        return out

    def classes(self, line: str, hits: set[str]) -> tuple[list[str], dict[int, float]]:
        """The classes of a line's words and marks in order, a phrase as one, and by place the weights of hits."""
        tokens = TOKEN.findall(line)
        kinds, weights, at = [FIXED_KINDS.get(t, "word") for t in tokens], {}, 0
        taken = []  # of phrases, places after the first
        for i, token in enumerate(tokens):
            if token in hits and i >= at:
                words, kind, weight = next((p for p in self.phrases.get(token, ()) if tokens[i : i + len(p[0])] == p[0]), ([token], *(self.kind(token) or ("", 0.0))))
                if kind:
                    kinds[i], weights[i] = kind, weight
                    at = i + len(words)
                    taken += range(i + 1, at)
        if taken:
            gone = set(taken)
            left = [i for i in range(len(tokens)) if i not in gone]
            kinds, weights = [kinds[i] for i in left], {k: weights[i] for k, i in enumerate(left) if i in weights}
        return kinds, weights

    def line(self, line: str, hits: set[str], out: np.ndarray) -> float:
        """Read a line from both sides, add its events to ``out``, and return the weight of its heaviest clause."""
        kinds, weights = self.classes(line, hits)
        if not weights:
            return 0.0
        after, state = {}, 0
        for i in range(len(kinds) - 1, -1, -1):
            to, _, states = BACKWARD[state][kinds[i]]
            if i in weights:
                after[i] = states
            state = to
        state, clause, peak = 0, 0.0, 0.0
        for i, kind in enumerate(kinds):
            state, factor, (_, _, aimed, negated, reported) = GRAMMAR[state][kind]
            if kind in HITS:
                late_aim, late_report = after[i]
                if late_aim and not aimed:
                    factor *= TARGET.step(1, kind)[1]
                if late_report == 2 and not reported:
                    factor *= REPORTED.step(2, kind)[1]
                weight = weights[i] * factor
                out[(0 if kind == "insult" else 4) + (3 if reported or late_report == 2 else 2 if negated else 1 if aimed or late_aim else 0)] += weight
                clause += weight
            elif kind in ENDS:
                peak, clause = max(peak, clause), 0.0
        return max(peak, clause)

    def events(self, text: str) -> np.ndarray:
        """Of each event the sum of its matches' weights, damped by a logarithm, and the heaviest clause."""
        out, peak = np.zeros(len(EVENTS)), 0.0
        low = text.lower()
        if hits := self.hits(set(WORD.findall(low))):
            for line in low.split("\n"):
                if not hits.isdisjoint(WORD.findall(line)):
                    peak = max(peak, self.line(line, hits, out))
        return np.append(np.log1p(out), math.log1p(peak))

    def scores(self, texts: list[str | None]) -> np.ndarray:
        x = np.stack([self.events(t or "") for t in texts]) if texts else np.zeros((0, len(EVENTS) + 1))
        return 1 / (1 + np.exp(-np.clip(self.weights[0] + x @ self.weights[1:], -30, 30)))


def ratio_test(t: np.ndarray, n: np.ndarray, base: float) -> np.ndarray:
    """Twice the log likelihood ratio of a rate t / n against ``base``; 0 where the rate is not higher."""
    rate = t / n
    with np.errstate(divide="ignore", invalid="ignore"):
        g = 2 * (np.where(t > 0, t * np.log(rate / base), 0) + np.where(n > t, (n - t) * np.log((1 - rate) / (1 - base)), 0))
    return np.where(rate > base, g, 0)


def _terms(word: str) -> list[str]:
    return [word, *(word[:n] + "*" for n in STEM_CHARS if len(word) > n)]


def _count_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, toxic) to (term, n, t): documents that hold the term, as far as one partition has them."""
    n, t = Counter(), Counter()

    def emit() -> pa.RecordBatch:
        names = list(n)
        return pa.RecordBatch.from_pydict({"term": names, "n": pa.array([n[x] for x in names], pa.int64()), "t": pa.array([t[x] for x in names], pa.int64())})

    for batch in batches:
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found = {x for w in set(words_of(text)) for x in _terms(w)}
            n.update(found)
            if toxic:
                t.update(found)
            if len(n) > COUNTER_WORDS:
                yield emit()
                n.clear()
                t.clear()
    if n:
        yield emit()


def _contexts(terms: frozenset[str]):
    """(text, toxic) to (term, context, toxic, announced): the words beside a term, and whether a word before announces something."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        intents = frozenset(INTENTS)
        for batch in batches:
            rows = set()
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = ["", *words_of(text), ""]
                wanted = {w: x for w in set(words) if (x := [t for t in _terms(w) if t in terms])}
                for i in range(1, len(words) - 1):
                    for term in wanted.get(words[i], ()):
                        rows.add((term, f"{words[i - 1]} {words[i + 1]}", toxic, not intents.isdisjoint(words[max(0, i - REACH) : i])))
            yield pa.RecordBatch.from_pylist(
                [{"term": a, "context": b, "toxic": c, "announced": d} for a, b, c, d in rows],
                pa.schema([("term", pa.string()), ("context", pa.string()), ("toxic", pa.int32()), ("announced", pa.bool_())]),
            )

    return find


def induce(rows: DataFrame, n_docs: int, n_toxic: int) -> tuple[dict[str, float], dict[str, float]]:
    """Words and stems that mark toxic rows (text, toxic), with their smoothed log odds: insults and threats."""
    base = n_toxic / n_docs
    counts = staged(rows.mapInArrow(_count_documents, "term string, n long, t long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("t").alias("t")), "terms")
    tested = counts.count()
    # The test by documents, as an expression, for terms that are toxic more often than not. What passes comes from the rows of the fit alone.
    rate = F.col("t") / F.col("n")
    rest = F.when(F.col("n") > F.col("t"), (F.col("n") - F.col("t")) * F.log((1 - rate) / (1 - base))).otherwise(0.0)
    evidence = F.when(rate > base, 2 * (F.col("t") * F.log(rate / base) + rest)).otherwise(0.0)
    ranked = counts.filter("t >= 0.5 * n").withColumn("g", evidence).filter(F.col("g") >= LEAST_EVIDENCE).orderBy(F.desc("g"), "term").select("term", "g").collect()
    # False discoveries at the rate ALPHA at most (Benjamini and Hochberg), p bounded by exp(-g / 2).
    passed = max((k for k, r in enumerate(ranked, 1) if math.exp(-r.g / 2) <= ALPHA * k / tested), default=0)
    names = [r.term for r in ranked[:passed]]
    if not names:
        return {}, {}
    least = 2 * math.log(len(names) / ALPHA)
    seen = rows.mapInArrow(_contexts(frozenset(names)), "term string, context string, toxic int, announced boolean")
    per = seen.groupBy("term", "context").agg(F.avg("toxic").alias("toxic"), F.avg(F.col("announced").cast("int")).alias("announced"))
    found = per.groupBy("term").agg(F.count("*").alias("n"), F.sum("toxic").alias("t"), F.sum(F.col("toxic") * F.col("announced")).alias("a")).toPandas()
    n, t, a = (found[c].to_numpy(float) for c in ("n", "t", "a"))
    good = (ratio_test(t, n, base) >= least) & (t / n >= 0.5)
    odds = np.log((t + 0.5) / (n - t + 0.5)) - math.log(base / (1 - base))
    known = [(term, float(w), x) for term, w, x, g in zip(found["term"], odds, a > 0.5 * t, good, strict=True) if g and w > 0]
    return {term: w for term, w, x in known if not x}, {term: w for term, w, x in known if x}


def default_model() -> Model:
    return Model({w: 2.0 for w in INSULTS + INSULT_PHRASES}, {w: 2.0 for w in THREATS + THREAT_PHRASES}, DEFAULT_WEIGHTS)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, *, fit_rows: int = FIT_ROWS) -> Model:
    """A model of the labelled rows of ``docs`` that aren't held out."""
    known = labels.filter("doc_id is not null and toxic is not null").filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    n = known.count()
    if n > fit_rows:
        known = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * fit_rows / n))
    # At most fit_rows ids in expectation: bounded, so they may be broadcast.
    rows = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(known), "doc_id").select("text", "toxic")
    rows = staged(rows, "labelled")
    n_docs, n_toxic = rows.agg(F.count("*"), F.coalesce(F.sum(F.col("toxic").cast("long")), F.lit(0))).first()
    model = default_model()
    if not 0 < n_toxic < n_docs:
        return model
    insults, threats = induce(rows, n_docs, n_toxic)
    model = Model({**model.terms, **insults}, {**model.threats, **threats}, model.weights)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [model.events(t).tolist() for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column(1)], names=["x", "toxic"])

    seen = rows.mapInArrow(features, "x array<double>, toxic int").groupBy("x").agg(F.count("*").alias("n"), F.sum("toxic").alias("t")).toPandas()
    x = np.array(seen["x"].tolist(), float)
    t, rest = seen["t"].to_numpy(float), (seen["n"] - seen["t"]).to_numpy(float)
    model.weights = fit_logistic(x, t, rest)
    return model


def fit_logistic(x: np.ndarray, t: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """Bias and non-negative weights of a ridge logistic model, of rows given with how often they were toxic and not."""
    xx = np.hstack([np.ones((len(x), 1)), x])
    w, n = np.zeros(xx.shape[1]), t + rest
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(xx @ w, -30, 30)))
        gradient = xx.T @ (n * p - t) + 0.05 * np.append(0, w[1:])
        hessian = (xx * (n * p * (1 - p))[:, None]).T @ xx + 0.05 * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w = w - np.clip(step, -2, 2)
        w[1:] = np.maximum(w[1:], 0)
        if np.abs(step).max() < 1e-6:
            break
    return w


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with a double column ``name`` (which replaces one of that name)."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    made = f"score_{uuid.uuid4().hex}"  # no column of the input has that name
    found = with_column(docs, text, made, DoubleType(), lambda texts: pa.array(held.value.scores([t.decode() for t in texts]), pa.float64()))
    return found.withColumn(name, F.col(made)).drop(made)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every whole text of ``documents``, by a model of the labelled rows that aren't held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
