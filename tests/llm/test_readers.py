"""Second readers: the clause grammar told by regular expressions over letters, the mixing classifier by dictionaries."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from winnower.llm import mixing, toxicity

# --- toxicity: i insult, k threat, g target, n negation, r report, v intent, w word, p pause, s stop, q quotation mark

MODEL = toxicity.Model({"idiot": 1.0, "trot*": 0.6, "piece of shit": 2.0}, {"kill": 1.5, "beat you up": 3.0}, toxicity.DEFAULT_WEIGHTS)
TOKENS = [
    *(("idiot", "i", 1.0), ("Trottelhaft", "i", 0.6), ("piece of shit", "i", 2.0), ("kill", "k", 1.5), ("beat you up", "k", 3.0)),
    *(("you", "g", 0), ("him", "g", 0), ("not", "n", 0), ("never", "n", 0), ("said", "r", 0), ("wrote", "r", 0), ("will", "v", 0), ("shall", "v", 0)),
    *(("table", "w", 0), ("green", "w", 0), ("piece", "w", 0), (",", "p", 0), (";", "p", 0), (".", "s", 0), ("!", "s", 0), ('"', "q", 0), ("«", "q", 0)),
]


def _inside(pattern: str, letters: str) -> set[int]:
    """Places within the first group of the pattern's matches."""
    return {i for m in re.finditer(pattern, letters) if m.group(1) is not None for i in range(*m.span(1))}


def _read(line: list[tuple[str, str, float]], out: np.ndarray) -> float:
    letters = "".join(t[1] for t in line)
    size = len(letters)
    from_left = _inside(r"r([^qs]*(?:q[^q]*)?)", letters)  # what is reported, to the stop or the closing mark
    quoted = {size - 1 - i for i in _inside(r"r[^qs]*(?:q([^q]*)q?|s|$)", letters[::-1])}  # quoted before the report
    clauses = defaultdict(float)
    for i, (_, kind, weight) in enumerate(line):
        if kind not in "ik":
            continue
        before, after = letters[:i], letters[i + 1 :]
        clause = re.split("[ps]", before)[-1]
        aimed, late = bool(re.search(r"g[^gr]*$", clause)), bool(re.match(r"[^grps]*g", after))
        near = lambda opener: re.search(opener + r"(?:q*[^qps]){0,%d}q*$" % (toxicity.REACH - 1), clause)  # noqa: B023, E731
        if kind == "i" and "i" in clause:
            weight *= 1.25
        if kind == "k" and near("v"):
            weight *= 1.5
        if aimed or late:
            weight *= 1.5 if kind == "i" else 2.0
        if negated := near("n"):
            weight *= 0.25
        reported = i in from_left or i in quoted
        if reported:
            weight *= 0.5
        out[(4 if kind == "k" else 0) + (3 if reported else 2 if negated else 1 if aimed or late else 0)] += weight
        clauses[len(re.findall("[ps]", before))] += weight
    return max(clauses.values(), default=0.0)


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.lists(st.sampled_from(TOKENS), max_size=22), min_size=1, max_size=3))
def test_grammar_against_regular_expressions(lines):
    """Events and the heaviest clause of random clauses, lines each by itself."""
    out = np.zeros(8)
    peak = max(_read(line, out) for line in lines)
    text = "\n".join(" ".join(t[0] for t in line) for line in lines)
    assert MODEL.events(text) == pytest.approx([*np.log1p(out), math.log1p(peak)])


# --- mixing


def _signed(data: bytes, seed: int = 42) -> int:
    h = xxhash.xxh64_intdigest(data, seed=seed)
    return h - (1 << 64) if h >> 63 else h


def _chained(*values: tuple[int, int]) -> int:
    """The hash of several numbers (value, bytes): each one's is the seed of the next."""
    h = 42
    for value, size in values:
        h = xxhash.xxh64_intdigest(value.to_bytes(size, "little", signed=True), seed=h)
    return h - (1 << 64) if h >> 63 else h


def _words(text: str | None) -> list[str]:
    return re.findall(mixing.WORDS, (text or "").lower())


def _posteriors(docs, domains):
    """The domains, and the posteriors of each (id, text), by dictionaries."""
    bucket = lambda w: _signed(w.encode()) % mixing.BUCKETS
    counts = defaultdict(Counter)
    for d, text in docs:
        if d in domains:
            counts[domains[d]].update(bucket(w) for w in set(_words(text)))
    names = sorted(counts)
    totals = [sum(counts[d].values()) for d in names]
    known = set().union(*(counts[d] for d in names))
    logs = {b: np.array([math.log((counts[d][b] + 1) / (n + mixing.BUCKETS)) for d, n in zip(names, totals, strict=True)]) for b in known}
    seen = Counter(domains.values())
    prior = np.array([seen[d] + 1 for d in names], float)
    out = []
    for _, text in docs:
        words = set(_words(text))
        z = np.log(prior / prior.sum()) + sum((logs[b] - logs[b].mean() for b in map(bucket, words) if b in known), np.zeros(len(names))) / math.sqrt(max(1, len(words)))
        e = np.exp(z - z.max())
        out.append(e / e.sum())
    return names, out


def test_posteriors_and_copies_against_dictionaries(spark):
    rng = np.random.default_rng(8)
    pool = [[f"{k}{i}" for i in range(40)] for k in ("good", "bad", "Éd", "und")]
    docs = [(i, " ".join(rng.choice(pool[i % 4], 12)) + "\t" + " ".join(rng.choice(sum(pool, []), 6))) for i in range(120)] + [(500, ""), (501, None), (502, "never\vseen words")]
    labels = [(i, int(i % 4 in (0, 2)), int(i % 4 == 3)) for i in range(60)] + [(7, 1, 0), (8, None, 1), (900, 1, 0)]
    domains = {}
    for d, q, t in labels:
        if q is not None:
            domains[d] = max(domains.get(d, 0), q + 2 * t)
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    mixed = mixing.mix(table, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), {0: 0.2, 1: 0.6, 2: 0.2})
    rows = {r.doc_id: r for r in mixed.collect()}
    names, wanted = _posteriors(docs, domains)
    assert len(rows) == len(docs)
    for (d, text), p in zip(docs, wanted, strict=True):
        assert rows[d].p == pytest.approx(p.tolist(), abs=1e-9) and rows[d].tokens == len(_words(text)) and rows[d].domain == names[int(np.argmax(p))]
    for seed in (7, 8):
        taken = Counter(r.doc_id for r in mixing.take(table, mixed, seed=seed).collect())
        for d, text in docs:
            rate = rows[d].rate
            luck = _chained((d, 8), (_signed((text or "").encode()), 8), (seed, 4)) % 1_000_000 / 1e6
            assert taken[d] == math.floor(rate) + (luck < rate - math.floor(rate))
