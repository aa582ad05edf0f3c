"""Exact dedup, importance resampling and the filter audit: SQL over whole tables, brute force on odd rows, and their parts."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from winnower.llm import audit, common, exact, importance, registry


@pytest.mark.parametrize("name", ["op11_exact_dedup", "op12_importance_resampling", "op13_filter_audit"])
def test_query_equals_sql(spark, sf, name):
    df = registry.QUERIES[name](spark, sf)
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    columns = sorted(df.columns)
    assert sorted(x[0] for x in con.execute(f"SELECT * FROM ({registry.ORACLE_SQL[name]}) LIMIT 0").description) == columns
    wanted = con.execute("SELECT " + ", ".join(f'CAST("{c}" AS VARCHAR)' for c in columns) + f" FROM ({registry.ORACLE_SQL[name]})").fetchall()
    assert sorted(map(str, map(tuple, df.select(*(df[c].cast("string") for c in columns)).collect()))) == sorted(map(str, wanted))


SAME = "The same text, ÄÖ, of more characters than the beginning has. " * 20
CLASHING = {c: 7 for c in ("length", "prefix", "digest", "near", "bucket", "at", "bitmap", "keep_id", "group_size", "kept", "row", "of", "hash", "part", "mask", "first", "n", "rank", "score", "down", "id", "segment", "in_pool", "weight")}
ODD = [
    (0, None), (1, ""), (2, SAME), (3, SAME.replace("The", "tHE")), (4, SAME.replace("Ä", "ä")), (5, SAME[:-1] + "!"), (6, SAME + "x"), (6, SAME + "x"), (None, SAME), (None, "only without an id"),
    (7, "one two $ three"), (8, "w" * 300_000), (9, "W" * 300_000), (10, "word " * 60_000), (11, "🎉 ünï日本語 ONE"), (11, "other text of the same id"), (12, "\n\t "), (13, " ".join(f"word{i}" for i in range(70))), (14, " ".join(f"word{i}" for i in range(70))),
]


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame([(d, t, ("a", "", None)[i % 3]) for i, (d, t) in enumerate(ODD)], "doc_id long, text string, source string")
    return df.select("*", *(F.lit(v).alias(k) for k, v in CLASHING.items())).repartition(4)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(2, 1, 0), (3, 0, 1), (3, 0, 1), (4, None, None), (None, 1, 1), (99, 1, 0), (13, 1, 1)], "doc_id long, quality int, toxic int")


def _low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


@pytest.mark.parametrize(("prefix_chars", "hot"), [(256, 1024), (1, 2), (0, 1)])
def test_exact_groups(odd, monkeypatch, prefix_chars, hot):
    monkeypatch.setattr(common, "HOT", hot)
    ids = defaultdict(list)
    for d, t in ODD:
        ids[_low(t)].append(d)
    wanted = []
    for text, held in ids.items():
        keep = max((x for x in held if x is not None), default=None)
        wanted += [(d, keep, len(held), d == keep, hashlib.sha256(text.encode()).hexdigest()) for d in held]
    found = exact.exact_groups(odd, prefix_chars=prefix_chars, hash_all=True).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.hash.hex()) for r in found) == Counter(wanted)
    assert all(r.digest is not None for r in found if r.group_size > 1)


def test_only_texts_that_may_have_a_copy_are_hashed(odd):
    rows = exact.digests(odd).collect()
    hashed = Counter(r.doc_id for r in rows if r.digest is not None)
    # Of 2 to 6 and the null id length and beginning are shared, 5 and 4 among them; texts of a length of their own aren't hashed.
    assert not {7, 10, 12} & set(hashed) and {2, 3, 6, 8, 9, 13, 14} <= set(hashed)


def test_drop_exact(odd):
    kept = exact.drop_exact(odd)
    assert kept.columns == odd.columns
    rows = kept.collect()
    assert len(rows) == len({_low(t) for _, t in ODD}) and {_low(r.text) for r in rows} == {_low(t) for _, t in ODD}
    assert {r.doc_id for r in rows if _low(r.text) == _low(SAME)} == {3}
    assert all(r[c] == v for r in rows for c, v in CLASHING.items())
    assert exact.drop_exact(odd.limit(0)).count() == 0 and exact.exact_groups(odd.limit(0)).count() == 0


def _resampled(rows, target, percent, least, seed=2024, buckets=10_000):
    """Brute force over whole texts."""
    cut = lambda t: re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", _low(t))
    at = lambda w: zlib.crc32(w.encode()) % buckets
    s, t = Counter(at(w) for _, x in rows for w in cut(x)), Counter(at(w) for x in target for w in cut(x))
    n_s, n_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (n_s + buckets) / ((s[b] + 1) * (n_t + buckets))))
    out = []
    for d, x in rows:
        words = cut(x)
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(at(w)) for w in words)
        out.append([d, len(words), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    pool = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[3], 2**63 if r[0] is None else r[0]))
    for i, r in enumerate(pool):
        r.append(i + 1 if i < percent * len(pool) // 100 else None)
    return Counter(tuple(r) if len(r) == 5 else (*r, None) for r in out)


@pytest.mark.parametrize(("parts", "samples", "percent"), [(None, 1 << 18, 50), (5, 1 << 18, 100), (3, 4, 37), (50, 2, 60)])
def test_resampling(spark, odd, parts, samples, percent):
    target = ["one word and three", None, "日本語 other text"]
    table = spark.createDataFrame([(t,) for t in target], "text string")
    found = importance.resampled(odd, table, percent=percent, min_words=1, parts=parts, max_samples=samples).collect()
    assert Counter(map(tuple, found)) == _resampled(ODD, target, percent, 1)
    none = importance.resampled(odd.limit(0), table.limit(0), parts=parts)
    assert none.count() == 0 and none.columns == ["doc_id", "n_features", "weight", "score", "rank"]


@pytest.mark.parametrize("parts", [1, 7, 64])
def test_ranks_of_equal_scores_are_dealt_to_all_segments(spark, parts):
    """Half of all rows have one score, a third one score and one id; ranks are 1, 2, 3 ... in order, and segments stay even."""
    rows = [(i if i % 3 else 0, 5 if i % 2 else i % 11, i % 13 > 0) for i in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, score long, in_pool boolean").repartition(6)
    found = importance.ranked(df, lambda n: n, parts=parts).collect()
    pool = sorted((r for r in found if r.in_pool), key=lambda r: r.rank)
    assert [r.rank for r in pool] == list(range(1, len(pool) + 1)) and all(r.rank is None for r in found if not r.in_pool)
    assert [(r.score, r.doc_id) for r in pool] == sorted(((s, d) for d, s, p in rows if p), key=lambda x: (-x[0], x[1]))
    table = importance.runs(df)
    cuts = importance.splitters(table.filter("in_pool"), parts)
    dealt = table.filter("in_pool").mapInArrow(importance._segments(cuts, table.columns), "doc_id long, score long, in_pool boolean, down long, id long, at long, segment int")
    sizes = [r["count"] for r in dealt.groupBy("segment").count().collect()]
    assert len(sizes) == parts and max(sizes) <= 2 * len(pool) / parts + 6


def test_ngrams_and_bounded_memory_of_buckets(monkeypatch):
    assert importance._features("One, Two three".encode(), 2) == [b"one", b"two", b"three", b"one two", b"two three"]
    monkeypatch.setattr(importance, "MAX_KNOWN", 3)
    known = importance._Buckets(97)
    words = [f"w{i % 7}".encode() for i in range(50)]
    assert [known[w] for w in words] == [zlib.crc32(w) % 97 for w in words] and len(known) <= 3


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 31, 1000, 4097])
def test_positional_popcount(n):
    words = np.random.default_rng(n).integers(0, 2**32, n, dtype=np.uint64).astype(np.uint32)
    assert audit.positional_popcount(words).tolist() == [int((words >> np.uint32(b) & np.uint32(1)).sum()) for b in range(32)]


def _audited(rows, labels):
    """Each order of filters, applied document by document."""
    good, toxic = {d for d, q, _ in labels if q == 1 and d is not None}, {d for d, _, t in labels if t == 1 and d is not None}
    ids = defaultdict(list)
    for d, t, _ in rows:
        ids[t or ""].append(2**63 if d is None else d)

    def fails(d, text):
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0d]+", text)
        copy = min(ids[text]) < (2**63 if d is None else d)
        checks = (len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), bool(re.search(r"[#$%&*|]", text)), copy)
        return {f for f, x in zip("ABCDE", checks, strict=True) if x}

    by = defaultdict(list)
    for d, t, p in rows:
        by[p or ""].append((d, fails(d, t)))
    out, total = [], Counter()
    for part, held in by.items():
        for order in map("".join, permutations("ABCDE")):
            left = held
            for i, f in enumerate(order):
                gone, left, before = [x for x in left if f in x[1]], [x for x in left if f not in x[1]], left
                total[part, f] += len(gone)
                row = [len(left), len(gone), sum(f in x[1] for x in held) - len(gone), sum(x[1] == {f} for x in held), sum(x[0] in good for x in gone), sum(x[0] in toxic for x in gone)]
                out.append((part, order, i + 1, *row))
    return Counter((*r, total[r[0], r[1][r[2] - 1]]) for r in out)


@pytest.mark.parametrize("hot", [1024, 1])
def test_audit(odd, labels, monkeypatch, hot):
    monkeypatch.setattr(common, "HOT", hot)
    rows = [(d, t, ("a", "", None)[i % 3]) for i, (d, t) in enumerate(ODD)]
    found = audit.audit(odd, labels).collect()
    assert len(found) == 2 * 120 * 5
    assert Counter(map(tuple, found)) == _audited(rows, [tuple(r) for r in labels.collect()])
    assert audit.audit(odd.limit(0), labels).count() == 0
    assert audit.audit(odd, labels.limit(0)).filter("good_lost + toxic_lost > 0").count() == 0


def test_audit_of_more_parts_than_a_task_holds(spark, labels, monkeypatch):
    monkeypatch.setattr(audit, "MAX_PARTS", 3)
    rows = [(i, "text " * (i % 80), f"p{i % 17}") for i in range(200)]
    found = audit.audit(spark.createDataFrame(rows, "doc_id long, text string, source string"), labels).collect()
    assert Counter(map(tuple, found)) == _audited(rows, [tuple(r) for r in labels.collect()])
