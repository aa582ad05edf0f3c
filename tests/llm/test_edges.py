"""Nulls, empty and long texts, ties, repeated rows, empty tables and columns of clashing names."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from winnower.llm import embeddings, jpeg, media, mixing, packing, pii, secrets, simhash, substring, toxicity, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, component_id long, fp long, tokens long, spans string, row long"
KEY = "AKIA" + "ABCD" * 5


def _row(doc, text):
    return (doc, text, None, None, len(text or ""), 0.5, 7, 7, 7, "x", 7)


@pytest.fixture(scope="module")
def odd(spark):
    """Every odd case at once; columns of names that the operators use themselves."""
    passage = "a passage of many words that stands in two documents and is long enough to count as one repeated span of the corpus by any measure we take here."
    rows = [_row(0, None), _row(1, ""), _row(None, passage), _row(2, passage), _row(3, passage), _row(3, passage), _row(4, "\n \t"), _row(5, "word " * 100_000), _row(6, "x" * 200_000), _row(7, f"key {KEY} and Zm9vYmFyMTIzNDU2Nzg5MDEyMw== end"), _row(None, None), _row(8, "🎉 ünïcödé 日本語 a@b.co"), _row(8, "other text of the same id")]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(2, 1, 0), (3, 0, 1), (3, 0, 1), (4, None, None), (None, 1, 1), (99, 1, 0)], "doc_id long, quality int, toxic int")


def test_toxicity(spark, odd, labels):
    model = toxicity.fit(odd, labels)
    rows = toxicity.score(odd, model).collect()
    assert len(rows) == 13 and all(0 <= r.score <= 1 for r in rows)
    empty = {round(r.score, 9) for r in rows if not (r.text or "").strip()}
    assert len(empty) == 1
    assert toxicity.score(odd.limit(0), toxicity.fit(odd.limit(0), labels.limit(0))).count() == 0
    plain, negated, reported = toxicity.default_model().scores(["you are an idiot", "you are not an idiot", "he said you are an idiot"])
    assert plain > reported and plain > negated


def test_simhash(odd):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == 13
    by = {(r.doc_id, r.fp): r.component_id for r in rows}
    assert {c for (_, f), c in by.items() if f == 0} == {0}
    assert len({r.component_id for r in rows if r.doc_id in (2, 3)}) == 1
    kept = simhash.drop_similar(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id for r in kept.filter("text like 'a passage%'").collect()) == [2]
    assert simhash.near_duplicates(odd.limit(0)).count() == 0 and simhash.drop_similar(odd.limit(0)).count() == 0


@pytest.mark.parametrize("block", [2, 8, 4096])
def test_anchors_lose_no_link(spark, block):
    """All pairs within three bits are connected, however small the blocks are."""
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    near = [int(b) ^ sum(1 << int(k) for k in rng.choice(64, n, replace=False)) for b in base for n in (0, 1, 2, 3, 3, 4)]
    values = sorted({x - (1 << 64) if x >> 63 else x for x in near})
    links = simhash.fingerprint_links(spark.createDataFrame([(v,) for v in values], "fp long"), block=block).collect()
    parent = {v: v for v in values}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        assert ((a ^ b) & (2**64 - 1)).bit_count() <= 3
        parent[top(a)] = top(b)
    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            if ((a ^ b) & (2**64 - 1)).bit_count() <= 3:
                assert top(a) == top(b)


def test_secrets(odd):
    rows = secrets.find_secrets(odd).collect()
    assert len(rows) == 13
    found = next(r for r in rows if r.doc_id == 7)
    assert (found.n_access, found.n_linked) == (1, 1)
    hidden = secrets.masked(odd)
    assert hidden.columns == odd.columns and hidden.count() == 13
    assert hidden.filter("doc_id = 7").first().text == "key <access> and <secret> end"
    assert hidden.filter("doc_id = 0").first().text is None
    assert secrets.masked(odd.limit(0)).count() == 0


def test_weak_parts_alone_are_not_reported(spark):
    docs = spark.createDataFrame([(1, "only Zm9vYmFyMTIzNDU2Nzg5MDEyMw== here"), (2, KEY + " " * 2000 + "Zm9vYmFyMTIzNDU2Nzg5MDEyMw=="), (3, "user: alice Zm9vYmFyMTIzNDU2Nzg5MDEyMw== at https://db.example.org/x")], "doc_id long, text string")
    rows = {r.doc_id: r.n_linked for r in secrets.find_secrets(docs).collect()}
    assert rows == {1: 0, 2: 0, 3: 2}


def test_pii(odd):
    docs = odd.withColumn("pattern", F.lit("clash"))
    rows = pii.extract(docs, pii.learn(docs.select("text"))).collect()
    assert len(rows) == 13
    assert next(r for r in rows if r.doc_id == 8 and "a@b" in r.text).pii.n_email == 1
    assert pii.extract(odd.limit(0), pii.learn(odd.limit(0).select("text"))).count() == 0


def test_pii_finds_unseen_identifiers_by_their_context(spark):
    rows = [(f"Some words. contact mailbox: user{i}@mail{i}.org thanks for all.",) for i in range(40)] + [("Some words. contact mailbox: hidden.person9#place thanks for all.",)]
    docs = spark.createDataFrame(rows, "text string")
    found = pii.extract(docs, pii.learn(docs)).filter("text like '%hidden%'").first().pii
    assert found.n_email == 0 and found.n_found >= 1


def test_packing(odd):
    rows = packing.pack(odd).collect()
    assert sum(r.piece == 0 for r in rows) == 13
    places = sorted((r.sequence_id, r.offset, r.length) for r in rows)
    for (s, a, n), (t, b, _) in zip(places, places[1:], strict=False):
        assert b == (a + n if s == t else 0)
    assert packing.pack(odd.limit(0)).count() == 0


def test_mixing(odd, labels):
    mixed = mixing.mix(odd, labels)
    assert mixed.count() == 13 and mixed.filter("rate < 0 or rate is null").count() == 0
    assert mixing.mix(odd, labels.limit(0)).filter("rate <> 1").count() == 0
    assert mixing.mix(odd.limit(0), labels).count() == 0
    taken = mixing.take(odd, mixing.mix(odd, labels, mixing.PIPELINE_TARGETS, least=1.0))
    assert taken.columns == odd.columns and taken.count() >= 13


def test_substring(odd):
    spans = substring.repeated_spans(odd)
    assert {r.doc_id: r.kept_doc_id for r in spans.filter("doc_id is null or doc_id <> 5").collect()} == {3: 2, None: 2}
    left = substring.remove_spans(odd, spans)
    assert left.count() == 13 and left.columns == [*odd.columns, "kept_spans"]
    assert {r.text for r in left.filter("doc_id = 3").collect()} == {""}
    assert left.filter("doc_id = 2").first().text.startswith("a passage")
    assert substring.repeated_spans(odd.limit(0)).count() == 0


def test_warc(spark, tmp_path):
    rows = [(1, "u", "<p>a</p>"), (2, None, "<p>a</p>"), (2, None, "<p>a</p>"), (3, "u", None), (4, "u", ""), (None, None, "b" * 300_000), (5, "u", "日本")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash")).withColumn("shard", F.lit(1))
    folder = f"file://{tmp_path}/warc"
    warc.write_archives(pages, folder, shards=3, roll_bytes=200)
    found = warc.read_archives(spark, folder).collect()
    assert len(found) == len(rows)
    assert {(r.page_id, r.record_type, r.refers_to) for r in found if r.page_id in (1, 3, 4, 5)} == {(1, "revisit", 2), (3, "revisit", 4), (4, "response", None), (5, "response", None)}
    assert {r.record_type for r in found if r.page_id == 2} == {"response"}  # ties for the largest id
    warc.write_archives(pages.limit(0), f"{folder}-none")
    assert warc.read_archives(spark, f"{folder}-none").count() == 0


def test_embeddings(spark):
    v = [1.0, 0.0, 0.5, 0.25]
    rows = [(1, v), (2, v), (2, [x * 3 for x in v]), (None, v), (3, None), (4, [0.0] * 4), (5, [1.0, None, 0.0, 0.0]), (6, [float("nan"), 1.0, 0.0, 0.0]), (7, [1.0, 0.0]), (8, []), (9, [1e300, 0.0, 5e299, 2.5e299]), (10, [-x for x in v])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("class", F.lit(1)).withColumn("n_links", F.lit(1))
    found = embeddings.near_duplicates(table).collect()
    assert len(found) == len(rows)
    assert {(r.n_links, r.component_id) for r in found if r.vec_id in (1, 2, 9)} == {(4, 1)}
    assert all(r.n_links == 0 and r.kept for r in found if r.vec_id in (3, 4, 5, 6, 7, 8, 10))
    assert embeddings.near_duplicates(table.limit(0)).count() == 0


@pytest.mark.parametrize("task_rows", [3, 50, 8192])
def test_blocks_lose_no_pair(spark, task_rows):
    """All links are counted once and connected, however many tasks a cell is split into."""
    rng = np.random.default_rng(3)
    x = np.repeat(rng.standard_normal((12, 32)), 10, axis=0) + 0.28 * rng.standard_normal((120, 32))
    classes = spark.createDataFrame([(i, 32, r.tolist(), 1) for i, r in enumerate(x)], "class long, dims int, vector array<double>, n long")
    found = embeddings.links(classes, 0.9, task_rows=task_rows).collect()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = np.triu(u @ u.T >= 0.9, 1)
    counted = np.zeros(len(x), int)
    parent = list(range(len(x)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for r in found:
        counted[r["class"]] += r.links
        if r.other is not None:
            assert near[min(r["class"], r.other), max(r["class"], r.other)]
            parent[top(r["class"])] = top(r.other)
    assert counted.tolist() == (near | near.T).sum(axis=1).tolist() and near.any()
    assert all(top(i) == top(j) for i, j in zip(*np.nonzero(near), strict=True))


def test_media(spark, odd):
    read = media.thumbnails(media.store_text(odd)).collect()
    assert len(read) == 13 and all(r.image.status == "ok" for r in read)
    bad = spark.createDataFrame([(None,), (b"",), (b"not a picture",), (jpeg.encode([b"a" * 192])[0][:40],)], "media binary")
    assert sorted(r.image.status for r in media.thumbnails(bad).collect()) == ["bad", "bad", "bad", "null"]
    assert media.thumbnails(media.store_text(odd.limit(0))).count() == 0


def test_pipeline_stages_on_an_empty_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    assert docs.count() == 0


def _edited(rng, base, n, changed):
    """A text and copies of it with ``changed`` words replaced each."""
    texts = [" ".join(base)]
    for i in range(n):
        words = list(base)
        for at in rng.choice(len(words), changed, replace=False):
            words[at] = f"new{i}x{at}"
        texts.append(" ".join(words))
    return texts


def _brute_groups(texts):
    """Of each text the first that five-word Jaccard similarities of 0.8 or more lead to."""
    sets = []
    for text in texts:
        words = text.split()
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))})
    parent = list(range(len(texts)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = 0
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both >= 0.8 * (len(a) + len(sets[j]) - both):
                links += 1
                x, y = top(i), top(j)
                parent[max(x, y)] = min(x, y)
    return [top(i) for i in range(len(texts))], links


@pytest.mark.parametrize("block", [32, 4096])
def test_similar_groups_try_every_pair_of_a_crowd(spark, block):
    """Hundreds of copies with three of 150 words changed: most aren't similar, but every true link counts."""
    rng = np.random.default_rng(3)
    texts = _edited(rng, [f"w{x}" for x in rng.integers(0, 5000, 150)], 500, 3)
    # repeated lines, and a passage that every text has
    line = [f"r{x}" for x in range(12)]
    texts += _edited(rng, line * 8 + [f"v{x}" for x in range(40)], 60, 2)
    texts += [" ".join([*line, *(f"u{i}y{x}" for x in range(30))]) for i in range(60)]
    wanted, links = _brute_groups(texts)
    assert links > 500
    rows = simhash.similar_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7), block=block).collect()
    of = {r.doc_id: r.component for r in rows}
    least = {}
    for d in sorted(of):
        least.setdefault(of[d], d)
    assert [least[of[d]] for d in range(len(texts))] == wanted


def test_pii_learns_in_two_hops(spark):
    """An identifier beside a pattern that no base match has, but identifiers do that the first hop finds."""
    # Base matches stand behind 'mail'; so do member numbers, which also stand behind 'badge', and the last one does only there.
    texts = [f"please mail user{i}@example.com today" for i in range(60)]
    numbers = [f"Q{i}-{7000 + 13 * i}" for i in range(10)]
    texts += [f"please mail {x} today" for x in numbers] + [f"their badge {x} was" for x in numbers]
    texts += ["their badge hidden-99z was", "some other-77z thing", "some thing-78z thing"]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    rows = {r.text: r.pii for r in pii.extract(docs, pii.learn(docs)).collect()}
    assert rows[f"please mail {numbers[0]} today"].n_found == 1
    assert rows["their badge hidden-99z was"].spans == "email:12:22"
    assert rows["some other-77z thing"].n_found == rows["some thing-78z thing"].n_found == 0


def test_pii_drops_no_pattern_beyond_the_broadcast(spark, odd):
    """Patterns that are too many to broadcast find what they find by broadcast, also in repeated and null texts."""
    texts = [f"mail user{i}@example.com or ring {w} +49 30 555{1000 + i}" for w in ("home", "office") for i in range(30)]
    texts += ["mail hidden-1z2 or not", "ring home hidden-3z4", "ring home hidden-3z4", "ring office hidden-5z6"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").unionByName(odd.select("doc_id", "text"))
    patterns = pii.learn(docs.select("text"))
    assert patterns.count() > 2
    wanted = sorted(map(str, pii.extract(docs, patterns).collect()))
    found = pii.extract(docs, patterns, max_patterns=1)
    assert found.columns == ["doc_id", "text", "pii"]
    assert sorted(map(str, found.collect())) == wanted
    assert sum(r.pii.n_found for r in found.filter("text like '%hidden%'").collect()) == 4


HELPERS = ["_content", "_rank", "_key", "_hash", "_times", "_copy", "_rate", "_score", "_id", "_gone", "_text_hash", "_found", "_row", "_text", "_new", "_last", "row", "id", "text_hash", "key", "hash", "rate", "times", "copy", "content", "rank", "component", "kept", "gone", "of", "start", "end", "domain", "pattern", "found", "made", "digest"]


def test_extra_columns_keep_their_values(spark, odd, monkeypatch):
    """Whatever names extra columns have, every stage and every operator that returns rows as they were leaves them alone."""
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars").filter("length(text) < 1000 or text is null")
    extra = [f"value of {h}" for h in HELPERS]
    rows = docs.select("*", *(F.lit(v).alias(h) for h, v in zip(HELPERS, extra, strict=True)))
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(20)], "doc_id long, quality int, toxic int")
    monkeypatch.setattr(corpus_pipeline, "table", lambda *_: labels)

    def same(found, columns):
        assert found.columns == columns
        held = found.collect()
        assert held and all([r[h] for h in HELPERS] == extra for r in held)

    for stage in (corpus_pipeline.drop_toxic, corpus_pipeline.drop_near_duplicates, corpus_pipeline.mask_secrets, corpus_pipeline.mix_sources):
        same(stage(spark, rows, None), rows.columns)
    assert corpus_pipeline.pack_documents(spark, rows, None).count() >= rows.count()
    same(substring.remove_spans(rows, substring.repeated_spans(rows)), [*rows.columns, "kept_spans"])
    patterns = spark.createDataFrame([("text of", 0, 0.9), ("same id", 1, 0.9)], "pattern string, kind int, score double")
    for most in (10, 1):
        same(pii.extract(rows, patterns, max_patterns=most), [*rows.columns, "pii"])


def test_short_lines_are_repeats_and_not_passages(spark):
    rows = spark.createDataFrame([(1, "Yes\nfirst of all this\n\nend"), (2, "yes\nanother line here"), (3, "Yes \n yes\nEND")], "doc_id long, text string")
    spans = substring.repeated_spans(rows)
    assert sorted((r.doc_id, r.start, r.end, r.n_words, r.passage, r.kept_doc_id) for r in spans.collect()) == [(2, 0, 4, 1, 0, 1), (3, 0, 13, 3, 0, 1)]
    assert {r.doc_id: r.text for r in substring.remove_spans(rows, spans).collect()} == {1: "Yes\nfirst of all this\n\nend", 2: "another line here", 3: ""}
    assert {r.doc_id: r.text for r in substring.remove_spans(rows, spans, min_words=2).collect()}[2] == "yes\nanother line here"
