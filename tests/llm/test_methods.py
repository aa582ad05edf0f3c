"""What the methods add, on small inputs: against brute force, by made cases, and on inputs that would break a weaker form."""

from __future__ import annotations

import math
import re
import struct
import time
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from winnower.llm import embeddings, jpeg, media, mixing, packing, pii, secrets, simhash, substring, toxicity, warc

# --- substring


def _brute_spans(docs, pattern, clauses, unit_words, min_words):
    """{doc: [(start, end)]} of what repeats: docs is a list of (id, text) in order of ids."""
    seen, out = {}, {}
    clause = re.compile(substring.CLAUSE) if clauses else None
    found = {d: substring.text_units(t or "", re.compile(substring.UNITS[pattern]), unit_words, clause) for d, t in docs}
    for d, _ in docs:
        for u in found[d]:
            seen.setdefault(u[4], d)
    for d, _ in docs:
        own, gone = set(), []
        for a, b, low, high, digest in found[d]:
            if seen[digest] != d or digest in own:
                gone.append((low, -high, a, b))
            own.add(digest)
        runs = []
        for low, high, a, b in sorted(gone):
            if runs and low - runs[-1][1] < unit_words:
                runs[-1] = [runs[-1][0], max(runs[-1][1], -high), min(runs[-1][2], a), max(runs[-1][3], b)]
            else:
                runs.append([low, -high, a, b])
        out[d] = [(a, b) for low, high, a, b in runs if high - low >= min_words]
    return out


@pytest.mark.parametrize(("unit", "clauses", "min_words"), [("line", False, 3), ("line", True, 3), ("paragraph", False, 3), ("paragraph", True, 8), ("line", True, 25)])
def test_repeated_units(spark, unit, clauses, min_words):
    rng = np.random.default_rng(11)
    parts = [" ".join(f"w{x}" for x in rng.integers(0, 400, rng.integers(1, 9))) for _ in range(60)]
    docs = [(i, "".join(parts[k] + [". ", ", ", "\n", "\n\n", "! "][rng.integers(5)] for k in rng.integers(0, 60, rng.integers(0, 30)))) for i in range(40)]
    rows = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    found = defaultdict(list)
    for r in substring.repeated_spans(rows, unit, clauses=clauses, min_words=min_words).collect():
        found[r.doc_id].append((r.start, r.end))
    wanted = {d: x for d, x in _brute_spans(docs, unit, clauses, 3, min_words).items() if x}
    assert {d: sorted(x) for d, x in found.items()} == wanted and (wanted or min_words == 25)


def test_removed_text_and_kept_offsets(spark):
    """A passage that begins in the middle of a line, and a short line that stays; what is left is cut at the offsets."""
    passage = "one passage of words, that two documents have in the middle of a line; it is long enough for a span, and ends before another word."
    docs = [(1, f"First here. {passage} Then more.\nall rights reserved"), (2, f"Second is other. {passage} And this.\nall rights reserved")]
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    spans = substring.repeated_spans(rows, min_words=20)
    left = {r.doc_id: r for r in substring.remove_spans(rows, spans).collect()}
    assert left[1].text == docs[0][1]
    # The line's end goes too: "and this" is too short to part the passage from the repeated line.
    assert left[2].text == "Second is other."
    assert "".join(docs[1][1][a:b] for a, b in left[2].kept_spans) == left[2].text


# --- toxicity


def _only(model, text):
    return [e for e, v in zip(toxicity.EVENTS, model.events(text), strict=False) if v]


@pytest.mark.parametrize(
    ("text", "wanted"),
    [
        ("you are an idiot", ["insult_aimed"]),
        ("an idiot walks", ["insult"]),
        ("he said: you are an idiot", ["insult_reported"]),
        ("she wrote, you are an idiot", ["insult_reported"]),
        ('he said "it is late. you are an idiot. go"', ["insult_reported"]),
        ('he said "it is late." you are an idiot', ["insult_aimed"]),
        ("“you are an idiot” she said", ["insult_reported"]),
        ("he said. you are an idiot", ["insult_aimed"]),
        ("I will kill you", ["threat_aimed"]),
        ("you are not an idiot", ["insult_negated"]),
        ("you piece of shit", ["insult_aimed"]),
        ("a piece of cake for you", []),
        ("he said " + "word " * 1000 + "idiot", ["insult_reported"]),
        ("idiot " + "word " * 1000 + "you", ["insult_aimed"]),
    ],
)
def test_clauses(text, wanted):
    assert _only(toxicity.default_model(), text) == wanted


def test_reported_clauses_score_less_and_announced_threats_more():
    said, plain, kill, will = toxicity.default_model().scores(["he said: you are an idiot", "you are an idiot", "kill you", "I will kill you"])
    assert said < toxicity.THRESHOLD <= plain and kill < will


def test_threats_are_learned_apart_from_insults(spark):
    rng = np.random.default_rng(2)
    word = lambda: f"w{rng.integers(900)}"
    rows, labels = [], []
    for i in range(400):
        toxic = i % 4 == 0
        text = " ".join(word() for _ in range(12))
        if toxic:
            text += f" {word()} you {word()} zorbler {word()} . I will {word()} frumple {word()} you"
        rows.append((i, text if toxic else f"{text} I will {word()} {word()} {word()} you"))
        labels.append((i, 1, int(toxic)))
    model = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert model.kind("zorbler")[0] == "insult" and model.kind("frumple")[0] == "threat"
    bad, good = model.scores(["I will frumple you", "I will see you"])
    assert bad >= toxicity.THRESHOLD > good


def test_scoring_is_linear_in_the_text():
    model = toxicity.default_model()
    began = time.perf_counter()
    model.events("you idiot " * 200_000)
    assert time.perf_counter() - began < 10


# --- WARC


def test_null_ids_revisit_the_largest_id(spark, tmp_path):
    rows = [(4, "u", "same"), (None, "v", "same"), (None, None, "same"), (2, None, "same"), (None, "x", "alone"), (None, "y", "alone"), (-(2**63), "z", "same")]
    folder = f"file://{tmp_path}/warc"
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), folder, shards=2)
    found = sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.read_archives(spark, folder).collect()), key=str)
    assert found == sorted([(4, 4, "response", None), (None, 4, "revisit", 4), (None, 4, "revisit", 4), (2, 4, "revisit", 4), (None, 5, "response", None), (None, 5, "response", None), (-(2**63), 4, "revisit", 4)], key=str)


def test_archives_are_a_function_of_the_rows(spark, tmp_path):
    rows = [(i, f"u{i}", "x" * (50 + i % 7)) for i in range(300)]
    tables = []
    for n in (1, 5):
        folder = f"file://{tmp_path}/warc{n}"
        manifest = warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(n), folder, shards=4, roll_bytes=4000)
        tables.append((sorted(map(tuple, manifest.collect())), {p.name: p.read_bytes() for p in (tmp_path / f"warc{n}").glob("*.warc.gz")}))
    assert tables[0] == tables[1] and len(tables[0][1]) > 4


# --- personal data


def _brute_patterns(texts, rounds, confidence, support):
    """The same scoring with dictionaries: {(pattern, kind): score} of confident patterns."""
    edges = set()
    for t in texts:
        base = pii.base_spans(t)
        for a, b, kind in [(a, b, k) for a, k, b in base] + [(a, b, -1) for a, b in pii.candidates(t, base)]:
            edges |= {(p, t[a:b], kind) for p in pii.contexts(t, a, b)}
    scored = {}
    for _ in range(rounds):
        miss, best = defaultdict(float), defaultdict(float)
        for p, i, kind in edges:
            for (q, k), s in scored.items():
                if kind < 0 and p == q:
                    miss[i, k] += math.log(1 - min(s, 0.999))
                    best[i, k] = max(best[i, k], s)
        good, sure, total = defaultdict(float), defaultdict(int), defaultdict(int)
        for p, i, kind in edges:
            total[p] += 1
            if kind >= 0:
                good[p, kind] += 1
                sure[p, kind] += 1
            for (j, k), m in miss.items():
                if kind < 0 and i == j:
                    good[p, k] += 1 - math.exp(m)
                    sure[p, k] += best[j, k] >= confidence
        scored = {(p, k): g / (total[p] + 1) for (p, k), g in good.items() if sure[p, k] >= support and g / (total[p] + 1) > 0.05}
    return {x: s for x, s in scored.items() if s >= confidence}


def test_pattern_scores_against_brute_force(spark):
    texts = [f"write to user{i}@mail.org now" for i in range(9)] + [f"call +49 30 12345{i:03d} now" for i in range(7)]
    texts += [f"write to member-{i}x now" for i in range(8)] + [f"badge of member-{i}x here" for i in range(8)] + ["badge of ghost-77z here", "some thing-12q here", "write to 12345abc now"]
    wanted = _brute_patterns(texts, pii.ROUNDS, 0.45, 5)
    found = {(r.pattern, r.kind): r.score for r in pii.learn(spark.createDataFrame([(t,) for t in texts], "text string"), confidence=0.45).collect()}
    assert found.keys() == wanted.keys() and len(found) > 4
    assert all(found[x] == pytest.approx(s) for x, s in wanted.items())


# --- packing


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = str(public_tokenizers.path(packing.TOKENIZER))
    return path, Tokenizer.from_file(path)


PIECES = st.sampled_from(["<|endoftext|>", "<|endof", " ", "  ", "\n", "\t", "a", "Hello", " world", "'s", "'LL", "123", "12 3", "é", "日本語", "🎉", "ß", " ", " ", "\r\n", "!!", "...", "_", "\x00", "İ", "é", "x" * 1200, " " * 1100, "ab" * 700])


@settings(max_examples=300, deadline=None)
@given(text=st.one_of(st.text(max_size=200), st.lists(PIECES, max_size=12).map("".join)))
def test_ids_are_the_tokenizers(tokenizer, text):
    path, slow = tokenizer
    assert packing.token_ids(text, path).tolist() == slow.encode(text, add_special_tokens=False).ids


def test_a_special_token_in_a_text(tokenizer):
    path, slow = tokenizer
    assert packing.token_ids("a <|endoftext|> b", path).tolist() == slow.encode("a <|endoftext|> b", add_special_tokens=False).ids
    assert 50256 in packing.token_ids("a <|endoftext|> b", path)


# --- secrets


def _brute_links(text, scope=secrets.SCOPE):
    """The linked spans of a text by comparing every two parts."""
    find = lambda p, g=0, least=1: [m.span() for m in re.finditer(p, text, re.A) if len(m[g]) >= least]
    base = [*find(secrets.ASSIGN, 2, 6), *find(secrets.HEX)]
    access, named, endpoint, opaque = find(secrets.ACCESS), find(secrets.IDENTIFIER), find(secrets.ENDPOINT), find(secrets.OPAQUE)
    over = lambda x, others: any(a < x[1] and x[0] < b for a, b in others)
    first = base + access
    kept_e = [x for x in endpoint if not over(x, first)]
    kept_n = [x for x in named if not over(x, first + endpoint)]
    kept_o = [x for x in opaque if not over(x, first + endpoint + named)]
    near = lambda x, others: any(abs(x[0] - a) <= scope for a, _ in others)
    out = [("secret", *x) for x in kept_o if near(x, access) or (near(x, kept_n) and near(x, kept_e))]
    out += [("identifier", *x) for x in kept_n if near(x, base + kept_o) and near(x, kept_e)]
    return out, [("assign", *x) for x in find(secrets.ASSIGN, 2, 6)] + [("access", *x) for x in access] + [("hex", *x) for x in find(secrets.HEX)]


PARTS = ["user: alice", "login=bob.smith", "https://db.example.org/x", "https://cdn.example.com/assets/v2/abc123def456ghi789", "postgres://h/db?sig=Zm9vYmFyMTIzNDU2Nzg5", "Zm9vYmFyMTIzNDU2Nzg5MDEyMw==", "AKIA" + "ABCD" * 5, "password: hunter22", "0123456789abcdef01234567", "login: abcdef0123456789abcdefgh01", "plain words here", "x" * 30, "é" * 7, "word " * 90]


def test_links_against_brute_force(spark):
    rng = np.random.default_rng(7)
    texts = [" ".join(PARTS[k] for k in rng.integers(0, len(PARTS), rng.integers(1, 14))) for _ in range(300)]
    rows = {r.doc_id: r for r in secrets.find_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    linked = 0
    for d, text in enumerate(texts):
        found, base = _brute_links(text)
        linked += len(found)
        assert sorted(filter(None, rows[d].spans.split(","))) == sorted(f"{k}:{a}:{b}" for k, a, b in found + base)
        assert rows[d].n_linked == len(found)
    assert linked > 100


def test_no_part_is_its_own_complement(spark):
    texts = ["login: abcdef0123456789abcdefgh01 at https://db.example.org/x", "user: bob see https://cdn.example.com/assets/v2/abc123def456ghi789"]
    assert [r.n_linked for r in secrets.find_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()] == [0, 0]


def test_a_text_of_very_many_tokens(spark):
    """Time linear in the text: an access key and 100,000 tokens, found and masked."""
    key = "AKIA" + "ABCD" * 5
    text = key + " " + " ".join(f"tokenNumber{i:012d}" for i in range(100_000))
    docs = spark.createDataFrame([(1, text, len(text))], "doc_id long, text string, n_chars long")
    began = time.perf_counter()
    found = secrets.find_secrets(docs).first()
    took = time.perf_counter() - began
    assert found.n_access == 1 and 10 < found.n_linked < 30
    assert took < 30
    docs = spark.createDataFrame([(1, f"password=hunter{i:02d} " * 20_000, 0) for i in range(2)], "doc_id long, text string, n_chars long")
    began = time.perf_counter()
    hidden = secrets.masked(docs).collect()
    assert time.perf_counter() - began < 30
    assert {r.text for r in hidden} == {"<assign> " * 20_000} and {r.n_chars for r in hidden} == {9 * 20_000}


def test_masked_texts_against_brute_force(spark):
    rng = np.random.default_rng(8)
    texts = ["é" * 5000 + " ".join(PARTS[k] for k in rng.integers(0, len(PARTS), rng.integers(0, 12))) + "🎉" * 4100 for _ in range(60)]
    rows = {r.doc_id: r.text for r in secrets.masked(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    order = {k: i for i, k in enumerate(secrets.KINDS)}
    for d, text in enumerate(texts):
        found, base = _brute_links(text)
        out, at = "", 0
        for a, _, b, kind in sorted((a, order[k], b, k) for k, a, b in found + base):
            if a >= at:
                out += text[at:a] + f"<{kind}>"
            at = max(at, b)
        assert rows[d] == out + text[at:]


# --- mixing


def test_rates_come_as_close_as_rates_can(spark):
    """Targets that nonnegative rates can't reach: the miss against that of many plain projected gradient steps in numpy."""
    rng = np.random.default_rng(4)
    p = rng.dirichlet([2.0, 2.0, 0.5], 400)
    p[:, 2] = np.minimum(p[:, 2], 0.3)
    p /= p.sum(axis=1, keepdims=True)
    tokens = rng.integers(1, 200, 400)
    rows = spark.createDataFrame([(i, int(t), x.tolist()) for i, (t, x) in enumerate(zip(tokens, p, strict=True))], "doc_id long, tokens long, p array<double>")
    targets = np.array([0.05, 0.05, 0.9])
    a = tokens[:, None] * p
    for least in (0.0, 1.0):
        rated, totals = mixing.fit_rates(rows, targets.tolist(), least=least)
        r = np.array([x.rate for x in rated.orderBy("doc_id").collect()])
        assert np.allclose(r @ a, totals) and r.min() >= least
        start = a.sum(axis=0)
        wanted = targets * (tokens.sum() if least == 0 else max(start / targets))
        best, steepest = np.ones(400), np.linalg.eigvalsh(a.T @ a).max()
        for _ in range(10_000):
            best = np.maximum(least, best - a @ (best @ a - wanted) / steepest)
        miss, least_miss, first = (np.linalg.norm(x @ a - wanted) for x in (r, best, np.ones(400)))
        assert miss <= 1.03 * least_miss + mixing.TOLERANCE * wanted.sum() and least_miss < 0.9 * first


# --- media


def _colour_jpeg(rng, across, down, interval):
    """A 4:2:0 image of random coefficients by an encoder of its own, and the luminance DC terms: tables give 8-bit codes to
    every symbol in use."""
    categories = list(range(12))
    symbols = [0x00, 0xF0] + [run << 4 | size for run in range(16) for size in range(1, 6)]

    def table(kind, number, values):
        return bytes([kind << 4 | number]) + bytes([0] * 7 + [len(values)] + [0] * 8) + bytes(values)

    code = lambda values, s: f"{values.index(s):08b}"
    bits_of = lambda v: "" if v == 0 else f"{v if v > 0 else v + (1 << abs(v).bit_length()) - 1:0{abs(v).bit_length()}b}"
    luma = np.zeros((2 * down, 2 * across), int)
    scan, previous, bits = b"", [0, 0, 0], ""

    def flush(bits):
        bits += "1" * (-len(bits) % 8)
        return bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00")

    for m in range(across * down):
        if m and m % interval == 0:
            scan += flush(bits) + bytes([0xFF, 0xD0 + (m // interval - 1) % 8])
            bits, previous = "", [0, 0, 0]
        for c, blocks in ((0, 4), (1, 1), (2, 1)):
            for k in range(blocks):
                dc = int(rng.integers(-100, 100))
                if c == 0:
                    luma[2 * (m // across) + k // 2, 2 * (m % across) + k % 2] = dc
                diff, previous[c] = dc - previous[c], dc
                bits += code(categories, abs(diff).bit_length()) + bits_of(diff)
                at = 1
                while at < 64 and rng.random() < 0.8:
                    run = int(rng.integers(0, 20))
                    if at + run > 63:
                        break
                    while run > 15:
                        bits += code(symbols, 0xF0)
                        run, at = run - 16, at + 16
                    v = int(rng.choice([-31, -7, -1, 1, 2, 13]))
                    bits += code(symbols, run << 4 | abs(v).bit_length()) + bits_of(v)
                    at += run + 1
                if at < 64:
                    bits += code(symbols, 0x00)
    scan += flush(bits)
    part = lambda marker, body: b"\xff" + bytes([marker]) + struct.pack(">H", len(body) + 2) + body
    data = b"\xff\xd8" + part(0xE0, b"JFIF\x00") + part(0xDB, b"\x00" + bytes([16] + [9] * 63) + b"\x01" + bytes([5] * 64))
    data += part(0xC0, struct.pack(">BHHB", 8, 16 * down - 3, 16 * across - 5, 3) + b"\x01\x22\x00\x02\x11\x01\x03\x11\x01")
    data += part(0xC4, table(0, 0, categories) + table(1, 0, symbols)) + part(0xDD, struct.pack(">H", interval))
    data += part(0xDA, b"\x03\x01\x00\x02\x00\x03\x00\x00\x3f\x00") + scan + b"\xff\xd9"
    wanted = np.clip(np.rint(luma * 16 / 8.0) + 128, 0, 255).astype(np.uint8)
    return data, wanted[: -(-(16 * down - 3) // 8), : -(-(16 * across - 5) // 8)]


@pytest.mark.parametrize(("across", "down", "interval"), [(5, 4, 7), (1, 1, 1), (3, 6, 100)])
def test_a_colour_image_with_ac_terms(across, down, interval):
    data, wanted = _colour_jpeg(np.random.default_rng(across), across, down, interval)
    (thumb,) = jpeg.thumbnails([(data, jpeg.parse(data))])
    assert (thumb == wanted).all()
    (row,) = media.read_images([data])
    assert (row["status"], row["width"], row["height"]) == ("ok", 16 * across - 5, 16 * down - 3)


def test_damaged_images_are_bad_and_leave_others_alone():
    good = jpeg.encode([b"ab" * 96])[0]
    at = good.index(b"\xff\xc4")
    short = good[:at] + b"\xff\xc4" + struct.pack(">H", 2 + 17 + 3) + b"\x00" + jpeg.DC_BITS + jpeg.DC_VALUES[:3] + good[at + 4 + 17 + 12 :]
    overfull = good[: at + 5] + bytes([3]) + good[at + 6 :]
    frame = good.index(b"\xff\xc0")
    zero = good[: frame + 11] + b"\x00" + good[frame + 12 :]
    huge = good[: frame + 5] + b"\xff\xff\xff\xff" + good[frame + 9 :]
    rows = media.read_images([good, short, None, overfull, zero, huge, good[:-30], b"", good])
    assert [r["status"] for r in rows] == ["ok", "bad", "null", "bad", "bad", "bad", "bad", "bad", "ok"]


# --- near duplicates


def test_links_of_embeddings_against_brute_force(spark):
    """Crowds of near copies, exact copies and strangers: counts and components by all cosines."""
    rng = np.random.default_rng(6)
    x = np.concatenate([np.repeat(rng.standard_normal((6, 24)), 40, axis=0) + 0.25 * rng.standard_normal((240, 24)), rng.standard_normal((200, 24)), np.repeat(rng.standard_normal((1, 24)), 30, axis=0)])
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    found = {r.vec_id: r for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert [found[i].n_links for i in range(len(x))] == near.sum(axis=1).tolist()
    least = list(range(len(x)))
    for _ in range(len(x)):
        new = [min([least[i], *(least[j] for j in np.flatnonzero(near[i]))]) for i in range(len(x))]
        if new == least:
            break
        least = new
    assert [found[i].component_id for i in range(len(x))] == least


def test_near_duplicates_of_one_template(spark):
    """4,000 texts of one template, five of 300 words altered in each, each fifth with one true partner: recall of its links."""
    rng = np.random.default_rng(9)
    base = [f"w{x}" for x in rng.integers(0, 5000, 300)]
    texts = []
    for i in range(4000):
        words = list(base)
        # Far from the others: a tenth of the words; a partner differs from its own in five.
        for at in rng.choice(300, 30, replace=False):
            words[at] = f"n{i}x{at}"
        texts.append(words)
        if i % 5 == 0:
            twin = list(words)
            for at in rng.choice(300, 5, replace=False):
                twin[at] = f"t{i}x{at}"
            texts.append(twin)
    shingle = lambda w: {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    rows = [(i, " ".join(w)) for i, w in enumerate(texts)]
    found = {r.doc_id: r.component for r in simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).collect()}
    true = kept = at = 0
    for i in range(4000):
        if i % 5 == 0:
            a, b = shingle(texts[at]), shingle(texts[at + 1])
            if len(a & b) >= 0.8 * len(a | b):
                true += 1
                kept += found[at] == found[at + 1]
            at += 1
        at += 1
    assert true > 300 and kept == true


def test_near_duplicate_stage_finds_every_link_at_sf01(spark):
    """All links of five-word Jaccard similarity 0.8 or more between different texts of a larger table, by counting what texts
    share, shingle by shingle."""
    rows = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text").collect()
    sets, node = {}, {}
    for r in rows:
        key = b" ".join((r.text or "").encode().lower().split())
        node[r.doc_id] = key
        if key not in sets:
            sets[key] = simhash.shingles((r.text or "").encode())
    names, found = list(sets), list(sets.values())
    size = np.array([len(x) for x in found])
    shingle, owner = np.concatenate(found), np.repeat(np.arange(len(found)), size)
    order = np.lexsort((owner, shingle))
    shingle, owner = shingle[order], owner[order]
    cuts = np.append(np.flatnonzero(np.append(True, shingle[1:] != shingle[:-1])), len(shingle))
    pairs = []
    for low, high in zip(cuts, cuts[1:], strict=False):
        if high - low > 1:
            i, j = np.triu_indices(high - low, 1)
            pairs.append(owner[low:high][i] * len(names) + owner[low:high][j])
    key, shared = np.unique(np.concatenate(pairs), return_counts=True)
    a, b = key // len(names), key % len(names)
    linked = shared >= 0.8 * (size[a] + size[b] - shared)
    parent = list(range(len(names)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, y in zip(a[linked].tolist(), b[linked].tolist(), strict=True):
        x, y = top(x), top(y)
        parent[max(x, y)] = min(x, y)
    wanted = {n: top(i) for i, n in enumerate(names)}
    groups = {}
    for r in simhash.similar_groups(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")).collect():
        assert groups.setdefault(wanted[node[r.doc_id]], r.component) == r.component
    assert len(set(groups.values())) == len(set(wanted.values())) and linked.sum() > 20
