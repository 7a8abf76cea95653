"""Each operator against a brute-force version, and on nulls, empty and very long texts, ties, repeats, empty tables and clashing columns."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pulsespark.llm import bpe, common, embedding_dedup, exact_dedup, html_extract, lm, minhash, packing, pii, registry, sharding, toxicity

LONG = " ".join(f"word{i % 700}" for i in range(30_000))
TEXTS = [
    "The quick brown fox", "the quick  brown\nfox", "The quick brown fox", "", None, "   \n", "one", "One", "é ü 日本 😀 x", LONG, LONG + " tail", "a b", "b a", "a\tb",
    "mail joe@example.com or +1 (523) 555-1055", "You worthless idiot", "You worthless moron!",
]


@pytest.fixture(scope="module")
def docs(spark):
    """Ids with a null and a repeat; columns that clash with names used inside."""
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "no id"), (0, TEXTS[0])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.select("doc_id", "text", *(F.lit(7).alias(c) for c in ("digest", "key", "rep", "bands", "n", "base", "spans", "length", "sub", "score", "terms", "label", "lang")))


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, digest int")


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


# ---- toxicity -------------------------------------------------------------------------------------------------------
def test_toxicity_learns_words_and_pairs(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("aeiourstln") for _ in range(7))
    rows = []
    for i in range(1200):
        kind, ws = i % 6, [word() for _ in range(40)]
        ws += {0: ["vileword"], 1: ["groupname", "insultish"], 2: ["groupname"], 3: ["insultish"]}.get(kind, [])
        rng.shuffle(ws)
        rows.append((i, " ".join(ws), int(kind < 2)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    machine = toxicity.train(df, df.select("doc_id", "toxic"))
    got = {r.doc_id: r.score for r in toxicity.score(df, machine).collect()}
    right = [(got[i] >= 0.5) == bool(y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean(right) > 0.95


def test_toxicity_learns_what_only_a_pair_tells(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("aeiourstln") for _ in range(7))
    rows = []
    for i in range(1500):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        ws = [word() for _ in range(40)] + ["groupname"] * a + ["insultish"] * b
        rng.shuffle(ws)
        rows.append((i, " ".join(ws), int(a != b)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    machine = toxicity.train(df, df.select("doc_id", "toxic"))
    held = [(i, y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    right = lambda m: np.mean([(got[i] >= 0.5) == bool(y) for got in [{r.doc_id: r.score for r in toxicity.score(df, m).collect()}] for i, y in held])
    assert right(machine) > 0.9
    linear = toxicity.Machine(machine.bias, machine.weights, np.zeros_like(machine.factors))
    assert right(linear) < 0.8


def test_toxicity_pair_sum():
    rng = np.random.default_rng(3)
    m = toxicity.Machine(0.3, rng.standard_normal(1 << toxicity.BITS), rng.standard_normal((1 << toxicity.BITS, toxicity.FACTORS)))
    sets = [np.unique(rng.integers(0, 1 << toxicity.BITS, n)) for n in (0, 1, 2, 40)]
    got = m.raw(np.repeat(np.arange(4), [len(s) for s in sets]), np.concatenate(sets), 4)
    for s, g in zip(sets, got):
        brute = 0.3 + sum(m.weights[i] for i in s) + sum(m.factors[i] @ m.factors[j] for k, i in enumerate(s) for j in s[:k])
        assert g == pytest.approx(brute)


def test_toxicity_edges(spark, docs):
    labels = spark.createDataFrame([(15, 1), (16, 1), (1, 0), (None, 1), (2, None)], "doc_id long, toxic int")
    got = toxicity.score(docs, toxicity.train(docs, labels)).collect()
    assert len(got) == len(TEXTS) + 2 and all(0 <= r.score <= 1 for r in got)
    blank = toxicity.train(docs, labels.limit(0))
    assert all(r.score < 0.5 for r in toxicity.score(docs, blank).collect())
    assert toxicity.score(empty(spark), blank).count() == 0
    kept = toxicity.filtered(docs, blank)
    assert kept.columns == docs.columns and kept.count() == len(TEXTS) + 2


# ---- BPE ------------------------------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def byte_bpe():
    tokenizers, public = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    path = public.path("byte_bpe_50k.json")
    return path, tokenizers.Tokenizer.from_file(path)


def test_bpe_equals_the_library(byte_bpe):
    path, library = byte_bpe
    rng = random.Random(3)
    texts = [t or "" for t in TEXTS] + ["a <|endoftext|> b<|endoftext|>", " " * 60 + "x", "x" + " " * 60, "it's 'S ''re\n\n\tz ", "y" * 5000, "\x1c \x85 　"]
    texts += ["".join(rng.choice("ab  \n\t'sdlétion<|>endftxhe. 1²日") for _ in range(rng.randint(1, 40))) for _ in range(1500)]
    enc = bpe.TextEncoder(open(path, encoding="utf-8").read())
    for text, got in zip(texts, enc.encode(texts)):
        ids = [i for s in got for i in s]
        assert ids == library.encode(text, add_special_tokens=False).ids
        assert enc.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_bpe_tables(spark, docs, byte_bpe):
    path, library = byte_bpe
    ids = bpe.encode(docs, path)
    back = {(r.doc_id, r.text) for r in bpe.decode(ids, path).collect()}
    assert back == {(i, t or "") for i, t in enumerate(TEXTS)} | {(None, "no id")}
    got = {r.doc_id: r for r in bpe.round_trip(docs, path).collect()}
    for i, t in enumerate(TEXTS):
        want = library.encode(t or "", add_special_tokens=False).ids
        assert got[i].n_tokens == len(want) and got[i].ids_sha256 == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.round_trip(empty(spark), path).count() == bpe.encode(empty(spark), path).count() == 0


# ---- PII ------------------------------------------------------------------------------------------------------------
def plain_spans(t):
    digits = lambda v: re.sub("[^0-9]", "", v)
    rules = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v: all(int(x) <= 255 for x in v.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda v: 16 <= len(digits(v)) <= 19 and pii._luhn(digits(v))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: 8 <= len(digits(v)) <= 15),
    )
    return [(k, m.start(), m.end()) for k, p, ok in rules for m in re.finditer(p, t) if ok(m[0])]


def test_pii_base_spans(spark):
    rng = random.Random(5)
    texts = ["a@b.co_x@d.com a@b.c@d.e 😀a@b.c. 1.2.3.4.5.6.7.8 0001.02.3.255 256.1.1.1", "4539 1488 0343 6467 4539-1488-0343-6467x", "9" * 30_000, "a" * 30_000, "1 " * 9000, "x@" * 900, "", None]
    texts += ["".join(rng.choice("a1.@+ -()23456789_b😀") for _ in range(rng.randint(1, 60))) for _ in range(1200)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.find(df).collect():
        assert [(s.kind, s.start, s.end) for s in r.base] == plain_spans(texts[r.doc_id] or "")
        assert all(r.text[s.start : s.end] == s.value for s in r.spans)
        assert {(s.kind, s.start) for s in r.base} <= {(s.kind, s.start) for s in r.spans}


def test_pii_of_many_spans(spark):
    text = " ".join(f"u{i}@ex.com call (415) 555-{i:04}" for i in range(4000))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    row = pii.find(df).first()
    assert [(s.kind, s.start, s.end) for s in row.base] == plain_spans(text)
    phones = [(m.start(), m.end()) for m in re.finditer(r"\([0-9]{3}\) [0-9]{3}-[0-9]{4}", text)]
    assert [(s.start, s.end) for s in row.spans if s.kind == "phone"] == phones
    assert pii.redact(df).first().text == " ".join(["[EMAIL] call [PHONE]"] * 4000)


def test_pii_candidates_and_redaction(spark, docs):
    text = "call (415) 555-0137 now, ref 415 555 0137, mail me: joe (at) example dot com, amex 378282246310005 ok 1.2.3.4"
    df = spark.createDataFrame([(1, text, 9)], "doc_id long, text string, n_chars long")
    row = pii.find(df).first()
    assert {(s.kind, s.value) for s in row.spans} >= {("phone", "(415) 555-0137"), ("email", "joe (at) example dot com"), ("ip", "1.2.3.4")}
    assert "415 555 0137" not in {s.value for s in row.spans}
    out = pii.redact(df).first()
    assert out.text.startswith("call [PHONE] now, ref 415 555 0137,") and out.text.endswith("[IP]") and out.n_chars == len(out.text)
    # what is said elsewhere in a text has no part in whether a span is proposed, nor has the length of a host
    host = "a-rather-long-host-name-of-more-than-forty-letters.com"
    lines = ["write to jane at example.com", "write to jane at example.com . price (at) cost", f"write to jane at {host}", "we shop at example.com today", "look at home.the door"]
    found = {r.doc_id: [s.value for s in r.spans] for r in pii.find(spark.createDataFrame(list(enumerate(lines)), "doc_id int, text string")).collect()}
    assert found == {0: ["jane at example.com"], 1: ["jane at example.com"], 2: [f"jane at {host}"], 3: [], 4: []}
    again = pii.redact(docs)
    assert again.columns == docs.columns and again.where("text is null").count() == 1
    assert pii.find(empty(spark)).count() == 0


# ---- LM -------------------------------------------------------------------------------------------------------------
def test_elias_fano():
    rng = np.random.default_rng(1)
    for n, top in ((0, 10), (1, 5), (500, 700), (2000, 2**62)):
        values = np.unique(rng.integers(0, top, n)).astype(np.uint64)
        ef, _ = lm.EliasFano.view(lm.EliasFano.encode(values), 0)
        asked = np.concatenate([values, rng.integers(0, top, 300).astype(np.uint64)])
        where = {int(v): i for i, v in enumerate(values)}
        assert ef.find(asked).tolist() == [where.get(int(a), -1) for a in asked]
        assert ef.get(np.arange(len(values))).tolist() == values.tolist()
        lo, hi = np.full(len(asked), len(values) // 3), np.full(len(asked), len(values) // 2)
        assert ef.find(asked, lo, hi).tolist() == [i if len(values) // 3 <= (i := where.get(int(a), -1)) < len(values) // 2 else -1 for a in asked]


def test_trie_searches_between_pointers():
    rng = np.random.default_rng(2)
    seen = {(int(rng.integers(3, 60)) << 40, int(rng.integers(0, 2**40))) for _ in range(3000)} | {(5 << 40, 7), (6 << 40, 7), (6 << 40, 2**40 - 1)}
    u, w = (np.array(x, np.uint64) for x in zip(*sorted(seen)))
    count = rng.integers(1, 500, len(u)).astype(float)
    trie = lm.Trie(u, w, count)
    assert trie.pointers.get(np.arange(trie.pointers.n)).tolist() == [*np.unique(u, return_index=True)[1].tolist(), len(u)]
    asked = sorted({(int(a), int(b)) for a, b in seen} | {(int(a) + (1 << 40), int(b)) for a, b in list(seen)[::3]} | {(1, 7), (2**61, 7)})
    contexts, runs = np.unique([a for a, _ in asked], return_counts=True)
    want = dict(zip(sorted(seen), lm.quantise(count - lm.D).tolist()))
    got = trie.query(contexts.astype(np.uint64), runs, np.array([b for _, b in asked], np.uint64))
    assert got.tolist() == [want.get(a, 0) for a in asked]
    assert lm.Trie(u[:0], w[:0], count[:0]).query(u[:1], np.array([1]), w[:1]).tolist() == [0]


def test_lm_equals_counting(spark):
    rng = random.Random(8)
    texts = {i: " ".join(rng.choice(("The", "the", "cat", "dog", "sat", "on", f"w{rng.randrange(40)}")) for _ in range(rng.randrange(30))) for i in range(150)} | {900: None, 901: LONG}
    df = spark.createDataFrame(list(texts.items()) + [(None, "the cat")], "doc_id long, text string").withColumn("train", F.lit("x"))
    split = lambda t: (t or "").encode().lower().split() + ["end"]
    rows = [(i, split(t), zlib.crc32(str(i).encode()) % 10 == 0) for i, t in texts.items()] + [(None, split("the cat"), True)]  # crc32 of nothing is 0
    c, bi, ctx, n1 = Counter(), Counter(), Counter(), Counter()
    for _, ws, held in rows:
        if not held:
            c.update(ws)
            bi.update(zip(["begin", *ws], ws))
            ctx.update(["begin", *ws[:-1]])
    for u, _ in bi:
        n1[u] += 1
    total, distinct = sum(c.values()), len(c)
    got = {r.doc_id: r for r in lm.score(df).collect()}
    assert len(got) == len(rows)
    for i, ws, held in rows:
        p1 = {w: (c[w] + 0.1) / (total + 0.1 * (distinct + 1)) for w in ws}
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, len(ws), sum(c[w] > 0 for w in ws), total)
        assert r.base_score == pytest.approx(sum(math.log10(p1[w]) for w in ws))
        model = sum(math.log10((max(bi[u, w] - lm.D, 0) + lm.D * n1[u] * p1[w]) / ctx[u] if ctx[u] else p1[w]) for u, w in zip(["begin", *ws], ws))
        assert abs(r.score - model) <= 0.0201 * len(ws)
    assert lm.score(empty(spark)).count() == 0


# ---- near and exact dedup -------------------------------------------------------------------------------------------
def brute_components(sets, percent):
    ids = list(sets)
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, i in enumerate(ids):
        for j in ids[:k]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                p, q = sorted((root(i), root(j)))
                parent[q] = p
    return {i: root(i) for i in ids}


@pytest.mark.parametrize("size", [2, 5])
def test_minhash_equals_brute_force(spark, size):
    rng = random.Random(6)
    texts, i = {}, 0
    for _ in range(8):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.choice((6, 60, 150)))]
        for _ in range(rng.randint(1, 25)):
            copy = list(base)
            for _ in range(rng.randrange(1 + len(base) // 12)):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(10**6)}"
            texts[i] = " ".join(copy)
            i += 1
    texts |= {i + k: t for k, t in enumerate(["", None, " ", "single", "Single", "two words", LONG, LONG])}
    df = spark.createDataFrame(list(texts.items()) + [(0, texts[0]), (None, "none")], "doc_id long, text string").withColumn("key", F.lit(1))
    sets = {k: minhash.shingles(minhash.words(t or ""), size) for k, t in texts.items()}
    want = brute_components(sets, 80)
    rows = minhash.near_duplicates(df, size).collect()
    assert len(rows) == len(texts) + 2
    for r in rows:
        if r.doc_id is None:
            assert r.component_id is None and not r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), want[r.doc_id], want[r.doc_id] == r.doc_id)
    assert minhash.near_duplicates(empty(spark)).count() == 0


def brute_by_id(rows, size):
    """Component of each id, ids that repeat being one document with several texts."""
    sets = {k: minhash.shingles(minhash.words(t or ""), size) for k, (_, t) in enumerate(rows)}
    parent = {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, _) in enumerate(rows):
        for m, (j, _) in enumerate(rows[:k]):
            a, b = sets[k], sets[m]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                p, q = sorted((root(i), root(j)))
                parent[q] = p
    return {i: root(i) for i, _ in rows}


def test_minhash_with_repeated_ids(spark):
    rng = random.Random(4)
    base, other, third = ([f"{c}{rng.randrange(9999)}" for _ in range(60)] for c in "bot")
    rows = [(5, base), (5, other), (6, [*base, "x"]), (7, [*other, "y"]), (8, third), (9, [*third, "z"]), (9, []), (10, third), (11, ["lone"])]
    rows = [(i, " ".join(ws)) for i, ws in rows]
    want = brute_by_id(rows, 2)
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()
    assert len(got) == len(rows)
    for r in got:
        component = want[r.doc_id] if r.n_shingles else r.doc_id
        assert (r.component_id, r.kept) == (component, component == r.doc_id)
    assert want[7] == 5


def test_minhash_of_a_group_at_the_threshold(spark, monkeypatch):
    """A large component, and many that are nearly similar enough to it and to each other; some of them are, to a few."""
    rng = random.Random(9)
    base, texts = [f"w{i}" for i in range(80)], {}
    for i in range(260):
        copy = list(base)
        for k in rng.sample(range(80), rng.choice((1, 2, 5, 6, 7, 8))):
            copy[k] = f"x{rng.randrange(40)}"
        texts[i] = " ".join(copy)
    monkeypatch.setattr(minhash, "FIRST", 1)
    monkeypatch.setattr(minhash, "BLOCK", 40)  # several blocks
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = brute_components({k: minhash.shingles(minhash.words(t), 2) for k, t in texts.items()}, 80)
    assert len(set(want.values())) > 20
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(df, 2).collect()} == want


@pytest.mark.parametrize("size", [1, 2, 5])
def test_full_sets(size):
    rng = random.Random(3)
    texts = [" ".join(rng.choice("abcd") for _ in range(rng.randrange(9))) for _ in range(60)]
    numbers, at = minhash.full_sets(pa.array(texts, pa.large_string()), size)
    sets, mine = [minhash.shingles(minhash.words(t), size) for t in texts], [set(numbers[i:j].tolist()) for i, j in zip(at, at[1:])]
    for i in range(len(texts)):
        assert len(mine[i]) == len(sets[i])
        assert all(len(mine[i] & mine[j]) == len(sets[i] & sets[j]) for j in range(i))


def test_registers_estimate_similarity():
    rng = np.random.default_rng(2)
    for shared in (0, 500, 900):
        a = rng.integers(0, 2**63, 1000).astype(np.uint64)
        b = np.concatenate([a[:shared], rng.integers(0, 2**63, 1000 - shared).astype(np.uint64)])
        r = minhash.registers([np.unique(a), np.unique(b), np.unique(np.concatenate([a, b]))])
        assert (np.maximum(r[0], r[1]) == r[2]).all()  # mergeable
        want = shared / (2000 - shared)
        assert abs(minhash.likelihood(r[:1], r[1:2], np.array([1000.0]), np.array([1000.0]))[0] - want) < 0.12


def test_fuse_filter_never_misses():
    rng = np.random.default_rng(4)
    for n in (1, 2, 7, 100, 5000):
        keys = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        built = exact_dedup.fuse_build(keys)
        assert exact_dedup.fuse_contains(keys, *built).all()
        assert exact_dedup.fuse_contains(rng.integers(0, 2**63, 20_000).astype(np.uint64), *built).mean() < 0.002


@pytest.mark.parametrize("weak", [False, True])
def test_exact_dedup(spark, docs, weak):
    how = (lambda t: F.format_string("%016x", F.crc32(t.cast("binary")) % 3)) if weak else exact_dedup.sha256  # colliding digests
    rows = [(i, norm(t)) for i, t in enumerate(TEXTS)] + [(None, "no id"), (0, norm(TEXTS[0]))]
    got = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_groups(docs, how).collect()), key=str)
    want = []
    for i, t in rows:
        same = [j for j, u in rows if u == t]
        keep = min((j for j in same if j is not None), default=None)
        want.append((i, keep, len(same), i is not None and i == keep, hashlib.sha256(t.encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert exact_dedup.exact_groups(empty(spark)).count() == 0


# ---- packing and sharding -------------------------------------------------------------------------------------------
def test_packing(spark, docs):
    tokenizers, public = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    path = public.path("word_bpe_49k.json")
    library = tokenizers.Tokenizer.from_file(path)
    rows = packing.pack(docs, path).collect()
    seen = {}
    for r in rows:
        seen.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert 0 < r.length <= 4096
    for parts in seen.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    for i, t in enumerate(TEXTS):
        ids = library.encode(t or "", add_special_tokens=False).ids + [2]
        mine = sorted((r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows if r.doc_id == i)
        for start, length, crc, n in mine:
            assert n == len(ids) and crc == zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes())
        assert sum(m[1] for m in mine) == len(ids) * (2 if i == 0 else 1)
    assert packing.pack(empty(spark), path).count() == 0


def test_packing_stretches_equal_the_library():
    tokenizers, public = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    text = open(public.path("word_bpe_49k.json"), encoding="utf-8").read()
    enc, library = packing.StretchEncoder(text), tokenizers.Tokenizer.from_str(text)
    hard = ["AB<|ENDOFTEXT|>c, x,.\"<|endoftext|>, y*** z&&&,", "É, á e\ńx İI ΑΣ ὈΔΥΣΣΕΎΣ", "\x1c a\x1fb don't i've 12ab½ 日本  ﬁ ǅ 's. d'", "", "..."]
    for t, got in zip(hard, enc.encode(hard)):
        assert np.frombuffer(got, "<u4").tolist() == library.encode(t, add_special_tokens=False).ids


def test_histogram_packing_places_every_length_once():
    rng = random.Random(7)
    histogram = dict(Counter(rng.choice((4096, 1, 2, 4000)) if rng.random() < 0.3 else rng.randint(1, 4096) for _ in range(5000)))
    patterns = packing.pack_histogram(histogram)
    placed = Counter()
    for count, pattern in patterns:
        assert sum(length * times for length, times in pattern) <= 4096
        for length, times in pattern:
            placed[length] += count * times
    assert placed == Counter(histogram)
    used = sum(k * v for k, v in histogram.items())
    assert used / (4096 * sum(c for c, _ in patterns)) > 0.98
    assert packing.pack_histogram({}) == []


def test_sharding(spark, docs):
    rows = sharding.shard(docs).collect()
    assert len(rows) == len(TEXTS) + 2
    for r in rows:
        assert r.grown_shard in (r.shard, 16) and 0 <= r.shard < 16
        if r.doc_id is not None:
            t = TEXTS[r.doc_id] or ""
            assert (r.size, r.text_crc32) == (len(t.encode()) + 1, zlib.crc32(t.encode()))
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    many = spark.range(6000).select(F.col("id").alias("doc_id"), F.lit("").alias("text"))
    weighted = Counter(r.shard for r in sharding.shard(many, (1.0, 1.0, 2.0)).collect())
    assert abs(weighted[2] / 6000 - 0.5) < 0.03
    assert sharding.shard(empty(spark)).count() == 0
    with pytest.raises(ValueError):
        sharding.rendezvous(F.col("x"), (1.0, 0.0))


# ---- HTML -----------------------------------------------------------------------------------------------------------
def test_html_held_out_blocks():
    x, y = html_extract.labelled_blocks(120, seed=77)
    assert (html_extract.is_main(x) == (y == 1)).mean() > 0.97


def test_html_tree_uses_links_and_neighbours():
    def split(node):
        return set() if isinstance(node, float) else {html_extract.FEATURES[node[0]]} | split(node[2]) | split(node[3])

    used = split(html_extract.tree())
    assert "links" in used and used & {"words_before", "links_before", "words_after", "links_after"}


@pytest.mark.parametrize("n", [10, 45, 200])
def test_html_drops_long_boilerplate(n):
    say = " ".join(["word"] * n)
    article = "<article><div class='entry-header'><h1>Head line</h1></div>" + f"<p>{' '.join(['text'] * 40)}</p>" * 4 + "</article>"
    want = "\n".join(["Head line", *[" ".join(["text"] * 40)] * 4])
    links = "".join(f"<li><a href='/'>{' '.join(['word'] * 5)}</a></li>" for _ in range(n // 5 + 1))
    for other in (
        f"<footer>{say}</footer>", f"<aside><p>{say}</p></aside>", f"<nav><a>{say}</a></nav>", f"<div class='comments'><p>{say}</p></div>", f"<p class=comment>{say}</p>",
        f"<div class='cookie-notice'>{say}</div>", f"<div hidden>{say}</div>", f"<div style='display: none'><p>{say}</p></div>", f"<ul>{links}</ul>", f"<div class=\"share-bar\">{say}</div>",
    ):
        for page in (other + article, article + other, article.replace("</article>", other + "</article>")):
            assert html_extract.main_text(f"<html><body class='page-with-sidebar'>{page}</body></html>") == want


def test_html_takes_time_in_the_length():
    for part in ("<a x ", '<a x="', "<!", "<div>", "</div>", '<p "', "<script>", "<div><p>"):
        began = time.perf_counter()
        html_extract.main_text(part * (1_000_000 // len(part)))
        assert time.perf_counter() - began < 3


def test_html_pages(spark):
    page = (
        "<html><head><title>t</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav><ul><li><a href='/a'>menu</a></li></ul></nav><div class=\"ad\">Buy now please.</div>"
        "<article><header><h1>Head &amp; line</h1></header><p>One  <b>bo</b>ld&nbsp;word<br>more<script>var a='</p>';</script></p><p>Two<p>Three</p>"
        "<section class='comments'><p>Nice one, dear author of this text</p></section></article><aside>side bar text</aside><form>Sign up <input></form><footer>&copy; x</footer></body></html>"
    )
    assert html_extract.main_text(page) == "Head & line\nOne bold word more\nTwo\nThree"
    long = "<article>" + "<p>alpha beta gamma</p>" * 20_000 + "</article>"
    rows = [(1, "u", page), (2, None, None), (None, "v", ""), (4, "w", "<p <b>broken"), (5, "x", long), (5, "x", long), (6, "y", "no tags at all")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = html_extract.extract(df).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    assert [r.text.count("\n") for r in got if r.page_id == 5] == [19_999] * 2
    assert html_extract.extract(df.limit(0)).count() == 0


def test_html_names_behind_long_attributes():
    long = "x hidden " * 80
    text = " ".join(["word"] * 60)
    for name, sign in (("comments", -1), ("article-body", 1)):
        for around in (f'data-config="{long}" class="{name}"', f"class='{name}' data-config='{long}'"):
            (block,) = html_extract.blocks(f"<div {around}><p>{text}</p></div>")
            assert (block.inner, block.bad_around, block.good_around) == (sign, int(sign < 0), int(sign > 0))
    assert html_extract.blocks(f"<div style='color:{long};display: none'><p>{text}</p></div>")[0].inner == -1


# ---- embeddings -----------------------------------------------------------------------------------------------------
def test_embeddings_against_brute_force(spark):
    rng = np.random.default_rng(12)
    vecs = list(rng.standard_normal((600, 32)))
    for k in range(120):
        vecs.append(vecs[k % 40] + rng.standard_normal(32) * rng.choice((0.02, 0.3, 0.45)))
    x = np.array(vecs)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = unit @ unit.T >= 0.9
    np.fill_diagonal(links, False)
    odd = [(9000, None), (9001, [0.0] * 32), (9002, [float("nan")] + [1.0] * 31), (9003, []), (9004, [None] + [1.0] * 31), (None, [1.0] * 32), (9005, [float("inf")] + [1.0] * 31)]
    rows = [(i, v.tolist()) for i, v in enumerate(vecs)] + odd + [(0, vecs[0].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("label", F.lit(1)).withColumn("unit", F.lit(2))
    got = embedding_dedup.near_duplicates(df).collect()
    assert len(got) == len(rows)
    mine = {r.vec_id: r for r in got}
    found = sum(mine[i].n_links for i in range(len(vecs)))
    assert found >= 0.97 * links.sum() and all(mine[i].n_links <= links[i].sum() for i in range(len(vecs)))
    for i, _ in odd:
        assert mine[i].n_links == 0 and mine[i].component_id == i
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_embeddings_with_a_hot_vector(spark):
    rng = np.random.default_rng(5)
    hot = rng.standard_normal(16)
    vecs = [hot] * 300 + [2 * hot] * 100 + [hot + 0.1 * rng.standard_normal(16) for _ in range(20)] + list(rng.standard_normal((40, 16))) + [rng.standard_normal(16)] * 2
    unit = np.array(vecs) / np.linalg.norm(vecs, axis=1, keepdims=True)
    links = unit @ unit.T >= 0.9
    df = spark.createDataFrame([(i + 7, x.tolist()) for i, x in enumerate(vecs)], "vec_id long, embedding array<double>").withColumn("n", F.lit(3))
    for r in embedding_dedup.near_duplicates(df).collect():
        assert (r.n_links, r.component_id) == (links[r.vec_id - 7].sum() - 1, 7 + int(np.flatnonzero(links[r.vec_id - 7])[0]))


def dense_vectors(n=1500, pairs=60, close=0.8, seed=3):
    """Rows around one direction with a mutual cosine of about `close`, and pairs among them at 0.90 to 0.92."""
    rng = np.random.default_rng(seed)
    unit = lambda m: m / np.linalg.norm(m, axis=-1, keepdims=True)
    center = unit(rng.standard_normal(64))
    side = rng.standard_normal((n, 64))
    base = unit(np.sqrt(close) * center + np.sqrt(1 - close) * unit(side - (side @ center)[:, None] * center))
    way = rng.standard_normal((pairs, 64))
    way = unit(way - (way * base[:pairs]).sum(1)[:, None] * base[:pairs])
    c = rng.uniform(0.9, 0.92, pairs)[:, None]
    return np.vstack([base, c * base[:pairs] + np.sqrt(1 - c * c) * way])


def test_embeddings_of_a_dense_group(spark, monkeypatch):
    v = dense_vectors()
    links = v @ v.T >= 0.9
    label = np.arange(len(v))
    for _ in range(len(v)):
        following = np.where(links, label[None], len(v)).min(1)
        if (following == label).all():
            break
        label = following
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    monkeypatch.setattr(embedding_dedup, "SWEEP", 200_000)  # several parts
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(df, passes=2, window=4).collect()}
    assert got == {i: (int(links[i].sum()) - 1, int(label[i])) for i in range(len(v))}


@pytest.mark.parametrize("part", [50, 400_000])
def test_components(spark, part):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1200)] + [(2000, j) for j in range(2001, 2300)]
    parent = {n: n for e in edges for n in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        p, q = sorted((root(a), root(b)))
        parent[q] = p
    got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long"), part=part).collect()}
    assert got == {n: root(n) for e in edges if e[0] != e[1] for n in e}


def test_registry_names():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 11))
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES)
