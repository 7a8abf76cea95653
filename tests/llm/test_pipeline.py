"""The pipeline and each of its stages against a plain version, on nulls, empty texts, ties, repeats, clashing columns and nothing."""

import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pulsespark.llm import minhash, packing, pii, toxicity

public = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")
CLASHES = ("digest", "key", "rid", "band", "kept", "keep_id", "component", "score", "spans", "length", "start", "label", "terms", "chunk", "_sha256", "n_shingles")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def texts():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("aeiourstln") for _ in range(6))
    prose = lambda n: " ".join(word() for _ in range(n))
    rows, labels = [], []
    for i in range(300):  # a third of them toxic
        rows.append((i, prose(30) + (" vileword" if i % 3 == 0 else "")))
        labels.append((i, int(i % 3 == 0)))
    base = prose(120).split()
    near = [" ".join(base[:k] + ["other"] + base[k + 1 :]) for k in (3, 60, 119)]
    chain = prose(100).split()
    rows += [(1000, " ".join(base)), *((1001 + k, t) for k, t in enumerate(near)), (999, " ".join(base) + "\n"), (1004, "  ".join(base))]
    rows += [(1010, " ".join(chain)), (1011, " ".join(chain[:90])), (1012, " ".join(chain[:81]))]  # similar to the next one only
    rows += [(1020, None), (1021, ""), (1022, " \n"), (1022, " \n"), (None, "nobody's text"), (None, "nobody's text"), (None, None)]
    rows += [(1030, " ".join(base)), (1030, prose(40)), (1031, "tie"), (1031, "tie")]  # an id with a copy and a text of its own
    rows += [(1040, "write to joe@example.com or call +1 (523) 555-1055 soon"), (1041, " ".join(f"w{i % 900}" for i in range(9000)))]
    return rows, labels


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("pipeline"))
    rows, labels = texts()
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)
    docs = docs.select("*", *(F.lit(7).alias(c) for c in CLASHES))
    docs.repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def pairs(df):
    return sorted(((r.doc_id, r.text) for r in df.select("doc_id", "text").collect()), key=str)


def plain_toxicity(spark, rows, folder):
    machine = toxicity.train(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))

    def score(text):
        terms = sorted({t for w in re.split(r"[\x20\x09-\x0D]+", text or "") for t in toxicity.Terms()._of(w.encode())})
        return machine.bias + sum(machine.weights[t] for t in terms) + sum(machine.factors[a] @ machine.factors[b] for k, a in enumerate(terms) for b in terms[:k])

    return [(i, t) for i, t in rows if score(t) < 0]


def plain_copies(rows):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    least = {}
    for i, t in rows:
        if i is not None:
            least[norm(t)] = min(i, least.get(norm(t), i))
    return [(i, t) for i, t in rows if i is None or least[norm(t)] == i]


def plain_near(rows):
    sets = [minhash.shingles(minhash.words(t or ""), 5) for _, t in rows]
    parent = {i: i for i, _ in rows if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, _) in enumerate(rows):
        for m, (j, _) in enumerate(rows[:k]):
            a, b = sets[k], sets[m]
            if i is not None and j is not None and a and b and 100 * len(a & b) >= 80 * len(a | b):
                p, q = sorted((root(i), root(j)))
                parent[q] = p
    return [(i, t) for (i, t), s in zip(rows, sets) if i is None or not s or root(i) == i]


def plain_redacted(rows):
    out = []
    for i, t in rows:
        out.append((i, t and t.replace("joe@example.com", "[EMAIL]").replace("+1 (523) 555-1055", "[PHONE]")))
    return out


def check_packing(pieces, rows):
    library = tokenizers.Tokenizer.from_file(packing.word_tokenizer())
    want = sorted(len(library.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in rows)
    assert sorted(r.doc_tokens for r in pieces if r.start == 0) == want
    assert sum(r.length for r in pieces) == sum(want)
    held = {}
    for r in pieces:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in held.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))] and sum(n for _, n in parts) <= packing.CAPACITY


def test_run_and_stages(spark, tables):
    rows, _ = texts()
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    columns = docs.columns
    plain = {"toxicity": lambda x: plain_toxicity(spark, x, tables), "exact_dedup": plain_copies, "minhash_dedup": plain_near, "pii": plain_redacted}
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, tables)
        if name == "packing":
            check_packing(got.collect(), rows)
            break
        rows = plain[name](rows)
        assert got.columns == columns and pairs(got) == sorted(rows, key=str), name
        docs = spark.createDataFrame(got.collect(), got.schema).repartition(2)
    assert [i for i, _ in rows if i in (999, 1000, 1001, 1004, 1010, 1011, 1012)] == [999, 1010]
    assert sum(i == 1030 for i, _ in rows) == 1 and sum(i == 1031 for i, _ in rows) == 2 and sum(i is None for i, _ in rows) == 3
    check_packing(corpus_pipeline.run(spark, tables).collect(), rows)


def test_stages_on_nothing(spark, tables):
    none = spark.read.parquet(f"{tables}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, none, tables)
        assert got.count() == 0
        assert name == "packing" or got.columns == none.columns


def test_personal_data_in_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a@b.co", 1, 2)], "doc_id long, text string, row long, new long")
    assert pii.redact(df).collect() == [(1, "[EMAIL]", 1, 2)]
