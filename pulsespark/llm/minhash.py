"""MinHash near-dedup on SetSketch registers.

A document's set holds its distinct shingles of some words.  Each shingle sends exponentially spaced points into the
registers; a register keeps the least, stored as the truncated logarithm to base 1.02.  Registers of unions are the maxima
of the registers, and those of similar sets are equal about as often as the Jaccard similarity says.  Five registers make a
band.

Documents with the same word sequence form a class at once.  Classes that share a band meet in its bucket.  First a bucket
links its members with its smallest one, in a few bands; then, in all bands, members outside the bucket's largest component
meet one member of that.  So a bucket of thousands gives as many pairs.  Pairs are kept by the size ratio (exact) and by the
joint likelihood of both registers and sizes, six standard deviations below the threshold, and then confirmed on the full sets.

What is still apart must not be missed: in buckets with several components, members outside the largest are compared with
all others by their registers, inside tasks, and components with likely pairs between them form suspects.  The members of
suspects are dealt into blocks with their texts; a task compares all likely pairs of a block on the full sets, unites
components as it goes, and gives only links that unite two.  So what comes out of a task is less than what went in, even
where all pairs are nearly similar enough.
"""

from __future__ import annotations

import hashlib
import math
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import body, coded_words, components, resting, staged, table, text_runs

REGISTERS = 160
BASE = 1.02
BANDS, ROWS = 32, 5
#: Members, and bytes of their texts, of a block of which a task compares two.
BLOCK, BLOCK_BYTES = 1024, 2 << 20
#: Bands whose buckets are linked first.
FIRST = 4
MARGIN = 0.19
_SKETCH = "rid long, doc_id long, n_shingles long, digest string, bands array<long>, sketch binary, text string"
#: Steps through the registers that meet each once.
_STEPS = np.array([i for i in range(REGISTERS) if math.gcd(i, REGISTERS) == 1], np.int64)
_MIX = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def words(text: str) -> list[bytes]:
    """ASCII letters in lower case, cut at ASCII white space: just what bytes' own methods do."""
    return text.encode().lower().split()


def shingles(ws: list[bytes], size: int = 2) -> set:
    """Distinct runs of `size` words; the whole sequence where there are fewer, nothing without words."""
    if len(ws) < size:
        return {tuple(ws)} if ws else set()
    return set(zip(*(ws[i:] for i in range(size))))


def _mix(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * _MIX[0]
    z = (z ^ (z >> np.uint64(27))) * _MIX[1]
    return z ^ (z >> np.uint64(31))


def shingle_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Distinct 64-bit hashes of a text's shingles, from the hashes of its words in order."""
    if not len(hashes):
        return np.zeros(0, np.uint64)
    width = min(size, len(hashes))
    with np.errstate(over="ignore"):
        out = np.full(len(hashes) - width + 1, width, np.uint64)
        for i in range(width):
            out = _mix(out * _MIX[2] + hashes[i : len(hashes) - width + 1 + i])
    return np.unique(out)


def full_sets(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, offsets): the distinct shingles of each text, numbered without collisions among these texts."""
    codes, distinct, rows = coded_words(texts)
    n = np.diff(rows)
    number, widths = codes.astype(np.int64), np.minimum(n, size)
    owner = np.repeat(np.arange(len(n)), n)
    place, span = np.arange(len(codes)) - rows[owner], max(len(distinct), 1)
    for i in range(1, size):
        # shingles of i + 1 words from those of i words; texts of fewer words keep their own
        grown = np.flatnonzero(place + i < n[owner])
        _, dense = np.unique(number, return_inverse=True)
        number = dense.astype(np.int64) * (span + 1)
        number[grown] += codes[grown + i].astype(np.int64) + 1
    begins = place + np.maximum(widths[owner], 1) <= n[owner]
    key = np.unique(owner[begins].astype(np.int64) << np.int64(40) | np.unique(number, return_inverse=True)[1][begins])
    return key & ((1 << 40) - 1), np.searchsorted(key >> 40, np.arange(len(n) + 1))


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """uint16 registers, one row a set of distinct hashes; empty sets have zeros."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    least = np.full(len(sets) * REGISTERS, np.inf, np.float32)
    state = np.concatenate([*sets, np.zeros(0, np.uint64)])
    first, step = (state % np.uint64(REGISTERS)).astype(np.int64), _STEPS[((state >> np.uint64(40)) % np.uint64(len(_STEPS))).astype(np.int64)]
    x = np.zeros(len(state), np.float32)
    with np.errstate(over="ignore", divide="ignore"):
        for k in range(REGISTERS):
            state = state + _MIX[2]
            u = ((_mix(state) >> np.uint64(40)).astype(np.float32) + np.float32(0.5)) * np.float32(2.0**-24)
            x = x - np.log(u) / np.float32(REGISTERS - k)
            at = owner * REGISTERS + (first + k * step) % REGISTERS
            np.minimum.at(least, at, x)
            alive = x < least.reshape(-1, REGISTERS).max(1)[owner]
            if not alive.any():
                break
            if alive.mean() < 0.8:
                state, first, step, x, owner = state[alive], first[alive], step[alive], x[alive], owner[alive]
        value = np.floor(1 - np.log(np.maximum(least, 1e-30)) / np.log(BASE)) + 1024
    return np.where(np.isfinite(least), np.clip(value, 1, 65535), 0).astype(np.uint16).reshape(-1, REGISTERS)


def bands(regs: np.ndarray) -> np.ndarray:
    """One signed 64-bit key a band, which holds the band's number."""
    parts = regs[:, : BANDS * ROWS].reshape(-1, BANDS, ROWS).astype(np.uint64)
    with np.errstate(over="ignore"):
        key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), parts.shape[:2]).copy()
        for i in range(ROWS):
            key = _mix(key * _MIX[2] + parts[:, :, i])
    return key.view(np.int64)


def likelihood(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """The Jaccard similarity that makes the registers of both sets, given their sizes, most likely (to 0.01)."""
    above, below = (a > b).sum(1)[:, None], (a < b).sum(1)[:, None]
    u = (na / (na + nb))[:, None]
    v = 1 - u
    j = np.minimum(np.linspace(0, 1, 101)[None, :], np.minimum(u / v, v / u))
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)
    up, down = p(u - v * j), p(v - u * j)
    log = lambda x: np.log(np.maximum(x, 1e-12))
    fit = above * log(up) + below * log(down) + (REGISTERS - above - below) * log(1 - up - down)
    return j[np.arange(len(j)), fit.argmax(1)]


def sketch(docs: DataFrame, size: int) -> DataFrame:
    """Rows (rid, doc_id, n_shingles, digest, bands, sketch, text); once staged, rid numbers the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rid = TaskContext.get().partitionId() << 40
        for b in batches:
            for lo, hi in text_runs(b.column(1), 1 << 20):
                texts = b.column(1).slice(lo, hi - lo)
                codes, distinct, rows = coded_words(texts)
                known = np.array([xxhash.xxh3_64_intdigest(w) for w in distinct], np.uint64)
                flat = known[codes]
                sets = [shingle_hashes(flat[i:j], size) for i, j in zip(rows, rows[1:])]
                spelt = list(map(distinct.__getitem__, codes.tolist()))
                digests = [hashlib.sha256(b" ".join(spelt[i:j])).hexdigest() for i, j in zip(rows, rows[1:])]
                regs = np.concatenate([registers(sets[i : i + 500]) for i in range(0, len(sets), 500)])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(rid, rid + len(sets)), pa.int64()), b.column(0).slice(lo, hi - lo), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.string()),
                        pa.ListArray.from_arrays(np.arange(len(sets) + 1, dtype=np.int32) * BANDS, bands(regs).reshape(-1)), pa.array([r.tobytes() for r in regs], pa.binary()), texts,
                    ],
                    ["rid", "doc_id", "n_shingles", "digest", "bands", "sketch", "text"],
                )
                rid += len(sets)

    return docs.select(F.col("doc_id").cast("long"), body().alias("text")).mapInArrow(resting(run), _SKETCH)


def _likely(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose sizes allow the similarity and whose registers make it likely."""
    side = lambda n: sketches.select(F.col("rid").alias(n), F.col("n_shingles").alias(f"n{n}"), F.col("sketch").alias(f"s{n}"))
    met = pairs.join(side("a"), "a").join(side("b"), "b").where(f"100 * least(na, nb) >= {percent} * greatest(na, nb)")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for at in range(0, len(pdf), 4000):
                part = pdf.iloc[at : at + 4000]
                a, b = (np.frombuffer(b"".join(part[c]), np.uint16).reshape(-1, REGISTERS) for c in ("sa", "sb"))
                yield part[["a", "b"]][likelihood(a, b, part["na"].to_numpy(float), part["nb"].to_numpy(float)) >= percent / 100 - MARGIN]

    return met.mapInPandas(resting(run), "a long, b long")


def confirm(pairs: DataFrame, texts: DataFrame, percent: int, size: int) -> DataFrame:
    """Pairs whose full sets are as similar as asked: 100 * intersection >= percent * union."""
    side = lambda n: texts.select(F.col("rid").alias(n), F.col("text").alias(f"t{n}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: OrderedDict[int, set] = OrderedDict()

        def of(key, text):
            if key in held:
                held.move_to_end(key)
            else:
                held[key] = shingles(words(text.as_py()), size)
                if len(held) > 32:
                    held.popitem(last=False)
            return held[key]

        for b in batches:
            out = []
            for i, (x, y) in enumerate(zip(b.column("a").to_pylist(), b.column("b").to_pylist())):
                p, q = of(x, b.column("ta")[i]), of(y, b.column("tb")[i])
                both = len(p & q)
                if 100 * both >= percent * (len(p) + len(q) - both):
                    out.append((x, y))
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.int64()) for k in (0, 1)], ["a", "b"])

    return pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "ta", "tb").mapInArrow(resting(run), "a long, b long")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs(doc_id, text, ...).

    Documents are linked where their sets of `size`-word shingles have a Jaccard similarity of percent or more; a
    component's id is its smallest doc_id, which alone is kept.  Null, empty and blank texts have empty sets and link with
    nothing; a text of fewer words is one shingle.  Rows that repeat a doc_id are one document: what any of their texts links
    with, all of them reach; each row has its own n_shingles, and all are kept or none, but for those without words.  A null
    id gives a null component and kept = false.  Other columns are ignored; an empty table gives no rows.
    """
    rows = staged(sketch(docs.select("doc_id", "text"), size), "sketches")
    full = rows.where("n_shingles > 0 and doc_id is not null")
    classes = staged(full.groupBy("digest").agg(F.min("rid").alias("rid"), F.min("doc_id").alias("low")), "classes")
    reps = full.join(classes.select("rid"), "rid", "left_semi").select("rid", "n_shingles", "bands", "sketch", "text")
    members = reps.select("rid", F.posexplode("bands").alias("band", "key"))
    leaders = members.groupBy("key").agg(F.min("rid").alias("lead"), F.count("*").alias("n")).where("n > 1").select("key", "lead")
    buckets = staged(members.join(leaders, "key"), "buckets")
    met = staged(reps.join(buckets.select("rid").distinct(), "rid", "left_semi").select("rid", "n_shingles", "sketch", "text"), "met")

    owned = staged(rows.select("doc_id", "n_shingles", "digest").join(classes.select("digest", "rid"), "digest", "left").drop("digest"), "owned")
    ids = owned.where("n_shingles > 0 and doc_id is not null").groupBy("doc_id").agg(F.min("rid").alias("a"), F.max("rid").alias("z")).where("a <> z")
    same = staged(owned.where("n_shingles > 0").join(ids, "doc_id").where("rid <> a").select("a", F.col("rid").alias("b")).distinct(), "same")

    links = same.union(_linked(buckets.where(F.col("band") < FIRST).where("lead <> rid").select(F.col("lead").alias("a"), F.col("rid").alias("b")).distinct(), met, percent, size))
    label = components(links)
    cells, mixed = _mixed(buckets, label)
    met_one = cells.join(mixed, "key").where("cell <> top").select(F.least("rid", "lead").alias("a"), F.greatest("rid", "lead").alias("b")).distinct()
    more = _linked(met_one, met, percent, size)
    if not more.isEmpty():
        links = links.union(more)
        label = components(links)
        cells, mixed = _mixed(buckets, label)
    suspects = _suspects(cells, mixed, met, percent)
    if not suspects.isEmpty():
        more = staged(_across(suspects, label, met, percent, size), "links")
        if not more.isEmpty():
            label = components(links.union(more))

    found = classes.join(label.withColumnRenamed("node", "rid"), "rid", "left").select("rid", "low", F.coalesce("component", "rid").alias("component"))
    lowest = found.groupBy("component").agg(F.min("low").alias("component_id"))
    out = owned.join(found.join(lowest, "component").select("rid", "component_id"), "rid", "left")
    component = F.when(F.col("n_shingles") > 0, F.when(F.col("doc_id").isNotNull(), F.col("component_id"))).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def _linked(pairs: DataFrame, met: DataFrame, percent: int, size: int) -> DataFrame:
    """The confirmed ones of pairs."""
    return staged(confirm(_likely(pairs, met, percent), met, percent, size), "links")


def _mixed(buckets: DataFrame, label: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cells (key, rid, cell) of buckets, cell being the component, and (key, top, lead, members, minority) of those with
    several: the largest component, its smallest member, and how many members lie outside it."""
    cells = buckets.join(label.withColumnRenamed("node", "rid"), "rid", "left").select("key", "rid", F.coalesce("component", "rid").alias("cell"))
    sizes = cells.groupBy("key", "cell").agg(F.count("*").alias("n"), F.min("rid").alias("lead"))
    sizes = sizes.groupBy("key").agg(F.sum("n").alias("n"), F.max(F.struct("n", "cell", "lead")).alias("top")).where("n > top.n")
    mixed = staged(sizes.select("key", F.col("top.cell").alias("top"), F.col("top.lead").alias("lead"), F.col("n").alias("members"), (F.col("n") - F.col("top.n")).alias("minority")), "mixed")
    return staged(cells.join(mixed.select("key"), "key", "left_semi"), "cells"), mixed


def _dealt(rows: DataFrame, key: str, outside: Column, high: Column, wide: Column) -> DataFrame:
    """Rows dealt into blocks (i, j) of their key, `high` blocks of those outside the largest component and `wide` of all:
    side 0 has the former, side 1 the latter, so that each of the former meets each row in one block."""
    part = lambda salt, of: F.pmod(F.xxhash64("rid", F.lit(salt)), of)
    every = lambda of: F.explode(F.sequence(F.lit(0).cast("long"), of - 1))
    rows = rows.withColumn("high", high.cast("long")).withColumn("wide", wide.cast("long"))
    left = rows.where(outside).withColumn("i", part(1, F.col("high"))).withColumn("j", every(F.col("wide"))).withColumn("side", F.lit(0))
    right = rows.withColumn("j", part(2, F.col("wide"))).withColumn("i", every(F.col("high"))).withColumn("side", F.lit(1))
    return left.unionByName(right).drop("high", "wide")


def _blocks(pdf: pd.DataFrame, key: str) -> Iterator[tuple[pd.DataFrame, int]]:
    """(rows, how many of them are of side 0, which come first) of each block in a group."""
    pdf = pdf.sort_values([key, "i", "j", "side"], kind="stable", ignore_index=True)
    at = pdf[[key, "i", "j"]].to_numpy()
    starts = np.flatnonzero(np.append(True, (at[1:] != at[:-1]).any(1)))
    for lo, hi in zip(starts, np.append(starts[1:], len(pdf))):
        part = pdf.iloc[lo:hi]
        yield part, int((part["side"] == 0).sum())


class _Union:
    """Components of small numbers."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def unite(self, a: int, b: int) -> bool:
        a, b = self.root[a], self.root[b]
        if a != b:
            self.root[self.root == max(a, b)] = min(a, b)
        return bool(a != b)


def _near(r: int, mid: int, group: np.ndarray, n: np.ndarray, regs: np.ndarray, percent: int) -> np.ndarray:
    """Rows from mid on that lie in another group than row r and whose sizes and registers make the similarity likely."""
    near = np.flatnonzero((group[mid:] != group[r]) & (100 * np.minimum(n[mid:], n[r]) >= percent * np.maximum(n[mid:], n[r]))) + mid
    return near[(regs[near] == regs[r]).sum(1) >= (percent / 100 - MARGIN) * REGISTERS]


def _suspects(cells: DataFrame, mixed: DataFrame, met: DataFrame, percent: int) -> DataFrame:
    """(cell, suspect): components with likely pairs in some bucket, and the smallest of those they form a chain with."""
    held = met.select("rid", F.col("n_shingles").alias("n"), "sketch")
    whole = lambda c: F.ceil(F.col(c) / BLOCK)
    dealt = _dealt(cells.join(mixed.drop("lead"), "key").join(held, "rid"), "key", F.col("cell") != F.col("top"), whole("minority"), whole("members"))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for part, mid in _blocks(pdf, "key"):
            names, cell = np.unique(part["cell"].to_numpy(), return_inverse=True)
            n, regs = part["n"].to_numpy(), np.frombuffer(b"".join(part["sketch"]), np.uint16).reshape(-1, REGISTERS)
            union = _Union(len(names))
            for r in range(mid):
                for c in np.unique(cell[_near(r, mid, union.root[cell], n, regs, percent)]):
                    if union.unite(cell[r], c):
                        out.append((names[cell[r]], names[c]))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    rows = mixed.agg(F.coalesce(F.sum("members"), F.lit(0)).alias("n")).first().n
    found = dealt.withColumn("g", F.expr(f"pmod(xxhash64(key, i, j), {max(64, rows // BLOCK)})")).groupBy("g").applyInPandas(compare, "a long, b long")
    return staged(components(found.distinct()).toDF("cell", "suspect"), "suspects")


def _across(suspects: DataFrame, label: DataFrame, met: DataFrame, percent: int, size: int) -> DataFrame:
    """Links (a, b) that unite components of a suspect: its likely pairs between components, compared on their full sets."""
    component = F.coalesce("component", "rid")
    inside = met.join(label.withColumnRenamed("node", "rid"), "rid", "left").withColumn("cell", component).drop("component").join(suspects, "cell")
    sizes = inside.groupBy("suspect", "cell").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
    sizes = sizes.groupBy("suspect").agg(F.sum("n").alias("members"), F.sum("bytes").alias("bytes"), F.max(F.struct("n", "cell", "bytes")).alias("top"))
    sizes = staged(sizes.select("suspect", "members", "bytes", F.col("top.cell").alias("top"), (F.col("members") - F.col("top.n")).alias("minority"), (F.col("bytes") - F.col("top.bytes")).alias("less")), "sizes")
    whole = lambda n, b: F.greatest(F.ceil(F.col(n) / BLOCK), F.ceil(F.col(b) / BLOCK_BYTES), F.lit(1))
    held = inside.select("suspect", "cell", "rid", F.col("n_shingles").alias("n"), "sketch", "text").join(sizes, "suspect")
    dealt = _dealt(held, "suspect", F.col("cell") != F.col("top"), whole("minority", "less"), whole("members", "bytes"))
    total = sizes.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("b"), F.coalesce(F.sum("members"), F.lit(0)).alias("n")).first()

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for part, mid in _blocks(pdf, "suspect"):
            names, cell = np.unique(part["cell"].to_numpy(), return_inverse=True)
            n, regs = part["n"].to_numpy(), np.frombuffer(b"".join(part["sketch"]), np.uint16).reshape(-1, REGISTERS)
            numbers, at = full_sets(pa.array(part["text"], pa.large_string()), size)
            ids, union, mark = part["rid"].to_numpy(), _Union(len(names)), np.zeros(int(numbers.max(initial=0)) + 1, bool)
            for r in range(mid):
                near = _near(r, mid, union.root[cell], n, regs, percent)
                mark[numbers[at[r] : at[r + 1]]] = True
                for b in near:
                    if union.root[cell[b]] != union.root[cell[r]]:
                        both = int(mark[numbers[at[b] : at[b + 1]]].sum())
                        if 100 * both >= percent * (n[r] + n[b] - both):
                            union.unite(cell[r], cell[b])
                            out.append((ids[r], ids[b]))
                mark[numbers[at[r] : at[r + 1]]] = False
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    groups = max(64, 2 * total.n // BLOCK, 2 * total.b // BLOCK_BYTES)
    return dealt.withColumn("g", F.expr(f"pmod(xxhash64(suspect, i, j), {groups})")).groupBy("g").applyInPandas(compare, "a long, b long")


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), size=2, percent=80)


OP5_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) = 1 THEN [ws[1]] ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END) AS ss FROM w),
e AS (SELECT doc_id, unnest(ss) AS x FROM s),
n AS (SELECT doc_id, len(ss) AS n FROM s),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM pairs JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 80 * (p.n + q.n - c)),
r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
m AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT n.doc_id, n.n::BIGINT AS n_shingles, component_id, n.doc_id = component_id AS kept FROM n JOIN m ON m.a = n.doc_id
"""
