"""Toxicity: a factorization machine over hashed terms.

A document is the set of its hashed terms: each word, and its first four and five letters, which inflected and compound
forms share.  The score is the logistic of bias + sum of weights + sum over pairs of <v_i, v_j>, so that two terms which
are harmless alone can count together.  The pair sum is computed in linear time from the sum and the squares of the v_i.

Terms take part if their own share differs between the labels, or if they form a pair that tells the labels apart better
than its two terms do alone; pairs are looked for among the PAIRED terms found in most rows of the sample.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import body, coded_words, id_hash, resting, staged, table, text_runs

BITS = 18
FACTORS = 4
#: Bound of the labelled sample, of each label.
SAMPLE = 4000
#: Terms among which pairs are looked for, and the least G of a pair beyond that of its terms.
PAIRED, PAIR_G = 1024, 40.0
WORD = re.compile(r"[^\W\d_]+")


class Terms:
    """Hashed terms of texts, of `used` (a mask) only where that is given; words' terms are remembered within a bound."""

    def __init__(self, used: np.ndarray | None = None) -> None:
        self.used = used
        self.known: dict[bytes, tuple[int, ...]] = {}

    def _of(self, stretch: bytes) -> tuple[int, ...]:
        out = []
        for w in WORD.findall(stretch.decode().lower()):
            for kind, part in (("w", w), ("4", w[:4]), ("5", w[:5])):
                out.append(zlib.crc32(f"{kind}{part}".encode()) & ((1 << BITS) - 1))
        return tuple(out) if self.used is None else tuple([t for t in out if self.used[t]])

    def of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(row, term) of the distinct terms of each whole text, ascending."""
        codes, distinct, rows = coded_words(texts)
        known = self.known
        if len(known) > 300_000:
            known.clear()
        found = []
        for word in distinct:
            terms = known.get(word)
            if terms is None:
                terms = self._of(word)
                if len(word) < 64:
                    known[word] = terms
            found.append(terms)
        sizes = np.array([len(t) for t in found], np.int64)
        flat, first = np.array([t for ts in found for t in ts], np.int64), np.cumsum(sizes) - sizes
        owner = np.repeat(np.arange(len(texts)), np.diff(rows))
        if not len(flat):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        n = sizes[codes]
        some = n > 0
        owner, first, n = owner[some], first[codes[some]], n[some]
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
        key = np.unique(np.repeat(owner, n) << BITS | flat[place])
        return key >> BITS, key & ((1 << BITS) - 1)


@dataclass
class Machine:
    bias: float
    weights: np.ndarray  # one a term
    factors: np.ndarray  # FACTORS a term

    def raw(self, row: np.ndarray, term: np.ndarray, rows: int) -> np.ndarray:
        """Scores before the logistic, of `rows` sets of terms."""
        v = self.factors[term].astype(np.float64)
        pairs = sum(np.bincount(row, v[:, f], rows) ** 2 for f in range(FACTORS)) - np.bincount(row, np.square(v).sum(1), rows)
        return self.bias + np.bincount(row, self.weights[term], rows) + 0.5 * pairs

    def scores(self, terms: Terms, texts: pa.Array) -> np.ndarray:
        out = [np.zeros(0)]
        for lo, hi in text_runs(texts):
            out.append(1 / (1 + np.exp(-np.clip(self.raw(*terms.of(texts.slice(lo, hi - lo)), hi - lo), -40, 40))))
        return np.concatenate(out)


def _g(*cells: tuple[np.ndarray, np.ndarray], ones: float, rows: float) -> np.ndarray:
    """The G statistic of cells (ones, rows) against the share that ones have of all rows."""
    total = 0.0
    for one, n in cells:
        for seen, share in ((one, ones / rows), (n - one, 1 - ones / rows)):
            total = total + np.where(seen > 0, 2 * seen * np.log(np.maximum(seen, 1e-9) / np.maximum(n * share, 1e-9)), 0.0)
    return total


def telling(ones: np.ndarray, rows: np.ndarray, labels: np.ndarray, least: float = 11.0, copies: int = 3) -> np.ndarray:
    """Which terms tell the labels apart by themselves, from the rows they are in: those in at least `copies` rows whose share
    differs by a G test.  Rare words of few documents would otherwise be learned by heart."""
    y, n = float(labels.sum()), float(len(labels))
    return (_g((ones, rows), (y - ones, n - rows), ones=y, rows=n) >= least) & (rows >= copies)


def pairs(has: np.ndarray, labels: np.ndarray, least: float = PAIR_G) -> np.ndarray:
    """Which columns of has (rows x terms, 0 or 1) are in a pair whose four cells tell the labels apart by `least` more than
    the two terms do by themselves."""
    y, n = float(labels.sum()), float(len(labels))
    toxic = has[labels == 1]
    one, all_ = toxic.sum(0, dtype=np.float64), has.sum(0, dtype=np.float64)
    alone = _g((one, all_), (y - one, n - all_), ones=y, rows=n)
    out = np.zeros(has.shape[1], bool)
    for at in range(0, has.shape[1], 128):
        part = slice(at, at + 128)
        both_one, both = (m[:, part].T @ m for m in (toxic, has))
        one_a, all_a = one[part, None], all_[part, None]
        g = _g(
            (both_one, both), (one_a - both_one, all_a - both), (one - both_one, all_ - both), (y - one_a - one + both_one, n - all_a - all_ + both), ones=y, rows=n
        )
        telling_ = g - alone[part, None] - alone >= least
        out[part] |= telling_.any(1)
        out |= telling_.any(0)
    return out


def fit(rows: list[np.ndarray], labels: np.ndarray, epochs: int = 30, rate: float = 0.15, decay: float = 2e-4, seed: int = 7) -> Machine:
    """AdaGrad on the logistic loss, both classes weighted alike, in small batches.  Without rows of both labels the score is constant."""
    rng = np.random.default_rng(seed)
    size = 1 << BITS
    distinct = {(r.tobytes(), int(y)): i for i, (r, y) in enumerate(zip(rows, labels))}  # copies teach nothing new
    rows, labels = [rows[i] for i in distinct.values()], labels[list(distinct.values())]
    w, v = np.zeros(size, np.float32), np.zeros((size, FACTORS), np.float32)
    if not len(rows) or labels.min() == labels.max():
        share = (float(labels.sum()) + 0.5) / (len(rows) + 1)
        return Machine(float(np.log(min(share, 0.49) / (1 - min(share, 0.49)))), w, v)
    met = np.unique(np.concatenate(rows))
    v[met] = rng.normal(0, 0.05, (len(met), FACTORS))
    gw, gv, bias, gb = np.full(size, 1e-6, np.float32), np.full((size, FACTORS), 1e-6, np.float32), 0.0, 1e-6
    weight = np.where(labels == 1, len(rows) / (2 * labels.sum()), len(rows) / (2 * (len(rows) - labels.sum())))
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(rows), 64):
            batch = order[at : at + 64]
            sizes = np.array([len(rows[i]) for i in batch])
            terms = np.concatenate([rows[i] for i in batch])
            row = np.repeat(np.arange(len(batch)), sizes)
            va = v[terms]
            s = np.zeros((len(batch), FACTORS), np.float32)
            np.add.at(s, row, va)
            q = np.bincount(row, np.square(va).sum(1), len(batch))
            z = bias + np.bincount(row, w[terms], len(batch)) + 0.5 * (np.square(s).sum(1) - q)
            g = ((1 / (1 + np.exp(-np.clip(z, -40, 40))) - labels[batch]) * weight[batch]).astype(np.float32) / len(batch)
            each = g[row]
            used, where = np.unique(terms, return_inverse=True)
            dw = np.bincount(where, each, len(used)).astype(np.float32) + decay * w[used]
            dv = np.stack([np.bincount(where, each * (s[row, f] - va[:, f]), len(used)) for f in range(FACTORS)], 1).astype(np.float32) + decay * v[used]
            gw[used] += dw**2
            gv[used] += dv**2
            w[used] -= rate * dw / np.sqrt(gw[used])
            v[used] -= 0.3 * rate * dv / np.sqrt(gv[used])
            gb += float(g.sum()) ** 2
            bias -= rate * float(g.sum()) / np.sqrt(gb)
    return Machine(float(bias), w, v)


def _terms(docs: DataFrame) -> DataFrame:
    """(label, terms) of docs(label, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms()
        for b in batches:
            for lo, hi in text_runs(b.column(1)):
                row, term = terms.of(b.column(1).slice(lo, hi - lo))
                lists = pa.ListArray.from_arrays(np.searchsorted(row, np.arange(hi - lo + 1)).astype(np.int32), pa.array(term, pa.int32()))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), lists], ["label", "terms"])

    return docs.mapInArrow(resting(run), "label int, terms array<int>")


def _packed(sample: DataFrame, used: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """(terms, labels) of the sample's rows, of the used terms only, which tasks pick out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for terms in b.column(1):
                t = terms.values.to_numpy(zero_copy_only=False)
                out.append(t[used[t]].astype("<i4").tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["label", "terms"])

    got = sorted(((r.label, bytes(r.terms)) for r in sample.mapInArrow(run, "label int, terms binary").collect()), key=lambda x: (x[0], len(x[1]), x[1]))
    return [np.frombuffer(t, "<i4") for _, t in got], np.array([y for y, _ in got], np.int64)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Machine:
    """Fit on at most `sample` rows of each label, the least by a hash of the id, among those whose crc32(id) mod 5 is not 0.

    Rows without an id or a label of 0 or 1 are left out; of several labels of an id the highest counts.
    """
    seen = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("label"))
    seen = seen.where(F.pmod(id_hash(), F.lit(5)) != 0)
    pick = lambda y: seen.where(F.col("label") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    chosen = pick(1).union(pick(0))
    rows = docs.select("doc_id", body().alias("text")).join(F.broadcast(chosen), "doc_id").select("label", "text")  # 2 * sample ids
    rows = staged(_terms(rows), "sample")
    counted = rows.select("label", F.explode("terms").alias("term")).groupBy("term").agg(F.sum("label").alias("ones"), F.count("*").alias("n"))
    found = counted.where("n > 2").select(F.col("term").cast("int"), F.col("ones").cast("int"), F.col("n").cast("int")).toPandas()  # 2**BITS rows at most
    ones, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    ones[found["term"]], n[found["term"]] = found["ones"], found["n"]
    often = np.zeros(1 << BITS, bool)
    order = np.lexsort((np.arange(1 << BITS), -n))[:PAIRED]
    often[order[n[order] > 0]] = True
    y = np.repeat([0, 1], [rows.where("label = 0").count(), rows.where("label = 1").count()])
    used = telling(ones, n, y) if 0 < y.sum() < len(y) else np.zeros(1 << BITS, bool)
    terms, y = _packed(rows, used | often)
    if used.any() or often.any() and 0 < y.sum() < len(y):
        column = np.cumsum(often) - 1
        has = np.zeros((len(terms), int(often.sum())), np.float32)  # 2 * sample rows, PAIRED columns
        for i, t in enumerate(terms):
            has[i, column[t[often[t]]]] = 1
        used[np.flatnonzero(often)[pairs(has, y)]] = True
    return fit([t[used[t]] for t in terms], y)


def _sent(docs: DataFrame, machine: Machine):
    """The terms that count, with their weights and factors, sent to all tasks: 2**BITS * (2 + FACTORS) numbers at most."""
    used = np.flatnonzero((machine.weights != 0) | (machine.factors != 0).any(1))
    return docs.sparkSession.sparkContext.broadcast((machine.bias, used, machine.weights[used], machine.factors[used]))


def _received(sent) -> tuple[Machine, Terms]:
    bias, used, weights, factors = sent
    mask, w, v = np.zeros(1 << BITS, bool), np.zeros(1 << BITS, np.float32), np.zeros((1 << BITS, FACTORS), np.float32)
    mask[used], w[used], v[used] = True, weights, factors
    return Machine(bias, w, v), Terms(mask)


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """(doc_id, score) for every row; empty and null texts have the bias' score, repeated rows a row each, nothing else is read."""
    model = _sent(docs, machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, terms = _received(model.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(m.scores(terms, b.column(1)), pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), body().alias("text")).mapInArrow(resting(run), "doc_id long, score double")


def filtered(docs: DataFrame, machine: Machine, bound: float = 0.5) -> DataFrame:
    """The rows of docs that score below bound, all columns kept; texts are scored where they lie, without a shuffle."""
    model, at = _sent(docs, machine), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, terms = _received(model.value)
        for b in batches:
            yield b.filter(pa.array(m.scores(terms, b.column(at).fill_null("")) < bound, pa.bool_()))

    return docs.mapInArrow(resting(run), docs.schema)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (F.pmod(id_hash(), F.lit(5)) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
