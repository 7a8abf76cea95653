"""LM scoring with an Elias-Fano bigram trie, sharded by context.

The model is an interpolated bigram with absolute discounting over add-0.1 unigrams:

    p(w | u) = (d(u, w) + D * n1(u) * p1(w)) / c(u),   d = c(u, w) - D quantised to 8 bits of its logarithm,

with c(u) the context's count, n1(u) its distinct successors and p1 the base model; an unseen context has p1.  A text
starts in a begin state and its end is a token.  The quantisation (steps of 0.04 in log10) moves a probability by less
than 5 percent, and sums by as little.

A shard of the trie has four levels in one mapped region: its contexts, pointers to each context's first successor, the
successors, and their quantised masses.  The first three are Elias-Fano sequences that stay packed while they are read.
Successors are stored on top of the last value of the context before, which makes the level monotone; a query finds the
context's rank, reads its two pointers, and searches for the successor relative to that value between them.  A context's
successors are dealt over 16 shards, so that a word as frequent as "the" is no shard by itself.

Texts are tokenised once, in chunks, and staged: their words in numbers of the chunk, from which its distinct bigrams follow,
and the chunk's words with their counts in training texts.  Words are counted by their bytes, so counts and the base model are
exact; bigrams are of hashes (48 bits of the context, 40 of the word).  A shard merges all chunks' counts and answers each
chunk in its order, with one byte a bigram.  So what moves is one entry a distinct n-gram and chunk, whatever the number of
documents.
"""

from __future__ import annotations

import mmap
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import body, coded_words, discard, id_hash, resting, staged, table, text_runs

SALTS = 16
D = 0.75
#: The states before and after a text: hashes no word has, and names no word can have.
BEGIN, END = 1, 2
STATES = (b" begin", b" end")
STEP, LOWEST = 0.04, -0.62
HASH_BITS, WORD_BITS = 48, 40
#: Bytes of text of a chunk; a longer text is a chunk of its own.
CHUNK = 8 << 20
_C1, _C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


# ---- Elias-Fano -----------------------------------------------------------------------------------------------------
def _place_in_word(word: np.ndarray, k: np.ndarray) -> np.ndarray:
    """The place of bit k (from 0) among the set bits of each 64-bit word."""
    place, k = np.zeros(len(word), np.int64), k.astype(np.int64)
    for half in (32, 16, 8, 4, 2, 1):
        below = np.bitwise_count(word & np.uint64((1 << half) - 1)).astype(np.int64)
        on = k >= below
        k -= np.where(on, below, 0)
        place += np.where(on, half, 0)
        word = np.where(on, word >> np.uint64(half), word)
    return place


class EliasFano:
    """An increasing sequence of integers below 2**63: low bits packed, high bits in unary, counts of ones a 64-bit word."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.ones = n, low_bits, low, high, ones

    @staticmethod
    def encode(values: np.ndarray) -> bytes:
        """Header (n, low bits, words of low, words of high), low, high, ones before each word of high."""
        n = len(values)
        values = values.astype(np.uint64)
        bits = max(0, int(np.log2(max(1.0, float(values[-1] if n else 0) / max(n, 1)))))
        low = np.zeros((n * bits + 63) // 64 + 2, np.uint64)
        if n and bits:
            part = values & np.uint64((1 << bits) - 1)
            at = np.arange(n, dtype=np.uint64) * np.uint64(bits)
            word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            np.bitwise_or.at(low, word, part << shift)
            over = shift > np.uint64(0)
            np.bitwise_or.at(low, word[over] + 1, part[over] >> (np.uint64(64) - shift[over]))
        place = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        unary = np.zeros(((int(place[-1]) if n else 0) // 64 + 1) * 64, np.uint8)
        unary[place] = 1
        high = np.packbits(unary, bitorder="little").view("<u8")
        ones = np.cumsum(np.append(0, np.bitwise_count(high)))[:-1]
        return np.array([n, bits, len(low), len(high)], "<i8").tobytes() + low.astype("<u8").tobytes() + high.tobytes() + ones.astype("<i8").tobytes()

    @classmethod
    def view(cls, buffer, at: int) -> tuple[EliasFano, int]:
        n, bits, lows, highs = np.frombuffer(buffer, "<i8", 4, at).tolist()
        low = np.frombuffer(buffer, "<u8", lows, at := at + 32)
        high = np.frombuffer(buffer, "<u8", highs, at := at + 8 * lows)
        return cls(n, bits, low, high, np.frombuffer(buffer, "<i8", highs, at := at + 8 * highs)), at + 8 * highs

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.uint64)
        at = i.astype(np.uint64) * np.uint64(self.low_bits)
        word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        upper = np.where(shift > np.uint64(0), self.low[word + 1] << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
        return ((self.low[word] >> shift) | upper) & np.uint64((1 << self.low_bits) - 1)

    def get(self, i: np.ndarray) -> np.ndarray:
        """The values at places i."""
        word = np.searchsorted(self.ones, i, "right") - 1
        place = word * 64 + _place_in_word(self.high[word], i - self.ones[word])
        return (place - i).astype(np.uint64) << np.uint64(self.low_bits) | self._low(i)

    def _up_to(self, high: np.ndarray) -> np.ndarray:
        """How many values have a high part of at most `high` (-1: none)."""
        zeros = np.arange(len(self.ones)) * 64 - self.ones
        k = np.maximum(high, 0)
        word = np.searchsorted(zeros, k, "right") - 1
        place = word * 64 + _place_in_word(~self.high[word], k - zeros[word])
        return np.where(high < 0, 0, np.minimum(place - k, self.n))

    def find(self, targets: np.ndarray, lo=None, hi=None) -> np.ndarray:
        """For each target its place, or -1, at places from lo to hi - 1; the high part narrows that, low parts are searched."""
        if not self.n:
            return np.full(len(targets), -1)
        targets = targets.astype(np.uint64)
        all_zeros = len(self.ones) * 64 - self.n
        high = np.minimum((targets >> np.uint64(self.low_bits)).astype(np.int64), all_zeros)
        begin, end = self._up_to(high - 1), np.where(high >= all_zeros, self.n, self._up_to(np.minimum(high, all_zeros - 1)))
        if lo is not None:
            begin, end = np.maximum(begin, lo), np.minimum(end, hi)
        last, want = end.copy(), targets & np.uint64((1 << self.low_bits) - 1)
        while len(on := np.flatnonzero(begin < end)):
            mid = (begin[on] + end[on]) >> 1
            less = self._low(mid) < want[on]
            begin[on], end[on] = np.where(less, mid + 1, begin[on]), np.where(less, end[on], mid)
        found = begin < last
        return np.where(found & (self._low(np.where(found, begin, 0)) == want), begin, -1)


def quantise(mass: np.ndarray) -> np.ndarray:
    """Codes 1 to 255 of discounted counts; 0 is for n-grams that were not seen."""
    return np.clip(np.rint((np.log10(mass) - LOWEST) / STEP), 0, 254).astype(np.uint8) + np.uint8(1)


def mass_of(codes: np.ndarray) -> np.ndarray:
    return np.where(codes > 0, 10.0 ** (LOWEST + STEP * (codes.astype(float) - 1)), 0.0)


class Trie:
    """A shard's levels in one mapped region."""

    def __init__(self, u: np.ndarray, w: np.ndarray, count: np.ndarray):
        """From distinct (u, w) in order, w below 2**WORD_BITS."""
        contexts, first = np.unique(u, return_index=True)
        pointers = np.append(first, len(u))
        # each context's successors go on top of the last value before them
        last = w[pointers[1:] - 1] + np.uint64(1) if len(contexts) else w[:0]
        under = np.cumsum(last, dtype=np.uint64) - last
        levels = EliasFano.encode(contexts) + EliasFano.encode(pointers) + EliasFano.encode(np.repeat(under, np.diff(pointers)) + w) + quantise(count - D).tobytes()
        self.mapped = mmap.mmap(-1, len(levels))
        self.mapped.write(levels)
        self.contexts, at = EliasFano.view(self.mapped, 0)
        self.pointers, at = EliasFano.view(self.mapped, at)
        self.successors, at = EliasFano.view(self.mapped, at)
        self.codes = np.frombuffer(self.mapped, np.uint8, len(u), at)

    def query(self, u: np.ndarray, runs: np.ndarray, w: np.ndarray) -> np.ndarray:
        """The codes of successors w, 0 where unseen; context u[i] has the next runs[i] of them."""
        if not self.successors.n:
            return np.zeros(len(w), np.uint8)
        rank = self.contexts.find(u)
        known = np.maximum(rank, 0)
        begin, end = self.pointers.get(known).astype(np.int64), self.pointers.get(known + 1).astype(np.int64)
        # the value before the context's first successor, plus one; the level starts from 0
        under = np.where(begin > 0, self.successors.get(np.maximum(begin - 1, 0)) + np.uint64(1), np.uint64(0))
        begin, end = np.where(rank < 0, 0, begin), np.where(rank < 0, 0, end)
        place = self.successors.find(np.repeat(under, runs) + w, np.repeat(begin, runs), np.repeat(end, runs))
        return np.where(place >= 0, self.codes[np.maximum(place, 0)], 0).astype(np.uint8)


# ---- chunks ---------------------------------------------------------------------------------------------------------
def _squeeze(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def _spread(data: bytes) -> bytes:
    return pa.decompress(memoryview(data)[8:], decompressed_size=int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)


def _pack(*arrays: np.ndarray, more: bytes = b"") -> bytes:
    """Arrays of unsigned numbers, each in as many bytes a number as its largest takes, the lowest of all first, and more bytes;
    compressed."""
    out = [len(arrays).to_bytes(8, "little")]
    for a in arrays:
        width = max(1, -(-int(a.max(initial=0)).bit_length() // 8))
        out += [np.array([len(a), width], "<i8").tobytes(), np.ascontiguousarray(a.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()]
    return _squeeze(b"".join([*out, more]))


def _unpack(data: bytes) -> tuple[list[np.ndarray], bytes]:
    data, out, at = _spread(data), [], 8
    for _ in range(int.from_bytes(data[:8], "little")):
        n, width = np.frombuffer(data, "<i8", 2, at).tolist()
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :width] = np.frombuffer(data, np.uint8, n * width, at + 16).reshape(width, n).T
        out.append(wide.reshape(-1).view("<u8"))
        at += 16 + n * width
    return out, data[at:]


def word_hash(w: bytes) -> int:
    return max(xxhash.xxh3_64_intdigest(w) >> 64 - HASH_BITS, 3)


def _shards_of_words(hashes: np.ndarray, shards: int) -> np.ndarray:
    return (hashes % np.uint64(shards)).astype(np.int64)


def _numbered(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A chunk's numbers of words, which follow their hashes' order (begin 0, end 1), and the hashes in that order."""
    order = np.argsort(hashes, kind="stable")
    number = np.empty(len(order), np.int64)
    number[order] = np.arange(len(order))
    return number, hashes[order]


def _tokens(words: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(context, word) numbers of every token of texts laid end to end, each with its begin (0) and end (1)."""
    ends = np.cumsum(lengths + 1)
    w = np.ones(int(ends[-1]) if len(ends) else 0, np.int64)
    inside = np.ones(len(w), bool)
    inside[ends - 1] = False
    w[inside] = words
    u = np.zeros_like(w)
    u[1:] = w[:-1]
    u[ends - lengths - 1] = 0
    return u, w


def _bigrams(u: np.ndarray, w: np.ndarray, hashes: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct bigrams by (shard, context, word): shard, context and word numbers, and the bigram of each token."""
    key, back = np.unique(u << 32 | w, return_inverse=True)
    u, w = key >> 32, key & 0xFFFFFFFF
    with np.errstate(over="ignore"):
        mixed = (hashes[u] + ((hashes % np.uint64(SALTS)) * _C1)[w]) * _C2
    shard = ((mixed >> np.uint64(33)) % np.uint64(shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return shard[order], u[order], w[order], place[back]


_PART = "chunk long, kind int, shard int, data binary"


def _parts(rows: list[tuple]) -> pa.RecordBatch:
    c, k, s, d = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()), pa.array(k, pa.int32()), pa.array(s, pa.int32()), pa.array(d, pa.binary())], ["chunk", "kind", "shard", "data"])


def _chunks(shards: int):
    """Texts to chunks: kind 0, the texts; 1, a shard's words with their counts in training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 24
        for b in batches:
            for lo, hi in text_runs(b.column(2), CHUNK):
                yield from one(at, b.slice(lo, hi - lo))
                at += 1

    def one(at: int, b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        codes, distinct, rows = coded_words(b.column(2))
        met, lengths = np.array([BEGIN, END, *map(word_hash, distinct)], np.uint64), np.diff(rows)
        number, hashes = _numbered(met)
        spelt, words = [*STATES, *distinct], number[codes + 2]
        spelt = [spelt[i] for i in np.argsort(number).tolist()]
        ids, train = b.column(0), np.asarray(b.column(1).to_pylist(), bool)
        yield _parts([(at, 0, -1, _pack(ids.fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64), ids.is_null().to_numpy(zero_copy_only=False), train, lengths, met, codes + 2))])
        count = np.bincount(words[np.repeat(train, lengths)], minlength=len(hashes))
        count[:2] = train.sum()  # begin, as a context, and end
        shard = _shards_of_words(hashes, shards)
        by = np.argsort(shard, kind="stable")
        ends = np.searchsorted(shard[by], np.arange(shards + 1))
        out = []
        for s, (i, j) in enumerate(zip(ends, ends[1:])):
            if j > i:
                named = [spelt[k] for k in by[i:j]]
                out.append((at, 1, s, _pack(np.array([len(x) for x in named]), count[by[i:j]], more=b"".join(named))))
        yield _parts(out)

    return run


def _chunk(data: bytes, shards: int):
    """(ids, null ids, training flags, lengths, hashes) of a chunk and its (shards, contexts, words, bigrams of tokens)."""
    ids, null, train, lengths, met, words = _unpack(data)[0]
    lengths, (number, hashes) = lengths.astype(np.int64), _numbered(met)
    return ids, null, train > 0, lengths, hashes, _bigrams(*_tokens(number[words.astype(np.int64)], lengths), hashes, shards)


def _bigram_counts(shards: int):
    """Chunks of kind 0 to kind 2: a shard's bigrams with their counts in training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, data in zip(b.column(0).to_pylist(), b.column(3)):
                yield from one(at, data.as_buffer())

    def one(at: int, data) -> Iterator[pa.RecordBatch]:
        _, _, train, lengths, hashes, (shard, u, w, back) = _chunk(data, shards)
        count = np.bincount(back[np.repeat(train, lengths + 1)], minlength=len(u))
        ends = np.searchsorted(shard, np.arange(shards + 1))
        hw = hashes[w] & np.uint64((1 << WORD_BITS) - 1)
        out = []
        for s, (i, j) in enumerate(zip(ends, ends[1:])):
            if j > i:
                first = np.flatnonzero(np.append(True, u[i + 1 : j] != u[i : j - 1]))
                out.append((at, 2, s, _pack(hashes[u[i + first]], np.diff(np.append(first, j - i)), hw[i:j], count[i:j])))
        for i in range(0, len(out), 256):
            yield _parts(out[i : i + 256])

    return run


# ---- the model ------------------------------------------------------------------------------------------------------
def _merge_bigrams(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """A shard's bigrams to answers for each chunk (kind 2) and the successors of each context (kind 4)."""
    parts = [_unpack(d)[0] for d in pdf["data"]]
    u, runs, w, count = (np.concatenate([p[i] for p in parts]) for i in range(4))
    runs = runs.astype(np.int64)
    contexts, rank = np.unique(u, return_inverse=True)
    seen = count > 0
    entry = (np.repeat(rank, runs).astype(np.uint64) << np.uint64(WORD_BITS) | w)[seen]
    order = np.argsort(entry)
    entry, count = entry[order], count[seen][order].astype(np.float64)
    first = np.flatnonzero(np.append(True, entry[1:] != entry[:-1])[: len(entry)])
    entry, count = entry[first], np.add.reduceat(count, first) if len(first) else count
    rank = (entry >> np.uint64(WORD_BITS)).astype(np.int64)
    trie = Trie(contexts[rank], entry & np.uint64((1 << WORD_BITS) - 1), count)
    codes, rows, at = trie.query(u, runs, w), [], 0
    for chunk, p in zip(pdf["chunk"], parts):
        rows.append((chunk, 2, key[0], _squeeze(codes[at : at + len(p[2])].tobytes())))
        at += len(p[2])
    known, n1 = np.unique(rank, return_counts=True)
    rows.append((-1, 4, key[0], _pack(contexts[known], n1)))
    return pd.DataFrame(rows, columns=["chunk", "kind", "shard", "data"])


def _split_contexts(shards: int):
    """Successor counts by bigram shard to rows by word shard."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for data in pdf["data"]:
                u, n1 = _unpack(data)[0]
                shard = _shards_of_words(u, shards)
                by = np.argsort(shard, kind="stable")
                found, first = np.unique(shard[by], return_index=True)
                rows += [(-1, 4, int(s), _pack(u[by[i:j]], n1[by[i:j]])) for s, i, j in zip(found, first, np.append(first[1:], len(by)))]
            yield pd.DataFrame(rows, columns=["chunk", "kind", "shard", "data"])

    return run


def _merge_words(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """A shard's counts and successor counts to answers (kind 1): counts and successors, and totals (kind 5): tokens, distinct."""
    parts, named, lengths, counts = pdf[pdf["kind"] == 1], [], [], []
    for data in parts["data"]:
        (size, count), names = _unpack(data)
        named.append(names)
        lengths.append(size)
        counts.append(count)
    sizes = [len(x) for x in lengths]
    lengths, counts = (np.concatenate([*x, np.zeros(0, np.uint64)]).astype(np.int64) for x in (lengths, counts))
    offsets = np.append(0, np.cumsum(lengths))
    coded = pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(b"".join(named))]).dictionary_encode()
    codes, words = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()
    total = np.bincount(codes, counts, len(words)).astype(np.int64)
    successors = np.zeros(len(words), np.int64)
    told = [_unpack(d)[0] for d in pdf["data"][pdf["kind"] == 4]]
    if told and len(words):
        contexts, back = np.unique(np.concatenate([t[0] for t in told]), return_inverse=True)
        n1 = np.bincount(back, np.concatenate([t[1] for t in told]).astype(float)).astype(np.int64)
        own = {STATES[0]: BEGIN, STATES[1]: END}
        hashes = np.array([own.get(w) or word_hash(w) for w in words], np.uint64)
        at = np.minimum(np.searchsorted(contexts, hashes), len(contexts) - 1)
        successors = np.where(contexts[at] == hashes, n1[at], 0)
    rows, at = [], 0
    for chunk, n in zip(parts["chunk"], sizes):
        mine = codes[at : at + n]
        rows.append((chunk, 1, key[0], _pack(total[mine], successors[mine])))
        at += n
    token = np.array([w != STATES[0] for w in words], bool)
    rows.append((-1, 5, key[0], np.array([total[token].sum(), (total[token] > 0).sum()], "<i8").tobytes()))
    return pd.DataFrame(rows, columns=["chunk", "kind", "shard", "data"])


_SCORE = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score(shards: int, tokens: int, distinct: int):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        ids, null, train, lengths, hashes, (_, u, w, bigram) = _chunk(pdf["data"][pdf["kind"] == 0].iloc[0], shards)
        codes = np.frombuffer(b"".join(map(_spread, pdf[pdf["kind"] == 2].sort_values("shard")["data"])), np.uint8)
        told = [_unpack(d)[0] for d in pdf[pdf["kind"] == 1].sort_values("shard")["data"]]
        by = np.argsort(_shards_of_words(hashes, shards), kind="stable")
        count, n1 = np.zeros(len(hashes)), np.zeros(len(hashes))
        count[by], n1[by] = (np.concatenate([t[i] for t in told]) for i in (0, 1))
        base = (count + 0.1) / (tokens + 0.1 * (distinct + 1))
        p = np.where(count[u] > 0, (mass_of(codes) + D * n1[u] * base[w]) / np.maximum(count[u], 1), base[w])
        first = np.cumsum(lengths + 1) - lengths - 1
        per = lambda of: np.add.reduceat(of[bigram], first)
        return pd.DataFrame({
            "doc_id": pd.array(np.where(null > 0, None, ids.view(np.int64)), dtype="Int64"), "held_out": ~train, "n_tokens": lengths + 1,
            "n_known": per((count[w] > 0).astype(np.int64)), "train_tokens": tokens, "base_score": per(np.log10(base)[w]), "score": per(np.log10(p)),
        })

    return run


def score(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of docs(doc_id, text, ...).

    Learns from rows whose crc32(doc_id as text) mod 10 is not 0.  A null or empty text is its end alone; rows that repeat
    a doc_id are counted and scored each; a null id hashes as the empty string and stays null; other columns are ignored;
    an empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long"), (F.pmod(id_hash(), F.lit(10)) != 0).alias("train"), body().alias("text"))
    shards = max(64, 4 * rows.rdd.getNumPartitions())
    chunks = staged(rows.mapInArrow(resting(_chunks(shards)), _PART), "chunks", "kind")
    bigrams = chunks.where("kind = 0").mapInArrow(resting(_bigram_counts(shards)), _PART)
    merged = staged(bigrams.groupBy("shard").applyInPandas(_merge_bigrams, _PART), "trie", "kind")
    successors = merged.where("kind = 4").mapInPandas(_split_contexts(shards), _PART)
    words = staged(chunks.where("kind = 1").unionByName(successors).groupBy("shard").applyInPandas(_merge_words, _PART), "words", "kind")
    discard(chunks, "kind=1")
    totals = [np.frombuffer(r.data, "<i8") for r in words.where("kind = 5").select("data").collect()]  # 16 bytes a shard
    tokens, distinct = (int(sum(t[i] for t in totals)) for i in (0, 1))
    answers = merged.where("kind = 2").unionByName(words.where("kind = 1"))
    return chunks.where("kind = 0").unionByName(answers).groupBy("chunk").applyInPandas(_score(shards, tokens, distinct), _SCORE)


def op4_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
