"""BPE encoding and decoding over a prefix-sharing trie of the distinct words.

In an encoding by ranked merges the last token of every prefix fixes the encoding of that prefix: remove it, and what is
left is the encoding of a shorter prefix.  So a word's state is one token per byte: the longest token that ends there and
may follow the last token of what precedes it.  Two tokens may follow one another if, of the pieces that the merges of
either leave standing at their common border, no two would have merged with each other first.

Distinct words are walked in sorted order, which is a depth-first walk of their trie: what a word shares with the one
before it keeps its states, so each shared prefix is worked out once.
"""

from __future__ import annotations

import gc
import hashlib
import json
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import body, pieces_of, raw_bytes, resting, table, text_runs

#: Fixed value: how byte-level vocabularies of this family split text before merging.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Stretches and words remembered in one generation, some 250 and 150 bytes each; longer ones than LONG are not.
KEPT_STRETCHES, KEPT_WORDS = 300_000, 300_000
LONG = 256
WINDOW = 6
MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_ASCII_WHITE = np.zeros(256, bool)
_ASCII_WHITE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
#: White space beyond U+0085 and U+00A0.
_WIDE_WHITE = np.array([0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000], np.int32)
_LEADS = np.zeros(256, bool)
_LEADS[[0xC2, 0xE1, 0xE2, 0xE3]] = True


def byte_of_letter() -> dict[str, int]:
    """The printable letters that stand for bytes: printable Latin-1 for themselves, the others from U+0100 on in order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tokens, merges and specials of a byte-level BPE file of the tokenizers library."""

    def __init__(self, definition: str):
        spec = json.loads(definition)
        letters = byte_of_letter()
        raw = lambda s: bytes(letters[c] for c in s)
        self.ids = {raw(k): v for k, v in spec["model"]["vocab"].items()}
        self.bytes = {v: k for k, v in self.ids.items()}
        self.specials = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes |= {v: k.encode() for k, v in self.specials.items()}
        self.rank: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int, int]] = {}
        for r, m in enumerate(spec["model"]["merges"]):
            left, right = m if isinstance(m, list) else m.split(" ")
            a, b = self.ids[raw(left)], self.ids[raw(right)]
            self.rank[a, b] = r
            self.halves.setdefault(self.ids[raw(left + right)], (a, b, r))
        self.longer: dict[bytes, list[tuple[int, int, bytes]]] = {}
        for token, i in sorted(self.ids.items(), key=lambda x: -len(x[0])):
            if len(token) > WINDOW:
                self.longer.setdefault(token[-WINDOW:], []).append((len(token), i, token))
        self.edge = lru_cache(None)(self._edge)
        self.ends: dict[bytes, list[tuple[int, int, bytes | None]]] = {}
        self.pairs: dict[int, bool] = {}

    def _edge(self, token: int, side: int) -> list[tuple[int, float]]:
        """The pieces of token at its left (0) or right (1) edge, each with the rank of the merge that takes it up."""
        out, until = [], float("inf")
        while True:
            out.append((token, until))
            if token not in self.halves:
                return out
            *parts, until = self.halves[token]
            token = parts[side]

    def may_follow(self, left: int, right: int) -> bool:
        for a, a_until in self.edge(left, 1):
            for b, b_until in self.edge(right, 0):
                r = self.rank.get((a, b))
                # of equal merges the one further left goes first
                if r is not None and r < a_until and r <= b_until:
                    return False
        return True

    def ending(self, window: bytes) -> list[tuple[int, int, bytes | None]]:
        """Tokens that can end with window, longest first: (length, id, the bytes to compare if longer than window)."""
        if len(self.ends) > 500_000:
            self.ends.clear()
        shorter = [(n, self.ids[window[-n:]], None) for n in range(len(window), 0, -1) if window[-n:] in self.ids]
        found = self.ends[window] = [*(self.longer.get(window, []) if len(window) == WINDOW else ()), *shorter]
        return found


class TrieEncoder:
    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary

    def encode_words(self, words: Iterable[bytes]) -> Iterator[tuple[bytes, list[int]]]:
        ends, ending, pairs, may_follow = self.v.ends, self.v.ending, self.v.pairs, self.v.may_follow
        if len(pairs) > 500_000:
            pairs.clear()
        path, last, size = b"", [], []  # the states along the path: last token and its length, for every prefix
        for word in sorted(words):
            n, shared, most = len(word), 0, min(len(word), len(path))
            while shared < most and word[shared] == path[shared]:
                shared += 1
            del last[shared:], size[shared:]
            for end in range(shared + 1, n + 1):
                window = word[end - WINDOW if end > WINDOW else 0 : end]
                for length, token, whole in ends.get(window) or ending(window):
                    if whole is not None and not word.endswith(whole, 0, end):
                        continue
                    if length < end:
                        pair = last[end - length - 1] << 20 | token
                        may = pairs.get(pair)
                        if may is None:
                            may = pairs[pair] = may_follow(last[end - length - 1], token)
                        if not may:
                            continue
                    last.append(token)
                    size.append(length)
                    break
                else:
                    raise ValueError("the vocabulary lacks a byte")
            path = word
            out, at = [], n
            while at:
                out.append(last[at - 1])
                at -= size[at - 1]
            yield word, out[::-1]


class TextEncoder:
    """Whole texts, cut into stretches; what stretches and words give is remembered for two generations of bounded size.

    make turns a word's ids into a tuple of what is kept for it; a stretch of several words has the sums of their parts.
    """

    def __init__(self, definition: str, make=lambda ids: (tuple(ids),)):
        self.v = Vocabulary(definition)
        self.trie = TrieEncoder(self.v)
        self.split = regex.compile(SPLIT)
        self.specials = {s.encode(): i for s, i in self.v.specials.items()}
        self.special = re.compile(b"|".join(map(re.escape, sorted(self.specials, key=len, reverse=True)))) if self.specials else None
        self.make = make
        self.stretches, self.words = Generations(KEPT_STRETCHES), Generations(KEPT_WORDS)

    def cut(self, texts: pa.Array) -> tuple[np.ndarray, list[bytes], np.ndarray]:
        """(codes, distinct stretches, offsets): text i is made up of the stretches codes[offsets[i]:offsets[i + 1]].

        A space between two visible characters starts a pre-token and a newline there is one, so texts are cut before
        either; specials are stretches of their own.
        """
        data, rows = raw_bytes(texts)
        if not len(data):
            return np.zeros(0, np.int32), [], np.zeros(len(rows), np.int64)
        white = _white(data)
        edges = rows[:-1][np.diff(rows) > 0]
        first = np.zeros(len(data), bool)
        first[edges] = True
        apart = []
        if self.special:
            apart = [m.span() for m in self.special.finditer(data.tobytes()) if not first[m.start() + 1 : m.end()].any()]
            for lo, hi in apart:
                white[lo:hi] = True
        at = np.flatnonzero((data == 32) | (data == 10))
        at = at[(at > 0) & (at < len(data) - 1)]
        at = at[~white[at - 1] & ~white[at + 1] & ~first[at] & ~first[at + 1]]
        first[at] = True
        for lo, hi in apart:
            first[lo] = True
            if hi < len(data):
                first[hi] = True
        starts = np.flatnonzero(first)
        codes, distinct = pieces_of(data, starts)
        return codes, distinct.to_pylist(), np.searchsorted(starts, rows)

    def made(self, distinct: list[bytes]) -> list:
        """What is made for each of distinct stretches."""
        collecting = gc.isenabled()
        gc.disable()  # nothing here makes cycles, and the caches are large
        try:
            known = self.stretches.find(distinct)
            self._encode_fresh([s for s in distinct if s not in known], known)
            out = [known[s] for s in distinct]
            self.stretches.turn(s for s in distinct if len(s) > LONG)
            return out
        finally:
            if collecting:
                gc.enable()

    def _words(self, stretch: bytes) -> list[bytes]:
        """The pre-tokens of a stretch; those of a space, ASCII letters and marks after them need no pattern."""
        head = stretch.rstrip(MARKS)
        if head.isalpha() or head[:1] == b" " and head[1:].isalpha():
            return [head, stretch[len(head) :]] if len(head) < len(stretch) else [stretch]
        return [w.encode() for w in self.split.findall(stretch.decode())]

    def _encode_fresh(self, fresh: list[bytes], known: dict) -> None:
        make = self.make
        for s in [s for s in fresh if s in self.specials]:
            known[s] = make((self.specials[s],))
        cut = {s: self._words(s) for s in fresh if s not in self.specials}
        made = self.words.find(wanted := set().union(*cut.values()))
        # one walk over the trie of all words that are new
        for word, ids in self.trie.encode_words(wanted.difference(made)):
            made[word] = make(ids)
        for s, ws in cut.items():
            out = made[ws[0]]
            for w in ws[1:]:
                out = tuple([a + b for a, b in zip(out, made[w])])
            known[s] = out
        self.words.turn(w for w in wanted if len(w) > LONG)

    def encode(self, texts: list[str]) -> list[list]:
        """For each text the first part of what was made for each of its stretches, in order."""
        codes, distinct, rows = self.cut(pa.array(texts, pa.large_string()))
        made = self.made(distinct)
        return [[made[c][0] for c in codes[a:b]] for a, b in zip(rows, rows[1:])]

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.v.bytes.__getitem__, ids)).decode("utf-8", "replace")


class Generations:
    """A memory of two generations: what is not met again within one more generation is forgotten."""

    def __init__(self, most: int):
        self.most, self.young, self.old = most, {}, {}

    def find(self, keys: Iterable) -> dict:
        """The memory, in which those of keys that are known can be found."""
        young, old = self.young, self.old
        if old:
            young.update((k, old[k]) for k in keys if k in old and k not in young)
        return young

    def turn(self, long: Iterable) -> None:
        for k in long:
            self.young.pop(k, None)
        if len(self.young) > self.most:
            self.old, self.young = self.young, {}


def _white(data: np.ndarray) -> np.ndarray:
    """Which bytes belong to white space as \\s sees it in UTF-8."""
    out = _ASCII_WHITE[data]
    at = np.flatnonzero(_LEADS[data])
    if len(at):
        at = at[at < len(data) - 1]
        two = at[(data[at] == 0xC2) & ((data[at + 1] == 0x85) | (data[at + 1] == 0xA0))]
        out[two] = out[two + 1] = True
        at = at[(data[at] != 0xC2) & (at < len(data) - 2)]
        code = (data[at].astype(np.int32) & 15) << 12 | (data[at + 1].astype(np.int32) & 63) << 6 | (data[at + 2] & 63)
        three = at[np.isin(code, _WIDE_WHITE)]
        out[three] = out[three + 1] = out[three + 2] = True
    return out


def _definition(tokenizer: str) -> str:
    with open(tokenizer, encoding="utf-8") as f:
        return f.read()


def encode(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, ids array<int>) of every row's whole text; null and empty texts have no ids.

    Repeated rows give a row each, other columns are ignored, an empty table gives no rows.  The tokenizer's file is read
    once on the driver.
    """
    definition = _definition(tokenizer)

    def run(batches):
        enc = TextEncoder(definition, lambda ids: (array("i", ids).tobytes(),))
        for b in batches:
            for lo, hi in text_runs(b.column(1)):
                codes, distinct, rows = enc.cut(b.column(1).slice(lo, hi - lo))
                ends, data = _joined([m[0] for m in enc.made(distinct)], codes, rows)
                ids = pa.ListArray.from_arrays(pa.array(ends // 4, pa.int32()), pa.array(np.frombuffer(data, np.int32), pa.int32()))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), ids], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), body().alias("text")).mapInArrow(resting(run), "doc_id long, ids array<int>")


def decode(rows: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids); null ids count as none, specials come out as their strings."""
    definition = _definition(tokenizer)

    def run(batches):
        enc = TextEncoder(definition)
        for b in batches:
            texts = [enc.decode(x or ()) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, text string")


def _joined(parts: list[bytes], codes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, memoryview]:
    """(offsets, bytes) of each row's parts, one after another: row i has bytes[offsets[i]:offsets[i + 1]]."""
    if not len(codes):
        return np.zeros(len(rows), np.int64), memoryview(b"")
    data, ends = raw_bytes(pa.array(parts, pa.large_binary()).take(pa.array(codes)))
    return ends[rows], memoryview(data)


_kept: dict[str, TextEncoder] = {}


def _of_worker(definition: str) -> TextEncoder:
    """The encoder that a Python worker keeps from task to task; its words give (n ids, ids as text, decoded bytes)."""
    if definition not in _kept:
        _kept.clear()
        enc = TextEncoder(definition)
        digits = {i: f"{i},".encode() for i in enc.v.bytes}
        enc.make = lambda ids: (len(ids), b"".join(map(digits.__getitem__, ids)), b"".join(map(enc.v.bytes.__getitem__, ids)))
        _kept[definition] = enc
    return _kept[definition]


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encode(), then decode(), digested where they are made.

    Rows as in encode(); the digests spare sending some 2.5 ids a word to the JVM and back.
    """
    definition = _definition(tokenizer)

    def run(batches):
        enc = _of_worker(definition)
        for b in batches:
            for lo, hi in text_runs(b.column(1)):
                codes, distinct, rows = enc.cut(b.column(1).slice(lo, hi - lo))
                n, shown, decoded = zip(*enc.made(distinct)) if distinct else ((), (), ())
                total = np.append(0, np.cumsum(np.array(n, np.int64)[codes]))[rows]
                at, ids = _joined(shown, codes, rows)
                a = [hashlib.sha256(ids[i : max(i, j - 1)]).hexdigest() for i, j in zip(at, at[1:])]  # without the last comma
                at, ids = _joined(decoded, codes, rows)
                d = [hashlib.sha256(str(ids[i:j], "utf-8", "replace").encode()).hexdigest() for i, j in zip(at, at[1:])]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo), pa.array(np.diff(total), pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return docs.select(F.col("doc_id").cast("long"), body().alias("text")).mapInArrow(
        resting(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )


def op2_bpe(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    return round_trip(table(spark, sf_dir, "documents"), tokenizer)
