"""Packing: shortest-pack-first over the length histogram.

Documents become pieces of at most `capacity` ids: whole stretches of capacity, then the rest.  The histogram of piece
lengths has at most capacity entries and is all the driver sees.  Lengths are placed longest first, each time into the
packs with least in them; packs with equal contents are one pattern with a count, so the work depends on the number of
lengths and not of documents.  Each length's places become runs of ranks, and pieces find theirs by their rank among the
pieces of their length.
"""

from __future__ import annotations

import gc
import json
import os
import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import body, resting, staged, table

CAPACITY = 4096
#: Pieces of one length that are numbered together, about.
SUB_ROWS = 100_000
MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
CACHE_BYTES = 24 << 20
_PIECES = "doc_id long, doc_tokens long, start long, length long, ids_crc32 long"


class StretchEncoder:
    """Ids of whole texts as little-endian unsigned 32-bit numbers.

    The tokenizer's words hold no white space and its normaliser does not work across it, so a text's ids are those of its
    stretches between white space, one after another; stretches are remembered within a bound of bytes.
    """

    def __init__(self, definition: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        specials = [t["content"] for t in json.loads(definition).get("added_tokens", [])]
        if any(len(s.split()) != 1 for s in specials):
            raise ValueError("a special token with white space reaches over stretches")
        #: How specials, for which case counts, begin.
        self.openers = tuple({s[:2] for s in specials})
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.known: dict[bytes, bytes] = {}
        self.aged: dict[bytes, bytes] = {}
        self.held = 0

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        collecting = gc.isenabled()
        gc.disable()  # nothing here makes cycles, and the caches are large
        try:
            # the normaliser lowers letters anyhow; only specials care about case
            cut, known = [t.encode().split() if self._special(t) else t.encode().lower().split() for t in texts], self.known
            fresh = set().union(*cut).difference(known)
            if fresh:
                aged = {s: self.aged[s] for s in fresh if s in self.aged}
                known |= aged
                self._encode_fresh(fresh.difference(aged))
                self.held += 130 * len(fresh) + 9 * sum(map(len, fresh))
            yield from [b"".join(map(known.__getitem__, c)) for c in cut]
            for s in [s for s in fresh if len(s) > 256]:
                del known[s]
            if self.held > CACHE_BYTES:  # what is met again within one more generation stays
                self.aged, self.known, self.held = known, {}, 0
        finally:
            if collecting:
                gc.enable()


    def _special(self, text: str) -> bool:
        """Whether a text may hold a special."""
        for o in self.openers:
            if o in text:
                return True
        return False

    def _encode_fresh(self, fresh: set[bytes]) -> None:
        """Words end where marks begin, so the marks at a stretch's end are encoded apart and its head but once."""
        known, openers = self.known, [o.encode() for o in self.openers]
        ends = {s: (head, s[len(head) :]) for s in fresh if s[-1] in MARKS and not (openers and any(o in s for o in openers)) and (head := s.rstrip(MARKS))}
        left = list({part for s in fresh for part in ends.get(s, (s,))}.difference(known))
        for s, e in zip(left, self.tokenizer.encode_batch_fast([s.decode() for s in left], add_special_tokens=False)):
            known[s] = array("I", e.ids).tobytes() if sys.byteorder == "little" else np.array(e.ids, "<u4").tobytes()
        for s, (head, tail) in ends.items():
            known[s] = known[head] + known[tail]


_kept: dict[str, StretchEncoder] = {}


def _of_worker(definition: str) -> StretchEncoder:
    if definition not in _kept:
        _kept.clear()
        _kept[definition] = StretchEncoder(definition)
    return _kept[definition]


def pieces(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, doc_tokens, start, length, ids_crc32) of every row's whole text, end_id following its last id."""
    with open(tokenizer, encoding="utf-8") as f:
        definition = f.read()
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _of_worker(definition)
        for b in batches:
            rows = []
            keys, texts, at = b.column(0).to_pylist(), b.column(1).to_pylist(), 0
            while at < len(keys):  # runs of bounded text
                until, held = at, 0
                while until < len(keys) and held < 2_000_000:
                    held += len(texts[until])
                    until += 1
                for key, ids in zip(keys[at:until], enc.encode(texts[at:until])):
                    ids += end
                    n = len(ids) // 4
                    for start in range(0, n, capacity):
                        part = ids[4 * start : 4 * (start + capacity)]
                        rows.append((key, n, start, len(part) // 4, zlib.crc32(part)))
                at = until
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)] if rows else [pa.array([], pa.int64())] * 5, ["doc_id", "doc_tokens", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), body().alias("text")).mapInArrow(resting(run), _PIECES)


def pack_histogram(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, tuple[tuple[int, int], ...]]]:
    """Patterns (count of sequences, ((length, times), ...)) that hold each length as often as the histogram says."""
    by_room: list[list[tuple[int, tuple]]] = [[] for _ in range(capacity + 1)]
    room = 0
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            while room and not by_room[room]:
                room -= 1
            if room < length:  # nothing open takes it: open sequences that hold it as often as it goes
                times = capacity // length
                whole, rest = divmod(left, times)
                for count, k in ((whole, times), (1, rest)):
                    if count and k:
                        by_room[capacity - k * length].append((count, ((length, k),)))
                        room = max(room, capacity - k * length)
                left = 0
            else:
                count, pattern = by_room[room].pop()
                taken = min(left, count)
                if count > taken:
                    by_room[room].append((count - taken, pattern))
                grown = (*pattern[:-1], (length, pattern[-1][1] + 1)) if pattern[-1][0] == length else (*pattern, (length, 1))
                by_room[room - length].append((taken, grown))
                left -= taken
    return [x for patterns in by_room for x in patterns]


def runs(patterns: list[tuple[int, tuple]]) -> np.ndarray:
    """Rows (length, first rank, sequences, first sequence, offset), by length and rank."""
    out, used, sequence = [], {}, 0
    for count, pattern in patterns:
        offset = 0
        for length, times in pattern:
            first = used.get(length, 0)
            out.append((length, first, count, sequence, offset))
            used[length] = first + count * times
            offset += length * times
        sequence += count
    return np.array(sorted(out), dtype=np.int64).reshape(-1, 5)


def place(rows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """rows(doc_id, start, length, ...) with sequence_id and offset.  rows must be a staged table: it is read three times."""
    sub = F.pmod(F.xxhash64(*(c for c in rows.columns if c != "length")), F.lit(max(64, rows.count() // SUB_ROWS)))
    counted = rows.groupBy("length", sub.alias("sub")).agg(F.count("*").alias("n"))
    before = counted.withColumn(
        "before", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("sub").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ).select("length", "sub", "before")
    histogram = {r.length: r.n for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    at = runs(pack_histogram(histogram, capacity))
    inside = Window.partitionBy("length", "sub").orderBy(*(c for c in rows.columns if c != "length"))
    ranked = rows.withColumn("sub", sub).withColumn("own", F.row_number().over(inside)).join(before, ["length", "sub"])
    ranked = ranked.select(*rows.columns, (F.col("before") + F.col("own") - 1).alias("rank"))
    keys = at[:, 0] * (1 << 46) + at[:, 1]

    def join(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            length, rank = pdf["length"].to_numpy(), pdf.pop("rank").to_numpy()
            _, first, count, sequence, offset = at[np.searchsorted(keys, length * (1 << 46) + rank, "right") - 1].T
            copy, which = np.divmod(rank - first, count)
            pdf["sequence_id"], pdf["offset"] = sequence + which, offset + copy * length
            yield pdf

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", sequence_id long, offset long"
    return ranked.mapInPandas(join, schema)


def pack(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of docs(doc_id, text, ...) with their places: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset).

    A null or empty text is its end id alone; rows that repeat a doc_id are packed each for itself; null ids stay null;
    other columns are ignored; an empty table gives no rows.  Offsets in a sequence have no gaps.
    """
    return place(staged(pieces(docs, tokenizer, end_id, capacity), "pieces"), capacity).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"
    )


def word_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op7_packing(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer or word_tokenizer())
