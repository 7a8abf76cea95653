"""Pieces that several operators share: the shared folder, staged tables, hashing, words of texts, components."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of every contract: the space and tab to carriage return.
WS = r"[\x20\x09-\x0D]+"

_own_folder: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share.  The session names it; one of our own only where it is unset (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not _own_folder:
        _own_folder.append(tempfile.mkdtemp(prefix="llm-shared-"))
    return "file://" + _own_folder[0]


def new_path(spark: SparkSession, tag: str) -> str:
    """A fresh path in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/llm/{tag}-{uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def staged(df: DataFrame, tag: str, *by: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: the lineage ends there, and lost executors cost nothing.

    Values of the columns `by` get folders of their own, so that reading some leaves the rest alone.
    """
    path = new_path(df.sparkSession, tag)
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)


def discard(df: DataFrame, only: str = "") -> None:
    """Delete the files behind a staged table that nothing reads any more, or those in folders of one value, as "kind=2"."""
    spark = df.sparkSession
    for parent in {p for f in df.inputFiles() if (p := f.rpartition("/")[0]).endswith(only)}:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(parent)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def body(text: str | Column = "text") -> Column:
    """The text, with null as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def id_hash(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text; a null id counts as the empty string."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")))


def resting(run):
    """run, a function of a task's batches, after which the worker gives freed memory back to the system: workers wait for tasks
    of their kind beside those that are at work."""

    @functools.wraps(run)
    def task(batches: Iterator) -> Iterator:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # other libraries of C have no such call
            ctypes.CDLL(None).malloc_trim(0)

    return task


# ---- texts of an Arrow batch as bytes -------------------------------------------------------------------------------
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WHITE = np.zeros(256, bool)
_WHITE[[32, 9, 10, 11, 12, 13]] = True
#: Bytes of text that are looked at together.
RUN_BYTES = 8 << 20


def raw_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an array of strings without nulls: text i is bytes[offsets[i]:offsets[i + 1]]."""
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, at, data = texts.buffers()
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    held = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return held, offsets - offsets[0]


def text_runs(texts: pa.Array, most: int = RUN_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts have about `most` bytes together; a longer text is a run of its own."""
    _, offsets = raw_bytes(texts)
    at = 0
    while at < len(texts):
        until = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, until
        at = until


def pieces_of(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """(code of each piece, distinct pieces) of bytes cut at ascending starts, the first of which is 0."""
    n = len(starts)
    offsets = np.append(starts, len(data)).astype(np.int64)
    array = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])
    coded = array.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary


def coded_words(texts: pa.Array) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """(codes, distinct words, offsets): words `[^\x20\x09-\x0D]+` of texts with A-Z in lower case; those of text i are
    codes[offsets[i]:offsets[i + 1]]."""
    data, rows = raw_bytes(texts)
    white = _WHITE[data]
    start = ~white
    inside = start.copy()
    start[1:] &= white[:-1]
    first = rows[:-1][rows[:-1] < len(data)]
    start[first] = inside[first]
    at = np.flatnonzero(start)
    if not len(at):
        return np.zeros(0, np.int32), [], np.zeros(len(rows), np.int64)
    kept = np.cumsum(inside, dtype=np.int64)[at] - 1
    codes, distinct = pieces_of(_LOWER[data[inside]], kept)
    return codes, distinct.to_pylist(), np.searchsorted(at, rows)


#: Edges that one task contracts at a time.
PART = 400_000


def _contract(edges: DataFrame, parts: int) -> DataFrame:
    """Edges (u, v) replaced, part by part, by edges of every node to the smallest of its component in the part."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (p := parent.setdefault(x, x)) != x:
                parent[x] = x = parent.setdefault(p, p)
            return x

        for pdf in frames:
            for a, b in zip(pdf["u"].tolist(), pdf["v"].tolist()):
                p, q = root(a), root(b)
                if p != q:
                    parent[max(p, q)] = min(p, q)
        pairs = [(x, root(x)) for x in list(parent)]
        yield pd.DataFrame([(x, r) for x, r in pairs if x != r], columns=["u", "v"], dtype="int64")

    return edges.repartition(parts).mapInPandas(run, "u long, v long")


def components(edges: DataFrame, max_rounds: int = 60, part: int = PART) -> DataFrame:
    """Connected components of edges(a, b) as rows (node, component), component being the smallest reachable node.

    Edges are first contracted in parts of bounded size, again and again while that shrinks them, which ends the matter once
    they fit one part.  Else large-star and small-star steps alternate, so paths shrink geometrically and a round moves
    each edge once.  A hub is grouped by its neighbours' minimum with map-side partial aggregation and joined back as an
    equi-join, so a hub with very many neighbours never has to fit into one task.  Rounds are staged in the shared folder.
    Nodes without edges are not returned; an empty input gives no rows.
    """
    current = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), "edges")
    n = current.count()
    while True:
        fits = n <= part
        following = staged(_contract(current, max(1, -(-n // part))), "edges")
        discard(current)
        current, before, n = following, n, following.count()
        if fits or n > 0.8 * before:
            break
    if not fits:
        current = _stars(current, max_rounds)
    out = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return out.union(current.select("v", "v").distinct().toDF("node", "component"))


def _stars(current: DataFrame, max_rounds: int) -> DataFrame:
    before = _total(current)
    for _ in range(max_rounds):
        both = current.union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: every larger neighbour of u moves to the smallest node of u's neighbourhood
        large = both.join(lowest, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: every smaller neighbour of u, and u, move to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = (
            joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(least.select("u", F.col("m").alias("v")))
            .where("u <> v").distinct()
        )
        following = staged(small, "edges")
        after = _total(following)
        discard(current)
        current = following
        if after == before:
            return current
        before = after
    raise RuntimeError("components did not settle")


def _total(edges: DataFrame) -> tuple:
    """What tells two rounds apart: the count of edges and an order-free digest of them."""
    row = edges.agg(
        F.count("*").alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("x"), F.expr("sum(cast(xxhash64(v, u) as decimal(38)))").alias("s")
    ).first()
    return row.n, row.x, row.s
