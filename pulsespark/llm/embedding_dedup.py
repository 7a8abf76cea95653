"""Embedding near-dedup by sorted projection passes and an exact sweep of what they leave apart.

Each pass hashes every vector to signs of random projections, all bits in one string, and sorts by it, so similar vectors
with a common prefix lie near one another.  Each vector is compared with a bounded window of neighbours in the order; pairs
with a cosine of at least the threshold, in double precision, are united across the passes.  The passes miss pairs that
never fall into a window, the more the denser the vectors lie, so they only prepare: then every vector meets every other,
block against block, and a link between two components unites them.  Since the components then hold all links, the links
inside each component are counted exactly, again block against block, without writing pairs out.

The sweep multiplies in single precision, with a margin that covers its rounding, and decides what passes that in double
precision.  Its time grows with the square of the table; pairs whose components are one already cost the product only.  Equal
vectors are taken together, so a hot vector is one.
Tests compare with brute force.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import components, discard, staged, table

PASSES = 32
WINDOW = 64
BITS = 63
BLOCK = 4096
#: Bytes of vectors that the sweep sends to all tasks at a time, and the sides of a product.
SWEEP = 16 << 20
TILE = (256, 4096)
_EPS = 1e-12


def _matrix(column) -> np.ndarray:
    return np.stack([np.frombuffer(x, "<f8") for x in column])


def unit_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, unit binary) of vectors that can link: not null, not zero, all components finite, with an id.

    Vectors are scaled to length 1 in double precision, by their largest component first so that squares neither overflow
    nor vanish.  Rows of one vec_id count once, as the first by their bytes.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for key, v in zip(pdf["vec_id"], pdf["embedding"]):
                v = np.array([np.nan if c is None else c for c in v], np.float64) if v is not None else np.zeros(0)
                top = np.abs(v).max(initial=0.0)
                if np.isfinite(top) and top > 0:
                    v = v / top
                    out.append((key, (v / np.sqrt(v @ v)).astype("<f8").tobytes()))
            yield pd.DataFrame(out, columns=["vec_id", "unit"])

    rows = vectors.where("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.mapInPandas(run, "vec_id long, unit binary").groupBy("vec_id").agg(F.min("unit").alias("unit"))


def _united(ids: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Edges (member, smallest member) of the components of the pairs a, b (positions in ids)."""
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y in zip(a.tolist(), b.tolist()):
        p, q = root(x), root(y)
        if p != q:
            if ids[q] < ids[p]:
                p, q = q, p
            parent[q] = p
    return [(int(ids[x]), int(ids[root(x)])) for x in list(parent) if root(x) != x]


def candidate_links(units: DataFrame, threshold: float, passes: int = PASSES, window: int = WINDOW, seed: int = 11) -> DataFrame:
    """Verified links (a, b) that span the components found in the passes' windows."""

    def keys(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        planes: dict[int, np.ndarray] = {}
        for pdf in frames:
            for size, part in pdf.groupby(pdf["unit"].str.len() // 8):
                if size not in planes:
                    planes[size] = np.random.default_rng([seed, int(size)]).standard_normal((int(size), passes * BITS)).astype(np.float32)
                for at in range(0, len(part), 2000):
                    some = part.iloc[at : at + 2000]
                    signs = (_matrix(some["unit"]).astype(np.float32) @ planes[size] > 0).reshape(len(some), passes, BITS)
                    code = signs.astype(np.int64) @ (np.int64(1) << np.arange(BITS - 1, -1, -1, dtype=np.int64))
                    yield pd.DataFrame({
                        "vec_id": np.repeat(some["vec_id"].to_numpy(), passes), "pass": np.tile(np.arange(passes), len(some)), "code": code.ravel(),
                        "dims": int(size),
                    })

    coded = staged(units.mapInPandas(keys, "vec_id long, pass int, code long, dims int"), "codes")
    # ranks in each pass's order: sorted in ranges, numbered inside each, with the counts of the ranges before
    ordered = coded.repartitionByRange("pass", "dims", "code", "vec_id").withColumn("pid", F.spark_partition_id()).sortWithinPartitions("pass", "dims", "code", "vec_id")

    def number(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = 0
        for pdf in frames:
            pdf["own"] = np.arange(at, at + len(pdf))
            at += len(pdf)
            yield pdf

    placed = staged(ordered.mapInPandas(number, "vec_id long, pass int, code long, dims int, pid int, own long"), "placed")
    sizes = placed.groupBy("pid").agg(F.count("*").alias("n"))  # a row a partition
    before = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    block = 1024
    rank = placed.join(F.broadcast(before.select("pid", "before")), "pid").select("vec_id", "pass", "dims", (F.col("own") + F.col("before")).alias("rank"))
    # a row also goes to the next block when it lies within a window of it
    cells = rank.withColumn("cell", F.explode(F.expr(f"array_distinct(array(rank div {block}, (rank + {window}) div {block}))")))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank")
        edges = []
        for _, part in pdf.groupby(["pass", "dims"], sort=False):
            ids, v = part["vec_id"].to_numpy(), _matrix(part["unit"])
            a, b = [], []
            for step in range(1, min(window, len(part) - 1) + 1):
                hit = np.flatnonzero(np.einsum("ij,ij->i", v[:-step], v[step:]) >= threshold - _EPS)
                a.append(hit)
                b.append(hit + step)
            if a:
                edges += _united(ids, np.concatenate(a), np.concatenate(b))
        return pd.DataFrame(edges, columns=["a", "b"])

    found = cells.join(units, "vec_id").groupBy("cell").applyInPandas(compare, "a long, b long")
    out = staged(found.distinct(), "links")
    discard(coded)
    discard(placed)
    return out


def missed_links(units: DataFrame, label: DataFrame, threshold: float, size: int) -> DataFrame:
    """Links (a, b) that unite components(node, component) with one another, of all pairs of vectors.

    The vectors are dealt into parts of about `size` bytes; part after part is sent to the tasks, which compare it with
    its own and the later parts, so each pair meets once.
    """
    spark = units.sparkSession
    total = units.agg(F.sum(F.length("unit"))).first()[0] or 0
    parts, tasks = max(1, -(-total // size)), max(2 * spark.sparkContext.defaultParallelism, total >> 22)
    marked = units.join(label.withColumnRenamed("node", "vec_id"), "vec_id", "left").withColumn("component", F.coalesce("component", "vec_id"))
    dealt = staged(marked.select("component", "unit", F.expr(f"pmod(xxhash64(vec_id), {parts})").alias("part")).repartition(tasks), "dealt")

    def sweep(sent):
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            high, wide = TILE
            for pdf in frames:
                for dims, rows in pdf.groupby(pdf["unit"].str.len() // 8):
                    if dims not in sent.value:
                        continue
                    theirs, w, w32 = sent.value[dims]
                    ours, v = rows["component"].to_numpy(), _matrix(rows["unit"])
                    v32, least = v.astype(np.float32), np.float32(threshold - _EPS - (int(dims) + 4) * 2.0**-23)
                    found = []
                    for i in range(0, len(v), high):
                        for j in range(0, len(w), wide):
                            near = v32[i : i + high] @ w32[j : j + wide].T
                            if near.max() < least:
                                continue
                            x, y = np.nonzero((near >= least) & (ours[i : i + high, None] != theirs[None, j : j + wide]))
                            for at in range(0, len(x), 1 << 15):
                                p, q = x[at : at + (1 << 15)] + i, y[at : at + (1 << 15)] + j
                                hit = np.einsum("ij,ij->i", v[p], w[q]) >= threshold - _EPS
                                found.append(np.unique(np.stack([ours[p[hit]], theirs[q[hit]]]), axis=1))
                    if found:
                        ids, at = np.unique(np.concatenate(found, axis=1), return_inverse=True)
                        at = at.reshape(2, -1)
                        yield pd.DataFrame(_united(ids, at[0], at[1]), columns=["a", "b"], dtype="int64")

        return run

    out = None
    for part in range(parts):
        rows = dealt.where(F.col("part") == part).toPandas()
        held = {}
        for dims, some in rows.groupby(rows["unit"].str.len() // 8):
            w = _matrix(some["unit"])
            held[int(dims)] = (some["component"].to_numpy(), w, w.astype(np.float32))
        sent = spark.sparkContext.broadcast(held)
        links = staged(dealt.where(F.col("part") >= part).mapInPandas(sweep(sent), "a long, b long"), "missed")
        sent.destroy()
        out = links if out is None else out.union(links)
    discard(dealt)
    return out


def link_counts(units: DataFrame, label: DataFrame, threshold: float) -> DataFrame:
    """(vec_id, n_links) of members of components(node, component), units having n copies each: every pair of a component
    counts, block by block, and a vector's own copies but for itself."""
    member = units.join(label.select(F.col("node").alias("vec_id"), "component"), "vec_id")
    sizes = member.groupBy("component").agg(F.count("*").alias("members"))
    # a component has a block for every BLOCK members, and each block meets each
    dealt = member.join(sizes, "component").withColumn("blocks", F.expr(f"cast(ceil(members / {BLOCK}) as int)")).withColumn("mine", F.expr("pmod(xxhash64(vec_id), blocks)"))
    left = dealt.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)"))).select("component", F.col("mine").alias("p"), F.col("other").alias("q"), "vec_id", "n", "unit", F.lit(0).alias("side"))
    right = dealt.where("blocks > 1").withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)"))).where("other <> mine").select(
        "component", F.col("other").alias("p"), F.col("mine").alias("q"), "vec_id", "n", "unit", F.lit(1).alias("side")
    )

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf[pdf["side"] == 0]
        others = own if int(pdf["p"].iloc[0]) == int(pdf["q"].iloc[0]) else pdf[pdf["side"] == 1]
        if not len(own) or not len(others):
            return pd.DataFrame({"vec_id": pd.Series([], dtype="int64"), "n": pd.Series([], dtype="int64")})
        a, b, copies = _matrix(own["unit"]), _matrix(others["unit"]), others["n"].to_numpy()
        n = np.zeros(len(a), np.int64)
        for at in range(0, len(b), 512):
            n += (a @ b[at : at + 512].T >= threshold - _EPS) @ copies[at : at + 512]
        return pd.DataFrame({"vec_id": own["vec_id"].to_numpy(), "n": n})

    counted = left.unionByName(right).groupBy("component", "p", "q").applyInPandas(count, "vec_id long, n long")
    return counted.groupBy("vec_id").agg((F.sum("n") - 1).alias("n_links"))


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, passes: int = PASSES, window: int = WINDOW) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of vectors(vec_id, embedding, ...).

    Vectors that are null, empty or zero or hold null or non-finite components link with nothing and are their own
    component; so are vectors of another length than the rest, but among themselves.  Rows that repeat a vec_id count once
    for links and come out as often as they came in; null ids have null components and kept = false.  Other columns are
    ignored; an empty table gives no rows.
    """
    every = staged(unit_vectors(vectors), "vectors")
    # equal vectors are one, with a number of copies
    units = staged(every.groupBy("unit").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("n")), "units")
    links = candidate_links(units, threshold, passes, window)
    label = staged(components(links), "labels")
    missed = missed_links(units, label, threshold, SWEEP)
    if not missed.isEmpty():
        label = staged(components(links.union(missed)), "labels")
    counts = link_counts(units, label, threshold)
    told = units.join(label.withColumnRenamed("node", "vec_id"), "vec_id", "left").join(counts, "vec_id", "left")
    told = told.select("unit", F.coalesce("component", "vec_id").alias("component"), F.coalesce("n_links", F.col("n") - 1).alias("n_links"))
    found = every.join(told, "unit").select("vec_id", "component", "n_links")
    out = vectors.select(F.col("vec_id").cast("long")).join(found, "vec_id", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(False)).alias("kept"))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


OP10_SQL = """
WITH RECURSIVE e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.9),
r(a, b) AS (SELECT vec_id, vec_id FROM e UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
m AS (SELECT a, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM e JOIN m ON m.a = vec_id LEFT JOIN n ON n.a = vec_id
"""
