"""Exact dedup: static binary-fuse filters over an immutable snapshot screen the digests of an incoming batch.

A snapshot is a table of distinct texts (digest, text, first_id, n_rows) with one filter per digest bucket.  A batch is
first grouped within itself, which map-side aggregation by (digest, text) makes proof against huge groups of copies and
compares bytes; then its distinct digests pass the filters, and only positives join the exact buckets, where the texts'
bytes decide.  A filter never misses a member, so a negative is new for certain.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WS, body, id_hash, staged, table

#: Digests of a snapshot in one filter, about.
FILTER_ROWS = 100_000


def normalised(text: str | Column = "text") -> Column:
    return F.regexp_replace(body(text), WS, " ")


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


# ---- the filter -----------------------------------------------------------------------------------------------------
def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = keys + np.uint64((seed * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return h ^ (h >> np.uint64(33))


def _slots(hashes: np.ndarray, segment: int, segments: int) -> np.ndarray:
    """Three slots in three consecutive segments, and so near one another in memory."""
    first = ((hashes >> np.uint64(32)) * np.uint64(segments)) >> np.uint64(32)
    low = np.uint64(segment - 1)
    offsets = (hashes & low, (hashes >> np.uint64(18)) & low, (hashes >> np.uint64(36)) & low)
    return np.stack([(first + np.uint64(i)) * np.uint64(segment) + o for i, o in enumerate(offsets)]).astype(np.int64)


def _print(hashes: np.ndarray) -> np.ndarray:
    return ((hashes ^ (hashes >> np.uint64(32))) & np.uint64(0xFFFF)).astype(np.uint16)


def fuse_build(keys: np.ndarray) -> tuple[int, int, int, bytes]:
    """(seed, segment length, segments, fingerprints) of a 3-wise binary-fuse filter over distinct 64-bit keys."""
    n = len(keys)
    segment = 1 << max(2, int(np.log(max(n, 2)) / np.log(3.33) + 2.25))
    room = int(n * max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 2)))) + segment
    segments = max(1, -(-room // segment) - 2)
    size = (segments + 2) * segment
    for seed in range(1, 200):
        hashes = _mix(keys, seed)
        slots = _slots(hashes, segment, segments)
        count, owners = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for row in slots:
            np.add.at(count, row, 1)
            np.bitwise_xor.at(owners, row, np.arange(n))
        alive, rounds = np.ones(n, bool), []
        while True:  # peel in rounds: slots that one key alone uses give that key its place
            single = np.flatnonzero(count == 1)
            key, at = np.unique(owners[single], return_index=True)
            if not len(key):
                break
            rounds.append((key, single[at]))
            alive[key] = False
            for row in slots[:, key]:
                np.subtract.at(count, row, 1)
                np.bitwise_xor.at(owners, row, key)
        if not alive.any():
            table_, prints = np.zeros(size, np.uint16), _print(hashes)
            for key, slot in reversed(rounds):  # a round's own slots are zero still, so all three may be folded in
                a, b, c = slots[:, key]
                table_[slot] = prints[key] ^ table_[a] ^ table_[b] ^ table_[c]
            return seed, segment, segments, table_.tobytes()
    raise RuntimeError("no seed gives a filter: are the keys distinct?")


def fuse_contains(keys: np.ndarray, seed: int, segment: int, segments: int, prints: bytes) -> np.ndarray:
    hashes = _mix(keys, seed)
    a, b, c = _slots(hashes, segment, segments)
    held = np.frombuffer(prints, np.uint16)
    return held[a] ^ held[b] ^ held[c] ^ _print(hashes) == 0


def _keys(digests: pd.Series) -> np.ndarray:
    """64 bits of each digest; a digest shorter than that is padded."""
    return np.array([int(d[-16:].ljust(16, "0"), 16) for d in digests], dtype=np.uint64)


# ---- tables ---------------------------------------------------------------------------------------------------------
def group_batch(docs: DataFrame, digest=sha256) -> DataFrame:
    """The distinct normalised texts of docs(doc_id, text) as (digest, text, first_id, n_rows)."""
    rows = docs.select("doc_id", normalised().alias("text")).select("doc_id", "text", digest(F.col("text")).alias("digest"))
    return rows.groupBy("digest", "text").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n_rows"))


def _bucketed(rows: DataFrame, buckets: int) -> DataFrame:
    return rows.select("digest").distinct().select("digest", F.pmod(F.xxhash64("digest"), F.lit(buckets)).cast("int").alias("bucket"))


def build_filters(snapshot: DataFrame, buckets: int) -> DataFrame:
    """One immutable filter for each of so many buckets of digests: (bucket, seed, segment, segments, prints)."""

    def build(key, pdf):
        return pd.DataFrame([(key[0], *fuse_build(np.unique(_keys(pdf["digest"]))))], columns=["bucket", "seed", "segment", "segments", "prints"])

    return _bucketed(snapshot, buckets).groupBy("bucket").applyInPandas(build, "bucket int, seed int, segment int, segments int, prints binary")


def screen(incoming: DataFrame, filters: DataFrame, buckets: int) -> DataFrame:
    """The digests of incoming(digest, ...) that the filters of so many buckets cannot rule out."""

    def probe(key, left, right):
        if not len(right) or not len(left):
            return left[["digest"]].iloc[:0]
        f = right.iloc[0]
        return left[["digest"]][fuse_contains(_keys(left["digest"]), int(f.seed), int(f.segment), int(f.segments), f.prints)]

    return _bucketed(incoming, buckets).groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInPandas(probe, "digest string")


def dedup_against(snapshot: DataFrame, filters: DataFrame, incoming: DataFrame, buckets: int) -> DataFrame:
    """Texts of incoming that snapshot holds: (digest, first_id, held_id), the bytes having been compared."""
    maybe = screen(incoming, filters, buckets)
    suspects = incoming.join(maybe, "digest", "left_semi").select("digest", "text", "first_id")
    exact = snapshot.select("digest", F.col("text").alias("held_text"), F.col("first_id").alias("held_id"))
    return suspects.join(exact, "digest").where("text = held_text").select("digest", "first_id", "held_id")


def exact_groups(docs: DataFrame, digest=sha256) -> DataFrame:
    """Rows (doc_id, keep_id, group_size, kept, text_sha256) for every row of docs(doc_id, text, ...).

    docs comes in as two batches, by the parity of the ids' crc32: the first becomes the snapshot, the second is screened
    against it.  Null texts count as empty and empty texts equal each other; rows that repeat a doc_id are rows of
    their own and all are kept or dropped together; null ids lose to any id, and a group of null ids only keeps null
    and kept = false there.  Other columns are ignored.  An empty table gives no rows.  Two texts that share a digest
    are told apart by their bytes.
    """
    docs = docs.select("doc_id", "text")
    old = F.pmod(id_hash(), F.lit(2)) == 0
    snapshot = staged(group_batch(docs.where(old), digest), "snapshot")
    incoming = staged(group_batch(docs.where(~old), digest), "incoming")
    buckets = max(256, snapshot.count() // FILTER_ROWS)
    filters = staged(build_filters(snapshot, buckets), "filters")
    matches = dedup_against(snapshot, filters, incoming, buckets)
    anchor = lambda c: F.coalesce(F.col(c), F.lit(-(2**63)))
    after = incoming.select("digest", "first_id", "n_rows", anchor("first_id").alias("own")).join(
        matches.select("digest", anchor("first_id").alias("own"), F.lit(True).alias("held"), anchor("held_id").alias("other")), ["digest", "own"], "left"
    )
    parts = snapshot.select("digest", "first_id", "n_rows", F.lit(0).alias("side"), anchor("first_id").alias("anchor")).unionByName(
        after.select(
            "digest", "first_id", "n_rows",
            F.when(F.col("held"), F.lit(0)).otherwise(1).alias("side"), F.when(F.col("held"), F.col("other")).otherwise(F.col("own")).alias("anchor"),
        )
    )
    groups = staged(parts.groupBy("digest", "side", "anchor").agg(F.min("first_id").alias("keep_id"), F.sum("n_rows").alias("group_size")), "groups")
    clashing = groups.groupBy("digest").count().where("count > 1").select("digest")
    text = normalised()
    rows = docs.select("doc_id", text.alias("text")).select("doc_id", "text", digest(F.col("text")).alias("digest"))
    if clashing.isEmpty():
        out = rows.join(groups.select("digest", "keep_id", "group_size"), "digest")
        out = out.select("doc_id", "keep_id", "group_size", (F.col("digest") if digest is sha256 else sha256(F.col("text"))).alias("text_sha256"))
    else:
        known = snapshot.select("digest", "text", F.lit(0).alias("side"), anchor("first_id").alias("anchor")).unionByName(
            incoming.select("digest", "text", anchor("first_id").alias("own")).join(
                matches.select("digest", anchor("first_id").alias("own"), F.lit(True).alias("held"), anchor("held_id").alias("other")), ["digest", "own"], "left"
            ).select("digest", "text", F.when(F.col("held"), F.lit(0)).otherwise(1).alias("side"), F.when(F.col("held"), F.col("other")).otherwise(F.col("own")).alias("anchor"))
        ).distinct()
        out = rows.join(known, ["digest", "text"]).join(groups, ["digest", "side", "anchor"]).select(
            "doc_id", "keep_id", "group_size", sha256(F.col("text")).alias("text_sha256")
        )
    return out.select("doc_id", "keep_id", "group_size", F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False)).alias("kept"), "text_sha256")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


OP6_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT n.doc_id, g.keep_id, g.group_size, coalesce(n.doc_id = g.keep_id, false) AS kept, sha256(n.t) AS text_sha256
FROM n JOIN g USING (t)
"""
