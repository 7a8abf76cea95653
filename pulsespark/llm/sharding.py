"""Sharding by rendezvous hashing: each record goes to the shard whose weighted hash of (key, shard) is best.

A shard's score is -ln(u) / weight with u in (0, 1] from 52 bits of md5(key:shard); the least score wins.  Scores of other
shards do not depend on how many there are, so one more shard takes records only into itself.  Slots are gapless numbers
inside a shard, dealt out over sub-buckets of the key's hash (without an id, of the text's), which are as many as the number
of rows asks for, so that no task holds a whole shard.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import body, table


#: Rows that are numbered together, about.
SUB_ROWS = 50_000


def _fraction(key: Column) -> Column:
    return (F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("long") + 1) / F.lit(float(2**52))


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard (0 to len(weights) - 1) of a string key.  Weights must be positive; equal scores go to the lower shard."""
    if not weights or min(weights) <= 0:
        raise ValueError("shards need positive weights")
    score = lambda s: -F.log(_fraction(F.concat(key, F.lit(f":{s}")))) / F.lit(float(weights[s]))
    return F.array_min(F.array(*(F.struct(score(s).alias("score"), F.lit(s).alias("shard")) for s in range(len(weights)))))["shard"]


def shard(docs: DataFrame, weights: Sequence[float] = (1.0,) * 16) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row of docs(doc_id, text, ...).

    grown_shard is the shard with one more shard of weight 1.  Null texts count as empty; rows that repeat a doc_id go to
    the same shard into slots of their own; null ids share the empty key; other columns are ignored; an empty table gives
    no rows.
    """
    key, crc, digits, n = F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.crc32(body().cast("binary")), 2, docs.count()
    while digits < 8 and n > len(weights) * 16**digits * SUB_ROWS:
        digits += 1
    sub = F.substring(F.md5(F.when(F.col("doc_id").isNull(), crc.cast("string")).otherwise(key).cast("binary")), 1, digits).alias("sub")
    rows = docs.select(
        F.col("doc_id"),
        (F.octet_length(body()).cast("long") + 1).alias("size"),
        crc.alias("text_crc32"),
        rendezvous(key, weights).alias("shard"),
        rendezvous(key, (*weights, 1.0)).alias("grown_shard"),
        sub,
    )
    # both sides are dealt by (shard, sub), so the counts join without moving the rows again
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("shard", "sub").orderBy("doc_id", "text_crc32", "size")))
    counts = docs.select(rendezvous(key, weights).alias("shard"), sub).groupBy("shard", "sub").agg(F.count("*").alias("n"))
    before = counts.withColumn(
        "before", F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("sub").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ).select("shard", "sub", "before")
    return ranked.join(before, ["shard", "sub"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("before") + F.col("rank") - 1).alias("slot"), "grown_shard"
    )


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))


OP9_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(doc_id::VARCHAR, '') AS k FROM documents),
c AS (SELECT k, s, ('0x' || substr(md5(k || ':' || s), 1, 13))::BIGINT AS h FROM (SELECT DISTINCT k FROM d), range(17) r(s)),
p AS (SELECT k, arg_max(s, h) FILTER (s < 16) AS shard, arg_max(s, h) AS grown_shard FROM c GROUP BY k),
crc_table AS (SELECT list(list_reduce(range(9), lambda a, k: CASE WHEN k = 0 THEN a WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END, i) ORDER BY i) AS l FROM range(256) t(i)),
bytes AS (SELECT doc_id, k, strlen(t) AS n, list_transform(range(strlen(t)), lambda i: ('0x' || substr(h, 2*i+1, 2))::BIGINT) AS b FROM (SELECT *, hex(encode(t)) AS h FROM d)),
r AS (SELECT doc_id, k, n + 1 AS size, xor(list_reduce(b, lambda a, x: xor(a // 256, l[xor(a % 256, x) + 1]), 4294967295), 4294967295) AS text_crc32 FROM bytes, crc_table)
SELECT doc_id, size, text_crc32, 'key' AS law, shard::INTEGER AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY substr(md5(CASE WHEN doc_id IS NULL THEN text_crc32::VARCHAR ELSE k END), 1, 2), doc_id, text_crc32, size) - 1 AS slot, grown_shard::INTEGER AS grown_shard
FROM r JOIN p USING (k)
"""
