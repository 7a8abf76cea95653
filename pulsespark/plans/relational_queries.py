"""Playlists and tracks, with orders as playlists, parts as tracks and brands as tags."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import relational as R
from ..operators import series as S
from ..sources import sinks
from ..sources.tables import table


def bridge(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("playlist_id"), F.col("l_partkey").alias("track_id"))


def nested(spark: SparkSession, d: str) -> DataFrame:
    """Orders as nested playlists."""
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_brand", "p_size", "p_retailprice")
    track = F.struct(
        F.col("l_partkey").cast("string").alias("id"), F.col("p_name").alias("name"), F.col("p_size").cast("long").alias("duration"), F.col("p_retailprice").alias("score"),
        F.lit(0.0).alias("popularity"),
        F.struct(F.concat(F.lit("a"), "l_suppkey").alias("id"), F.lit(1).cast("long").alias("size"), F.array("p_brand").alias("tags"),
                 F.array(F.struct(F.col("l_suppkey").cast("string").alias("id"), F.concat(F.lit("s"), "l_suppkey").alias("name"))).alias("artists")).alias("album"),
    )
    lists = table(spark, d, "lineitem").join(parts, "l_partkey").groupBy("l_orderkey").agg(
        F.sort_array(F.collect_list(F.struct("l_linenumber", track.alias("track")))).alias("l"), F.sort_array(F.collect_set("p_brand")).alias("tags")
    )
    return table(spark, d, "orders").join(lists, F.col("o_orderkey") == F.col("l_orderkey")).select(
        F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderpriority").alias("name"), "tags", F.struct(F.col("o_custkey").alias("userId")).alias("creator"),
        F.transform("l", lambda x: x["track"]).alias("tracks"),
    )


def _flatten(spark, d):
    f = R.flatten_playlists(nested(spark, d), 3)
    p = f["playlists"].select(F.lit("playlist").alias("kind"), "id", F.col("name").alias("name"), F.size("tracks").cast("long").alias("n"))
    t = f["tracks"].select(F.lit("track"), "id", "name", F.col("duration"))
    al = f["albums"].select(F.lit("album"), "id", F.array_join("artists", ","), F.col("size"))
    ar = f["artists"].select(F.lit("artist"), "id", "name", F.lit(0).cast("long"))
    return p.union(t).union(al).union(ar)


def _tagged(spark, d):
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_partkey").join(parts, "l_partkey")
    lists = lines.groupBy("l_orderkey").agg(F.collect_set("p_brand").alias("tags"), F.transform(F.collect_set("l_partkey"), lambda k: k.cast("string")).alias("tracks"))  # of nested() what is asked for
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("user_id"))
    return R.tagged_tracks(orders.join(lists, "l_orderkey").select(F.col("l_orderkey").cast("string").alias("id"), "tags", "user_id", "tracks"))


def _partners(spark, d):
    return R.co_playlist_partners(bridge(spark, d), table(spark, d, "part").select(F.col("p_partkey").alias("track_id")))


def _genres(spark, d):
    tags = table(spark, d, "part").where("p_size < 40").select(F.col("p_partkey").alias("track_id"), F.explode(F.array("p_brand", "p_type")).alias("tag"))
    return R.genres(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("track_id")), tags).select(
        "l_orderkey", "l_linenumber", "track_id", F.array_join("genres", "|").alias("genres")
    )


def _epochs(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", S.epoch_seconds(F.col("event_id") * 1_000_000_000 + 7).alias("long_epoch"), S.epoch_seconds(F.col("event_id") + 1).alias("short_epoch"))


def _first(spark, d):
    e = table(spark, d, "events").select("user_id", "event_type", "event_id", "value")
    return R.first_of_each(e, ["user_id", "event_type"], ["event_id"])


def _buckets(spark, d):
    n = F.col("l_orderkey") * 3 + F.col("l_linenumber")
    a, b = sinks.bucket(n)
    c, e = sinks.lyric_bucket(n)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", a.alias("first"), b.alias("second"), c.alias("top"), e.alias("sub"))


def _json(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


QUERIES = {
    "playlist_flatten": _flatten,
    "tagged_tracks": _tagged,
    "track_playlists": lambda s, d: R.track_playlists(bridge(s, d)).select("track_id", F.array_join(F.transform("playlist_ids", lambda x: x.cast("string")), ",").alias("playlist_ids")),
    "co_playlist_partners": _partners,
    "genre_lookup": _genres,
    "track_names": lambda s, d: bridge(s, d).join(table(s, d, "part").select(F.col("p_partkey").alias("track_id"), F.col("p_name").alias("name")), "track_id").select("playlist_id", "track_id", "name"),
    "count_rows": lambda s, d: table(s, d, "lineitem").agg(F.count("*").alias("n")),
    "insert_ignore": lambda s, d: sinks.insert_ignore(
        table(s, d, "customer").select("c_nationkey", F.lit("new").alias("origin")).groupBy("c_nationkey").agg(F.min("origin").alias("origin")),
        table(s, d, "nation").where("n_nationkey < 10").select(F.col("n_nationkey").alias("c_nationkey"), F.lit("held").alias("origin")), ["c_nationkey"]),
    "epoch_normalise": _epochs,
    "dedup_first": _first,
    "bucket_assign": _buckets,
    "sample_rows": lambda s, d: R.spaced_sample(table(s, d, "events").select("event_type", "event_id"), "event_type", "event_id", 100),
    "semi_intersect": lambda s, d: table(s, d, "customer").select(F.col("c_nationkey").alias("k")).intersect(table(s, d, "supplier").select(F.col("s_nationkey").alias("k"))),
    "union_distinct": lambda s, d: table(s, d, "customer").select(F.col("c_nationkey").alias("k")).union(table(s, d, "supplier").select("s_nationkey")).distinct(),
    "anti_exact": lambda s, d: table(s, d, "part").join(table(s, d, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey")), "p_partkey", "left_anti").select("p_partkey", "p_name"),
    "anti_substring": lambda s, d: table(s, d, "part").select("p_partkey", "p_name", "p_type").where(~F.col("p_type").rlike("BRASS|SMALL|PLATED") & ~F.contains("p_name", F.lit("7"))),
    "conversation_text": lambda s, d: R.ordered_text(table(s, d, "conversations").where("text is not null"), ["conv_id"], "turn"),
    "json_field": _json,
    "tuple_items": lambda s, d: table(s, d, "nation").select("n_nationkey", F.array_join(R.tuple_items(F.concat(F.lit("('"), "n_name", F.lit("', 'x"), "n_nationkey", F.lit("')"))), "+").alias("items")),
    "review_projection": lambda s, d: table(s, d, "documents").select("doc_id", F.length("text").cast("long").alias("size"), F.md5(F.replace("text", F.lit("\n"), F.lit(" ")).cast("binary")).alias("flat_md5")),
}
ORACLE_SQL = {
    "playlist_flatten": """SELECT 'playlist' AS kind, o_orderkey::VARCHAR AS id, o_orderpriority AS name, least(count(*), 3) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey GROUP BY ALL
UNION ALL SELECT 'track', p_partkey::VARCHAR, p_name, p_size::BIGINT FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
UNION ALL SELECT DISTINCT 'album', 'a' || l_suppkey, l_suppkey::VARCHAR, 1 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey
UNION ALL SELECT DISTINCT 'artist', l_suppkey::VARCHAR, 's' || l_suppkey, 0 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey""",
    "tagged_tracks": """SELECT DISTINCT l.l_partkey::VARCHAR AS track_id, t.p_brand AS tag, o_custkey AS user_id, o_orderkey::VARCHAR AS playlist_id
FROM orders JOIN lineitem l ON l.l_orderkey = o_orderkey JOIN lineitem m ON m.l_orderkey = o_orderkey JOIN part t ON t.p_partkey = m.l_partkey""",
    "track_playlists": "SELECT l_partkey AS track_id, string_agg(l_orderkey::VARCHAR, ',' ORDER BY l_orderkey) AS playlist_ids FROM (SELECT DISTINCT l_partkey, l_orderkey FROM lineitem) GROUP BY 1",
    "co_playlist_partners": """WITH b AS (SELECT DISTINCT l_orderkey AS p, l_partkey AS t FROM lineitem) SELECT x.t AS track_id, y.t AS partner, count(*) AS n FROM b x JOIN b y ON x.p = y.p GROUP BY ALL""",
    "genre_lookup": """WITH t AS (SELECT p_partkey, p_brand AS tag FROM part WHERE p_size < 40 UNION SELECT p_partkey, p_type FROM part WHERE p_size < 40), g AS (SELECT p_partkey, string_agg(tag, '|' ORDER BY tag) AS genres FROM t GROUP BY 1)
SELECT l_orderkey, l_linenumber, l_partkey AS track_id, coalesce(genres, '') AS genres FROM lineitem LEFT JOIN g ON p_partkey = l_partkey""",
    "track_names": "SELECT l_orderkey AS playlist_id, l_partkey AS track_id, p_name AS name FROM lineitem JOIN part ON p_partkey = l_partkey",
    "count_rows": "SELECT count(*) AS n FROM lineitem",
    "insert_ignore": "SELECT n_nationkey AS c_nationkey, 'held' AS origin FROM nation WHERE n_nationkey < 10 UNION ALL SELECT DISTINCT c_nationkey, 'new' FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_nationkey < 10)",
    "epoch_normalise": "SELECT event_id, rpad((event_id * 1000000000 + 7)::VARCHAR, 10, '0')::BIGINT AS long_epoch, rpad((event_id + 1)::VARCHAR, 10, '0')::BIGINT AS short_epoch FROM events",
    "dedup_first": "SELECT user_id, event_type, min(event_id) AS event_id, arg_min(value, event_id) AS value FROM events GROUP BY ALL",
    "bucket_assign": """SELECT l_orderkey, l_linenumber, n // 10000 AS first, (n % 10000) // 100 AS second, n // 8000 AS top, greatest(n % 8000 - 1, 0) // 200 + 1 AS sub FROM (SELECT *, l_orderkey * 3 + l_linenumber AS n FROM lineitem)""",
    "sample_rows": """WITH e AS (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS p, count(*) OVER (PARTITION BY event_type) AS n FROM events),
i AS (SELECT DISTINCT event_type, round_even(i * (n - 1) / 99.0::DOUBLE, 0)::BIGINT AS p FROM (SELECT DISTINCT event_type, n FROM e), range(100) r(i)) SELECT e.event_type, e.event_id FROM e JOIN i USING (event_type, p)""",
    "semi_intersect": "SELECT DISTINCT c_nationkey AS k FROM customer WHERE c_nationkey IN (SELECT s_nationkey FROM supplier)",
    "union_distinct": "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier",
    "anti_exact": "SELECT p_partkey, p_name FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)",
    "anti_substring": "SELECT p_partkey, p_name, p_type FROM part WHERE NOT regexp_matches(p_type, 'BRASS|SMALL|PLATED') AND NOT contains(p_name, '7')",
    "conversation_text": "SELECT conv_id, string_agg(text, chr(10) ORDER BY turn, text) AS text FROM conversations WHERE text IS NOT NULL GROUP BY 1",
    "json_field": "SELECT event_id, json_extract(props, '$.k')::BIGINT AS k FROM events",
    "tuple_items": "SELECT n_nationkey, n_name || '+x' || n_nationkey AS items FROM nation",
    "review_projection": "SELECT doc_id, length(text) AS size, md5(replace(text, chr(10), ' ')) AS flat_md5 FROM documents",
}
