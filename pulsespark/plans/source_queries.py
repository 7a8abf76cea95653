"""Readers over files that the query itself writes from the small tables: customers as reviews of a region's track, nations as playlists."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import tables as T
from ..sources.tables import table

_own: list[str] = []


def folder(spark: SparkSession) -> str:
    """A fresh folder where all executors can read; one of our own only where the session names none (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not _own:
        _own.append("file://" + tempfile.mkdtemp(prefix="engine-sources-"))
    return f"{named or _own[0]}/sources/{uuid.uuid4().hex}"


def _file(rows: DataFrame, path: str, name: str) -> None:
    """The lines of rows(value) as the one file path/name."""
    jvm, conf = rows.sparkSession.sparkContext._jvm, rows.sparkSession.sparkContext._jsc.hadoopConfiguration()
    rows.coalesce(1).write.text(f"{path}/parts/{name}")
    at = jvm.org.apache.hadoop.fs.Path(f"{path}/parts/{name}")
    fs = at.getFileSystem(conf)
    fs.mkdirs(jvm.org.apache.hadoop.fs.Path(f"{path}/files"))
    part = next(s.getPath() for s in fs.listStatus(at) if s.getPath().getName().startswith("part-"))
    fs.rename(part, jvm.org.apache.hadoop.fs.Path(f"{path}/files/{name}"))


def _reviews(spark: SparkSession, d: str) -> DataFrame:
    """(region, time, likedCount, content) of customers."""
    nations = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("c_nationkey"), F.col("r_name").alias("region"))
    return table(spark, d, "customer").join(F.broadcast(nations), "c_nationkey").select(  # 25 rows
        "region", (F.col("c_custkey") + 1_500_000_000).alias("time"), F.floor("c_acctbal").cast("long").alias("likedCount"), F.col("c_name").alias("content")
    )


def _by_region(spark: SparkSession, d: str, how) -> str:
    rows, path = _reviews(spark, d), folder(spark)
    for r in table(spark, d, "region").select("r_name").collect():  # five rows
        _file(how(rows.where(F.col("region") == r.r_name).drop("region")), path, f"{r.r_name}.json")
    return f"{path}/files"


def _json(spark, d):
    return T.reviews_json(spark, _by_region(spark, d, lambda rows: rows.groupBy().agg(F.to_json(F.collect_list(F.struct("*"))).alias("value")))).select("track_id", "time", "likedCount", "content")


def _lines(spark, d):
    broken = spark.createDataFrame([('{"time": 1, "likedCount"',), ('{"time": 1}',)], "value string")
    return T.reviews_lines(spark, _by_region(spark, d, lambda rows: rows.select(F.to_json(F.struct("*")).alias("value")).union(broken))).select("track_id", "time", "likedCount", "content")


def _corrupt(spark, d):
    broken = spark.createDataFrame([('{"time": 1, "likedCount"',)], "value string")
    got = T.reviews_with_corrupt(spark, _by_region(spark, d, lambda rows: rows.select(F.to_json(F.struct("*")).alias("value")).union(broken)))
    return got.groupBy("track_id", F.col("_corrupt_record").isNotNull().alias("corrupt")).agg(F.count("*").alias("n"), F.count("content").alias("contents"))


def _playlists(spark, d):
    track = F.struct(F.col("s_suppkey").cast("string").alias("id"), F.col("s_name").alias("name"))
    lists = table(spark, d, "supplier").groupBy("s_nationkey").agg(F.sort_array(F.collect_list(track)).alias("tracks"))
    rows = table(spark, d, "nation").join(lists, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("name"), F.array("n_name").alias("tags"), F.struct(F.col("n_regionkey").cast("long").alias("userId")).alias("creator"), "tracks"
    )
    path = folder(spark)
    _file(rows.groupBy().agg(F.to_json(F.collect_list(F.struct("*"))).alias("value")), path, "all.json")
    _file(spark.createDataFrame([("[1]",)], "value string"), path, "none.json")  # a payload that is no object
    return T.playlists(spark, f"{path}/files").select("id", "name", F.col("creator.userId").alias("user_id"), F.size("tracks").cast("long").alias("n"), F.element_at("tracks", 1)["name"].alias("first"))


def _texts(spark, d):
    path = folder(spark)
    for r in table(spark, d, "region").select("r_name").collect():  # five rows
        _file(table(spark, d, "nation").join(table(spark, d, "region").where(F.col("r_name") == r.r_name), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("value")).orderBy("value"), path, f"{r.r_name}.txt")
    return T.text_files(spark, f"{path}/files", 12)


def _lexicon(spark, d):
    path = folder(spark)
    _file(table(spark, d, "nation").select(F.col("n_name").alias("value")).union(spark.createDataFrame([("",), ("FRANCE",)], "value string")), path, "words.txt")
    return T.lexicon(spark, f"{path}/files")


def _csv(spark, d):
    path = folder(spark)
    table(spark, d, "nation").select("n_nationkey", "n_name").write.csv(path, header=True)
    return T.csv(spark, path, "n_nationkey int, n_name string")


QUERIES = {
    "source_reviews_json": _json,
    "source_reviews_lines": _lines,
    "source_reviews_corrupt": _corrupt,
    "source_playlists": _playlists,
    "source_text_files": _texts,
    "source_lexicon": _lexicon,
    "source_csv": _csv,
}
_R = "FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey"
_REVIEWS = f"SELECT r_name AS track_id, c_custkey + 1500000000 AS time, floor(c_acctbal)::BIGINT AS \"likedCount\", c_name AS content {_R}"
ORACLE_SQL = {
    "source_reviews_json": _REVIEWS,
    "source_reviews_lines": _REVIEWS,
    "source_reviews_corrupt": f"SELECT r_name AS track_id, false AS corrupt, count(*) AS n, count(*) AS contents {_R} GROUP BY 1 UNION ALL SELECT r_name, true, 1, 0 FROM region",
    "source_playlists": "SELECT n_nationkey::VARCHAR AS id, n_name AS name, n_regionkey::BIGINT AS user_id, count(*) AS n, arg_min(s_name, s_suppkey::VARCHAR) AS first FROM nation JOIN supplier ON s_nationkey = n_nationkey GROUP BY ALL",
    "source_text_files": "SELECT r_name AS track_id, left(string_agg(n_name, chr(10) ORDER BY n_name) || chr(10), 12) AS text FROM nation JOIN region ON r_regionkey = n_regionkey GROUP BY 1",
    "source_lexicon": "SELECT DISTINCT n_name AS word FROM nation UNION SELECT 'FRANCE'",
    "source_csv": "SELECT n_nationkey, n_name FROM nation",
}
