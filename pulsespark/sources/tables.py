"""Readers.  Schemas are given, never inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REVIEW = "time long, likedCount long, content string"
PLAYLIST = (
    "id string, name string, tags array<string>, creator struct<userId:long>, tracks array<struct<id:string,name:string,duration:long,score:double,popularity:double,"
    "album:struct<id:string,size:long,tags:array<string>,artists:array<struct<id:string,name:string>>>>>"
)
LYRIC = "lrc struct<lyric:string>"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _track_id(rows: DataFrame) -> DataFrame:
    # names come with spaces and the like escaped, but plus signs as they are
    name = F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B")))
    return rows.withColumn("track_id", F.regexp_extract(name, r"^(.*?)(\.[A-Za-z]+)?$", 1))


def reviews_json(spark: SparkSession, path: str) -> DataFrame:
    """JSON arrays, a file a track; a malformed file fails the read."""
    return _track_id(spark.read.schema(REVIEW).json(path, multiLine=True, mode="FAILFAST", recursiveFileLookup=True))


def reviews_lines(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines, a file a track; malformed or incomplete lines are left out."""
    return _track_id(spark.read.schema(REVIEW).json(path, mode="DROPMALFORMED", recursiveFileLookup=True)).dropna(subset=["time", "likedCount", "content"])


def reviews_with_corrupt(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines with the text of malformed ones in _corrupt_record."""
    return _track_id(spark.read.schema(REVIEW + ", _corrupt_record string").json(path, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt_record", recursiveFileLookup=True))


def playlists(spark: SparkSession, path: str) -> DataFrame:
    """Playlist files; payloads that are no object are left out."""
    rows = spark.read.schema(PLAYLIST + ", _corrupt_record string").json(path, multiLine=True, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt_record", recursiveFileLookup=True)
    return rows.where("_corrupt_record is null and id is not null").drop("_corrupt_record")


def lyrics(spark: SparkSession, path: str) -> DataFrame:
    return _track_id(spark.read.schema(LYRIC).json(path, multiLine=True, recursiveFileLookup=True)).select("track_id", F.col("lrc.lyric").alias("lyric"))


def text_files(spark: SparkSession, path: str, first: int | None = None) -> DataFrame:
    """(track_id, text) of every .txt file below path, cut to its first characters where the caller says so."""
    rows = _track_id(spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.txt"))
    return rows.select("track_id", (F.substring("value", 1, first) if first else F.col("value")).alias("text"))


def lexicon(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.col("value").alias("word")).where("word <> ''").distinct()


def kinds_of_clusters(spark: SparkSession, path: str) -> DataFrame:
    """(num, kind): the first line lists topics, the second events."""
    lines = spark.read.text(path, wholetext=True).select(F.split("value", "\n").alias("l"))
    line = lambda i, kind: lines.select(F.explode(F.split(F.trim(F.get("l", F.lit(i))), r"\s+")).alias("num"), F.lit(kind).alias("kind"))
    return line(0, "topic").union(line(1, "event")).where("num <> ''")


def csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, schema=schema, header=True)


def jdbc(spark: SparkSession, url: str, name: str, **options: str) -> DataFrame:
    """A table of a database; address and credentials come from the caller."""
    return spark.read.format("jdbc").options(url=url, dbtable=name, **options).load()


def newest(spark: SparkSession, path: str) -> str | None:
    """The path of the newest file of a folder, hidden files apart."""
    files = spark.read.format("binaryFile").load(path).select("path", "modificationTime").where(~F.col("path").rlike(r"/\.[^/]*$"))
    return files.agg(F.max_by("path", "modificationTime").alias("p")).first().p


def garch_report(text: DataFrame) -> DataFrame:
    """(name, estimate, se, p) of reports (id, text): the lines from "mu" to "Robust" but the last, their fields 1, 2, 3 and 5."""
    part = F.regexp_extract("text", r"(?s)(mu.*?)Robust", 1)
    lines = F.filter(F.split(part, "\n"), lambda x: F.trim(x) != "")
    rows = text.select("id", F.explode(F.slice(lines, 1, F.greatest(F.size(lines) - 1, F.lit(0)))).alias("line"))
    field = lambda i: F.get(F.split(F.trim("line"), r"\s+"), F.lit(i))
    return rows.select("id", field(0).alias("name"), field(1).try_cast("double").alias("estimate"), field(2).try_cast("double").alias("se"), field(4).try_cast("double").alias("p"))
