"""Playlists to relations, tags of tracks, and the indexes between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def flatten_playlists(playlists: DataFrame, most: int = 400) -> dict[str, DataFrame]:
    """The four relations of nested playlists; a playlist lists at most `most` tracks, artists come from the albums."""
    heads = playlists.select("id", "name", "tags", F.col("creator.userId").alias("user_id"), F.slice(F.transform("tracks", lambda t: t["id"]), 1, most).alias("tracks"))
    each = playlists.select(F.explode("tracks").alias("t"))
    tracks = each.select("t.id", "t.name", "t.duration", "t.score", "t.popularity", F.col("t.album.id").alias("album_id")).dropDuplicates(["id"])
    albums = each.select("t.album.id", "t.album.size", "t.album.tags", F.transform("t.album.artists", lambda a: a["id"]).alias("artists")).where("id is not null").dropDuplicates(["id"])
    artists = each.select(F.explode("t.album.artists").alias("a")).select("a.id", "a.name").where("id is not null").dropDuplicates(["id"])
    return {"playlists": heads.dropDuplicates(["id"]), "tracks": tracks, "albums": albums, "artists": artists}


def tagged_tracks(playlists: DataFrame) -> DataFrame:
    """Distinct (track_id, tag, user_id, playlist_id) of playlists(id, tags, user_id, tracks); empty tag lists give nothing."""
    lists = F.struct(F.array_sort(F.array_distinct("tags")).alias("tags"), F.array_sort(F.array_distinct("tracks")).alias("tracks"))
    # rows of a playlist meet as lists, not as tracks times tags; most have one
    met = playlists.where((F.size("tags") > 0) & (F.size("tracks") > 0)).groupBy("user_id", F.col("id").alias("playlist_id")).agg(F.collect_set(lists).alias("l"))
    each = met.select("user_id", "playlist_id", "l", F.explode(F.array_distinct(F.flatten("l.tracks"))).alias("track_id"))
    of = F.filter("l", lambda x: F.exists(x["tracks"], lambda t: t.eqNullSafe(F.col("track_id"))))
    tags = F.when(F.size("l") == 1, F.get("l", F.lit(0))["tags"]).otherwise(F.array_distinct(F.flatten(F.transform(of, lambda x: x["tags"]))))
    return each.select("track_id", F.explode(tags).alias("tag"), "user_id", "playlist_id")


def track_playlists(bridge: DataFrame) -> DataFrame:
    """(track_id, playlist_ids): the sorted distinct playlists of each track of bridge(playlist_id, track_id)."""
    return bridge.distinct().groupBy("track_id").agg(F.sort_array(F.collect_list("playlist_id")).alias("playlist_ids"))


#: Rows of a bridge to a part, whose pairs a task counts in memory.
PART = 250_000


def co_playlist_partners(bridge: DataFrame, tracks: DataFrame) -> DataFrame:
    """(track_id, partner, n): the tracks that share playlists with those of tracks(track_id), with how many.

    Pairs are dealt to as many parts as the rows ask for, so that a task's memory does not grow with them.
    """
    parts = max(bridge.count() // PART + 1, bridge.sparkSession.sparkContext.defaultParallelism)
    b = bridge.distinct()
    mine = b.join(tracks.select("track_id").distinct(), "track_id", "left_semi")
    met = mine.join(b.withColumnRenamed("track_id", "partner"), "playlist_id").select("track_id", "partner")
    return met.repartition(parts, "track_id", "partner").groupBy("track_id", "partner").agg(F.count("*").alias("n"))


def genres(rows: DataFrame, tagged: DataFrame) -> DataFrame:
    """rows with the sorted distinct tags of their track_id, an empty list where there are none."""
    tags = tagged.select("track_id", "tag").distinct().groupBy("track_id").agg(F.sort_array(F.collect_list("tag")).alias("genres"))
    return rows.join(tags, "track_id", "left").withColumn("genres", F.coalesce("genres", F.array().cast("array<string>")))


def tuple_items(text: Column) -> Column:
    """The items of a tuple written as text, 'a', 'b'."""
    return F.regexp_extract_all(text, F.lit("'([^']*)'"), F.lit(1))


def first_of_each(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_r = 1").drop("_r")


def spaced_sample(rows: DataFrame, group: str, order: str, most: int = 500) -> DataFrame:
    """Evenly spaced rows of each group: the places rint(i (n - 1) / (most - 1)), halves going to the even, each once."""
    placed = rows.withColumn("_p", F.row_number().over(Window.partitionBy(group).orderBy(order)) - 1).withColumn("_n", F.count("*").over(Window.partitionBy(group)))
    # place p is taken if some i rounds to it: i near p (most - 1) / (n - 1)
    i = F.rint(F.col("_p") * (most - 1) / F.greatest(F.col("_n") - 1, F.lit(1)))
    near = lambda d: F.rint(F.least(F.greatest(i + d, F.lit(0.0)), F.lit(most - 1.0)) * (F.col("_n") - 1) / (most - 1)) == F.col("_p")
    return placed.where((F.col("_n") <= most) | near(0) | near(-1) | near(1)).drop("_p", "_n")


def ordered_text(rows: DataFrame, key: list[str], order: str, text: str = "text") -> DataFrame:
    """The texts of each key in order, a line each."""
    listed = rows.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t")))).alias("l"))
    return listed.select(*key, F.array_join(F.transform("l", lambda s: s["t"]), "\n").alias("text"))
