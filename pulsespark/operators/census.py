"""The census of bursts: their texts, tags and clusters, and what it is joined with."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import cluster
from . import series as S
from .relational import ordered_text
from .words import top_words

OTHERS = 0


def burst_text(bursts: DataFrame, reviews: DataFrame | Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(key, head, text): the texts of reviews(key, bucket, pos, text) in the bucket of each of bursts(key, head, bucket), a line each.

    Bursts without reviews have no row.  reviews may be a function that makes those of the bursts, so that other texts stay where they are.
    """
    met = (reviews(bursts) if callable(reviews) else reviews).join(bursts.select("key", "bucket", "head"), ["key", "bucket"])
    return ordered_text(met, ["key", "head"], "pos")


def census(series: DataFrame, reviews: DataFrame | Callable[[DataFrame], DataFrame], words: Column, keep: Callable[[Column], Column], vectors: DataFrame | Callable[[DataFrame], DataFrame], clusters: DataFrame, bh: int = 3, min_y: int = 100, k: int = 5, least: float = 0.7, grain: str = "day") -> DataFrame:
    """A row a burst: (key, flag, start_date, end_date, center, reviews_count, tags, clusters).

    Bursts are the heads of a series' peaks with room on both sides, numbered from 1 in order; tags are the first k of `words`
    (an expression over the column text) that keep holds for, of the text of its center; clusters(num, center) are what its tags with a vector
    vote for, (0, others) without a vote.  A burst without text has no tags.
    vectors(word, vec) may be a function that gives rows with a word their vec.
    """
    heads = S.select_bursts(S.peak_heads(series, bh=bh), min_y)
    bursts = S.extents(heads, series).withColumn("flag", F.row_number().over(Window.partitionBy("key").orderBy("head")).cast("long"))
    texts = burst_text(bursts, reviews).select(F.struct("key", "head").alias("doc_id"), "text")
    found = top_words(texts, words, k, keep)
    tags = found.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "word"))), lambda s: s["word"]).alias("tags"))
    voted = cluster.classify((vectors(found) if callable(vectors) else found.join(vectors, "word")).select("doc_id", F.col("word").alias("tag"), "vec"), clusters, least=least)
    told = tags.join(voted, "doc_id", "left").select("doc_id.key", "doc_id.head", "tags", "clusters")
    when = lambda c: F.expr(f"timestampadd({grain}, cast(`{c}` - head as int), bucket)")
    others = F.array(F.struct(F.lit(0).cast("long").alias("num"), F.lit("others").alias("center")))
    return bursts.join(told, ["key", "head"], "left").select(
        "key", "flag", when("start").alias("start_date"), when("end").alias("end_date"), F.col("bucket").alias("center"), F.col("y").alias("reviews_count"),
        F.coalesce("tags", F.array().cast("array<string>")).alias("tags"), F.coalesce("clusters", others).alias("clusters"),
    )


def named(clusters: Column) -> Column:
    """The clusters without (0, others)."""
    return F.filter(clusters, lambda c: c["num"] != OTHERS)


def sets_across_bursts(rows: DataFrame) -> DataFrame:
    """(items) of keys with several bursts: the distinct first clusters of rows(key, clusters), where there are several."""
    several = rows.withColumn("bursts", F.count("*").over(Window.partitionBy("key"))).where("bursts > 1")
    first = several.select("key", F.get("clusters", F.lit(0)).alias("c")).where(F.col("c.num") != OTHERS)
    return first.groupBy("key").agg(F.array_sort(F.collect_set("c.num")).alias("items")).where("size(items) > 1").select("items")


def sets_within_bursts(rows: DataFrame) -> DataFrame:
    """(items): the clusters of each burst of rows(clusters), where there are several."""
    return rows.select(F.array_sort(F.array_distinct(F.transform(named(F.col("clusters")), lambda c: c["num"]))).alias("items")).where("size(items) > 1")


def with_lyrics(tracks: DataFrame, files: DataFrame) -> DataFrame:
    """(track_id, path) of tracks that have a file of files(track_id, path); of several the last path."""
    return files.join(tracks.select("track_id").distinct(), "track_id", "left_semi").groupBy("track_id").agg(F.max("path").alias("path"))


def reviewed_tracks(playlists: DataFrame, reviewed: DataFrame) -> DataFrame:
    """(playlist_id, tracks): the sorted tracks of playlists(playlist_id, track_id) that have reviews."""
    met = playlists.join(reviewed.select("track_id").distinct(), "track_id", "left_semi").distinct()
    return met.groupBy("playlist_id").agg(F.sort_array(F.collect_list("track_id")).alias("tracks"))


def histogram(rows: DataFrame, value: str, bins: int = 20) -> DataFrame:
    """(bin, n, mean): equal bins from the least to the largest value, the last one closed, and the mean of all values."""
    ends = rows.agg(F.min(value).cast("double").alias("lo"), F.max(value).cast("double").alias("hi"), F.avg(value).alias("mean"))
    wide = F.col("hi") - F.col("lo")
    at = F.when(wide > 0, F.least(F.floor((F.col(value) - F.col("lo")) * bins / wide), F.lit(bins - 1))).otherwise(0).cast("long")
    return rows.crossJoin(F.broadcast(ends)).groupBy(at.alias("bin"), "mean").agg(F.count("*").alias("n"))  # ends is a row


def kept_by_tags(words: Column, flags: DataFrame, rows: DataFrame, stop: Sequence[str] = ()) -> DataFrame:
    """(doc_id, words): words of two letters or more that a lexicon flags(word) of wanted parts of speech has, in order, no stop words.

    The lexicon stands in for a tagger.  Documents that keep no word have an empty list.
    """
    each = rows.select("doc_id", F.posexplode(words).alias("pos", "word")).where((F.length("word") > 1) & ~F.col("word").isin(list(stop)))
    met = each.join(flags.select("word").distinct(), "word", "left_semi")
    listed = met.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda s: s["word"]).alias("words"))
    return rows.select("doc_id").join(listed, "doc_id", "left").select("doc_id", F.coalesce("words", F.array().cast("array<string>")).alias("words"))


def tagged_documents(lines: DataFrame, words: Column, most: int = 500, least: int = 5) -> DataFrame:
    """(doc_id, words): evenly spaced lines of lines(doc_id, pos, text), of those with more than `least` words all words in order."""
    from .relational import spaced_sample

    said = spaced_sample(lines, "doc_id", "pos", most).select("doc_id", "pos", words.alias("w")).where(F.size("w") > least)
    listed = said.groupBy("doc_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", "w"))), lambda s: s["w"])).alias("words"))
    return lines.select("doc_id").distinct().join(listed, "doc_id", "left").select("doc_id", F.coalesce("words", F.array().cast("array<string>")).alias("words"))


def feature_words(weights: DataFrame, lengths: DataFrame, k: int = 10) -> DataFrame:
    """(doc_id, rank, word) for documents: the k best of weights(doc_id, word, weight); a document of lengths(doc_id, words) with
    fewer words than k has just these, in their order."""
    short = lengths.where(F.size("words") < k)
    best = weights.join(short.select("doc_id"), "doc_id", "left_anti").withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc(F.round("weight", 9)), "word")).cast("long"))
    own = short.select("doc_id", F.posexplode("words").alias("pos", "word")).select("doc_id", (F.col("pos") + 1).cast("long").alias("rank"), "word")
    return own.unionByName(best.where(F.col("rank") <= k).select("doc_id", "rank", "word"))


def kept_fits(fits: DataFrame, least: int = 15, most: float = 0.7) -> DataFrame:
    """fits(label, n, slope, sigma, mean) of labels with more than `least` rows and a fit, those of a sigma up to `most`, with
    keep_rate, their percentage among the fitted."""
    fitted = fits.where((F.col("n") > least) & F.col("slope").isNotNull())
    kept = F.col("sigma") <= most
    rate = fitted.agg((F.avg(kept.cast("double")) * 100).alias("keep_rate"))
    return fitted.where(kept).crossJoin(F.broadcast(rate))  # a row
