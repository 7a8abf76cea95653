"""Text operators over tables: tags, n-grams, TF-IDF feature words and their rerank."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.vectors import cosine, norm


def top_words(docs: DataFrame, words: Column, k: int = 8, keep: Callable[[Column], Column] | None = None) -> DataFrame:
    """(doc_id, rank, word, n): the most frequent words of each document, ties in the order of first sight.

    Of the words only those that keep holds for count; it is asked once for each distinct word of a document.
    """
    counted = docs.select("doc_id", F.posexplode(words).alias("pos", "word")).groupBy("doc_id", "word").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    if keep:
        counted = counted.where(keep(F.col("word")))
    ranked = counted.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("n"), "first")).cast("long"))
    return ranked.where(F.col("rank") <= k).select("doc_id", "rank", "word", "n")


def top_grams(docs: DataFrame, grams: Column, k: int = 10, least: int = 30) -> DataFrame:
    """The first k grams of each document, and of them those with count enough."""
    return top_words(docs, grams, k).where(F.col("n") >= least)


def consolidate(grams: DataFrame, fragments: Sequence[str]) -> DataFrame:
    """Distinct grams that hold none of the fragments, which are one pattern however many there are."""
    out = grams.select("word").distinct()
    held = [f for f in fragments if f]
    if len(held) < len(fragments):  # every gram holds an empty fragment
        return out.limit(0)
    return out.where(~F.col("word").rlike("|".join(re.escape(f) for f in held))) if held else out


def term_counts(docs: DataFrame, words: Column) -> DataFrame:
    return docs.select("doc_id", F.explode(words).alias("word")).groupBy("doc_id", "word").agg(F.count("*").alias("tf"))


def dictionary(counts: DataFrame, docs: int, no_below: int = 30, no_above: float = 0.03, keep: int | None = 100_000) -> DataFrame:
    """(word, df) of words in at least no_below documents and at most a share no_above of them, the most frequent `keep`, or all."""
    df = counts.groupBy("word").agg(F.count("*").alias("df")).where((F.col("df") >= no_below) & (F.col("df") <= no_above * docs))
    return df if keep is None else df.orderBy(F.desc("df"), "word").limit(keep)


def tf_idf(counts: DataFrame, words: DataFrame, docs: int, few: bool = False) -> DataFrame:
    """(doc_id, word, weight): tf * log2(N / df), each document scaled to length 1; few: words come from a dictionary() with a
    bound and are sent to the counts."""
    raw = counts.join(F.broadcast(words) if few else words, "word").withColumn("w", F.col("tf") * F.log2(F.lit(float(docs)) / F.col("df")))
    length = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("doc_id")))
    return raw.withColumn("weight", F.try_divide("w", length)).select("doc_id", "word", "weight")


def best(weights: DataFrame, k: int) -> DataFrame:
    ranked = weights.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc(F.round("weight", 9)), "word")).cast("long"))
    return ranked.where(F.col("rank") <= k)


def coherence(members: DataFrame) -> DataFrame:
    """(doc, mean_cos, pairs) of members(doc, pos, vec): the mean cosine of the pairs p, q of a doc with pos(p) <= pos(q), a member with
    itself among them, and the number of pairs.

    Vectors of length 1 add up: of all ordered pairs and of those at one pos the cosines sum to the squared length of the vectors'
    sum, so half of both together is the sum over the pairs, and none is formed.  Vectors without a cosine (null, zero, with null
    components) count among the pairs alone, and those of different sizes have none together.
    """
    rows = members.where(F.col("doc").isNotNull() & F.col("pos").isNotNull())
    long = F.col("vec").isNotNull() & ~F.exists("vec", lambda x: x.isNull()) & (norm(F.col("vec")) != 0)
    unit = rows.where(long).select("doc", "pos", F.size("vec").alias("size"), F.col("vec").cast("array<double>").alias("vec"), norm(F.col("vec")).alias("norm"))
    each = unit.select("doc", "pos", "size", F.posexplode(F.transform("vec", lambda x: x / F.col("norm"))).alias("i", "x"))
    at = each.groupBy("doc", "size", "i", "pos").agg(F.sum("x").alias("s"))  # most have a pos of their own
    cos = at.groupBy("doc", "size", "i").agg((F.pow(F.sum("s"), F.lit(2)) + F.sum(F.col("s") * F.col("s"))).alias("twice")).groupBy("doc").agg(F.sum("twice").alias("twice"))
    places = lambda df, *keys: df.groupBy("doc", *keys, "pos").agg(F.count("*").alias("m")).groupBy("doc", *keys).agg(((F.pow(F.sum("m"), F.lit(2)) + F.sum(F.col("m") * F.col("m"))) / 2).cast("long").alias("n"))
    met = places(unit, "size").groupBy("doc").agg(F.sum("n").alias("met"))
    return places(rows).withColumnRenamed("n", "pairs").join(cos, "doc", "left").join(met, "doc", "left").select("doc", F.try_divide(F.col("twice") / 2, "met").alias("mean_cos"), "pairs")


def diversity_rerank(candidates: DataFrame, vectors: DataFrame, k: int = 10) -> DataFrame:
    """(doc_id, rank, word): the best first; then each time all scores are multiplied by 1 - cosine to the last pick.

    candidates(doc_id, word, weight) are few a document; words without a vector are left out.  Ties go to the word.
    """
    rows = candidates.join(vectors.select("word", F.col("vec").cast("array<double>").alias("vec")), "word").groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.struct((-F.round("weight", 9)).alias("minus"), "word", "vec"))).alias("left")
    )
    kind = "array<struct<minus:double,word:string,vec:array<double>>>"

    def step(acc: Column, _i: Column) -> Column:
        top = F.element_at(acc["left"], 1)
        rest = F.slice(acc["left"], 2, F.greatest(F.size(acc["left"]) - 1, F.lit(0)))
        again = F.array_sort(F.transform(rest, lambda c: F.struct((c["minus"] * (1 - F.coalesce(cosine(c["vec"], top["vec"]), F.lit(0.0)))).alias("minus"), c["word"].alias("word"), c["vec"].alias("vec"))))
        return F.when(F.size(acc["left"]) > 0, F.struct(again.alias("left"), F.array_append(acc["out"], top["word"]).alias("out"))).otherwise(acc)

    first = F.struct(F.col("left").cast(kind).alias("left"), F.array().cast("array<string>").alias("out"))
    picked = rows.select("doc_id", F.aggregate(F.sequence(F.lit(1), F.lit(k)), first, step, lambda a: a["out"]).alias("words"))
    return picked.select("doc_id", F.posexplode("words").alias("rank", "word")).select("doc_id", (F.col("rank") + 1).cast("long").alias("rank"), "word")


def token_number(text: Column) -> Column:
    """White-space separated tokens of a text; 0 for blank ones."""
    bare = F.regexp_replace(text, r"^\s+|\s+$", "")
    return F.when(F.length(bare) > 0, F.size(F.split(bare, r"\s+"))).otherwise(0).cast("long")
