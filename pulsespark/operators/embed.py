"""Word and document vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import cosine

#: Words that each part of a training has at least.
PART = 1_000_000


def train_words(sentences: DataFrame, column: str = "words", size: int = 300, least: int = 20, window: int = 2, rounds: int = 6, seed: int = 21):
    """A skip-gram model.  More text means training again on the union: vectors cannot be trained on.

    Spark's trainer takes one task unless told otherwise: here as many as there are cores, where each has PART words.  The words are
    kept on disk while it goes over them.
    """
    from pyspark import StorageLevel
    from pyspark.ml.feature import Word2Vec

    held = sentences.select(column).persist(StorageLevel.DISK_ONLY)
    try:
        words = held.agg(F.sum(F.size(column))).first()[0] or 0
        parts = max(1, min(words // PART, sentences.sparkSession.sparkContext.defaultParallelism))
        return Word2Vec(vectorSize=size, minCount=least, windowSize=window, maxIter=rounds, seed=seed, inputCol=column, outputCol="vec", numPartitions=parts).fit(held)
    finally:
        held.unpersist()


def synonyms(model, word: str, k: int = 10) -> DataFrame:
    return model.findSynonyms(word, k)


def document_vectors(model, docs: DataFrame) -> DataFrame:
    """Documents with the mean of their words' vectors, in the place of trained paragraph vectors."""
    from pyspark.ml.functions import vector_to_array

    return model.transform(docs).withColumn("vec", vector_to_array("vec"))


def nearest_documents(vectors: DataFrame, query: DataFrame, k: int = 10) -> DataFrame:
    """(doc_id, sim): the k nearest of vectors(doc_id, vec) to the one row of query(vec)."""
    one = query.select(F.col("vec").alias("q")).limit(1)
    return vectors.crossJoin(F.broadcast(one)).select("doc_id", F.round(cosine("vec", "q"), 9).alias("sim")).orderBy(F.desc_nulls_last("sim"), "doc_id").limit(k)
