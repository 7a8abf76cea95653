"""A corpus pipeline: toxic documents go, then exact and near copies, personal data is redacted, and what is left is packed.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs.  All but the last return the columns of docs, whatever others docs has besides doc_id and text.  Null texts count
as empty and stay null until they are packed; empty texts equal each other, so one of them stays.  Rows with a null id are kept
by the two dedup stages.  Rows that repeat an id are told apart by their texts in exact dedup; in near-dedup they are one
document and stay or go together, and rows that repeat both stay together in both.  An empty table passes through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsespark.llm import exact_dedup, minhash, packing, pii, toxicity
from pulsespark.llm.common import staged, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1, fitted on the labels of the documents that are there; a score of 0.5 or more goes, equal texts together."""
    machine = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.filtered(docs, machine)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: of equal texts the row with the smallest id stays."""
    gone = exact_dedup.exact_groups(docs).where("not kept and doc_id is not null").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha")).distinct()
    same = (docs["doc_id"] == gone["_id"]) & (exact_dedup.sha256(exact_dedup.normalised(docs["text"])) == gone["_sha"])
    return docs.join(gone, same, "left_anti")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5 on five-word shingles at 0.8: the smallest id of each component stays."""
    gone = minhash.near_duplicates(docs).where("not kept and doc_id is not null").select(F.col("doc_id").alias("_id")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["_id"], "left_anti")


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: each span becomes its kind in brackets, and n_chars the new length; overlapping spans become one."""
    return pii.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: the pieces of every document with their sequences and offsets; equal pieces go to places of their own."""
    return packing.pack(docs, packing.word_tokenizer())


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("minhash_dedup", drop_near_copies),
    ("pii", redact),
    ("packing", pack),
]

#: SQL can express neither the fitted stages nor the tokenizer; tests/llm/test_pipeline.py holds run() and each stage against
#: a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
