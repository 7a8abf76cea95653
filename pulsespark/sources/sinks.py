"""Writers."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def insert_ignore(new: DataFrame, held: DataFrame, key: list[str]) -> DataFrame:
    """held with the rows of new whose key it lacks; the last part is never lost."""
    return held.unionByName(new.dropDuplicates(key).join(held.select(*key), key, "left_anti"))


def bucket(n: Column) -> tuple[Column, Column]:
    """First and second folder of the n-th file."""
    return F.floor(n / 10000).cast("long"), F.floor((n % 10000) / 100).cast("long")


def lyric_bucket(n: Column) -> tuple[Column, Column]:
    """Folders of 8,000 and 200 files; a multiple of 8,000 falls into bucket 1, not 40."""
    return F.floor(n / 8000).cast("long"), (F.floor(F.greatest(n % 8000 - 1, F.lit(0)) / 200) + 1).cast("long")


def cluster_listing(clusters: DataFrame) -> DataFrame:
    """clusters(rank, count, tags) as lines "rank count:n - [tag, tag]"."""
    return clusters.orderBy("rank").select(F.format_string("%d count:%d - [%s]", F.col("rank").cast("int"), F.col("count").cast("int"), F.array_join("tags", ", ")).alias("value"))


def write_census(census: DataFrame, path: str, export: str | None = None) -> None:
    """Parquet, and on request CSV with arrays as JSON."""
    census.write.mode("overwrite").parquet(path)
    if export:
        flat = [F.to_json(c).alias(c) if t.startswith(("array", "struct")) else F.col(c) for c, t in census.dtypes]
        census.select(*flat).write.mode("overwrite").csv(export, header=True)


def write_texts(texts: DataFrame, path: str) -> None:
    """texts(track_id, flag, text, n) in folders by the bucket of n, the text's number among all."""
    first, second = bucket(F.col("n"))
    texts.withColumns({"first": first, "second": second}).write.mode("overwrite").partitionBy("first", "second").parquet(path)


def save_model(model, path: str) -> None:
    """A fitted model in its own format, replacing what is there; load it with its class's load()."""
    model.write().overwrite().save(path)


def log_run(spark: SparkSession, path: str, name: str, **parameters: object) -> DataFrame:
    """The table of runs at path, (name, at, parameters as JSON), with this one added."""
    row = spark.createDataFrame([(name, json.dumps(parameters, sort_keys=True, default=str))], "name string, parameters string").withColumn("at", F.current_timestamp())
    row.coalesce(1).write.mode("append").parquet(path)
    return spark.read.schema(row.schema).parquet(path)
