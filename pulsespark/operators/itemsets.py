"""Frequent itemsets and association rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def transactions(baskets: DataFrame) -> DataFrame:
    """Distinct sets of items; equal baskets count once."""
    return baskets.select(F.array_sort(F.array_distinct("items")).alias("items")).where(F.size("items") > 0).distinct()


def frequent(baskets: DataFrame, min_support: int = 3) -> DataFrame:
    """(items, freq) of the sets with an absolute support; the share handed on lies between two counts, so that rounding cannot tip it."""
    from pyspark.ml.fpm import FPGrowth

    n = baskets.count()
    if not n:
        return baskets.select("items", F.lit(0).cast("long").alias("freq"))
    model = FPGrowth(itemsCol="items", minSupport=max(0.0, (min_support - 0.5) / n)).fit(baskets)
    return model.freqItemsets.select(F.array_sort("items").alias("items"), "freq")


def report(itemsets: DataFrame) -> DataFrame:
    return itemsets.where("size(items) > 1 and freq > 1")


def rules(itemsets: DataFrame, min_confidence: float = 0.6) -> DataFrame:
    """(antecedent, consequent, confidence) with consequents of any size: proper subsets A of a frequent I with f(I) / f(A) high enough.

    Subsets are enumerated inside each itemset by bit masks and joined by equality, so itemsets of n items cost 2^n - 2 rows;
    those of more than 30 items, which cost a thousand million, end in an error.
    """
    big = itemsets.where("size(items) > 1").select(F.col("items").alias("all"), F.col("freq").alias("f_all"))
    most = "if(size(`all`) <= 30, shiftleft(1L, size(`all`)) - 2, raise_error('an itemset of more than 30 items'))"
    mask = big.select("*", F.explode(F.expr(f"sequence(1L, {most})")).alias("mask"))
    ante = mask.select("all", "f_all", F.expr("filter(`all`, (x, i) -> getbit(mask, i) = 1)").alias("items"))
    met = ante.join(itemsets.select("items", "freq"), "items").withColumn("confidence", F.col("f_all") / F.col("freq")).where(F.col("confidence") >= min_confidence)
    return met.select(F.col("items").alias("antecedent"), F.array_except("all", "items").alias("consequent"), "confidence")


def pairs(baskets: DataFrame, min_support: int = 3) -> DataFrame:
    """(a, b, n) of item pairs; each basket's pairs come from its own short list."""
    listed = baskets.select(F.array_sort(F.array_distinct("items")).alias("items"))
    first = listed.select("items", F.posexplode("items").alias("i", "a"))
    both = first.select("a", F.explode(F.expr("slice(items, i + 2, size(items))")).alias("b"))
    return both.groupBy("a", "b").agg(F.count("*").alias("n")).where(F.col("n") >= min_support)
