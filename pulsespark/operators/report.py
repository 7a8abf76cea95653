"""Statistics of a census of bursts: distributions, lonely and focus clusters, rank bands, power laws."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: First band that holds the level wins.
BANDS = ((1, 5), (5, 10), (10, 15), (15, 30), (30, 60), (60, 1000))


def value_counts(rows: DataFrame, k: int = 30) -> DataFrame:
    """(cluster, n, density) of the most frequent of rows(cluster), the density being of all of them."""
    counted = rows.groupBy("cluster").agg(F.count("*").alias("n"))
    total = rows.agg(F.count("*").alias("total"))
    return counted.orderBy(F.desc("n"), "cluster").limit(k).crossJoin(F.broadcast(total)).select("cluster", "n", (F.col("n") / F.col("total")).alias("density"))


def lonely(census: DataFrame) -> DataFrame:
    return census.withColumn("lonely", F.count("*").over(Window.partitionBy("track_id")) == 1)


def event_topic_share(counts: DataFrame, kinds: DataFrame) -> DataFrame:
    """Shares of events and topics among counts(cluster, n) by kinds(cluster, kind)."""
    of = lambda k: F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0))
    both = counts.join(kinds, "cluster").agg(of("event").alias("events"), of("topic").alias("topics"))
    total = F.col("events") + F.col("topics")
    return both.select("events", "topics", F.round(F.try_divide("events", total), 6).alias("event_share"), F.round(F.try_divide("topics", total), 6).alias("topic_share"))


def focus_clusters(rows: DataFrame) -> DataFrame:
    """(track_id, cluster) of clusters that occur in every burst of a track with several; rows(track_id, flag, cluster)."""
    bursts = rows.groupBy("track_id").agg(F.countDistinct("flag").alias("bursts")).where("bursts > 1")
    return rows.groupBy("track_id", "cluster").agg(F.countDistinct("flag").alias("n")).join(bursts, "track_id").where("n = bursts").select("track_id", "cluster")


def bands(rows: DataFrame, ranges: Sequence[tuple[int, int]] = BANDS) -> DataFrame:
    """rows(n, ...) with the first band of n // 100; rows of no band are left out."""
    level, band = F.floor(F.col("n") / 100), F.lit(None).cast("string")
    for lo, hi in reversed(ranges):
        band = F.when(level.between(lo, hi), f"{lo}-{hi}").otherwise(band)
    return rows.withColumn("band", band).where("band is not null")


def band_counts(rows: DataFrame, show: int = 8) -> DataFrame:
    """(band, cluster, n): the first clusters of each band, the others summed; where a band has more than 20, clusters of 1 go."""
    counted = rows.groupBy("band", "cluster").agg(F.count("*").alias("n")).withColumn("total", F.sum("n").over(Window.partitionBy("band")))
    kept = counted.where("not (total > 20 and n <= 1)").withColumn("r", F.row_number().over(Window.partitionBy("band").orderBy(F.desc("n"), "cluster")))
    return kept.groupBy("band", F.when(F.col("r") <= show, F.col("cluster")).otherwise("others").alias("cluster")).agg(F.sum("n").alias("n"))


def band_shares(counts: DataFrame, ranges: Sequence[tuple[int, int]] = BANDS) -> DataFrame:
    """A column a band with the cluster's share in it, 0 where absent."""
    shares = counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("band")), 6))
    names = [f"{a}-{b}" for a, b in ranges]
    return shares.groupBy("cluster").pivot("band", names).agg(F.first("share")).fillna(0.0, names)


def power_law(rows: DataFrame, key: str = "key", value: str = "x") -> DataFrame:
    """(key, slope, sigma, mean): a line through log-binned counts, nulls where three points or fewer are left.

    Ten log-spaced bins a decade from minimum to maximum, edges floored but the last raised, equal edges merged, the last
    bin closed; points are the bins' middles and counts; sigma is the root mean square error over the mean log count.
    """
    v = rows.select(F.col(key).alias("key"), F.col(value).cast("double").alias("x"))
    ends = v.groupBy("key").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.avg("x").alias("mean"))
    lo, hi = F.log10("lo"), F.log10("hi")
    n = F.ceil(F.round(10 * (hi - lo), 9)).cast("int")
    raw = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.pow(F.lit(10.0), lo + (hi - lo) * i / F.greatest(n - 1, F.lit(1))))
    edge = F.transform(raw, lambda e, i: F.when(i == F.size(raw) - 1, F.ceil(F.round(e, 6))).otherwise(F.floor(F.round(e, 6))).cast("double"))
    edges = ends.select("key", "mean", F.array_sort(F.array_distinct(edge)).alias("e"))
    binned = v.join(edges, "key").select("key", "mean", "e", F.expr("least(size(filter(e, t -> t <= x)), size(e) - 1)").alias("b")).where("b >= 1")
    points = binned.groupBy("key", "mean", "b").agg(F.log10(F.count("*").cast("double")).alias("y"), F.log10(F.first(F.expr("(e[b - 1] + e[b]) / 2"))).alias("x"))
    fits = points.groupBy("key", "mean").agg(F.count("*").alias("points"), F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("cut"))
    err = points.join(fits, ["key", "mean"]).groupBy("key", "mean", "points", "slope").agg(
        F.sqrt(F.avg(F.pow(F.col("y") - F.col("slope") * F.col("x") - F.col("cut"), F.lit(2)))).alias("rmse"), F.avg("y").alias("my"))
    return err.select("key", F.when(F.col("points") > 3, F.round("slope", 6)).alias("slope"), F.when(F.col("points") > 3, F.round(F.try_divide("rmse", "my"), 6)).alias("sigma"), F.round("mean", 6).alias("mean"))


def _zeta(a: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The sum over k of (q + k)^-a, times q^a, so that no power vanishes: 16 terms, the others by Euler and Maclaurin."""
    r = q + 16.0
    head = sum(np.exp(-a * np.log1p(k / q)) for k in range(16))
    f = a / r
    g = f * (a + 1) / r * (a + 2) / r
    rest = r / (a - 1) + 0.5 + f / 12 - g / 720 + g * (a + 3) / r * (a + 4) / r / 30240
    return head + np.exp(-a * np.log(r / q)) * rest


def _alphas(q: np.ndarray, mean_log: np.ndarray, bounded: bool) -> np.ndarray:
    """The most likely alpha of each tail from q on, of which mean_log is the mean of log(x / q)."""

    def rising(a):
        h = 1e-4
        return -(np.log(_zeta(a + h, q)) - np.log(_zeta(a - h, q))) / (2 * h) > mean_log

    lo, hi = np.full(len(q), 1.01), np.full(len(q), 8.0)
    while not bounded and (up := rising(hi)).any() and hi.max() < 1e12:
        lo, hi = np.where(up, hi, lo), np.where(up, 2 * hi, hi)
    for _ in range(60):  # the likelihood's slope in alpha falls, so halve
        a = (lo + hi) / 2
        up = rising(a)
        lo, hi = np.where(up, a, lo), np.where(up, hi, a)
    return (lo + hi) / 2


def power_law_mle(rows: DataFrame, key: str = "key", value: str = "x") -> DataFrame:
    """(key, alpha, xmin, n_tail, exp_rate): discrete maximum likelihood at the xmin of least Kolmogorov distance, among the values' histogram.

    Each key's histogram is worked on, not its rows; every distinct value but the largest is tried, which costs the square of
    their number.  exp_rate is that of the exponential fitted to the same tail; a key of one value has an alpha of 8.
    """
    histogram = rows.select(F.col(key).cast("string").alias("key"), F.col(value).cast("long").alias("x")).where("x >= 1").groupBy("key", "x").agg(F.count("*").alias("n"))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("x")
        x, n = pdf["x"].to_numpy(float), pdf["n"].to_numpy(float)
        tails = lambda v: v[::-1].cumsum()[::-1]
        size, mean = tails(n), tails(n * x) / tails(n)
        tried = max(1, len(x) - 1)
        alpha = _alphas(x[:tried], (tails(n * np.log(x)) / size - np.log(x))[:tried], bounded=len(x) == 1)
        best = None
        for i, a in enumerate(alpha):
            beyond = np.exp(-a * np.log((x[i:] + 1) / x[i])) * _zeta(a, x[i:] + 1) / _zeta(a, x[i])
            distance = float(np.abs(n[i:].cumsum() / size[i] - (1 - beyond)).max())
            if best is None or distance < best[0] - 1e-12:
                best = (distance, float(a), int(x[i]), int(size[i]), 1 / max(float(mean[i] - x[i]), 1e-9))
        return pd.DataFrame([(pdf["key"].iloc[0], *best[1:])], columns=["key", "alpha", "xmin", "n_tail", "exp_rate"])

    return histogram.groupBy("key").applyInPandas(fit, "key string, alpha double, xmin long, n_tail long, exp_rate double")
