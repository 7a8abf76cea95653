"""Dense count series, peaks, groups of peaks, and the extent of bursts.  Everything is expressions over one partitioning by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def epoch_seconds(t: Column) -> Column:
    """An epoch of any number of digits, cut or padded with zeros to ten."""
    digits = F.abs(t).cast("string")
    return F.when(t.isNotNull(), F.rpad(digits, 10, "0").cast("long") * F.signum(t).cast("long"))


def dense_counts(rows: DataFrame, key: Column, ts: Column, grain: str = "day") -> DataFrame:
    """(key, bucket, idx, y, n): counts per key and bucket of time, zero where nothing happened, from the key's first to last bucket.

    Rows without a key or time are left out.  n is the length of the key's series and idx counts from 0.
    """
    found = rows.select(key.cast("string").alias("key"), F.date_trunc(grain, ts).cast("timestamp_ntz").alias("bucket")).dropna().groupBy("key", "bucket").agg(F.count("*").alias("y"))
    ends = found.groupBy("key").agg(F.min("bucket").alias("a"), F.max("bucket").alias("b"))
    every = F.sequence("a", "b", F.expr(f"interval 1 {grain}"))
    calendar = ends.select("key", F.size(every).cast("long").alias("n"), F.posexplode(every).alias("idx", "bucket"))
    return calendar.join(found, ["key", "bucket"], "left").select("key", "bucket", F.col("idx").cast("long").alias("idx"), F.coalesce("y", F.lit(0)).alias("y"), "n")


def _over(key: str = "key") -> Window:
    return Window.partitionBy(key).orderBy("idx")


def ratio_bursts(series: DataFrame, threshold: float = 10) -> DataFrame:
    """Places whose count is more than threshold times the one before; any rise from 0 counts, 0 after 0 does not."""
    return series.withColumn("before", F.lag("y").over(_over())).where(F.col("y") > threshold * F.col("before"))


def cumulative(series: DataFrame) -> DataFrame:
    return series.withColumn("total", F.sum("y").over(_over().rowsBetween(Window.unboundedPreceding, 0)))


def peak_measure(series: DataFrame, k: int = 5, method: str = "mean") -> DataFrame:
    """Interior places with m, the measure times a constant (2k for mean, 2 for max), an integer.

    mean: the sum of the differences to up to k neighbours on the left and k - 1 on the right, of which the series' last is
    never one.  max: the largest difference on either side, added; without a right neighbour there is no measure.
    """
    left = _over().rowsBetween(-k, -1)
    right = _over().rowsBetween(1, k - 1) if k > 1 else None
    inner = F.when(F.col("idx") < F.col("n") - 1, F.col("y"))
    none = F.lit(None).cast("long")
    of = lambda f, side, what: f(what).over(side) if side is not None else none
    if method == "mean":
        cells = F.count("y").over(left) + F.coalesce(of(F.count, right, inner), F.lit(0))
        total = F.coalesce(F.sum("y").over(left), F.lit(0)) + F.coalesce(of(F.sum, right, inner), F.lit(0))
        m = cells * F.col("y") - total
    elif method == "max":
        m = 2 * F.col("y") - F.min("y").over(left) - of(F.min, right, inner)
    else:
        raise ValueError(f"method {method!r} is neither mean nor max")
    return series.withColumn("m", m).where("idx between 1 and n - 2 and m is not null")


def peaks(measured: DataFrame, bh: int = 3, ch: int = 1000) -> DataFrame:
    """Places whose measure lies between bh and ch population standard deviations above the mean of the key, in exact integers.

    With count N, sum S and sum of squares Q of the measures: (N m - S) >= 0 and bh^2 V <= (N m - S)^2 <= ch^2 V, V = N Q - S^2.
    A constant series has V = 0 and every interior place passes.
    """
    whole = Window.partitionBy("key")
    wide = lambda c: c.cast("decimal(19,0)")
    n, s, q = F.count("m").over(whole), F.sum("m").over(whole), F.sum(wide(F.col("m")) * wide(F.col("m"))).over(whole)
    rows = measured.select("*", wide(n).alias("_n"), wide(s).alias("_s"), q.cast("decimal(38,0)").alias("_q"))
    rows = rows.withColumn("_d", (F.col("_n") * wide(F.col("m")) - F.col("_s")).cast("decimal(19,0)")).withColumn("_v", (F.col("_n") * F.col("_q") - F.col("_s") * F.col("_s")).cast("decimal(32,0)"))
    square = (F.col("_d") * F.col("_d")).cast("decimal(38,0)")
    return rows.where((F.col("_d") >= 0) & (square >= F.lit(bh * bh) * F.col("_v")) & (square <= F.lit(ch * ch) * F.col("_v"))).drop("_n", "_s", "_q", "_d", "_v")


def peak_groups(found: DataFrame, gap: int = 15) -> DataFrame:
    """(key, n, groups): peaks from the highest on join the first head nearer than gap or become heads; groups by head.

    The fold runs over the peaks of one key, which the threshold keeps few.
    """
    listed = found.groupBy("key", "n").agg(F.sort_array(F.collect_list(F.struct((-F.col("y")).alias("minus"), F.col("idx")))).alias("p"))
    empty = F.array().cast("array<struct<head:bigint,members:array<bigint>>>")

    def step(acc: Column, p: Column) -> Column:
        near = lambda g: F.abs(p["idx"] - g["head"]) < gap
        first = F.array_position(F.transform(acc, near), True)
        grown = F.transform(acc, lambda g, i: F.struct(g["head"].alias("head"), F.when(i + 1 == first, F.array_append(g["members"], p["idx"])).otherwise(g["members"]).alias("members")))
        return F.when(first > 0, grown).otherwise(F.array_append(acc, F.struct(p["idx"].alias("head"), F.array(p["idx"]).alias("members"))))

    return listed.select("key", "n", F.array_sort(F.aggregate("p", empty, step)).alias("groups"))


def peak_heads(series: DataFrame, k: int = 5, bh: int = 3, ch: int = 1000, method: str = "mean", gap: int = 15) -> DataFrame:
    """(key, n, head, y) of every group of peaks."""
    groups = peak_groups(peaks(peak_measure(series, k, method), bh, ch), gap)
    heads = groups.select("key", F.explode("groups").alias("g")).select("key", F.col("g.head").alias("idx"))
    return heads.join(series, ["key", "idx"]).select("key", "n", F.col("idx").alias("head"), "y", "bucket")


def select_bursts(heads: DataFrame, min_y: int = 100, min_start: int = 30) -> DataFrame:
    """Heads with room on both sides and height enough."""
    return heads.where(F.least(F.col("head"), F.col("n") - F.col("head")) >= min_start).where(F.col("y") >= min_y)


def select_guarded(heads: DataFrame, min_y: int = 200, min_start: int = 30) -> DataFrame:
    """High heads of the keys none of whose heads comes within the first places; the end has no bound."""
    return heads.withColumn("lowest", F.min("head").over(Window.partitionBy("key"))).where(F.col("lowest") > min_start).where(F.col("y") >= min_y).drop("lowest")


def select_influential(heads: DataFrame, width: int = 30, min_y: int = 300) -> DataFrame:
    return heads.where(f"head > {width} and n - head > {width} and n - 1 - head >= {width}").where(F.col("y") >= min_y)


def big_days(series: DataFrame, least: int) -> DataFrame:
    return series.where(F.col("y") >= least).withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy("idx")).cast("long"))


def extents(heads: DataFrame, series: DataFrame, width: int = 15, legacy_end: bool = False) -> DataFrame:
    """Heads with start and end, the knees of a triangle over width places either side; null where the window leaves the series' start.

    start is the first place with the largest i*y_b - w*y_i above 0, else the window's start; end likewise with
    (2w+1-j)*y_b - (w+1)*y_j, else the head itself (with legacy_end the window's start).
    """
    w = width
    spread = heads.where(f"head >= {w}").select("key", "head", F.col("y").alias("yb"), F.explode(F.sequence(F.col("head") - w, F.col("head") + w)).alias("idx"))
    local = spread.join(series.select("key", "idx", "y"), ["key", "idx"]).withColumn("i", F.col("idx") - F.col("head") + w)
    score = F.when(F.col("i") < w, F.col("i") * F.col("yb") - w * F.col("y")).when(F.col("i") > w, (2 * w + 1 - F.col("i")) * F.col("yb") - (w + 1) * F.col("y"))
    local = local.withColumn("score", score).where("score > 0")
    side = lambda on: F.min_by(F.when(on, F.col("idx")), F.when(on, F.struct(-F.col("score"), F.col("idx"))))
    knees = local.groupBy("key", "head").agg(side(F.col("i") < w).alias("s"), side(F.col("i") > w).alias("e"))
    out = heads.join(knees, ["key", "head"], "left")
    inside = F.col("head") >= w
    return out.select(
        *heads.columns, F.when(inside, F.coalesce("s", F.col("head") - w)).alias("start"), F.when(inside, F.coalesce("e", F.col("head") - w if legacy_end else F.col("head"))).alias("end")
    )


def influence_windows(bursts: DataFrame, series: DataFrame, width: int = 30) -> DataFrame:
    """(key, head, bucket, value, attr, idx): width values before a burst's start, the burst, and width values after its end."""
    spread = bursts.select("key", "head", "start", "end", F.explode(F.sequence(F.col("start") - width, F.col("end") + width)).alias("idx"))
    attr = F.when(F.col("idx") < F.col("start"), "former").when(F.col("idx") <= F.col("end"), "breakout").otherwise("after")
    return spread.join(series.select("key", "idx", "bucket", "y"), ["key", "idx"]).select("key", "head", "bucket", F.col("y").alias("value"), attr.alias("attr"), "idx")


def has_vacuum(values: Column, run: int = 5) -> Column:
    """Whether five zeros follow one another, the search giving up once no more than five values are left.

    So a run counts if it starts where more than `run` values remain, or right after a zero that was looked at before.
    The scan goes on after the first zero found, so every zero with more than `run` values from the scan's place is tried;
    the scan's place is one after the last zero, or the start.
    """
    def step(acc: Column, i: Column) -> Column:
        zero = F.element_at(values, i) == 0
        alive = (F.size(values) - acc["from"] + 1 > run) & ~acc["found"]
        full = (i + run - 1 <= F.size(values)) & F.forall(F.slice(values, i, run), lambda v: v == 0)
        return F.struct(F.when(alive & zero, i + 1).otherwise(acc["from"]).alias("from"), (acc["found"] | (alive & zero & full)).alias("found"))

    first = F.struct(F.lit(1).alias("from"), F.lit(False).alias("found"))
    return F.when(F.size(values) > 0, F.aggregate(F.sequence(F.lit(1), F.size(values)), first, step, lambda a: a["found"])).otherwise(False)


def intervals(bursts: DataFrame) -> DataFrame:
    """Durations, and gaps to the key's next head."""
    return bursts.select("key", "head", (F.col("end") - F.col("start")).alias("duration"), (F.lead("head").over(Window.partitionBy("key").orderBy("head")) - F.col("head")).alias("gap"))


def window_change(series: DataFrame, width: int = 40) -> DataFrame:
    """Local maxima of the least-squares gain of splitting the width places around idx in two, in integers.

    With half h the gain is SSE(whole) - SSE(left) - SSE(right) = (SL - SR)^2 / (2h); gain holds (SL - SR)^2.
    """
    h = width // 2
    left, right = F.sum("y").over(_over().rowsBetween(-h, -1)), F.sum("y").over(_over().rowsBetween(0, h - 1))
    scored = series.where(f"n >= {width}").withColumn("gain", F.pow(left - right, F.lit(2)).cast("long")).where(f"idx between {h} and n - {h}")
    around = _over().rowsBetween(-h, h)
    return scored.withColumn("top", F.max("gain").over(around)).where("gain = top and gain > 0").select("key", "idx", "gain")


def best_split(series: DataFrame) -> DataFrame:
    """(key, at, gain): the first of the splits of a whole series in two that lower its squared error most."""
    total, n = F.sum("y").over(Window.partitionBy("key")), F.col("n")
    before = F.sum("y").over(_over().rowsBetween(Window.unboundedPreceding, -1))
    # SL^2/i + SR^2/(n-i) - S^2/n over the common denominator i (n - i) n, which is (n SL - i S)^2 / (i (n - i) n)
    num = F.pow(n * before - F.col("idx") * total, F.lit(2))
    gain = F.round(num / (F.col("idx") * (n - F.col("idx")) * n), 6)
    scored = series.withColumn("gain", F.when(F.col("idx") >= 1, gain)).where("idx >= 1")
    return scored.groupBy("key").agg(F.min_by("idx", F.struct(-F.col("gain"), F.col("idx"))).alias("at"), F.max("gain").alias("gain"))
