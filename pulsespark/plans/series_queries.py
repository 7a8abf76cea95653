"""Queries over dense series: orders by priority and day, events by type and hour."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import series as S
from ..sources.tables import table

BH, MIN_Y = 2, 9


def daily(spark: SparkSession, d: str) -> DataFrame:
    return S.dense_counts(table(spark, d, "orders"), F.col("o_orderpriority"), F.col("o_orderdate"), "day")


def hourly(spark: SparkSession, d: str) -> DataFrame:
    return S.dense_counts(table(spark, d, "events"), F.col("event_type"), F.col("ts"), "hour")


def _sql(table_: str, key: str, ts: str, grain: str) -> str:
    return f"""WITH RECURSIVE b AS (SELECT {key} AS key, date_trunc('{grain}', {ts})::TIMESTAMP AS bucket, count(*) AS y FROM {table_} WHERE {key} IS NOT NULL AND {ts} IS NOT NULL GROUP BY ALL),
cal AS (SELECT key, unnest(range(min(bucket), max(bucket) + INTERVAL 1 {grain}, INTERVAL 1 {grain})) AS bucket FROM b GROUP BY key),
seq AS (SELECT cal.key, cal.bucket, row_number() OVER (PARTITION BY cal.key ORDER BY cal.bucket) - 1 AS idx, coalesce(b.y, 0) AS y, count(*) OVER (PARTITION BY cal.key) AS n FROM cal LEFT JOIN b ON b.key = cal.key AND b.bucket = cal.bucket)"""


DAILY = _sql("orders", "o_orderpriority", "o_orderdate", "day")
HOURLY = _sql("events", "event_type", "ts", "hour")


def _measure(k: int = 5, method: str = "mean") -> str:
    over = "OVER (PARTITION BY key ORDER BY idx ROWS BETWEEN"
    left, right = f"{over} {k} PRECEDING AND 1 PRECEDING)", f"{over} 1 FOLLOWING AND {k - 1} FOLLOWING)"
    inner = "CASE WHEN idx < n - 1 THEN y END"
    m = (
        f"(count(y) {left} + count({inner}) {right}) * y - coalesce(sum(y) {left}, 0) - coalesce(sum({inner}) {right}, 0)" if method == "mean"
        else f"2 * y - min(y) {left} - min({inner}) {right}"
    )
    return f", m0 AS (SELECT *, ({m})::BIGINT AS m FROM seq), me AS (SELECT * FROM m0 WHERE idx BETWEEN 1 AND n - 2 AND m IS NOT NULL)"


def _peaks(bh: int = 3, ch: int = 1000, **how) -> str:
    return _measure(**how) + f""", st AS (SELECT *, count(m) OVER w AS cn, (sum(m) OVER w)::HUGEINT AS cs, (sum(m::HUGEINT * m) OVER w)::HUGEINT AS cq FROM me WINDOW w AS (PARTITION BY key)),
pk AS (SELECT key, bucket, idx, y, n, m FROM st WHERE cn * m - cs >= 0 AND (cn * m - cs) * (cn * m - cs) BETWEEN {bh * bh} * (cn * cq - cs * cs) AND {ch * ch}::HUGEINT * (cn * cq - cs * cs))"""


def _heads(bh: int = 3, gap: int = 15) -> str:
    return _peaks(bh) + f""", o AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY y DESC, idx) AS r FROM pk),
g AS (SELECT key, n, r, [idx] AS heads, idx AS head FROM o WHERE r = 1
  UNION ALL SELECT o.key, o.n, o.r, CASE WHEN len(list_filter(g.heads, lambda h: abs(o.idx - h) < {gap})) > 0 THEN g.heads ELSE list_append(g.heads, o.idx) END,
    CASE WHEN len(list_filter(g.heads, lambda h: abs(o.idx - h) < {gap})) > 0 THEN list_filter(g.heads, lambda h: abs(o.idx - h) < {gap})[1] ELSE o.idx END
  FROM g JOIN o ON o.key = g.key AND o.r = g.r + 1),
hd AS (SELECT DISTINCT s.key, s.n, g.head, s.y, s.bucket FROM g JOIN seq s ON s.key = g.key AND s.idx = g.head)"""


def _extent(width: int = 15) -> str:
    w = width
    return f""", sp AS (SELECT h.key, h.head, s.idx, s.idx - h.head + {w} AS i, h.y AS yb, s.y FROM hd h JOIN seq s ON s.key = h.key AND s.idx BETWEEN h.head - {w} AND h.head + {w} WHERE h.head >= {w}),
sc AS (SELECT *, CASE WHEN i < {w} THEN i * yb - {w} * y WHEN i > {w} THEN ({2 * w + 1} - i) * yb - {w + 1} * y END AS s FROM sp),
kn AS (SELECT key, head, arg_min(idx, [-s, idx]) FILTER (i < {w}) AS st, arg_min(idx, [-s, idx]) FILTER (i > {w}) AS en FROM sc WHERE s > 0 GROUP BY ALL),
ex AS (SELECT h.*, CASE WHEN h.head >= {w} THEN coalesce(st, h.head - {w}) END AS "start", CASE WHEN h.head >= {w} THEN coalesce(en, h.head) END AS "end" FROM hd h LEFT JOIN kn ON kn.key = h.key AND kn.head = h.head)"""


def _heads_of(spark, d, bh=BH):
    return S.peak_heads(hourly(spark, d), bh=bh)


def _extents(spark, d):
    return S.extents(_heads_of(spark, d), hourly(spark, d))


def _plain(df: DataFrame) -> DataFrame:
    return df.withColumn("bucket", F.col("bucket").cast("string")) if "bucket" in df.columns else df


def _q(make):
    return lambda spark, d: _plain(make(spark, d))


B = "strftime(bucket, '%Y-%m-%d %H:%M:%S') AS bucket"
W = 6
_WINDOWS = HOURLY + _heads(BH) + _extent() + f""", wi AS (SELECT e.key, e.head, s.bucket, s.y AS value, CASE WHEN s.idx < e."start" THEN 'former' WHEN s.idx <= e."end" THEN 'breakout' ELSE 'after' END AS attr, s.idx
  FROM ex e JOIN seq s ON s.key = e.key AND s.idx BETWEEN e."start" - {W} AND e."end" + {W})"""


def _vacuum(spark, d):
    windows = S.influence_windows(_extents(spark, d), hourly(spark, d), 20).where("attr <> 'breakout'")
    lists = windows.groupBy("key", "head", "attr").agg(F.transform(F.sort_array(F.collect_list(F.struct("idx", "value"))), lambda s: s["value"] - F.lit(0)).alias("v"))
    thinned = F.transform("v", lambda x: F.greatest(x - 9, F.lit(0)))  # the hours of the test table are never empty
    return lists.select("key", "head", "attr", S.has_vacuum(thinned).alias("vacuum"))


_VACUUM = HOURLY + _heads(BH) + _extent() + """, wi AS (SELECT e.key, e.head, CASE WHEN s.idx < e."start" THEN 'former' ELSE 'after' END AS attr, greatest(s.y - 9, 0) AS v, s.idx
  FROM ex e JOIN seq s ON s.key = e.key AND s.idx BETWEEN e."start" - 20 AND e."end" + 20 WHERE NOT s.idx BETWEEN e."start" AND e."end"),
li AS (SELECT key, head, attr, list(v ORDER BY idx) AS l FROM wi GROUP BY ALL),
sc2(key, head, attr, l, done, yes) AS (SELECT key, head, attr, l, false, false FROM li
  UNION ALL SELECT key, head, attr, CASE WHEN len(l) <= 5 OR list_position(l, 0) IS NULL OR list_position(l, 0) = 0 THEN [] ELSE l[list_position(l, 0) + 1:] END,
    len(l) <= 5 OR coalesce(list_position(l, 0), 0) = 0 OR (len(l[list_position(l, 0):list_position(l, 0) + 4]) = 5 AND list_sum(l[list_position(l, 0):list_position(l, 0) + 4]) = 0),
    len(l) > 5 AND coalesce(list_position(l, 0), 0) > 0 AND len(l[list_position(l, 0):list_position(l, 0) + 4]) = 5 AND list_sum(l[list_position(l, 0):list_position(l, 0) + 4]) = 0
  FROM sc2 WHERE NOT done)
SELECT key, head, attr, bool_or(yes) AS vacuum FROM sc2 GROUP BY ALL"""


def _groups(spark, d):
    g = S.peak_groups(S.peaks(S.peak_measure(hourly(spark, d)), BH)).select("key", F.explode("groups").alias("g"))
    return g.select("key", F.col("g.head").alias("head"), F.size("g.members").cast("long").alias("n_members"), F.array_join(F.transform(F.array_sort("g.members"), lambda x: x.cast("string")), ",").alias("members"))


QUERIES = {
    "daily_dense_sequence": _q(daily),
    "hourly_dense_sequence": _q(hourly),
    "ratio_breakouts": _q(lambda s, d: S.ratio_bursts(daily(s, d), 4).select("key", "idx", "y", "before")),
    "cumulative_counts": _q(lambda s, d: S.cumulative(daily(s, d)).select("key", "idx", "total")),
    "peak_measure_mean": _q(lambda s, d: S.peak_measure(hourly(s, d)).select("key", "idx", "m")),
    "peak_measure_max": _q(lambda s, d: S.peak_measure(hourly(s, d), method="max").select("key", "idx", "m")),
    "peak_threshold": _q(lambda s, d: S.peaks(S.peak_measure(hourly(s, d)), BH).select("key", "idx", "y", "m")),
    "peak_heads_daily": _q(lambda s, d: S.peak_heads(daily(s, d))),
    "peak_heads": _q(_heads_of),
    "peak_groups": _q(_groups),
    "breakouts_selected": _q(lambda s, d: S.select_bursts(_heads_of(s, d), MIN_Y).select("key", "head", "y")),
    "breakouts_track_guard": _q(lambda s, d: S.select_guarded(_heads_of(s, d), MIN_Y, 10).select("key", "head", "y")),
    "breakouts_influential": _q(lambda s, d: S.select_influential(_heads_of(s, d), 30, MIN_Y).select("key", "head", "y")),
    "big_days": _q(lambda s, d: S.big_days(hourly(s, d), 8).select("key", "idx", "y", "rank")),
    "breakout_extent": _q(_extents),
    "influence_windows": _q(lambda s, d: S.influence_windows(_extents(s, d), hourly(s, d), W)),
    "influence_vacuum": _q(_vacuum),
    "breakout_intervals": _q(lambda s, d: S.intervals(_extents(s, d)).fillna(-1, ["gap"])),
    "cpd_window": _q(lambda s, d: S.window_change(daily(s, d))),
    "cpd_binseg_first_split": _q(lambda s, d: S.best_split(daily(s, d))),
}
ORACLE_SQL = {
    "daily_dense_sequence": DAILY + f" SELECT key, {B}, idx, y, n FROM seq",
    "hourly_dense_sequence": HOURLY + f" SELECT key, {B}, idx, y, n FROM seq",
    "ratio_breakouts": DAILY + ", l AS (SELECT key, idx, y, lag(y) OVER (PARTITION BY key ORDER BY idx) AS before FROM seq) SELECT * FROM l WHERE y > 4 * before",
    "cumulative_counts": DAILY + " SELECT key, idx, (sum(y) OVER (PARTITION BY key ORDER BY idx))::BIGINT AS total FROM seq",
    "peak_measure_mean": HOURLY + _measure() + " SELECT key, idx, m FROM me",
    "peak_measure_max": HOURLY + _measure(method="max") + " SELECT key, idx, m FROM me",
    "peak_threshold": HOURLY + _peaks(BH) + " SELECT key, idx, y, m FROM pk",
    "peak_heads_daily": DAILY + _heads() + f" SELECT key, n, head, y, {B} FROM hd",
    "peak_heads": HOURLY + _heads(BH) + f" SELECT key, n, head, y, {B} FROM hd",
    "peak_groups": HOURLY + _heads(BH) + " SELECT g.key, g.head, count(*) AS n_members, string_agg(o.idx::VARCHAR, ',' ORDER BY o.idx) AS members FROM g JOIN o ON o.key = g.key AND o.r = g.r GROUP BY ALL",
    "breakouts_selected": HOURLY + _heads(BH) + f" SELECT key, head, y FROM hd WHERE least(head, n - head) >= 30 AND y >= {MIN_Y}",
    "breakouts_track_guard": HOURLY + _heads(BH) + f" SELECT key, head, y FROM (SELECT *, min(head) OVER (PARTITION BY key) AS lo FROM hd) WHERE lo > 10 AND y >= {MIN_Y}",
    "breakouts_influential": HOURLY + _heads(BH) + f" SELECT key, head, y FROM hd WHERE head > 30 AND n - head > 30 AND n - 1 - head >= 30 AND y >= {MIN_Y}",
    "big_days": HOURLY + " SELECT key, idx, y, row_number() OVER (PARTITION BY key ORDER BY idx) AS rank FROM seq WHERE y >= 8",
    "breakout_extent": HOURLY + _heads(BH) + _extent() + f' SELECT key, n, head, y, {B}, "start", "end" FROM ex',
    "influence_windows": _WINDOWS + f" SELECT key, head, {B}, value, attr, idx FROM wi",
    "influence_vacuum": _VACUUM,
    "breakout_intervals": HOURLY + _heads(BH) + _extent() + ' SELECT key, head, "end" - "start" AS duration, coalesce(lead(head) OVER (PARTITION BY key ORDER BY head) - head, -1) AS gap FROM ex',
    "cpd_window": DAILY + """, s2 AS (SELECT key, idx, n, (sum(y) OVER (PARTITION BY key ORDER BY idx ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) - sum(y) OVER (PARTITION BY key ORDER BY idx ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)) AS df FROM seq WHERE n >= 40),
s3 AS (SELECT key, idx, n, (df * df)::BIGINT AS gain FROM s2 WHERE idx BETWEEN 20 AND n - 20), s4 AS (SELECT *, max(gain) OVER (PARTITION BY key ORDER BY idx ROWS BETWEEN 20 PRECEDING AND 20 FOLLOWING) AS top FROM s3)
SELECT key, idx, gain FROM s4 WHERE gain = top AND gain > 0""",
    "cpd_binseg_first_split": DAILY + """, t AS (SELECT key, idx, n, sum(y) OVER (PARTITION BY key) AS s, sum(y) OVER (PARTITION BY key ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS sl FROM seq),
gg AS (SELECT key, idx, round(pow((n * sl - idx * s)::DOUBLE, 2) / (idx * (n - idx) * n), 6) AS gain FROM t WHERE idx >= 1)
SELECT key, arg_min(idx, [-gain, idx]) AS at, max(gain) AS gain FROM gg GROUP BY key""",
}
