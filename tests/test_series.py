"""Series operators against plain restatements of their rules, on random and on edge series."""

import random

import pytest
from pyspark.sql import functions as F

from pulsespark.operators import changepoint, influence
from pulsespark.operators import series as S


def frame(spark, series: dict[str, list[int]]):
    rows = [(k, i, y, len(ys)) for k, ys in series.items() for i, y in enumerate(ys)]
    return spark.createDataFrame(rows, "key string, idx long, y long, n long").withColumn("bucket", F.col("idx"))


def plain_measures(y, k, method):
    n, out = len(y), {}
    for i in range(1, n - 1):
        left, right = y[max(0, i - k) : i], y[i + 1 : min(i + k, n - 1)]
        if method == "mean":
            out[i] = (len(left) + len(right)) * y[i] - sum(left) - sum(right)
        elif right:
            out[i] = 2 * y[i] - min(left) - min(right)
    return out


def plain_heads(y, k, bh, gap):
    m = plain_measures(y, k, "mean")
    n, s, q = len(m), sum(m.values()), sum(v * v for v in m.values())
    peaks = [i for i, v in m.items() if n * v - s >= 0 and (n * v - s) ** 2 >= bh * bh * (n * q - s * s)]
    heads = []
    for p in sorted(peaks, key=lambda i: (-y[i], i)):
        if not any(abs(p - h) < gap for h in heads):
            heads.append(p)
    return sorted(heads)


@pytest.fixture(scope="module")
def some():
    rng = random.Random(4)
    out = {f"r{i}": [rng.choice((0, 1, 2, 3, 3, 9, 40)) if rng.random() < 0.9 else rng.randrange(200) for _ in range(rng.randint(3, 90))] for i in range(25)}
    return out | {"flat": [5] * 9, "one": [3], "two": [3, 4], "ties": [0, 9, 0, 0, 9, 0, 0, 0, 9, 0] * 4}


@pytest.mark.parametrize("method", ["mean", "max"])
@pytest.mark.parametrize("k", [1, 2, 5])
def test_measures(spark, some, k, method):
    got = {(r.key, r.idx): r.m for r in S.peak_measure(frame(spark, some), k, method).collect()}
    assert got == {(key, i): m for key, y in some.items() for i, m in plain_measures(y, k, method).items()}


def test_heads_and_groups(spark, some):
    series = frame(spark, some)
    got = {}
    for r in S.peak_heads(series, bh=1, gap=7).collect():
        got.setdefault(r.key, []).append(r.head)
    want = {k: plain_heads(y, 5, 1, 7) for k, y in some.items()}
    assert {k: sorted(v) for k, v in got.items()} == {k: v for k, v in want.items() if v}
    assert want["flat"] == [1]  # no deviation: every interior place is a peak, one group
    groups = S.peak_groups(S.peaks(S.peak_measure(series), 1), 7).collect()
    for r in groups:
        members = [m for g in r.groups for m in g.members]
        assert len(members) == len(set(members)) and all(abs(m - g.head) < 7 for g in r.groups for m in g.members)


def test_extents(spark, some):
    w = 6
    series = frame(spark, some)
    heads = spark.createDataFrame([(k, len(y), b, y[b]) for k, y in some.items() for b in range(len(y))], "key string, n long, head long, y long")

    def plain(y, b, legacy):
        if b < w:
            return None, None
        local = {i: y[b - w + i] for i in range(2 * w + 1) if b - w + i < len(y)}
        s = {i: i * y[b] - w * v for i, v in local.items() if i < w}
        e = {j: (2 * w + 1 - j) * y[b] - (w + 1) * v for j, v in local.items() if j > w}
        start = max(s, key=lambda i: (s[i], -i))
        end = max(e, key=lambda i: (e[i], -i), default=None)
        return b - w + (start if s[start] > 0 else 0), b - w + (end if end is not None and e[end] > 0 else 0 if legacy else w)

    for legacy in (False, True):
        for r in S.extents(heads, series, w, legacy).collect():
            assert (r.start, r.end) == plain(some[r.key], r.head, legacy)


def test_vacuum(spark):
    def plain(values):
        while len(values) > 5 and 0 in values:
            at = values.index(0)
            if len(values[at : at + 5]) == 5 and not any(values[at : at + 5]):
                return True
            values = values[at + 1 :]
        return False

    rng = random.Random(9)
    lists = [[0] * 5, [0] * 6, [1] + [0] * 5, [0, 0, 0, 0, 1, 0, 0, 0, 0, 0], []] + [[rng.choice((0, 0, 0, 1)) for _ in range(rng.randint(0, 14))] for _ in range(300)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "i int, v array<long>")
    got = {r.i: r.x for r in df.select("i", S.has_vacuum(F.col("v")).alias("x")).collect()}
    assert got == {i: plain(x) for i, x in enumerate(lists)}


def test_selection_modes(spark):
    heads = spark.createDataFrame([("a", 100, 29, 500), ("a", 100, 50, 500), ("b", 100, 40, 150), ("b", 100, 71, 500)], "key string, n long, head long, y long")
    pairs = lambda df: sorted((r.key, r.head) for r in df.collect())
    assert pairs(S.select_bursts(heads)) == [("a", 50), ("b", 40)]
    assert pairs(S.select_guarded(heads)) == [("b", 71)]
    assert pairs(S.select_influential(heads, 30, 100)) == [("a", 50), ("b", 40)]


def test_ratio_and_dense(spark):
    rows = spark.createDataFrame([("a", "2020-01-01 05:00:00"), ("a", "2020-01-04 00:00:00"), ("a", "2020-01-04 07:00:00"), (None, "2020-01-01 00:00:00"), ("b", None)], "k string, t string")
    dense = S.dense_counts(rows, F.col("k"), F.col("t").cast("timestamp"), "day")
    assert [(r.idx, r.y, r.n) for r in dense.orderBy("idx").collect()] == [(0, 1, 4), (1, 0, 4), (2, 0, 4), (3, 2, 4)]
    assert [(r.key, r.idx) for r in S.ratio_bursts(dense, 10).collect()] == [("a", 3)]


def test_epochs(spark):
    df = spark.createDataFrame([(1577836800123,), (1577836800,), (15,), (None,)], "t long").select(S.epoch_seconds(F.col("t")).alias("e"))
    assert [r.e for r in df.collect()] == [1577836800, 1577836800, 1500000000, None]


def test_change_points(spark):
    step = {"s": [0] * 40 + [30] * 40 + [5] * 40}
    series = frame(spark, step)
    assert {r["at"] for r in changepoint.binary_segmentation(series, 2).collect()} == {40, 80}
    assert {r["at"] for r in changepoint.dynamic(series, 2).collect()} == {40, 80}
    assert {r["at"] for r in changepoint.pelt(series, 3).collect()} == {40, 80}
    assert {r["idx"] for r in S.window_change(series, 20).collect()} >= {40, 80}
    assert S.best_split(frame(spark, {"t": [0] * 10 + [9] * 10})).first()["at"] == 10


def test_garch_finds_a_shift(spark):
    rng = random.Random(2)
    rows = [("k", 1, "former" if i < 60 else "after", 20.0 + rng.gauss(0, 1) + 30 * (i >= 60), i) for i in range(120)]
    fits = influence.garch(spark.createDataFrame(rows, "key string, head long, attr string, value double, idx long"))
    found = {r.name: r for r in fits.collect()}
    assert abs(found["mu"].estimate - 20) < 3 and abs(found["mxreg1"].estimate - 30) < 4
    assert [r.special_type for r in influence.significant(fits).collect()][:1] == ["mu"]
