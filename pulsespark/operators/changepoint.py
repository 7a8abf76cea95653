"""Change points of one series at a time: penalised kernel segmentation, binary segmentation, dynamic programming.

These are sequential by definition; series are what a key's calendar has, some thousand places.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

_OUT = "key string, at long"


def _by_key(series: DataFrame, find) -> DataFrame:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx")
        return pd.DataFrame([(pdf["key"].iloc[0], int(i)) for i in find(pdf["y"].to_numpy(float))], columns=["key", "at"])

    return series.select("key", "idx", "y").groupBy("key").applyInPandas(run, _OUT)


def _middle_distance(y: np.ndarray) -> float:
    """The median of the positive squared distances of all pairs, from the distinct values and how often each occurs."""
    values, times = np.unique(y, return_counts=True)
    if len(values) < 2:
        return 1.0
    gaps: dict[float, int] = {}
    for i in range(len(values) - 1):
        found, at = np.unique(np.square(values[i + 1 :] - values[i]), return_inverse=True)
        for gap, n in zip(found.tolist(), np.bincount(at, times[i + 1 :] * times[i]).tolist()):
            gaps[gap] = gaps.get(gap, 0) + int(n)
    order = sorted(gaps)
    upto = np.cumsum([gaps[g] for g in order])
    half = upto[-1] / 2
    low, high = order[int(np.searchsorted(upto, half, "left"))], order[int(np.searchsorted(upto, half, "right"))]
    return (low + high) / 2


def pelt(series: DataFrame, penalty: float = 10, least: int = 2) -> DataFrame:
    """Optimal segmentation for a penalty with pruning under the Gaussian kernel.

    A segment costs its length less the mean of its kernel values.  The sums of kernel values from each start to the present
    place grow by one row of the kernel a place, so memory is linear in the series and time its square.
    """

    def find(y: np.ndarray) -> list[int]:
        n = len(y)
        scale, best, last, live = _middle_distance(y), np.full(n + 1, np.inf), np.zeros(n + 1, int), np.zeros(1, int)
        best[0] = -penalty
        inside = np.zeros(n + 1)
        for t in range(1, n + 1):
            row = np.exp(-np.clip(np.square(y[:t] - y[t - 1]) / scale, 1e-2, 1e2))
            inside[:t] += 2 * row[::-1].cumsum()[::-1] - row[-1]
            if t < least:
                continue
            starts = live[t - live >= least]
            if len(starts):
                total = best[starts] + (t - starts) - inside[starts] / (t - starts) + penalty
                i = int(total.argmin())
                best[t], last[t] = total[i], starts[i]
                live = np.setdiff1d(live, starts[total - penalty > best[t]], assume_unique=True)
            if t - least + 1 > 0:
                live = np.append(live, t - least + 1)
        out, t = [], n
        while t and last[t]:
            t = int(last[t])
            out.append(t)
        return sorted(out)

    return _by_key(series, find)


def binary_segmentation(series: DataFrame, points: int = 10, least: int = 2) -> DataFrame:
    """Splits one after another where the squared error falls most, prefix sums giving each cost at once."""

    def find(y: np.ndarray) -> list[int]:
        s, q = np.append(0, y.cumsum()), np.append(0, np.square(y).cumsum())
        sse = lambda a, b: q[b] - q[a] - np.square(s[b] - s[a]) / np.maximum(b - a, 1)
        ends, out = [(0, len(y))], []
        while len(out) < points:
            found = []
            for a, b in ends:
                at = np.arange(a + least, b - least + 1)
                if len(at):
                    gain = sse(a, b) - sse(a, at) - sse(at, b)
                    found.append((float(gain.max()), int(at[gain.argmax()]), (a, b)))
            if not found or max(found)[0] <= 0:
                break
            _, at, (a, b) = max(found, key=lambda f: (f[0], -f[1]))
            ends = [e for e in ends if e != (a, b)] + [(a, at), (at, b)]
            out.append(at)
        return sorted(out)

    return _by_key(series, find)


def dynamic(series: DataFrame, points: int = 10, least: int = 3, jump: int = 5) -> DataFrame:
    """The best segmentation into points + 1 pieces by absolute error around medians, cuts at multiples of jump."""

    def find(y: np.ndarray) -> list[int]:
        grid = [i for i in range(0, len(y), jump)] + [len(y)]
        grid = sorted(set(grid))
        m = len(grid)
        k = min(points, m - 2)
        if k < 1:
            return []
        cost = np.full((m, m), np.inf)
        for a in range(m):
            low, high, under, over = [], [], 0.0, 0.0  # the halves under (negated) and over the running median, and their sums
            for b in range(a + 1, m):
                for v in y[grid[b - 1] : grid[b]].tolist():
                    moved = -heapq.heappushpop(low, -v)
                    heapq.heappush(high, moved)
                    under, over = under + v - moved, over + moved
                    if len(high) > len(low):
                        moved = heapq.heappop(high)
                        heapq.heappush(low, -moved)
                        under, over = under + moved, over - moved
                if grid[b] - grid[a] >= least:
                    cost[a, b] = over - under - (len(low) - len(high)) * low[0]
        best, back = [cost[0]], []
        for _ in range(k):
            total = best[-1][:, None] + cost
            back.append(total.argmin(0))
            best.append(total.min(0))
        out, at = [], m - 1
        for b in reversed(back):
            at = int(b[at])
            out.append(grid[at])
        return sorted(out)

    return _by_key(series, find)
