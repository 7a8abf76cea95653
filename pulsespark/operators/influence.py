"""The influence of bursts: AR(1)-GARCH(1,1) with a dummy for the time after, and its significance."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_OUT = "key string, head long, name string, estimate double, se double, p double"
NAMES = ("mu", "ar1", "mxreg1", "omega", "alpha1", "beta1", "vxreg1")


def _loss(t: np.ndarray, y: np.ndarray, after: np.ndarray) -> float:
    mu, ar, mx = t[:3]
    omega, alpha, beta, vx = np.exp(t[3]), 1 / (1 + np.exp(-t[4])), 1 / (1 + np.exp(-t[5])), np.exp(t[6])
    alpha, beta = 0.999 * alpha * (1 - beta) if alpha + beta >= 1 else alpha, beta
    e = np.empty(len(y))
    base = mu + mx * after
    e[0] = y[0] - base[0]
    e[1:] = y[1:] - base[1:] - np.tanh(ar) * (y[:-1] - base[:-1])
    h, total = max(float(e.var()), 1e-6), 0.0
    for i in range(len(y)):
        if i:
            h = omega + alpha * e[i - 1] ** 2 + beta * h + vx * after[i]
        h = min(max(h, 1e-8), 1e12)
        total += math.log(h) + e[i] ** 2 / h
    return 0.5 * total


def _simplex(f, x: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Nelder-Mead."""
    pts = [x] + [x + np.eye(len(x))[i] * (0.5 if abs(x[i]) < 1 else 0.2 * abs(x[i])) for i in range(len(x))]
    val = [f(p) for p in pts]
    for _ in range(rounds):
        order = np.argsort(val)
        pts, val = [pts[i] for i in order], [val[i] for i in order]
        if val[-1] - val[0] < 1e-9:
            break
        mid = np.mean(pts[:-1], 0)
        up = mid + (mid - pts[-1])
        v = f(up)
        if v < val[0]:
            far = mid + 2 * (mid - pts[-1])
            w = f(far)
            pts[-1], val[-1] = (far, w) if w < v else (up, v)
        elif v < val[-2]:
            pts[-1], val[-1] = up, v
        else:
            near = mid + 0.5 * (pts[-1] - mid)
            w = f(near)
            if w < val[-1]:
                pts[-1], val[-1] = near, w
            else:
                pts = [pts[0]] + [pts[0] + 0.5 * (p - pts[0]) for p in pts[1:]]
                val = [val[0]] + [f(p) for p in pts[1:]]
    return pts[int(np.argmin(val))]


def garch(windows: DataFrame) -> DataFrame:
    """(key, head, name, estimate, se, p) of each burst's former and after values of windows(key, head, attr, value, idx).

    Numerical second derivatives give the standard errors; null where they cannot be had.
    """

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf[pdf["attr"] != "breakout"].sort_values("idx")
        y, after = pdf["value"].to_numpy(float), (pdf["attr"] == "after").to_numpy(float)
        if len(y) < 8:
            return pd.DataFrame([], columns=["key", "head", "name", "estimate", "se", "p"])
        f = lambda t: _loss(t, y, after)
        start = np.array([y[after == 0].mean() if (after == 0).any() else y.mean(), 0.1, y[after == 1].mean() - y[after == 0].mean() if 0 < after.sum() < len(y) else 0.0, math.log(y.var() / 2 + 1e-3), -2.0, 0.0, -4.0])
        t = _simplex(f, start)
        k, step = len(t), 1e-3
        hess = np.empty((k, k))
        unit = np.eye(k) * step
        for i in range(k):
            for j in range(k):
                hess[i, j] = (f(t + unit[i] + unit[j]) - f(t + unit[i] - unit[j]) - f(t - unit[i] + unit[j]) + f(t - unit[i] - unit[j])) / (4 * step * step)
        try:
            var = np.diag(np.linalg.inv(hess))
        except np.linalg.LinAlgError:
            var = np.full(k, np.nan)
        value = [t[0], math.tanh(t[1]), t[2], math.exp(t[3]), 1 / (1 + math.exp(-t[4])), 1 / (1 + math.exp(-t[5])), math.exp(t[6])]
        scale = [1, 1 - value[1] ** 2, 1, value[3], value[4] * (1 - value[4]), value[5] * (1 - value[5]), value[6]]
        rows = []
        for name, v, s, w in zip(NAMES, value, scale, var):
            se = float(math.sqrt(w) * abs(s)) if np.isfinite(w) and w > 0 else None
            p = float(math.erfc(abs(v) / se / math.sqrt(2))) if se else None
            rows.append((pdf["key"].iloc[0], int(pdf["head"].iloc[0]), name, float(v), se, p))
        return pd.DataFrame(rows, columns=["key", "head", "name", "estimate", "se", "p"])

    return windows.select("key", "head", "attr", "value", "idx").groupBy("key", "head").applyInPandas(fit, _OUT)


def significant(fits: DataFrame, effect: float = 10, level: float = 0.05) -> DataFrame:
    """Bursts that moved the mean by `effect` or more, or the variance, significantly: (key, head, special_type)."""
    mean = (F.col("name") == "mxreg1") & (F.col("estimate") >= effect) & (F.col("p") <= level)
    spread = (F.col("name") == "vxreg1") & (F.col("p") <= level)
    return fits.select("key", "head", F.when(mean, "mu").when(spread, "vx").alias("special_type"), "estimate", "p").where("special_type is not null")
