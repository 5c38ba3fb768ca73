"""Ordered folds: adaptive estimators that see one observation after another.

An ordered fold collects a key's observations as (order, value) structs, sorts
them and folds with the ``aggregate`` higher-order function: no Python, and one
shuffle. It holds a key's history in one row, so keys are series of bounded
length; ``kalman5`` and the streaming variants carry state instead.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the filters.
SCALAR = {"variance": 0.10, "q": 0.0001, "r": 0.02, "q_floor": 1e-6, "q_ceil": 0.05, "r_floor": 0.002, "r_ceil": 0.15}
WINDOW = 20.0
LEAST = 3
R5 = (0.002, 0.002, 0.003, 0.005, 0.02)
COV5 = (0.05, 0.10, 0.10, 0.10, 0.05)
Q5 = (0.0001, 0.0001, 0.00005, 0.00005, 0.001)
Q5_FLOOR, Q5_CEIL = (1e-6, 1e-6, 1e-6, 1e-6, 1e-5), (0.05, 0.05, 0.04, 0.04, 0.08)
R5_CEIL = (0.10, 0.10, 0.08, 0.08, 0.15)


def series(rows: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """Each key's observations in order, as an array of structs ``xs``."""
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*order, *values))).alias("xs"))


def let(value: Column, fn: Callable[[Column], Column]) -> Column:
    """``fn`` of a value that is computed once."""
    return F.transform(F.array(value), fn)[0]


def ema(xs: Column, value: str, alpha: float, start: float) -> Column:
    """Exponential average, held within 0 and 1."""
    a = min(max(alpha, 0.0001), 1.0)
    return F.aggregate(xs, F.lit(start), lambda m, x: F.least(F.greatest(m + a * (x[value] - m), F.lit(0.0)), F.lit(1.0)))


def integer_ewma(xs: Column, value: str) -> Column:
    """(7 * old + new) div 8 over integers; 0 is unset."""
    return F.aggregate(xs, F.lit(0).cast("bigint"), lambda m, x: F.when(m == 0, x[value]).otherwise(F.floor((m * 7 + x[value]) / 8)))


def scalar_kalman(xs: Column, value: str) -> Column:
    """estimate, variance, q, r and n after all observations, with noise learnt on the way."""
    k = SCALAR

    def state(e, v, q, r, n):
        return F.struct(e.cast("double").alias("e"), v.cast("double").alias("v"), q.cast("double").alias("q"), r.cast("double").alias("r"), n.cast("int").alias("n"))

    def clamp(x, lo, hi):
        return F.least(F.greatest(x, lo if isinstance(lo, Column) else F.lit(lo)), hi if isinstance(hi, Column) else F.lit(hi))

    def step(s: Column, x: Column) -> Column:
        z = clamp(x[value], 0.0, 1.0)
        p = s["v"] + s["q"]

        def gained(g: Column) -> Column:
            innovation = z - s["e"]
            v = F.greatest((1 - g) * p, F.lit(1e-12))
            alpha = 1 / F.least((s["n"] - 1).cast("double"), F.lit(WINDOW))
            mature = F.least(s["n"] / WINDOW, F.lit(1.0))
            r = clamp((1 - alpha) * s["r"] + alpha * (innovation * innovation - p), k["r_floor"], k["r_ceil"] * (1 - mature * 0.5) + k["r_ceil"] * 0.5)
            q = clamp((1 - alpha) * s["q"] + alpha * (g * innovation * g * innovation + v - s["v"]), k["q_floor"], k["q_ceil"] * (1 - mature * 0.5) + k["q_ceil"] * 0.5)
            learn = s["n"] >= LEAST
            return state(clamp(s["e"] + g * innovation, 0.0, 1.0), v, F.when(learn, q).otherwise(s["q"]), F.when(learn, r).otherwise(s["r"]), s["n"] + 1)

        first = state(z, F.lit(k["r"]), s["q"], s["r"], F.lit(1))
        return F.when(s["n"] == 0, first).otherwise(let(p / (p + s["r"]), gained))

    return F.aggregate(xs, state(F.lit(0.0), F.lit(k["variance"]), F.lit(k["q"]), F.lit(k["r"]), F.lit(0)), step)


def rollout(xs: Column) -> Column:
    """State after all benchmark observations (passed, precision, recall, match_ratio, enough).

    Levels: 0 adaptive, 1 balanced, 2 strict. The profile rises after 3 or 5
    passes in a row that also meet the next one's thresholds and falls after 3
    or 2 failures in a row; it is armed while enough passes follow each other.
    """
    from .accuracy import meets

    def state(level, passes, fails, up, down, armed):
        cast = [c.cast("int").alias(n) for c, n in ((level, "level"), (passes, "passes"), (fails, "fails"), (up, "up"), (down, "down"))]
        return F.struct(*cast, armed.alias("armed"))

    def step(s: Column, x: Column) -> Column:
        passes = F.when(x["passed"], s["passes"] + 1).otherwise(0)
        fails = F.when(x["passed"], 0).otherwise(s["fails"] + 1)
        args = (x["precision"], x["recall"], x["match_ratio"])
        rise = x["passed"] & (((s["level"] == 0) & (passes >= 3) & meets("balanced", *args)) | ((s["level"] == 1) & (passes >= 5) & meets("strict", *args)))
        fall = ~x["passed"] & (((s["level"] == 2) & (fails >= 2)) | ((s["level"] == 1) & (fails >= 3)))
        moved = rise | fall
        level = s["level"] + rise.cast("int") - fall.cast("int")
        base = F.greatest(x["required"], F.lit(1))
        target = F.when(level == 2, F.least(base, F.lit(2))).when(level == 1, F.greatest(base, F.lit(2))).otherwise(F.greatest(base + 1, F.lit(3)))
        streak = F.when(moved, 0).otherwise(passes)
        seen = state(level, streak, F.when(moved, 0).otherwise(fails), s["up"] + rise.cast("int"), s["down"] + fall.cast("int"), streak >= target)
        few = state(s["level"], s["passes"], s["fails"], s["up"], s["down"], F.lit(False))
        return F.when(x["enough"], seen).otherwise(few)

    return F.aggregate(xs, state(F.lit(1), F.lit(0), F.lit(0), F.lit(0), F.lit(0), F.lit(False)), step)


class Kalman5:
    """The five-dimensional filter with learnt noise; one ``observe`` an observation."""

    def __init__(self):
        self.n, self.x = 0, np.array([0.85, 0.5, 0.5, 0.5, 0.85])
        self.p, self.q, self.r = np.diag(COV5), np.diag(Q5), np.diag(R5)

    def observe(self, z: np.ndarray) -> None:
        z = np.clip(np.asarray(z, float), 0, 1)
        if not self.n:
            self.x, self.p, self.n = z, np.diag(R5), 1
            return
        pred = self.p + self.q
        y = z - self.x
        gain = pred @ np.linalg.inv(pred + self.r)
        rest = np.eye(5) - gain
        cov = rest @ pred @ rest.T + gain @ self.r @ gain.T
        if self.n >= LEAST:
            alpha, mature = 1 / min(self.n - 1, WINDOW), min(self.n / WINDOW, 1.0)
            ky = gain @ y
            self.r = self._held((1 - alpha) * self.r + alpha * (np.outer(y, y) - pred), R5, R5_CEIL, mature)
            self.q = self._held((1 - alpha) * self.q + alpha * (np.outer(ky, ky) + cov - self.p), Q5_FLOOR, Q5_CEIL, mature)
        self.x, self.p, self.n = np.clip(self.x + gain @ y, 0, 1), (cov + cov.T) / 2, self.n + 1

    @staticmethod
    def _held(m: np.ndarray, floor, ceil, mature: float) -> np.ndarray:
        """Diagonal within its bounds, symmetric, and made positive definite by shrinking what is off it."""
        m = (m + m.T) / 2
        d = np.clip(np.diag(m), np.array(floor) * (1 - 0.5 * mature), np.array(ceil) * (1 + 2 * (1 - mature)))
        off = m - np.diag(np.diag(m))
        while np.linalg.eigvalsh(np.diag(d) + off)[0] <= 0:
            off = off / 2
        return np.diag(d) + off


def kalman5(rows: DataFrame, key: str, order: list[str], dims: list[str]) -> DataFrame:
    """Final estimates (e0 to e4) and count of each key, by a fold in the workers."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        f = Kalman5()
        for z in pdf.sort_values(order)[dims].to_numpy():
            f.observe(z)
        return pd.DataFrame([[pdf[key].iloc[0], f.n, *f.x]], columns=[key, "n", *(f"e{i}" for i in range(5))])

    kind = dict(rows.dtypes)[key]
    return rows.groupBy(key).applyInPandas(fold, f"{key} {kind}, n int, " + ", ".join(f"e{i} double" for i in range(5)))
