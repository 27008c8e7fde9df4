"""ODE solvers of the sampler.

Two forms of the same schemes:

* ``*_frame``: the step as a column expression, one projection per step (used
  with analytic velocity fields; checked by value against SQL);
* ``*_np``: the step on NumPy arrays inside an Arrow batch, with a velocity
  callback that scores the fitted trees for a whole batch at once.

Scheme details of the reference: sequential Euler makes ``n_t`` steps of
``h = 1/(n_t-1)`` by default (``steps='n_t'``), RK4 and joint Euler make
``n_t-1``; RK4 half steps look up level ``round(i + 0.5)`` half to even.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def euler_frame(df: DataFrame, x: str, v: Callable[[float, Column], Column], n_steps: int,
                h: float, t0: float = 0.0) -> DataFrame:
    t = t0
    for _ in range(n_steps):
        df = df.withColumn(x, F.col(x) + F.lit(h) * v(t, F.col(x)))
        t += h
    return df


def rk4_frame(df: DataFrame, x: str, v: Callable[[float, Column], Column], n_steps: int,
              h: float, t0: float = 0.0) -> DataFrame:
    t = t0
    for _ in range(n_steps):
        xc = F.col(x)
        df = df.withColumn("__k1", F.lit(h) * v(t, xc))
        df = df.withColumn("__k2", F.lit(h) * v(t + h / 2, xc + F.col("__k1") / 2))
        df = df.withColumn("__k3", F.lit(h) * v(t + h / 2, xc + F.col("__k2") / 2))
        df = df.withColumn("__k4", F.lit(h) * v(t + h, xc + F.col("__k3")))
        df = df.withColumn(x, xc + (F.col("__k1") + F.lit(2) * F.col("__k2") + F.lit(2) * F.col("__k3")
                                    + F.col("__k4")) / F.lit(6))
        t += h
    return df.drop("__k1", "__k2", "__k3", "__k4")


def level_of(step: int, half: bool, n_t: int) -> int:
    """Model level used at time ``t = step*h`` (+ h/2): integer schedule, half to even."""
    if not half:
        return min(step, n_t - 1)
    return min(int(np.round(step + 0.5)), n_t - 1)


def euler_np(x: np.ndarray, velocity: Callable[[int, np.ndarray], np.ndarray], n_t: int,
             steps: str = "n_t") -> np.ndarray:
    """explicit Euler; ``velocity(level, x)`` -> dx/dt for the batch."""
    h = 1.0 / (n_t - 1)
    n = n_t if steps == "n_t" else n_t - 1
    for i in range(n):
        x = x + h * velocity(level_of(i, False, n_t), x)
    return x


def rk4_np(x: np.ndarray, velocity: Callable[[int, np.ndarray], np.ndarray], n_t: int) -> np.ndarray:
    """classic Runge-Kutta with ``n_t - 1`` steps."""
    h = 1.0 / (n_t - 1)
    for i in range(n_t - 1):
        lo, mid, hi = level_of(i, False, n_t), level_of(i, True, n_t), level_of(i + 1, False, n_t)
        k1 = h * velocity(lo, x)
        k2 = h * velocity(mid, x + k1 / 2)
        k3 = h * velocity(mid, x + k2 / 2)
        k4 = h * velocity(hi, x + k3)
        x = x + (k1 + 2 * k2 + 2 * k3 + k4) / 6
    return x
