"""Row-keyed fixture generators (A15, A16): one generated row per key row of a
supplied table, so the work grows with the table; hash noise keeps them
reproducible for any partitioning."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.noise import hash_normal, hash_uniform


def two_moons(keys: DataFrame, row_id: str, noise: float = 0.1) -> DataFrame:
    """Two interleaved half circles; label ``y`` by a fair hash coin."""
    k = F.col(row_id)
    y = (hash_uniform("moon", k) >= 0.5).cast("long")
    a = F.lit(math.pi) * hash_uniform("angle", k)
    x0 = F.when(y == 0, F.cos(a)).otherwise(F.lit(1.0) - F.cos(a))
    x1 = F.when(y == 0, F.sin(a)).otherwise(F.lit(0.5) - F.sin(a))
    return keys.select(row_id, (x0 + F.lit(noise) * hash_normal("moon-noise", k, 0)).alias("x0"),
                       (x1 + F.lit(noise) * hash_normal("moon-noise", k, 1)).alias("x1"), y.alias("y"))


def toy_rule_table(keys: DataFrame, row_id: str, n_binary: int, n_gauss: int) -> DataFrame:
    """+-1 block and N(0,1) block; targets: sum > 0, majority of positives
    (>= half of the columns, integer division), XOR of the signs; the -1 codes
    become 0 after the targets are computed."""
    k = F.col(row_id)
    bins = [F.when(hash_uniform("bin", k, j) < 0.5, F.lit(-1.0)).otherwise(F.lit(1.0)) for j in range(n_binary)]
    gs = [hash_normal("gauss", k, j) for j in range(n_gauss)]
    vals = bins + gs
    total = vals[0]
    for v in vals[1:]:
        total = total + v
    pos = sum((F.when(v > 0, 1).otherwise(0) for v in vals), F.lit(0))
    sgn = sum((F.when(v >= 0, 1).otherwise(0) for v in vals), F.lit(0))
    half = len(vals) // 2
    return keys.select(
        row_id,
        *[F.when(b == -1.0, F.lit(0.0)).otherwise(b).alias(f"b{j}") for j, b in enumerate(bins)],
        *[g.alias(f"g{j}") for j, g in enumerate(gs)],
        F.when(total > 0, 1).otherwise(0).cast("long").alias("y_sum"),
        F.when(pos >= half, 1).otherwise(0).cast("long").alias("y_vote"),
        (sgn % 2).cast("long").alias("y_xor"))
