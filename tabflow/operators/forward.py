"""Forward (noising) process of flow matching, D1-D5, as row expansions.

Everything is an ``explode`` of small integer sequences plus hash noise, so it
stays inside one narrow stage; callers expand inside the jobs that consume the
rows instead of persisting ``rows x K x n_t`` tables where they can.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.noise import hash_normal

T0 = 1e-3


def level_time(level: Column | str, n_t: int, t0: float = T0) -> Column:
    """``t_i = t0 + i (1 - t0) / (n_t - 1)`` (``np.linspace(t0, 1, n_t)``)."""
    i = F.col(level) if isinstance(level, str) else level
    if n_t == 1:
        return F.lit(1.0)
    return F.lit(t0) + i.cast("double") * F.lit((1.0 - t0) / (n_t - 1))


def noise_levels(df: DataFrame, n_t: int, t0: float = T0) -> DataFrame:
    """One row per (input row, level) with its time."""
    return (df.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(n_t - 1))))
            .withColumn("t", level_time("level", n_t, t0)))


def duplicate_rows(df: DataFrame, k: int) -> DataFrame:
    """Each row K times, ``dup`` = 0..K-1."""
    return df.withColumn("dup", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))


def x0_noise(seed: int, row_id: Column | str, dup: Column | str, feature: int | Column,
             epoch: int | Column | None = None) -> Column:
    """D3: N(0,1) per (seed, row, copy, feature), shared by all levels."""
    keys = [seed, row_id, dup, feature] + ([] if epoch is None else [epoch])
    return hash_normal("x0", *keys)


def gaussian_noise(df: DataFrame, row_id: str, features: Sequence[str], k: int, seed: int) -> DataFrame:
    """D2+D3 in long form: (row_id, dup, feature index, z)."""
    d = duplicate_rows(df.select(row_id), k)
    d = d.withColumn("feature", F.explode(F.sequence(F.lit(0), F.lit(len(features) - 1))))
    return d.withColumn("z", x0_noise(seed, F.col(row_id), F.col("dup"), F.col("feature")))


def interpolate_path(df: DataFrame, row_id: str, features: Sequence[str], k: int, n_t: int,
                     seed: int, sigma: float = 0.0, t0: float = T0) -> DataFrame:
    """``x_t = t x1 + (1-t) x0 (+ sigma eps)``, target ``u = x1 - x0`` in long form.

    Output: row_id, dup, level, t, feature, xt, ut.
    """
    arr = F.array(*[F.col(c).cast("double") for c in features])
    d = duplicate_rows(df.select(row_id, arr.alias("__x")), k)
    d = d.select(row_id, "dup", F.posexplode("__x").alias("feature", "x1"))
    d = d.withColumn("z", x0_noise(seed, F.col(row_id), F.col("dup"), F.col("feature")))
    d = noise_levels(d, n_t, t0)
    xt = F.col("t") * F.col("x1") + (F.lit(1.0) - F.col("t")) * F.col("z")
    if sigma:
        xt = xt + F.lit(sigma) * hash_normal("eps", seed, F.col(row_id), F.col("dup"), F.col("feature"))
    return d.select(row_id, "dup", "level", "t", "feature", xt.alias("xt"),
                    (F.col("x1") - F.col("z")).alias("ut"))


def interpolate_at_t(df: DataFrame, row_id: str, features: Sequence[str], level: int, n_t: int,
                     seed: int, epoch: int, t0: float = T0) -> DataFrame:
    """One level with fresh noise per epoch (noise key includes the epoch)."""
    arr = F.array(*[F.col(c).cast("double") for c in features])
    d = df.select(row_id, F.posexplode(arr).alias("feature", "x1"))
    z = x0_noise(seed, F.col(row_id), F.lit(0), F.col("feature"), epoch=epoch)
    t = level_time(F.lit(level), n_t, t0)
    return d.select(row_id, "feature", (t * F.col("x1") + (F.lit(1.0) - t) * z).alias("xt"),
                    (F.col("x1") - z).alias("ut"))


def minibatch_expand(df: DataFrame, row_id: str, features: Sequence[str], n_batch: int, epochs: int,
                     n_t: int, seed: int, t0: float = T0) -> DataFrame:
    """The expansion a mini-batch trainer sees -- slice ``floor(u * n_batch)``
    by row hash, fresh noise per epoch -- as rows, never stored by the trainer.

    Output: row_id, slice, epoch, level, feature, xt, ut."""
    from ..functions.noise import hash_uniform
    arr = F.array(*[F.col(c).cast("double") for c in features])
    d = df.select(row_id, F.floor(hash_uniform("slice", seed, F.col(row_id)) * F.lit(n_batch))
                  .cast("long").alias("slice"), arr.alias("__x"))
    d = d.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    d = d.select(row_id, "slice", "epoch", F.posexplode("__x").alias("feature", "x1"))
    z = hash_normal("x0-mb", seed, F.col(row_id), F.col("epoch"), F.col("feature"))
    d = noise_levels(d.withColumn("z", z), n_t, t0)
    return d.select(row_id, "slice", "epoch", "level", "feature",
                    (F.col("t") * F.col("x1") + (F.lit(1.0) - F.col("t")) * F.col("z")).alias("xt"),
                    (F.col("x1") - F.col("z")).alias("ut"))
