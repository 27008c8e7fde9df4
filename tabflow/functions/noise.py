"""Reproducible hash noise.

``rand()``/``randn()`` depend on partitioning and change on task retry, so all
randomness here is a pure function of integer/string keys:

    u(tag, keys) = (int(first 13 hex digits of md5(tag|k1|k2...)) + 0.5) / 16**13
    z(tag, keys) = sqrt(-2 ln u1) * cos(2 pi u2)   (u1: hex 1-13, u2: hex 14-26)

The same definition is available as DuckDB SQL text (``sql_uniform`` /
``sql_normal``) so value oracles can recompute every draw.  Keys must be
integers or strings (text forms of doubles differ between engines).
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

SCALE = float(16 ** 13)  # 2**52


def _as_col(k) -> Column:
    if isinstance(k, Column):
        return k.cast("string")
    if isinstance(k, str):
        return F.col(k).cast("string")
    return F.lit(str(k))


def _digest(tag: str, keys) -> Column:
    return F.md5(F.concat_ws("|", F.lit(tag), *[_as_col(k) for k in keys]))


def _hex_unit(h: Column, start: int) -> Column:
    return (F.conv(F.substring(h, start, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(SCALE)


def hash_uniform(tag: str, *keys) -> Column:
    """Uniform in (0, 1), strictly inside."""
    return _hex_unit(_digest(tag, keys), 1)


def hash_normal(tag: str, *keys) -> Column:
    """Standard normal by Box-Muller over two 52-bit slices of one md5."""
    return _box_muller(_digest(tag, keys))


def _box_muller(h: Column) -> Column:
    u1 = _hex_unit(h, 1)
    u2 = _hex_unit(h, 14)
    return F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(2.0 * math.pi) * u2)


def hash_normals(n: int, tag: str, keys) -> Column:
    """Array of ``hash_normal(tag, *keys(i))`` for i = 0..n-1.  Spark shares no subexpressions inside a lambda, so the
    digests are made first, one a draw."""
    digests = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: _digest(tag, keys(i)))
    return F.transform(digests, _box_muller)


# ---- DuckDB SQL text with the same definition --------------------------------

def _sql_key(k) -> str:
    if isinstance(k, int):
        return f"'{k}'"
    return f"CAST({k} AS VARCHAR)"


def _sql_digest(tag: str, keys) -> str:
    parts = ", ".join([f"'{tag}'"] + [_sql_key(k) for k in keys])
    return f"md5(concat_ws('|', {parts}))"


def _sql_unit(h: str, start: int) -> str:
    return f"((('0x' || substr({h}, {start}, 13))::BIGINT + 0.5) / 4503599627370496.0)"


def sql_uniform(tag: str, *keys) -> str:
    """``keys`` are SQL expressions (str) or Python ints (literals)."""
    return _sql_unit(_sql_digest(tag, keys), 1)


def sql_normal(tag: str, *keys) -> str:
    h = _sql_digest(tag, keys)
    return (f"(sqrt(-2.0 * ln({_sql_unit(h, 1)})) * "
            f"cos({2.0 * math.pi!r} * {_sql_unit(h, 14)}))")


# ---- NumPy twin (used inside Arrow batches, same bits) ------------------------

def np_hash_normal(seed: int, keys, step: int, col: int):
    """Per-cell N(0,1) inside Arrow batches from a splitmix64 counter hash of
    (seed, key, step, column): independent of batching and partitioning."""
    import numpy as np
    with np.errstate(over="ignore"):
        k = np.asarray(keys, dtype=np.int64).astype(np.uint64)
        base = (k * np.uint64(0x9E3779B97F4A7C15) + np.uint64((step * 1_000_003 + col) & 0xFFFFFFFF)
                + np.uint64((seed * 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF))

        def mix(z):
            z = z + np.uint64(0x9E3779B97F4A7C15)
            z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            return z ^ (z >> np.uint64(31))
        a = mix(base)
        b = mix(a)
        u1 = ((a >> np.uint64(11)).astype(np.float64) + 0.5) / 9007199254740992.0
        u2 = ((b >> np.uint64(11)).astype(np.float64) + 0.5) / 9007199254740992.0
    return np.sqrt(-2.0 * np.log(u1)) * np.cos(2.0 * np.pi * u2)
