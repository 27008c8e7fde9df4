"""One-hot coding of columns with any number of values (C4-C8), as (dimension, value) lists.

A dummy column per value stops working at some hundred thousand values.  Here a row keeps
only its entries that are not zero: ``dims`` (ascending dimension numbers) and ``vals``.
Dimension = first dimension of the column + rank of the value.  The dictionaries are
tables that are joined, never collected; the driver knows their sizes only.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from . import encode


@dataclass
class Dummies:
    """Dictionaries (value, code) of the coded columns and the dimensions that each one takes."""
    drop_first: bool
    tables: dict[str, DataFrame] = field(default_factory=dict)
    first: dict[str, int] = field(default_factory=dict)
    width: int = 0


def dummies(df: DataFrame, cols: Sequence[str], drop_first: bool = False) -> Dummies:
    """Sorted dictionaries of ``cols`` (missing values have no code)."""
    out = Dummies(drop_first)
    for c in cols:
        out.tables[c] = materialize(encode.sorted_dictionary(df, c, "code"))
        out.first[c] = out.width
        out.width += max(out.tables[c].count() - int(drop_first), 0)
    return out


def onehot_sparse(df: DataFrame, d: Dummies, value: float = 1.0) -> DataFrame:
    """Coded columns make way for ``dims`` and ``vals``.  Missing values, and the first value under ``drop_first``,
    have no entry."""
    out, entries = df, []
    for i, (c, t) in enumerate(d.tables.items()):
        out = out.join(t.select(F.col(c).alias(f"__v{i}"), (F.col("code") - int(d.drop_first)).alias(f"__c{i}")),
                       F.col(c) == F.col(f"__v{i}"), "left")
        entries.append(F.when(F.col(f"__c{i}") >= 0, F.col(f"__c{i}") + F.lit(d.first[c]).cast("long")))
    dims = F.array_compact(F.array(*entries)) if entries else F.array().cast("array<bigint>")
    out = out.select(*[c for c in df.columns if c not in d.tables], dims.alias("dims"))
    return out.withColumn("vals", F.array_repeat(F.lit(float(value)), F.size("dims")))


def onehot_sparse_decode(df: DataFrame, d: Dummies, order: Sequence[str]) -> DataFrame:
    """C7 on drop-first entries: 0.5 stands for the first value, the first largest entry wins; columns in ``order``."""
    cols = list(d.tables)
    ends = [*[d.first[c] for c in cols[1:]], d.width]
    out = df
    for i, (c, hi) in enumerate(zip(cols, ends)):
        lo = d.first[c]
        mine = F.filter(F.arrays_zip("dims", "vals"), lambda e: (e["dims"] >= lo) & (e["dims"] < hi) & (e["vals"] > 0.5))
        best = F.array_min(F.transform(mine, lambda e: F.struct((-e["vals"]).alias("v"), e["dims"].alias("dim"))))
        out = out.withColumn(f"__c{i}", F.coalesce(best["dim"] - lo + 1, F.lit(0).cast("long")))
    for i, (c, t) in enumerate(d.tables.items()):
        out = out.join(t.select(F.col(c).alias(f"__v{i}"), F.col("code").alias(f"__k{i}")),
                       F.col(f"__c{i}") == F.col(f"__k{i}"), "left")
    return out.select(*[F.col(f"__v{cols.index(c)}").alias(c) if c in d.tables else F.col(c) for c in order])


def l1_sparse(a_dims: str, a_vals: str, b_dims: str, b_vals: str) -> Column:
    """L1 distance of two rows' entries."""
    other = F.map_from_arrays(b_dims, b_vals)
    add = lambda acc, x: acc + F.abs(x)
    own = F.transform(F.arrays_zip(a_dims, a_vals), lambda e: e[a_vals] - F.coalesce(
        F.try_element_at(other, e[a_dims]), F.lit(0.0)))
    rest = F.transform(F.filter(F.arrays_zip(b_dims, b_vals), lambda e: ~F.array_contains(a_dims, e[b_dims])),
                       lambda e: e[b_vals])
    return F.aggregate(F.concat(own, rest), F.lit(0.0), add)


def metric_space_sparse(train: DataFrame, other: DataFrame, continuous: Sequence[str], categorical: Sequence[str],
                        divide_by: float = 2.0):
    """[0, 1] scaling fitted on ``train``, entries over the union's values divided by ``divide_by``."""
    bounds = encode.data_bounds(train, continuous) if continuous else {}
    d = dummies(train.select(*categorical).unionByName(other.select(*categorical)), categorical)
    value = 1.0 / divide_by if divide_by > 0 else 1.0
    return (*[onehot_sparse(encode.minmax_scale(x, bounds, 0.0, 1.0), d, value) for x in (train, other)], bounds, d)


def dummy_distances(p: DataFrame, q: DataFrame) -> DataFrame:
    """(dim, w1): 1-D Wasserstein distance of every dummy column.  Both sides hold 0 and one value, so it is the
    distance of the means; dimensions without an entry on either side are left out (0)."""
    side = lambda d, s: d.select(F.explode(F.arrays_zip("dims", "vals")).alias("e")).select(
        F.col("e.dims").alias("dim"), (s * F.col("e.vals")).alias("v"), F.lit(s).alias("side"))
    sums = side(p, 1).unionByName(side(q, -1)).groupBy("dim").agg(
        F.sum(F.when(F.col("side") == 1, F.col("v")).otherwise(0.0)).alias("sp"),
        F.sum(F.when(F.col("side") == -1, -F.col("v")).otherwise(0.0)).alias("sq"))
    mean = lambda s, n: F.col(s) / F.lit(max(n, 1))
    return sums.select("dim", F.abs(mean("sp", p.count()) - mean("sq", q.count())).alias("w1"))
