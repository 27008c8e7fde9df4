"""Distributed running sums and row numbers without a whole-group window.

``Window.partitionBy(g).orderBy(k)`` puts every row of group ``g`` into one
task.  Here the order is cut into buckets that are monotone in the order key,
a window runs only inside (group, bucket), and the totals of earlier buckets
(a table with at most ``groups x buckets`` rows) are added back as offsets.

Two ways to get monotone buckets:

* ``bucket_col`` given by the caller -- e.g. the leading bits of a uniform hash
  key, which is skew-free by construction and deterministic;
* otherwise the rows are range-partitioned on (group, order) and the partition
  id becomes the bucket.  That table is checkpointed first so the bucket of a
  row is fixed before the totals are taken (range bounds come from sampling).
  Callers pre-aggregate hot keys (one row per distinct value) so range
  partitions are balanced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize


def _cols(xs) -> list[Column]:
    return [F.col(x) if isinstance(x, str) else x for x in xs]


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join that matches NULL keys with NULL keys; one copy of the keys stays."""
    r = right.select(*[F.col(k).alias(f"__r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    cond = [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys]
    return left.join(r, cond, how).drop(*[f"__r_{k}" for k in keys])


def running_sums(df: DataFrame, order: Sequence, sums: dict[str, Column],
                 partition: Sequence[str] = (), bucket_col: str | None = None,
                 num_buckets: int | None = None, inclusive: bool = True,
                 next_of: dict[str, str] | None = None) -> DataFrame:
    """Add running sums (in ``order`` within ``partition``) as new columns.

    ``sums`` maps output name -> column expression to accumulate.  With
    ``inclusive`` the current row counts.  ``next_of`` maps output name -> a
    column whose value on the following row (in order) is wanted (``lead``),
    also across bucket borders.
    """
    partition = list(partition)
    order_cols = _cols(order)
    tmp = [f"__v{i}" for i in range(len(sums))]
    base = df.select("*", *[e.alias(t) for e, t in zip(sums.values(), tmp)])
    if bucket_col is None:
        n = num_buckets or max(1, base.rdd.getNumPartitions())
        base = base.repartitionByRange(n, *[F.col(p) for p in partition], *order_cols)
        base = materialize(base.withColumn("__b", F.spark_partition_id()))
        bcol = "__b"
    else:
        bcol = bucket_col
    keys = partition + [bcol]
    agg = [F.sum(t).alias(t) for t in tmp]
    nxt = dict(next_of or {})
    firsts = []
    if nxt:
        # first row of each bucket, for ``lead`` across the border
        first_struct = F.min(F.struct(*order_cols, *[F.col(c).alias(f"__f_{o}") for o, c in nxt.items()]))
        firsts = [first_struct.alias("__first")]
    totals = base.groupBy(*keys).agg(*agg, *firsts)
    wb = Window.partitionBy(*partition).orderBy(bcol)
    before = Window.partitionBy(*partition).orderBy(bcol).rowsBetween(Window.unboundedPreceding, -1)
    offs = totals.select(
        *keys,
        *[F.coalesce(F.sum(t).over(before), F.lit(0)).alias(f"__o{i}") for i, t in enumerate(tmp)],
        *([F.lead(F.col("__first")).over(wb).alias("__nextfirst")] if nxt else []),
    )
    # offsets: one row per (group, bucket); no forced broadcast -- with many
    # groups it is not small, and adaptive execution broadcasts it when it is
    # null-safe: rows of a NULL group or with a NULL order bucket keep their sums
    joined = join_null_safe(base, offs, keys)
    frame = (Window.partitionBy(*keys).orderBy(*order_cols)
             .rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1))
    w_in = Window.partitionBy(*keys).orderBy(*order_cols)
    out_cols = []
    for i, (name, t) in enumerate(zip(sums.keys(), tmp)):
        local = F.coalesce(F.sum(t).over(frame), F.lit(0))
        out_cols.append((local + F.col(f"__o{i}")).alias(name))
    for o, c in nxt.items():
        out_cols.append(F.coalesce(F.lead(F.col(c)).over(w_in),
                                   F.col(f"__nextfirst.__f_{o}")).alias(o))
    res = joined.select(*[F.col(c) for c in df.columns], *out_cols)
    return res


def row_numbers(df: DataFrame, order: Sequence, partition: Sequence[str] = (),
                bucket_col: str | None = None, name: str = "rn") -> DataFrame:
    """1-based ``row_number`` over (partition, order) computed by buckets."""
    return running_sums(df, order, {name: F.lit(1).cast("long")}, partition=partition,
                        bucket_col=bucket_col)


def hash_bucket(u: Column, bits: int = 20) -> Column:
    """Monotone bucket of a uniform hash value in (0,1): its leading bits."""
    return F.floor(u * F.lit(float(1 << bits))).cast("long")
