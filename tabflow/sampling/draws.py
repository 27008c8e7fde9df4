"""Model-free sampling primitives: frequency draws, prior noise, level lookup,
probability draws, shuffling into generated sets, train/test split.

Frequency draws are a range join of each row's uniform against the cumulative
shares of the categories.  The share table has one row per category value; its
size is checked before it is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.noise import hash_normal, hash_uniform
from ..operators.prefix import hash_bucket, join_null_safe, row_numbers

SHARE_BUCKETS = 4096  # cells of (0,1) on which rows and category intervals meet


def cumulative_shares(df: DataFrame, col: str) -> DataFrame:
    """Categories in ascending order with their interval ``[lo, hi)`` in (0,1)."""
    counts = df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    w = Window.orderBy(col)  # one row per category value
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    tot = F.sum("n").over(Window.partitionBy())
    return counts.select(
        col,
        (F.coalesce(F.sum("n").over(before), F.lit(0)).cast("double") / tot.cast("double")).alias("lo"),
        (F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("double")
         / tot.cast("double")).alias("hi"))


def interval_join(rows: DataFrame, shares: DataFrame, u: str) -> DataFrame:
    """Rows with the share row whose interval ``[lo, hi)`` holds ``u`` in (0,1).

    An interval is listed under every cell of (0,1) it touches, so the join is an
    equi-join on the cell (hash or sort-merge, whatever the number of categories);
    a cell holds one category more than it has interval borders."""
    first = F.floor(F.col("lo") * SHARE_BUCKETS)
    last = F.least(F.floor(F.col("hi") * SHARE_BUCKETS), F.lit(SHARE_BUCKETS - 1))
    cells = shares.withColumn("__cell", F.explode(F.sequence(first.cast("long"), last.cast("long"))))
    r = rows.withColumn("__cell", F.least(F.floor(F.col(u) * SHARE_BUCKETS), F.lit(SHARE_BUCKETS - 1)).cast("long"))
    on = ((r["__cell"] == cells["__cell"]) & (F.col(u) >= F.col("lo")) & (F.col(u) < F.col("hi")))
    return r.join(cells, on, "left").drop(cells["__cell"]).drop("__cell", "lo", "hi")


def draw_from_frequencies(rows: DataFrame, source: DataFrame, col: str, u: Column,
                          out: str | None = None) -> DataFrame:
    """One category per row, drawn with the observed frequencies of
    ``source[col]``; ``u`` is the row's uniform in (0,1)."""
    out = out or col
    shares = cumulative_shares(source, col).withColumnRenamed(col, "__cat")
    return interval_join(rows.withColumn("__u", u), shares, "__u").drop("__u").withColumnRenamed("__cat", out)


def prior_noise(seed: int, row_id: Column | str, feature: int) -> Column:
    """N(0,1) start value per (output row, generated column)."""
    return hash_normal("prior", seed, row_id, feature)


def nearest_level(t: Column, n_t: int) -> Column:
    """model index for time t, ``round(t (n_t - 1))`` half to even."""
    return F.bround(t * F.lit(float(n_t - 1)), 0).cast("long")


def cumulative(p: Column) -> Column:
    """Left-to-right running sums of an ``array<double>``."""
    return F.transform(p, lambda x, i: F.aggregate(F.slice(p, 1, i + 1), F.lit(0.0), lambda a, b: a + b))


def category_draw(p: Column, u: Column) -> Column:
    """index of the category drawn with probabilities ``p`` for uniform ``u``
    (number of cumulative shares <= u; capped at the last class)."""
    idx = F.size(F.filter(cumulative(p), lambda c: c <= u))
    return F.least(idx, F.size(p) - 1).cast("long")


def shuffle_order(df: DataFrame, row_id: str, seed: int, name: str = "pos") -> DataFrame:
    """A random permutation as a 0-based position, by md5 order with
    ties broken by the row id; computed by hash buckets (no global window)."""
    d = df.withColumn("__u", hash_uniform("shuffle", seed, F.col(row_id)))
    d = d.withColumn("__bk", hash_bucket(F.col("__u")))
    d = row_numbers(d, ["__u", row_id], bucket_col="__bk", name="__rn")
    return d.withColumn(name, F.col("__rn") - 1).drop("__u", "__bk", "__rn")


def shuffle_and_batch(df: DataFrame, row_id: str, seed: int, n_per_set: int) -> DataFrame:
    """shuffle generated rows and cut them into sets of ``n_per_set``."""
    d = shuffle_order(df, row_id, seed)
    return d.withColumn("gen_id", F.floor(F.col("pos") / F.lit(n_per_set)).cast("long"))


def train_test_split(df: DataFrame, row_id: str, seed: int, test_size: float = 0.2,
                     stratify: str | None = None) -> DataFrame:
    """G1: ``is_test`` = rank (by md5 of seed,row) <= ceil(test_size * n_y) per class."""
    part = [stratify] if stratify else []
    d = df.withColumn("__u", hash_uniform("split", seed, F.col(row_id)))
    d = d.withColumn("__bk", hash_bucket(F.col("__u")))
    d = row_numbers(d, ["__u", row_id], partition=part, bucket_col="__bk", name="__rn")
    sizes = df.groupBy(*part).agg(F.count(F.lit(1)).alias("__n")) if part else None
    if sizes is not None:
        d = join_null_safe(d, sizes, part)  # a missing class is a stratum of its own
    else:
        d = d.withColumn("__n", F.lit(df.count()))  # one scalar, no global window
    is_test = F.col("__rn") <= F.ceil(F.lit(test_size) * F.col("__n").cast("double"))
    return d.withColumn("is_test", is_test.cast("long")).drop("__u", "__bk", "__rn", "__n")
