"""One-hot entries against dummy columns, and a column of 200,000 values."""

import random

import pytest
from pyspark.sql import functions as F

from tabflow.operators import encode, sparse


@pytest.fixture
def rows(spark):
    rng = random.Random(5)
    return spark.createDataFrame([(i, rng.choice(["a", "b", "c", None]), rng.choice([1, 5, 9, 12, None]), rng.random())
                                  for i in range(120)], "id long, s string, n int, x double")


@pytest.mark.parametrize("drop", [False, True])
def test_entries_are_the_dummies_that_are_not_zero(rows, drop):
    d = sparse.dummies(rows, ["s", "n"], drop)
    got = {r.id: dict(zip(r.dims, r.vals)) for r in sparse.onehot_sparse(rows, d, 0.5).collect()}
    dense = encode.onehot(rows, {c: encode.category_values(rows, c) for c in ("s", "n")}, drop, 0.5)
    want = {r["id"]: {j: v for j, v in enumerate(r[2:]) if v} for r in dense.collect()}
    assert got == want and d.width == len(dense.columns) - 2


def test_distance_of_entries_is_that_of_dummies(rows):
    d = sparse.dummies(rows, ["s", "n"])
    e = sparse.onehot_sparse(rows, d, 0.5).withColumn("vals", F.transform("vals", lambda v: v * F.col("x")))
    pairs = e.select(F.col("id").alias("i"), F.col("dims").alias("ad"), F.col("vals").alias("av")).join(
        e.select(F.col("id").alias("j"), F.col("dims").alias("bd"), F.col("vals").alias("bv")),
        F.col("j") == (F.col("i") * 7 + 3) % 120)
    rowsof = {r.id: dict(zip(r.dims, r.vals)) for r in e.collect()}
    found = pairs.select("i", "j", sparse.l1_sparse("ad", "av", "bd", "bv").alias("l1")).collect()
    assert len(found) == 120
    for r in found:
        a, b = rowsof[r.i], rowsof[r.j]
        assert r.l1 == pytest.approx(sum(abs(a.get(k, 0) - b.get(k, 0)) for k in {*a, *b}))


def test_decode_takes_the_first_largest_entry(spark):
    base = spark.createDataFrame([(v,) for v in "abcd"], "s string")
    d = sparse.dummies(base, ["s"], drop_first=True)
    made = spark.createDataFrame([(0, [], []), (1, [0, 1, 2], [0.6, 0.9, 0.9]), (2, [1], [0.5]), (3, [2], [0.51])],
                                 "id long, dims array<long>, vals array<double>")
    got = {r.id: r.s for r in sparse.onehot_sparse_decode(made, d, ["id", "s"]).collect()}
    assert got == {0: "a", 1: "c", 2: "a", 3: "d"}


def test_two_hundred_thousand_values_with_a_hot_one(spark):
    n = 200_000
    hot = F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id"))
    df = spark.range(3 * n // 2).select("id", F.concat(F.lit("v"), hot).alias("s"), (F.col("id") * 0.5).alias("x"))
    n_values = df.select("s").distinct().count()
    assert n_values >= n
    a, b, _, d = sparse.metric_space_sparse(df.where("id % 2 = 0"), df.where("id % 2 = 1"), ["x"], ["s"])
    assert d.width == n_values and a.where("size(dims) = 1 and vals[0] = 0.5").count() == a.count()
    near = {r.dim: r.w1 for r in sparse.dummy_distances(a, b).where("w1 > 0.001").collect()}
    assert not near                                                # the hot value has the same share on both sides
    coded = sparse.dummies(df, ["s"], drop_first=True)
    back = sparse.onehot_sparse_decode(sparse.onehot_sparse(df, coded), coded, ["id", "s"])
    assert back.join(df, ["id", "s"], "left_semi").count() == 3 * n // 2


def test_empty_tables(spark, rows):
    none = rows.limit(0)
    d = sparse.dummies(none, ["s", "n"])
    assert d.width == 0 and sparse.onehot_sparse(rows, d).where("size(dims) > 0").count() == 0
    assert sparse.dummy_distances(sparse.onehot_sparse(none, d), sparse.onehot_sparse(rows, d)).count() == 0
