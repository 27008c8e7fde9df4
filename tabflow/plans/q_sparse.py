"""Queries of one-hot coding without dummy columns (C4-C8): customers of orders as a category, a tenth of them missing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.noise import hash_uniform, sql_uniform
from ..operators import sparse
from ..sources.registry import table
from .q_basic import _scaled_sql
from .registry import query, r6

_ORDERS = f"""
o AS (SELECT o_orderkey, o_totalprice, o_orderpriority AS p,
             CASE WHEN {sql_uniform('blank', 'o_orderkey')} < 0.1 THEN NULL ELSE o_custkey END AS k,
             CASE WHEN {sql_uniform('split', 'o_orderkey')} < 0.5 THEN 'train' ELSE 'test' END AS side FROM orders),
dk AS (SELECT k, row_number() OVER (ORDER BY k) - 1 AS code FROM (SELECT DISTINCT k FROM o WHERE k IS NOT NULL)),
dp AS (SELECT p, row_number() OVER (ORDER BY p) - 1 AS code FROM (SELECT DISTINCT p FROM o)),
entry AS (SELECT o.*, dk.code AS dim FROM o JOIN dk USING (k) UNION ALL
          SELECT o.*, dp.code + (SELECT count(*) FROM dk) AS dim FROM o JOIN dp USING (p))"""


def _orders(spark, sf):
    key = F.col("o_orderkey")
    side = F.when(hash_uniform("split", key) < 0.5, "train").otherwise("test")
    return table(spark, sf, "orders").select(
        "o_orderkey", F.col("o_totalprice").cast("double").alias("o_totalprice"),
        F.when(hash_uniform("blank", key) >= 0.1, F.col("o_custkey")).alias("k"), F.col("o_orderpriority").alias("p"),
        side.alias("side"))


def _space(spark, sf):
    o = _orders(spark, sf)
    return sparse.metric_space_sparse(o.where("side = 'train'"), o.where("side = 'test'"), ["o_totalprice"], ["k", "p"])[:2]


@query("metric_space_sparse", sql=f"""
WITH {_ORDERS},
b AS (SELECT min(o_totalprice) AS mn, max(o_totalprice) AS mx FROM o WHERE side = 'train')
SELECT o_orderkey, side, round({_scaled_sql('o_totalprice', 'mn', 'mx', 0.0, 1.0)}, 6) AS o_totalprice,
       CAST(dim AS BIGINT) AS dim, CAST(0.5 AS DOUBLE) AS val FROM entry, b""")
def q_metric_space_sparse(spark, sf):
    train, test = _space(spark, sf)
    return train.unionByName(test).select("o_orderkey", "side", r6("o_totalprice").alias("o_totalprice"), F.explode(
        F.arrays_zip("dims", "vals")).alias("e")).select("o_orderkey", "side", "o_totalprice", F.col("e.dims").alias("dim"),
                                                         F.col("e.vals").alias("val"))


@query("onehot_decode_sparse", sql=f"""
WITH {_ORDERS}
SELECT o_orderkey, CASE WHEN k IS NULL OR {sql_uniform('dec', 'o_orderkey')} <= 0.5 THEN (SELECT min(k) FROM o) ELSE k END AS k,
       CASE WHEN {sql_uniform('dec', 'o_orderkey')} <= 0.5 THEN (SELECT min(p) FROM o) ELSE p END AS p FROM o""")
def q_onehot_decode_sparse(spark, sf):
    o = _orders(spark, sf).select("o_orderkey", "k", "p")
    d = sparse.dummies(o, ["k", "p"], drop_first=True)
    made = sparse.onehot_sparse(o, d).withColumn("vals", F.transform("vals", lambda v: v * hash_uniform(
        "dec", F.col("o_orderkey"))))
    return sparse.onehot_sparse_decode(made, d, ["o_orderkey", "k", "p"])


@query("dummy_wasserstein_sparse", sql=f"""
WITH {_ORDERS},
n AS (SELECT sum(CASE WHEN side = 'train' THEN 1 ELSE 0 END) AS np, sum(CASE WHEN side = 'test' THEN 1 ELSE 0 END) AS nq FROM o)
SELECT CAST(dim AS BIGINT) AS dim, round(abs(sum(CASE WHEN side = 'train' THEN 0.5 ELSE 0 END) / any_value(np)
       - sum(CASE WHEN side = 'test' THEN 0.5 ELSE 0 END) / any_value(nq)), 6) AS w1
FROM entry, n GROUP BY dim""")
def q_dummy_wasserstein_sparse(spark, sf):
    return sparse.dummy_distances(*_space(spark, sf)).withColumn("w1", r6("w1"))
