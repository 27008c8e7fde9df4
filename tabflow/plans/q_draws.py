"""Queries for model-free sampling primitives and fixtures (A15, A16, E3, F1-F3,
F5, F12, F13, G1, G26, analytic solver steps)."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions.noise import hash_uniform, sql_normal, sql_uniform
from ..operators import encode
from ..sampling import draws, solvers
from ..sources.registry import load_dataset, table
from .registry import query, r6

PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def _shares_sql(col, tbl):
    return f"""SELECT {col} AS cat, CAST(coalesce(sum(n) OVER (ORDER BY {col} ROWS BETWEEN UNBOUNDED PRECEDING
          AND 1 PRECEDING), 0) AS DOUBLE) / CAST(sum(n) OVER () AS DOUBLE) AS lo,
       CAST(sum(n) OVER (ORDER BY {col} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE)
          / CAST(sum(n) OVER () AS DOUBLE) AS hi
FROM (SELECT {col}, count(*) AS n FROM {tbl} WHERE {col} IS NOT NULL GROUP BY {col})"""


@query("first_category_marginal", sql=f"""
WITH sh AS ({_shares_sql('o_orderpriority', 'orders')}),
r AS (SELECT o_orderkey AS row_id, {sql_uniform('first', 11, 'o_orderkey')} AS u FROM orders)
SELECT r.row_id, sh.cat AS o_orderpriority FROM r LEFT JOIN sh ON r.u >= sh.lo AND r.u < sh.hi""")
def q_first_category_marginal(spark, sf):
    o = table(spark, sf, "orders")
    rows = o.select(F.col("o_orderkey").alias("row_id"))
    return draws.draw_from_frequencies(rows, o, "o_orderpriority",
                                       hash_uniform("first", 11, F.col("row_id")))


@query("sample_labels", sql=f"""
WITH sh AS ({_shares_sql('o_orderstatus', 'orders')}),
r AS (SELECT o_orderkey AS row_id, {sql_uniform('label', 11, 'o_orderkey')} AS u FROM orders)
SELECT r.row_id, sh.cat AS o_orderstatus FROM r LEFT JOIN sh ON r.u >= sh.lo AND r.u < sh.hi""")
def q_sample_labels(spark, sf):
    o = table(spark, sf, "orders")
    rows = o.select(F.col("o_orderkey").alias("row_id"))
    return draws.draw_from_frequencies(rows, o, "o_orderstatus", hash_uniform("label", 11, F.col("row_id")))


@query("prior_noise", sql=f"""
SELECT o_orderkey AS row_id, round({sql_normal('prior', 11, 'o_orderkey', 0)}, 6) AS z0,
       round({sql_normal('prior', 11, 'o_orderkey', 1)}, 6) AS z1 FROM orders""")
def q_prior_noise(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("row_id"))
    return o.select("row_id", r6(draws.prior_noise(11, F.col("row_id"), 0)).alias("z0"),
                    r6(draws.prior_noise(11, F.col("row_id"), 1)).alias("z1"))


@query("nearest_level", sql=f"""
SELECT o_orderkey AS row_id, CAST(round_even({sql_uniform('t', 'o_orderkey')} * 49.0, 0) AS BIGINT) AS level
FROM orders""")
def q_nearest_level(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("row_id"))
    return o.select("row_id", draws.nearest_level(hash_uniform("t", F.col("row_id")), 50).alias("level"))


@query("category_draw", sql=f"""
WITH p AS (SELECT o_orderkey AS row_id, {sql_uniform('p', 'o_orderkey', 0)} AS a,
                  {sql_uniform('p', 'o_orderkey', 1)} AS b, {sql_uniform('p', 'o_orderkey', 2)} AS c,
                  {sql_uniform('c', 'o_orderkey')} AS u FROM orders)
SELECT row_id, CAST(CASE WHEN u < a / (a + b + c) THEN 0
                         WHEN u < a / (a + b + c) + b / (a + b + c) THEN 1 ELSE 2 END AS BIGINT) AS category
FROM p""")
def q_category_draw(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("row_id"))
    a, b, c = (hash_uniform("p", F.col("row_id"), j) for j in range(3))
    s = a + b + c
    p = F.array(a / s, b / s, c / s)
    return o.select("row_id", draws.category_draw(p, hash_uniform("c", F.col("row_id"))).alias("category"))


def _raw_output(o):
    """Stand-in raw model output per orders row (scaled space + drop-first dummies)."""
    return o.select(
        F.col("o_orderkey").alias("row_id"),
        ((hash_uniform("pp", F.col("o_orderkey")) * 2.0 - 1.0) * 1.3).alias("o_totalprice"),
        ((hash_uniform("pd", F.col("o_orderkey")) * 2.0 - 1.0) * 1.1).alias("o_orderdate_days"),
        *[hash_uniform("pq", F.col("o_orderkey"), j).alias(encode.dummy_name("o_orderpriority", v))
          for j, v in enumerate(PRIORITIES[1:], start=1)])


@query("postprocess", sql=f"""
WITH o AS (SELECT o_orderkey, o_totalprice,
                  CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS DOUBLE) AS d FROM orders),
b AS (SELECT min(o_totalprice) AS mn0, max(o_totalprice) AS mx0, min(d) AS mn1, max(d) AS mx1 FROM o),
z AS (SELECT o_orderkey AS row_id, ({sql_uniform('pp', 'o_orderkey')} * 2.0 - 1.0) * 1.3 AS zp,
             ({sql_uniform('pd', 'o_orderkey')} * 2.0 - 1.0) * 1.1 AS zd,
             [0.5, {', '.join(sql_uniform('pq', 'o_orderkey', j) for j in range(1, 5))}] AS a FROM o),
sh AS ({_shares_sql('o_orderstatus', 'orders')}),
u AS (SELECT o_orderkey AS row_id, {sql_uniform('label', 12, 'o_orderkey')} AS u FROM orders),
v AS (SELECT z.row_id, (zp - -1.0) / 2.0 * (CASE WHEN mx0 - mn0 = 0 THEN 1.0 ELSE mx0 - mn0 END) + mn0 AS p,
             round_even((zd - -1.0) / 2.0 * (CASE WHEN mx1 - mn1 = 0 THEN 1.0 ELSE mx1 - mn1 END) + mn1, 0) AS d,
             {PRIORITIES!r}[list_position(a, list_max(a))] AS o_orderpriority, mn0, mx0, mn1, mx1 FROM z, b)
SELECT v.row_id, round(greatest(least(p, mx0), mn0), 6) AS o_totalprice, o_orderpriority,
       CAST(greatest(least(d, mx1), mn1) AS DOUBLE) AS o_orderdate_days, sh.cat AS o_orderstatus
FROM v JOIN u ON v.row_id = u.row_id LEFT JOIN sh ON u.u >= sh.lo AND u.u < sh.hi""")
def q_postprocess(spark, sf):
    from ..sampling.postprocess import Postprocessor
    df, spec = load_dataset(spark, sf, "orders")
    pp = Postprocessor.fit(df, spec)
    raw = _raw_output(table(spark, sf, "orders"))
    out = pp.transform(raw, dummy_coded=True)
    out = draws.draw_from_frequencies(out, df, "o_orderstatus", hash_uniform("label", 12, F.col("row_id")))
    return out.select("row_id", r6("o_totalprice").alias("o_totalprice"), "o_orderpriority",
                      F.col("o_orderdate_days").cast("double").alias("o_orderdate_days"), "o_orderstatus")


SHUF_SQL = f"""SELECT o_orderkey, CAST(row_number() OVER (ORDER BY {sql_uniform('shuffle', 3, 'o_orderkey')},
       o_orderkey) - 1 AS BIGINT) AS pos FROM orders"""


@query("shuffle_input", sql=SHUF_SQL)
def q_shuffle_input(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey")
    return draws.shuffle_order(o, "o_orderkey", 3)


@query("shuffle_and_batch", sql=f"""
SELECT o_orderkey, pos, CAST(floor(pos / 4000) AS BIGINT) AS gen_id FROM ({SHUF_SQL})""")
def q_shuffle_and_batch(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey")
    return draws.shuffle_and_batch(o, "o_orderkey", 3, 4000)


@query("train_test_split_stratified", sql=f"""
WITH r AS (SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderstatus
                  ORDER BY {sql_uniform('split', 5, 'o_orderkey')}, o_orderkey) AS rn,
                  count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders)
SELECT o_orderkey, CAST(rn <= ceil(0.2 * CAST(n AS DOUBLE)) AS BIGINT) AS is_test FROM r""")
def q_train_test_split(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return draws.train_test_split(o, "o_orderkey", 5, 0.2, stratify="o_orderstatus").select("o_orderkey", "is_test")


# ---- fixtures generated per row of a supplied table (A15, A16) ---------------

@query("two_moons", sql=f"""
WITH m AS (SELECT o_orderkey AS row_id, CAST({sql_uniform('moon', 'o_orderkey')} >= 0.5 AS BIGINT) AS y,
                  {math.pi!r} * {sql_uniform('angle', 'o_orderkey')} AS a FROM orders)
SELECT row_id, round(CASE WHEN y = 0 THEN cos(a) ELSE 1.0 - cos(a) END
                     + 0.1 * {sql_normal('moon-noise', 'row_id', 0)}, 6) AS x0,
       round(CASE WHEN y = 0 THEN sin(a) ELSE 0.5 - sin(a) END
             + 0.1 * {sql_normal('moon-noise', 'row_id', 1)}, 6) AS x1, y
FROM m""")
def q_two_moons(spark, sf):
    from ..sources.fixtures import two_moons
    keys = table(spark, sf, "orders").select(F.col("o_orderkey").alias("row_id"))
    m = two_moons(keys, "row_id", noise=0.1)
    return m.select("row_id", r6("x0").alias("x0"), r6("x1").alias("x1"), "y")


def _toy_sql():
    bins = [f"CASE WHEN {sql_uniform('bin', 'o_orderkey', j)} < 0.5 THEN -1.0 ELSE 1.0 END AS b{j}" for j in range(3)]
    gs = [f"{sql_normal('gauss', 'o_orderkey', j)} AS g{j}" for j in range(2)]
    allv = ["b0", "b1", "b2", "g0", "g1"]
    total = " + ".join(allv)
    pos = " + ".join(f"CASE WHEN {v} > 0 THEN 1 ELSE 0 END" for v in allv)
    sgn = " + ".join(f"CASE WHEN {v} >= 0 THEN 1 ELSE 0 END" for v in allv)
    return f"""WITH t AS (SELECT o_orderkey AS row_id, {', '.join(bins)}, {', '.join(gs)} FROM orders)
SELECT row_id, {', '.join(f'CASE WHEN b{j} = -1.0 THEN 0.0 ELSE b{j} END AS b{j}' for j in range(3))},
       round(g0, 6) AS g0, round(g1, 6) AS g1,
       CAST(CASE WHEN {total} > 0 THEN 1 ELSE 0 END AS BIGINT) AS y_sum,
       CAST(CASE WHEN {pos} >= 2 THEN 1 ELSE 0 END AS BIGINT) AS y_vote,
       CAST(({sgn}) % 2 AS BIGINT) AS y_xor
FROM t"""


@query("toy_rule_table", sql=_toy_sql())
def q_toy_rule_table(spark, sf):
    from ..sources.fixtures import toy_rule_table
    keys = table(spark, sf, "orders").select(F.col("o_orderkey").alias("row_id"))
    t = toy_rule_table(keys, "row_id", n_binary=3, n_gauss=2)
    return t.select("row_id", "b0", "b1", "b2", r6("g0").alias("g0"), r6("g1").alias("g1"),
                    "y_sum", "y_vote", "y_xor")


# ---- solver steps with an analytic velocity (F6/F7 checked by value) ---------

def _analytic_sql(kind):
    # v(t, x) = a - x with a = 0.5; 4 steps of h = 1/4 from x0 = prior noise
    h = 0.25
    x = f"{sql_normal('prior', 21, 'o_orderkey', 0)}"
    lines = [f"x0 AS MATERIALIZED (SELECT o_orderkey AS row_id, {x} AS x FROM orders)"]
    for i in range(4):
        prev = f"x{i}"
        if kind == "euler":
            step = f"x + {h!r} * (0.5 - x)"
        else:
            k1 = f"({h!r} * (0.5 - x))"
            k2 = f"({h!r} * (0.5 - (x + {k1} / 2)))"
            k3 = f"({h!r} * (0.5 - (x + {k2} / 2)))"
            k4 = f"({h!r} * (0.5 - (x + {k3})))"
            step = f"x + ({k1} + 2 * {k2} + 2 * {k3} + {k4}) / 6"
        lines.append(f"x{i + 1} AS MATERIALIZED (SELECT row_id, {step} AS x FROM {prev})")
    return "WITH " + ",\n".join(lines) + "\nSELECT row_id, round(x, 6) AS x FROM x4"


@query("euler_step_analytic", sql=_analytic_sql("euler"))
def q_euler_step_analytic(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("row_id"))
    o = o.withColumn("x", draws.prior_noise(21, F.col("row_id"), 0))
    out = solvers.euler_frame(o, "x", lambda t, x: F.lit(0.5) - x, n_steps=4, h=0.25)
    return out.select("row_id", r6("x").alias("x"))


@query("rk4_step_analytic", sql=_analytic_sql("rk4"))
def q_rk4_step_analytic(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("row_id"))
    o = o.withColumn("x", draws.prior_noise(21, F.col("row_id"), 0))
    out = solvers.rk4_frame(o, "x", lambda t, x: F.lit(0.5) - x, n_steps=4, h=0.25)
    return out.select("row_id", r6("x").alias("x"))
