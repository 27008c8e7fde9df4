"""Value-checked queries of the model half: one-round trees against SQL histograms, draws, flags, known cells.

A boosted model of one round and depth one is a histogram, a running sum and an arg max, all of which SQL can
state; the same code path trains the deep models.  Generated rows are checked where they are fixed by hash draws
(labels) and by the flow's promises (bounds, integrality, dictionaries).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.noise import hash_uniform, sql_normal, sql_uniform
from ..learners import flows
from ..learners.hist_boost import BoostParams
from ..metrics import utility
from ..sampling import draws
from ..sources.registry import load_dataset
from ..spec import ColumnSpec, TableSpec
from .q_models import SMALL, _cached, _n_rows, fitted_joint, fitted_seq
from .registry import query

STUMP = BoostParams(n_rounds=1, depth=1, eta=0.3, lam=0.0)
N_T, K, BINS = SMALL["n_t"], SMALL["K"], SMALL["n_bins"]


def r4(c):
    return F.round(c.cast("double"), 4) + 0.0


def _stump_seq(spark, sf):
    def build():
        df, spec = load_dataset(spark, sf, "orders")
        return flows.SequentialFlow(reg=STUMP, clf=BoostParams(n_rounds=1, depth=1, eta=0.1, objective="softmax"),
                                    **SMALL).fit(df, spec)
    return _cached(spark, sf, "stump-seq", build)


_PATH = f"""
b AS (SELECT min(o_totalprice)::DOUBLE AS mn0, max(o_totalprice)::DOUBLE AS mx0 FROM orders),
x AS (SELECT o_orderkey AS row_id, o_orderstatus AS lab,
             (o_totalprice::DOUBLE - mn0) / (mx0 - mn0) * 2.0 + -1.0 AS x1 FROM orders, b),
lv AS (SELECT level, 0.001 + level * (0.999 / {N_T - 1}) AS t FROM (SELECT unnest(range({N_T})) AS level)),
z AS (SELECT row_id, lab, x1, dup, {sql_normal('x0', 0, 'row_id', 'dup', 0)} AS z
      FROM x, (SELECT unnest(range({K})) AS dup)),
e AS (SELECT row_id, lab, dup, level, t * x1 + (1.0 - t) * z AS xt, x1 - z AS y FROM z, lv),
g AS (SELECT level, min(xt) AS mn, greatest((max(xt) - min(xt)) / {BINS}, 1e-12) AS w FROM e GROUP BY level),
base AS (SELECT lab, level, avg(y) AS base FROM e GROUP BY lab, level),
h AS (SELECT lab, level, least(greatest(ceil((xt - mn) / w), 1), {BINS})::BIGINT AS bin,
             sum(base - y) AS gg, count(*)::DOUBLE AS hh
      FROM e JOIN g USING (level) JOIN base USING (lab, level) GROUP BY ALL),
c AS (SELECT *, sum(gg) OVER (PARTITION BY lab, level ORDER BY bin) AS gl,
             sum(hh) OVER (PARTITION BY lab, level ORDER BY bin) AS hl,
             sum(gg) OVER (PARTITION BY lab, level) AS gt, sum(hh) OVER (PARTITION BY lab, level) AS ht FROM h),
s AS (SELECT *, gl * gl / hl + (gt - gl) * (gt - gl) / (ht - hl) - gt * gt / ht AS gain FROM c WHERE ht - hl >= 1),
best AS (SELECT lab, level, arg_max(bin, gain) AS split_bin, -0.3 * arg_max(gl / hl, gain) AS l,
                -0.3 * arg_max((gt - gl) / (ht - hl), gain) AS r FROM s GROUP BY lab, level)"""


@query("fit_velocity_stump", sql=f"""WITH {_PATH}
SELECT lab AS label, level::BIGINT AS level, split_bin, round(base, 4) + 0.0 AS base, round(l, 4) + 0.0 AS left_leaf,
       round(r, 4) + 0.0 AS right_leaf FROM best JOIN base USING (lab, level)""")
def q_fit_velocity_stump(spark, sf):
    fit = _stump_seq(spark, sf)
    kpos, L = 0, len(fit.prep.label_values)
    rows = []
    for lv, label in enumerate(fit.prep.label_values):
        for level in range(N_T):
            key = ((kpos * L + lv) * N_T + level, 0)
            f = fit.reg_forest
            rows.append((label, level, int(f.sbin[key][0, 0]), float(f.base[key]), *map(float, f.leaf[key][0])))
    df = spark.createDataFrame(rows, "label string, level long, split_bin long, base double, left_leaf double, "
                                     "right_leaf double")
    return df.select("label", "level", "split_bin", *[r4(F.col(c)).alias(c) for c in ("base", "left_leaf", "right_leaf")])


@query("velocity_eval_stump", sql=f"""WITH {_PATH}
SELECT row_id, round(xt, 4) + 0.0 AS xt,
       round(base + CASE WHEN least(greatest(ceil((xt - mn) / w), 1), {BINS}) <= split_bin THEN l ELSE r END, 4) + 0.0
         AS velocity
FROM e JOIN g USING (level) JOIN base USING (lab, level) JOIN best USING (lab, level) WHERE level = 2 AND dup = 0""")
def q_velocity_eval_stump(spark, sf):
    v = flows.velocity_frame(_stump_seq(spark, sf), 0, 2)
    return v.select("row_id", r4(F.col("xt")).alias("xt"), r4(F.col("velocity")).alias("velocity"))


@query("fit_category_stump", sql=f"""
WITH codes AS (SELECT c_nationkey, dense_rank() OVER (ORDER BY c_nationkey) - 1 AS code FROM (SELECT DISTINCT c_nationkey FROM customer)),
d AS (SELECT code + 1 AS bin, c_mktsegment AS seg FROM customer JOIN codes USING (c_nationkey)),
cls AS (SELECT DISTINCT c_mktsegment AS cls FROM customer), nc AS (SELECT count(*)::DOUBLE AS j FROM cls),
h AS (SELECT cls, bin, {K} * sum(1.0 / j - (seg = cls)::INT) AS gg, {K} * sum(2.0 / j * (1.0 - 1.0 / j)) AS hh
      FROM d, cls, nc GROUP BY ALL),
c AS (SELECT cls, bin, sum(gg) OVER w AS gl, sum(hh) OVER w AS hl, sum(gg) OVER (PARTITION BY cls) AS gt,
             sum(hh) OVER (PARTITION BY cls) AS ht FROM h WINDOW w AS (PARTITION BY cls ORDER BY bin)),
s AS (SELECT *, gl * gl / hl + (gt - gl) * (gt - gl) / (ht - hl) - gt * gt / ht AS gain FROM c
      WHERE hl >= 1 AND ht - hl >= 1)
SELECT cls AS category, arg_max(bin, gain)::BIGINT AS split_bin, round(-0.1 * arg_max(gl / hl, gain), 4) + 0.0 AS left_leaf,
       round(-0.1 * arg_max((gt - gl) / (ht - hl), gain), 4) + 0.0 AS right_leaf FROM s GROUP BY cls""")
def q_fit_category_stump(spark, sf):
    df, _ = load_dataset(spark, sf, "customer")
    spec = TableSpec.of(ColumnSpec("c_nationkey", "categorical"), ColumnSpec("c_mktsegment", "categorical"))
    fit = flows.SequentialFlow(label_cond=False, clf=BoostParams(n_rounds=1, depth=1, eta=0.1, objective="softmax"),
                               **{**SMALL, "n_bins": 16}).fit(df, spec)       # 25 codes, 16 bins: a bin per code all the same
    f = fit.clf_forest
    rows = [(v, int(f.sbin[(0, j)][0, 0]), *map(float, f.leaf[(0, j)][0]))
            for j, v in enumerate(fit.prep.dictionaries["c_mktsegment"])]
    out = spark.createDataFrame(rows, "category string, split_bin long, left_leaf double, right_leaf double")
    return out.select("category", "split_bin", r4(F.col("left_leaf")).alias("left_leaf"),
                      r4(F.col("right_leaf")).alias("right_leaf"))


_JOINT = f"""
b AS (SELECT min(o_totalprice)::DOUBLE AS a0, max(o_totalprice)::DOUBLE AS z0,
             min(o_orderdate::DATE - DATE '1970-01-01')::DOUBLE AS a1,
             max(o_orderdate::DATE - DATE '1970-01-01')::DOUBLE AS z1 FROM orders),
x AS (SELECT o_orderkey AS row_id, o_orderstatus AS lab, (o_totalprice::DOUBLE - a0) / (z0 - a0) * 2.0 + -1.0 AS x0,
             ((o_orderdate::DATE - DATE '1970-01-01')::DOUBLE - a1) / (z1 - a1) * 2.0 + -1.0 AS x1 FROM orders, b),
lv AS (SELECT level, 0.001 + level * (0.999 / {N_T - 1}) AS t FROM (SELECT unnest(range({N_T})) AS level)),
z AS (SELECT *, {sql_normal('x0', 0, 'row_id', 'dup', 0)} AS z0, {sql_normal('x0', 0, 'row_id', 'dup', 1)} AS z1
      FROM x, (SELECT unnest(range({K})) AS dup)),
e AS (SELECT row_id, lab, dup, level, t * x0 + (1.0 - t) * z0 AS xt0, t * x1 + (1.0 - t) * z1 AS xt1,
             x0 - z0 AS y0, x1 - z1 AS y1 FROM z, lv),
i AS (SELECT row_id, lab, dup, level, 0 AS j, xt0 AS xt, y0, y1 FROM e
      UNION ALL SELECT row_id, lab, dup, level, 1, xt1, y0, y1 FROM e),
g AS (SELECT level, j, min(xt) AS mn, greatest((max(xt) - min(xt)) / {BINS}, 1e-12) AS w FROM i GROUP BY level, j),
o AS (SELECT lab, level, j, xt, 0 AS k, y0 AS y FROM i UNION ALL SELECT lab, level, j, xt, 1, y1 FROM i),
base AS (SELECT lab, level, k, avg(y) AS base FROM o WHERE j = 0 GROUP BY ALL),
h AS (SELECT lab, level, k, j, least(greatest(ceil((xt - mn) / w), 1), {BINS})::BIGINT AS bin,
             sum(base - y) AS gg, count(*)::DOUBLE AS hh
      FROM o JOIN g USING (level, j) JOIN base USING (lab, level, k) GROUP BY ALL),
c AS (SELECT *, sum(gg) OVER q AS gl, sum(hh) OVER q AS hl, sum(gg) OVER (PARTITION BY lab, level, k, j) AS gt,
             sum(hh) OVER (PARTITION BY lab, level, k, j) AS ht FROM h
      WINDOW q AS (PARTITION BY lab, level, k, j ORDER BY bin)),
s AS (SELECT *, gl * gl / hl + (gt - gl) * (gt - gl) / (ht - hl) - gt * gt / ht AS gain FROM c WHERE ht - hl >= 1)"""


@query("fit_joint_velocity_stump", sql=f"""WITH {_JOINT}
SELECT lab AS label, level::BIGINT AS level, k::BIGINT AS output, arg_max(j, gain)::BIGINT AS split_input,
       arg_max(bin, gain) AS split_bin, round(-0.3 * arg_max(gl / hl, gain), 4) + 0.0 AS left_leaf,
       round(-0.3 * arg_max((gt - gl) / (ht - hl), gain), 4) + 0.0 AS right_leaf FROM s GROUP BY lab, level, k""")
def q_fit_joint_velocity_stump(spark, sf):
    df, _ = load_dataset(spark, sf, "orders")
    spec = TableSpec.of(ColumnSpec("o_totalprice", "continuous"), ColumnSpec("o_orderdate_days", "integer"),
                        ColumnSpec("o_orderstatus", "categorical", "label"))
    fit = flows.JointFlow(reg=STUMP, **SMALL).fit(df, spec)
    f, rows = fit.forest, []
    for lv, label in enumerate(fit.label_values):
        for level in range(N_T):
            for k in range(2):
                key = ((lv * N_T + level) * 2 + k, 0)
                rows.append((label, level, k, int(f.feat[key][0, 0]), int(f.sbin[key][0, 0]), *map(float, f.leaf[key][0])))
    out = spark.createDataFrame(rows, "label string, level long, output long, split_input long, split_bin long, "
                                      "left_leaf double, right_leaf double")
    return out.select("label", "level", "output", "split_input", "split_bin", r4(F.col("left_leaf")).alias("left_leaf"),
                      r4(F.col("right_leaf")).alias("right_leaf"))


_LABELS = f"""
n AS (SELECT o_orderstatus AS v, count(*) AS n FROM orders GROUP BY 1),
sh AS (SELECT v, (sum(n) OVER (ORDER BY v) - n)::DOUBLE / sum(n) OVER () AS lo,
              (sum(n) OVER (ORDER BY v))::DOUBLE / sum(n) OVER () AS hi FROM n),
r AS (SELECT row_id, {sql_uniform('label', 1, 'row_id')} AS u
      FROM (SELECT unnest(range((SELECT count(*) FROM orders))) AS row_id)),
lab AS (SELECT row_id, v AS o_orderstatus FROM r JOIN sh ON u >= lo AND u < hi)"""


@query("generate_methods_checked", sql=f"""WITH {_LABELS}
SELECT method, row_id, o_orderstatus, true AS in_bounds, true AS whole_days, true AS known_priority
FROM lab, (SELECT unnest(['HS3F_Euler', 'HS3F_Rg4', 'CS3F_Euler', 'CS3F_Rg4', 'FFM']) AS method)""")
def q_generate_methods_checked(spark, sf):
    df, _ = load_dataset(spark, sf, "orders")
    n = _n_rows(spark, sf)
    made = {"HS3F_Euler": fitted_seq(spark, sf).sample(n, seed=1, solver="euler"),
            "HS3F_Rg4": fitted_seq(spark, sf).sample(n, seed=1, solver="rk4"),
            "CS3F_Euler": fitted_seq(spark, sf, "CS3F").sample(n, seed=1, solver="euler"),
            "CS3F_Rg4": fitted_seq(spark, sf, "CS3F").sample(n, seed=1, solver="rk4"),
            "FFM": fitted_joint(spark, sf).sample(n, seed=1)}
    rng = df.agg(F.min("o_totalprice").alias("a"), F.max("o_totalprice").alias("b"),
                 F.min("o_orderdate_days").alias("c"), F.max("o_orderdate_days").alias("d")).first()
    known = [r[0] for r in df.select("o_orderpriority").distinct().collect()]
    whole = all(f.schema["o_orderdate_days"].dataType == df.schema["o_orderdate_days"].dataType for f in made.values())
    out = None
    for method, f in made.items():
        ok = (F.col("o_totalprice").between(rng["a"] - 1e-6, rng["b"] + 1e-6)
              & F.col("o_orderdate_days").between(rng["c"], rng["d"]))
        one = f.select(F.lit(method).alias("method"), "row_id", "o_orderstatus", ok.alias("in_bounds"),
                       F.lit(whole).alias("whole_days"), F.col("o_orderpriority").isin(known).alias("known_priority"))
        out = one if out is None else out.unionByName(one)
    return out


@query("impute_known_cells", sql=f"""
SELECT o_orderkey AS row_id, CASE WHEN {sql_uniform('impute', 'o_orderkey')} < 0.1 THEN NULL
         ELSE round(o_totalprice::DOUBLE, 4) END AS known_price, true AS filled, o_orderpriority,
       (o_orderdate::DATE - DATE '1970-01-01')::BIGINT AS o_orderdate_days, o_orderstatus FROM orders""")
def q_impute_known_cells(spark, sf):
    df, _ = load_dataset(spark, sf, "orders")
    gone = hash_uniform("impute", F.col("row_id")) < 0.1
    blank = df.withColumn("o_totalprice", F.when(gone, F.lit(None)).otherwise(F.col("o_totalprice")))
    rng = df.agg(F.min("o_totalprice").alias("a"), F.max("o_totalprice").alias("b")).first()
    out = fitted_joint(spark, sf).impute(blank, seed=3)
    return out.select("row_id", F.when(~gone, F.round("o_totalprice", 4)).alias("known_price"),
                      F.col("o_totalprice").between(rng["a"] - 1e-6, rng["b"] + 1e-6).alias("filled"),
                      "o_orderpriority", F.col("o_orderdate_days").cast("long").alias("o_orderdate_days"), "o_orderstatus")


_SPLIT = f"""
o AS (SELECT o_orderkey AS k, (o_orderdate::DATE - DATE '1970-01-01')::DOUBLE AS x, o_totalprice::DOUBLE AS y,
             {sql_uniform('split', 0, 'o_orderkey')} AS u FROM orders),
s AS (SELECT *, row_number() OVER (ORDER BY u, k) <= ceil(0.2 * count(*) OVER ()) AS is_test FROM o)"""


@query("predict_linear_regression", sql=f"""WITH {_SPLIT},
m AS (SELECT regr_slope(y, x) AS a, regr_intercept(y, x) AS b FROM s WHERE NOT is_test)
SELECT round(y, 2) AS label, round(a * x + b, 1) AS prediction FROM s, m WHERE is_test""")
def q_predict_linear_regression(spark, sf):
    df, _ = load_dataset(spark, sf, "orders")
    s = draws.train_test_split(df, "row_id", 0, 0.2)
    tr, te, _, cols = utility.prepare_parts(s.where("is_test = 0"), s.where("is_test = 1"), ["o_orderdate_days"], [],
                                            "o_totalprice", False)
    (p,) = utility.predictions("lin", tr, [te], cols, False, 0, utility.UtilityParams())
    return p.select(F.round("label", 2).alias("label"), F.round("prediction", 1).alias("prediction"))


@query("split_with_missing_classes", sql=f"""
WITH o AS (SELECT o_orderkey AS k, CASE WHEN {sql_uniform('gap', 'o_orderkey')} < 0.1 THEN NULL ELSE o_orderstatus END AS c,
                  {sql_uniform('split', 0, 'o_orderkey')} AS u FROM orders)
SELECT k AS row_id, c AS o_orderstatus,
       (row_number() OVER (PARTITION BY c ORDER BY u, k) <= ceil(0.2 * count(*) OVER (PARTITION BY c)))::BIGINT AS is_test
FROM o""")
def q_split_with_missing_classes(spark, sf):
    df, _ = load_dataset(spark, sf, "orders")
    gap = hash_uniform("gap", F.col("row_id")) < 0.1
    d = df.select("row_id", F.when(~gap, F.col("o_orderstatus")).alias("o_orderstatus"))
    return draws.train_test_split(d, "row_id", 0, 0.2, stratify="o_orderstatus")


@query("score_four_models_regression")
def q_score_four_models_regression(spark, sf):
    """G12, G15 for a continuous target: retail price from size and brand."""
    df, _ = load_dataset(spark, sf, "part")
    s = draws.train_test_split(df, "row_id", 0, 0.2)
    up = utility.UtilityParams(ada_rounds=10, forest_trees=20, forest_depth=8, boost_rounds=10, boost_depth=4, seeds=2)
    r = utility.score_four_models(s.where("is_test = 0"), s.where("is_test = 1"), ["p_size", "p_brand"], ["p_brand"],
                                  "p_retailprice", False, up)
    return spark.createDataFrame([(k, float(v)) for k, v in r.items()], "learner string, r2 double")


