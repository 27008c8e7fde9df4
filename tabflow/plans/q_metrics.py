"""Queries for the evaluation operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.noise import hash_normal, hash_uniform, sql_normal, sql_uniform
from ..metrics import neighbors, report, scores, transport
from ..operators import encode, project
from ..sampling import draws
from ..session import scratch_path
from ..sources import readers
from ..sources.registry import table
from .q_basic import SEGMENTS, _scaled_sql
from .registry import query, r6

# ---- customer split into a "real" and a "synthetic" half by hash -------------

SEG_COLS = [encode.dummy_name("c_mktsegment", s) for s in SEGMENTS]
MS_COLS = ["c_acctbal", *SEG_COLS]


def _customer_metric_space(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    u = hash_uniform("split", F.col("c_custkey"))
    tr, te, _, _ = encode.metric_space(c.filter(u < 0.5), c.filter(u >= 0.5), ["c_acctbal"], ["c_mktsegment"])
    return (tr.withColumnRenamed("c_custkey", "row_id"), te.withColumnRenamed("c_custkey", "row_id"))


def _seg_sql(value=0.5):
    return ", ".join(f"CASE WHEN c_mktsegment = '{s}' THEN {value!r} ELSE 0.0 END AS c_mktsegment_{s}"
                     for s in SEGMENTS)


MS_SQL = f"""WITH c AS (SELECT c_custkey, c_acctbal, c_mktsegment,
                  {sql_uniform('split', 'c_custkey')} < 0.5 AS is_real FROM customer),
b AS (SELECT min(c_acctbal) AS mn, max(c_acctbal) AS mx FROM c WHERE is_real),
m AS (SELECT c_custkey, is_real, {_scaled_sql('c_acctbal', 'mn', 'mx', 0.0, 1.0)} AS c_acctbal, {_seg_sql()}
      FROM c, b),
r AS (SELECT * FROM m WHERE is_real), f AS (SELECT * FROM m WHERE NOT is_real)
"""


def _l1_sql(a, b, cols=MS_COLS):
    return " + ".join(f"abs({a}.{c} - {b}.{c})" for c in cols)


def _kth_sql(rank):
    return f""", p AS (SELECT a.c_custkey, {_l1_sql('a', 'b')} AS d FROM m a, m b),
k AS (SELECT c_custkey, d, row_number() OVER (PARTITION BY c_custkey ORDER BY d) AS rn FROM p)
SELECT c_custkey, round(d, 6) AS {{name}} FROM k WHERE rn = {rank}"""


@query("wasserstein1", sql=f"""
WITH c AS (SELECT c_acctbal, CAST(c_nationkey AS DOUBLE) AS c_nationkey,
                  CASE WHEN {sql_uniform('split', 'c_custkey')} < 0.5 THEN 0 ELSE 1 END AS side FROM customer),
l AS (SELECT 'c_acctbal' AS column_name, c_acctbal AS v, side FROM c
      UNION ALL SELECT 'c_nationkey', c_nationkey, side FROM c),
g AS (SELECT column_name, v, sum(CASE WHEN side = 0 THEN 1 ELSE 0 END) AS cp,
             sum(CASE WHEN side = 1 THEN 1 ELSE 0 END) AS cq FROM l GROUP BY column_name, v),
w AS (SELECT column_name, v, lead(v) OVER (PARTITION BY column_name ORDER BY v) AS nv,
             CAST(sum(cp) OVER (PARTITION BY column_name ORDER BY v ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS fp,
             CAST(sum(cq) OVER (PARTITION BY column_name ORDER BY v ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS fq,
             CAST(sum(cp) OVER (PARTITION BY column_name) AS DOUBLE) AS np,
             CAST(sum(cq) OVER (PARTITION BY column_name) AS DOUBLE) AS nq FROM g)
SELECT column_name, round(sum(abs(fp / np - fq / nq) * (nv - v)), 6) AS w1 FROM w WHERE nv IS NOT NULL
GROUP BY column_name""")
def q_wasserstein1(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_acctbal",
                                            F.col("c_nationkey").cast("double").alias("c_nationkey"))
    u = hash_uniform("split", F.col("c_custkey"))
    w = transport.wasserstein1_columns(c.filter(u < 0.5), c.filter(u >= 0.5), ["c_acctbal", "c_nationkey"])
    return w.select("column_name", r6("w1").alias("w1"))


def _w1_lower_sql():
    parts = " UNION ALL ".join(f"SELECT '{c}' AS column_name, {c} AS v, is_real FROM m" for c in MS_COLS)
    return MS_SQL + f""", l AS ({parts}),
g AS (SELECT column_name, v, sum(CASE WHEN is_real THEN 1 ELSE 0 END) AS cp,
             sum(CASE WHEN is_real THEN 0 ELSE 1 END) AS cq FROM l GROUP BY column_name, v),
w AS (SELECT column_name, v, lead(v) OVER (PARTITION BY column_name ORDER BY v) AS nv,
             CAST(sum(cp) OVER (PARTITION BY column_name ORDER BY v ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS fp,
             CAST(sum(cq) OVER (PARTITION BY column_name ORDER BY v ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS fq,
             CAST(sum(cp) OVER (PARTITION BY column_name) AS DOUBLE) AS np,
             CAST(sum(cq) OVER (PARTITION BY column_name) AS DOUBLE) AS nq FROM g)
SELECT round(sum(abs(fp / np - fq / nq) * (nv - v)), 6) AS w1_lower FROM w WHERE nv IS NOT NULL"""


@query("wasserstein1_lower", sql=_w1_lower_sql())
def q_wasserstein1_lower(spark, sf):
    real, fake = _customer_metric_space(spark, sf)
    return transport.wasserstein1_lower(real, fake, MS_COLS).select(r6("w1_lower").alias("w1_lower"))


def _w1_upper_sql(levels=6, seed=1):
    """The quadtree bound level by level: equal points, then cells of doubling width."""
    n = range(len(MS_COLS))
    keys = [f"CAST(floor(({c} - l{i} + {sql_uniform('shift', seed, i)} * side) / (2.0 * side) * {float(2 ** levels)!r}) AS BIGINT)"
            for i, c in enumerate(MS_COLS)]
    ends = ", ".join(f"min({c}) AS l{i}, max({c}) - min({c}) AS s{i}" for i, c in enumerate(MS_COLS))
    sql = MS_SQL + f""", ends AS (SELECT CAST(sum(CASE WHEN is_real THEN 1 ELSE 0 END) AS DOUBLE) AS np,
    CAST(sum(CASE WHEN is_real THEN 0 ELSE 1 END) AS DOUBLE) AS nq, {ends} FROM m),
e AS (SELECT *, greatest({', '.join(f's{i}' for i in n)}) AS side FROM ends),
t0 AS (SELECT sum(CASE WHEN is_real THEN 1 ELSE 0 END) / min(np) - sum(CASE WHEN is_real THEN 0 ELSE 1 END) / min(nq) AS d,
       0.0::DOUBLE AS cost, {', '.join(f'{c} AS lo{i}, {c} AS hi{i}, min({k}) AS k{i}' for i, (c, k) in enumerate(zip(MS_COLS, keys)))}
       FROM m, e GROUP BY {', '.join(MS_COLS)})"""
    extent = " + ".join(f"(max(hi{i}) - min(lo{i}))" for i in n)
    for level in range(levels + 1):
        ks = ", ".join(f"k{i} >> {min(level, 1)}" for i in n)
        sql += f""",
t{level + 1} AS (SELECT sum(d) AS d, sum(cost) + ({extent}) * (sum(abs(d)) - abs(sum(d))) / 2 AS cost,
    {', '.join(f'min(lo{i}) AS lo{i}, max(hi{i}) AS hi{i}, k{i} >> {min(level, 1)} AS k{i}' for i in n)}
    FROM t{level} GROUP BY {ks})"""
    return sql + f" SELECT round(sum(cost), 6) AS w1_upper FROM t{levels + 1}"


@query("wasserstein1_upper", sql=_w1_upper_sql())
def q_wasserstein1_upper(spark, sf):
    real, fake = _customer_metric_space(spark, sf)
    return transport.wasserstein1_upper(real, fake, MS_COLS, levels=6, seed=1).select(r6("w1_upper").alias("w1_upper"))


def _sliced_sql(n_proj=8, seed=1):
    projs = []
    for j in range(n_proj):
        w = [sql_normal("slice", seed, j, i) for i in range(len(MS_COLS))]
        norm = "sqrt(" + " + ".join(f"({x}) * ({x})" for x in w) + ")"
        num = " + ".join(f"({x}) * {c}" for x, c in zip(w, MS_COLS))
        projs.append(f"SELECT 'proj_{j}' AS column_name, ({num}) / {norm} AS v, is_real FROM m")
    return MS_SQL + f""", l AS ({' UNION ALL '.join(projs)}),
g AS (SELECT column_name, v, sum(CASE WHEN is_real THEN 1 ELSE 0 END) AS cp,
             sum(CASE WHEN is_real THEN 0 ELSE 1 END) AS cq FROM l GROUP BY column_name, v),
w AS (SELECT column_name, v, lead(v) OVER (PARTITION BY column_name ORDER BY v) AS nv,
             CAST(sum(cp) OVER (PARTITION BY column_name ORDER BY v ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS fp,
             CAST(sum(cq) OVER (PARTITION BY column_name ORDER BY v ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS fq,
             CAST(sum(cp) OVER (PARTITION BY column_name) AS DOUBLE) AS np,
             CAST(sum(cq) OVER (PARTITION BY column_name) AS DOUBLE) AS nq FROM g),
per AS (SELECT column_name, sum(abs(fp / np - fq / nq) * (nv - v)) AS w1 FROM w WHERE nv IS NOT NULL
        GROUP BY column_name)
SELECT round(avg(w1), 6) AS sliced_w1 FROM per"""


@query("sliced_w1", sql=_sliced_sql())
def q_sliced_w1(spark, sf):
    real, fake = _customer_metric_space(spark, sf)
    return transport.sliced_w1(real, fake, MS_COLS, n_proj=8, seed=1).select(r6("sliced_w1").alias("sliced_w1"))


@query("pairwise_l1", sql=MS_SQL + f"""
SELECT r.c_custkey AS row_id, round(min({_l1_sql('r', 'f')}), 6) AS nearest FROM r, f GROUP BY r.c_custkey""")
def q_pairwise_l1(spark, sf):
    real, fake = _customer_metric_space(spark, sf)
    d = neighbors.nearest_distance(real, fake, MS_COLS, "row_id")
    return d.select("row_id", r6("nearest").alias("nearest"))


def _whole_metric_space(spark, sf):
    """All customers (scaled with the bounds of the real half, as the other queries are)."""
    real, fake = _customer_metric_space(spark, sf)
    return real.unionByName(fake)


def _kth_query(k_rank, name):
    def fn(spark, sf):
        real = _whole_metric_space(spark, sf)
        pts = neighbors.dedupe_points(real, MS_COLS, "row_id")
        d = neighbors.kth_distance(pts, pts, MS_COLS, k_rank)
        back = real.join(pts.select("pid", *MS_COLS), on=MS_COLS)
        return back.join(d, on="pid").select(F.col("row_id").alias("c_custkey"), r6("dist").alias(name))
    return fn


query("kth_smallest", sql=MS_SQL + _kth_sql(3).format(name="kth"))(_kth_query(3, "kth"))


@query("knn_radius", sql=MS_SQL + _kth_sql(6).format(name="radius"))
def q_knn_radius(spark, sf):
    real = _whole_metric_space(spark, sf)
    pts = neighbors.dedupe_points(real, MS_COLS, "row_id")
    rad = neighbors.knn_radius(pts, MS_COLS, 5)
    back = real.join(pts.select("pid", *MS_COLS), on=MS_COLS)
    return back.join(rad, on="pid").select(F.col("row_id").alias("c_custkey"), r6("radius").alias("radius"))


def _coverage_sql(ms_sql, cols, key, k_expr):
    l1 = " + ".join(f"abs(a.{c} - b.{c})" for c in cols)
    return ms_sql + f""", kk AS ({k_expr}),
p AS (SELECT a.{key}, {l1} AS d FROM r a, r b),
k AS (SELECT {key}, d, row_number() OVER (PARTITION BY {key} ORDER BY d) AS rn FROM p),
rad AS (SELECT {key}, d AS radius FROM k, kk WHERE rn = kk.k + 1),
nn AS (SELECT a.{key}, min({l1}) AS dmin FROM r a, f b GROUP BY a.{key})
SELECT round(avg(CASE WHEN dmin < radius THEN 1.0 ELSE 0.0 END), 6) AS coverage FROM rad JOIN nn USING ({key})"""


def _auto_k_sql(cols, src="r"):
    g = ", ".join(cols)
    return f"""SELECT greatest(1, min(m)) + 1 AS k FROM (
  SELECT m, sum(rows) OVER (ORDER BY m) / sum(rows) OVER () AS cov FROM (
    SELECT m, CAST(sum(m) AS DOUBLE) AS rows FROM (SELECT count(*) AS m FROM {src} GROUP BY {g}) GROUP BY m))
WHERE cov >= 0.95"""


@query("coverage", sql=_coverage_sql(MS_SQL, MS_COLS, "c_custkey", "SELECT 5 AS k"))
def q_coverage(spark, sf):
    real, fake = _customer_metric_space(spark, sf)
    v = neighbors.coverage(real, fake, MS_COLS, 5, "row_id")
    return spark.createDataFrame([(round(float(v), 6),)], "coverage double")


@query("coverage_auto_k", sql=_coverage_sql(MS_SQL, MS_COLS, "c_custkey", _auto_k_sql(MS_COLS)))
def q_coverage_auto_k(spark, sf):
    real, fake = _customer_metric_space(spark, sf)
    cp = neighbors.covered_points(real, fake, MS_COLS, neighbors.auto_k(real, MS_COLS), "row_id")
    return cp.agg(F.round(F.sum(F.when(F.col("covered"), F.col("m")).otherwise(0)) / F.sum("m"), 6)
                  .alias("coverage"))


EMB = [f"e{i}" for i in range(64)]
EMB_SQL = f"""WITH m AS (SELECT vec_id, {', '.join(f'CAST(embedding[{i + 1}] AS DOUBLE) AS e{i}' for i in range(64))},
                  {sql_uniform('split', 'vec_id')} < 0.5 AS is_real FROM embeddings),
r AS (SELECT * FROM m WHERE is_real), f AS (SELECT * FROM m WHERE NOT is_real)
"""


@query("coverage_embeddings", sql=_coverage_sql(EMB_SQL, EMB, "vec_id", _auto_k_sql(EMB)))
def q_coverage_embeddings(spark, sf):
    e = table(spark, sf, "embeddings")
    e = e.select(F.col("vec_id").alias("row_id"),
                 *[F.element_at("embedding", i + 1).cast("double").alias(f"e{i}") for i in range(64)])
    u = hash_uniform("split", F.col("row_id"))
    real, fake = e.filter(u < 0.5), e.filter(u >= 0.5)
    cp = neighbors.covered_points(real, fake, EMB, neighbors.auto_k(real, EMB), "row_id")
    return cp.agg(F.round(F.sum(F.when(F.col("covered"), F.col("m")).otherwise(0)) / F.sum("m"), 6)
                  .alias("coverage"))


LI_COLS = ["l_returnflag", "l_linestatus", "l_linenumber", "l_discount", "l_tax"]


@query("auto_k", sql=_auto_k_sql(LI_COLS, "lineitem").replace("SELECT greatest(1, min(m)) + 1 AS k",
                                                              "SELECT CAST(greatest(1, min(m)) + 1 AS BIGINT) AS k"))
def q_auto_k(spark, sf):
    li = table(spark, sf, "lineitem").select(*LI_COLS)
    return neighbors.auto_k_frame(li, LI_COLS)


# ---- predictive scores ------------------------------------------------------

PRED_SQL = f"""CASE WHEN {sql_uniform('pred', 'o_orderkey')} < 0.6 THEN o_orderstatus
     WHEN {sql_uniform('pred2', 'o_orderkey')} < 0.3 THEN 'F'
     WHEN {sql_uniform('pred2', 'o_orderkey')} < 0.6 THEN 'O'
     WHEN {sql_uniform('pred2', 'o_orderkey')} < 0.9 THEN 'P' ELSE 'X' END"""


def _pred_col():
    u, u2 = hash_uniform("pred", F.col("o_orderkey")), hash_uniform("pred2", F.col("o_orderkey"))
    return (F.when(u < 0.6, F.col("o_orderstatus")).when(u2 < 0.3, "F").when(u2 < 0.6, "O")
            .when(u2 < 0.9, "P").otherwise("X"))


@query("f1_macro", sql=f"""
WITH t AS (SELECT o_orderstatus AS y, {PRED_SQL} AS p FROM orders),
lab AS (SELECT y AS l FROM t UNION SELECT p FROM t),
s AS (SELECT l, (SELECT count(*) FROM t WHERE y = l AND p = l) AS tp,
             (SELECT count(*) FROM t WHERE y = l) AS nt, (SELECT count(*) FROM t WHERE p = l) AS np FROM lab)
SELECT round(avg(2.0 * tp / (nt + np)), 6) AS f1 FROM s""")
def q_f1_macro(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus").withColumn("pred", _pred_col())
    return scores.f1_macro(o, "o_orderstatus", "pred").select(r6("f1").alias("f1"))


@query("r2", sql=f"""
WITH t AS (SELECT o_totalprice AS y, o_totalprice + 40000.0 * {sql_normal('r2', 'o_orderkey')} AS p FROM orders),
m AS (SELECT avg(y) AS my FROM t)
SELECT round(1.0 - sum((y - p) * (y - p)) / sum((y - my) * (y - my)), 6) AS r2 FROM t, m""")
def q_r2(spark, sf):
    o = table(spark, sf, "orders").select(
        "o_totalprice", (F.col("o_totalprice") + F.lit(40000.0) * hash_normal("r2", F.col("o_orderkey"))).alias("p"))
    return scores.r2(o, "o_totalprice", "p").select(r6("r2").alias("r2"))


@query("missing_class_guard", sql=f"""
WITH o AS (SELECT o_orderpriority, {sql_uniform('split', 'o_orderkey')} AS u FROM orders),
tr AS (SELECT DISTINCT o_orderpriority FROM o WHERE u < 0.8 AND o_orderpriority <> '5-LOW'),
te AS (SELECT DISTINCT o_orderpriority FROM o WHERE u >= 0.8),
m AS (SELECT count(*) AS n FROM te WHERE o_orderpriority NOT IN (SELECT o_orderpriority FROM tr))
SELECT CAST(n AS BIGINT) AS n_missing_classes, CAST(n > 0 AS BIGINT) AS guard FROM m""")
def q_missing_class_guard(spark, sf):
    o = table(spark, sf, "orders").withColumn("u", hash_uniform("split", F.col("o_orderkey")))
    tr = o.filter((F.col("u") < 0.8) & (F.col("o_orderpriority") != "5-LOW"))
    te = o.filter(F.col("u") >= 0.8)
    return scores.missing_classes(tr, te, "o_orderpriority")


# ---- experiment result tables (derived per lineitem row = one run) ----------

LEARNER_FACTOR = {"lin": 0.9, "linboost": 0.95, "tree": 1.05, "treeboost": 1.1}


def _run_exprs():
    """(name, spark column builder, sql text) of each metric of a run."""
    C = F.col
    cls_s = lambda: C("l_linestatus") == "F"
    out = [
        ("W_train", lambda: C("l_discount") * 10.0, "l_discount * 10.0"),
        ("W_test", lambda: C("l_tax") * 10.0 + C("l_discount"), "l_tax * 10.0 + l_discount"),
    ]
    reg = {"R2_real": (20.0, 30.0), "R2_fake": (25.0, 25.0), "R2_comb": (15.0, 35.0)}
    for n, (a, b) in reg.items():
        out.append((n, lambda a=a, b=b: F.when(cls_s(), F.lit(0.0)).otherwise((C("l_quantity") - a) / b),
                    f"CASE WHEN l_linestatus = 'F' THEN 0.0 ELSE (l_quantity - {a!r}) / {b!r} END"))
    f1 = {"F1_real": ("l_discount * 5.0 + 0.5", lambda: C("l_discount") * 5.0 + 0.5),
          "F1_fake": ("l_tax * 5.0 + 0.4", lambda: C("l_tax") * 5.0 + 0.4),
          "F1_comb": ("(l_discount + l_tax) * 3.0 + 0.45", lambda: (C("l_discount") + C("l_tax")) * 3.0 + 0.45)}
    for n, (sq, sc) in f1.items():
        out.append((n, lambda sc=sc: F.when(cls_s(), sc()).otherwise(F.lit(0.0)),
                    f"CASE WHEN l_linestatus = 'F' THEN {sq} ELSE 0.0 END"))
    out += [("coverage_train", lambda: C("l_discount") + C("l_tax") * 5.0, "l_discount + l_tax * 5.0"),
            ("coverage_test", lambda: C("l_tax") * 10.0, "l_tax * 10.0"),
            ("time", lambda: C("l_extendedprice") / 1000.0, "l_extendedprice / 1000.0")]
    base = {n: (c, s) for n, c, s in out}
    for m in report.LEARNERS:
        f = LEARNER_FACTOR[m]
        for score in ("R2", "F1"):
            for side in ("real", "fake", "comb"):
                c, s = base[f"{score}_{side}"]
                out.append((f"{score}_{m}_{side}", lambda c=c, f=f: c() * F.lit(f), f"({s}) * {f!r}"))
    return out


def experiment_runs(spark, sf):
    li = table(spark, sf, "lineitem")
    methods = F.array(*[F.lit(m) for m in report.METHODS])
    return li.select(F.concat("l_returnflag", "l_linestatus").alias("dataset"),
                     F.element_at(methods, (F.col("l_linenumber") % 5 + 1).cast("int")).alias("method"),
                     *[c().alias(n) for n, c, _ in _run_exprs()])


RUNS_SQL = f"""WITH runs AS (SELECT l_returnflag || l_linestatus AS dataset,
    {report.METHODS!r}[(l_linenumber % 5) + 1] AS method,
    {', '.join(f'{s} AS {n}' for n, _, s in _run_exprs())} FROM lineitem)
"""
ALL_METRICS = report.MAIN_METRICS + report.LEARNER_METRICS
MEANS_SQL = RUNS_SQL + f""", means AS (SELECT dataset, method, {', '.join(f'avg({m}) AS {m}' for m in ALL_METRICS)}
    FROM runs GROUP BY dataset, method)
"""
MEANS_OUT_SQL = MEANS_SQL + f"SELECT dataset, method, {', '.join(f'round({m}, 6) AS {m}' for m in ALL_METRICS)} FROM means"


def _means(spark, sf):
    return report.mean_over_runs(experiment_runs(spark, sf))


def _round_all(df, cols=ALL_METRICS):
    return df.select(*[r6(c).alias(c) if c in cols else F.col(c) for c in df.columns])


@query("mean_over_runs", sql=MEANS_OUT_SQL)
def q_mean_over_runs(spark, sf):
    return _round_all(_means(spark, sf))


@query("result_row_wide", sql=MEANS_OUT_SQL)
def q_result_row_wide(spark, sf):
    long = report.to_long(experiment_runs(spark, sf), ["dataset", "method"], ALL_METRICS)
    return _round_all(report.result_row_wide(long)).select(*report.RESULT_COLUMNS)


@query("collect_results", sql=MEANS_OUT_SQL)
def q_collect_results(spark, sf):
    runs = experiment_runs(spark, sf)
    parts = [report.mean_over_runs(runs.filter(F.col("dataset").endswith(s))) for s in ("F", "O")]
    return _round_all(report.collect_results(parts))


@query("conditional_mean", sql=MEANS_SQL + f"""SELECT method, {', '.join(
    f'round(avg(CASE WHEN {m} > 0 THEN {m} END), 6) AS {m}' if m in report.POSITIVE_ONLY
    else f'round(avg({m}), 6) AS {m}' for m in report.MAIN_METRICS)} FROM means GROUP BY method""")
def q_conditional_mean(spark, sf):
    return report.conditional_mean(_means(spark, sf), report.MAIN_METRICS, group=["method"])


CAT_DATASETS = ["AF", "NF", "RF"]
NO_R2 = [m for m in report.MAIN_METRICS if not m.startswith("R2")]


@query("method_comparison", sql=MEANS_SQL + f"""SELECT method, {', '.join(
    f'round(avg(CASE WHEN {m} > 0 THEN {m} END), 3) AS {m}' if m in report.POSITIVE_ONLY
    else f'round(avg({m}), 3) AS {m}' for m in NO_R2)} FROM means
WHERE dataset IN ('AF', 'NF', 'RF') GROUP BY method""")
def q_method_comparison(spark, sf):
    sub = report.filter_datasets(_means(spark, sf), CAT_DATASETS)
    return report.method_comparison(sub, report.MAIN_METRICS, drop=[m for m in report.MAIN_METRICS
                                                                    if m.startswith("R2")], decimals=3)


@query("filter_datasets", sql=MEANS_OUT_SQL.replace("FROM means", "FROM means WHERE dataset IN ('AF', 'RF')"))
def q_filter_datasets(spark, sf):
    return _round_all(report.filter_datasets(_means(spark, sf), ["AF", "RF"]))


@query("project_result_columns", sql=MEANS_SQL + f"""SELECT dataset, {', '.join(
    f'round({m}, 6) AS {m}' for m in report.MAIN_METRICS)} FROM means""")
def q_project_result_columns(spark, sf):
    return _round_all(project.project_result_columns(_means(spark, sf), report.SUMMARY_COLUMNS))


@query("numeric_columns", sql=MEANS_SQL + f"SELECT {', '.join(f'round({m}, 6) AS {m}' for m in ALL_METRICS)} FROM means")
def q_numeric_columns(spark, sf):
    m = _means(spark, sf)
    return _round_all(m.select(*report.numeric_columns(m)))


@query("plot_ranges", sql=RUNS_SQL + """SELECT round(min(W_train), 6) AS W_train_min,
    round(min(coverage_train), 6) AS coverage_train_min, round(max(W_train), 6) AS W_train_max,
    round(max(coverage_train), 6) AS coverage_train_max FROM runs""")
def q_plot_ranges(spark, sf):
    r = report.plot_ranges(experiment_runs(spark, sf), ["W_train", "coverage_train"])
    return r.select(*[r6(c).alias(c) for c in r.columns])


@query("dataset_metric_matrix", sql=MEANS_SQL + f"""SELECT dataset, {', '.join(
    f"round(max(CASE WHEN method = '{m}' THEN W_train END), 6) AS {m}" for m in report.METHODS)}
FROM means GROUP BY dataset""")
def q_dataset_metric_matrix(spark, sf):
    d = report.dataset_metric_matrix(_means(spark, sf), "W_train")
    return d.select("dataset", *[r6(m).alias(m) for m in report.METHODS])


RESULT_SCHEMA = ", ".join(["dataset string", "method string"] + [f"{m} double" for m in ALL_METRICS])


@query("write_results_csv", sql=MEANS_OUT_SQL)
def q_write_results_csv(spark, sf):
    path = scratch_path(spark, "results_csv")
    readers.write_results(_round_all(_means(spark, sf)), path, "csv")
    return spark.read.schema(RESULT_SCHEMA).option("header", "true").csv(path)


@query("read_results_csv", sql=MEANS_OUT_SQL)
def q_read_results_csv(spark, sf):
    path = scratch_path(spark, "results_csv_in")
    readers.write_results(_round_all(_means(spark, sf)), path, "csv")
    return readers.read_results(spark, path)


# ---- flagship: coverage of real orders by an independent-marginal sampler ------

PRIOS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
STATUS = ["F", "O", "P"]
FLAG_COLS = ["o_totalprice", *[encode.dummy_name("o_orderstatus", v) for v in STATUS],
             *[encode.dummy_name("o_orderpriority", v) for v in PRIOS]]


def marginal_fake_orders(spark, sf):
    """One synthetic order per real order key: status and priority drawn from
    their observed frequencies (F1, E3), price uniform between the observed
    bounds (F2/C2 with a uniform prior)."""
    o = table(spark, sf, "orders")
    b = encode.data_bounds(o, ["o_totalprice"])["o_totalprice"]
    rows = o.select(F.col("o_orderkey").alias("row_id"))
    rows = draws.draw_from_frequencies(rows, o, "o_orderstatus", hash_uniform("fs", F.col("row_id")))
    rows = draws.draw_from_frequencies(rows, o, "o_orderpriority", hash_uniform("fp", F.col("row_id")))
    z = hash_uniform("fprice", F.col("row_id")) * 2.0 - 1.0
    return rows.withColumn("o_totalprice", encode.unscale_expr(z, *b))


def flagship(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("row_id"), "o_totalprice",
                                          "o_orderstatus", "o_orderpriority")
    fake = marginal_fake_orders(spark, sf)
    real_m, fake_m, _, _ = encode.metric_space(o, fake.select(*o.columns), ["o_totalprice"],
                                               ["o_orderstatus", "o_orderpriority"])
    v = neighbors.coverage(real_m, fake_m, FLAG_COLS, 5, "row_id")
    return spark.createDataFrame([(round(float(v), 6),)], "coverage double")


def _flag_sql():
    def dums(col, vals, src):
        return ", ".join(f"CASE WHEN {src}.{col} = '{v}' THEN 0.5 ELSE 0.0 END AS \"{col}_{v}\"" for v in vals)
    cols = ["o_totalprice"] + [f'"o_orderstatus_{v}"' for v in STATUS] + \
        [f'"o_orderpriority_{v}"' for v in PRIOS]
    l1 = " + ".join(f"abs(a.{c} - b.{c})" for c in cols)
    shares_s = ("SELECT o_orderstatus AS cat, CAST(coalesce(sum(n) OVER (ORDER BY o_orderstatus ROWS BETWEEN "
                "UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) / CAST(sum(n) OVER () AS DOUBLE) AS lo, "
                "CAST(sum(n) OVER (ORDER BY o_orderstatus ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE)"
                " / CAST(sum(n) OVER () AS DOUBLE) AS hi FROM (SELECT o_orderstatus, count(*) AS n FROM orders "
                "GROUP BY o_orderstatus)")
    shares_p = shares_s.replace("o_orderstatus", "o_orderpriority")
    return f"""WITH b AS (SELECT min(o_totalprice) AS mn, max(o_totalprice) AS mx FROM orders),
ss AS ({shares_s}), sp AS ({shares_p}),
fk AS (SELECT o.o_orderkey AS row_id, ss.cat AS o_orderstatus, sp.cat AS o_orderpriority,
              (({sql_uniform('fprice', 'o.o_orderkey')} * 2.0 - 1.0) - -1.0) / 2.0
              * (CASE WHEN b.mx - b.mn = 0 THEN 1.0 ELSE b.mx - b.mn END) + b.mn AS o_totalprice
       FROM orders o CROSS JOIN b
       LEFT JOIN ss ON {sql_uniform('fs', 'o.o_orderkey')} >= ss.lo AND {sql_uniform('fs', 'o.o_orderkey')} < ss.hi
       LEFT JOIN sp ON {sql_uniform('fp', 'o.o_orderkey')} >= sp.lo AND {sql_uniform('fp', 'o.o_orderkey')} < sp.hi),
ms AS (SELECT 'r' AS side, o_orderkey AS row_id, {_scaled_sql('o_totalprice', 'mn', 'mx', 0.0, 1.0)} AS o_totalprice,
              {dums('o_orderstatus', STATUS, 'orders')}, {dums('o_orderpriority', PRIOS, 'orders')} FROM orders, b
       UNION ALL
       SELECT 'f', row_id, {_scaled_sql('fk.o_totalprice', 'mn', 'mx', 0.0, 1.0)},
              {dums('o_orderstatus', STATUS, 'fk')}, {dums('o_orderpriority', PRIOS, 'fk')} FROM fk, b),
r AS (SELECT * FROM ms WHERE side = 'r'), f AS (SELECT * FROM ms WHERE side = 'f'),
p AS (SELECT a.row_id, {l1} AS d FROM r a, r b),
k AS (SELECT row_id, d, row_number() OVER (PARTITION BY row_id ORDER BY d) AS rn FROM p),
rad AS (SELECT row_id, d AS radius FROM k WHERE rn = 6),
nn AS (SELECT a.row_id, min({l1}) AS dmin FROM r a, f b GROUP BY a.row_id)
SELECT round(avg(CASE WHEN dmin < radius THEN 1.0 ELSE 0.0 END), 6) AS coverage FROM rad JOIN nn USING (row_id)"""


query("orders_coverage_marginal", sql=_flag_sql(), headline=True)(flagship)
