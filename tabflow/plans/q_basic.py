"""Queries for sources, cleaning, encoding and the forward process (A, B, C, D).

Every query reads the supplied tables at ``sf_dir``; each has a DuckDB twin in
``sql=``.  Doubles are rounded to 6 decimals on both sides.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.noise import hash_normal, hash_uniform, sql_normal, sql_uniform
from ..operators import clean, encode, forward, project
from ..session import scratch_path
from ..sources import readers
from ..sources.registry import load_dataset, table
from .registry import query, r6

# ---- fixed values of the supplied tables (used only in oracle SQL text) -----
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
NATIONS = list(range(25))
PART_TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]


def _scaled_sql(col: str, mn: str, mx: str, lo: float = -1.0, hi: float = 1.0) -> str:
    rng = f"(CASE WHEN {mx} - {mn} = 0 THEN 1.0 ELSE {mx} - {mn} END)"
    return f"(({col} - {mn}) / {rng} * {hi - lo!r} + {lo!r})"


# ============================ A: sources ======================================

@query("load_dataset", sql="""
SELECT CAST(o_orderkey AS BIGINT) AS row_id, o_totalprice, o_orderpriority,
       CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS o_orderdate_days,
       o_orderstatus
FROM orders""")
def q_load_dataset(spark, sf):
    df, _ = load_dataset(spark, sf, "orders")
    return df


CUSTOMER_SCHEMA = "c_custkey long, c_nationkey int, c_acctbal double, c_mktsegment string"


@query("scan_csv", sql="SELECT c_custkey, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def q_scan_csv(spark, sf):
    src = table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    path = scratch_path(spark, "scan_csv")
    src.write.option("header", "true").csv(path)
    return readers.read_csv(spark, path, CUSTOMER_SCHEMA, header=True)


@query("scan_csv_semicolon", sql="SELECT p_partkey, p_size, p_retailprice, p_brand FROM part")
def q_scan_csv_semicolon(spark, sf):
    src = table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice", "p_brand")
    path = scratch_path(spark, "scan_semicolon")
    src.write.option("sep", ";").csv(path)
    return readers.read_csv(spark, path, "p_partkey long, p_size int, p_retailprice double, p_brand string",
                            header=False, sep=";")


@query("scan_whitespace", sql="SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def q_scan_whitespace(spark, sf):
    o = table(spark, sf, "orders")
    gap1 = F.expr("repeat(' ', 1 + int(o_orderkey % 3))")
    gap2 = F.expr("repeat(' ', 1 + int(o_custkey % 2))")
    line = F.concat(F.lit("  "), F.col("o_orderkey").cast("string"), gap1,
                    F.col("o_custkey").cast("string"), gap2, F.col("o_totalprice").cast("string"), F.lit(" "))
    path = scratch_path(spark, "scan_ws")
    o.select(line.alias("value")).write.text(path)
    from pyspark.sql.types import DoubleType, LongType, StructField, StructType
    schema = StructType([StructField("o_orderkey", LongType()), StructField("o_custkey", LongType()),
                         StructField("o_totalprice", DoubleType())])
    return readers.read_whitespace(spark, path, schema)


@query("scan_zip", sql="SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def q_scan_zip(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    path = scratch_path(spark, "scan_zip")
    readers.write_zip_csv(o.repartition(4, "o_orderkey"), path).count()
    lines = readers.read_zip_lines(spark, f"{path}/*.zip", member="data.csv", skip_header=True)
    from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType
    schema = StructType([StructField("o_orderkey", LongType()), StructField("o_orderstatus", StringType()),
                         StructField("o_totalprice", DoubleType())])
    return readers.parse_delimited(lines, schema, ",")


@query("scan_gzip", sql="SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice FROM lineitem")
def q_scan_gzip(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    path = scratch_path(spark, "scan_gzip")
    li.write.option("header", "true").option("compression", "gzip").csv(path)
    # gzip is one split per file: parallelism comes from the number of files
    return readers.read_csv(spark, f"{path}/*.csv.gz",
                            "l_orderkey long, l_linenumber int, l_quantity double, l_extendedprice double",
                            header=True)


@query("project_drop_columns",
       sql="SELECT o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders")
def q_project_drop_columns(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
                                          "o_orderdate", "o_orderpriority")
    return project.project_drop_columns(o, [0, "o_orderdate"])


@query("factorize_first_seen", sql="""
WITH f AS (SELECT o_orderpriority, min(o_orderkey) AS first_key FROM orders
           WHERE o_orderpriority IS NOT NULL GROUP BY o_orderpriority),
d AS (SELECT o_orderpriority,
             CAST(row_number() OVER (ORDER BY first_key, o_orderpriority) - 1 AS BIGINT) AS o_orderpriority_code
      FROM f)
SELECT o.o_orderkey, COALESCE(d.o_orderpriority_code, -1) AS o_orderpriority_code
FROM orders o LEFT JOIN d ON o.o_orderpriority = d.o_orderpriority""")
def q_factorize_first_seen(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return encode.factorize_first_seen(o, "o_orderpriority", "o_orderkey").select(
        "o_orderkey", "o_orderpriority_code")


@query("label_encode_sorted", sql="""
WITH d AS (SELECT o_orderpriority,
                  CAST(dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS BIGINT) AS o_orderpriority_code
           FROM (SELECT DISTINCT o_orderpriority FROM orders WHERE o_orderpriority IS NOT NULL))
SELECT o.o_orderkey, d.o_orderpriority_code FROM orders o LEFT JOIN d ON o.o_orderpriority = d.o_orderpriority""")
def q_label_encode_sorted(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return encode.label_encode_sorted(o, "o_orderpriority").select("o_orderkey", "o_orderpriority_code")


@query("label_shift", sql="""
SELECT p_partkey,
       CAST(CASE WHEN p_size - 1 >= 4 THEN p_size - 2 ELSE p_size - 1 END AS BIGINT) AS p_size_code
FROM part""")
def q_label_shift(spark, sf):
    p = table(spark, sf, "part")
    return p.select("p_partkey", encode.label_shift("p_size", gap_from=4).cast("long").alias("p_size_code"))


@query("cast_numeric", sql="""
SELECT o_orderkey, TRY_CAST(split_part(o_orderpriority, '-', 1) AS DOUBLE) AS priority_num,
       TRY_CAST(o_orderstatus AS DOUBLE) AS status_num
FROM orders""")
def q_cast_numeric(spark, sf):
    o = table(spark, sf, "orders")
    return o.select("o_orderkey",
                    F.split("o_orderpriority", "-").getItem(0).try_cast("double").alias("priority_num"),
                    F.col("o_orderstatus").try_cast("double").alias("status_num"))


@query("validate_category_codes", sql="""
WITH t AS (SELECT p_size - 1 AS size0, p_size AS size1, p_size // 2 AS half FROM part),
s AS (
  SELECT 'size0' AS column_name, min(size0) AS mn, max(size0) AS mx, count(DISTINCT size0) AS nd FROM t
  UNION ALL SELECT 'size1', min(size1), max(size1), count(DISTINCT size1) FROM t
  UNION ALL SELECT 'half', min(half), max(half), count(DISTINCT half) FROM t)
SELECT column_name, CAST(mn AS BIGINT) AS min_code, CAST(mx AS BIGINT) AS max_code,
       CAST(nd AS BIGINT) AS n_codes, CAST(mn = 0 AND nd = mx + 1 AS BIGINT) AS valid
FROM s""")
def q_validate_category_codes(spark, sf):
    p = table(spark, sf, "part").select((F.col("p_size") - 1).alias("size0"), F.col("p_size").alias("size1"),
                                        F.floor(F.col("p_size") / 2).cast("long").alias("half"))
    v = encode.validate_category_codes(p, ["size0", "size1", "half"])
    return v.select(F.col("column").alias("column_name"), "min_code", "max_code", "n_codes",
                    F.col("valid").cast("long").alias("valid"))


# ============================ B: cleaning =====================================

def customer_blanked(spark, sf):
    """Customer with 10% of each cell blanked by hash (fixture (g))."""
    c = table(spark, sf, "customer")

    def blank(col, typ):
        return F.when(hash_uniform(f"blank-{col}", F.col("c_custkey")) < 0.1,
                      F.lit(None).cast(typ)).otherwise(F.col(col)).alias(col)
    return c.select("c_custkey", blank("c_acctbal", "double"), blank("c_mktsegment", "string"),
                    blank("c_nationkey", "int"))


def _blank_sql(col):
    return f"CASE WHEN {sql_uniform('blank-' + col, 'c_custkey')} < 0.1 THEN NULL ELSE {col} END AS {col}"


CB_SQL = (f"WITH cb AS (SELECT c_custkey, {_blank_sql('c_acctbal')}, {_blank_sql('c_mktsegment')}, "
          f"{_blank_sql('c_nationkey')} FROM customer)\n")


@query("drop_rows_any_missing", sql=CB_SQL + """SELECT * FROM cb
WHERE c_acctbal IS NOT NULL AND c_mktsegment IS NOT NULL AND c_nationkey IS NOT NULL""")
def q_drop_any(spark, sf):
    return clean.drop_rows_any_missing(customer_blanked(spark, sf), ["c_acctbal", "c_mktsegment", "c_nationkey"])


@query("drop_rows_all_missing", sql=CB_SQL + """SELECT * FROM cb
WHERE NOT (c_acctbal IS NULL AND c_mktsegment IS NULL AND c_nationkey IS NULL)""")
def q_drop_all(spark, sf):
    return clean.drop_rows_all_missing(customer_blanked(spark, sf), ["c_acctbal", "c_mktsegment", "c_nationkey"])


@query("drop_missing_target", sql=CB_SQL + "SELECT * FROM cb WHERE c_acctbal IS NOT NULL")
def q_drop_target(spark, sf):
    return clean.drop_missing_target(customer_blanked(spark, sf), "c_acctbal")


@query("assert_label_present", sql=CB_SQL + """
SELECT CAST(count(*) FILTER (WHERE c_mktsegment IS NULL) AS BIGINT) AS n_missing_label,
       CAST(count(*) AS BIGINT) AS n_rows FROM cb""")
def q_assert_label(spark, sf):
    return clean.missing_label_count(customer_blanked(spark, sf), "c_mktsegment")


@query("label_mask", sql="""
SELECT o_orderstatus, CAST(count(*) AS BIGINT) AS n, round(avg(o_totalprice), 6) AS mean_price
FROM orders GROUP BY o_orderstatus""")
def q_label_mask(spark, sf):
    o = table(spark, sf, "orders")
    return o.groupBy("o_orderstatus").agg(F.count(F.lit(1)).cast("long").alias("n"),
                                          r6(F.avg("o_totalprice")).alias("mean_price"))


@query("append_target", sql="""
SELECT CAST(c_custkey AS BIGINT) AS row_id, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_mktsegment, c_acctbal
FROM customer""")
def q_append_target(spark, sf):
    df, spec = load_dataset(spark, sf, "customer")
    spec = spec.with_roles(c_acctbal="target", c_mktsegment="feature")
    return project.append_target(df, spec)


def _orders_scaled(spark, sf):
    df, _ = load_dataset(spark, sf, "orders")
    b = encode.data_bounds(df, ["o_totalprice", "o_orderdate_days"])
    return df.select("row_id",
                     encode.scale_expr("o_totalprice", *b["o_totalprice"]).alias("x0"),
                     encode.scale_expr(F.col("o_orderdate_days").cast("double"), *b["o_orderdate_days"]).alias("x1"))


ORD_SCALED_SQL = f"""WITH o AS (SELECT o_orderkey AS row_id, o_custkey, o_totalprice,
    CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS DOUBLE) AS d FROM orders),
b AS (SELECT min(o_totalprice) AS mn0, max(o_totalprice) AS mx0, min(d) AS mn1, max(d) AS mx1 FROM o),
s AS (SELECT row_id, o_custkey, {_scaled_sql('o_totalprice', 'mn0', 'mx0')} AS x0,
             {_scaled_sql('d', 'mn1', 'mx1')} AS x1 FROM o, b)
"""

N_T_SMALL, K_SMALL, SEED = 5, 2, 7
T_SQL = f"(0.001 + CAST(level AS DOUBLE) * {(1.0 - 1e-3) / (N_T_SMALL - 1)!r})"


@query("condition_matrix", sql=ORD_SCALED_SQL + f"""
, e AS (SELECT row_id, dup, x0, x1, {sql_normal('x0', SEED, 'row_id', 'dup', 1)} AS z1
        FROM s CROSS JOIN range({K_SMALL}) AS r(dup))
SELECT row_id, CAST(dup AS BIGINT) AS dup,
       round(t * x1 + (1.0 - t) * z1, 6) AS in_0, round(x0, 6) AS in_1
FROM (SELECT *, (0.001 + CAST(2 AS DOUBLE) * {(1.0 - 1e-3) / (N_T_SMALL - 1)!r}) AS t FROM e)""")
def q_condition_matrix(spark, sf):
    s = _orders_scaled(spark, sf)
    d = forward.duplicate_rows(s, K_SMALL)
    z1 = forward.x0_noise(SEED, F.col("row_id"), F.col("dup"), 1)
    t = forward.level_time(F.lit(2), N_T_SMALL)
    xt = t * F.col("x1") + (F.lit(1.0) - t) * z1
    m = project.condition_inputs(xt, [F.col("x0")])
    return d.select("row_id", F.col("dup").cast("long").alias("dup"),
                    r6(F.element_at(m, 1)).alias("in_0"), r6(F.element_at(m, 2)).alias("in_1"))


@query("attach_covariates", sql=ORD_SCALED_SQL + f"""
, e AS (SELECT row_id, o_custkey, dup, x0, x1,
               {sql_normal('x0', SEED, 'row_id', 'dup', 0)} AS z0,
               {sql_normal('x0', SEED, 'row_id', 'dup', 1)} AS z1
        FROM s CROSS JOIN range({K_SMALL}) AS r(dup))
SELECT row_id, CAST(dup AS BIGINT) AS dup, round(t * x0 + (1.0 - t) * z0, 6) AS xt_0,
       round(t * x1 + (1.0 - t) * z1, 6) AS xt_1, CAST(o_custkey AS DOUBLE) AS cov_0
FROM (SELECT *, (0.001 + CAST(3 AS DOUBLE) * {(1.0 - 1e-3) / (N_T_SMALL - 1)!r}) AS t FROM e)""")
def q_attach_covariates(spark, sf):
    s = _orders_scaled(spark, sf).join(
        table(spark, sf, "orders").select(F.col("o_orderkey").alias("row_id"), "o_custkey"), "row_id")
    d = forward.duplicate_rows(s, K_SMALL)
    t = forward.level_time(F.lit(3), N_T_SMALL)
    xts = [t * F.col(f"x{j}") + (F.lit(1.0) - t) * forward.x0_noise(SEED, F.col("row_id"), F.col("dup"), j)
           for j in range(2)]
    return d.select("row_id", F.col("dup").cast("long").alias("dup"), r6(xts[0]).alias("xt_0"),
                    r6(xts[1]).alias("xt_1"), F.col("o_custkey").cast("double").alias("cov_0"))


# ============================ C: scaling / coding =============================

@query("minmax_scale", sql=f"""
WITH b AS (SELECT min(p_size) AS mn0, max(p_size) AS mx0, min(p_retailprice) AS mn1, max(p_retailprice) AS mx1
           FROM part)
SELECT p_partkey, round({_scaled_sql('CAST(p_size AS DOUBLE)', 'mn0', 'mx0')}, 6) AS p_size_s,
       round({_scaled_sql('p_retailprice', 'mn1', 'mx1')}, 6) AS p_retailprice_s,
       round({_scaled_sql('7.0', '7.0', '7.0')}, 6) AS const_s
FROM part, b""")
def q_minmax_scale(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"),
                                        "p_retailprice", F.lit(7.0).alias("const"))
    b = encode.data_bounds(p, ["p_size", "p_retailprice", "const"])
    s = encode.minmax_scale(p, b)
    return s.select("p_partkey", r6("p_size").alias("p_size_s"), r6("p_retailprice").alias("p_retailprice_s"),
                    r6("const").alias("const_s"))


def _unscaled_sql(z, mn, mx):
    rng = f"(CASE WHEN {mx} - {mn} = 0 THEN 1.0 ELSE {mx} - {mn} END)"
    return f"(({z} - -1.0) / 2.0 * {rng} + {mn})"


@query("minmax_unscale", sql=f"""
WITH b AS (SELECT min(p_size) AS mn0, max(p_size) AS mx0, min(p_retailprice) AS mn1, max(p_retailprice) AS mx1
           FROM part),
z AS (SELECT p_partkey, {sql_uniform('z0', 'p_partkey')} * 2.0 - 1.0 AS z0,
             {sql_uniform('z1', 'p_partkey')} * 2.0 - 1.0 AS z1 FROM part)
SELECT p_partkey, round({_unscaled_sql('z0', 'mn0', 'mx0')}, 6) AS p_size_u,
       round({_unscaled_sql('z1', 'mn1', 'mx1')}, 6) AS p_retailprice_u
FROM z, b""")
def q_minmax_unscale(spark, sf):
    p = table(spark, sf, "part")
    b = encode.data_bounds(p.select(F.col("p_size").cast("double").alias("p_size"), "p_retailprice"),
                           ["p_size", "p_retailprice"])
    z0 = hash_uniform("z0", F.col("p_partkey")) * 2.0 - 1.0
    z1 = hash_uniform("z1", F.col("p_partkey")) * 2.0 - 1.0
    return p.select("p_partkey", r6(encode.unscale_expr(z0, *b["p_size"])).alias("p_size_u"),
                    r6(encode.unscale_expr(z1, *b["p_retailprice"])).alias("p_retailprice_u"))


@query("data_bounds", sql="""
SELECT 'c_acctbal' AS column_name, min(c_acctbal) AS min_value, max(c_acctbal) AS max_value FROM customer
UNION ALL SELECT 'c_nationkey', CAST(min(c_nationkey) AS DOUBLE), CAST(max(c_nationkey) AS DOUBLE) FROM customer
UNION ALL SELECT 'c_custkey', CAST(min(c_custkey) AS DOUBLE), CAST(max(c_custkey) AS DOUBLE) FROM customer""")
def q_data_bounds(spark, sf):
    c = table(spark, sf, "customer")
    return encode.bounds_frame(c, ["c_acctbal", "c_nationkey", "c_custkey"]).withColumnRenamed(
        "column", "column_name")


def _dummies_sql(col, values, value=1.0, quote=True):
    out = []
    for v in values:
        lit = f"'{v}'" if quote else str(v)
        out.append(f"CASE WHEN {col} = {lit} THEN {value!r} ELSE 0.0 END AS {col}_{v}")
    return ", ".join(out)


@query("onehot_drop_first", sql=f"""
SELECT c_custkey, c_acctbal, {_dummies_sql('c_mktsegment', SEGMENTS[1:])},
       {_dummies_sql('c_nationkey', NATIONS[1:], quote=False)}
FROM customer""")
def q_onehot_drop_first(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_nationkey", "c_acctbal")
    dicts = {k: encode.category_values(c, k) for k in ("c_mktsegment", "c_nationkey")}
    return encode.onehot(c, dicts, drop_first=True)


@query("onehot_full_halved", sql=f"""
SELECT c_custkey, CASE WHEN {sql_uniform('split', 'c_custkey')} < 0.5 THEN 'real' ELSE 'fake' END AS side,
       {_dummies_sql('c_mktsegment', SEGMENTS, 0.5)}, {_dummies_sql('c_nationkey', NATIONS, 0.5, quote=False)}
FROM customer""")
def q_onehot_full_halved(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    u = hash_uniform("split", F.col("c_custkey"))
    real = c.filter(u < 0.5).withColumn("side", F.lit("real"))
    fake = c.filter(u >= 0.5).withColumn("side", F.lit("fake"))
    both = real.unionByName(fake)
    dicts = {k: encode.category_values(both, k) for k in ("c_mktsegment", "c_nationkey")}
    return encode.onehot(both, dicts, drop_first=False, value=0.5)


@query("onehot_full", sql=f"""
SELECT p_partkey, {_dummies_sql('p_type', PART_TYPES)} FROM part""")
def q_onehot_full(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_type")
    return encode.onehot(p, {"p_type": encode.category_values(p, "p_type")}, drop_first=False)


def _decode_inputs(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    vals = encode.category_values(c, "c_mktsegment")
    names = [encode.dummy_name("c_mktsegment", v) for v in vals[1:]]
    d = c.select("c_custkey", *[hash_uniform("dec", F.col("c_custkey"), j).alias(n)
                                for j, n in enumerate(names, start=1)])
    return d, vals


@query("onehot_decode", sql=f"""
WITH d AS (SELECT c_custkey, [0.5, {', '.join(sql_uniform('dec', 'c_custkey', j) for j in range(1, 5))}] AS a
           FROM customer)
SELECT c_custkey, {SEGMENTS!r}[list_position(a, list_max(a))] AS c_mktsegment FROM d""")
def q_onehot_decode(spark, sf):
    d, vals = _decode_inputs(spark, sf)
    return encode.onehot_decode(d, {"c_mktsegment": vals}, ["c_custkey", "c_mktsegment"])


@query("metric_space", sql=f"""
WITH c AS (SELECT c_custkey, c_acctbal, c_mktsegment,
                  CASE WHEN {sql_uniform('split', 'c_custkey')} < 0.5 THEN 'train' ELSE 'test' END AS side
           FROM customer),
b AS (SELECT min(c_acctbal) AS mn, max(c_acctbal) AS mx FROM c WHERE side = 'train')
SELECT c_custkey, side, round({_scaled_sql('c_acctbal', 'mn', 'mx', 0.0, 1.0)}, 6) AS c_acctbal,
       {_dummies_sql('c_mktsegment', SEGMENTS, 0.5)}
FROM c, b""")
def q_metric_space(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    u = hash_uniform("split", F.col("c_custkey"))
    tr, te, _, _ = encode.metric_space(c.filter(u < 0.5), c.filter(u >= 0.5), ["c_acctbal"], ["c_mktsegment"])
    out = tr.withColumn("side", F.lit("train")).unionByName(te.withColumn("side", F.lit("test")))
    return out.withColumn("c_acctbal", r6("c_acctbal"))


@query("round_integers", sql="""
SELECT p_partkey, CAST(round_even(p_retailprice, 0) AS DOUBLE) AS p_retailprice_r,
       CAST(round_even(p_retailprice / 4.0, 0) AS DOUBLE) AS quarter_r
FROM part""")
def q_round_integers(spark, sf):
    p = table(spark, sf, "part")
    return p.select("p_partkey", encode.round_half_even("p_retailprice").alias("p_retailprice_r"),
                    encode.round_half_even(F.col("p_retailprice") / 4.0).alias("quarter_r"))


@query("clip_to_bounds", sql=CB_SQL + f"""
, b AS (SELECT min(c_acctbal) AS mn, max(c_acctbal) AS mx FROM customer),
v AS (SELECT cb.c_custkey, cb.c_acctbal + 3000.0 * {sql_normal('clip', 'cb.c_custkey')} AS v FROM cb)
SELECT c_custkey, round(CASE WHEN v IS NOT NULL THEN greatest(least(v, mx), mn) END, 6) AS c_acctbal_c
FROM v, b""")
def q_clip_to_bounds(spark, sf):
    cb = customer_blanked(spark, sf)
    b = encode.data_bounds(table(spark, sf, "customer"), ["c_acctbal"])["c_acctbal"]
    v = F.col("c_acctbal") + F.lit(3000.0) * hash_normal("clip", F.col("c_custkey"))
    return cb.select("c_custkey", r6(encode.clip_expr(v, *b)).alias("c_acctbal_c"))


# ============================ D: forward process ==============================

CUST_SCALED_SQL = f"""WITH b AS (SELECT min(c_acctbal) AS mn0, max(c_acctbal) AS mx0,
                  CAST(min(c_nationkey) AS DOUBLE) AS mn1, CAST(max(c_nationkey) AS DOUBLE) AS mx1 FROM customer),
s AS (SELECT c_custkey, {_scaled_sql('c_acctbal', 'mn0', 'mx0')} AS x0,
             {_scaled_sql('CAST(c_nationkey AS DOUBLE)', 'mn1', 'mx1')} AS x1 FROM customer, b)
"""


def _customer_scaled(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_acctbal",
                                            F.col("c_nationkey").cast("double").alias("c_nationkey"))
    b = encode.data_bounds(c, ["c_acctbal", "c_nationkey"])
    return c.select("c_custkey", encode.scale_expr("c_acctbal", *b["c_acctbal"]).alias("x0"),
                    encode.scale_expr("c_nationkey", *b["c_nationkey"]).alias("x1"))


@query("noise_levels", sql=f"""
SELECT c_custkey, CAST(level AS BIGINT) AS level, round({T_SQL}, 6) AS t
FROM customer CROSS JOIN range({N_T_SMALL}) AS r(level)""")
def q_noise_levels(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey")
    d = forward.noise_levels(c, N_T_SMALL)
    return d.select("c_custkey", F.col("level").cast("long").alias("level"), r6("t").alias("t"))


@query("duplicate_rows", sql="""
SELECT c_custkey, CAST(dup AS BIGINT) AS dup FROM customer CROSS JOIN range(3) AS r(dup)""")
def q_duplicate_rows(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey")
    return forward.duplicate_rows(c, 3).select("c_custkey", F.col("dup").cast("long").alias("dup"))


@query("gaussian_noise", sql=f"""
SELECT c_custkey, CAST(dup AS BIGINT) AS dup, CAST(feature AS BIGINT) AS feature,
       round({sql_normal('x0', SEED, 'c_custkey', 'dup', 'feature')}, 6) AS z
FROM customer CROSS JOIN range(3) AS r(dup) CROSS JOIN range(2) AS f(feature)""")
def q_gaussian_noise(spark, sf):
    c = table(spark, sf, "customer")
    g = forward.gaussian_noise(c, "c_custkey", ["c_acctbal", "c_nationkey"], 3, SEED)
    return g.select("c_custkey", F.col("dup").cast("long").alias("dup"),
                    F.col("feature").cast("long").alias("feature"), r6("z").alias("z"))


@query("interpolate_path", sql=CUST_SCALED_SQL + f"""
, e AS (SELECT c_custkey, dup, feature, CASE WHEN feature = 0 THEN x0 ELSE x1 END AS x1v,
               {sql_normal('x0', SEED, 'c_custkey', 'dup', 'feature')} AS z
        FROM s CROSS JOIN range(3) AS r(dup) CROSS JOIN range(2) AS f(feature))
SELECT c_custkey, CAST(dup AS BIGINT) AS dup, CAST(level AS BIGINT) AS level, CAST(feature AS BIGINT) AS feature,
       round({T_SQL}, 6) AS t, round({T_SQL} * x1v + (1.0 - {T_SQL}) * z, 6) AS xt, round(x1v - z, 6) AS ut
FROM e CROSS JOIN range({N_T_SMALL}) AS l(level)""")
def q_interpolate_path(spark, sf):
    s = _customer_scaled(spark, sf)
    p = forward.interpolate_path(s, "c_custkey", ["x0", "x1"], 3, N_T_SMALL, SEED)
    return p.select("c_custkey", F.col("dup").cast("long").alias("dup"), F.col("level").cast("long").alias("level"),
                    F.col("feature").cast("long").alias("feature"), r6("t").alias("t"), r6("xt").alias("xt"),
                    r6("ut").alias("ut"))


@query("interpolate_at_t", sql=CUST_SCALED_SQL + f"""
, e AS (SELECT c_custkey, feature, CASE WHEN feature = 0 THEN x0 ELSE x1 END AS x1v,
               {sql_normal('x0', SEED, 'c_custkey', 0, 'feature', 1)} AS z
        FROM s CROSS JOIN range(2) AS f(feature)),
tt AS (SELECT (0.001 + CAST(2 AS DOUBLE) * {(1.0 - 1e-3) / (N_T_SMALL - 1)!r}) AS t)
SELECT c_custkey, CAST(feature AS BIGINT) AS feature, round(t * x1v + (1.0 - t) * z, 6) AS xt,
       round(x1v - z, 6) AS ut
FROM e, tt""")
def q_interpolate_at_t(spark, sf):
    s = _customer_scaled(spark, sf)
    p = forward.interpolate_at_t(s, "c_custkey", ["x0", "x1"], 2, N_T_SMALL, SEED, epoch=1)
    return p.select("c_custkey", F.col("feature").cast("long").alias("feature"), r6("xt").alias("xt"),
                    r6("ut").alias("ut"))


@query("minibatch_expand", sql=CUST_SCALED_SQL + f"""
, e AS (SELECT c_custkey, CAST(floor({sql_uniform('slice', SEED, 'c_custkey')} * 3) AS BIGINT) AS slice,
               epoch, feature, CASE WHEN feature = 0 THEN x0 ELSE x1 END AS x1v,
               {sql_normal('x0-mb', SEED, 'c_custkey', 'epoch', 'feature')} AS z
        FROM s CROSS JOIN range(2) AS r(epoch) CROSS JOIN range(2) AS f(feature))
SELECT c_custkey, slice, CAST(epoch AS BIGINT) AS epoch, CAST(level AS BIGINT) AS level,
       CAST(feature AS BIGINT) AS feature, round({T_SQL} * x1v + (1.0 - {T_SQL}) * z, 6) AS xt,
       round(x1v - z, 6) AS ut
FROM e CROSS JOIN range({N_T_SMALL}) AS l(level)""")
def q_minibatch_expand(spark, sf):
    s = _customer_scaled(spark, sf)
    p = forward.minibatch_expand(s, "c_custkey", ["x0", "x1"], 3, 2, N_T_SMALL, SEED)
    return p.select("c_custkey", "slice", F.col("epoch").cast("long").alias("epoch"),
                    F.col("level").cast("long").alias("level"), F.col("feature").cast("long").alias("feature"),
                    r6("xt").alias("xt"), r6("ut").alias("ut"))


@query("label_decode_sorted", sql="""
WITH d AS (SELECT o_orderpriority,
                  CAST(dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS BIGINT) AS code
           FROM (SELECT DISTINCT o_orderpriority FROM orders WHERE o_orderpriority IS NOT NULL)),
c AS (SELECT o_orderkey, CAST(floor(({sql}) * 5) AS BIGINT) AS code FROM orders)
SELECT c.o_orderkey, c.code, d.o_orderpriority AS decoded FROM c LEFT JOIN d ON c.code = d.code""".replace(
    "{sql}", sql_uniform("dec-code", "o_orderkey")))
def q_label_decode_sorted(spark, sf):
    """A9 inverse: codes (here hash-drawn) back to category values through the dictionary."""
    o = table(spark, sf, "orders")
    dic = encode.sorted_dictionary(o, "o_orderpriority", "code")
    codes = o.select("o_orderkey", F.floor(hash_uniform("dec-code", F.col("o_orderkey")) * 5).cast("long")
                     .alias("code"))
    out = encode.label_decode(codes, "code", dic.select("o_orderpriority", "code"), "o_orderpriority")
    return out.select("o_orderkey", "code", F.col("o_orderpriority").alias("decoded"))
