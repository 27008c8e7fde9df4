"""Invariants of the boosted-tree flows."""

import pickle

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from datasets import SF_SMALL
from tabflow.functions.noise import hash_uniform
from tabflow.learners.bagging import ForestParams, fit_bagged
from tabflow.learners.flows import Grid, JointExamples, JointFlow, SequentialFlow, level_times
from tabflow.learners.hist_boost import BoostParams, PlainRows, fit_boosted, fit_expanded, packed_examples, predict_margin
from tabflow.sources.registry import load_dataset
from tabflow.spec import ColumnSpec, TableSpec

REG = BoostParams(n_rounds=2, depth=2, eta=0.3)
CLF = BoostParams(n_rounds=2, depth=2, eta=0.1, objective="softmax")
SMALL = dict(n_t=4, K=2, n_bins=16)


def test_single_split_is_best_split(spark):
    rng = np.random.default_rng(0)
    n = 400
    b0, b1 = rng.integers(1, 9, n), rng.integers(1, 5, n)
    y = np.where(b0 > 5, 2.0, -1.0) + 0.3 * (b1 > 2) + rng.normal(0, 0.1, n)
    pdf = pd.DataFrame({"model": 0, "rid": np.arange(n), "bins": [[int(a), int(b)] for a, b in zip(b0, b1)],
                        "nin": 2, "y": y})
    rows = spark.createDataFrame(pdf, "model int, rid long, bins array<int>, nin int, y double")
    forest = fit_boosted(rows, BoostParams(n_rounds=1, depth=1, eta=1.0, lam=0.0), n_inputs=2, n_bins=8)
    best, arg = -1, None
    g = y.mean() - y
    for j, b in ((0, b0), (1, b1)):
        for s in range(1, 9):
            left = b <= s
            if left.all() or (~left).all():
                continue
            gain = g[left].sum() ** 2 / left.sum() + g[~left].sum() ** 2 / (~left).sum() - g.sum() ** 2 / n
            if gain > best + 1e-12:
                best, arg = gain, (j, s)
    assert (int(forest.feat[(0, 0)][0, 0]), int(forest.sbin[(0, 0)][0, 0])) == arg
    # leaf values are the residual means of each side
    left = (b0 if arg[0] == 0 else b1) <= arg[1]
    assert np.isclose(forest.leaf[(0, 0)][0, 0], (y[left] - y.mean()).mean())
    thr = np.tile(np.arange(10, dtype=float), (2, 1))
    X = np.column_stack([b0, b1]).astype(float)
    pred = predict_margin(forest, (0, 0), X, thr)
    assert np.allclose(pred[left], y[left].mean()) and np.allclose(pred[~left], y[~left].mean())


@pytest.fixture(scope="module")
def orders(spark):
    return load_dataset(spark, SF_SMALL, "orders")


def _check_sample(out, df, spec, n):
    pdf = out.toPandas()
    assert len(pdf) == n
    assert list(out.columns) == ["row_id", *[c.name for c in spec.generated], spec.label.name]
    src = df.toPandas()
    for c in spec.generated:
        if c.kind == "categorical":
            assert set(pdf[c.name]) <= set(src[c.name])
        else:
            assert pdf[c.name].min() >= src[c.name].min() - 1e-9
            assert pdf[c.name].max() <= src[c.name].max() + 1e-9
        if c.kind == "integer":
            assert (pdf[c.name] == np.round(pdf[c.name])).all()
    assert set(pdf[spec.label.name]) <= set(src[spec.label.name])
    return pdf


@pytest.mark.parametrize("model_type", ["HS3F", "CS3F"])
def test_sequential_invariants(spark, orders, model_type):
    df, spec = orders
    fit = SequentialFlow(model_type=model_type, reg=REG, clf=CLF, **SMALL).fit(df, spec)
    a = _check_sample(fit.sample(300, seed=4, partitions=2), df, spec, 300)
    b = fit.sample(300, seed=4, partitions=5).toPandas()
    pd.testing.assert_frame_equal(a.sort_values("row_id").reset_index(drop=True),
                                  b.sort_values("row_id").reset_index(drop=True))
    _check_sample(fit.sample(300, seed=4, solver="rk4"), df, spec, 300)


def test_euler_equals_rk4_when_all_categorical(spark):
    li = load_dataset(spark, SF_SMALL, "lineitem_flags")[0].withColumn(
        "row_id", F.monotonically_increasing_id())
    spec = TableSpec.of(ColumnSpec("l_returnflag", "categorical"), ColumnSpec("l_linestatus", "categorical"),
                        ColumnSpec("l_linenumber", "categorical"))
    fit = SequentialFlow(model_type="HS3F", reg=REG, clf=CLF, label_cond=False, **SMALL).fit(li, spec)
    e = fit.sample(200, seed=2, solver="euler").toPandas().sort_values("row_id").reset_index(drop=True)
    r = fit.sample(200, seed=2, solver="rk4").toPandas().sort_values("row_id").reset_index(drop=True)
    pd.testing.assert_frame_equal(e, r)


def test_hs3f_equals_cs3f_without_categorical_columns(spark):
    emb = load_dataset(spark, SF_SMALL, "embeddings")[0].select("row_id", "e0", "e1", "label")
    spec = TableSpec.of(ColumnSpec("e0"), ColumnSpec("e1"), ColumnSpec("label", "categorical", "label"))
    h = SequentialFlow(model_type="HS3F", reg=REG, clf=CLF, **SMALL).fit(emb, spec)
    c = SequentialFlow(model_type="CS3F", reg=REG, clf=CLF, **SMALL).fit(emb, spec)
    a = h.sample(150, seed=1).toPandas().sort_values("row_id").reset_index(drop=True)
    b = c.sample(150, seed=1).toPandas().sort_values("row_id").reset_index(drop=True)
    pd.testing.assert_frame_equal(a, b)


def test_joint_sample_and_imputation_keeps_known_cells(spark, orders):
    df, spec = orders
    fit = JointFlow(reg=REG, **SMALL).fit(df, spec)
    _check_sample(fit.sample(200, seed=3), df, spec, 200)
    blank = df.withColumn("o_totalprice", F.when(hash_uniform("t", F.col("row_id")) < 0.2, F.lit(None))
                          .otherwise(F.col("o_totalprice")))
    imp = fit.impute(blank, seed=1).toPandas().set_index("row_id").sort_index()
    src = blank.toPandas().set_index("row_id").sort_index()
    assert imp["o_totalprice"].notna().all()
    known = src["o_totalprice"].notna()
    assert np.allclose(imp.loc[known, "o_totalprice"], src.loc[known, "o_totalprice"])
    assert (imp["o_orderpriority"] == src["o_orderpriority"]).all()


def test_random_forest_flow_generates_valid_rows(spark, orders):
    from tabflow.learners.mllib import RandomForestSampler
    df, spec = orders
    rf = RandomForestSampler(n_t=3, K=1, num_trees=3, max_depth=3).fit(df, spec)
    _check_sample(rf.sample(120, seed=2), df, spec, 120)


def test_quality_floor_beats_uniform_sampler(spark):
    """Sum of marginal W1 (metric space) of the flow's rows is below that of
    an independent-uniform sampler (SURVEY section 5, quality floor), on a
    table whose marginals are far from uniform."""
    from tabflow.functions.noise import hash_uniform as hu
    from tabflow.metrics import transport
    from tabflow.operators import encode
    from tabflow.sources.registry import table
    li = table(spark, SF_SMALL, "lineitem").select(
        F.monotonically_increasing_id().alias("row_id"), "l_extendedprice",
        F.col("l_quantity").cast("double").alias("l_quantity"), "l_returnflag", "l_linestatus")
    li = li.cache()
    spec = TableSpec.of(ColumnSpec("l_extendedprice"), ColumnSpec("l_quantity", "integer"),
                        ColumnSpec("l_returnflag", "categorical"),
                        ColumnSpec("l_linestatus", "categorical", "label"))
    fit = SequentialFlow(model_type="HS3F", reg=BoostParams(n_rounds=4, depth=3), clf=CLF, **SMALL).fit(li, spec)
    n = li.count()
    fake = fit.sample(n, seed=7)
    cont, cats = ["l_extendedprice", "l_quantity"], ["l_returnflag", "l_linestatus"]
    b = encode.data_bounds(li, cont)
    uni = spark.range(n).select(F.col("id").alias("row_id"), *[
        encode.unscale_expr(hu(f"u{i}", F.col("id")) * 2 - 1, *b[c]).alias(c) for i, c in enumerate(cont)], *[
        F.element_at(F.array(*[F.lit(v) for v in encode.category_values(li, c)]),
                     (F.floor(hu(f"c{i}", F.col("id")) * len(encode.category_values(li, c))) + 1).cast("int"))
        .alias(c) for i, c in enumerate(cats)])
    real = li.select("row_id", *cont, *cats)

    def w(other):
        r, o, _, _ = encode.metric_space(real, other.select("row_id", *cont, *cats), cont, cats)
        cols = [c for c in r.columns if c != "row_id"]
        return transport.wasserstein1_lower(r, o, cols).first()[0]
    assert w(fake) < w(uni)


@pytest.mark.parametrize("bagged", [False, True])
def test_examples_are_made_once_per_fit(spark, tmp_path, bagged):
    rows = spark.createDataFrame([(0, i, [i % 7 + 1, i % 3 + 1], 2, float(i % 5), 1.0) for i in range(200)],
                                 "model long, row_id long, bins array<int>, nin int, y double, w double").coalesce(1)
    made = str(tmp_path / "made")

    class Counted(PlainRows):       # a line for every time examples are made
        def blocks(self, pdf):
            with open(made, "a") as f:
                f.write("x\n")
            yield from PlainRows.blocks(self, pdf)

    if bagged:
        fit_bagged(rows, Counted(2), ForestParams(n_trees=4, depth=3, trees_per_pass=2), 8)
    else:
        fit_expanded(rows, Counted(2), BoostParams(n_rounds=3, depth=3), 8)
    assert len(open(made).read().split()) <= 2       # the examples of one row for the size of a chunk, then all of them


def test_chunks_keep_shared_arrays_once_and_bins_in_bytes(spark):
    rng = np.random.default_rng(3)
    rows = [(i, i % 2, float(rng.uniform(-1, 1)), rng.normal(size=4).tolist(), []) for i in range(300)]
    df = spark.createDataFrame(rows, "row_id long, lab int, x0 double, z0 array<double>, cb array<int>").coalesce(1)
    ex = JointExamples(1, 0, 4, 16, level_times(5), {(0, level): Grid(-4.0, 0.5, 16) for level in range(5)})
    got = packed_examples(df, ex).collect()
    (ids, n, blocks), = (pickle.loads(r["examples"]) for r in got)
    plain = list(ex.blocks(df.toPandas()))
    assert n == 300 and ids.tolist() == list(range(300)) and len(blocks) == len(plain) == 5
    assert len({id(b.y) for b in blocks}) == 1 and all(b.bins[0].dtype == np.uint8 for b in blocks)
    for a, b in zip(blocks, plain):
        models, loc = a.models()
        assert (models[loc] == b.model).all() and (a.bins[0] == b.bins[0]).all() and (a.y == b.y).all()


def test_utility_split_is_made_once(spark):
    from tabflow.plans import q_models
    tr, te = q_models._split(spark, SF_SMALL)
    again, _ = q_models._split(spark, SF_SMALL)
    assert all("InMemory" in d._jdf.queryExecution().executedPlan().toString() for d in (tr, te, again))
    assert tr.count() + te.count() == q_models._n_rows(spark, SF_SMALL)
