"""Bagged trees, mini-batch fits and imputation of repeated rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from datasets import SF_SMALL
from tabflow.learners.bagging import ForestParams, bootstrap, fit_bagged
from tabflow.learners.flows import JointFlow, SequentialFlow, joint_model_table, sequential_model_table
from tabflow.learners.hist_boost import BoostParams, PlainRows, predict_margin
from tabflow.sources.registry import load_dataset
from test_models import _check_sample

SMALL = dict(n_t=4, K=2, n_bins=16)
REG = BoostParams(n_rounds=2, depth=2, eta=0.3)
CLF = BoostParams(n_rounds=2, depth=2, eta=0.1, objective="softmax")


def _rows(spark, y, seed=0, n=300):
    rng = np.random.default_rng(seed)
    bins = np.column_stack([rng.integers(1, 9, n), rng.integers(1, 5, n)])
    pdf = pd.DataFrame({"row_id": np.arange(n), "model": 3, "bins": bins.tolist(), "nin": 2, "y": y(bins, rng), "w": 1.0})
    return spark.createDataFrame(pdf, "row_id long, model long, bins array<int>, nin int, y double, w double"), pdf, bins


def _grown(bins, y, w, depth):
    """Leaf means (columns: outputs) of a tree grown by trying every split."""
    out = np.zeros_like(y)

    def grow(rows, depth):
        mean = (w[rows, None] * y[rows]).sum(0) / w[rows].sum()
        out[rows] = mean
        if depth == 0:
            return
        best, arg = 1e-9, None
        for j in range(bins.shape[1]):
            for b in range(1, 9):
                left = rows[bins[rows, j] <= b]
                right = rows[bins[rows, j] > b]
                if w[left].sum() < 1 or w[right].sum() < 1:
                    continue
                gain = sum((((w[r, None] * y[r]).sum(0) ** 2).sum() / w[r].sum()) for r in (left, right)) \
                    - ((w[rows, None] * y[rows]).sum(0) ** 2).sum() / w[rows].sum()
                if gain > best + 1e-9:
                    best, arg = gain, (left, right)
        if arg:
            for r in arg:
                grow(r, depth - 1)
    grow(np.arange(len(y)), depth)
    return out


def test_bootstrap_counts_are_poisson_and_differ_between_trees():
    a, b = (bootstrap(np.arange(50_000), 2, t, 0).ravel() for t in (0, 1))
    for k, p in enumerate((0.3679, 0.3679, 0.1839, 0.0613)):
        assert abs((a == k).mean() - p) < 0.006
    assert abs(np.corrcoef(a, b)[0, 1]) < 0.01
    assert bootstrap(np.array([-5, 2 ** 62]), 3, 7, 1).shape == (2, 3)


def test_regression_forest_by_brute_force(spark):
    df, pdf, bins = _rows(spark, lambda b, r: np.where(b[:, 0] > 5, 2.0, -1.0) + b[:, 1] + r.normal(0, 0.5, len(b)))
    forest = fit_bagged(df, PlainRows(2), ForestParams(n_trees=3, depth=2, trees_per_pass=2, seed=4), 8)
    y = pdf["y"].to_numpy()[:, None]
    want = np.mean([_grown(bins, y, bootstrap(pdf["row_id"].to_numpy(), 1, t, 4)[:, 0], 2) for t in range(3)], axis=0)
    thr = np.tile(np.arange(10, dtype=float), (2, 1))
    got = predict_margin(forest, (3, 0), bins.astype(float), thr)
    assert np.allclose(got, want[:, 0])


def test_classification_forest_by_brute_force(spark):
    df, pdf, bins = _rows(spark, lambda b, r: (b[:, 0] // 3 + (r.random(len(b)) < 0.2)).astype(float) % 3, seed=1)
    forest = fit_bagged(df, PlainRows(2, {3: 3}), ForestParams(n_trees=2, depth=2, seed=1), 8)
    y = np.eye(3)[pdf["y"].to_numpy().astype(int)]
    want = np.mean([_grown(bins, y, bootstrap(pdf["row_id"].to_numpy(), 1, t, 1)[:, 0], 2) for t in range(2)], axis=0)
    thr = np.tile(np.arange(10, dtype=float), (2, 1))
    got = np.column_stack([predict_margin(forest, (3, c), bins.astype(float), thr) for c in range(3)])
    assert np.allclose(got, want) and np.allclose(got.sum(1), 1)


def test_forest_flows_generate_valid_rows(spark):
    df, spec = load_dataset(spark, SF_SMALL, "orders")
    seq = SequentialFlow(learner="forest", reg=REG, clf=CLF, **SMALL).fit(df, spec)
    _check_sample(seq.sample(120, seed=2, solver="rk4"), df, spec, 120)
    joint = JointFlow(learner="forest", reg=REG, **SMALL).fit(df, spec)
    _check_sample(joint.sample(120, seed=2), df, spec, 120)
    blank = df.withColumn("o_totalprice", F.when(F.col("row_id") % 7 > 0, F.col("o_totalprice")))
    with pytest.raises(ValueError):
        JointFlow(learner="forest", reg=REG, **SMALL).fit(blank, spec)


def test_minibatch_models_depend_on_slices_and_epochs(spark):
    df, spec = load_dataset(spark, SF_SMALL, "orders")

    def trees(**kw):
        fit = SequentialFlow(reg=REG, **{**SMALL, **kw}).fit(df, spec)
        t = sequential_model_table(fit).orderBy("kind", "feature", "label", "level", "output", "round").collect()
        return [r for r in t if r.kind == "velocity"], sum(r.kind == "category" and r.output == t[0].output for r in t)
    (one, _), (again, _), (two, n_two), (epochs, _), (whole, n_whole) = (
        trees(n_batch=1), trees(n_batch=1), trees(n_batch=3), trees(n_batch=1, K=3), trees())
    assert one == again and one != two and one != epochs and one != whole
    assert n_whole > n_two            # the classifier's 15 extra trees are not part of a mini-batch fit
    fit = JointFlow(n_batch=3, reg=REG, **SMALL).fit(df, spec)
    assert joint_model_table(fit, spark).count() > 0
    _check_sample(fit.sample(60, seed=1), df, spec, 60)


def test_sketch_bins_hold_about_equal_counts(spark):
    from tabflow.learners import flows
    rows = spark.range(4000).select(F.col("id").alias("row_id"), F.lit(0).alias("lab"),
                                    F.expr("pow(id / 4000D, 4)").alias("x0"), F.array(F.lit(0.0)).alias("z0"),
                                    F.array(F.lit(1)).alias("fb"))
    ex = flows.PathExamples([0], 1, 1, 16, np.ones(1))
    ex.edges = flows._path_edges(rows, ex, 16, quantiles=True)
    bins = np.concatenate([b.bins[0].ravel() for b in ex.blocks(rows.toPandas())])
    counts = np.bincount(bins)[1:]
    # the lowest values crowd in the first cells, which no edge can cut
    assert len(counts) >= 11 and counts[3:].max() <= 1.3 * 4000 / 16
    thr = ex.edges[(0, 0)].thresholds(20)
    x = (np.arange(4000) / 4000) ** 4
    assert all((bins <= b).tolist() == (x <= thr[b]).tolist() for b in range(1, len(counts)))


def test_imputation_keeps_repeated_row_ids(spark):
    df, spec = load_dataset(spark, SF_SMALL, "orders")
    fit = JointFlow(reg=REG, **SMALL).fit(df, spec)
    blank = df.withColumn("o_totalprice", F.when(F.col("row_id") % 5 > 0, F.col("o_totalprice")))
    out = fit.impute(blank.unionByName(blank).unionByName(blank), seed=1)
    assert out.count() == 3 * df.count() and out.filter("o_totalprice is null").isEmpty()
    assert out.dropDuplicates().count() == df.count()      # copies are filled alike
    assert fit.impute(blank.limit(0), seed=1).count() == 0
