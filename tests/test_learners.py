"""Utility learners of both problem types, booster options, and errors instead of silent losses."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from datasets import SF_SMALL
from tabflow.learners.flows import JointFlow, SequentialFlow, with_row_id
from tabflow.learners.hist_boost import BoostParams, best_splits, fit_boosted, predict_margin
from tabflow.metrics import experiment, neighbors, scores, utility
from tabflow.sampling import draws
from tabflow.sources.registry import load_dataset
from tabflow.spec import ColumnSpec, TableSpec

UP = utility.UtilityParams(max_iter=50, ada_rounds=3, forest_trees=3, forest_depth=3, boost_rounds=2, boost_depth=2, seeds=1)
REG = BoostParams(n_rounds=2, depth=2, eta=0.3)
CLF = BoostParams(n_rounds=2, depth=2, eta=0.1, objective="softmax")
SMALL = dict(n_t=4, K=2, n_bins=16)


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=240)
    pdf = pd.DataFrame({"row_id": np.arange(240), "x": x, "c": np.where(x > 0.3, "hi", np.where(x < -0.3, "lo", "mid")),
                        "y": 3 * x + rng.normal(0, 0.1, 240)})
    df = spark.createDataFrame(pdf).cache()
    split = draws.train_test_split(df, "row_id", 0, 0.25)
    return split.where("is_test = 0").drop("is_test"), split.where("is_test = 1").drop("is_test")


@pytest.mark.parametrize("learner", utility.LEARNERS)
@pytest.mark.parametrize("classification", [True, False])
def test_every_learner_predicts_both_problem_types(table, learner, classification):
    train, test = table
    target = "c" if classification else "y"
    tr, te, classes, cols = utility.prepare_parts(train, test, ["x"], [], target, classification)
    (p,) = utility.predictions(learner, tr, [te], cols, classification, len(classes or []), UP)
    assert p.columns == ["row_no", "label", "prediction"] and p.count() == test.count()
    assert utility.score(p, classification) > 0.3


def test_one_column_table_is_scored_from_itself(table):
    train, test = table
    s = utility.score_four_models(train.select("y"), test.select("y"), [], [], "y", False, UP, ("lin", "tree"))
    assert s["lin"] > 0.99


def test_weighted_median_is_the_first_value_at_half_the_weight(spark):
    rng = np.random.default_rng(1)
    w = rng.random(5)
    v = rng.normal(size=(50, 5))
    df = spark.createDataFrame(pd.DataFrame(v, columns=list("abcde")))
    got = df.select(utility.weighted_median([F.col(c) for c in "abcde"], w.tolist()).alias("m")).toPandas()["m"]
    for row, m in zip(v, got):
        o = np.argsort(row)
        assert np.isclose(m, row[o][np.searchsorted(np.cumsum(w[o]), 0.5 * w.sum())])


def test_scores_match_their_definition(spark):
    pdf = pd.DataFrame({"t": list("aabbbcc"), "p": list("abbbdca")})
    f1 = scores.f1_macro(spark.createDataFrame(pdf), "t", "p").first()["f1"]
    want = []
    for k in "abcd":
        tp = ((pdf.t == k) & (pdf.p == k)).sum()
        want.append(2 * tp / ((pdf.t == k).sum() + (pdf.p == k).sum()))
    assert np.isclose(f1, np.mean(want))


def _rows(spark, b, y, model=0, nin=None):
    b = np.atleast_2d(np.asarray(b).T).T
    return spark.createDataFrame(pd.DataFrame({"model": model, "rid": np.arange(len(y)), "bins": [list(map(int, r)) for r in b],
                                               "nin": b.shape[1], "y": np.asarray(y, float)}),
                                 "model int, rid long, bins array<int>, nin int, y double")


def test_two_classes_use_the_logistic_loss(spark):
    b = np.array([1] * 30 + [2] * 30)
    y = np.array([0] * 25 + [1] * 5 + [1] * 27 + [0] * 3)
    f = fit_boosted(_rows(spark, b, y), BoostParams(n_rounds=1, depth=1, eta=1.0, objective="softmax"), {0: 2}, 1, 2)
    assert (0, 1) in f.feat and (0, 0) not in f.feat
    # leaf = -G / H with p = 1/2, h = 1/4
    assert np.allclose(f.leaf[(0, 1)][0], [(5 - 15) / (30 / 4), (27 - 15) / (30 / 4)])


def test_penalties_and_missing_values_in_the_split_search():
    g, h = np.zeros((1, 5)), np.zeros((1, 5))
    g[0], h[0] = [4, -6, -6, 5, 5], [2, 3, 3, 3, 3]                 # bin 0: missing
    p = BoostParams(lam=1.0, alpha=0.5, depth=1)
    (node, j, b, left, gl, hl, gt, ht), = best_splits({0: np.stack([g.ravel(), h.ravel()])}, 1, 5, p)
    assert (node, j, b, left) == (0, 0, 2, False) and gl == -12 and hl == 6 and gt == 2 and ht == 14
    none = best_splits({0: np.stack([g.ravel(), h.ravel()])}, 1, 5, BoostParams(min_child_weight=20))
    assert none[0][1] == -1


def test_subsample_and_named_parameters(spark):
    p = BoostParams().with_params({"n_estimators": 3, "max_depth": 2, "reg_alpha": 0.1, "subsample": 0.5})
    assert (p.n_rounds, p.depth, p.alpha, p.subsample) == (3, 2, 0.1, 0.5)
    with pytest.raises(TypeError):
        BoostParams().with_params({"no_such_parameter": 1})
    b = np.arange(200) % 8 + 1
    y = np.where(b > 4, 1.0, -1.0)
    one = fit_boosted(_rows(spark, b, y), p, None, 1, 8)
    two = fit_boosted(_rows(spark, b, y).repartition(3), p, None, 1, 8)
    assert all((one.feat[k] == two.feat[k]).all() and np.allclose(one.leaf[k], two.leaf[k]) for k in one.feat)
    thr = np.arange(10.0)[None, :]
    assert predict_margin(one, (0, 0), np.array([[1.0], [8.0]]), thr)[0] < 0


def test_more_categories_than_bins(spark):
    n = 400
    code = np.arange(n) % 40
    pdf = pd.DataFrame({"row_id": np.arange(n), "a": [f"v{c:02d}" for c in code], "b": np.where(code >= 25, "big", "small")})
    spec = TableSpec.of(ColumnSpec("a", "categorical"), ColumnSpec("b", "categorical"))
    fit = SequentialFlow(label_cond=False, clf=BoostParams(n_rounds=8, depth=1, eta=0.5, objective="softmax"), **SMALL) \
        .fit(spark.createDataFrame(pdf), spec)
    out = fit.sample(300, seed=1).toPandas()
    assert ((out.a >= "v25") == (out.b == "big")).mean() > 0.8


def test_covariates_and_integer_types(spark):
    df, _ = load_dataset(spark, SF_SMALL, "orders")
    spec = TableSpec.of(ColumnSpec("o_totalprice"), ColumnSpec("o_orderdate_days", "integer", "covariate"),
                        ColumnSpec("o_orderstatus", "categorical", "label"))
    fit = JointFlow(reg=REG, **SMALL).fit(df, spec)
    out = fit.sample(df.select("row_id", "o_orderdate_days").limit(50), seed=1)
    assert out.count() == 50 and out.columns == ["row_id", "o_totalprice", "o_orderstatus"]
    df, spec = load_dataset(spark, SF_SMALL, "orders")
    made = SequentialFlow(reg=REG, clf=CLF, **SMALL).fit(df, spec).sample(20, seed=1)
    assert made.schema["o_orderdate_days"].dataType == df.schema["o_orderdate_days"].dataType


def test_a_missing_label_raises(spark):
    df, spec = load_dataset(spark, SF_SMALL, "orders")
    fit = JointFlow(reg=REG, **SMALL).fit(df, spec)
    gone = df.withColumn("o_orderstatus", F.when(F.col("row_id") % 10 != 0, F.col("o_orderstatus")))
    with pytest.raises(ValueError):
        fit.impute(gone, seed=1).count()


def test_too_few_rows_for_k_raises(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(4)], "row_id long, x double")
    with pytest.raises(ValueError):
        neighbors.coverage(df, df, ["x"], 5)
    assert neighbors.coverage(df, df, ["x"], 2) == 1.0


def test_row_ids_are_stable_without_a_key(spark):
    df = spark.createDataFrame([(i % 5, "x") for i in range(40)], "a long, b string")
    one = sorted(r.row_id for r in with_row_id(df, "row_id", ["a", "b"]).collect())
    two = sorted(r.row_id for r in with_row_id(df.repartition(7), "row_id", ["a", "b"]).collect())
    assert one == two and len(set(one)) == 40


def test_experiment_has_one_row_per_run_and_method(spark):
    df, spec = load_dataset(spark, SF_SMALL, "orders")
    e = experiment.Experiment(nexp=1, ngen=2, flow={**SMALL, "reg": REG}, clf=CLF, scoring=UP, learners=("lin",))
    runs = experiment.run(df.limit(400), spec, "orders", methods=("HS3F_Euler", "FFM"), e=e)
    assert runs.count() == 4
    out = experiment.summarize(runs).toPandas().set_index("method")
    assert set(out.index) == {"HS3F_Euler", "FFM"} and (out.W_train_lower > 0).all() and (out.F1_real > 0).all()
    assert (out.R2_real == 0).all() and out.loc["FFM", "W_train_lower"] != out.loc["HS3F_Euler", "W_train_lower"]


def test_regression_experiment(spark):
    df, _ = load_dataset(spark, SF_SMALL, "orders")
    spec = TableSpec.of(ColumnSpec("o_orderdate_days", "integer"), ColumnSpec("o_totalprice", "continuous", "target"))
    e = experiment.Experiment(nexp=1, ngen=1, flow={**SMALL, "reg": REG}, scoring=UP, learners=("lin",))
    r = experiment.run(df.limit(300), spec, "orders", methods=("CS3F_Rg4",), e=e).first()
    assert r.F1_real == 0 and r.R2_lin_fake <= 1
