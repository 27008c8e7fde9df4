"""Fits at size: whole category models, equal rows once, caches, small example sets in one task."""

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from datasets import SF_SMALL
from tabflow.learners import flows, hist_boost
from tabflow.learners.hist_boost import BoostParams, fit_boosted
from tabflow.metrics import utility
from tabflow.plans import q_models
from tabflow.sources.registry import load_dataset

SMALL = dict(n_t=3, K=2, n_bins=16)
CLF = BoostParams(n_rounds=3, depth=3, eta=0.1, objective="softmax")


def test_category_models_are_fitted_at_the_reference_settings(spark):
    t = q_models.q_fit_category(spark, SF_SMALL)
    got = t.agg(F.countDistinct("round").alias("rounds"), F.min(F.size("leaf")).alias("leaves"),
                F.min("kind").alias("a"), F.max("kind").alias("b")).first()
    assert (got["rounds"], got["leaves"], got["a"], got["b"]) == (115, 128, "category", "category")


@pytest.mark.parametrize("depth", [0, 1])
def test_equal_rows_give_the_same_sums(spark, depth):
    df = _orders_state(spark).drop("n")
    df, ex = df.unionByName(df), flows.CategoryExamples([1], 2, [4], 2.0)
    few = ex.equal_rows(df)
    assert few.count() < df.count() == few.agg(F.sum("n")).first()[0]
    trees = {(m, c): (np.array([0]), np.array([4]), np.array([True]), None) for m in range(2) for c in range(4)} if depth else {}
    work, schema, got = hist_boost._Pass(CLF, 8, {}), pa.schema([("examples", pa.binary()), ("F", pa.binary())]), []
    for d in (df, few):
        packed = hist_boost.packed_examples(d, ex, True).toPandas()
        out = {}
        for b in work.histograms(iter([pa.RecordBatch.from_pandas(packed, schema, preserve_index=False)]), trees, depth, 0):
            out |= {(m, c, j): np.frombuffer(gh) for m, c, j, gh in b.to_pandas().itertuples(index=False)}
        got.append(out)
    assert got[0].keys() == got[1].keys() and len(got[0]) == 8 and all(np.allclose(got[0][k], got[1][k]) for k in got[0])


@pytest.mark.parametrize("params", [BoostParams(n_rounds=3, depth=3, subsample=0.7),
                                    BoostParams(n_rounds=6, depth=2, objective="softmax", eta=0.2)])
def test_one_task_boosts_like_many(spark, monkeypatch, params):
    rng = np.random.default_rng(1)
    n = 500
    y = rng.integers(0, 3, n) if params.objective == "softmax" else rng.normal(size=n)
    pdf = pd.DataFrame({"model": rng.integers(0, 3, n), "rid": np.arange(n), "nin": 2, "y": y.astype(float),
                        "bins": rng.integers(0, 9, (n, 2)).tolist()})
    rows = spark.createDataFrame(pdf, "model int, rid long, nin int, y double, bins array<int>").repartition(3, "rid")
    kinds = {m: 3 for m in range(3)} if params.objective == "softmax" else None
    a = fit_boosted(rows, params, kinds, 2, 8)
    monkeypatch.setattr(hist_boost, "SMALL", -1)
    b = fit_boosted(rows, params, kinds, 2, 8)
    assert a.feat.keys() == b.feat.keys() and len(a.feat) == (9 if kinds else 3)
    for k in a.feat:
        assert (a.feat[k] == b.feat[k]).all() and (a.sbin[k] == b.sbin[k]).all() and (a.dleft[k] == b.dleft[k]).all()
        assert np.allclose(a.leaf[k], b.leaf[k], atol=1e-6) and (a.feat[k] >= 0).any()


def test_a_round_has_no_more_tasks_than_trees(spark, monkeypatch):
    df, spec = load_dataset(spark, SF_SMALL, "orders")
    monkeypatch.setattr(hist_boost, "SMALL", -1)
    kind = type(df)
    seen, plain = [], kind.repartition
    monkeypatch.setattr(kind, "repartition", lambda self, n, *c: seen.append((n, *c)) or plain(self, n, *c))
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        flows.SequentialFlow(reg=BoostParams(n_rounds=1, depth=1), clf=CLF, **SMALL).fit(df, spec)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert {n for n, *c in seen if c == ["model", "cls"]} == {18, 15}       # 2 columns x 3 labels x 3 levels; 3 labels x 5 classes


@pytest.mark.parametrize("kind", ["sequential", "joint", "forest"])
def test_caches_are_kept_as_objects_or_on_disk(spark, monkeypatch, kind):
    df, spec = load_dataset(spark, SF_SMALL, "orders")
    seen, plain = [], type(df).persist
    monkeypatch.setattr(type(df), "persist", lambda self, *a: seen.append(a) or plain(self, *a))
    reg = BoostParams(n_rounds=2, depth=1)
    if kind == "sequential":
        flows.SequentialFlow(reg=reg, clf=CLF, **SMALL).fit(df, spec)
    else:
        flows.JointFlow(reg=reg, learner="boosted" if kind == "joint" else "forest", **SMALL).fit(df, spec)
    assert seen and all(a and a[0].useDisk and (a[0].deserialized or not a[0].useMemory) for a in seen)
    assert any(not a[0].useMemory for a in seen)


def test_bagging_counts_drawn_examples_only(spark, monkeypatch):
    from tabflow.learners import bagging
    rng = np.random.default_rng(4)
    n = 400
    pdf = pd.DataFrame({"row_id": np.arange(n), "model": 0, "bins": rng.integers(0, 9, (n, 3)).tolist(), "nin": 3,
                        "y": rng.normal(size=n), "w": 1.0})
    rows = spark.createDataFrame(pdf, "row_id long, model long, bins array<int>, nin int, y double, w double").coalesce(1)
    packed = hist_boost.packed_examples(rows, hist_boost.PlainRows(3)).toPandas()
    batch = pa.RecordBatch.from_pandas(packed, pa.schema([("examples", pa.binary()), ("F", pa.binary())]), preserve_index=False)
    sizes, plain = [], np.bincount
    monkeypatch.setattr(np, "bincount", lambda x, w=None, minlength=0: sizes.append(len(x)) or plain(x, w, minlength))
    tree = (np.array([1, 2, -1]), np.array([4, 0, 0]), np.array([True, False, True]))
    out = list(bagging._Pass(bagging.ForestParams(2, 3), 8, 0, {(0, t): tree for t in range(2)}, 2).histograms(iter([batch])))
    drawn = [bagging.bootstrap(np.arange(n), 1, t, 0)[:, 0] for t in range(2)]
    assert sum(sizes) == 3 * 2 * sum((w > 0).sum() for w in drawn)
    got = {(t, j): np.frombuffer(s).reshape(2, 4, 9) for b in out for _, t, j, s in b.to_pandas().itertuples(index=False)}
    bins, y = np.stack(pdf["bins"]), pdf["y"].to_numpy()
    node = np.where(bins[:, 1] > 4, 2, 1)       # of depth 2; the left child of the root sends all to the right, the right one to the left
    for t, w in enumerate(drawn):
        for j in range(3):
            for k, total in enumerate((w * y, w)):
                want = np.zeros((4, 9))
                np.add.at(want, (node, bins[:, j]), total)
                assert np.allclose(got[t, j][k], want)


def test_plain_rows_of_different_lengths():
    pdf = pd.DataFrame({"model": 0, "nin": [2, 0, 1, 2], "bins": [[3, 4], [], [5, 6, 7], [8]], "y": 0.0, "w": 1.0})
    (b,) = hist_boost.PlainRows(3).blocks(pdf)
    assert np.hstack(b.bins).tolist() == [[3, 4, -1], [-1, -1, -1], [5, -1, -1], [8, -1, -1]]


def test_learners_train_side_by_side(spark, monkeypatch):
    import threading
    gate, plain = threading.Barrier(4), utility.predictions

    def predictions(*a):
        gate.wait(60)       # passes once all four have begun
        return plain(*a)
    monkeypatch.setattr(utility, "predictions", predictions)
    df = load_dataset(spark, SF_SMALL, "orders")[0]
    p = utility.UtilityParams(max_iter=5, ada_rounds=1, forest_trees=2, forest_depth=2, boost_rounds=1, boost_depth=1, seeds=1)
    got = utility.score_four_models(df, df.limit(200), ["o_totalprice"], [], "o_orderstatus", True, p)
    assert list(got) == [*utility.LEARNERS, "mean"]


def test_classifiers_alone_need_no_tasks_for_copies(spark, monkeypatch):
    df, spec = load_dataset(spark, SF_SMALL, "orders")
    seen, plain = [], flows.spread
    monkeypatch.setattr(flows, "spread", lambda d, n, expansion: seen.append(expansion) or plain(d, n, expansion))
    flows.SequentialFlow(clf=CLF, **SMALL).fit(df, spec, kinds=("category",))
    flows.SequentialFlow(clf=CLF, reg=BoostParams(n_rounds=1, depth=1), **SMALL).fit(df, spec)
    assert seen == [1, 2 * 3 * 2]


def test_small_chunks_are_joined(spark):
    df = _orders_state(spark).repartition(7, "row_id")
    ex = flows.CategoryExamples([1], 2, [4], 2.0)
    got = hist_boost.packed_examples(df, ex, True).toPandas()
    schema = pa.schema([("examples", pa.binary()), ("F", pa.binary())])
    parts = [pa.RecordBatch.from_pandas(got[i:i + 1], schema, preserve_index=False) for i in range(len(got))]
    joined = hist_boost._joined(iter(parts))
    assert len(parts) > 3 and len(joined) == 1 and hist_boost._joined(iter([])) == []
    work = hist_boost._Pass(CLF, 8, {})

    def sums(batches):
        out = {}
        for b in work.histograms(iter(batches), {}, 0, 0):
            for m, c, j, gh in b.to_pandas().itertuples(index=False):
                out[m, c, j] = out.get((m, c, j), 0) + np.frombuffer(gh)
        return out
    a, b = sums(parts), sums(joined)
    assert a.keys() == b.keys() and len(a) == 8 and all(np.allclose(a[k], b[k]) for k in a)


def _orders_state(spark):
    rng = np.random.default_rng(5)
    rows = [(i, i % 2, [int(rng.integers(1, 9)), 0], float(rng.integers(0, 4)), int(rng.integers(1, 5))) for i in range(60)]
    return spark.createDataFrame(rows, "row_id long, lab int, fb array<int>, x1 double, n long")
