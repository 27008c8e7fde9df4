"""Trees read by page from shared storage."""

import pickle

import numpy as np
import pandas as pd
import pytest

from datasets import SF_SMALL
from tabflow.learners import flows, paged
from tabflow.learners.hist_boost import BoostedForest, BoostParams, predict_margin
from tabflow.sources.registry import load_dataset

REG = BoostParams(n_rounds=2, depth=2, eta=0.3)
CLF = BoostParams(n_rounds=2, depth=2, eta=0.1, objective="softmax")


def random_forest(keys, rounds=3, depth=3, inputs=4, bins=8, seed=0):
    rng = np.random.default_rng(seed)
    out = BoostedForest(depth=depth, n_rounds=rounds, objective="squared")
    for key in keys:
        out._ensure(key)
        out.feat[key][:] = rng.integers(-1, inputs, out.feat[key].shape)
        out.sbin[key][:] = rng.integers(0, bins, out.sbin[key].shape)
        out.dleft[key][:] = rng.random(out.dleft[key].shape) < 0.5
        out.leaf[key][:] = rng.normal(size=out.leaf[key].shape)
        out.base[key] = float(rng.normal())
    return out


@pytest.fixture
def tiny_pages(monkeypatch):
    monkeypatch.setattr(paged, "PAGE_BYTES", 1500)
    monkeypatch.setattr(paged, "CACHE_BYTES", 4000)


def test_margins_are_those_of_the_whole_forest(spark, tiny_pages):
    """Several classes a model, a model without trees, unknown models, and pages that push each other out."""
    whole = random_forest([(m, c) for m in range(0, 60, 2) for c in range(1 + m % 3)])
    whole.base[(4, 7)] = 2.5
    forest = paged.store(spark, whole)
    assert len(forest.first) > 5 and (np.diff(forest.first) > 0).all() and forest.nbytes > paged.CACHE_BYTES
    x = np.random.default_rng(1).normal(size=(50, 4))
    x[::7, 2] = np.nan
    thr = np.sort(np.random.default_rng(2).normal(size=(4, 10)), axis=1)
    for key in [*whole.feat, (4, 7), (5, 0), (-1, 0), (1000, 0), (2, 9)] * 2:
        assert np.array_equal(predict_margin(forest, key, x, thr), predict_margin(whole, key, x, thr)), key
    assert sum(n for _, n in paged._HELD.values()) == paged._SIZE[0] <= paged.CACHE_BYTES + 1500


def test_an_empty_forest_gives_its_default(spark):
    forest = paged.store(spark, BoostedForest(depth=2, n_rounds=1, objective="squared"))
    assert forest.nbytes == 0 and forest.model((0, 0)) == (0.0, None)


def test_what_is_broadcast_does_not_grow_with_the_trees(spark):
    """100 numeric columns, 50 levels and 2 labels: 10,000 models."""
    whole = random_forest([(m, 0) for m in range(100 * 50 * 2)], rounds=5, depth=4)
    sent = pickle.dumps(paged.store(spark, whole))
    assert len(sent) < 20_000 < 5_000_000 < len(pickle.dumps(whole))


def test_generated_rows_are_those_of_broadcast_trees(spark):
    df, spec = load_dataset(spark, SF_SMALL, "orders")
    flow = dict(n_t=4, K=2, n_bins=16, reg=REG)
    seq = flows.SequentialFlow(model_type="HS3F", clf=CLF, **flow).fit(df, spec)
    joint = flows.JointFlow(**flow).fit(df, spec)
    for fitted, batch in ((seq, lambda b, p: flows._sequential_batch(b, p, "rk4", "n_t")),
                          (joint, lambda b, p: flows._joint_batch(b, p, 4))):
        rng, n, c = np.random.default_rng(3), 300, 12
        own = pd.DataFrame({"row_id": np.arange(n), "lab": rng.integers(0, 2, n), "first": 0,
                            **{f"z{k}": rng.normal(size=n) for k in range(c)}, **{f"u{k}": rng.random(n) for k in range(c)}})
        names = ("reg", "clf") if fitted is seq else ("forest",)
        whole, pages = batch(own, fitted._payload()), batch(own, paged.payload(spark, fitted, names))
        assert whole.equals(pages) and whole.drop(columns=["row_id", "lab"]).std().max() > 0
    assert seq.sample(500, seed=1).count() == 500 and joint.impute(df).count() == df.count()


def test_batches_are_joined_only_above_the_cache(spark, tiny_pages, monkeypatch):
    pay = {"forest": paged.store(spark, random_forest([(m, 0) for m in range(30)])), "none": None}
    monkeypatch.setattr(paged, "BATCH_BYTES", 100)
    parts = [pd.DataFrame({"a": np.arange(5) + 5 * i}) for i in range(7)]        # 40 bytes each
    got = list(paged.gathered(iter(parts), pay, ("forest", "none")))
    assert [len(g) for g in got] == [15, 15, 5] and pd.concat(got).a.tolist() == list(range(35))
    monkeypatch.setattr(paged, "CACHE_BYTES", 1 << 30)
    assert [len(g) for g in paged.gathered(iter(parts), pay, ("forest", "none"))] == [5] * 7
