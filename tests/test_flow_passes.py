"""Cost of the passes over a flow's examples: noise, packing, shared cells, tasks and scoring."""

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from datasets import SF_SMALL
from tabflow.functions import noise
from tabflow.learners import flows, hist_boost
from tabflow.learners.hist_boost import BoostedForest, BoostParams, columns_of, packed_examples, predict_margin
from tabflow.learners.mllib import RandomForestSampler
from tabflow.sources.registry import load_dataset


def _state(spark, n=300):
    rng = np.random.default_rng(3)
    rows = [(i, i % 2, float(rng.uniform(-1, 1)), float(rng.uniform(-1, 1)) if i % 5 else None,
             rng.normal(size=2).tolist(), rng.normal(size=2).tolist(), []) for i in range(n)]
    return spark.createDataFrame(rows, "row_id long, lab int, x0 double, x1 double, z0 array<double>, z1 array<double>, "
                                       "cb array<int>")


def _examples():
    return flows.JointExamples(2, 0, 2, 16, flows.level_times(3),
                               {(j, lv): flows.Grid(-4.0, 0.5, 16) for j in range(2) for lv in range(3)})


@pytest.mark.parametrize("copies", [1, 3, 20])
def test_noise_of_a_copy_is_one_digest(spark, copies):
    rows = spark.range(-2, 50).withColumnRenamed("id", "row_id")
    z = flows.noise_array(5, copies, 2)
    want = F.transform(F.sequence(F.lit(0), F.lit(copies - 1)),
                       lambda d: noise.hash_normal("x0", 5, F.col("row_id"), d, 2))
    assert rows.select(z.alias("a"), want.alias("b")).filter("a <> b or size(a) <> size(b)").isEmpty()
    plan = rows.select(z.alias("a"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("md5(") == 1


def test_flow_examples_are_packed_from_arrow(spark):
    df, ex = _state(spark), _examples()
    plan = packed_examples(df, ex)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "MapInPandas" not in plan
    pdf = df.toPandas()
    cols = columns_of(pa.RecordBatch.from_pandas(pdf, preserve_index=False))
    assert len(cols) == len(pdf) and len(cols.part(290, 310)) == 10
    for a, b in zip(ex.blocks(pdf), ex.blocks(cols)):
        assert np.array_equal(a.y, b.y, equal_nan=True) and all(map(np.array_equal, a.bins, b.bins))
        assert np.array_equal(a.model, b.model)


def test_blocks_share_cells_and_counts_at_the_root(spark, monkeypatch):
    df, ex = _state(spark).fillna(0.5), _examples()
    packed = packed_examples(df.coalesce(1), ex).toPandas()
    batch = pa.RecordBatch.from_pandas(packed, pa.schema([("examples", pa.binary()), ("F", pa.binary())]), preserve_index=False)
    calls, plain = [], np.bincount

    def counted(x, weights=None, minlength=0):
        calls.append(weights is None)
        return plain(x, weights, minlength)
    monkeypatch.setattr(np, "bincount", counted)
    out = list(hist_boost._Pass(BoostParams(), 16, {}).histograms(iter([batch]), {}, 0, 0))
    assert sum(calls) == 2 * 3 and len(calls) - sum(calls) == 2 * 3 * 2    # counts: inputs x levels, not x outputs
    got = {(m, j): np.frombuffer(gh).reshape(2, -1) for b in out for m, _, j, gh in b.to_pandas().itertuples(index=False)}
    blocks = list(ex.blocks(df.toPandas()))
    for blk in blocks:
        for m in np.unique(blk.model):
            rows = blk.model == m
            for j, b in enumerate(blk.bins):
                assert np.allclose(got[m, j][0], plain(b[rows].ravel(), -blk.y[rows].ravel(), 17))
                assert np.array_equal(got[m, j][1], plain(b[rows].ravel(), minlength=17))


def test_tasks_of_a_fit_fill_whole_waves(spark, monkeypatch):
    df, cores = spark.range(100).withColumnRenamed("id", "row_id"), spark.sparkContext.defaultParallelism
    monkeypatch.setattr(flows, "ROWS_PER_PARTITION", 1000)
    for rows, waves in ((10, 1), (cores * 100, 1), (cores * 100 + 1, 2), (cores * 1000, 10)):
        assert flows.spread(df, rows, 10).rdd.getNumPartitions() == cores * waves


def test_scoring_follows_the_trees_node_by_node():
    rng, forest = np.random.default_rng(2), BoostedForest(3, 5, "squared")
    forest._ensure((0, 0))
    feat, sbin, dleft, leaf = forest.model((0, 0))[1]
    feat[:], sbin[:] = rng.integers(-1, 4, feat.shape), rng.integers(0, 9, sbin.shape)
    dleft[:], leaf[:] = rng.random(dleft.shape) < 0.5, rng.normal(size=leaf.shape)
    x, thr = rng.normal(size=(200, 4)), np.sort(rng.normal(size=(4, 9)), axis=1)
    x[rng.random(x.shape) < 0.2] = np.nan
    want = []
    for row in x:
        total = []
        for t in range(5):
            node = 0
            for _ in range(3):
                j, missing = feat[t, node], feat[t, node] >= 0 and np.isnan(row[feat[t, node]])
                left = j < 0 or (dleft[t, node] if missing else row[j] <= thr[j, sbin[t, node]])
                node = 2 * node + (1 if left else 2)
            total.append(leaf[t, node - 7])
        want.append(np.sum(total))
    assert np.allclose(predict_margin(forest, (0, 0), x, thr), want)


def test_a_fit_lets_go_of_the_cached_input(spark):
    ex = _examples()
    df = _state(spark).persist()
    df.count()
    hist_boost.fit_expanded(df, ex, BoostParams(n_rounds=1, depth=1), 16, release=True)
    assert not df.storageLevel.useMemory


def test_imputation_spreads_a_table_of_one_file(spark):
    df, spec = load_dataset(spark, SF_SMALL, "orders")
    fit = flows.JointFlow(n_t=3, K=1, n_bins=8, reg=BoostParams(n_rounds=1, depth=1)).fit(df, spec)
    blank = df.withColumn("o_totalprice", F.when(F.col("row_id") % 5 > 0, F.col("o_totalprice"))).coalesce(1)
    out = fit.impute(blank, seed=1)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.index("MapInArrow") < plan.index("REPARTITION_BY_COL")
    again = fit.impute(blank.repartition(7), seed=1)
    key = lambda d: d.toPandas().sort_values("row_id", ignore_index=True)
    pd.testing.assert_frame_equal(key(out), key(again))


def test_forest_noise_is_drawn_before_the_levels(spark, monkeypatch):
    from tabflow.learners import mllib
    df, spec = load_dataset(spark, SF_SMALL, "orders")
    seen, plain = [], mllib.forward.noise_levels
    monkeypatch.setattr(mllib.forward, "noise_levels", lambda d, n: seen.append(d.columns) or plain(d, n))
    RandomForestSampler(n_t=3, K=2, num_trees=2, max_depth=2).fit(df, spec)
    assert seen and all("z" in cols for cols in seen)
