"""Brute-force checks of the distributed building blocks."""

import hashlib
import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabflow.functions.noise import hash_uniform
from tabflow.metrics import neighbors, transport
from tabflow.operators.prefix import running_sums
from tabflow.sampling import solvers


def test_hash_uniform_matches_md5(spark):
    df = spark.range(50).select(F.col("id"), hash_uniform("tag", 3, F.col("id")).alias("u"))
    for r in df.collect():
        h = hashlib.md5(f"tag|3|{r['id']}".encode()).hexdigest()
        assert r["u"] == (int(h[:13], 16) + 0.5) / 16 ** 13


def test_running_sums_range_buckets(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"g": rng.integers(0, 3, 500), "v": rng.normal(size=500).round(3), "w": rng.integers(1, 5, 500)})
    pdf = pdf.drop_duplicates(["g", "v"])
    df = spark.createDataFrame(pdf).repartition(4)
    out = running_sums(df, ["v"], {"cw": F.col("w")}, partition=["g"], num_buckets=5,
                       next_of={"nv": "v"}).toPandas()
    exp = pdf.sort_values(["g", "v"]).copy()
    exp["cw"] = exp.groupby("g")["w"].cumsum()
    exp["nv"] = exp.groupby("g")["v"].shift(-1)
    m = out.merge(exp, on=["g", "v"], suffixes=("", "_e"))
    assert len(m) == len(exp)
    assert (m["cw"] == m["cw_e"]).all()
    assert np.allclose(m["nv"].fillna(1e9), m["nv_e"].fillna(1e9))


def _w1_numpy(a, b):
    xs = np.sort(np.unique(np.concatenate([a, b])))
    fa = np.searchsorted(np.sort(a), xs, side="right") / len(a)
    fb = np.searchsorted(np.sort(b), xs, side="right") / len(b)
    return float(np.sum(np.abs(fa - fb)[:-1] * np.diff(xs)))


def test_w1_matches_numpy(spark):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=300).round(2), rng.normal(0.5, 1.3, size=200).round(2)
    p = spark.createDataFrame(pd.DataFrame({"x": a}))
    q = spark.createDataFrame(pd.DataFrame({"x": b}))
    w = transport.wasserstein1_columns(p, q, ["x"]).first()["w1"]
    assert abs(w - _w1_numpy(a, b)) < 1e-9


def _fixture(rng, n, dup_every=4):
    X = rng.integers(0, 6, size=(n, 3)).astype(float) / 2.0
    X[::dup_every] = X[0]  # a heavy duplicate group
    return X


def test_kth_distance_and_coverage_brute_force(spark):
    rng = np.random.default_rng(2)
    R, Fk = _fixture(rng, 120), _fixture(rng, 90, 7) + 0.25
    cols = ["a", "b", "c"]
    real = spark.createDataFrame(pd.DataFrame(R, columns=cols).assign(row_id=np.arange(len(R))))
    fake = spark.createDataFrame(pd.DataFrame(Fk, columns=cols).assign(row_id=np.arange(len(Fk))))
    D = np.abs(R[:, None, :] - R[None, :, :]).sum(-1)
    for k in (1, 3, 5):
        radius = np.sort(D, axis=1)[:, k]  # (k+1)-th smallest incl. self
        pts = neighbors.dedupe_points(real, cols, "row_id")
        rad = neighbors.knn_radius(pts, cols, k).toPandas()
        back = real.toPandas().merge(pts.select("pid", *cols).toPandas(), on=cols).merge(rad, on="pid")
        got = back.sort_values("row_id")["radius"].to_numpy()
        assert np.allclose(got, radius)
        dmin = np.abs(R[:, None, :] - Fk[None, :, :]).sum(-1).min(axis=1)
        cov = float(np.mean(dmin < radius))
        assert abs(neighbors.coverage(real, fake, cols, k) - cov) < 1e-12


def test_auto_k_equals_pairwise_definition(spark):
    rng = np.random.default_rng(3)
    X = rng.integers(0, 3, size=(200, 2)).astype(float)
    cols = ["a", "b"]
    df = spark.createDataFrame(pd.DataFrame(X, columns=cols))
    D = np.abs(X[:, None, :] - X[None, :, :]).sum(-1)
    k, cov = 1, 0.0
    while cov < 0.95:  # the reference's loop: coverage of the set by itself, then one more
        radius = np.sort(D, axis=1)[:, k]
        cov = float(np.mean(D.min(axis=1) < radius))
        k += 1
    assert neighbors.auto_k(df, cols) == k


def test_solvers_closed_form():
    a, x0, n_t = 0.5, np.array([-2.0, 0.0, 3.0]), 11
    h = 1.0 / (n_t - 1)
    e = solvers.euler_np(x0.copy(), lambda lvl, x: a - x, n_t, steps="n_t-1")
    assert np.allclose(e, a + (x0 - a) * (1 - h) ** (n_t - 1))
    r = solvers.rk4_np(x0.copy(), lambda lvl, x: a - x, n_t)
    assert np.allclose(r, a + (x0 - a) * np.exp(-1.0), atol=1e-6)
    # reference's sequential Euler integrates n_t steps
    e2 = solvers.euler_np(x0.copy(), lambda lvl, x: a - x, n_t, steps="n_t")
    assert np.allclose(e2, a + (x0 - a) * (1 - h) ** n_t)


def test_rk4_half_step_levels():
    assert [solvers.level_of(i, True, 50) for i in range(4)] == [0, 2, 2, 4]


def test_knn_with_onehot_columns_matches_brute_force(spark):
    rng = np.random.default_rng(5)
    n = 150
    cont = rng.random(n).round(3)
    cat = rng.integers(0, 3, n)
    X = np.column_stack([cont, *[(cat == j) * 0.5 for j in range(3)]])
    X[::5] = X[1]
    Fk = np.column_stack([rng.random(100).round(3), *[(rng.integers(0, 3, 100) == j) * 0.5 for j in range(3)]])
    cols = ["x", "d0", "d1", "d2"]
    real = spark.createDataFrame(pd.DataFrame(X, columns=cols).assign(row_id=np.arange(n)))
    fake = spark.createDataFrame(pd.DataFrame(Fk, columns=cols).assign(row_id=np.arange(len(Fk))))
    D = np.abs(X[:, None, :] - X[None, :, :]).sum(-1)
    for k in (2, 5):
        radius = np.sort(D, axis=1)[:, k]
        dmin = np.abs(X[:, None, :] - Fk[None, :, :]).sum(-1).min(axis=1)
        want = float(np.mean(dmin < radius))
        got = neighbors.coverage(real, fake, cols, k)
        assert abs(got - want) < 1e-12


def _l1(a, b):
    return np.abs(a[:, None, :] - b[None, :, :]).sum(-1)


def test_cells_are_exact_over_leaves_parts_copies_and_groups(spark, monkeypatch):
    rng = np.random.default_rng(11)
    X = np.round(rng.normal(size=(900, 3)) * rng.choice([0.1, 1, 10], (900, 1)), 3)
    g = rng.integers(0, 2, 900)
    df = spark.createDataFrame(pd.DataFrame(X, columns=list("abc")).assign(row_id=np.arange(900), grp=g))
    monkeypatch.setattr(neighbors, "CELL", 40)
    monkeypatch.setattr(neighbors, "SHARE", 25)
    pts = neighbors.dedupe_points(df, list("abc"), "row_id", "grp")
    got = {(r.grp, r.pid): r.radius for r in neighbors.knn_radius(pts, list("abc"), 4, "grp").collect()}
    for i in (0, 1):
        ids = np.flatnonzero(g == i)
        D = np.sort(_l1(X[ids], X[ids]), axis=1)[:, 4]
        assert all(np.isclose(got[i, r], d) for r, d in zip(ids.tolist(), D) if (i, r) in got)
    assert len(got) == pts.count()


def test_boxes_spare_pairs_on_a_clustered_column(spark, monkeypatch):
    rng = np.random.default_rng(12)
    X = np.concatenate([rng.normal(c, 0.01, (500, 2)) for c in (0, 5, 10, 15, 20, 25, 30, 35)])
    monkeypatch.setattr(neighbors, "CELL", 100)
    df = spark.createDataFrame(pd.DataFrame(X, columns=["a", "b"]).assign(pid=np.arange(4000), m=1))
    cells = neighbors.Cells(df, ["a", "b"])
    asked = cells.queries(df)
    first = cells.meet(cells.visits(asked, True), 6)
    near = asked.drop("lim").join(neighbors._reached(first, 6).withColumnRenamed("dist", "lim"), ["g", "pid"])
    n = near.select("g", "pid", "lim", "x")
    visited = cells.visits(n, False).count() + 4000
    assert visited < 4000 * 4 and len(cells.leaves) >= 32            # of 32 cells and more, fewer than 4 a point


def test_a_missing_coordinate_raises(spark):
    df = spark.createDataFrame([(i, float(i), None if i == 3 else 1.0) for i in range(9)], "row_id long, a double, b double")
    with pytest.raises(RuntimeError):
        neighbors.nearest_distance(df, df, ["a", "b"])


def test_transport_lies_between_its_bounds(spark):
    from itertools import permutations
    rng = np.random.default_rng(8)
    for n, same in ((6, 0), (7, 3)):
        P, Q = rng.normal(size=(n, 2)), rng.normal(size=(n, 2)) + 0.5
        Q[:same] = P[:same]
        D = _l1(P, Q)
        exact = min(sum(D[i, j] for i, j in enumerate(o)) for o in permutations(range(n))) / n
        p, q = (spark.createDataFrame(pd.DataFrame(a, columns=["a", "b"])) for a in (P, Q))
        lower = transport.wasserstein1_lower(p, q, ["a", "b"]).first()[0]
        upper = transport.wasserstein1_upper(p, q, ["a", "b"], levels=9).first()[0]
        assert lower <= exact + 1e-9 and exact <= upper + 1e-9 and upper < 6 * exact
    assert transport.wasserstein1_upper(p, p, ["a", "b"]).first()[0] == 0
    assert transport.wasserstein1_upper(p, q.limit(0), ["a", "b"]).first()[0] is None


@pytest.mark.parametrize("pairs", [1 << 21, 64])
def test_near_boxes_are_those_of_all_leaves_and_far_subtrees_are_skipped(monkeypatch, pairs):
    monkeypatch.setattr(neighbors, "PAIRS", pairs)
    rng = np.random.default_rng(5)
    x = np.column_stack([rng.uniform(0, 1, 4000), np.where(rng.random(4000) < 0.3, 0.5, 0.0), rng.normal(size=4000)])
    tree = neighbors.Tree(x[::3], 7)
    leaf = tree.leaf(x[1::3])
    leaves = np.unique(leaf)[::2]                   # some leaves hold nothing
    low, high = (np.array([f(x[1::3][leaf == v], axis=0) for v in leaves]) for f in (np.min, np.max))
    boxes = neighbors.Boxes(7, leaves, low, high)
    q, limit = x[2::3], rng.uniform(0, 0.3, len(x[2::3]))
    limit[:3] = np.inf
    gap = np.maximum(np.maximum(low[None] - q[:, None], q[:, None] - high[None]), 0.0)
    dist = gap[..., 0] + gap[..., 1] + gap[..., 2]
    row, cell = np.nonzero(dist < limit[:, None])
    got = boxes.near(q, limit)
    assert sorted(zip(*(v.tolist() for v in got))) == sorted(zip(row.tolist(), leaves[cell].tolist()))
    gone = neighbors.Boxes(7, leaves, low, high)
    gone.low[1], gone.high[1] = np.inf, -np.inf     # the left half is far: nothing below it may come
    assert (gone.near(q, limit)[1] >= 64).all()
