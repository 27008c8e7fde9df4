"""Flow-matching generators on boosted trees: sequential (HS3F / CS3F) and joint.

fit:
  clean (B1, B4) -> dictionaries (A9) -> bounds + min-max (C1, C3) ->
  fixed quantile bins of the conditioning columns (one approxQuantile job) ->
  forward expansion rows x K x n_t (D1-D4, hash noise) -> x_t bins per
  (column, level) -> all regressors in one boosting run (E1/E4/E5), all
  classifiers in another (E2), label and first-column frequencies (E3, F1).
sample:
  ``spark.range(n)`` -> label / first category by range join on cumulative
  shares -> prior noise + uniforms as hash columns -> one ``mapInPandas``
  (trees read by page, vectorised scoring, Euler / RK4 per batch) ->
  postprocess (C2, C7, C9, C10).  One narrow stage after the draws; no shuffle
  of the generated rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import ClassVar

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.noise import hash_normal, hash_normals, hash_uniform, np_hash_normal
from ..operators import clean, encode, forward
from ..sampling import draws, solvers
from ..sampling.postprocess import Postprocessor
from ..session import KEPT
from ..spec import TableSpec
from . import paged
from .bagging import ForestParams, fit_bagged
from .hist_boost import Block, BoostedForest, BoostParams, columns_of, fit_expanded, predict_margin

INF = float("inf")
ROWS_PER_PARTITION = 4_000_000  # expanded training rows per task
GENERATED_PER_PARTITION = 200_000  # generated rows per sampling task (each runs n_t model steps)
SKETCH_CELLS = 2048  # cells of the mergeable quantile sketch of mini-batch fits (error: one cell)


def generation_partitions(spark, n: int, partitions: int | None = None) -> int:
    """Tasks for ``spark.range(n)``: grows with n, at least the parallelism."""
    if partitions:
        return partitions
    return max(spark.sparkContext.defaultParallelism, -(-n // GENERATED_PER_PARTITION))


def spread(df: DataFrame, n_rows: int, expansion: int, key: str = "row_id") -> DataFrame:
    """Hash-partition the real rows before the K x n_t expansion so that
    every task expands a slice: ``explode`` never splits a partition, so a
    one-file table would otherwise be expanded and boosted by a single task."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    waves = max(-(-n_rows * expansion // (ROWS_PER_PARTITION * cores)), 1)
    return df.repartition(cores * waves, key)


# ---- binning -------------------------------------------------------------------

def bin_expr(x: Column, edges: list[float]) -> Column:
    """1 + number of edges < x (binary search as nested CASE); missing -> 0."""
    def lb(lo, hi):
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(x <= F.lit(float(edges[mid])), lb(lo, mid)).otherwise(lb(mid + 1, hi))
    if not edges:
        return F.when(x.isNull() | F.isnan(x), F.lit(0)).otherwise(F.lit(1))
    return F.when(x.isNull() | F.isnan(x), F.lit(0)).otherwise(lb(0, len(edges)) + 1)


def thresholds_from_edges(edges: list[float], n_bins: int) -> np.ndarray:
    """thr[b] for split bin b (left iff x <= thr[b])."""
    thr = np.full(n_bins + 2, INF)
    thr[0] = -INF
    for i, e in enumerate(edges, start=1):
        thr[i] = e
    return thr


def quantile_edges(df: DataFrame, cols: list[str], n_bins: int, categorical: dict) -> dict:
    """Fixed bin edges per column: quantiles (one job) or one bin per code."""
    edges = {}
    num = [c for c in cols if c not in categorical]
    if num:
        probs = [i / n_bins for i in range(1, n_bins)]
        qs = df.approxQuantile(num, probs, 1.0 / (4 * n_bins))
        for c, q in zip(num, qs):
            edges[c] = sorted(set(float(v) for v in q if v is not None and not np.isnan(v)))
    for c, n_codes in categorical.items():
        if c in cols:
            edges[c] = [float(i) for i in range(max(n_codes - 1, 0))]
    return edges


def code_expr(col: str, values: list) -> Column:
    """Category value -> code (dictionary of a categorical column, schema-sized)."""
    pairs = []
    for i, v in enumerate(values):
        pairs += [F.lit(v), F.lit(i)]
    return F.element_at(F.create_map(*pairs), F.col(col)) if values else F.lit(None).cast("int")


# ---- shared preparation --------------------------------------------------------

@dataclass
class Prepared:
    spec: TableSpec
    names: list
    kinds: list
    label: str | None
    label_values: list
    dictionaries: dict
    bounds: dict
    real: DataFrame  # row_id, lab, x0..x{c-1} (model space)
    n_rows: int
    clip: dict = field(default_factory=dict)    # given bounds: for clipping only
    types: dict = field(default_factory=dict)   # declared types of the input columns


def effective_spec(spec: TableSpec, label_cond: bool) -> TableSpec:
    """Without label conditioning (or with a non-categorical label) the label is
    generated like any other column, appended last (B6)."""
    lab = spec.label
    if lab is None or (label_cond and lab.kind == "categorical"):
        return spec
    from dataclasses import replace
    cols = [c for c in spec.columns if c.name != lab.name] + [replace(lab, role="target")]
    return replace(spec, columns=tuple(cols))


def with_row_id(df: DataFrame, name: str, cols: list[str]) -> DataFrame:
    """``df`` with its key column; without one, equal rows are numbered and the key is a hash of row and number
    (the same after a recomputation, whatever the partitioning)."""
    if name in df.columns:
        return df
    h = F.xxhash64(*[F.col(c).cast("string") for c in cols])
    n = F.row_number().over(Window.partitionBy("__h").orderBy("__h"))
    return df.withColumn("__h", h).withColumn(name, F.xxhash64("__h", n)).drop("__h")


def prepare(df: DataFrame, spec: TableSpec, label_cond: bool, scale_categorical: bool = False,
            drop_missing: bool = True) -> Prepared:
    spec = effective_spec(spec, label_cond)
    gen = spec.generated
    names = [c.name for c in gen]
    kinds = [c.kind for c in gen]
    label = spec.label.name if (label_cond and spec.label is not None
                                and spec.label.kind == "categorical") else None
    keep = names + ([label] if label else [])
    d = clean.nan_to_null(df, keep)
    if drop_missing:
        d = d.na.drop("any", subset=keep)
    elif label:
        clean.assert_label_present(d, label)
    dicts = {c.name: encode.category_values(d, c.name) for c in gen if c.kind == "categorical"}
    label_values = encode.category_values(d, label) if label else [0]
    num = [c.name for c in gen if c.kind != "categorical"]
    given = {c.name: (c.min, c.max) for c in gen if c.min is not None and c.max is not None}
    bounds = encode.data_bounds(d, num) if num else {}
    cols = []
    for i, c in enumerate(gen):
        if c.kind == "categorical":
            cols.append(code_expr(c.name, dicts[c.name]).cast("double").alias(f"x{i}"))
        else:
            cols.append(encode.scale_expr(F.col(c.name).cast("double"), *bounds[c.name]).alias(f"x{i}"))
    lab = code_expr(label, label_values).cast("int") if label else F.lit(0)
    d = with_row_id(d, spec.row_id, keep)
    real = d.select(F.col(spec.row_id).cast("long").alias("row_id"), lab.alias("lab"), *cols)
    real = real.persist(KEPT)
    n = real.count()
    return Prepared(spec, names, kinds, label, label_values, dicts, bounds, real, n, given, dict(df.dtypes))


def _shares(df: DataFrame, col: str) -> list[tuple]:
    """(code, lo, hi) per category code -- one row per category."""
    sh = draws.cumulative_shares(df, col).orderBy(col).collect()
    return [(int(r[col]), float(r["lo"]), float(r["hi"])) for r in sh]


def _draw_codes(rows: DataFrame, shares: list[tuple], u: Column, out: str) -> DataFrame:
    spark = rows.sparkSession
    sh = spark.createDataFrame(shares, f"{out} int, lo double, hi double")
    return draws.interval_join(rows.withColumn("__u", u), sh, "__u").drop("__u")


# ---- examples of a batch of real rows ---------------------------------------------

def level_times(n_t: int, t_0: float = forward.T0) -> np.ndarray:
    """D1 as numbers (the levels of ``forward.level_time``)."""
    return np.ones(1) if n_t == 1 else t_0 + np.arange(n_t) * ((1.0 - t_0) / (n_t - 1))


def slice_of(n_batch: int, seed: int) -> Column:
    """The slice of a real row in a mini-batch fit."""
    return F.floor(hash_uniform("slice", seed, F.col("row_id")) * F.lit(n_batch)).cast("long")


def noise_array(seed: int, copies: int, feature: int, n_batch: int = 0) -> Column:
    """The K noise draws of a row for one column (the keys of D3), as an array: all levels share them.  In a mini-batch
    fit the copies are epochs, and the keys are (row, epoch, column, slice)."""
    if n_batch > 0:
        return hash_normals(copies, "x0-mb", lambda d: (seed, F.col("row_id"), d, feature, F.col("slice")))
    return hash_normals(copies, "x0", lambda d: (seed, F.col("row_id"), d, feature))


def _stack(series, width: int) -> np.ndarray:
    if isinstance(series, np.ndarray):      # a column of ``Columns``: stacked already
        return series.astype(np.float64)
    return np.concatenate(list(series)).astype(np.float64).reshape(len(series), -1) if len(series) else np.zeros((0, width))


def _columns(bins: np.ndarray) -> list[np.ndarray]:
    """One array per input, the same one for every block that reads it."""
    return [np.ascontiguousarray(bins[:, j:j + 1]) for j in range(bins.shape[1])]


@dataclass
class Grid:
    """Bins of one input at one level: even cells from ``mn``, and the bin of each cell where cells share bins."""
    mn: float
    width: float
    cells: int
    edges: list | None = None    # last cells of the bins but the last one

    def bins(self, x: np.ndarray) -> np.ndarray:
        """1, 2, ...; 0 = missing."""
        b = np.clip(np.ceil((x - self.mn) / self.width), 1, self.cells)
        b = np.where(np.isnan(b), 0, b).astype(np.int32)
        if self.edges is None:
            return b
        of = np.searchsorted(self.edges, np.arange(self.cells + 1), side="left").astype(np.int32) + 1
        of[0] = 0
        return of[b]

    def thresholds(self, size: int) -> np.ndarray:
        """thr[b] of split bin b: a row goes left if x <= thr[b]."""
        last = np.arange(1, self.cells) if self.edges is None else np.asarray(self.edges, float)
        thr = np.full(size, INF)
        thr[0] = -INF
        thr[1:len(last) + 1] = self.mn + self.width * last
        return thr


@dataclass
class PathExamples:
    """Regression examples of the sequential flow: per (column, level), inputs (x_t, earlier columns), target x1 - x0."""
    arrow: ClassVar[bool] = True
    feats: list
    n_labels: int
    copies: int
    n_bins: int
    times: np.ndarray
    edges: dict | None = None    # (position, level) -> Grid

    @property
    def trees(self) -> int:
        return len(self.feats) * self.n_labels * len(self.times)

    def paths(self, pdf):
        for pos, k in enumerate(self.feats):
            x1 = np.asarray(pdf[f"x{k}"], np.float64)[:, None]
            z = _stack(pdf[f"z{k}"], self.copies)
            y = x1 - z
            for level, t in enumerate(self.times):
                yield pos, k, level, t * x1 + (1 - t) * z, y

    def blocks(self, pdf):
        fixed = _columns(_stack(pdf["fb"], 1).astype(np.int32))
        lab = np.asarray(pdf["lab"], np.int64)
        for pos, k, level, xt, y in self.paths(pdf):
            own = self.edges[(pos, level)].bins(xt)
            yield Block((pos * self.n_labels + lab) * len(self.times) + level,
                        [own, *fixed[:k]], y)


@dataclass
class CategoryExamples:
    """Classifier examples of the sequential flow: per column, inputs the earlier columns, target the code.  A row with a
    column ``n`` stands for that many equal ones."""
    arrow: ClassVar[bool] = True
    feats: list
    n_labels: int
    codes: list
    weight: float

    @property
    def trees(self) -> int:
        return self.n_labels * sum(self.codes)

    def blocks(self, pdf):
        fixed = _columns(_stack(pdf["fb"], 1).astype(np.int32))
        lab = np.asarray(pdf["lab"], np.int64)
        w = np.asarray(pdf["n"], np.float64)[:, None] * self.weight if "n" in pdf else self.weight
        for pos, k in enumerate(self.feats):
            yield Block(pos * self.n_labels + lab, fixed[:k],
                        np.asarray(pdf[f"x{k}"], np.float64)[:, None], w, self.codes[pos])

    def equal_rows(self, state: DataFrame) -> DataFrame:
        """One row for all that no classifier tells apart (the inputs are bins), with their number ``n``."""
        last = max(self.feats)
        return state.groupBy("lab", F.slice("fb", 1, last).alias("fb"), *[f"x{k}" for k in self.feats]).agg(
            F.count(F.lit(1)).alias("n"))


@dataclass
class JointExamples:
    """Regression examples of the joint flow: per (level, output), inputs all columns at x_t and the covariates."""
    arrow: ClassVar[bool] = True
    n_cols: int
    n_cov: int
    copies: int
    n_bins: int
    times: np.ndarray
    edges: dict | None = None    # (column, level) -> Grid

    def paths(self, pdf):
        x = [np.asarray(pdf[f"x{j}"], np.float64)[:, None] for j in range(self.n_cols)]
        z = [_stack(pdf[f"z{j}"], self.copies) for j in range(self.n_cols)]
        y = [a - b for a, b in zip(x, z)]
        for level, t in enumerate(self.times):
            yield level, [t * a + (1 - t) * b for a, b in zip(x, z)], y

    def blocks(self, pdf):
        cov = _columns(_stack(pdf["cb"], 1).astype(np.int32)) if self.n_cov else []
        lab = np.asarray(pdf["lab"], np.int64)
        for level, xt, y in self.paths(pdf):
            bins = [self.edges[(j, level)].bins(v) for j, v in enumerate(xt)] + cov
            for k in range(self.n_cols):
                yield Block((lab * len(self.times) + level) * self.n_cols + k, bins, y[k])


def _cells(examples, pdf):
    """(position, level, x_t without missing values) of a batch."""
    for got in examples.paths(pdf):
        found = [(j, got[0], x) for j, x in enumerate(got[1])] if isinstance(examples, JointExamples) \
            else [(got[0], got[2], got[3])]
        for pos, level, x in found:
            gone = np.isnan(x)
            x = x[~gone] if gone.any() else x.ravel()
            if x.size:
                yield pos, level, x


def _path_edges(state: DataFrame, examples, n_bins: int, quantiles: bool = False) -> dict:
    """The grid of x_t for each (column, level), from one pass over the examples: ``n_bins`` even bins, or with
    ``quantiles`` (mini-batch fits) bins of about equal counts from a sketch that adds up over tasks."""
    def ranges(batches):
        import pandas as pd
        import pyarrow as pa
        schema = pa.schema([("pos", pa.int32()), ("level", pa.int32()), ("mn", pa.float64()), ("mx", pa.float64())])
        for batch in batches:
            out = [(pos, level, float(x.min()), float(x.max())) for pos, level, x in _cells(examples, columns_of(batch))]
            yield pa.RecordBatch.from_pandas(pd.DataFrame(out, columns=schema.names), schema, preserve_index=False)
    got = state.mapInArrow(ranges, "pos int, level int, mn double, mx double").groupBy("pos", "level").agg(
        F.min("mn").alias("mn"), F.max("mx").alias("mx")).collect()
    cells = SKETCH_CELLS if quantiles else n_bins
    found = {(r["pos"], r["level"]): Grid(r["mn"], max((r["mx"] - r["mn"]) / cells, 1e-12), cells) for r in got}
    if quantiles:
        for (pos, level), edges in _sketch(state, examples, found, n_bins).items():
            found[(pos, level)].edges = edges
    n = examples.n_cols if isinstance(examples, JointExamples) else len(examples.feats)
    return {(i, lv): found.get((i, lv), Grid(0.0, 1e-12, n_bins)) for i in range(n) for lv in range(len(examples.times))}


def _sketch(state: DataFrame, examples, grids: dict, n_bins: int) -> dict:
    """Quantile cells of each (position, level): tasks count examples per fine cell, Spark adds the counts up, and a
    cell is an edge if a multiple of the total over ``n_bins`` falls into it.  What is collected are the edges."""
    def count(batches):
        import pandas as pd
        held: dict = {}

        def rows():
            parts = [(k, np.flatnonzero(v)) for k, v in held.items()]
            return pd.DataFrame({"pos": np.repeat([k[0] for k, _ in parts], [len(c) for _, c in parts]),
                                 "level": np.repeat([k[1] for k, _ in parts], [len(c) for _, c in parts]),
                                 "cell": np.concatenate([c for _, c in parts]),
                                 "n": np.concatenate([held[k][c] for k, c in parts])})
        for pdf in batches:
            for pos, level, x in _cells(examples, pdf):
                n = np.bincount(grids[(pos, level)].bins(x), minlength=SKETCH_CELLS + 1)
                held[(pos, level)] = held[(pos, level)] + n if (pos, level) in held else n
            if len(held) * SKETCH_CELLS * 8 > 64 << 20:
                yield rows()
                held.clear()
        if held:
            yield rows()
    w = Window.partitionBy("pos", "level")
    cells = state.mapInPandas(count, "pos int, level int, cell long, n long").groupBy("pos", "level", "cell").agg(
        F.sum("n").alias("n"))
    cum = cells.select("pos", "level", "cell", "n", F.sum("n").over(w.orderBy("cell")).alias("upto"),
                       F.sum("n").over(w).alias("total"))
    edge = F.expr(f"least(upto * {n_bins} div total, {n_bins - 1}) > (upto - n) * {n_bins} div total")
    rows = cum.filter(edge).groupBy("pos", "level").agg(F.sort_array(F.collect_list("cell")).alias("cells")).collect()
    return {(r["pos"], r["level"]): list(r["cells"]) for r in rows}   # at most n_bins - 1 each


def _fit_models(learner: str, state: DataFrame, examples, p: BoostParams, n_bins: int, seed: int) -> BoostedForest:
    """All models of an expander, boosted or bagged with the same number and depth of trees (classifiers try the root
    of the number of inputs at a node).  A cached ``state`` is let go once its examples are packed."""
    if learner == "boosted":
        return fit_expanded(state, examples, p, n_bins, release=True)
    if learner != "forest":
        raise ValueError("learner must be boosted or forest")
    features = "sqrt" if p.objective == "softmax" else 1.0
    return fit_bagged(state, examples, ForestParams(p.n_rounds, p.depth, features=features, seed=seed), n_bins)


# ---- sequential flow (HS3F / CS3F) ---------------------------------------------

@dataclass
class SequentialFlow:
    """Column-by-column flow (HS3F: classifiers for categorical columns; CS3F:
    every column through the ODE, codes rounded at the end)."""
    model_type: str = "HS3F"
    n_t: int = 50
    K: int = 100
    label_cond: bool = True
    seed: int = 0
    n_bins: int = 64
    reg: BoostParams = field(default_factory=lambda: BoostParams(n_rounds=100, depth=7, eta=0.3, lam=0.0))
    clf: BoostParams | None = None  # default: n_rounds + 15 trees, eta 0.1, softmax
    n_batch: int = 0  # >0: mini-batch fit (E7): slices x K epochs, quantile bins, classifier without the +15 trees
    learner: str = "boosted"  # or "forest": bagged trees (E6)
    t_0: float = forward.T0  # first level time
    learner_params: dict = field(default_factory=dict)  # E9: learner parameters by name, for both kinds of trees

    def _clf_params(self) -> BoostParams:
        if self.clf is not None:
            return self.clf
        extra = 0 if self.n_batch > 0 or self.learner == "forest" else 15
        return BoostParams(n_rounds=self.reg.n_rounds + extra, depth=self.reg.depth, eta=0.1, lam=self.reg.lam,
                           objective="softmax", checkpoint_every=self.reg.checkpoint_every)

    def fit(self, df: DataFrame, spec: TableSpec, kinds: tuple = ("velocity", "category")) -> "FittedSequential":
        """``kinds``: the models to train; a flow generates rows only with both."""
        if self.model_type not in ("HS3F", "CS3F"):
            raise ValueError("model_type must be HS3F or CS3F")
        prep = prepare(df, spec, self.label_cond)
        c = len(prep.names)
        is_cat = [k == "categorical" for k in prep.kinds]
        hetero = self.model_type == "HS3F"
        reg_feats = [k for k in range(c) if not (hetero and is_cat[k])] if "velocity" in kinds else []
        clf_feats = [k for k in range(1, c) if hetero and is_cat[k]] if "category" in kinds else []
        n_codes = {f"x{k}": len(prep.dictionaries[prep.names[k]]) for k in range(c) if is_cat[k]}
        width = max([self.n_bins, *n_codes.values()])  # a category has a bin of its own, however many there are
        xcols = [f"x{k}" for k in range(c)]
        fixed = quantile_edges(prep.real, xcols, self.n_bins, n_codes)
        L = len(prep.label_values)
        real = spread(prep.real, prep.n_rows, self.K * self.n_t * len(reg_feats) or 1)     # classifiers: rows as they are
        real = real.withColumn("fb", F.array(*[bin_expr(F.col(f"x{k}"), fixed[f"x{k}"]) for k in range(c)]))

        if self.n_batch > 0:
            real = real.withColumn("slice", slice_of(self.n_batch, self.seed))
        state = real.select("row_id", "lab", "fb", *[f"x{k}" for k in range(c)],
                            *[noise_array(self.seed, self.K, k, self.n_batch).alias(f"z{k}") for k in reg_feats])

        # regressors: one per (regression column, label, level)
        reg_forest, xt_edges = None, {}
        if reg_feats:
            state = state.persist(KEPT)
            examples = PathExamples(reg_feats, L, self.K, self.n_bins, level_times(self.n_t, self.t_0))
            xt_edges = examples.edges = _path_edges(state, examples, self.n_bins, self.n_batch > 0)
            reg_forest = _fit_models(self.learner, state, examples, self.reg.with_params(self.learner_params), width,
                                     self.seed)

        # classifiers: one per (categorical column k >= 1, label) -- rows used once with weight K,
        # which is what K identical copies amount to
        clf_forest = None
        if clf_feats:
            examples = CategoryExamples(clf_feats, L, [n_codes[f"x{k}"] for k in clf_feats], float(self.K))
            p = self._clf_params().with_params(self.learner_params)
            rows = state.select("row_id", "lab", "fb", *[f"x{k}" for k in clf_feats])
            if self.learner == "boosted" and p.subsample == 1:      # no draw needs to tell equal rows apart
                rows = examples.equal_rows(rows)
            clf_forest = _fit_models(self.learner, rows, examples, p, width, self.seed)
        state.unpersist()

        label_shares = _shares(prep.real, "lab")
        first_shares = _shares(prep.real.withColumn("c0", F.col("x0").cast("int")), "c0") \
            if (hetero and is_cat[0]) else None
        post = Postprocessor(prep.spec.with_roles(**({prep.label: "label"} if prep.label else {})),
                             prep.bounds, prep.dictionaries, prep.clip, prep.types)
        prep.real.unpersist()
        return FittedSequential(self, prep, reg_feats, clf_feats, fixed, xt_edges, reg_forest, clf_forest,
                                label_shares, first_shares, post)


@dataclass
class FittedSequential:
    params: SequentialFlow
    prep: Prepared
    reg_feats: list
    clf_feats: list
    fixed_edges: dict
    xt_edges: dict
    reg_forest: BoostedForest | None
    clf_forest: BoostedForest | None
    label_shares: list
    first_shares: list | None
    post: Postprocessor

    def _payload(self):
        p = self.params
        c = len(self.prep.names)
        nb = p.n_bins
        wide = max([nb, *[len(e) + 1 for e in self.fixed_edges.values()]])
        fixed_thr = np.stack([thresholds_from_edges(self.fixed_edges[f"x{k}"], wide) for k in range(c)]) \
            if c else np.zeros((0, wide + 2))
        xt_thr = {at: grid.thresholds(wide + 2) for at, grid in self.xt_edges.items()}
        return dict(model_type=p.model_type, n_t=p.n_t, c=c,
                    is_cat=[k == "categorical" for k in self.prep.kinds],
                    reg_feats=self.reg_feats, clf_feats=self.clf_feats, L=len(self.prep.label_values),
                    fixed_thr=fixed_thr, xt_thr=xt_thr, reg=self.reg_forest, clf=self.clf_forest,
                    n_codes=[len(self.prep.dictionaries.get(n, [])) for n in self.prep.names])

    def raw_sample(self, n: int | DataFrame, seed: int = 0, solver: str = "euler",
                   euler_steps: str = "n_t", partitions: int | None = None) -> DataFrame:
        """Generated rows in model space: row_id, lab, x0..x{c-1}."""
        spark = self.prep.real.sparkSession
        if isinstance(n, DataFrame):
            rows = n.select(F.col(n.columns[0]).cast("long").alias("row_id"))
        else:
            rows = spark.range(0, n, numPartitions=generation_partitions(spark, n, partitions)) \
                .withColumnRenamed("id", "row_id")
        rows = _draw_codes(rows, self.label_shares, hash_uniform("label", seed, F.col("row_id")), "lab")
        c = len(self.prep.names)
        if self.first_shares is not None:
            rows = _draw_codes(rows, self.first_shares, hash_uniform("first", seed, F.col("row_id")), "first")
        else:
            rows = rows.withColumn("first", F.lit(0))
        rows = rows.select("row_id", "lab", "first",
                           *[hash_normal("prior", seed, F.col("row_id"), k).alias(f"z{k}") for k in range(c)],
                           *[hash_uniform("cat", seed, F.col("row_id"), k).alias(f"u{k}") for k in range(c)])
        bc = spark.sparkContext.broadcast(paged.payload(spark, self, ("reg", "clf")))
        schema = "row_id long, lab int, " + ", ".join(f"x{k} double" for k in range(c))

        def run(batches, _bc=bc, _solver=solver, _steps=euler_steps):
            pay = _bc.value
            for pdf in paged.gathered(batches, pay, ("reg", "clf")):
                yield _sequential_batch(pdf, pay, _solver, _steps)
        return rows.mapInPandas(run, schema)

    def sample(self, n: int | DataFrame, seed: int = 0, solver: str = "euler", euler_steps: str = "n_t",
               partitions: int | None = None) -> DataFrame:
        """generated rows with the input's column names and values."""
        raw = self.raw_sample(n, seed, solver, euler_steps, partitions)
        names = self.prep.names
        raw = raw.select("row_id", "lab", *[F.col(f"x{k}").alias(names[k]) for k in range(len(names))])
        out = self.post.transform(raw, dummy_coded=False, round_codes=(self.params.model_type == "CS3F"))
        if self.prep.label:
            vals = F.array(*[F.lit(v) for v in self.prep.label_values])
            out = out.withColumn(self.prep.label, F.element_at(vals, F.col("lab") + 1))
        return out.drop("lab")


def _softmax(m: np.ndarray) -> np.ndarray:
    m = m - m.max(axis=1, keepdims=True)
    e = np.exp(m)
    return e / e.sum(axis=1, keepdims=True)


def _sequential_batch(pdf, pay, solver, euler_steps):
    import pandas as pd
    n = len(pdf)
    c, n_t, L = pay["c"], pay["n_t"], pay["L"]
    hetero = pay["model_type"] == "HS3F"
    lab = pdf["lab"].to_numpy(dtype=np.int64)
    X = np.zeros((n, c))
    reg_pos = {k: i for i, k in enumerate(pay["reg_feats"])}
    clf_pos = {k: i for i, k in enumerate(pay["clf_feats"])}
    for k in range(c):
        if hetero and pay["is_cat"][k]:
            if k == 0:
                X[:, 0] = pdf["first"].to_numpy(dtype=np.float64)
                continue
            u = pdf[f"u{k}"].to_numpy()
            J = pay["n_codes"][k]
            out = np.zeros(n)
            for lv in range(L):
                mask = lab == lv
                if not mask.any():
                    continue
                model = clf_pos[k] * L + lv
                Xin = X[mask, :k]
                thr = pay["fixed_thr"][:k]
                marg = np.stack([predict_margin(pay["clf"], (model, j), Xin, thr) for j in range(J)], axis=1)
                cum = np.cumsum(marg if pay["clf"].objective == "forest" else _softmax(marg), axis=1)
                out[mask] = np.minimum((cum <= u[mask, None]).sum(axis=1), J - 1)
            X[:, k] = out
            continue
        x = pdf[f"z{k}"].to_numpy(dtype=np.float64).copy()
        kpos = reg_pos[k]
        for lv in range(L):
            mask = lab == lv
            if not mask.any():
                continue
            prev = X[mask, :k]

            def vel(level, xv, _prev=prev, _lv=lv):
                model = (kpos * L + _lv) * n_t + level
                thr = np.vstack([pay["xt_thr"][(kpos, level)][None, :], pay["fixed_thr"][:k]])
                Xin = np.column_stack([xv, _prev]) if k else xv[:, None]
                return predict_margin(pay["reg"], (model, 0), Xin, thr)
            if solver == "rk4":
                x[mask] = solvers.rk4_np(x[mask], vel, n_t)
            else:
                x[mask] = solvers.euler_np(x[mask], vel, n_t, steps=euler_steps)
        X[:, k] = x
    res = {"row_id": pdf["row_id"].to_numpy(), "lab": lab.astype(np.int32)}
    for k in range(c):
        res[f"x{k}"] = X[:, k]
    return pd.DataFrame(res)


# ---- joint flow ------------------------------------------------------------------

def _null_dummies(d: DataFrame, dicts: dict) -> DataFrame:
    """C4 drop-first dummies at the end; a missing category gives missing
    dummies (not zeros) so the trees route it as missing."""
    plain = [F.col(c) for c in d.columns if c not in dicts]
    dums = []
    for cn, vals in dicts.items():
        for v in vals[1:]:
            dums.append(F.when(F.col(cn).isNull(), F.lit(None).cast("double"))
                        .when(F.col(cn) == F.lit(v), F.lit(1.0)).otherwise(F.lit(0.0))
                        .alias(encode.dummy_name(cn, v)))
    return d.select(*plain, *dums)


@dataclass
class JointFlow:
    """All columns at once (E4/E5/F8/F10/F11): one regressor per (label, level,
    output column); categorical columns dummy-coded (drop-first) and scaled with
    the rest; covariates are extra inputs, not generated."""
    n_t: int = 50
    K: int = 100
    label_cond: bool = True
    seed: int = 0
    n_bins: int = 64
    remove_missing: bool = False
    n_batch: int = 0  # >0: mini-batch fit (E7): slices x K epochs, quantile bins
    learner: str = "boosted"  # or "forest": bagged trees (E6), for tables without missing values
    t_0: float = forward.T0
    learner_params: dict = field(default_factory=dict)
    reg: BoostParams = field(default_factory=lambda: BoostParams(n_rounds=100, depth=7, eta=0.3, lam=0.0))

    def fit(self, df: DataFrame, spec: TableSpec) -> "FittedJoint":
        spec = effective_spec(spec, self.label_cond)
        gen = spec.generated
        covs = [c.name for c in spec.covariates]
        label = spec.label.name if (self.label_cond and spec.label is not None) else None
        names = [c.name for c in gen]
        d = clean.nan_to_null(df, names + covs + ([label] if label else []))
        d = d.na.drop("any" if self.remove_missing else "all", subset=names)
        if label:
            clean.assert_label_present(d, label)
        if self.learner == "forest" and not d.filter(" or ".join(f"`{c}` is null" for c in names + covs)).isEmpty():
            raise ValueError("a random forest needs a table without missing values")
        cats = [c.name for c in gen if c.kind == "categorical"]
        dicts = {cname: encode.category_values(d, cname) for cname in cats}
        label_values = encode.category_values(d, label) if label else [0]
        # dummy-code (drop first, dummies at the end, C4), then scale everything
        wide_cols = [c.name for c in gen if c.kind != "categorical"]
        dummy_cols = [encode.dummy_name(cn, v) for cn in cats for v in dicts[cn][1:]]
        d2 = _null_dummies(d.select(*([spec.row_id] if spec.row_id in d.columns else []), *names, *covs,
                                    *([label] if label else [])), dicts)
        model_cols = wide_cols + dummy_cols
        given = {c.name: (c.min, c.max) for c in gen if c.min is not None and c.max is not None}
        bounds = encode.data_bounds(d2, model_cols)
        p = len(model_cols)
        lab = code_expr(label, label_values).cast("int") if label else F.lit(0)
        d2 = with_row_id(d2, spec.row_id, model_cols)
        real = d2.select(F.col(spec.row_id).cast("long").alias("row_id"), lab.alias("lab"),
                         *[encode.scale_expr(F.col(m).cast("double"), *bounds[m]).alias(f"x{j}")
                           for j, m in enumerate(model_cols)],
                         *[F.col(cv).cast("double").alias(f"cov{i}") for i, cv in enumerate(covs)])
        n_real = real.count()
        real = spread(real, n_real, self.K * self.n_t * max(len(model_cols), 1)).persist(KEPT)
        real.count()
        cov_edges = quantile_edges(real, [f"cov{i}" for i in range(len(covs))], self.n_bins, {}) if covs else {}
        L = len(label_values)
        cov_bins = F.array(*[bin_expr(F.col(f"cov{i}"), cov_edges[f"cov{i}"]) for i in range(len(covs))])
        if self.n_batch > 0:
            real = real.withColumn("slice", slice_of(self.n_batch, self.seed))
        state = real.select("row_id", "lab", *[f"x{j}" for j in range(p)], cov_bins.cast("array<int>").alias("cb"),
                            *[noise_array(self.seed, self.K, j, self.n_batch).alias(f"z{j}") for j in range(p)])
        state = state.persist(KEPT)
        examples = JointExamples(p, len(covs), self.K, self.n_bins, level_times(self.n_t, self.t_0))
        xt_edges = examples.edges = _path_edges(state, examples, self.n_bins, self.n_batch > 0)
        # An example without target does not train that output
        forest = _fit_models(self.learner, state, examples, self.reg.with_params(self.learner_params), self.n_bins,
                             self.seed)
        state.unpersist()
        label_shares = _shares(real, "lab")
        real.unpersist()
        return FittedJoint(self, spec, names, cats, dicts, model_cols, bounds, label, label_values, covs,
                           cov_edges, xt_edges, forest, label_shares, given, dict(df.dtypes))


@dataclass
class FittedJoint:
    params: JointFlow
    spec: TableSpec
    names: list
    cats: list
    dictionaries: dict
    model_cols: list
    bounds: dict
    label: str | None
    label_values: list
    covs: list
    cov_edges: dict
    xt_edges: dict
    forest: BoostedForest
    label_shares: list
    clip: dict = field(default_factory=dict)
    types: dict = field(default_factory=dict)

    def _payload(self):
        nb, p = self.params.n_bins, len(self.model_cols)
        thr = {}
        for lvl in range(self.params.n_t):
            rows = []
            for j in range(p):
                rows.append(self.xt_edges[(j, lvl)].thresholds(nb + 2))
            for i in range(len(self.covs)):
                rows.append(thresholds_from_edges(self.cov_edges[f"cov{i}"], nb))
            thr[lvl] = np.stack(rows)
        return dict(n_t=self.params.n_t, p=p, L=len(self.label_values), thr=thr, forest=self.forest,
                    n_cov=len(self.covs))

    def _post(self, raw: DataFrame, keep: tuple = ()) -> DataFrame:
        out = raw.select("row_id", "lab", *keep, *[encode.unscale_expr(F.col(f"x{j}"), *self.bounds[m]).alias(m)
                                            for j, m in enumerate(self.model_cols)])
        post = Postprocessor(self.spec, {m: self.bounds[m] for m in self.model_cols if m in self.names},
                             self.dictionaries, self.clip, self.types)
        cols = []
        for c in self.spec.generated:
            if c.kind == "categorical":
                vals = self.dictionaries[c.name]
                cols.append(encode.onehot_decode_expr([encode.dummy_name(c.name, v) for v in vals[1:]], vals)
                            .alias(c.name))
            else:
                cols.append(post.finish(c, F.col(c.name)).alias(c.name))
        res = out.select("row_id", "lab", *keep, *cols)
        if self.label:
            vals = F.array(*[F.lit(v) for v in self.label_values])
            res = res.withColumn(self.label, F.element_at(vals, F.col("lab") + 1))
        return res.drop("lab")

    def raw_sample(self, n: int | DataFrame, seed: int = 0, n_steps: int | None = None,
                   partitions: int | None = None, covariates: list | None = None) -> DataFrame:
        from pyspark.sql import SparkSession
        spark = n.sparkSession if isinstance(n, DataFrame) else SparkSession.builder.getOrCreate()
        if isinstance(n, DataFrame):
            rows = n.select(F.col(n.columns[0]).cast("long").alias("row_id"),
                            *[F.col(cv).cast("double").alias(f"cov{i}") for i, cv in enumerate(covariates or [])])
        else:
            if self.covs:
                raise ValueError("a model with covariates generates one row per covariate row: pass a DataFrame")
            rows = spark.range(0, n, numPartitions=generation_partitions(spark, n, partitions)) \
                .withColumnRenamed("id", "row_id")
        rows = _draw_codes(rows, self.label_shares, hash_uniform("label", seed, F.col("row_id")), "lab")
        p = len(self.model_cols)
        rows = rows.select("row_id", "lab", *[f"cov{i}" for i in range(len(self.covs))],
                           *[hash_normal("prior", seed, F.col("row_id"), j).alias(f"z{j}") for j in range(p)])
        bc = spark.sparkContext.broadcast(paged.payload(spark, self, ("forest",)))
        steps = n_steps or self.params.n_t
        schema = "row_id long, lab int, " + ", ".join(f"x{j} double" for j in range(p))

        def run(batches, _bc=bc, _steps=steps):
            pay = _bc.value
            for pdf in paged.gathered(batches, pay, ("forest",)):
                yield _joint_batch(pdf, pay, _steps)
        return rows.mapInPandas(run, schema)

    def sample(self, n: int | DataFrame, seed: int = 0, n_steps: int | None = None,
               partitions: int | None = None) -> DataFrame:
        """generated rows; ``n`` may be a DataFrame of (id, covariates...)."""
        raw = self.raw_sample(n, seed, n_steps, partitions, self.covs if isinstance(n, DataFrame) else None)
        return self._post(raw)

    def impute(self, df: DataFrame, seed: int = 0) -> DataFrame:
        """fill missing cells of ``df`` (rows keyed by the spec's row id);
        known cells are kept and follow ``t x + (1 - t) noise`` on the path."""
        spec = self.spec
        d = clean.nan_to_null(df, self.names + ([self.label] if self.label else []))
        if self.label:
            clean.assert_label_present(d, self.label)  # a missing label cannot be made up (B4)
        d = d.repartition(spec.row_id, *self.names)    # a table of few files would be filled by as few tasks
        # the known cells travel with their row, as one struct that no Python code reads
        d = d.withColumn("__known", F.struct(*self.names))
        d2 = _null_dummies(d.select(spec.row_id, "__known", *self.names, *self.covs, *([self.label] if self.label else [])),
                           self.dictionaries)
        lab = code_expr(self.label, self.label_values).cast("int") if self.label else F.lit(0)
        p = len(self.model_cols)
        rows = d2.select(F.col("__known"), F.col(spec.row_id).cast("long").alias("row_id"), lab.alias("lab"),
                         *[encode.scale_expr(F.col(m).cast("double"), *self.bounds[m]).alias(f"k{j}")
                           for j, m in enumerate(self.model_cols)],
                         *[F.col(cv).cast("double").alias(f"cov{i}") for i, cv in enumerate(self.covs)],
                         *[hash_normal("prior", seed, F.col(spec.row_id), j).alias(f"z{j}") for j in range(p)])
        bc = rows.sparkSession.sparkContext.broadcast(paged.payload(rows.sparkSession, self, ("forest",)))
        schema = StructType([rows.schema["__known"], *StructType.fromDDL(
            "row_id long, lab int, " + ", ".join(f"x{j} double" for j in range(p))).fields])

        def run(batches, _bc=bc, _seed=seed):
            import pyarrow as pa
            pay = _bc.value
            for batch in batches:
                known, own = batch.columns[0], pa.Table.from_batches([batch]).drop_columns(["__known"])
                new = pa.RecordBatch.from_pandas(_impute_batch(own.to_pandas(), pay, _seed), preserve_index=False)
                yield pa.RecordBatch.from_arrays([known, *new.columns], names=["__known", *new.schema.names])
        out = self._post(rows.mapInArrow(run, schema), ("__known",))
        return out.select("row_id", *[F.coalesce(F.col(f"__known.`{nm}`"), F.col(f"`{nm}`")).alias(nm)
                                      for nm in self.names], *([self.label] if self.label else []))


def _joint_velocity(pay, X, lab, level, cov):
    n, p, L = X.shape[0], pay["p"], pay["L"]
    out = np.zeros_like(X)
    Xin = np.column_stack([X, cov]) if cov is not None and cov.shape[1] else X
    for lv in range(L):
        mask = lab == lv
        if not mask.any():
            continue
        for k in range(p):
            model = (lv * pay["n_t"] + level) * p + k
            out[mask, k] = predict_margin(pay["forest"], (model, 0), Xin[mask], pay["thr"][level])
    return out


def _joint_batch(pdf, pay, n_steps):
    import pandas as pd
    p, n_t = pay["p"], pay["n_t"]
    lab = pdf["lab"].to_numpy(dtype=np.int64)
    X = np.column_stack([pdf[f"z{j}"].to_numpy(dtype=np.float64) for j in range(p)])
    cov = np.column_stack([pdf[f"cov{i}"].to_numpy(dtype=np.float64) for i in range(pay["n_cov"])]) \
        if pay["n_cov"] else None
    h = 1.0 / (n_steps - 1)
    for i in range(n_steps - 1):  # joint Euler: N - 1 steps (F8)
        t = i * h
        level = min(int(np.round(t * (n_t - 1))), n_t - 1)
        X = X + h * _joint_velocity(pay, X, lab, level, cov)
    res = {"row_id": pdf["row_id"].to_numpy(), "lab": lab.astype(np.int32)}
    for j in range(p):
        res[f"x{j}"] = X[:, j]
    return pd.DataFrame(res)


def _impute_batch(pdf, pay, seed):
    import pandas as pd
    p, n_t = pay["p"], pay["n_t"]
    n = len(pdf)
    lab = pdf["lab"].to_numpy(dtype=np.int64)
    known = np.column_stack([pdf[f"k{j}"].to_numpy(dtype=np.float64) for j in range(p)])
    miss = np.isnan(known)
    state = np.column_stack([pdf[f"z{j}"].to_numpy(dtype=np.float64) for j in range(p)])
    cov = np.column_stack([pdf[f"cov{i}"].to_numpy(dtype=np.float64) for i in range(pay["n_cov"])]) \
        if pay["n_cov"] else None
    rid = pdf["row_id"].to_numpy(dtype=np.int64)
    h = 1.0 / (n_t - 1)
    for i in range(n_t - 1):
        t = i * h
        # fresh noise per step for the known cells (deterministic per row / step / column)
        z = np.column_stack([np_hash_normal(seed, rid, i, j) for j in range(p)])
        X = np.where(miss, state, t * np.nan_to_num(known) + (1 - t) * z)
        level = min(int(np.round(t * (n_t - 1))), n_t - 1)
        v = _joint_velocity(pay, X, lab, level, cov)
        state = np.where(miss, state + h * v, state)
    out = np.where(miss, state, known)
    res = {"row_id": rid, "lab": lab.astype(np.int32)}
    for j in range(p):
        res[f"x{j}"] = out[:, j]
    return pd.DataFrame(res)


# ---- model tables (FIXTURES: feature, label, level, output, round, nodes) ---------

def _tree_rows(forest, key, thr, meta):
    feat, sb, dl, leaf = forest.feat[key], forest.sbin[key], forest.dleft[key], forest.leaf[key]
    out = []
    for r in range(forest.n_rounds):
        th = [float(thr[f, b]) if f >= 0 else None for f, b in zip(feat[r], sb[r])]
        out.append((*meta, int(r), [int(x) for x in feat[r]], th, [bool(x) for x in dl[r]],
                    [float(x) for x in leaf[r]], float(forest.base.get(key, 0.0))))
    return out


MODEL_SCHEMA = ("kind string, feature string, label string, level int, output string, round int, "
                "split_input array<int>, threshold array<double>, default_left array<boolean>, "
                "leaf array<double>, base double")


def sequential_model_table(fitted: "FittedSequential"):
    """One row per tree: velocity regressors and category classifiers."""
    pay = fitted._payload()
    prep, L, n_t = fitted.prep, len(fitted.prep.label_values), fitted.params.n_t
    recs = []
    for kpos, k in enumerate(fitted.reg_feats):
        for lv in range(L):
            for level in range(n_t):
                key = ((kpos * L + lv) * n_t + level, 0)
                if fitted.reg_forest is None or key not in fitted.reg_forest.feat:
                    continue
                thr = np.vstack([pay["xt_thr"][(kpos, level)][None, :], pay["fixed_thr"][:k]])
                recs += _tree_rows(fitted.reg_forest, key, thr,
                                   ("velocity", prep.names[k], str(prep.label_values[lv]), level, "velocity"))
    for cpos, k in enumerate(fitted.clf_feats):
        for lv in range(L):
            for j, val in enumerate(prep.dictionaries[prep.names[k]]):
                key = (cpos * L + lv, j)
                if fitted.clf_forest is None or key not in fitted.clf_forest.feat:
                    continue
                recs += _tree_rows(fitted.clf_forest, key, pay["fixed_thr"][:k],
                                   ("category", prep.names[k], str(prep.label_values[lv]), None, str(val)))
    return prep.real.sparkSession.createDataFrame(recs, MODEL_SCHEMA)


def joint_model_table(fitted: "FittedJoint", spark):
    pay = fitted._payload()
    p, L, n_t = len(fitted.model_cols), len(fitted.label_values), fitted.params.n_t
    recs = []
    for lv in range(L):
        for level in range(n_t):
            for k in range(p):
                key = ((lv * n_t + level) * p + k, 0)
                if key not in fitted.forest.feat:
                    continue
                recs += _tree_rows(fitted.forest, key, pay["thr"][level],
                                   ("velocity", fitted.model_cols[k], str(fitted.label_values[lv]), level,
                                    fitted.model_cols[k]))
    return spark.createDataFrame(recs, MODEL_SCHEMA)


def velocity_frame(fitted: "FittedSequential", k: int, level: int, seed: int = 0) -> DataFrame:
    """velocity of column ``k`` at ``level`` for every real row's x_t
    (row routed to its label's model), scored in Arrow batches."""
    prep = fitted.prep
    real = prep.real
    t = forward.level_time(F.lit(level), fitted.params.n_t)
    z = hash_normal("x0", seed, F.col("row_id"), F.lit(0), k)
    rows = real.select("row_id", "lab", (t * F.col(f"x{k}") + (F.lit(1.0) - t) * z).alias("xt"),
                       *[f"x{j}" for j in range(k)])
    bc = real.sparkSession.sparkContext.broadcast(paged.payload(real.sparkSession, fitted, ("reg", "clf")))
    kpos = fitted.reg_feats.index(k)

    def run(batches, _bc=bc):
        import pandas as pd
        pay = _bc.value
        L, n_t = pay["L"], pay["n_t"]
        for pdf in batches:
            lab = pdf["lab"].to_numpy(dtype=np.int64)
            X = np.column_stack([pdf["xt"].to_numpy(dtype=np.float64)]
                                + [pdf[f"x{j}"].to_numpy(dtype=np.float64) for j in range(k)])
            thr = np.vstack([pay["xt_thr"][(kpos, level)][None, :], pay["fixed_thr"][:k]])
            v = np.zeros(len(pdf))
            for lv in range(L):
                mask = lab == lv
                if mask.any():
                    v[mask] = predict_margin(pay["reg"], ((kpos * L + lv) * n_t + level, 0), X[mask], thr)
            yield pd.DataFrame({"row_id": pdf["row_id"].to_numpy(), "xt": X[:, 0], "velocity": v})
    return rows.mapInPandas(run, "row_id long, xt double, velocity double")
