"""Distributed histogram gradient boosting for many small models at once.

The training set of a flow is an *expansion* of the real rows (copies x noise
levels x columns).  An *expander* (a small picklable object) makes the examples
of an Arrow batch once; what is kept of them is packed by chunks of rows: the
bin numbers (one byte an example where they fit), the targets all levels share
and the margins, so that a pass reads arrays instead of rows.  Per round and depth:

* ``mapInArrow``: route the examples of a chunk through the current round's splits, add gradients and hessians into one array per (model, class,
  input); a task sends one packed row per such array;
* the arrays are added up, streaming, by (model, class) -- one shuffle of
  tasks x models x inputs rows whatever the number of real rows -- and the best
  split of every node is searched right there (gain and leaf formulas of Chen &
  Guistrin, KDD 2016, with a learned default direction for missing values);
* the splits (models x nodes rows: the size of the model itself) go to the
  driver and are broadcast to the next pass.

After the last depth the margins are updated with the leaf values ``-eta G / (H
+ lambda)`` in the first pass of the next round.  The state is kept on disk per round
and goes to the checkpoint folder every few rounds, so a lost executor repeats a
few rounds at most.  There is one split search and one way of routing, at every
size; examples of less than ``SMALL`` bytes go through all rounds in one task
(``_boost_here``), as a job per round and depth would take longer than its work.

Objectives: ``squared`` (base score = mean target per model), ``softmax``
(margins of all classes of an example side by side; hessian ``2 p (1 - p)``);
two classes use the binary logistic loss with one tree per round and hessian
``p (1 - p)``, the tree belonging to class 1.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field, fields, replace
from typing import ClassVar

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ON_DISK, materialize

FLUSH_BYTES = 64 << 20   # histogram arrays a task keeps before it sends them
CHUNK = 1 << 18          # margins of a packed chunk of rows at most (a row of more is a chunk of its own)
SMALL = 1 << 21          # bytes of packed examples that one task takes through all rounds
NO_CLASS = np.float32(-1e30)


@dataclass
class BoostParams:
    n_rounds: int = 100
    depth: int = 7
    eta: float = 0.3
    lam: float = 0.0
    alpha: float = 0.0
    min_child_weight: float = 1.0
    gamma: float = 0.0
    subsample: float = 1.0
    objective: str = "squared"  # or "softmax"
    checkpoint_every: int = 4
    base_score: float | None = None  # softmax: margin start (0 = uniform)
    seed: int = 0

    #: fixed values: usual learner parameter names and what they are called here
    ALIASES: ClassVar[dict] = {"n_estimators": "n_rounds", "max_depth": "depth", "learning_rate": "eta", "reg_lambda": "lam",
               "reg_alpha": "alpha", "min_split_loss": "gamma", "random_state": "seed"}

    def with_params(self, params: dict) -> "BoostParams":
        """A copy with parameters given by their usual or their own names; an unknown name raises."""
        known = {f.name for f in fields(self)}
        named = {self.ALIASES.get(k, k): v for k, v in params.items()}
        if set(named) - known:
            raise TypeError(f"unknown learner parameters: {sorted(set(named) - known)}")
        return replace(self, **named)


@dataclass
class BoostedForest:
    """Trees of many models: arrays indexed [round, node] per (model, cls)."""
    depth: int
    n_rounds: int
    objective: str
    base: dict = field(default_factory=dict)     # (model, cls) -> float
    feat: dict = field(default_factory=dict)     # (model, cls) -> int[R, 2^D-1]  (-1 = no split)
    sbin: dict = field(default_factory=dict)     # (model, cls) -> int[R, 2^D-1]
    dleft: dict = field(default_factory=dict)    # (model, cls) -> bool[R, 2^D-1]
    leaf: dict = field(default_factory=dict)     # (model, cls) -> float[R, 2^D]

    def _ensure(self, key):
        if key not in self.feat:
            n_int, n_leaf = 2 ** self.depth - 1, 2 ** self.depth
            self.feat[key] = np.full((self.n_rounds, n_int), -1, dtype=np.int32)
            self.sbin[key] = np.zeros((self.n_rounds, n_int), dtype=np.int32)
            self.dleft[key] = np.ones((self.n_rounds, n_int), dtype=bool)
            self.leaf[key] = np.zeros((self.n_rounds, n_leaf), dtype=np.float64)

    def model(self, key):
        """Base score and (feat, sbin, dleft, leaf) of a model; None for one without trees."""
        trees = (self.feat[key], self.sbin[key], self.dleft[key], self.leaf[key]) if key in self.feat else None
        return self.base.get(key, 0.0), trees


@dataclass
class Block:
    """Examples of one batch that share their inputs' meaning: ``model`` per row, and (rows, copies) arrays.

    ``bins[j]`` has shape (rows, copies) or (rows, 1): 0 = missing, -1 = the example has no input j.
    ``y`` may hold NaN: such an example does not train."""
    model: np.ndarray
    bins: list
    y: np.ndarray
    w: float | np.ndarray = 1.0
    n_class: int = 1
    classes_of: np.ndarray | None = None  # per row, where models of a block differ in their classes
    by_model: tuple | None = None  # models of the block, and the place of each row's among them

    def models(self) -> tuple[np.ndarray, np.ndarray]:
        if self.by_model is None:
            self.by_model = np.unique(self.model, return_inverse=True)
        return self.by_model


def _small(a: np.ndarray) -> np.ndarray:
    """Whole numbers in as few bytes as hold them, contiguous; unsigned if none is negative."""
    if not a.size:
        return a.astype(np.uint8)
    low, high = int(a.min()), int(a.max())
    kinds = (np.int8, np.int16, np.int32) if low < 0 else (np.uint8, np.uint16, np.uint32)
    return np.ascontiguousarray(a, next((k for k in kinds if np.iinfo(k).min <= low and high <= np.iinfo(k).max), np.int64))


class Columns(dict):
    """Columns of an Arrow batch as arrays: numbers (missing: NaN), and lists of one length as (rows, length)."""

    def __init__(self, n: int, *args):
        super().__init__(*args)
        self.n = n

    def __len__(self) -> int:
        return self.n

    def part(self, lo: int, hi: int) -> "Columns":
        return Columns(min(hi, self.n) - lo, {k: v[lo:hi] for k, v in self.items()})


def columns_of(batch: pa.RecordBatch) -> Columns:
    n = batch.num_rows
    return Columns(n, {name: col.flatten().to_numpy(zero_copy_only=False).reshape(n, -1 if n else 0)
                       if pa.types.is_list(col.type) else col.to_numpy(zero_copy_only=False)
                       for name, col in zip(batch.schema.names, batch.columns)})


def packed_examples(state: DataFrame, expander, classes: bool = False) -> DataFrame:
    """The examples of ``state`` by chunks of rows: ``examples`` (row ids, blocks) and ``F``, their margins, still null.
    Arrays that blocks share are kept once.  An expander whose ``arrow`` is true reads ``Columns``, others pandas."""
    has_id = "row_id" in state.columns

    def pack(frames: Iterator) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            if not len(pdf):
                continue
            cut = pdf.part if isinstance(pdf, Columns) else lambda lo, hi, pdf=pdf: pdf.iloc[lo:hi]
            each = sum(b.y.shape[1] * (b.n_class if classes else 1) for b in expander.blocks(cut(0, 1)))
            step = max(CHUNK // max(each, 1), 1)
            for lo in range(0, len(pdf), step):
                part, seen, blocks = cut(lo, lo + step), {}, []

                def kept(a, seen=seen):
                    if id(a) not in seen:
                        seen[id(a)] = a, _small(a)      # with the array itself, so that its id stays taken
                    return seen[id(a)][1]
                for b in expander.blocks(part):
                    models, loc = b.models()
                    blocks.append(replace(b, model=None, bins=[kept(x) for x in b.bins], by_model=(models, _small(loc))))
                rows = np.asarray(part["row_id"]) if has_id else None
                yield pd.DataFrame({"examples": [pickle.dumps((rows, len(part), blocks), 5)], "F": [None]})

    def pack_arrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("examples", pa.binary()), ("F", pa.binary())])
        for out in pack(map(columns_of, batches)):
            yield pa.RecordBatch.from_pandas(out, schema, preserve_index=False)
    if getattr(expander, "arrow", False):
        return state.mapInArrow(pack_arrow, "examples binary, F binary")
    return state.mapInPandas(pack, "examples binary, F binary")


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(row ids, rows, blocks, margins, examples as stored) of each packed chunk."""
    for batch in batches:
        for i, (raw, flat) in enumerate(zip(batch.column("examples"), batch.column("F"))):
            rows, n, blocks = pickle.loads(raw.as_buffer())
            held = np.frombuffer(flat.as_buffer(), np.float32).reshape(n, -1) if flat.is_valid else None
            yield rows, n, blocks, held, batch.column("examples").slice(i, 1)


class PlainRows:
    """Expander of rows that are examples already: model, bins, nin, y, w."""

    def __init__(self, n_inputs: int, n_class: dict | None = None):
        self.n_inputs, self.n_class = n_inputs, n_class

    def blocks(self, pdf: pd.DataFrame) -> Iterator[Block]:
        n = len(pdf)
        b, rows = np.full((n, self.n_inputs), -1, np.int32), list(pdf["bins"])
        size = np.fromiter(map(len, rows), np.int64, n)
        has = np.arange(self.n_inputs) < np.minimum(pdf["nin"].to_numpy(np.int64), size)[:, None]
        b[has] = np.concatenate(rows)[((np.cumsum(size) - size)[:, None] + np.arange(self.n_inputs))[has]]
        model = pdf["model"].to_numpy(np.int64)
        c = max(self.n_class.values()) if self.n_class else 1
        of = np.array([self.n_class.get(int(m), 1) for m in model]) if self.n_class else None
        yield Block(model, [b[:, j:j + 1] for j in range(self.n_inputs)], pdf["y"].to_numpy(float)[:, None],
                    pdf["w"].to_numpy(float)[:, None], c, of)


# ---- one batch -------------------------------------------------------------------

def _margin_classes(blk: Block, objective: str) -> int:
    """Margins per example: one for regression and for two classes."""
    return 1 if objective == "squared" or blk.n_class <= 2 else blk.n_class


def _class_ids(blk: Block, objective: str) -> list[int]:
    if objective == "squared":
        return [0]
    return [1] if blk.n_class <= 2 else list(range(blk.n_class))


def _gradients(blk: Block, m: np.ndarray, objective: str) -> tuple[np.ndarray, np.ndarray | float]:
    """g and h per (row, copy, class), zero where the example does not train; h may be one whole number for all."""
    if objective == "squared" and np.isscalar(blk.w) and float(blk.w).is_integer() and not np.isnan(blk.y).any():
        g = m - blk.y[..., None]
        return (g if blk.w == 1 else g * blk.w), float(blk.w)
    w = np.where(np.isnan(blk.y), 0.0, blk.w)[..., None]
    y = np.nan_to_num(blk.y)[..., None]
    if objective == "squared":
        return (m - y) * w, np.broadcast_to(w, m.shape)
    if m.shape[-1] == 1:
        p = 1 / (1 + np.exp(-m))
        return (p - y) * w, np.maximum(p * (1 - p), 1e-16) * w
    m = m.astype(float)
    if blk.classes_of is not None:
        m = np.where(np.arange(m.shape[-1]) < blk.classes_of[:, None, None], m, NO_CLASS)
    e = np.exp(m - m.max(-1, keepdims=True))
    p = e / e.sum(-1, keepdims=True)
    return (p - (y == np.arange(m.shape[-1]))) * w, np.maximum(2 * p * (1 - p), 1e-16) * w


def _route(blk: Block, loc: np.ndarray, trees: tuple, depth: int, shape) -> np.ndarray:
    """Node (heap number) of each example after ``depth`` splits; trees: per local model feat, sbin, dleft."""
    feat, sbin, dleft = trees
    first = loc[:, None] * feat.shape[1]
    sbin, dleft = np.where(feat < 0, np.iinfo(np.int32).max, sbin), dleft | (feat < 0)     # no split: to the left
    node = np.zeros((len(loc), 1), np.int64)
    for d in range(depth):
        level = slice(2 ** d - 1, 2 ** (d + 1) - 1)
        used = [j for j in np.unique(feat[:, level]).tolist() if j >= 0]
        if not used:
            node = node * 2 + 1
            continue
        at = first + node
        b = blk.bins[used[0]]
        if len(used) > 1:
            f = feat.ravel()[at]
            for j in used[1:]:
                b = np.where(f == j, blk.bins[j], b)
        right = b > sbin.ravel()[at]
        if not dleft[:, level].all():
            right = np.where(b == 0, ~dleft.ravel()[at], right)
        node = node * 2 + 1 + right
    return np.broadcast_to(node, shape)


def _local_trees(models: np.ndarray, cls: int, trees: dict, n_int: int):
    feat = np.full((len(models), max(n_int, 1)), -1, np.int32)
    sbin = np.zeros((len(models), max(n_int, 1)), np.int32)
    dleft = np.ones((len(models), max(n_int, 1)), bool)
    for i, m in enumerate(models.tolist()):
        t = trees.get((m, cls))
        if t is not None:
            feat[i], sbin[i], dleft[i] = (a[:max(n_int, 1)] for a in t[:3])
    return feat, sbin, dleft


def _sampled(blk_no: int, rows: np.ndarray, copies: int, share: float, seed: int, rnd: int) -> np.ndarray:
    """Examples that take part in a round: a hash of (row, copy, block, round) below the share."""
    x = (rows.astype(np.int64).astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15)
         + np.arange(copies, dtype=np.uint64)[None, :] * np.uint64(0xC2B2AE3D27D4EB4F)
         + np.uint64((seed * 1_000_003 + rnd * 7919 + blk_no) & 0xFFFFFFFF))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(float) / 2.0 ** 53 < share


class _Pass:
    """What a task does with a chunk of examples: margins, gradients, histograms."""

    def __init__(self, p: BoostParams, n_bins: int, base: dict):
        self.p, self.n_bins, self.base = p, n_bins, base

    def parts(self, n: int, blocks: list, flat: np.ndarray | None):
        """(block number, block, local model, models, margins) of a chunk, margins as last stored."""
        at = 0
        for no, blk in enumerate(blocks):
            copies = blk.y.shape[1]
            k = _margin_classes(blk, self.p.objective)
            models, loc = blk.models()
            loc = loc.astype(np.int64)
            if flat is None:
                start = np.array([[self.base.get((m, c), 0.0) for c in _class_ids(blk, self.p.objective)]
                                  for m in models.tolist()]).reshape(len(models), k)
                margin = np.broadcast_to(start[loc][:, None, :], (n, copies, k))
            else:
                margin = flat[:, at:at + copies * k].reshape(n, copies, k)
            at += copies * k
            yield no, blk, loc, models, margin

    def histograms(self, batches, trees: dict, depth: int, rnd: int) -> Iterator[pa.RecordBatch]:
        width, nb = 2 ** depth, self.n_bins + 1
        held: dict = {}
        size = 0
        for rows, n, blocks, flat, _ in chunks(batches):
            roots: dict = {}        # what the blocks of a chunk share at the root: cells and counts by input and models
            for no, blk, loc, models, margin in self.parts(n, blocks, flat):
                g, h = _gradients(blk, margin, self.p.objective)
                if self.p.subsample < 1:
                    keep = _sampled(no, rows, g.shape[1], self.p.subsample, self.p.seed, rnd)
                    g, h = g * keep[..., None], h * keep[..., None]
                shape = g.shape[:2]
                for i, cls in enumerate(_class_ids(blk, self.p.objective)):
                    node = _route(blk, loc, _local_trees(models, cls, trees, width - 1), depth, shape) - (width - 1)
                    base = (loc[:, None] * width + node) * nb
                    gi, hi = g[..., i].ravel(), h if np.isscalar(h) else h[..., i].ravel()
                    total = len(models) * width * nb
                    at_root = loc.tobytes() if depth == 0 and np.isscalar(hi) else None
                    for j, b in enumerate(blk.bins):
                        same = (id(b), shape, total, at_root, hi) if at_root is not None else None
                        if same in roots:
                            key, ok, counts = roots[same]
                        else:
                            key, ok = (base + b).ravel(), None
                            if b.dtype.kind == "i" and (b < 0).any():
                                ok = (np.broadcast_to(b, shape) >= 0).ravel()
                                key = key[ok]
                            counts = np.bincount(key, minlength=total) * hi if np.isscalar(hi) \
                                else np.bincount(key, hi if ok is None else hi[ok], total)
                            if same is not None:
                                roots[same] = key, ok, counts
                        both = [np.bincount(key, gi if ok is None else gi[ok], total), counts]
                        both = [x.reshape(len(models), width * nb) for x in both]
                        for q, m in enumerate(models.tolist()):
                            at = (m, cls, j)
                            if at in held:
                                held[at][0] += both[0][q]
                                held[at][1] += both[1][q]
                            else:
                                held[at] = [both[0][q].copy(), both[1][q].copy()]
                                size += 16 * width * nb
                if size > FLUSH_BYTES:
                    yield _packed(held)
                    held, size = {}, 0
        if held:
            yield _packed(held)

    def update(self, batches, trees: dict, rnd: int) -> Iterator[pa.RecordBatch]:
        """The chunks again with margins advanced by the round's trees."""
        depth, n_int = self.p.depth, 2 ** self.p.depth - 1
        for _, n, blocks, flat, raw in chunks(batches):
            out = []
            for _, blk, loc, models, margin in self.parts(n, blocks, flat):
                new = np.array(margin, np.float32)
                for i, cls in enumerate(_class_ids(blk, self.p.objective)):
                    node = _route(blk, loc, _local_trees(models, cls, trees, n_int), depth, blk.y.shape) - n_int
                    leaf = np.stack([trees[(m, cls)][3] if (m, cls) in trees else np.zeros(n_int + 1)
                                     for m in models.tolist()])
                    new[..., i] += leaf.ravel()[loc[:, None] * (n_int + 1) + node]
                out.append(new.reshape(n, -1))
            flat = np.concatenate(out, axis=1) if out else np.zeros((n, 0), np.float32)
            yield pa.record_batch([raw, pa.array([flat.tobytes()], pa.binary())],
                                  names=["examples", "F"])


def _packed(held: dict) -> pa.RecordBatch:
    keys = sorted(held)
    return pa.record_batch([pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int32()),
                            pa.array([k[2] for k in keys], pa.int32()),
                            pa.array([np.concatenate(held[k]).tobytes() for k in keys], pa.binary())],
                           names=["model", "cls", "j", "gh"])


# ---- split search ----------------------------------------------------------------

def _weight(g, p: BoostParams):
    """Gradient sum after the L1 penalty."""
    return np.sign(g) * np.maximum(np.abs(g) - p.alpha, 0.0)


def _score(g, h, p: BoostParams):
    den = h + p.lam
    return np.where(den > 0, _weight(g, p) ** 2 / np.where(den > 0, den, 1.0), 0.0)


def leaf_value(g: float, h: float, p: BoostParams) -> float:
    return float(-p.eta * _weight(np.float64(g), p) / (h + p.lam)) if h + p.lam > 0 else 0.0


def best_splits(hist: dict, width: int, nb: int, p: BoostParams) -> list[tuple]:
    """(node, input, bin, default left, GL, HL, GT, HT) of each node of one (model, class) with examples;
    input -1 where no split gains.  Ties: smaller input, then smaller bin, then missing to the left."""
    best: dict = {}
    for j in sorted(hist):
        g, h = (x.reshape(width, nb) for x in hist[j])
        gt, ht = g.sum(1), h.sum(1)
        gl0, hl0 = np.cumsum(g[:, 1:], 1), np.cumsum(h[:, 1:], 1)
        whole = _score(gt, ht, p)[:, None]
        tries = []
        for gl, hl in ((gl0 + g[:, :1], hl0 + h[:, :1]), (gl0, hl0)):
            gr, hr = gt[:, None] - gl, ht[:, None] - hl
            gain = _score(gl, hl, p) + _score(gr, hr, p) - whole
            ok = (hl >= p.min_child_weight) & (hr >= p.min_child_weight) & (gain > max(p.gamma, 1e-12))
            tries.append((np.where(ok, gain, -np.inf), gl, hl))
        right = tries[1][0] > tries[0][0]
        gain = np.where(right, tries[1][0], tries[0][0])
        at = gain.argmax(1)
        for node in np.flatnonzero(ht > 0).tolist():
            b = int(at[node])
            now = best.get(node)
            if now is None:
                now = best[node] = (-np.inf, -1, 0, True, 0.0, 0.0, float(gt[node]), float(ht[node]))
            if gain[node, b] > now[0]:
                side = int(right[node, b])
                best[node] = (float(gain[node, b]), j, b + 1, not side, float(tries[side][1][node, b]),
                              float(tries[side][2][node, b]), float(gt[node]), float(ht[node]))
    return [(node, *v[1:]) for node, v in sorted(best.items())]


_SPLITS = "model long, cls int, node int, sj int, sb int, sdl boolean, GL double, HL double, GT double, HT double"


def _search(width: int, nb: int, p: BoostParams):
    """Streaming over rows sorted by (model, cls): add up the tasks' arrays, search when a pair is complete."""
    names = [c.split()[0] for c in _SPLITS.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, hist, out = None, {}, []

        def close():
            if now is not None:
                first = 2 ** (width.bit_length() - 1) - 1
                out.extend((now[0], now[1], node + first, *rest) for node, *rest in best_splits(hist, width, nb, p))
        for pdf in batches:
            for m, c, j, raw in pdf.itertuples(index=False):
                if (m, c) != now:
                    close()
                    now, hist = (m, c), {}
                gh = np.frombuffer(raw, np.float64).reshape(2, -1)
                hist[j] = hist[j] + gh if j in hist else gh
            if len(out) > 10_000:
                yield pd.DataFrame(out, columns=names)
                out = []
        close()
        if out:
            yield pd.DataFrame(out, columns=names)
    return run


# ---- the loop --------------------------------------------------------------------

def fit_expanded(state: DataFrame, expander, p: BoostParams, n_bins: int, release: bool = False) -> BoostedForest:
    """Train all models of an expander.  ``state``: one row per real row with the columns the expander reads
    (``row_id`` too if ``subsample`` < 1); its examples are cached here, and with ``release`` a cache of ``state`` itself
    ends as soon as they are."""
    spark = state.sparkSession
    forest = BoostedForest(depth=p.depth, n_rounds=p.n_rounds, objective=p.objective)
    given, state = state, packed_examples(state, expander, p.objective != "squared").persist(ON_DISK)
    if p.objective == "squared":
        forest.base = _mean_targets(state)
        if release:
            given.unpersist()
    else:
        forest.base = _Default(p.base_score or 0.0)
    work = _Pass(p, n_bins, forest.base)
    size = state.agg(F.sum(F.octet_length("examples"))).first()[0] or 0
    if size <= SMALL:
        _boost_here(state, work, forest)
        state.unpersist()
        return forest
    n_parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    n_parts = min(n_parts, max(1, getattr(expander, "trees", n_parts)))      # no more tasks than trees of a round
    nb = n_bins + 1
    for r in range(p.n_rounds):
        trees: dict = {}
        for d in range(p.depth):
            sent = spark.sparkContext.broadcast((work, trees))

            def hist(batches, sent=sent, d=d, r=r):
                w, t = sent.value
                return w.histograms(batches, t, d, r)
            rows = state.mapInArrow(hist, "model long, cls int, j int, gh binary")
            found = (rows.repartition(n_parts, "model", "cls").sortWithinPartitions("model", "cls")
                     .mapInPandas(_search(2 ** d, nb, p), _SPLITS)).collect()   # models x nodes rows
            sent.unpersist()
            trees = _grow(trees, found, d, p)
            if not any(s["sj"] >= 0 for s in found):
                break       # nothing split at this depth: the leaves are set already
        for key, (feat, sbin, dleft, leaf) in trees.items():
            forest._ensure(key)
            forest.feat[key][r], forest.sbin[key][r], forest.dleft[key][r], forest.leaf[key][r] = \
                feat, sbin, dleft, leaf
        if r + 1 < p.n_rounds:
            sent = spark.sparkContext.broadcast((work, trees))

            def update(batches, sent=sent, r=r):
                w, t = sent.value
                return w.update(batches, t, r)
            new = state.mapInArrow(update, state.schema)
            if (r + 1) % p.checkpoint_every == 0:
                new = materialize(new)
            else:
                new = new.persist(ON_DISK)
                new.count()
            state.unpersist()
            state = new
    state.unpersist()
    return forest


def _joined(batches: Iterator[pa.RecordBatch]) -> list[pa.RecordBatch]:
    """Chunks without margins as one chunk: many tasks leave many chunks of few rows."""
    parts = list(chunks(batches))
    if not parts:
        return []
    blocks = []
    for same in zip(*[blocks for _, _, blocks, _, _ in parts], strict=True):
        b, join = same[0], lambda pick: np.concatenate([pick(x) for x in same])  # noqa: B023
        blocks.append(replace(b, bins=[join(lambda x, j=j: x.bins[j]) for j in range(len(b.bins))], y=join(lambda x: x.y),
                              w=b.w if np.isscalar(b.w) else join(lambda x: x.w),
                              classes_of=None if b.classes_of is None else join(lambda x: x.classes_of),
                              by_model=np.unique(join(lambda x: x.by_model[0][x.by_model[1]]), return_inverse=True)))
    rows = None if parts[0][0] is None else np.concatenate([p[0] for p in parts])
    data = pickle.dumps((rows, sum(p[1] for p in parts), blocks), 5)
    return [pa.record_batch([pa.array([data], pa.binary()), pa.array([None], pa.binary())], names=["examples", "F"])]


def _boost_here(state: DataFrame, work: _Pass, forest: BoostedForest) -> None:
    """All rounds on all chunks in one task: the passes, the search and the growth of the distributed rounds."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, batches, done = work.p, _joined(batches), {}
        for r in range(p.n_rounds):
            trees: dict = {}
            for d in range(p.depth):
                rows = [b.to_pandas() for b in work.histograms(iter(batches), trees, d, r)]
                if not rows:
                    break
                rows = pd.concat(rows).sort_values(["model", "cls"], kind="stable")
                found = [s for out in _search(2 ** d, work.n_bins + 1, p)(iter([rows])) for s in out.to_dict("records")]
                trees = _grow(trees, found, d, p)
                if not any(s["sj"] >= 0 for s in found):
                    break
            for key, tree in trees.items():
                done.setdefault(key, []).append((r, *tree))
            if r + 1 < p.n_rounds:
                batches = list(work.update(iter(batches), trees, r))
        for (model, cls), grown in done.items():
            yield pa.record_batch([pa.array([model], pa.int64()), pa.array([cls], pa.int32()),
                                   pa.array([pickle.dumps(grown, 5)], pa.binary())], names=["model", "cls", "grown"])
    for row in state.coalesce(1).mapInArrow(run, "model long, cls int, grown binary").collect():      # the model itself
        key = int(row["model"]), int(row["cls"])
        forest._ensure(key)
        for r, *tree in pickle.loads(row["grown"]):
            forest.feat[key][r], forest.sbin[key][r], forest.dleft[key][r], forest.leaf[key][r] = tree


class _Default(dict):
    """Base scores of classifiers: one value for every class."""

    def __init__(self, value: float):
        super().__init__()
        self.value = value

    def get(self, key, default=None):
        return self.value

    def __reduce__(self):
        return _Default, (self.value,)


def _mean_targets(state: DataFrame) -> dict:
    """Weighted mean target of each model: one pass, sums per (chunk, model)."""
    def sums(batches):
        for _, _, blocks, _, _ in chunks(batches):
            for blk in blocks:
                models, loc = blk.models()
                w = np.where(np.isnan(blk.y), 0.0, blk.w)
                at = np.broadcast_to(loc[:, None], blk.y.shape).ravel()
                yield pa.record_batch([pa.array(models.astype(np.int64)),
                                       pa.array(np.bincount(at, (np.nan_to_num(blk.y) * w).ravel(), len(models))),
                                       pa.array(np.bincount(at, w.ravel(), len(models)))], names=["model", "s", "w"])
    rows = state.mapInArrow(sums, "model long, s double, w double").groupBy("model").agg(
        F.sum("s").alias("s"), F.sum("w").alias("w")).filter("w > 0").collect()
    return {(int(r["model"]), 0): float(r["s"] / r["w"]) for r in rows}


def _grow(trees: dict, found: list, depth: int, p: BoostParams) -> dict:
    """Trees of the round after one more depth; the last depth sets the leaves."""
    n_int = 2 ** p.depth - 1
    trees = {k: tuple(a.copy() for a in t) for k, t in trees.items()}
    for s in found:
        key = (int(s["model"]), int(s["cls"]))
        if key not in trees:
            trees[key] = (np.full(n_int, -1, np.int32), np.zeros(n_int, np.int32), np.ones(n_int, bool),
                          np.zeros(n_int + 1))
        feat, sbin, dleft, leaf = trees[key]
        node, split = int(s["node"]), s["sj"] >= 0
        if split:
            feat[node], sbin[node], dleft[node] = s["sj"], s["sb"], s["sdl"]
        # a node's value goes to the leaves under it; deeper splits overwrite their part
        left = leaf_value(s["GL"], s["HL"], p) if split else leaf_value(s["GT"], s["HT"], p)
        right = leaf_value(s["GT"] - s["GL"], s["HT"] - s["HL"], p) if split else left
        for child, value in ((2 * node + 1, left), (2 * node + 2, right)):
            span = 2 ** (p.depth - depth - 1)
            first = (child + 1) * span - 1 - n_int
            leaf[first:first + span] = value
    return trees


def fit_boosted(rows: DataFrame, p: BoostParams, n_class: dict | None = None,
                n_inputs: int | None = None, n_bins: int | None = None) -> BoostedForest:
    """Train all models in ``rows``: model, rid, bins (array<int>, 0 = missing), nin, y and an optional weight w."""
    if "w" not in rows.columns:
        rows = rows.withColumn("w", F.lit(1.0))
    rows = rows.select(F.col("model").cast("long").alias("model"), F.col("rid").cast("long").alias("row_id"), "bins",
                       F.col("nin").cast("int").alias("nin"), F.col("y").cast("double").alias("y"),
                       F.col("w").cast("double").alias("w"))
    if n_inputs is None or n_bins is None:
        seen = rows.agg(F.max("nin").alias("j"), F.max(F.array_max("bins")).alias("b")).first()
        n_inputs, n_bins = n_inputs or seen["j"] or 1, n_bins or seen["b"] or 1
    n_class = {int(k): int(v) for k, v in n_class.items()} if n_class else None
    return fit_expanded(rows, PlainRows(n_inputs, n_class), p, n_bins)


# ---- scoring inside Arrow batches ----------------------------------------------

def predict_margin(forest, key, X: np.ndarray, thresholds: np.ndarray) -> np.ndarray:
    """Margin of model ``key`` of a forest (whole or paged) for raw inputs ``X[n, J]``; a row goes left iff
    ``x <= threshold`` (missing: learned direction).  ``thresholds[j, bin]``
    maps split bins of input j to raw values."""
    n = X.shape[0]
    base, trees = forest.model(key)
    out = np.full(n, base)
    if trees is None or n == 0:
        return out
    feat, sb, dl, leaf = trees
    R, n_int = feat.shape
    split = feat >= 0
    of = np.where(split, feat, 0)
    limit = np.where(split, thresholds[of, sb], np.inf).ravel()     # per node; without a split to the left
    of, missing_left = of.ravel(), (dl | ~split).ravel()
    gone = bool(np.isnan(X).any())
    X = np.ascontiguousarray(X)
    first, row = (np.arange(R) * n_int)[None, :], (np.arange(n) * X.shape[1])[:, None]
    node = np.zeros((n, R), dtype=np.int64)
    for _ in range(forest.depth):
        at = first + node
        v = X.ravel()[row + of[at]]
        go_left = v <= limit[at]
        if gone:
            go_left |= np.isnan(v) & missing_left[at]
        node = node * 2 + 2 - go_left
    return out + leaf[np.arange(R)[None, :], node - n_int].sum(axis=1)
