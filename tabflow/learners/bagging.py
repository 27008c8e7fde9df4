"""Random forests of many models in shared passes over an expansion that is never stored.

The examples come from the expanders of ``hist_boost``.  Trees of a forest do not depend on each other, so a pass serves
one depth of ``trees_per_pass`` trees of all models: ``n_trees / trees_per_pass * depth`` jobs in all.  In a pass

* a task reads packed chunks of examples, weighs every example by its bootstrap count, routes it and adds its weight and its
  weighted targets (numbers: the target; classes: one column a class) to one array per (model, tree, input);
* the arrays are added up while streaming, by (model, tree), and the split with the largest fall in squared error is
  searched there; for classes, with one column a class, that is the largest fall in Gini impurity;
* the splits, which are the trees, come to the driver.

A bootstrap count is Poisson(1), the limit of drawing n of n examples with replacement, as a hash of (row, copy, tree):
the same whatever the partitioning and after a retry.  All models of a row share it.  A leaf holds the mean target, or
the class shares, of its examples; the forest's answer is the mean over its trees.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from ..session import ON_DISK
from .hist_boost import FLUSH_BYTES, Block, BoostedForest, chunks, packed_examples

PRIME = 2 ** 31 - 1
#: distribution function of Poisson(1) at 0, 1, 2, ...
POISSON = np.cumsum(np.exp(-1.0) / np.cumprod([1.0, *range(1, 12)]))


@dataclass
class ForestParams:
    n_trees: int = 100
    depth: int = 7
    min_leaf: float = 1.0
    features: float | str = 1.0     # share of the inputs tried at a node; "sqrt": the root of their number
    trees_per_pass: int = 25
    seed: int = 0

    def tried(self, n_inputs: int) -> int:
        n = int(np.sqrt(n_inputs)) if self.features == "sqrt" else int(np.ceil(self.features * n_inputs))
        return min(max(n, 1), n_inputs)


def bootstrap(rows: np.ndarray, copies: int, tree: int, seed: int) -> np.ndarray:
    """Poisson(1) counts (rows, copies) of a tree; fifth powers permute the residues of ``PRIME``."""
    def fifth(x):
        y = x * x % PRIME
        return y * y % PRIME * x % PRIME
    x = (rows.astype(np.int64)[:, None] % PRIME * 48271 + np.arange(copies) * 69621 + tree * 40692 + seed * 16807
         + 12345) % PRIME
    x = fifth((fifth(x) * 48271 + 11) % PRIME)
    return np.searchsorted(POISSON, (x + 0.5) / PRIME, side="left").astype(np.float64)


def _weights(blk: Block, rows: np.ndarray, tree: int, seed: int, drawn: dict) -> np.ndarray:
    """Bootstrap weights of a block's examples, 0 without a target; a whole-number weight stands for that many copies.
    ``drawn``: the counts of a chunk's rows so far, as its blocks share them."""
    n, copies = blk.y.shape
    each = max(int(blk.w), 1) if np.isscalar(blk.w) else 1
    if (copies, each, tree) not in drawn:
        drawn[copies, each, tree] = bootstrap(rows, copies * each, tree, seed).reshape(n, copies, each).sum(2)
    w = drawn[copies, each, tree]
    if not np.isscalar(blk.w):
        w = w * blk.w
    missing = np.isnan(blk.y)
    return np.where(missing, 0.0, w) if missing.any() else w


def _nodes(table: np.ndarray, loc: np.ndarray, trees: tuple, depth: int) -> np.ndarray:
    """Node (heap number) after ``depth`` splits of each row of ``table`` (bins by input); trees: per local model feat,
    sbin, dleft."""
    feat, sbin, dleft = trees
    split = feat >= 0
    of, cut = np.where(split, feat, 0).ravel(), np.where(split, sbin, np.iinfo(np.int32).max).ravel()      # no split: left
    left, flat = (dleft | ~split).ravel(), table.ravel()
    first, row = loc * feat.shape[1], np.arange(len(table)) * table.shape[1]
    node = np.zeros(len(table), np.int64)
    for _ in range(depth):
        at = first + node
        b = flat[row + of[at]]
        right = b > cut[at]
        if not left.all():
            right = np.where(b == 0, ~left[at], right)
        node = node * 2 + 1 + right
    return node


class _Pass:
    """Histograms of some trees at one depth; ``trees``: (model, tree) -> feat, sbin, dleft so far."""

    def __init__(self, p: ForestParams, n_bins: int, first: int, trees: dict, depth: int):
        self.p, self.nb, self.first, self.trees, self.depth = p, n_bins + 1, first, trees, depth

    def _local(self, models: np.ndarray, tree: int):
        n_int = max(2 ** self.depth - 1, 1)
        feat = np.full((len(models), n_int), -1, np.int32)
        sbin, dleft = np.zeros_like(feat), np.ones(feat.shape, bool)
        for i, m in enumerate(models.tolist()):
            if (m, tree) in self.trees:
                feat[i], sbin[i], dleft[i] = (a[:n_int] for a in self.trees[(m, tree)])
        return feat, sbin, dleft

    def _drawn(self, blk: Block, rows: np.ndarray, tree: int, drawn: dict, kept: dict):
        """Bins, table of the bins, loc, weights, targets and weighted targets of the examples of a block that the bootstrap
        of a tree drew (the others weigh nothing).  ``kept``: what the blocks of a chunk share, by array and tree."""
        w, copies = _weights(blk, rows, tree, self.p.seed, drawn), blk.y.shape[1]
        if (id(w), "at") not in kept:
            at = np.flatnonzero(w)
            kept[id(w), "at"] = w, at, at // copies, w.ravel()[at]      # with the array itself, so that its id stays taken
        _, at, row, wat = kept[id(w), "at"]
        if (id(w), id(blk.y)) not in kept:
            y = np.nan_to_num(blk.y.ravel()[at])
            kept[id(w), id(blk.y)] = y, wat * y
        bins = []
        for b in blk.bins:
            if (id(w), id(b)) not in kept:
                kept[id(w), id(b)] = b[row, 0] if b.shape[1] == 1 else b.ravel()[at]
            bins.append(kept[id(w), id(b)])
        same = id(w), "table", *map(id, blk.bins)
        if same not in kept:
            kept[same] = np.stack(bins, axis=1) if bins else np.zeros((len(at), 1), np.uint8)
        return bins, kept[same], blk.models()[1].astype(np.int64)[row], wat, *kept[id(w), id(blk.y)]

    def histograms(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width, held, size = 2 ** self.depth, {}, 0
        last = min(self.first + self.p.trees_per_pass, self.p.n_trees)
        for rows, _, blocks, _, _ in chunks(batches):
            rows, drawn, kept = rows.astype(np.int64), {}, {}
            for blk in blocks:
                c, models = blk.n_class, blk.models()[0]
                cells = len(models) * width * self.nb
                for tree in range(self.first, last):
                    bins, table, loc, w, y, wy = self._drawn(blk, rows, tree, drawn, kept)
                    node = _nodes(table, loc, self._local(models, tree), self.depth) - (width - 1)
                    base = (loc * width + node) * self.nb
                    for j, b in enumerate(bins):
                        key, wk, yk, wyk = base + b, w, y, wy
                        if b.dtype.kind == "i" and (b < 0).any():
                            ok = b >= 0
                            key, wk, yk, wyk = key[ok], w[ok], y[ok], wy[ok]
                        if c == 1:
                            sums = np.bincount(key, wyk, cells)[None]
                        else:
                            sums = np.bincount(yk.astype(np.int64) * cells + key, wk, c * cells).reshape(c, cells)
                        new = np.concatenate([sums, np.bincount(key, wk, cells)[None]])
                        new = new.reshape(c + 1, len(models), width * self.nb)
                        for q, m in enumerate(models.tolist()):
                            at = (m, tree, j)
                            if at in held:
                                held[at] += new[:, q]
                            else:
                                held[at] = new[:, q].copy()
                                size += held[at].nbytes
                    if size > FLUSH_BYTES:
                        yield _packed(held)
                        held, size = {}, 0
        if held:
            yield _packed(held)


def _packed(held: dict) -> pa.RecordBatch:
    keys = sorted(held)
    return pa.record_batch([pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int32()),
                            pa.array([k[2] for k in keys], pa.int32()),
                            pa.array([held[k].tobytes() for k in keys], pa.binary())], names=["model", "tree", "j", "sums"])


def _purity(s: np.ndarray) -> np.ndarray:
    """Sum of squared sums over the weight (last of the first axis); 0 where there is no weight."""
    return np.where(s[-1] > 0, (s[:-1] ** 2).sum(0) / np.where(s[-1] > 0, s[-1], 1.0), 0.0)


def best_splits(hist: dict, width: int, nb: int, p: ForestParams, model: int, tree: int) -> list[tuple]:
    """(node, input, bin, missing left, sums left, sums) of each node with examples; input -1 where nothing gains.
    Ties: smaller input, then smaller bin, then missing to the left."""
    best: dict = {}
    some = p.tried(len(hist)) < len(hist)
    tried = {n: set(np.random.default_rng([p.seed, model, tree, width, n]).permutation(sorted(hist))[:p.tried(len(hist))])
             for n in range(width)} if some else {}
    for j in sorted(hist):
        a = hist[j].reshape(-1, width, nb)
        total, known = a.sum(2), np.cumsum(a[:, :, 1:], 2)
        whole = _purity(total)[:, None]
        gains, lefts = [], [known + a[:, :, :1], known]
        for left in lefts:
            right = total[:, :, None] - left
            gain = _purity(left) + _purity(right) - whole
            ok = (left[-1] >= p.min_leaf) & (right[-1] >= p.min_leaf) & (gain > 1e-9)
            gains.append(np.where(ok, gain, -np.inf))
        away = gains[1] > gains[0]
        gain = np.where(away, gains[1], gains[0])
        at = gain.argmax(1)
        for n in np.flatnonzero(total[-1] > 0).tolist():
            if n not in best:
                best[n] = (-np.inf, -1, 0, True, total[:, n], total[:, n])
            b = int(at[n])
            if gain[n, b] > best[n][0] and (not some or j in tried[n]):
                side = int(away[n, b])
                best[n] = (float(gain[n, b]), j, b + 1, not side, lefts[side][:, n, b], total[:, n])
    return [(n, *v[1:]) for n, v in sorted(best.items())]


_SPLITS = "model long, tree int, node int, j int, bin int, dleft boolean, lo array<double>, total array<double>"


def _search(width: int, nb: int, p: ForestParams):
    """Streaming over rows sorted by (model, tree): add up the tasks' arrays, search when a tree is complete."""
    names = [c.split()[0] for c in _SPLITS.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, hist, out = None, {}, []

        def close():
            if now is not None:
                out.extend((*now, n + width - 1, j, b, d, lo.tolist(), total.tolist())
                           for n, j, b, d, lo, total in best_splits(hist, width, nb, p, *now))
        for pdf in batches:
            for m, t, j, raw in pdf.itertuples(index=False):
                if (m, t) != now:
                    close()
                    now, hist = (m, t), {}
                sums = np.frombuffer(raw, np.float64)
                hist[j] = hist[j] + sums if j in hist else sums
            if len(out) > 10_000:
                yield pd.DataFrame(out, columns=names)
                out.clear()
        close()
        if out:
            yield pd.DataFrame(out, columns=names)
    return run


def _grow(trees: dict, leaves: dict, found: list, depth: int, p: ForestParams) -> None:
    """One more depth of the trees; a node's mean goes to the leaves under it, deeper splits overwrite their part."""
    n_int = 2 ** p.depth - 1
    for s in found:
        key, node, split = (int(s["model"]), int(s["tree"])), int(s["node"]), s["j"] >= 0
        total, lo = np.array(s["total"]), np.array(s["lo"])
        if key not in trees:
            trees[key] = (np.full(n_int, -1, np.int32), np.zeros(n_int, np.int32), np.ones(n_int, bool))
            leaves[key] = np.zeros((n_int + 1, len(total) - 1))
        if split:
            for a, v in zip(trees[key], (s["j"], s["bin"], s["dleft"])):
                a[node] = v
        hi = total - lo if split else total
        for child, v in ((2 * node + 1, lo if split else total), (2 * node + 2, hi)):
            span = 2 ** (p.depth - depth - 1)
            first = (child + 1) * span - 1 - n_int
            leaves[key][first:first + span] = v[:-1] / v[-1]


def fit_bagged(state: DataFrame, expander, p: ForestParams, n_bins: int) -> BoostedForest:
    """Forests of all models of an expander, as trees that ``predict_margin`` adds up: the mean target of model m under
    the key (m, 0), the share of class c under (m, c).  ``state`` has one row per real row with ``row_id``; a tree whose
    bootstrap drew nothing does not count; a model without examples answers 0."""
    spark = state.sparkSession
    state = packed_examples(state, expander).persist(ON_DISK)
    n_parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    trees: dict = {}
    leaves: dict = {}
    for first in range(0, p.n_trees, p.trees_per_pass):
        for d in range(p.depth):
            part = {k: v for k, v in trees.items() if k[1] >= first}
            sent = spark.sparkContext.broadcast(_Pass(p, n_bins, first, part, d))

            def hist(batches, sent=sent):
                return sent.value.histograms(batches)
            rows = state.mapInArrow(hist, "model long, tree int, j int, sums binary")
            found = (rows.repartition(n_parts, "model", "tree").sortWithinPartitions("model", "tree")
                     .mapInPandas(_search(2 ** d, n_bins + 1, p), _SPLITS)).collect()    # the trees themselves
            sent.unpersist()
            _grow(trees, leaves, found, d, p)
            if p.features == 1.0 and not any(s["j"] >= 0 for s in found):
                break       # with all inputs tried, nothing will split later
    state.unpersist()
    forest = BoostedForest(depth=p.depth, n_rounds=p.n_trees, objective="forest")
    grown: dict = {}
    for m, _ in trees:
        grown[m] = grown.get(m, 0) + 1
    for (m, t), (feat, sbin, dleft) in trees.items():
        for c in range(leaves[(m, t)].shape[1]):
            forest._ensure((m, c))
            forest.feat[(m, c)][t], forest.sbin[(m, c)][t], forest.dleft[(m, c)][t] = feat, sbin, dleft
            forest.leaf[(m, c)][t] = leaves[(m, t)][:, c] / grown[m]
    return forest
