"""Hard negatives by inner product: anchors' clusters share sorted candidate lists.

``search`` finds, for every anchor and each of its score windows [low, high], the first k
candidates of the same (or of another) label whose inner product with the anchor lies in
the window, exactly:

* Anchors are clustered by direction (spherical k-means on a bounded sample of them); a
  cluster's angle is the largest of all its members.
* Candidates are dealt into blocks by hash.  In a block, a cluster sorts the candidates once
  by the angular upper bound |x| cos(max(0, angle(x, centre) - angle of the cluster)), and
  all members walk that list in steps.  A member stops as soon as the next bound times its
  own length lies below what each window still needs: the window's lower end or the k-th
  score found so far.  Every unread candidate is then certified to be of no use.
* About the square root of the blocks is searched first; the merged k-th scores are the
  starting needs in the others, so most of them stop early and return few rows.

An anchor's row goes to every block (a stated query set against all rows, in blocks).  A
task streams its block's anchors, sorted by cluster, past the candidates of one block, so
it holds one block (at most ``BLOCK_ROWS`` rows) and ``MEMBERS`` anchors.  Blocks are by
hash of the whole row, so neither a common label nor a common vector makes one large; the
partial results of an anchor are cut to k per window and block before they are merged.

Defined cases: rows with a null id, label or vector, or with a null or non-finite component take
no part.  Rows equal in id, label and vector count once; rows that share an id only are rows
of their own.  A shorter vector is padded with zeros.  Components are floor(256 x), limited
to +-2^25, so that a score fits a long.  Ties go to the smaller id.  An anchor without
positives, or a positive without negatives in its window, gives no row; an empty table an
empty result.  A third of all rows with one label or one vector changes nothing: no row is
keyed by either.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabflow.llm.common import n_partitions
from tabflow.session import materialize

BLOCK_ROWS = 1 << 18                 # candidates in a block at most (on average)
MEMBERS = 256                        # anchors that walk a list together
STEP = 2048                          # candidates read at a step
SAMPLE, CLUSTERS = 2048, 64          # anchors that the centres are fitted on, and centres, at most
WIDE = 1 << 62
_LIMIT = 1 << 25

_ROW = "block int, kind int, cluster int, id long, tie long, label int, vec array<int>, low array<long>, high array<long>, need array<long>"
_HIT = "id long, tie long, w int, score long, other long"


def whole_rows(rows: DataFrame, vec_col: str, id_col: str, label: Column) -> DataFrame:
    """(id, tie, label, vec): integer vectors of the rows that take part; ``tie`` tells rows of one id apart."""
    x = F.col(vec_col)
    fine = F.forall(x, lambda v: v.isNotNull() & (F.abs(v.cast("double")) < float("inf")) & ~F.isnan(v.cast("double")))
    whole = F.transform(x, lambda v: F.least(F.greatest(F.floor(v.cast("double") * 256.0), F.lit(-_LIMIT)), F.lit(_LIMIT)).cast("int"))
    return (rows.where(F.col(id_col).isNotNull() & label.isNotNull() & x.isNotNull() & fine)
            .select(F.col(id_col).cast("long").alias("id"), label.cast("int").alias("label"), whole.alias("vec"))
            .withColumn("tie", F.xxhash64("label", "vec")))


def matrix(vec: pa.ListArray, dims: int) -> np.ndarray:
    """Rows of a list column as float64 rows of ``dims`` numbers, padded with zeros."""
    offs = vec.offsets.to_numpy()
    flat = vec.values.to_numpy()[offs[0]:offs[-1]]
    lens = np.diff(offs)
    if len(lens) and (lens == dims).all():
        return flat.reshape(len(lens), dims).astype(np.float64)
    out = np.zeros((len(lens), dims))
    row = np.repeat(np.arange(len(lens)), lens)
    out[row, np.arange(len(flat)) - np.repeat(offs[:-1] - offs[0], lens)] = flat
    return out


def _units(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n > 0, n, 1)


def fit_centres(x: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """Spherical k-means: k unit vectors (fewer for few points), started at evenly spaced points."""
    u = _units(x)
    if not len(u):
        return np.zeros((1, x.shape[1]))
    c = u[np.linspace(0, len(u) - 1, min(k, len(u))).astype(int)]
    for _ in range(rounds):
        near = np.argmax(u @ c.T, axis=1)
        total = np.zeros_like(c)
        np.add.at(total, near, u)
        length = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(length > 1e-9, total / np.where(length > 0, length, 1), c)
    return c


def angles(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Angle of every row to every centre; a zero row has angle 0 (its bound is 0 anyway)."""
    a = np.arccos(np.clip(_units(x) @ centres.T, -1.0, 1.0))
    a[~x.any(axis=1)] = 0.0
    return a


def scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer inner products."""
    most = max(np.abs(q).max(initial=0), 1) * max(np.abs(x).max(initial=0), 1) * q.shape[1]
    if most < 2 ** 53:
        return (q @ x.T).astype(np.int64)
    return q.astype(np.int64) @ x.astype(np.int64).T


class Block:
    """Candidates of a block; ``order`` sorts them for a cluster."""

    def __init__(self, ids, ties, labels, x):
        keep = np.lexsort((ties, ids))
        ids, ties = ids[keep], ties[keep]
        new = np.ones(len(ids), bool)
        new[1:] = (ids[1:] != ids[:-1]) | (ties[1:] != ties[:-1])     # repeated rows count once
        self.ids, self.ties, self.labels, self.x = ids[new], ties[new], labels[keep][new], x[keep][new]
        self.length = np.linalg.norm(self.x, axis=1)

    def order(self, centre: np.ndarray, wide: float) -> tuple[np.ndarray, np.ndarray]:
        """Candidates by falling upper bound for a query of length 1 in the cluster, and the bounds."""
        a = angles(self.x, centre[None, :])[:, 0]
        bound = self.length * np.cos(np.maximum(a - wide - 1e-6, 0.0))
        at = np.argsort(-bound, kind="stable")
        return at, bound[at]


def walk(block: Block, order: np.ndarray, bound: np.ndarray, q: np.ndarray, ids: np.ndarray, ties: np.ndarray,
         labels: np.ndarray, low: np.ndarray, high: np.ndarray, need: np.ndarray, k: int, same: bool
         ) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Row (member * windows + window), score and candidate of the first k of every window in the block, and the
    number of inner products.  ``need``: the scores below which a window takes nothing."""
    m, w = low.shape
    need = np.maximum(need, low)
    length = np.linalg.norm(q, axis=1)
    row = np.zeros(0, np.int64)
    score, cand = np.zeros(0, np.int64), np.zeros(0, np.int64)
    active, read = np.arange(m), 0
    for at in range(0, len(order), STEP):
        best = np.abs(bound[at]) * length * 1e-9 + bound[at] * length + 1e-3
        least = np.where(high >= low, need, WIDE).min(axis=1)
        active = active[best[active] >= least[active]]
        if not len(active):
            break
        mine = order[at:at + STEP]
        s = scores(q[active], block.x[mine])
        read += s.size
        fits = (labels[active, None] == block.labels[None, mine]) == same
        if same:
            fits &= (ids[active, None] != block.ids[None, mine]) | (ties[active, None] != block.ties[None, mine])
        for j in range(w):
            r, c = np.nonzero(fits & (s >= need[active, j, None]) & (s <= high[active, j, None]))
            row = np.concatenate([row, active[r] * w + j])
            score = np.concatenate([score, s[r, c]])
            cand = np.concatenate([cand, mine[c]])
        by = np.lexsort((block.ids[cand], -score, row))
        row, score, cand = row[by], score[by], cand[by]
        first = np.searchsorted(row, row, side="left")
        rank = np.arange(len(row)) - first
        kth = rank == k - 1
        need.reshape(-1)[row[kth]] = np.maximum(need.reshape(-1)[row[kth]], score[kth])
        row, score, cand = row[rank < k], score[rank < k], cand[rank < k]
    return row, score, cand, read


def _walker(centres: np.ndarray, wide: list[float], dims: int, k: int, same: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, block, cluster, order = None, [], None, None, None
        for batch in batches:
            key = np.stack([batch.column(c).to_numpy() for c in ("block", "kind", "cluster")], axis=1)
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), len(key)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if lo == hi:
                    continue
                b, kind, c = key[lo].tolist()
                if b != now:
                    now, parts, block, cluster = b, [], None, None
                for i in range(lo, hi, MEMBERS):
                    piece = batch.slice(i, min(MEMBERS, hi - i))
                    ids, ties, labels = (piece.column(x).to_numpy() for x in ("id", "tie", "label"))
                    x = matrix(piece.column("vec"), dims)
                    if kind == 0:
                        parts.append((ids, ties, labels, x))
                        continue
                    if not parts and block is None:
                        continue                                  # a block without candidates
                    if block is None:
                        block, parts = Block(*(np.concatenate(p) for p in zip(*parts, strict=True))), []
                    if c != cluster:
                        cluster, order = c, block.order(centres[c], wide[c])
                    windows = [np.stack(piece.column(n).to_numpy(zero_copy_only=False)) for n in ("low", "high", "need")]
                    row, score, cand, _ = walk(block, *order, x, ids, ties, labels, *windows, k, same)
                    if len(row):
                        w = windows[0].shape[1]
                        yield pa.record_batch([pa.array(ids[row // w]), pa.array(ties[row // w]),
                                               pa.array((row % w).astype(np.int32)), pa.array(score),
                                               pa.array(block.ids[cand])], names=["id", "tie", "w", "score", "other"])
    return run


class Clusters:
    """Centres, assigned anchors (stored) and the angle of every cluster."""

    def __init__(self, anchors: DataFrame, dims: int):
        sample = anchors.orderBy(F.xxhash64("id", "tie")).limit(SAMPLE).toArrow()["vec"].combine_chunks()
        x = matrix(sample, dims)
        self.centres = centres = fit_centres(x, min(CLUSTERS, -(-len(x) // 16)))

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                a = angles(matrix(b.column("vec"), dims), centres)
                near = a.argmin(axis=1) if len(a) else np.zeros(0, np.int64)
                yield pa.record_batch([*b.columns, pa.array(near.astype(np.int32)), pa.array(a[np.arange(len(a)), near])],
                                      names=[*b.schema.names, "cluster", "angle"])

        self.rows = materialize(anchors.mapInArrow(
            assign, "id long, tie long, label int, vec array<int>, cluster int, angle double"))
        self.wide = [0.0] * len(centres)
        for r in self.rows.groupBy("cluster").agg(F.max("angle").alias("a")).collect():
            self.wide[r["cluster"]] = r["a"]


def search(anchors: DataFrame, rows: DataFrame, clusters: Clusters, dims: int, blocks: int, k: int, same: bool) -> DataFrame:
    """(id, tie, w, rank, score, other): first k rows of each window.  ``anchors``: (id, tie, label, vec, cluster,
    low, high, need), one number a window in the last three; ``rows``: (id, tie, label, vec)."""
    seeds = max(int(blocks ** 0.5), 1)
    step = _walker(clusters.centres, clusters.wide, dims, k, same)
    none = F.lit(None).cast("array<long>")
    dealt = rows.select(F.pmod(F.xxhash64("id", "tie"), F.lit(blocks)).cast("int").alias("block"), F.lit(0).alias("kind"),
                        F.lit(0).alias("cluster"), "id", "tie", "label", "vec", none.alias("low"), none.alias("high"), none.alias("need"))

    def over(asked: DataFrame, lo: int, hi: int) -> DataFrame:
        if lo >= hi:
            return None
        copies = asked.select(F.explode(F.sequence(F.lit(lo), F.lit(hi - 1))).alias("block"), F.lit(1).alias("kind"), "cluster",
                              "id", "tie", "label", "vec", "low", "high", "need")
        together = dealt.where(F.col("block").between(lo, hi - 1)).unionByName(copies)
        return together.repartition(hi - lo, "block").sortWithinPartitions("block", "kind", "cluster").mapInArrow(step, _HIT)

    first = materialize(_best(over(anchors, 0, seeds), k))
    rest = None
    if seeds < blocks:
        known = first.where(F.col("rank") == k).groupBy("id", "tie").agg(
            F.map_from_entries(F.collect_list(F.struct("w", "score"))).alias("kth"))
        asked = anchors.join(known, ["id", "tie"], "left").withColumn(
            "need", F.transform("need", lambda x, i: F.greatest(x, F.try_element_at("kth", i.cast("int")))))
        rest = over(asked, seeds, blocks)
    out = first.drop("rank") if rest is None else first.drop("rank").unionByName(rest)
    return _best(out, k)


def _best(hits: DataFrame, k: int) -> DataFrame:
    by = Window.partitionBy("id", "tie", "w").orderBy(F.desc("score"), "other")
    return hits.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def mine(rows: DataFrame, is_anchor: Column, label: Column, positives: int = 5, negatives: int = 10, least: int = 30,
         most: int = 90, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor and each of its
    first ``positives`` rows of the same label, the first ``negatives`` rows of another label whose score is
    between ``least`` and ``most`` hundredths of the positive's.  ``is_anchor`` and ``label`` are columns of ``rows``."""
    spark = rows.sparkSession
    part = rows.withColumns({"__label": label, "__anchor": F.coalesce(is_anchor, F.lit(False))})
    whole = whole_rows(part, vec_col, id_col, F.col("__label"))
    n, dims = whole.agg(F.count("*"), F.max(F.size("vec"))).first()
    dims = max(dims or 0, 1)
    blocks = max(min(n_partitions(spark), -(-n // STEP)), -(-n // BLOCK_ROWS), 1)
    asked = whole_rows(part.where("__anchor"), vec_col, id_col, F.col("__label")).dropDuplicates(["id", "tie"])
    clusters = Clusters(asked.select("id", "tie", "label", "vec"), dims)
    anchors = clusters.rows.drop("angle")
    one = lambda x: F.array(F.lit(x).cast("long"))
    found = search(anchors.withColumns({"low": one(-WIDE), "high": one(WIDE), "need": one(-WIDE)}), whole, clusters,
                   dims, blocks, positives, True)
    liked = materialize(found.select("id", "tie", (F.col("rank") - 1).cast("int").alias("w"), F.col("score").alias("positive_score"),
                                     F.col("other").alias("positive_id")))
    ends = liked.groupBy("id", "tie").agg(F.array_sort(F.collect_list(F.struct(
        "w", _up(F.col("positive_score") * least).alias("low"), _down(F.col("positive_score") * most).alias("high")))).alias("e"))
    full = F.transform(F.sequence(F.lit(0), F.lit(positives - 1)), lambda i: F.get("e", i))
    asked = anchors.join(ends, ["id", "tie"]).withColumn("e", full).withColumns({
        "low": F.transform("e", lambda x: F.coalesce(x["low"], F.lit(WIDE))),
        "high": F.transform("e", lambda x: F.coalesce(x["high"], F.lit(-WIDE)))}).withColumn("need", F.col("low")).drop("e")
    got = search(asked, whole, clusters, dims, blocks, negatives, False)
    return got.join(liked, ["id", "tie", "w"]).select(
        F.col("id").alias("anchor_id"), "positive_id", F.col("rank").cast("int").alias("rank"), F.col("other").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"))


def _down(x: Column) -> Column:
    """floor(x / 100) of a long, without a detour through doubles."""
    return F.floor((x - F.pmod(x, F.lit(100))) / 100).cast("long")


def _up(x: Column) -> Column:
    return -_down(-x)
