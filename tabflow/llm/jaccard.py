"""Exact Jaccard join of shingle sets as a metric-space join.

Jaccard distance is a metric.  Two texts are linked when their distance is at most
``r = 1 - threshold``; the result gives each text its connected component.

1. Equal sets are one point (a digest of the set); everything below works on points.
2. Only shared shingles can bring points together.  Shingles travel packed to hash
   buckets, which count in how many points each occurs and send that number back to
   the points.  A point with more than the share ``r`` of shingles of its own has no
   link and leaves.
3. With shingles ordered from rare to common (number of points, then hash), two linked
   points must share one of the first ``n - ceil(threshold * n) + 1``.  Sizes are cut into
   bands as wide as a link allows; the points of a band and of the band below that share
   such a shingle elect a pivot, the point with the smallest share of shingles of its own,
   the centre of a cell.  A point belongs to the cell of every pivot elected by one of its
   rare shingles in its band or the next; any two linked points (their bands are the same or
   neighbours) meet in at least one cell.
4. The distance of every member to its pivot is computed exactly.  Members within ``r``
   are linked to it, so pairs among them need no test: they are connected.
5. Members farther than ``r`` are the boundary of a cell.  By the triangle inequality
   such a point can only be linked to members whose distance to the pivot differs by at
   most ``r``: a cell is cut into rings of that width and each boundary point is
   replicated into its own ring and the neighbouring ones.  Rings are split into tiles of
   bounded size and joined exactly, skipping points that are already connected.  A
   parity sketch (symmetric differences can only cancel) rejects far pairs before their
   sets are compared.  Cells whose members are already one component are dropped.

Components come from contracting links until none is left.  Sets are compared by 64-bit
shingle hashes.  No group is held whole: buckets hold hashes, cells are joins and
aggregations, tiles are bounded.

Defined cases: a text with fewer words than a shingle is one shingle (all its words); a
text without words is linked with nothing and is its own component; equal ids are equal
documents for the component id; a null id counts as larger than every id; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabflow.llm.common import n_partitions, row_hash
from tabflow.llm.text import Words, mix64, windows, word_slices
from tabflow.session import materialize

SHINGLE = 5
FLUSH = 1_500_000                       # shingles packed at a time
TILE = 1000
_U = np.uint64


def shingle_sets(words: Words, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash) of the distinct shingles, ordered by both, and the set size of each row."""
    n_words = np.diff(words.first)
    at, h = windows(words, size)
    row = np.searchsorted(words.first, at, side="right") - 1
    rows, hashes = [row], [h]
    for k in range(1, size):
        short = np.flatnonzero(n_words == k)
        if len(short):
            x = np.full(len(short), k, np.uint64)
            for j in range(k):
                x = mix64(x * _U(0xD6E8FEB86659FD93) + words.hash[words.first[short] + j])
            rows.append(short)
            hashes.append(x)
    row, h = np.concatenate(rows), np.concatenate(hashes)
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
    row, h = row[new], h[new]
    return row, h, np.bincount(row, minlength=len(n_words))


def set_digest(row: np.ndarray, h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """64-bit digest of each row's set (0 for an empty one)."""
    total = np.zeros(len(n), np.uint64)
    if len(h):
        first = np.flatnonzero(np.diff(row, prepend=-1))
        total[row[first]] = np.add.reduceat(mix64(h ^ _U(0xA24BAED4963EE407)), first)
    return np.where(n > 0, mix64(total + n.astype(np.uint64)) | _U(1), _U(0)).astype(np.uint64)


def _batch(names: str, columns: list, kinds: list) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names.split())


def describe_sets(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, key, n, point) per row of (doc_id, key, text); ``point`` is the set's digest."""
    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i, j, words in word_slices(batch.column(2), lower=True):
                row, h, n = shingle_sets(words, size)
                yield _batch("doc_id key n point", [ids[i:j], keys[i:j], n, set_digest(row, h, n).view(np.int64)],
                             [pa.int64()] * 4)
    return docs.mapInArrow(stream, "doc_id long, key long, n long, point long")


# ---------------------------------------------------------------- packed postings

def _planes(a: np.ndarray) -> bytes:
    return a.view(np.uint8).reshape(len(a), -1).T.tobytes()


def _unplane(raw: pa.Buffer, n: int, kind, at: int) -> tuple[np.ndarray, int]:
    width = np.dtype(kind).itemsize
    flat = np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n).T
    return np.ascontiguousarray(flat).view(kind)[:, 0], at + n * width


def pack(points: np.ndarray, sizes: np.ndarray, owner: np.ndarray, h: np.ndarray, *more: np.ndarray) -> bytes:
    """Postings with ascending hashes within a blob: owner indexes ``points``; byte planes, compressed."""
    raw = b"".join([np.array([len(points), len(h), len(more)], np.int64).tobytes(), _planes(points),
                    _planes(sizes.astype(np.uint32)), _planes(owner.astype(np.uint32)),
                    _planes(np.diff(h, prepend=_U(0))), *[_planes(m.astype(np.uint32)) for m in more]])
    return np.array([len(raw)], np.int64).tobytes() + pa.compress(raw, "zstd", asbytes=True)


def unpack(blob: pa.Buffer) -> list[np.ndarray]:
    raw = pa.decompress(blob.slice(8), int(np.frombuffer(blob, np.int64, 1)[0]), "zstd")
    k, n, extra = np.frombuffer(raw, np.int64, 3).tolist()
    points, at = _unplane(raw, k, np.uint64, 24)
    sizes, at = _unplane(raw, k, np.uint32, at)
    owner, at = _unplane(raw, n, np.uint32, at)
    h, at = _unplane(raw, n, np.uint64, at)
    out = [points, sizes, owner, np.cumsum(h, dtype=np.uint64)]
    for _ in range(extra):
        m, at = _unplane(raw, n, np.uint32, at)
        out.append(m)
    return out


def _deal(bucket: np.ndarray, points, sizes, owner, h, *more) -> Iterator[tuple[int, bytes]]:
    """One blob per bucket; ``bucket`` is per posting, hashes ascend within each."""
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    edges = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1))
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        own = order[a:b]
        used, local = np.unique(owner[own], return_inverse=True)
        yield int(bucket[a]), pack(points[used], sizes[used], local, h[own], *[m[own] for m in more])


_BLOBS = "bucket int, blob binary"


def _blob_rows(items: Iterator[tuple[int, bytes]]) -> pa.RecordBatch | None:
    items = list(items)
    if not items:
        return None
    b, x = zip(*items, strict=True)
    return _batch("bucket blob", [b, x], [pa.int32(), pa.binary()])


def _merge(batches: Iterator[pa.RecordBatch]) -> list[np.ndarray]:
    """All postings of one bucket: points, sizes, owner, hash and further columns.  Blobs are read where Arrow holds
    them, and each list of pieces goes as soon as it is joined."""
    parts = [unpack(x.as_buffer()) for batch in batches for x in batch.column(1)]
    columns = [list(c) for c in zip(*parts, strict=True)]
    del parts
    points, at, where = np.unique(np.concatenate(columns[0]), return_index=True, return_inverse=True)
    sizes = np.concatenate(columns[1])[at]
    where, base = where.astype(np.int32), 0
    for i, (p, own) in enumerate(zip(columns[0], columns[2], strict=True)):
        columns[2][i] = where[base + own.astype(np.int64)]
        base += len(p)
    out = [points, sizes]
    for k in range(2, len(columns)):
        out.append(np.concatenate(columns[k]))
        columns[k] = []
    return out


def _send_shingles(size: int, buckets: int):
    def flush(held) -> pa.RecordBatch | None:
        points = np.concatenate([x[0] for x in held])
        sizes = np.concatenate([x[1] for x in held])
        base, owner = 0, []
        for x in held:
            owner.append(x[2] + np.int32(base))
            base += len(x[0])
        owner, h = np.concatenate(owner), np.concatenate([x[3] for x in held])
        held.clear()
        first = np.zeros(len(points), bool)                 # equal sets in this flush are sent once
        first[np.unique(points, return_index=True)[1]] = True
        keep = first[owner]
        owner, h = owner[keep], h[keep]
        order = np.argsort(h, kind="stable")
        owner, h = owner[order], h[order]
        bucket = (((h >> _U(32)) * _U(buckets)) >> _U(32)).astype(np.int64)
        return _blob_rows(_deal(bucket, points, sizes, owner, h))

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n_held = [], 0
        for batch in batches:
            for _, _, words in word_slices(batch.column(0), lower=True):
                row, h, n = shingle_sets(words, size)
                held.append((set_digest(row, h, n), n, row.astype(np.int32), h))
                n_held += len(h)
                if n_held >= FLUSH:
                    out = flush(held)
                    if out is not None:
                        yield out
                    held, n_held = [], 0
        if n_held:
            out = flush(held)
            if out is not None:
                yield out
    return stream


def _count_points(buckets: int):
    """Postings of a hash bucket -> postings of shared shingles with their number of points, dealt by point."""
    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points, sizes, owner, h = _merge(batches)
        order = np.lexsort((owner, h))
        owner, h = owner[order], h[order]
        del order
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
        owner, h = owner[new], h[new]
        start = np.flatnonzero(np.diff(h, prepend=h[:1] ^ _U(1)))
        count = np.diff(np.append(start, len(h))).astype(np.int32)
        df = np.repeat(count, count)
        shared = df > 1
        if shared.any():
            owner, h, df = owner[shared], h[shared], df[shared]
            to = (points[owner] % _U(buckets)).astype(np.int64)
            yield _blob_rows(_deal(to, points, sizes, owner, h, df))
    return stream


def _gather(percent: int):
    """Shared shingles by point -> points that may have links: their shared set and their rare shingles."""
    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points, sizes, owner, h, df = _merge(batches)
        shared = np.bincount(owner, minlength=len(points))
        sizes = sizes.astype(np.int64)
        least = -(-percent * sizes // 100)
        rare = sizes - least + 1 - (sizes - shared)         # shingles of its own come first in the order
        order = np.lexsort((h, df, owner))
        owner, h = owner[order], h[order]
        first = np.searchsorted(owner, np.arange(len(points) + 1))
        out = []
        for p in np.flatnonzero(rare > 0).tolist():
            own = h[first[p]:first[p + 1]]
            out.append((int(points[p].astype(np.int64)), int(sizes[p]), float((sizes[p] - shared[p]) / sizes[p]),
                        np.sort(own).tobytes(), own[:rare[p]].astype(np.int64)))
            if len(out) == 512:
                yield _points(out)
                out = []
        if out:
            yield _points(out)
    return stream


def _points(rows) -> pa.RecordBatch:
    return _batch("point n own shared rare", list(zip(*rows, strict=True)),
                  [pa.int64(), pa.int64(), pa.float64(), pa.binary(), pa.list_(pa.int64())])


def candidate_points(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Stored (point, n, own, shared, rare): points at most (100 - percent) % of whose shingles are their own;
    ``shared`` are the sorted hashes of the others, ``rare`` the leading ones in the order rare to common."""
    parts = n_partitions(docs.sparkSession)
    buckets = 2 * parts

    def by_bucket(df):
        # a Python worker gets one bucket at a time, however many of them a partition has
        return df.repartition(parts, "bucket").groupBy("bucket")

    sent = by_bucket(docs.select("text").mapInArrow(_send_shingles(size, buckets), _BLOBS))
    back = by_bucket(sent.applyInArrow(_count_points(buckets), _BLOBS))
    return materialize(back.applyInArrow(
        _gather(percent), "point long, n long, own double, shared binary, rare array<long>"))


# ---------------------------------------------------------------- cells

def cells(points: DataFrame, percent: int) -> DataFrame:
    """(point, pivot) distinct, point <> pivot: cells elected by the rare shingles within bands of size."""
    # a little wider than the ratio of two linked sizes, so that rounding cannot put them two bands apart
    step = math.log(100 / min(percent, 99)) * (1 + 1e-6)
    banded = points.withColumn("size_band", F.floor(F.log("n") / step).cast("int"))
    listed = (banded.select("point", "own", "size_band", F.explode("rare").alias("h"))
              .withColumn("up", F.explode(F.array(F.lit(0), F.lit(1))))
              .select("h", (F.col("size_band") + F.col("up")).alias("band"), "point", "own", "up"))
    # without a point of its own band a group is part of the one below
    elected = (listed.groupBy("h", "band").agg(F.min(F.struct("own", "point")).alias("p"),
                                               F.count(F.lit(1)).alias("m"), F.min("up").alias("least"))
               .filter("m > 1 AND least = 0").select("h", "band", F.col("p.point").alias("pivot")))
    return (listed.select("h", "band", "point").join(elected, ["h", "band"]).filter("point <> pivot")
            .select("point", "pivot").distinct())


def _common(a: pa.Buffer, b: pa.Buffer) -> int:
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return int((y[at] == x).sum()) if len(y) else 0


def measure(pairs: DataFrame, points: DataFrame) -> DataFrame:
    """(point, pivot, union, common) of every pair."""
    sets = points.select("point", "n", "shared")
    both = (pairs.join(sets, "point")
            .join(sets.select(F.col("point").alias("pivot"), F.col("n").alias("n_pivot"),
                              F.col("shared").alias("pivot_shared")), "pivot"))

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            common = np.array([_common(x.as_buffer(), y.as_buffer())
                               for x, y in zip(b.column(4), b.column(5), strict=True)], np.int64)
            n = b.column(2).to_numpy() + b.column(3).to_numpy()
            yield pa.record_batch([b.column(0), b.column(1), pa.array(n - common), pa.array(common)],
                                  names=["point", "pivot", "union", "common"])

    return both.select("point", "pivot", "n", "n_pivot", "shared", "pivot_shared").mapInArrow(
        stream, "point long, pivot long, union long, common long")


def components(links: DataFrame) -> DataFrame:
    """(node, comp) of the nodes of (a, b) links: contraction to the smallest neighbour until no link is left."""
    label = None
    while True:
        edges = materialize(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
                            .filter("a <> b").distinct())
        if edges.isEmpty():
            break
        ends = edges.union(edges.select("b", "a"))
        hook = ends.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")) \
            .select("node", F.least("node", "m").alias("up"))
        hook = materialize(hook)
        up2 = hook.select(F.col("node").alias("up"), F.col("up").alias("up2"))
        hook = materialize(hook.join(up2, "up").select("node", F.col("up2").alias("up")))
        if label is None:
            label = hook.select("node", F.col("up").alias("comp"))
        else:
            to = hook.select(F.col("node").alias("comp"), "up")
            label = label.join(to, "comp", "left").select("node", F.coalesce("up", "comp").alias("comp"))
        label = materialize(label)
        links = (edges.join(hook.select(F.col("node").alias("a"), F.col("up").alias("ua")), "a")
                 .join(hook.select(F.col("node").alias("b"), F.col("up").alias("ub")), "b")
                 .select(F.col("ua").alias("a"), F.col("ub").alias("b")))
    if label is None:
        return links.select(F.col("a").alias("node"), F.col("b").alias("comp"))
    return label


# ---------------------------------------------------------------- boundary

SKETCH = 1024


def _sketches(sets: list[np.ndarray]) -> np.ndarray:
    """Parity of the number of hashes falling on each of SKETCH bits; |x ^ y| is at least the bits that differ."""
    out = np.zeros((len(sets), SKETCH), np.uint8)
    for i, s in enumerate(sets):
        out[i] = np.bincount((mix64(s) % _U(SKETCH)).astype(np.int64), minlength=SKETCH) & 1
    return np.packbits(out, axis=1).view(np.uint64)


def _join_tile(percent: int):
    """Boundary points against ring members of one tile -> links that connect different components."""
    def run(t):
        home = np.array(t.column("home").to_pylist())
        comp = t.column("comp").to_numpy()
        point = t.column("point").to_numpy()
        n = t.column("n").to_numpy()
        own = t.column("own_n").to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in t.column("shared").to_pylist()]
        members, bounds = np.flatnonzero(home), np.flatnonzero(~home)
        found = []
        if len(members) and len(bounds):
            sketch = _sketches(sets)
            leader = {c: c for c in comp.tolist()}

            def top(c):
                while leader[c] != c:
                    leader[c] = leader[leader[c]]
                    c = leader[c]
                return c

            for b in bounds.tolist():
                # own shingles differ for certain; shared ones differ in at least the sketch's bits
                differ = np.bitwise_count(sketch[members] ^ sketch[b]).sum(1) + own[members] + own[b]
                # common = (n1 + n2 - differ) / 2, union = (n1 + n2 + differ) / 2
                total = n[members] + n[b]
                near = members[100 * (total - differ) >= percent * (total + differ)]
                for m in near.tolist():
                    if top(int(comp[b])) == top(int(comp[m])):
                        continue
                    common = len(np.intersect1d(sets[b], sets[m], assume_unique=True))
                    if 100 * common >= percent * (n[b] + n[m] - common):
                        leader[top(int(comp[b]))] = top(int(comp[m]))
                        found.append((int(point[b]), int(point[m])))
        a, b = zip(*found, strict=True) if found else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})
    return run


def boundary_links(measured: DataFrame, points: DataFrame, label: DataFrame, percent: int) -> DataFrame:
    """Links between components inside cells, found from boundary points ring by ring."""
    width = (100 - percent) / 100
    comp = label.select(F.col("node").alias("point"), "comp")
    pivots = measured.select("pivot").distinct().select("pivot", F.col("pivot").alias("point"), F.lit(0.0).alias("d"))
    member = (measured.select("pivot", "point", (1 - F.col("common") / F.col("union")).alias("d"))
              .unionByName(pivots).join(comp, "point", "left")
              .withColumn("comp", F.coalesce("comp", "point")))
    member = materialize(member.withColumn("ring", F.floor(F.col("d") / width).cast("int")))
    far = F.col("d") > width + 1e-12
    size = (member.groupBy("pivot").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
            .filter("lo <> hi").select("pivot"))
    # stored, so that the sums below are made where the rows lie and a large cell never meets in one task
    mixed = materialize(member.join(size, "pivot"))
    rings = mixed.groupBy("pivot", "ring").agg(
        F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("tiles"),
        F.ceil(F.sum(far.cast("int")) / TILE).cast("int").alias("far_tiles"))
    spread = F.pmod(F.xxhash64("point"), F.lit(1 << 30))
    # a boundary point of ring k goes to the members of rings k-1, k and k+1, tile by tile
    bounds = (mixed.filter(far).join(rings.select("pivot", "ring", "far_tiles"), ["pivot", "ring"])
              .select("pivot", "point", "comp", F.col("ring").alias("from"),
                      F.pmod(spread, F.col("far_tiles")).cast("int").alias("far_tile"),
                      F.explode(F.array(F.col("ring") - 1, F.col("ring"), F.col("ring") + 1)).alias("ring"))
              .join(rings.select("pivot", "ring", "tiles"), ["pivot", "ring"])
              .withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).drop("tiles")
              .withColumn("home", F.lit(False)))
    sources = bounds.select("pivot", "ring", "from", "far_tile").distinct()
    homes = (mixed.join(rings.select("pivot", "ring", "tiles"), ["pivot", "ring"])
             .select("pivot", "point", "comp", "ring", F.pmod(spread, F.col("tiles")).cast("int").alias("tile"))
             .join(sources, ["pivot", "ring"]).withColumn("home", F.lit(True)))
    sets = points.select("point", "n", "shared", F.round(F.col("own") * F.col("n")).cast("long").alias("own_n"))
    rows = homes.unionByName(bounds).join(sets, "point")
    keys = ["pivot", "ring", "tile", "from", "far_tile"]
    return rows.select(*keys, "home", "point", "comp", "n", "own_n", "shared").groupBy(*keys).applyInArrow(
        _join_tile(percent), "a long, b long")


# ---------------------------------------------------------------- the join

def jaccard_components(docs: DataFrame, size: int = SHINGLE, percent: int = 75, id_col: str = "doc_id",
                       text_col: str = "text") -> DataFrame:
    """(doc_id, key, n_shingles, point, component_id) per row: ``component_id`` is the smallest id reachable by links;
    ``point`` names the set (equal sets, equal points), ``key`` is ``row_hash`` of the row."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), row_hash(id_col, text_col).alias("key"),
                       F.col(text_col).alias("text"))
    described = materialize(describe_sets(rows, size))
    points = candidate_points(rows, size, percent)
    measured = materialize(measure(cells(points, percent), points))
    linked = F.col("common") * 100 >= percent * F.col("union")
    links = materialize(measured.filter(linked).select(F.col("point").alias("a"), F.col("pivot").alias("b")))
    label = components(links)
    more = materialize(boundary_links(measured, points, label, percent))
    if not more.isEmpty():
        label = components(links.union(more))
    smallest = (described.filter("n > 0").groupBy("point").agg(F.min("doc_id").alias("least"))
                .join(label.select(F.col("node").alias("point"), "comp"), "point", "left")
                .withColumn("comp", F.coalesce("comp", "point")))
    named = smallest.groupBy("comp").agg(F.min("least").alias("component_id"))
    of_point = smallest.join(named, "comp").select("point", "component_id")
    return (described.join(of_point, "point", "left")
            .select("doc_id", "key", F.col("n").alias("n_shingles"), "point",
                    F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of each component, that with the smallest id (texts without words all stay); columns as given."""
    found = jaccard_components(docs, id_col=id_col, text_col=text_col, **options)
    lost = (found.filter(~F.col("component_id").eqNullSafe(F.col("doc_id")))
            .select(F.col("key").alias("_lost")).distinct())
    return docs.join(lost, row_hash(id_col, text_col) == F.col("_lost"), "left_anti").select(*docs.columns)
