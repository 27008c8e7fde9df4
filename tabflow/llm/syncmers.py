"""Document fingerprints from closed syncmers.

A k-mer of code points is an anchor if the smallest hash among its inner s-mers
lies at its first or last place.  Whether a k-mer is an anchor depends on its own
characters only, so equal passages give equal anchors wherever they stand.  A
fingerprint keeps the ``size`` anchors with the smallest hashes and their first
positions: ``hash@position`` items, ascending by hash, joined by commas.

Likeness of two fingerprints: of the ``size`` smallest hashes of their union, the
share that both hold at agreeing positions (within ``slack`` of the commonest
offset).  Two empty fingerprints have likeness 1, an empty and another 0.

Defined cases: null text is empty; an empty text has the fingerprint ''; a text
without anchors (shorter than k, for instance) has one item, the hash of all its
characters at position 0; neighbours follow ascending id (nulls first, ties by text);
the last document's neighbour is the first; an empty table gives an empty result.

Spark side: ids are cut into buckets at quantiles; one shuffle brings every bucket
together, sorted, and each bucket also receives a copy of the first row of the
following one, so that neighbours are found while streaming over sorted partitions.
No group is held in memory: a task keeps one Arrow batch and one carried row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabflow.llm.common import n_partitions
from tabflow.llm.text import mix64

K, S, SIZE = 16, 8, 64
_U = np.uint64
_MUL = 0x9E3779B97F4A7C15
CHARS = 1 << 17
ROWS = 256                              # rows of an Arrow batch taken at a time

Print = tuple[np.ndarray, np.ndarray]


def _roll(x: np.ndarray, width: int) -> np.ndarray:
    """Polynomial hash of every window of ``width`` values, by doubling (width a power of two)."""
    w, base = 1, _MUL
    while w < width:
        x = x[:-w] * _U(base) + x[w:]
        base, w = base * base % 2 ** 64, 2 * w
    return x


def anchors(points: np.ndarray, k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray]:
    """Start and 32-bit hash of each closed syncmer in an array of code points."""
    if len(points) < k:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    inner = _roll(points.astype(np.uint64) + _U(1), s)
    outer = _roll_from(inner, s, k)
    inner = mix64(inner) >> _U(32)
    low, w, need = inner, 1, k - s + 1
    while w < need:
        step = min(w, need - w)
        low = np.minimum(low[:-step], low[step:])
        w += step
    at = np.flatnonzero((inner[:len(low)] == low) | (inner[k - s:k - s + len(low)] == low))
    return at, mix64(outer[at]) >> _U(32)


def _roll_from(x: np.ndarray, have: int, width: int) -> np.ndarray:
    w, base = have, pow(_MUL, have, 2 ** 64)
    while w < width:
        x = x[:-w] * _U(base) + x[w:]
        base, w = base * base % 2 ** 64, 2 * w
    return x


def fingerprints(texts: list[str], k: int = K, s: int = S, size: int = SIZE) -> list[Print]:
    """The fingerprint (hashes ascending, positions) of each text."""
    out: list[Print] = []
    i = 0
    while i < len(texts):
        j, n = i, 0
        while j < len(texts) and (j == i or n + len(texts[j]) <= CHARS):
            n += len(texts[j])
            j += 1
        out += _batch(texts[i:j], k, s, size)
        i = j
    return out


def _batch(texts: list[str], k: int, s: int, size: int) -> list[Print]:
    lens = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    ends = np.cumsum(lens)
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    at, h = anchors(points, k, s)
    row = np.searchsorted(ends, at, side="right")
    inside = at + k <= ends[row] if len(at) else np.zeros(0, bool)
    at, h, row = at[inside], h[inside], row[inside]
    pos = at - (ends - lens)[row]
    order = np.lexsort((pos, h, row))
    row, h, pos = row[order], h[order], pos[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
    row, h, pos = row[new], h[new], pos[new]
    first = np.searchsorted(row, np.arange(len(texts) + 1))
    out = []
    for r, t in enumerate(texts):
        a, b = first[r], min(first[r + 1], first[r] + size)
        if a < b:
            out.append((h[a:b], pos[a:b]))
        elif t:
            whole = int.from_bytes(hashlib.sha256(t.encode("utf-8", "surrogatepass")).digest()[:4], "big")
            out.append((np.array([whole], np.uint64), np.zeros(1, np.int64)))
        else:
            out.append((np.zeros(0, np.uint64), np.zeros(0, np.int64)))
    return out


def render(p: Print) -> str:
    return ",".join(f"{h:08x}@{x}" for h, x in zip(p[0].tolist(), p[1].tolist(), strict=True))


def parse(text: str) -> Print:
    """Inverse of :func:`render`."""
    items = [x.split("@") for x in text.split(",")] if text else []
    return (np.array([int(h, 16) for h, _ in items], np.uint64), np.array([int(x) for _, x in items], np.int64))


def likeness(a: Print, b: Print, size: int = SIZE, slack: int = 64) -> float:
    if not len(a[0]) or not len(b[0]):
        return float(len(a[0]) == len(b[0]))
    union = np.union1d(a[0], b[0])[:size]
    common, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    kept = common <= union[-1]
    if not kept.any():
        return 0.0
    shift = np.sort((a[1][i] - b[1][j])[kept])
    together = np.searchsorted(shift, shift + slack, side="right") - np.arange(len(shift))
    return float(together.max() / len(union))


def _neighbours(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (bucket, tail, id, h, text), partitioned by bucket; ``tail`` rows are copies of a bucket's successor."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    parts = 8 * n_partitions(spark)
    cuts = rows.select(F.col("doc_id").cast("double").alias("x")).na.drop() \
        .approxQuantile("x", [i / parts for i in range(1, parts)], 0.25 / parts)
    cuts = sorted({int(c) for c in cuts})
    rows = rows.withColumn("bucket", _bucket_of(cuts)("doc_id")).withColumn("h", F.xxhash64("text"))
    firsts = sorted((r["bucket"], r["f"]) for r in
                    rows.groupBy("bucket").agg(F.min(F.struct("doc_id", "h")).alias("f")).collect())
    if not firsts:
        return rows.withColumn("tail", F.lit(0))
    heads = spark.createDataFrame(
        [(b, f["doc_id"], f["h"], firsts[i - 1][0]) for i, (b, f) in enumerate(firsts)],
        "bucket int, first_id long, first_h long, before int")
    head = F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("h") == F.col("first_h"))
    own = F.struct(F.col("bucket"), F.lit(0).alias("tail"))
    copy = F.struct(F.col("before").alias("bucket"), F.lit(1).alias("tail"))
    return (rows.join(F.broadcast(heads), "bucket")
            .withColumn("to", F.explode(F.when(head, F.array(own, copy)).otherwise(F.array(own))))
            .select("to.bucket", "to.tail", "doc_id", "h", "text"))


def _bucket_of(cuts: list[int]):
    """Number of cuts below an id (0 for null): a binary search over each Arrow batch of ids."""
    edges = np.array(cuts, np.int64)

    @F.pandas_udf("int")
    def bucket(ids: pd.Series) -> pd.Series:
        known = ids.notna().to_numpy()
        out = np.zeros(len(ids), np.int32)
        out[known] = np.searchsorted(edges, ids[known].to_numpy().astype(np.int64), side="left")
        return pd.Series(out)

    return bucket


def fingerprint_documents(docs: DataFrame, k: int = K, s: int = S, size: int = SIZE,
                          id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint of each text and of its edited text (second half replaced by the next document's start),
    and how like its fingerprint is to the edited text's and the next document's."""
    rows = _neighbours(docs, id_col, text_col)
    parts = n_partitions(docs.sparkSession)
    dealt = rows.repartition(parts, "bucket").sortWithinPartitions(
        "bucket", "tail", F.col("doc_id").asc_nulls_first(), "h")
    schema = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
              "edited_fingerprint string, near_edited double, near_next double")
    names = [c.split()[0] for c in schema.split(", ")]

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried = None                                   # (bucket, id, text, fingerprint)
        for batch in (b.slice(i, ROWS) for b in batches for i in range(0, b.num_rows, ROWS)):
            col = {n: batch.column(n).to_pylist() for n in ("bucket", "tail", "doc_id", "text")}
            prints = fingerprints(col["text"], k, s, size)
            pairs = []
            for bucket, tail, i, text, mine in zip(*col.values(), prints, strict=True):
                if carried is not None and carried[0] == bucket:
                    pairs.append((carried, text, mine))
                carried = None if tail else (bucket, i, text, mine)
            edited = []
            for (_, _, text, _), after, _ in pairs:
                half = len(text) // 2
                edited.append(text[:len(text) - half] + after[:half])
            changed = fingerprints(edited, k, s, size)
            out = [(i, len(text), hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest(),
                    render(mine), render(c), likeness(mine, c, size), likeness(mine, nxt, size))
                   for ((_, i, text, mine), _, nxt), e, c in zip(pairs, edited, changed, strict=True)]
            if out:
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)],
                                      names=names)

    return dealt.mapInArrow(stream, schema)
