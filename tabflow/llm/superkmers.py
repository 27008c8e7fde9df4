"""Substring dedup by super-k-mer partitioning.

A window is ``width`` consecutive words of one document.  Its minimiser is the
smallest hash among its runs of ``inner`` words.  Consecutive windows mostly share
their minimiser; such a run of windows travels as ONE packed string (a super-k-mer)
to the bucket of the minimiser, so a word is sent about three times instead of
``width`` times.  Equal windows have equal minimisers and meet in one bucket, where
sorting brings them together and finds the smallest doc_id of each exactly.

A window is removed from a document if the same words also start in a document
with a smaller id; a word goes if any removed window covers it.  Removal is judged
on the input.

Skew: before anything is sent, a task drops those copies of a super-k-mer string
that belong to larger ids than its own smallest one (their windows are known to be
repeats and are reported at once), so a passage in a third of all documents reaches
its bucket once per few MB of input.  Strings travel compressed, many to a row.

Windows are told apart by 128 bits of hash.

Defined cases: null text has no words; fewer than ``width`` words: nothing removed;
a null id counts as larger than every id; rows with equal id never remove each
other's words; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabflow.llm.common import n_partitions
from tabflow.llm.text import _BYTE, Words, mix64, powers, word_slices

WIDTH, INNER = 13, 3
FLUSH_BYTES = 24 << 20
NO_ID = np.iinfo(np.int64).max
_U = np.uint64
_SECOND = 0xC2B2AE3D27D4EB4F


def plain(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """All words one after another, each followed by one space, and where each starts (one more entry: the end)."""
    lens = words.end - words.start
    at = np.concatenate([[0], np.cumsum(lens + 1)])
    out = np.full(at[-1], 32, np.uint8)
    shift = np.repeat(at[:-1] - (np.cumsum(lens) - lens), lens)
    src = np.repeat(words.start - (np.cumsum(lens) - lens), lens)
    k = np.arange(int(lens.sum()))
    out[k + shift] = words.buf[k + src]
    return out, at


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    w = 1
    while w < width:
        step = min(w, width - w)
        x = np.minimum(x[:-step], x[step:])
        w += step
    return x


def runs(words: Words, width: int, inner: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, number of windows and minimiser of each super-k-mer."""
    counts = np.diff(words.first)
    n_win = np.maximum(counts - width + 1, 0)
    total = int(n_win.sum())
    if not total:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    n = len(words.hash)
    h = np.zeros(n - inner + 1, np.uint64)
    for k in range(inner):
        h = h * _U(0xD6E8FEB86659FD93) + words.hash[k:n - inner + 1 + k]
    low = _sliding_min(mix64(h), width - inner + 1)
    row0 = np.repeat(words.first[:-1], n_win)
    at = row0 + np.arange(total) - np.repeat(np.cumsum(n_win) - n_win, n_win)
    m = low[at]
    new = np.ones(total, bool)
    new[1:] = (m[1:] != m[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    return at[first], np.diff(np.append(first, total)), m[first]


_HEAD = (np.int64, np.int32, np.int32, np.int32, np.int32)   # doc_id, key, start, windows, bytes
_CODEC = pa.Codec("zstd", compression_level=5)


def _planes(a: np.ndarray) -> bytes:
    """Bytes of equal weight side by side: the many zero ones cost nothing when compressed."""
    return np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T.tobytes()


def _pack(strings: list[np.ndarray], *head: np.ndarray) -> bytes:
    body = b"".join([np.array([len(strings)], np.int64).tobytes(),
                     *[_planes(a.astype(k)) for a, k in zip(head, _HEAD, strict=True)],
                     np.concatenate(strings).tobytes()])
    return np.array([len(body)], np.int64).tobytes() + _CODEC.compress(body, asbytes=True)


def _unpack(blob: bytes):
    raw = _CODEC.decompress(blob[8:], int(np.frombuffer(blob, np.int64, 1)[0]), asbytes=True)
    n, at, out = int(np.frombuffer(raw, np.int64, 1)[0]), 8, []
    for kind in _HEAD:
        width = np.dtype(kind).itemsize
        flat = np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n).T
        out.append(np.ascontiguousarray(flat).view(kind)[:, 0])
        at += n * width
    return (*out, np.frombuffer(raw, np.uint8, offset=at))


def _rows(names: list[str], columns: list, kinds: list) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)


SPANS = "bucket int, doc_id long, key int, start int, n int, blob binary"
_NAMES = ["bucket", "doc_id", "key", "start", "n", "blob"]
_KINDS = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]


def _span_batch(ids, keys, starts, n) -> pa.RecordBatch:
    """Rows that already name removed windows (bucket -1)."""
    k = len(ids)
    return _rows(_NAMES, [np.full(k, -1), ids, keys, starts, n, [None] * k], _KINDS)


def _send(buckets: int, width: int, inner: int):
    """Arrow batches of (doc_id, key, text) -> packed super-k-mers by bucket, and spans known at once."""

    def flush(held: list[dict]) -> Iterator[pa.RecordBatch]:
        col = {k: np.concatenate([x[k] for x in held]) for k in ("id", "key", "start", "n", "hash", "min", "len")}
        texts, at = np.concatenate([x["text"] for x in held]), 0
        offs = []
        for x in held:
            offs.append(x["off"] + at)
            at += len(x["text"])
        col["off"] = np.concatenate(offs)
        order = np.lexsort((col["id"], col["len"], col["hash"]))
        h, ln, ids = col["hash"][order], col["len"][order], col["id"][order]
        new = np.ones(len(order), bool)
        new[1:] = (h[1:] != h[:-1]) | (ln[1:] != ln[:-1])
        least = ids[np.flatnonzero(new)][np.cumsum(new) - 1]
        repeat = order[ids > least]
        if len(repeat):
            yield _span_batch(col["id"][repeat], col["key"][repeat], col["start"][repeat], col["n"][repeat])
        kept = order[ids == least]
        bucket = (col["min"][kept] % _U(buckets)).astype(np.int64)
        by = np.argsort(bucket, kind="stable")
        kept, bucket = kept[by], bucket[by]
        edges = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1))
        blobs = []
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            own = kept[a:b]
            parts = [texts[o:o + n] for o, n in zip(col["off"][own].tolist(), col["len"][own].tolist(), strict=True)]
            blobs.append(_pack(parts, col["id"][own], col["key"][own], col["start"][own], col["n"][own],
                               col["len"][own]))
        k = len(blobs)
        none = [None] * k
        yield _rows(_NAMES, [bucket[edges[:-1]], none, none, none, none, blobs], _KINDS)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            keys = batch.column(1).to_numpy(zero_copy_only=False)
            for i, _, words in word_slices(batch.column(2), lower=False):
                first, n, low = runs(words, width, inner)
                if not len(first):
                    continue
                text, at = plain(words)
                row = np.searchsorted(words.first, first, side="right") - 1
                last = first + n + width - 1
                lens = at[last] - at[first]
                up, down = powers(len(text) + 1)
                total = np.zeros(len(text) + 1, np.uint64)
                np.cumsum(_BYTE[text] * up[:len(text)], out=total[1:])
                held.append({"id": ids[i + row], "key": keys[i + row], "start": first - words.first[row], "n": n,
                             "hash": (total[at[last]] - total[at[first]]) * down[at[first]], "min": low,
                             "len": lens, "off": at[first], "text": text})
                size += len(text)
                if size >= FLUSH_BYTES // 3:
                    yield from flush(held)
                    held, size = [], 0
        if held:
            yield from flush(held)

    return stream


def _judge(width: int):
    """Packed super-k-mers of a bucket -> spans of windows that start in a document with a smaller id too."""

    def bucket(blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        parts = [_unpack(b) for b in blobs]
        ids, keys, starts = (np.concatenate([p[k] for p in parts]) for k in range(3))
        one, two, owner, offset, base = [], [], [], [], 0
        for p in parts:
            text, n = p[5], p[3].astype(np.int64)
            cut = np.flatnonzero(text == 32)
            begin = np.concatenate([[0], cut[:-1] + 1])
            for a, b, w in _word_hash(text, begin, cut, n, width):
                own = np.repeat(np.arange(a, b), n[a:b])
                at = np.arange(len(own)) - np.repeat(np.cumsum(n[a:b]) - n[a:b], n[a:b])
                where = own - a
                first = np.cumsum(n[a:b] + width - 1) - (n[a:b] + width - 1)
                lead = first[where] + at
                h1, h2 = np.zeros(len(w) - width + 1, np.uint64), np.zeros(len(w) - width + 1, np.uint64)
                for j in range(width):
                    x = w[j:len(w) - width + 1 + j]
                    h1 = h1 * _U(0xD6E8FEB86659FD93) + x
                    h2 = (h2 ^ x) * _U(_SECOND)
                one.append(h1[lead])
                two.append(h2[lead])
                owner.append((own + base).astype(np.int32))
                offset.append(at.astype(np.int32))
            base += len(p[0])
        one, two = np.concatenate(one), np.concatenate(two)
        owner, offset = np.concatenate(owner), np.concatenate(offset)
        order = np.argsort(one, kind="stable")
        h1 = one[order]
        same = h1[1:] == h1[:-1]
        shared = np.zeros(len(order), bool)            # only windows that are not alone go on
        shared[1:] |= same
        shared[:-1] |= same
        order = order[shared]
        order = order[np.lexsort((ids[owner[order]], two[order], one[order]))]
        h1, h2, who = one[order], two[order], ids[owner[order]]
        new = np.ones(len(order), bool)
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        least = who[np.flatnonzero(new)][np.cumsum(new) - 1] if len(order) else who
        gone = np.sort(order[who > least])             # window order: super-k-mer by super-k-mer
        if not len(gone):
            return
        o, f = owner[gone], offset[gone]
        new = np.ones(len(gone), bool)
        new[1:] = (o[1:] != o[:-1]) | (f[1:] != f[:-1] + 1)
        head = np.flatnonzero(new)
        length = np.diff(np.append(head, len(gone)))
        yield _span_batch(ids[o[head]], keys[o[head]], starts[o[head]] + f[head], length)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, blobs = None, []
        for batch in batches:
            for b, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if b != now and blobs:
                    yield from bucket(blobs)
                    blobs = []
                now = b
                blobs.append(blob)
        if blobs:
            yield from bucket(blobs)

    return stream


def _word_hash(text, begin, cut, n_win, width, limit=4 << 20):
    """(a, b, word hashes) of super-k-mers a..b of a packed text, a few MB at a time."""
    words = n_win + width - 1
    last = np.cumsum(words)
    a = 0
    while a < len(words):
        w0 = int(last[a] - words[a])
        b = max(a + 1, int(np.searchsorted(begin[np.minimum(last, len(begin)) - 1], begin[w0] + limit)))
        b = min(b, len(words))
        w1 = int(last[b - 1])
        lo, hi = int(begin[w0]), int(cut[w1 - 1]) + 1
        part = text[lo:hi]
        up, down = powers(len(part) + 1)
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_BYTE[part] * up[:len(part)], out=total[1:])
        s, e = begin[w0:w1] - lo, cut[w0:w1] - lo
        yield a, b, mix64((total[e] - total[s]) * down[s])
        a = b


def repeated_spans(docs: DataFrame, width: int = WIDTH, inner: int = INNER) -> DataFrame:
    """(doc_id, key, start, n): windows start .. start+n-1 (word places) of a row that also start in a document
    with a smaller id.  ``docs`` has (doc_id, key, text); ``key`` (32 bits) tells rows of one id apart; a null id
    comes back as the largest long."""
    parts = n_partitions(docs.sparkSession)
    sent = docs.select("doc_id", "key", "text").mapInArrow(_send(4 * parts, width, inner), SPANS)
    # packed rows go to their buckets, rows that are spans already spread evenly, in one shuffle
    deal = F.when(F.col("bucket") >= 0, F.col("bucket").cast("long")).otherwise(F.xxhash64("doc_id", "start"))
    dealt = sent.select("bucket", "doc_id", "key", "start", "n", "blob", deal.alias("to")) \
        .repartition(parts, "to").sortWithinPartitions("bucket")
    judge = _judge(width)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed():
            for batch in batches:
                known = batch.filter(pc.less(batch.column(0), 0))
                if known.num_rows:
                    ready.append(known.select([1, 2, 3, 4]))
                rest = batch.filter(pc.greater_equal(batch.column(0), 0))
                if rest.num_rows:
                    yield rest.select([0, 5])

        ready: list[pa.RecordBatch] = []
        for out in judge(packed()):
            yield from ready
            ready.clear()
            yield out.select([1, 2, 3, 4])
        yield from ready

    return dealt.drop("to").mapInArrow(stream, "doc_id long, key int, start int, n int")


def remove_repeats(docs: DataFrame, width: int = WIDTH, inner: int = INNER, id_col: str = "doc_id",
                   text_col: str = "text", digest: bool = False) -> DataFrame:
    """Per row: doc_id, n_words, n_removed and ``kept_text`` (kept words joined by one space),
    or ``kept_sha256`` of it with ``digest``."""
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc_id"),
                       F.hash(F.col(text_col)).alias("key"), F.col(text_col).alias("text"))
    spans = (repeated_spans(rows, width, inner).groupBy("doc_id", "key")
             .agg(F.collect_set(F.struct("start", "n")).alias("spans")))
    joined = rows.join(spans, ["doc_id", "key"], "left").select(
        F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id"), "text", "spans")
    last = "kept_sha256" if digest else "kept_text"
    names = ["doc_id", "n_words", "n_removed", last]

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            spans = batch.column(2)
            starts, lengths = spans.flatten().flatten()
            count = pc.fill_null(pc.list_value_length(spans), 0).to_numpy(zero_copy_only=False)
            begin = np.concatenate([[0], np.cumsum(count)])
            start, n = (x.to_numpy(zero_copy_only=False) for x in (starts, lengths))
            for i, j, words in word_slices(batch.column(1), lower=False):
                a, b = begin[i], begin[j]
                first = words.first[np.repeat(np.arange(j - i), count[i:j])] + start[a:b]
                edge = np.zeros(len(words.start) + 1, np.int64)
                np.add.at(edge, first, 1)
                np.add.at(edge, first + n[a:b] + width - 1, -1)
                gone = np.cumsum(edge[:-1]) > 0
                text, at = plain(words)
                kept = text[np.repeat(~gone, np.diff(at))]
                size = np.concatenate([[0], np.cumsum(np.diff(at) * ~gone)])
                out = []
                for r in range(j - i):
                    w0, w1 = words.first[r], words.first[r + 1]
                    raw = kept[size[w0]:max(size[w1] - 1, size[w0])].tobytes()
                    out.append(hashlib.sha256(raw).hexdigest() if digest else raw.decode("utf-8", "replace"))
                lost = np.concatenate([[0], np.cumsum(gone)])
                yield pa.record_batch([
                    pa.array(ids[i:j], pa.int64()), pa.array(np.diff(words.first), pa.int64()),
                    pa.array(lost[words.first[1:]] - lost[words.first[:-1]], pa.int64()),
                    pa.array(out, pa.string())], names=names)

    return joined.mapInArrow(stream, f"doc_id long, n_words long, n_removed long, {last} string")
