"""Spelling variants: words one edit apart, found by probing Bloom filters of the vocabulary.

``near_pairs`` finds all pairs of words that differ by one inserted, deleted or replaced
code point:

1. The vocabulary is cut into shards by word length, each with a blocked Bloom filter of
   its own (blocks of eight 32-bit lanes, one bit a lane), in segments of at most a MB
   that are built by grouped tasks.  The filters are broadcast in rounds of at most
   ``filter_bytes``; a small vocabulary needs one round, a large one more.
2. Every word generates its edits as hashes: deletions, to be looked up one length below,
   and replacements by a larger letter, to be looked up at its own length.  As nearness is
   symmetric, each pair is generated from one side (an insertion is the other word's
   deletion).  A polynomial hash makes an edit's hash from the word's by one addition, so
   no edit is spelt out before the filter has said yes.
3. Only positives are spelt out and joined to the vocabulary, which removes the false ones.

``variant_forms`` then gives each word its form (the near word of largest n, if that is at
least twice its own) and its root, by pointer doubling: n doubles along every form, so a
chain has at most log2(n) links.

Defined cases: a null text has no words, a null id counts as the empty text before the
colon; runs longer than any word list are words like others; equal n is decided by code
point order; repeated rows count again; an empty table gives an empty result.  The letters
tried are the code points that occur in the vocabulary.  Hot words are summed inside their
tasks before the shuffle; a word has at most length x letters near words, so no join key is hot.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabflow.llm.text import mix64
from tabflow.session import materialize

RUN = "[A-Za-zÀ-ÿ]+"
LANES = 8                           # lanes of 32 bits in a block
KEYS_PER_BLOCK = 16                 # 16 bits a word
SEGMENT = 1 << 15                   # blocks in a segment (1 MB)
PROBES = 1 << 20                    # hashes probed at a time
_U = np.uint64
_BASE = 0xD1342543DE82EF95
_BACK = pow(_BASE, -1, 2 ** 64)
_SALT = np.random.default_rng(20250611).integers(1, 2 ** 31, LANES, dtype=np.uint64) * _U(2) + _U(1)

#: (length, segment) -> lanes of its blocks; number of blocks by length
Filters = dict[tuple[int, int], np.ndarray]


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 5,
               min_count: int = 3, erase: int = 97) -> DataFrame:
    """(word, n): lower-cased letter runs of all texts with at least ``min_length`` code points and ``min_count``
    occurrences.  A run whose crc32 (after id and colon) ``erase`` divides loses its code point crc % length."""
    runs = docs.select(
        F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("doc"),
        F.explode(F.expr(f"regexp_extract_all({_name(text_col)}, '{RUN}', 0)")).alias("run"))
    low = runs.select("doc", F.translate("run", string.ascii_uppercase, string.ascii_lowercase).alias("run")) \
        .where(F.length("run") >= min_length)
    crc = low.select("run", F.crc32(F.concat_ws(":", "doc", "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + F.lit(2), F.length("run")))
    words = crc.select(F.when(F.col("h") % erase == 0, cut).otherwise(F.col("run")).alias("word"))
    return (words.where(F.length("word") >= min_length).groupBy("word").agg(F.count("*").alias("n"))
            .where(F.col("n") >= min_count))


def _name(col: str) -> str:
    return "`" + col.replace("`", "``") + "`"


def _powers(n: int, base: int) -> np.ndarray:
    a = np.full(max(n, 1), _U(base), np.uint64)
    a[0] = 1
    return np.multiply.accumulate(a)


def _by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(indices, code point matrix) of the words of each length."""
    lens = np.fromiter(map(len, words), np.int64, len(words))
    for n in np.unique(lens):
        at = np.flatnonzero(lens == n)
        if n:
            joined = "".join(words[i] for i in at).encode("utf-32-le", "surrogatepass")
            yield at, np.frombuffer(joined, np.uint32).reshape(len(at), n).astype(np.uint64)


def word_hashes(points: np.ndarray) -> np.ndarray:
    """Polynomial hash of each row of code points (not yet mixed)."""
    return (points * _powers(points.shape[1], _BASE)).sum(axis=1, dtype=np.uint64)


def place(mixed: np.ndarray, blocks: int) -> np.ndarray:
    """Block of a mixed hash (by its upper half)."""
    return ((mixed >> _U(32)) * _U(blocks)) >> _U(32)


def _bit(mixed: np.ndarray, lane: int) -> np.ndarray:
    key = mixed & _U(0xFFFFFFFF)
    return np.uint32(1) << (((key * _SALT[lane]) & _U(0xFFFFFFFF)) >> _U(27)).astype(np.uint32)


def build_segment(mixed: np.ndarray, blocks: int, segment: int, size: int = SEGMENT) -> np.ndarray:
    """Lanes of one segment's blocks (``size`` at most) that hold all the given hashes."""
    own = min(size, blocks - segment * size)
    lanes = np.zeros((own, LANES), np.uint32)
    at = (place(mixed, blocks) - _U(segment * size)).astype(np.int64)
    for k in range(LANES):
        np.bitwise_or.at(lanes[:, k], at, _bit(mixed, k))
    return lanes


def probe(mixed: np.ndarray, length: int, blocks: int, filters: Filters, size: int = SEGMENT) -> np.ndarray:
    """Places of the hashes that a length's filter may hold, as far as its segments are in ``filters``."""
    block = place(mixed, blocks).astype(np.int64)
    found = []
    segments = block // size if blocks > size else None
    for s in range(-(-blocks // size)):
        lanes = filters.get((length, s))
        if lanes is None:
            continue
        at = np.arange(len(mixed)) if segments is None else np.flatnonzero(segments == s)
        for k in range(LANES):                        # few survive the first lanes
            own = lanes[block[at] - s * size, k]
            at = at[(own & _bit(mixed[at], k)) != 0]
        found.append(at)
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def edits(points: np.ndarray, letters: np.ndarray, blocks: dict[int, int], filters: Filters, size: int = SEGMENT
          ) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row of ``points``, code points of the edit) of the deletions and larger replacements that may be words."""
    n = points.shape[1]
    up = _powers(n, _BASE)
    rows = max(PROBES // (n * max(len(letters), 1)), 1)
    for lo in range(0, len(points), rows):
        part = points[lo:lo + rows]
        terms = part * up
        upto = np.zeros((len(part), n + 1), np.uint64)
        np.cumsum(terms, axis=1, out=upto[:, 1:])
        if n - 1 in blocks:
            after = (upto[:, -1:] - upto[:, 1:]) * _U(_BACK)
            h = mix64(upto[:, :-1] + after)
            first = np.ones(part.shape, bool)        # of equal neighbours only the first is deleted
            first[:, 1:] = part[:, 1:] != part[:, :-1]
            r, i = np.nonzero(first)
            hit = probe(h[r, i], n - 1, blocks[n - 1], filters, size)
            if len(hit):
                r, i = r[hit], i[hit]
                kept = np.arange(n)[None, :] != i[:, None]
                yield lo + r, part[r][kept].reshape(len(r), n - 1)
        if n in blocks:
            cols = max(PROBES // (len(part) * max(len(letters), 1)), 1)
            for c in range(0, n, cols):              # a very long word goes in pieces
                old = part[:, c:c + cols, None]
                larger = letters[None, None, :] > old
                h = mix64((upto[:, -1:, None] + (letters[None, None, :] - old) * up[c:c + cols, None])[larger])
                hit = probe(h, n, blocks[n], filters, size)
                if len(hit):
                    r, i, k = (x[hit] for x in np.nonzero(larger))
                    made = part[r].copy()
                    made[np.arange(len(r)), c + i] = letters[k]
                    yield lo + r, made


def _texts(points: np.ndarray) -> list[str]:
    n = points.shape[1]
    flat = points.astype(np.uint32).tobytes().decode("utf-32-le", "surrogatepass")
    return [flat[i:i + n] for i in range(0, len(flat), n)]


def near_pairs(vocab: DataFrame, filter_bytes: int = 64 << 20, segment: int = SEGMENT) -> DataFrame:
    """(word, n, near, near_n) for every ordered pair of words of ``vocab`` (word, n; words distinct) that are
    one edit apart.  ``vocab`` is read several times and should be stored."""
    spark = vocab.sparkSession
    sizes = {r["l"]: r["c"] for r in vocab.groupBy(F.length("word").alias("l")).agg(F.count("*").alias("c")).collect() if r["l"]}
    letters = np.array(sorted(ord(r["c"]) for r in vocab.select(F.explode(F.split("word", "")).alias("c"))
                              .where("c <> ''").distinct().collect()), np.uint64)
    blocks = {n: -(-c // KEYS_PER_BLOCK) for n, c in sizes.items()}
    hashed = vocab.select("word").mapInArrow(_hash_rows(blocks, segment), "length int, segment int, h long")
    built = materialize(hashed.groupBy("length", "segment").applyInPandas(
        _segment_rows(blocks, segment), "length int, segment int, lanes binary"))
    found = None
    for part in _rounds(blocks, filter_bytes, segment):
        wanted = spark.createDataFrame(part, "length int, segment int")
        held = spark.sparkContext.broadcast(
            {(r["length"], r["segment"]): bytes(r["lanes"]) for r in built.join(F.broadcast(wanted), ["length", "segment"]).collect()})
        got = vocab.mapInArrow(_probe_rows(held, letters, blocks, segment), "word string, n long, edit string")
        found = got if found is None else found.unionByName(got)
    if found is None:
        return vocab.select("word", "n", F.col("word").alias("near"), F.col("n").alias("near_n")).limit(0)
    words = vocab.select(F.col("word").alias("edit"), F.col("n").alias("edit_n"))
    both = found.join(words, "edit").select(F.explode(F.array(
        F.struct(F.col("word"), F.col("n"), F.col("edit").alias("near"), F.col("edit_n").alias("near_n")),
        F.struct(F.col("edit").alias("word"), F.col("edit_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")))).alias("p"))
    return both.select("p.*")


def _rounds(blocks: dict[int, int], limit: int, size: int) -> Iterator[list[tuple[int, int]]]:
    """Segments of all lengths, as many at a time as ``limit`` bytes hold (one at least)."""
    part, total = [], 0
    for n in sorted(blocks):
        for s in range(-(-blocks[n] // size)):
            own = min(size, blocks[n] - s * size) * LANES * 4
            if part and total + own > limit:
                yield part
                part, total = [], 0
            part.append((n, s))
            total += own
    if part:
        yield part


def _hash_rows(blocks: dict[int, int], size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, points in _by_length(batch.column("word").to_pylist()):
                n = points.shape[1]
                h = mix64(word_hashes(points))
                segment = (place(h, blocks[n]) // _U(size)).astype(np.int32)
                yield pa.record_batch([pa.array(np.full(len(h), n, np.int32)), pa.array(segment), pa.array(h.view(np.int64))],
                                      names=["length", "segment", "h"])
    return run


def _segment_rows(blocks: dict[int, int], size: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        n, s = int(key[0]), int(key[1])
        lanes = build_segment(rows["h"].to_numpy(np.int64).view(np.uint64), blocks[n], s, size)
        return pd.DataFrame({"length": [n], "segment": [s], "lanes": [lanes.tobytes()]})
    return run


def _probe_rows(held, letters: np.ndarray, blocks: dict[int, int], size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = {k: np.frombuffer(v, np.uint32).reshape(-1, LANES) for k, v in held.value.items()}
        for batch in batches:
            words = batch.column("word").to_pylist()
            n = batch.column("n").to_numpy()
            for at, points in _by_length(words):
                for r, made in edits(points, letters, blocks, filters, size):
                    own = at[r]
                    yield pa.record_batch([pa.array([words[i] for i in own], pa.string()), pa.array(n[own]),
                                           pa.array(_texts(made), pa.string())], names=["word", "n", "edit"])
    return run


def variant_forms(vocab: DataFrame, filter_bytes: int = 64 << 20) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of ``vocab`` (word, n; distinct words)."""
    vocab = materialize(vocab.select("word", F.col("n").cast("long").alias("n")))
    best = near_pairs(vocab, filter_bytes).groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("low"), F.col("near"))).alias("b"))
    known = vocab.join(best, "word", "left")
    has = -F.col("b.low") >= 2 * F.col("n")
    known = materialize(known.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(has, F.col("b.near")).alias("form"), F.when(has, -F.col("b.low")).alias("form_n")))
    roots = last_links(known.where("form IS NOT NULL").select("word", "form"))
    return known.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def last_links(links: DataFrame) -> DataFrame:
    """(word, root): the end of each word's chain of links (word, form), which has no cycle."""
    now = materialize(links.select("word", F.col("form").alias("root")))
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        now = materialize(now.join(ahead, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if now.where("moved").isEmpty():
            return now.select("word", "root")
        now = now.select("word", "root")
