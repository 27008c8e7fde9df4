"""Fitted trees on shared storage, read block by block while rows are generated.

A flow holds columns x labels x levels models; at 100 columns and 50 levels their trees
are far too many to broadcast.  ``store`` writes them once as one file below the shared
checkpoint folder, sorted by model number and cut into pages of about ``PAGE_BYTES``;
models of one step have neighbouring numbers.  What travels to the tasks is the page
directory only (two numbers a page).  A Python worker keeps the pages read last, up to
``CACHE_BYTES``, and reads a page again after a lost executor like any other file.
"""

from __future__ import annotations

import os
from collections import OrderedDict
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession

from ..session import scratch_path

PAGE_BYTES = 1 << 20
CACHE_BYTES = 64 << 20
BATCH_BYTES = 32 << 20      # rows worked on at once where the trees exceed the cache

_HELD: OrderedDict = OrderedDict()      # (file, page) -> models, per worker process
_SIZE = [0]


def _open(uri: str, write: bool = False):
    from pyarrow import fs
    filesystem, path = fs.FileSystem.from_uri(uri if ":/" in uri else "file://" + uri)
    if not write:
        return filesystem.open_input_file(path)
    filesystem.create_dir(os.path.dirname(path), recursive=True)
    return filesystem.open_output_stream(path)


class PagedForest:
    """The trees of a ``BoostedForest`` by page; ``model`` gives the same as the forest's own."""

    def __init__(self, uri: str, shape: tuple[int, int], objective: str, default: float):
        self.uri, self.objective, self.default = uri, objective, default
        self.depth, self.n_rounds = shape
        self.first: np.ndarray = np.zeros(0, np.int64)      # lowest model number of each page
        self.at: np.ndarray = np.zeros(1, np.int64)         # where pages begin, and the end

    @property
    def nbytes(self) -> int:
        return int(self.at[-1])

    def model(self, key: tuple[int, int]):
        page = int(np.searchsorted(self.first, key[0], side="right")) - 1
        return self._page(page).get((int(key[0]), int(key[1])), (self.default, None)) if page >= 0 else (self.default, None)

    def _page(self, page: int) -> dict:
        got = _HELD.get((self.uri, page))
        if got is not None:
            _HELD.move_to_end((self.uri, page))
            return got[0]
        lo, hi = int(self.at[page]), int(self.at[page + 1])
        with _open(self.uri) as f:
            f.seek(lo)
            data = f.read(hi - lo)
        models = unpack(data, self.depth, self.n_rounds)
        _HELD[self.uri, page] = models, len(data)
        _SIZE[0] += len(data)
        while _SIZE[0] > CACHE_BYTES and len(_HELD) > 1:
            _SIZE[0] -= _HELD.popitem(last=False)[1][1]
        return models


def _layout(depth: int, rounds: int) -> np.dtype:
    inner = (rounds, 2 ** depth - 1)
    return np.dtype([("model", "<i8"), ("cls", "<i8"), ("base", "<f8"), ("grown", "?"), ("feat", "<i4", inner),
                     ("sbin", "<i4", inner), ("dleft", "?", inner), ("leaf", "<f8", (rounds, 2 ** depth))], align=True)


def pack(forest, keys: list) -> bytes:
    rows = np.zeros(len(keys), _layout(forest.depth, forest.n_rounds))
    for row, key in zip(rows, keys):
        row["model"], row["cls"] = key
        row["base"], trees = forest.model(key)
        if trees is not None:
            row["grown"] = True
            row["feat"], row["sbin"], row["dleft"], row["leaf"] = trees
    return rows.tobytes()


def unpack(data: bytes, depth: int, rounds: int) -> dict:
    out = {}
    for r in np.frombuffer(data, _layout(depth, rounds)):
        trees = (r["feat"], r["sbin"], r["dleft"], r["leaf"]) if r["grown"] else None
        out[int(r["model"]), int(r["cls"])] = float(r["base"]), trees
    return out


def store(spark: SparkSession, forest) -> PagedForest:
    """Write ``forest`` to the shared folder; all classes of a model lie in one page."""
    uri = scratch_path(spark, "trees")
    out = PagedForest(uri, (forest.depth, forest.n_rounds), forest.objective, float(forest.base.get((-1, -1), 0.0)))
    keys = sorted({*forest.feat, *forest.base})
    per_page = max(PAGE_BYTES // _layout(forest.depth, forest.n_rounds).itemsize, 1)
    first, at, page = [], [0], []
    with _open(uri, write=True) as f:
        for i, key in enumerate(keys):
            page.append(key)
            if i + 1 == len(keys) or (len(page) >= per_page and keys[i + 1][0] != key[0]):
                data = pack(forest, page)
                f.write(data)
                first.append(page[0][0])
                at.append(at[-1] + len(data))
                page = []
    out.first, out.at = np.array(first, np.int64), np.array(at, np.int64)
    return out


def payload(spark: SparkSession, fitted, names: Iterable[str]) -> dict:
    """What generation broadcasts: the fitted payload with its forests ``names`` paged, written once per application."""
    pay, app = fitted._payload(), spark.sparkContext.applicationId
    kept = fitted.__dict__.setdefault("_stored", {})
    for n in names:
        if pay[n] is not None:
            if (app, n) not in kept:
                kept[app, n] = store(spark, pay[n])
            pay[n] = kept[app, n]
    return pay


def gathered(batches: Iterator[pd.DataFrame], pay: dict, names: Iterable[str]) -> Iterator[pd.DataFrame]:
    """The batches, joined up to ``BATCH_BYTES`` where the trees don't fit into a worker's cache and every batch would
    read them all again."""
    if sum(pay[n].nbytes for n in names if pay[n] is not None) <= CACHE_BYTES:
        yield from batches
        return
    held, size = [], 0
    for pdf in batches:
        held.append(pdf)
        size += int(pdf.memory_usage(index=False).sum())
        if size >= BATCH_BYTES:
            yield pd.concat(held, ignore_index=True)
            held, size = [], 0
    if held:
        yield pd.concat(held, ignore_index=True)
