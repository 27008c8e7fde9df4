"""Consistent-hash ring with virtual nodes and bounded loads (DataFrame functions only).

A ring of ``shards * virtual_nodes`` tokens cuts the 32-bit hash space into arcs.
Every row hashes to a position and belongs to the arc that ends at the next token
clockwise; that token's shard is its home.  Each shard has a capacity.  A shard
first takes its own rows in ring order; what exceeds its capacity continues
clockwise to the next token whose shard still has room, so no shard is ever over
its capacity and only overflowing rows leave home.

Only the row count of each arc reaches the driver (``shards * virtual_nodes``
numbers, a parameter, whatever the table size).  From these the driver derives
*segments*: rank range [lo, hi) of an arc -> shard and first slot.  Rows find
their rank by one window per arc and their segment by a broadcast of at most
``arcs + shards`` rows.

Defined cases: null id or text hash like a constant; a null text has size
``overhead`` and crc 0; equal rows are counted once with a multiplicity before
any shuffle and expanded at the end; an empty table gives an empty result; other
columns of the input are ignored.
"""

from __future__ import annotations

import bisect
import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabflow.session import materialize

RING_BITS = 32
CELL_BITS = 12


def ring(shards: int, virtual_nodes: int) -> list[tuple[int, int]]:
    """Sorted (position, shard) tokens; a shard's tokens do not depend on the other shards."""
    seen: dict[int, int] = {}
    for s in range(shards):
        for v in range(virtual_nodes):
            p = int.from_bytes(hashlib.md5(f"shard-{s}/{v}".encode()).digest()[:4], "big")
            while p in seen:
                p = (p + 1) % (1 << RING_BITS)
            seen[p] = s
    return sorted(seen.items())


def capacities(total: int, shards: int, slack: float) -> list[int]:
    """Row capacity of each shard: the even share times (1 + slack); with slack 0 they add up to the total."""
    if slack > 0:
        return [-(-int(total * (1 + slack) + 1) // shards)] * shards
    return [total // shards + (s < total % shards) for s in range(shards)]


def segments(tokens: list[tuple[int, int]], counts: dict[int, int], caps: list[int]) -> list[tuple]:
    """(arc, lo, hi, shard, first slot): where ranks lo..hi-1 of an arc go."""
    room, used = list(caps), [0] * len(caps)
    out, rest = [], []

    def put(arc, lo, hi, shard):
        out.append((arc, lo, hi, shard, used[shard]))
        used[shard] += hi - lo
        room[shard] -= hi - lo

    for arc in sorted(counts):
        shard, n = tokens[arc][1], counts[arc]
        take = min(room[shard], n)
        if take:
            put(arc, 0, take, shard)
        if take < n:
            rest.append((arc, take, n))
    onward = list(range(len(tokens)))      # next token that may have room, path-compressed

    def open_token(i):
        trail = []
        while True:
            j = onward[i]
            if j == i:
                if room[tokens[i][1]] > 0:
                    break
                onward[i] = j = (i + 1) % len(tokens)
            trail.append(i)
            i = j
        for t in trail:
            onward[t] = i
        return i

    for arc, lo, hi in rest:
        at = (arc + 1) % len(tokens)
        while lo < hi:
            at = open_token(at)
            shard = tokens[at][1]
            take = min(room[shard], hi - lo)
            put(arc, lo, lo + take, shard)
            lo += take
    return out


def _arc(position: Column, tokens: list[tuple[int, int]], df: DataFrame) -> DataFrame:
    """Adds ``arc``: the ring's lookup table has one row per cell of the hash space (a fixed number)."""
    spark, shift = df.sparkSession, RING_BITS - CELL_BITS
    pos = [p for p, _ in tokens]
    cells = []
    for c in range(1 << CELL_BITS):
        i, j = bisect.bisect_left(pos, c << shift), bisect.bisect_left(pos, (c + 1) << shift)
        ends = [(pos[k], k) for k in range(i, j)] + [((c + 1) << shift, j % len(pos))]
        cells.append((c, ends))
    lookup = spark.createDataFrame(cells, "cell long, ends array<struct<upto:long, arc:int>>")
    found = F.filter(F.col("ends"), lambda e: e["upto"] >= F.col("position"))
    return (df.withColumn("position", position)
            .withColumn("cell", F.shiftright("position", shift))
            .join(F.broadcast(lookup), "cell")
            .withColumn("arc", F.element_at(found, 1)["arc"]).drop("cell", "ends"))


def bounded_ring(df: DataFrame, keys: list[str], shards: int, virtual_nodes: int = 256,
                 slack: float = 0.0) -> DataFrame:
    """``df``'s ``keys`` columns plus ``shard``, ``slot`` (0.. within the shard) and ``home_shard``.

    ``slack`` is the share by which a shard may exceed the even load; 0 fills all
    shards to within one row of each other.
    """
    spark, tokens = df.sparkSession, ring(shards, virtual_nodes)
    rows = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies"))
    position = F.shiftrightunsigned(F.xxhash64(*[F.col(k).cast("string") for k in keys]), 64 - RING_BITS)
    placed = materialize(_arc(position, tokens, rows))
    counts = {r["arc"]: r["n"] for r in placed.groupBy("arc").agg(F.sum("copies").alias("n")).collect()}
    parts = segments(tokens, counts, capacities(sum(counts.values()), shards, slack))
    by_arc: dict[int, list] = {}
    for arc, lo, hi, shard, first in parts:
        by_arc.setdefault(arc, []).append((lo, hi, shard, first))
    plan = spark.createDataFrame(
        [(a, tokens[a][1], p) for a, p in by_arc.items()],
        "arc int, home_shard int, parts array<struct<lo:long, hi:long, shard:int, first:long>>")
    order = Window.partitionBy("arc").orderBy("position", *keys).rowsBetween(Window.unboundedPreceding, 0)
    ranked = placed.withColumn("rank0", F.sum("copies").over(order) - F.col("copies"))
    copies = ranked.withColumn("rank", F.explode(F.sequence(F.col("rank0"), F.col("rank0") + F.col("copies") - 1)))
    part = F.element_at(F.filter(F.col("parts"), lambda p: (p["lo"] <= F.col("rank")) & (F.col("rank") < p["hi"])), 1)
    return (copies.join(F.broadcast(plan), "arc").withColumn("part", part)
            .select(*keys, F.col("part.shard").alias("shard"),
                    (F.col("part.first") + F.col("rank") - F.col("part.lo")).alias("slot"), "home_shard"))


def shard_documents(docs: DataFrame, shards: int = 40, overhead: int = 16, id_col: str = "doc_id",
                    text_col: str = "text", **ring_options) -> DataFrame:
    """Rows of a document table on balanced shards; ``law`` is ``rows`` (counts at most one apart)."""
    sized = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text_col), F.lit(0)) + overhead).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col(text_col).cast("binary")), F.lit(0)).cast("long").alias("text_crc32"))
    out = bounded_ring(sized, ["doc_id", "size", "text_crc32"], shards, **ring_options)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"), "home_shard")
