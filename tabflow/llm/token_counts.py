"""Token counts through a digest cache.

A text is known by the digest of its normalised content, a tokenizer by the digest
of its file, its library's name and version and the way it is called.  Counts are
stored as Parquet under ``<cache>/tokenizer=<digest>/run=<id>/``; a call

1. joins the distinct content digests of its rows to the stored counts,
2. brings one text of every digest without a count to a task and encodes it there,
3. appends the new counts as a run of its own, and
4. joins all rows to the counts by digest.

Only digests move in steps 1 and 4; in step 2 copies meet inside their tasks before
the shuffle, so a text that a third of all rows share is sent once a task.  Step 4 is
a plain sort-merge join, whose hot keys adaptive execution splits.

Defined cases: a null text is the empty one (0 tokens, 0 bytes); every row is answered,
repeated rows and null ids too; strings of special tokens inside a text are treated as
the library does by default; nothing is cut or padded; an empty table gives an empty
result and an empty run.  ``normalise`` must not change a count (white space and case
count for most tokenizers, so by default only null becomes '').  Runs that two jobs
append at a time may hold a digest twice; readers take one.  A run is visible only
when its job has committed, and a failed job leaves none.

Bounds: a worker holds the tokenizer, and the encodings of ``SLICE`` characters of text
or of one longer text.
"""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Callable, Iterator
from importlib.metadata import version

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabflow.session import materialize

SLICE = 1 << 18                      # characters encoded at a time
SETTINGS = "no added special tokens, no truncation, no padding"
_STORED = "digest binary, n_tokens long"


def null_as_empty(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def tokenizer_digest(file: str) -> str:
    """Digest of a tokenizer file with its library's version and the settings of :func:`counter`."""
    lib = _library(file)
    with open(file, "rb") as f:
        body = f.read()
    return hashlib.sha256(f"{lib} {version(lib)} {SETTINGS}\n".encode() + body).hexdigest()


def _library(file: str) -> str:
    kinds = {".json": "tokenizers", ".model": "sentencepiece"}
    kind = os.path.splitext(file)[1]
    if kind not in kinds:
        raise ValueError(f"{file}: a tokenizer file ends in .json or .model")
    return kinds[kind]


def counter(lib: str, body: bytes) -> Callable[[list[str]], list[int]]:
    """Function that gives the numbers of tokens of some texts."""
    if lib == "sentencepiece":
        import sentencepiece
        codec = sentencepiece.SentencePieceProcessor(model_proto=body)
        return lambda texts: [len(x) for x in codec.encode(texts, num_threads=1)]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"       # a task has one core
    import tokenizers
    codec = tokenizers.Tokenizer.from_buffer(body)
    codec.no_truncation()
    codec.no_padding()
    return lambda texts: [len(x) for x in codec.encode_batch_fast(texts, add_special_tokens=False)]


def encode_counts(texts: DataFrame, file: str) -> DataFrame:
    """(digest, n_tokens) of the rows (digest, text)."""
    lib = _library(file)
    with open(file, "rb") as f:
        body = f.read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            count = count or counter(lib, body)
            text = batch.column("text")
            size = np.cumsum([0, *(len(t) for t in (x.as_py() for x in text))])
            n, i = [], 0
            while i < batch.num_rows:
                j = max(int(np.searchsorted(size, size[i] + SLICE, side="right")) - 1, i + 1)
                n += count(text.slice(i, j - i).to_pylist())
                i = j
            yield pa.record_batch([batch.column("digest"), pa.array(n, pa.int64())], names=["digest", "n_tokens"])

    return texts.mapInArrow(run, _STORED)


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def stored_counts(spark: SparkSession, cache: str, tokenizer: str) -> DataFrame | None:
    """(digest, n_tokens) rows stored for a tokenizer; None if it has no run yet."""
    path = f"{cache.rstrip('/')}/tokenizer={tokenizer}"
    return spark.read.schema(_STORED).option("recursiveFileLookup", "true").parquet(path) if _exists(spark, path) else None


def count_tokens(docs: DataFrame, file: str, cache: str, keep: list[str] | None = None, text_col: str = "text",
                 normalise: Callable[[Column], Column] = null_as_empty) -> DataFrame:
    """Columns ``keep`` (all but the text, if None) of every row with ``n_bytes`` (of the normalised text, in
    UTF-8) and ``n_tokens``, which replace columns of these names.  New texts' counts go to ``cache``, a folder
    that all executors reach."""
    spark = docs.sparkSession
    tokenizer = tokenizer_digest(file)
    names = [c for c in (docs.columns if keep is None else keep) if c not in (text_col, "n_bytes", "n_tokens")]
    text = normalise(F.col(text_col))
    digest = F.unhex(F.sha2(text.cast("binary"), 256))
    texts = docs.select(digest.alias("digest"), text.alias("text"))
    known = stored_counts(spark, cache, tokenizer)
    hits = None
    if known is not None:
        asked = docs.select(digest.alias("digest")).distinct()
        found = materialize(asked.join(known.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")), "digest", "left"))
        hits = found.where("n_tokens IS NOT NULL")
        texts = texts.join(found.where("n_tokens IS NULL").select("digest"), "digest", "left_semi")
    misses = texts.groupBy("digest").agg(F.first("text").alias("text"))
    run = f"{cache.rstrip('/')}/tokenizer={tokenizer}/run={uuid.uuid4().hex}"
    encode_counts(misses, file).write.parquet(run)
    counts = spark.read.schema(_STORED).parquet(run)
    if hits is not None:
        counts = counts.unionByName(hits)
    rows = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(names)],
                       F.octet_length(text).cast("long").alias("n_bytes"), digest.alias("digest"))
    return rows.join(counts, "digest", "left").select(
        *[F.col(f"k{i}").alias(c) for i, c in enumerate(names)], "n_bytes", "n_tokens")
