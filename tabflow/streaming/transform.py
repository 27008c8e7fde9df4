"""Fitted stateless transforms on Structured Streaming sources.

A fitted scaler (C1/C2) or postprocessor (F12) is a projection with literal
parameters, so it applies unchanged to a ``readStream`` DataFrame: no state,
no watermark.  ``run_available`` drains what is available with an
``availableNow`` trigger; the stream's checkpoint lives in the shared
checkpoint folder so a restarted query resumes where it stopped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..operators import encode
from ..session import scratch_path


def read_parquet_stream(spark: SparkSession, folder: str, schema: StructType, glob: str | None = None,
                        max_files_per_trigger: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema)
    if glob:
        r = r.option("pathGlobFilter", glob)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return r.parquet(folder)


def scale_stream(stream: DataFrame, bounds: dict, lo: float = -1.0, hi: float = 1.0) -> DataFrame:
    """C1 on a stream with bounds fitted on a batch table."""
    return encode.minmax_scale(stream, bounds, lo, hi)


def run_available(stream: DataFrame, sink_path: str | None = None, fmt: str = "parquet",
                  checkpoint_path: str | None = None) -> DataFrame:
    """Process everything available now into a parquet table in the shared
    folder and return that table as a batch DataFrame.  With a given sink the
    stream's progress is kept beside it (or in ``checkpoint_path``), so a later
    call takes up where this one ended; without one, both folders are fresh."""
    spark = stream.sparkSession
    out = sink_path or scratch_path(spark, "stream-out")
    ckpt = checkpoint_path or f"{out.rstrip('/')}-progress"
    q = (stream.writeStream.format(fmt).option("path", out).option("checkpointLocation", ckpt)
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
    return spark.read.format(fmt).load(out)
