"""Fitted scaler on a parquet stream equals the batch transform."""

from pyspark.sql import functions as F

from datasets import SF_SMALL
from tabflow.operators import encode
from tabflow.sources.registry import table
from tabflow.streaming import transform


def test_stream_scaler_equals_batch(spark):
    batch = table(spark, SF_SMALL, "events")
    bounds = encode.data_bounds(batch, ["value"])
    stream = transform.read_parquet_stream(spark, SF_SMALL, batch.schema, glob="events.parquet")
    out = transform.run_available(transform.scale_stream(stream.select("event_id", "value"), bounds))
    want = encode.minmax_scale(batch.select("event_id", "value"), bounds)
    a = sorted((r.event_id, round(r.value, 9)) for r in out.collect())
    b = sorted((r.event_id, round(r.value, 9)) for r in want.collect())
    assert a == b and len(a) == batch.count()
    assert out.agg(F.min("value"), F.max("value")).first() == (-1.0, 1.0)
