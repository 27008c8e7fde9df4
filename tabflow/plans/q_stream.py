"""Streaming query: the fitted scaler applied to the events table as a stream."""

from __future__ import annotations


from ..operators import encode
from ..sources.registry import table
from ..streaming import transform
from .q_basic import _scaled_sql
from .registry import query, r6


@query("stream_minmax_scale", sql=f"""
WITH b AS (SELECT min(value) AS mn, max(value) AS mx FROM events)
SELECT event_id, event_type, round({_scaled_sql('value', 'mn', 'mx')}, 6) AS value_s FROM events, b""")
def q_stream_minmax_scale(spark, sf):
    batch = table(spark, sf, "events")
    bounds = encode.data_bounds(batch, ["value"])
    stream = transform.read_parquet_stream(spark, sf, batch.schema, glob="events.parquet")
    scaled = transform.scale_stream(stream.select("event_id", "event_type", "value"), bounds)
    out = transform.run_available(scaled)
    return out.select("event_id", "event_type", r6("value").alias("value_s"))
