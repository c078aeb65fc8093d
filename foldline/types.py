"""Schemas of the canonical tables; never inferred."""

from __future__ import annotations

from pyspark.sql import types as T

EVENT_LOG = T.StructType([
    T.StructField("global_position", T.LongType(), False), T.StructField("stream_id", T.LongType()), T.StructField("stream_name", T.StringType()),
    T.StructField("category", T.StringType()), T.StructField("stream_version", T.LongType()), T.StructField("event_id", T.StringType()),
    T.StructField("event_type", T.StringType()), T.StructField("schema_version", T.IntegerType()), T.StructField("payload", T.StringType()),
    T.StructField("metadata", T.StringType()), T.StructField("causation_id", T.StringType()), T.StructField("correlation_id", T.StringType()),
    T.StructField("created_at", T.TimestampNTZType()),
])

SNAPSHOT = T.StructType([
    T.StructField("stream_name", T.StringType()), T.StructField("stream_version", T.LongType()), T.StructField("state", T.StringType()),
    T.StructField("state_codec_version", T.LongType()), T.StructField("regfile_shape_hash", T.StringType()), T.StructField("state_shape_hash", T.StringType()),
])

TIMER = T.StructType([
    T.StructField("timer_id", T.LongType()), T.StructField("owner", T.StringType()), T.StructField("correlation_id", T.StringType()),
    T.StructField("fire_at", T.TimestampNTZType()), T.StructField("status", T.StringType()), T.StructField("attempts", T.LongType()),
])

KAFKA_RECORD = T.StructType([
    T.StructField("topic", T.StringType()), T.StructField("partition", T.IntegerType()), T.StructField("offset", T.LongType()), T.StructField("key", T.StringType()),
    T.StructField("value", T.BinaryType()), T.StructField("headers", T.MapType(T.StringType(), T.StringType())), T.StructField("received_at", T.TimestampNTZType()),
])
