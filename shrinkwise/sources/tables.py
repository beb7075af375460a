"""Fixed table layouts shared by readers and writers."""

from __future__ import annotations

from pyspark.sql import types as T

# The audit columns in file order.
AUDIT_SCHEMA = T.StructType(
    [
        T.StructField("timestamp", T.StringType()),
        T.StructField("input_path", T.StringType()),
        T.StructField("output_path", T.StringType()),
        T.StructField("ext", T.StringType()),
        T.StructField("action", T.StringType()),
        T.StructField("orig_size", T.LongType()),
        T.StructField("out_size", T.LongType()),
        T.StructField("saved_bytes", T.LongType()),
        T.StructField("saved_pct", T.StringType()),
        T.StructField("notes", T.StringType()),
    ]
)

EVENT_SCHEMA = T.StructType(
    [
        T.StructField("job_id", T.StringType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("kind", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("current", T.LongType()),
        T.StructField("total", T.LongType()),
        T.StructField("orig_total", T.LongType()),
        T.StructField("out_total", T.LongType()),
        T.StructField("saved", T.LongType()),
        T.StructField("saved_pct", T.DoubleType()),
    ]
)
