"""Explicit schemas of the tables and payloads."""

from pyspark.sql import types as T

PAYLOAD_DDL = (
    "article struct<title:string,textContent:string,content:string>, title string, textContent string, content string"
)
CURSOR_DDL = "segmentIndex double, charOffset double"
PREFERENCES_DDL = "voice string, rate double, provider string"
PROFILE_DDL = "markedAt string, reason string"
MANIFEST_DDL = (
    "artifacts array<struct<id:string,packageOrModelName:string,versionOrHash:string,license:string,"
    "sourceUrl:string,attributionText:string>>"
)

TELEMETRY = T.StructType(
    [
        T.StructField("session_id", T.LongType()),
        T.StructField("seq", T.LongType()),
        T.StructField("event_ts", T.TimestampType()),
        T.StructField("type", T.StringType()),
        T.StructField("segment_id", T.StringType()),
        T.StructField("duration_ms", T.DoubleType()),
        T.StructField("reason", T.StringType()),
        T.StructField("code", T.StringType()),
        T.StructField("attempt", T.IntegerType()),
        T.StructField("max_attempts", T.IntegerType()),
        T.StructField("split_depth", T.IntegerType()),
        T.StructField("chunk_count", T.IntegerType()),
        T.StructField("queue_underruns", T.IntegerType()),
        T.StructField("queue_transitions", T.IntegerType()),
        T.StructField("underrun_rate", T.DoubleType()),
        T.StructField("device", T.StringType()),
        T.StructField("model", T.StringType()),
        T.StructField("peak_memory_mb", T.DoubleType()),
        T.StructField("device_memory_gb", T.DoubleType()),
        T.StructField("status", T.StringType()),
        T.StructField("provider_from", T.StringType()),
        T.StructField("provider_to", T.StringType()),
        T.StructField("fallback_code", T.StringType()),
        T.StructField("fallback_message", T.StringType()),
        T.StructField("transition", T.StringType()),
        T.StructField("is_underrun", T.BooleanType()),
    ]
)
