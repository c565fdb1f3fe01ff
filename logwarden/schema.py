"""Column layouts shared by every job."""

from pyspark.sql import types as T

RAW_LOGS = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("source", T.StringType()),
    T.StructField("raw", T.StringType()),
])

# Parsed values; only those of the row's category are set.
FIELDS = T.StructType([
    T.StructField("process", T.StringType()),
    T.StructField("pid", T.StringType()),
    T.StructField("message", T.StringType()),
    T.StructField("src_ip", T.StringType()),
    T.StructField("method", T.StringType()),
    T.StructField("path", T.StringType()),
    T.StructField("query", T.StringType()),
    T.StructField("full_uri", T.StringType()),
    T.StructField("status", T.IntegerType()),
    T.StructField("size", T.IntegerType()),
    T.StructField("signature", T.StringType()),
    T.StructField("signature_id", T.LongType()),
    T.StructField("dest_ip", T.StringType()),
    T.StructField("proto", T.StringType()),
    T.StructField("http_method", T.StringType()),
    T.StructField("http_uri", T.StringType()),
    T.StructField("priority", T.IntegerType()),
])

GEO = T.StructType([
    T.StructField("country", T.StringType()),
    T.StructField("region", T.StringType()),
    T.StructField("city", T.StringType()),
    T.StructField("isp", T.StringType()),
    T.StructField("org", T.StringType()),
])

EVENTS = T.StructType(
    [f for f in RAW_LOGS.fields if f.name != "raw"]
    + [T.StructField("category", T.StringType()), T.StructField("raw", T.StringType())]
    + FIELDS.fields
    + [T.StructField("has_alert", T.IntegerType())]
)

ALERTS = T.StructType([
    T.StructField("alert_id", T.LongType()),
    T.StructField("event_id", T.LongType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("rule_id", T.StringType()),
    T.StructField("rule_name", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("mitre", T.StringType()),
    T.StructField("source_ip", T.StringType()),
    T.StructField("geo", GEO),
])

RULE_OVERRIDES = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("enabled", T.BooleanType()),
    T.StructField("name", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("severity", T.StringType()),
])

IP_RANGES = T.StructType(
    [T.StructField("start", T.LongType()), T.StructField("end", T.LongType())] + GEO.fields
)

HTTP_FLOWS = T.StructType([
    T.StructField("flow_id", T.LongType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("proto", T.StringType()),
    T.StructField("src_ip", T.StringType()),
    T.StructField("dest_ip", T.StringType()),
    T.StructField("dest_port", T.IntegerType()),
    T.StructField("http_uri", T.StringType()),
    T.StructField("user_agent", T.StringType()),
    T.StructField("tcp_flags", T.IntegerType()),
    T.StructField("icmp_type", T.IntegerType()),
    T.StructField("payload", T.StringType()),
])
