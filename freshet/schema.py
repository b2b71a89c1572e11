"""Types, enumerations and the window resolutions; the adapter from the driver's events table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Event types, error classes and their order.
CLICK, PURCHASE, PAGE_VIEW = "CLICK", "PURCHASE", "PAGE_VIEW"
EVENT_TYPES = (CLICK, PURCHASE, PAGE_VIEW)
ERROR_CLASSES = (
    "DESERIALIZE_FAILURE", "SCHEMA_MISMATCH", "NULL_REQUIRED_FIELD", "OUT_OF_RANGE",
    "MALFORMED_RECORD", "UNKNOWN_EVENT_TYPE", "PIPELINE_INTERNAL_ERROR",
)

PAYLOAD = T.StructType([
    T.StructField("click", T.StructType([T.StructField("element_id", T.StringType()), T.StructField("page_url", T.StringType())])),
    T.StructField("purchase", T.StructType([T.StructField("product_id", T.StringType()), T.StructField("quantity", T.IntegerType()), T.StructField("price_cents", T.LongType()), T.StructField("currency", T.StringType())])),
    T.StructField("page_view", T.StructType([T.StructField("page_url", T.StringType()), T.StructField("referrer", T.StringType())])),
])
EVENT = T.StructType([
    T.StructField("event_id", T.StringType()), T.StructField("event_type", T.StringType()), T.StructField("user_id", T.StringType()),
    T.StructField("session_id", T.StringType()), T.StructField("event_timestamp", T.TimestampType()), T.StructField("payload", PAYLOAD),
])
DLQ = T.StructType([
    T.StructField("schema_version", T.IntegerType()), T.StructField("original_topic", T.StringType()), T.StructField("original_partition", T.IntegerType()),
    T.StructField("original_offset", T.LongType()), T.StructField("original_timestamp_ms", T.LongType()), T.StructField("original_key_bytes", T.BinaryType()),
    T.StructField("original_value_bytes", T.BinaryType()), T.StructField("rejected_at_ms", T.LongType()), T.StructField("error_class", T.StringType()),
    T.StructField("validator_name", T.StringType()), T.StructField("error_field_path", T.StringType()), T.StructField("error_message", T.StringType()),
    T.StructField("validator_version", T.StringType()),
])

# The wire schemas of events, feature records and dead letters, version 1.
_SPACE = "ecommerce.v1"
_TEXT = lambda *names: [{"name": n, "type": "string"} for n in names]
EVENT_AVRO = {"type": "record", "name": "EcommerceEvent", "namespace": _SPACE, "fields": [
    {"name": "event_id", "type": {"type": "string", "logicalType": "uuid"}}, {"name": "event_type", "type": {"type": "enum", "name": "EventType", "symbols": list(EVENT_TYPES)}},
    *_TEXT("user_id", "session_id"), {"name": "event_timestamp", "type": {"type": "long", "logicalType": "timestamp-micros"}},
    {"name": "payload", "type": [
        {"type": "record", "name": "ClickPayload", "fields": _TEXT("element_id", "page_url")},
        {"type": "record", "name": "PurchasePayload", "fields": [*_TEXT("product_id"), {"name": "quantity", "type": "int"}, {"name": "price_cents", "type": "long"}, {"name": "currency", "type": "string", "default": "USD"}]},
        {"type": "record", "name": "PageViewPayload", "fields": [*_TEXT("page_url"), {"name": "referrer", "type": ["null", "string"], "default": None}]},
    ]},
]}


@dataclass(frozen=True)
class Resolution:
    """A sliding window: value and symbol, size and slide in seconds, published features."""

    value: str
    symbol: str
    size: int
    slide: int
    features: tuple[str, ...]

    @property
    def panes(self) -> int:
        return self.size // self.slide

    def ttl_seconds(self, multiplier: float = 1.5) -> int:
        return int(self.size * multiplier)


COUNTS = ("click_count", "page_view_count", "purchase_count", "revenue")
R5M = Resolution("5m", "W_5M_SLIDE_1M", 300, 60, COUNTS)
R1H = Resolution("1h", "W_1H_SLIDE_5M", 3600, 300, (*COUNTS, "distinct_products"))
R24H = Resolution("24h", "W_24H_SLIDE_1H", 86400, 3600, ("purchase_count", "revenue", "distinct_products", "avg_purchase_amount"))
RESOLUTIONS = (R5M, R1H, R24H)
FEATURES = {
    "click_count": "bigint", "page_view_count": "bigint", "purchase_count": "bigint", "revenue": "double",
    "distinct_products": "bigint", "avg_purchase_amount": "double",
}
#: The feature's name in the online vector, before its resolution.
ONLINE_PREFIX = {
    "click_count": "clicks", "page_view_count": "page_views", "purchase_count": "purchases", "revenue": "revenue",
    "distinct_products": "distinct_products", "avg_purchase_amount": "avg_purchase_amount",
}

_LONGS = lambda *names: [{"name": n, "type": "long"} for n in names]
FEATURE_AVRO = {"type": "record", "name": "SlidingFeatureRecord", "namespace": "sliding.v1", "fields": [
    *_TEXT("user_id"), {"name": "window_resolution", "type": {"type": "enum", "name": "WindowResolution", "symbols": [r.symbol for r in RESOLUTIONS]}},
    *_LONGS("window_start_ms", "window_end_ms"), {"name": "emission_seq", "type": "int", "default": 0},
    *({"name": f, "type": ["null", {"bigint": "long"}.get(k, k)], "default": None} for f, k in FEATURES.items()),
]}
DLQ_AVRO = {"type": "record", "name": "DlqRecord", "namespace": "dlq.v1", "fields": [
    {"name": "schema_version", "type": "int", "default": 1}, *_TEXT("original_topic"), {"name": "original_partition", "type": "int"}, *_LONGS("original_offset", "original_timestamp_ms"),
    {"name": "original_key_bytes", "type": ["null", "bytes"], "default": None}, {"name": "original_value_bytes", "type": "bytes"}, *_LONGS("rejected_at_ms"),
    {"name": "error_class", "type": {"type": "enum", "name": "ErrorClass", "symbols": list(ERROR_CLASSES)}}, *_TEXT("validator_name"), {"name": "error_field_path", "type": ["null", "string"], "default": None},
    *_TEXT("error_message"), {"name": "validator_version", "type": "string", "default": "1.0.0"},
]}


def online_fields() -> list[tuple[str, str, str, str]]:
    """(field, resolution, feature, type) of the 13 fields of the online vector."""
    return [(f"{ONLINE_PREFIX[f]}_{r.value}", r.value, f, FEATURES[f]) for r in RESOLUTIONS for f in r.features]


def epoch_us(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp without time zone (naive means UTC), whatever the
    session's time zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts.cast("timestamp_ntz"))


def events_from_table(spark: SparkSession, sf_dir: str, tasks: int | None = None) -> DataFrame:
    """The driver's events as flat e-commerce events: ids, type, times and the fields of all
    payloads (product, quantity, price, currency; element, page; referrer). tasks: rows are dealt out to so many before they are
    parsed, but after filters by time or id, as a table in order of time has a batch's in a few places."""
    raw = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type", "value", "props")
    raw = raw if tasks is None else raw.repartition(tasks, "event_id")
    k = F.get_json_object("props", "$.k").cast("int")
    kind = F.when(F.col("event_type") == "click", CLICK).when(F.col("event_type") == "view", PAGE_VIEW).when(F.col("event_type") == "purchase", PURCHASE).otherwise(F.upper("event_type"))
    user = F.lpad(F.col("user_id").cast("string"), 6, "0")
    us = epoch_us(F.col("ts"))
    return raw.select(
        F.col("event_id").cast("string").alias("event_id"),
        kind.alias("event_type"),
        F.concat(F.lit("u-"), user).alias("user_id"),
        F.concat(F.lit("s-"), user, F.lit("-"), F.date_format("ts", "yyyy-MM-dd")).alias("session_id"),
        us.alias("event_us"),
        F.concat(F.lit("sku-"), F.lpad(k.cast("string"), 5, "0")).alias("product_id"),
        F.round(F.col("value") * 100).cast("bigint").alias("price_cents"),
        (k % 4 + 1).cast("int").alias("quantity"),
        F.lit("USD").alias("currency"),
        F.concat(F.lit("el-"), k.cast("string")).alias("element_id"),
        F.concat(F.lit("https://shop.example/p/"), k.cast("string")).alias("page_url"),
        F.when(k % 2 == 0, F.concat(F.lit("https://search.example/?q="), k.cast("string"))).alias("referrer"),
    )


#: The same in DuckDB's SQL, as a common table expression named ev.
EVENTS_SQL = """ev AS (SELECT CAST(event_id AS VARCHAR) AS event_id,
  CASE event_type WHEN 'click' THEN 'CLICK' WHEN 'view' THEN 'PAGE_VIEW' WHEN 'purchase' THEN 'PURCHASE' ELSE upper(event_type) END AS event_type,
  'u-' || lpad(CAST(user_id AS VARCHAR), 6, '0') AS user_id,
  's-' || lpad(CAST(user_id AS VARCHAR), 6, '0') || '-' || strftime(ts, '%Y-%m-%d') AS session_id,
  epoch_us(ts) AS event_us, 'sku-' || lpad(CAST(json_extract_string(props, '$.k') AS VARCHAR), 5, '0') AS product_id,
  CAST(round(value * 100) AS BIGINT) AS price_cents, CAST(json_extract_string(props, '$.k') AS INTEGER) % 4 + 1 AS quantity, 'USD' AS currency,
  'el-' || CAST(json_extract_string(props, '$.k') AS INTEGER) AS element_id, 'https://shop.example/p/' || CAST(json_extract_string(props, '$.k') AS INTEGER) AS page_url,
  CASE WHEN CAST(json_extract_string(props, '$.k') AS INTEGER) % 2 = 0 THEN 'https://search.example/?q=' || CAST(json_extract_string(props, '$.k') AS INTEGER) END AS referrer FROM events)"""
