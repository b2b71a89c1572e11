"""The reference operators as queries over the driver's tables, and the same in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import evolution, scalars
from .operators import metrics, offline, online, validate, windows
from .schema import EVENTS_SQL, EVENT_AVRO, PAGE_VIEW, PURCHASE, R1H, R24H, R5M, RESOLUTIONS, events_from_table, online_fields
from .sources import avro, commits, incremental, keyed, sinks
from .sources import events as sources
from .sources.folders import shared_folder
from .streaming import replays

#: 2024-01-31 00:00:00 UTC: "now" for the rule on time stamps; a price bound that rejects some.
NOW_US = 1_706_659_200_000_000
MAX_CENTS = 20_000
RUN_MS = (1_704_890_096_000, 1_705_708_800_000)


def _tagged(spark: SparkSession, d: str) -> DataFrame:
    return validate.tag(events_from_table(spark, d), validate.default_rules(NOW_US, max_price_cents=MAX_CENTS))


# -- windows ---------------------------------------------------------------------------------


def sliding_5m(spark, d):
    return windows.sliding(events_from_table(spark, d), R5M)


def sliding_1h(spark, d):
    return windows.sliding(events_from_table(spark, d), R1H)


def sliding_24h(spark, d):
    return windows.sliding(events_from_table(spark, d), R24H)


def sliding_all(spark, d):
    return windows.sliding_all(events_from_table(spark, d))


def panes_1m(spark, d):
    own = windows.panes(events_from_table(spark, d), 60)
    return own.select("user_id", "pane", "click_count", "page_view_count", "purchase_count", "cents", F.size("products").cast("bigint").alias("products"))


def emission_keys(spark, d):
    own = windows.emission_keys(sliding_all(spark, d))
    return own.select("idempotency_key", "kafka_key", "symbol", "emission_seq")


def emission_counts(spark, d):
    return sliding_all(spark, d).groupBy("window_resolution").agg(F.count("*").alias("emitted"))


def fired_windows(spark, d):
    """What a run emits whose watermark goes from the 10th of the month, 12:34:56, to the 20th."""
    return windows.fired(sliding_all(spark, d), *RUN_MS).select("user_id", "window_resolution", "window_end_ms", "purchase_count")


def late_split(spark, d):
    """Arrival order shuffled by a rule: every 7th event arrives 40 places later, every 11th 400."""
    e = events_from_table(spark, d).withColumn("id", F.col("event_id").cast("bigint"))
    shift = F.when(F.col("id") % 11 == 0, 400).when(F.col("id") % 7 == 0, 40).otherwise(0)
    e = e.withColumn("arrival", (F.col("id") + shift) * 1_000_000 + F.col("id")).withColumn("process", F.substring("user_id", 3, 6).cast("int") % 12)
    own = windows.late_split(e)
    return own.select("event_id", "process", "watermark_us", "is_late")


def session_features(spark, d):
    return windows.sessions(events_from_table(spark, d))


def _raw(r) -> str:
    return f"""SELECT user_id, '{r.value}' AS window_resolution, (e - {r.size}) * 1000 AS window_start_ms, e * 1000 AS window_end_ms,
  {_f(r, "click_count", "count(*) FILTER (event_type = 'CLICK')", "BIGINT")}, {_f(r, "page_view_count", "count(*) FILTER (event_type = 'PAGE_VIEW')", "BIGINT")},
  {_f(r, "purchase_count", "count(*) FILTER (event_type = 'PURCHASE')", "BIGINT")}, {_f(r, "revenue", _REVENUE, "DOUBLE")},
  {_f(r, "distinct_products", "count(DISTINCT product_id) FILTER (event_type = 'PURCHASE')", "BIGINT")},
  {_f(r, "avg_purchase_amount", f"CASE WHEN count(*) FILTER (event_type = 'PURCHASE') > 0 THEN {_REVENUE} / count(*) FILTER (event_type = 'PURCHASE') END", "DOUBLE")}
FROM (SELECT *, unnest([(CAST(floor(event_us / {r.slide * 1_000_000}) AS BIGINT) + k) * {r.slide} FOR k IN range(1, {r.panes + 1})]) AS e FROM ev) GROUP BY user_id, e"""


_REVENUE = "CAST(coalesce(sum(price_cents * quantity) FILTER (event_type = 'PURCHASE'), 0) AS DOUBLE) / 100.0::DOUBLE"


def _f(r, feature: str, sql: str, kind: str) -> str:
    return f"CAST({sql if feature in r.features else 'NULL'} AS {kind}) AS {feature}"


def _with(sql: str, *more: str) -> str:
    return "WITH " + ", ".join((EVENTS_SQL, *more)) + " " + sql


_ALL = " UNION ALL ".join(_raw(r) for r in RESOLUTIONS)

# -- validation ------------------------------------------------------------------------------


def validate_tagged(spark, d):
    return _tagged(spark, d).select("event_id", "error.error_class", "error.validator_name", "error.error_field_path")


def validated_events(spark, d):
    return validate.valid(_tagged(spark, d))


def dlq_events(spark, d):
    """All 13 fields of the envelope, bytes as text, and the message key."""
    t = _tagged(spark, d).withColumn("offset", F.col("event_id").cast("bigint")).withColumn("partition", F.substring("user_id", 3, 6).cast("int") % 12).withColumn("timestamp_ms", F.expr("event_us div 1000"))
    own = validate.dead_letters(t, "e-commerce-events", NOW_US // 1000)
    text = [F.col(c).cast("string").alias(c) for c in ("original_key_bytes", "original_value_bytes")]
    return own.select(*(c for c in own.columns if not c.endswith("_bytes")), *text, F.concat_ws(":", "original_topic", "original_partition", "original_offset").alias("dlq_key"))


def routed_outputs(spark, d):
    """Each event in the output that it went to, both outputs written as one commit a batch."""
    ledger = commits.Ledger(spark, shared_folder(spark, "routed"))
    tagged = _tagged(spark, d).withColumn("timestamp_ms", F.expr("event_us div 1000")).withColumn("n", F.col("event_id").cast("bigint") % 3)
    for n in range(3):
        own = tagged.where(F.col("n") == n)
        ledger.commit(n, {"validated": own.where("error is null").select("event_id"), "dead": own.where("error is not null").select("event_id", "error.error_class")})
    ledger.roll()
    valid = ledger.read("validated").select("event_id", F.lit("validated").alias("output"), F.lit(None).cast("string").alias("error_class"))
    return valid.union(ledger.read("dead").select("event_id", F.lit("dead"), "error_class"))


def keyed_inserts(spark, d):
    """The batch that each event was inserted by: some arrive in two of four batches, and each batch is run twice."""
    table = keyed.KeyedTable(spark, shared_folder(spark, "keyed"))
    events = events_from_table(spark, d).select("event_id", "user_id", "event_us")
    n = F.col("event_id").cast("bigint")
    for i in range(4):
        own = events.where((n % 4 == i) | ((n % 10 == 0) & ((n + 1) % 4 == i)))
        table.append(own.withColumn("arrival", F.lit(i)).withColumn("batch", F.lit(i)), i)
        table.append(own.withColumn("arrival", F.lit(i)).withColumn("batch", F.lit(-1)), i)  # run again: changes nothing
    return table.read()


def incremental_windows(spark, d):
    """Records after four batches, of which each has events of all days: only windows that a batch
    changes are worked out again."""
    table = incremental.FeatureTable(spark, shared_folder(spark, "incremental"))
    events = events_from_table(spark, d)
    for n in range(4):
        table.fold(events.where(F.pmod(F.crc32("event_id"), F.lit(7)) % 4 == n), n)
    return table.read()


def accumulated_features(spark, d):
    """Features by accumulators beside the built-in ones; of so few values a window the sketches are exact."""
    page, price = F.col("event_type") == PAGE_VIEW, F.when(F.col("event_type") == PURCHASE, F.col("price_cents"))
    more = [
        windows.Feature("pages", lambda: F.when(page, F.col("page_url")), "distinct"), windows.Feature("median_price", lambda: price, "median"),
        windows.Feature("p95_price", lambda: price, "p95", ("24h",)), windows.Feature("top_price", lambda: price, "max"), windows.Feature("priced", lambda: price, "count"),
    ]
    own = windows.sliding_all(events_from_table(spark, d), more)
    return own.select("user_id", "window_resolution", "window_end_ms", *(f.name for f in more))


def _hard(spark: SparkSession, d: str) -> DataFrame:
    """Events changed so that every rule rejects some: each by the remainder of its id."""
    e = events_from_table(spark, d)
    n = F.col("event_id").cast("bigint")
    return e.withColumns({
        "user_id": F.when(n % 97 == 0, "").when(n % 89 == 0, F.repeat(F.lit("x"), F.lit(257))).when(n % 83 == 0, F.concat("user_id", F.lit("\n"))).otherwise(F.col("user_id")),
        "session_id": F.when(n % 79 == 0, "").otherwise(F.col("session_id")),
        "quantity": F.when(n % 7 == 0, 0).when(n % 11 == 0, 20_000).otherwise(F.col("quantity")).cast("int"),
        "price_cents": F.when(n % 13 == 0, 0).otherwise(F.col("price_cents")),
        "event_us": F.when(n % 17 == 0, NOW_US + 7_200_000_000).when(n % 19 == 0, NOW_US - 691_200_000_000).otherwise(NOW_US - n % 500_000 * 1_000_000),
    })


def every_rule(spark, d):
    """Each rule and each of its ways to fail."""
    t = validate.tag(_hard(spark, d), validate.default_rules(NOW_US, max_price_cents=MAX_CENTS))
    return t.select("event_id", "error.error_class", "error.validator_name", "error.error_field_path", "error.error_message")


def model_violations(spark, d):
    """What the event model refuses, of payloads whose fields are emptied or unknown."""
    n = F.col("event_id").cast("bigint")
    e = _hard(spark, d).withColumns({
        "element_id": F.when(n % 5 == 0, "").otherwise(F.col("element_id")), "page_url": F.when(n % 6 == 0, "").otherwise(F.col("page_url")),
        "currency": F.when(n % 8 == 0, "usd").otherwise(F.col("currency")), "price_cents": F.when(n % 9 == 0, -1).otherwise(F.col("price_cents")),
        "extra_fields": F.when(n % 10 == 0, F.array(F.lit("coupon"))).otherwise(F.array().cast("array<string>")),
    })
    t = validate.tag(e, [validate.model_rule(e.columns)])
    return t.select("event_id", "error.error_class", "error.validator_name", "error.error_field_path")


def _shares(fields: dict) -> None:
    return None if 100 // (fields["quantity"] - 3) < 10**9 else ("OUT_OF_RANGE", "quantity", "too many")


def internal_errors(spark, d):
    """A rule that raises for purchases of three pieces: these become dead letters, no event stops the job."""
    rule = validate.python_rule("SharesValidator", _shares, ["quantity"], ("PURCHASE",))
    t = validate.tag(events_from_table(spark, d), [validate.required_fields(), rule])
    raised = F.col("error.error_message").startswith("Traceback") & F.col("error.error_message").contains("ZeroDivisionError")
    return t.select("event_id", "error.error_class", "error.validator_name", "error.error_field_path", raised.alias("raised"))


def invalid_by_class(spark, d):
    return metrics.histogram(_tagged(spark, d), "error.error_class")


def invalid_by_validator(spark, d):
    return metrics.histogram(_tagged(spark, d), "error.validator_name")


def invalid_by_field_top10(spark, d):
    return metrics.top(metrics.histogram(_tagged(spark, d), "error.error_field_path"))


def invalid_rate(spark, d):
    return metrics.invalid_rate(_tagged(spark, d)).withColumn("rate", F.round("rate", 9))


#: The rules in SQL: condition, class, validator, field, message.
_RULES = [
    ("user_id = ''", "NULL_REQUIRED_FIELD", "RequiredFieldsValidator", "user_id", "user_id is empty"),
    ("session_id = ''", "NULL_REQUIRED_FIELD", "RequiredFieldsValidator", "session_id", "session_id is empty"),
    ("event_type NOT IN ('CLICK', 'PURCHASE', 'PAGE_VIEW')", "UNKNOWN_EVENT_TYPE", "EventTypeAllowlistValidator", "event_type", "event type isn''t allowed"),
    ("length(user_id) > 256", "MALFORMED_RECORD", "UserIdShapeValidator", "user_id", "user_id is too long"),
    ("contains(user_id, chr(10))", "MALFORMED_RECORD", "UserIdShapeValidator", "user_id", "user_id holds a line break or NUL"),
    ("event_type = 'PURCHASE' AND price_cents <= 0", "OUT_OF_RANGE", "PriceRangeValidator", "payload.price_cents", "price isn''t positive"),
    (f"event_type = 'PURCHASE' AND price_cents > {MAX_CENTS}", "OUT_OF_RANGE", "PriceRangeValidator", "payload.price_cents", "price is too high"),
    ("event_type = 'PURCHASE' AND (quantity < 1 OR quantity > 10000)", "OUT_OF_RANGE", "QuantityRangeValidator", "payload.quantity", "quantity out of range"),
    (f"event_us > {NOW_US} + 3600000000", "OUT_OF_RANGE", "TimestampRangeValidator", "event_timestamp", "event is in the future"),
    (f"event_us < {NOW_US} - 604800000000", "OUT_OF_RANGE", "TimestampRangeValidator", "event_timestamp", "event is too old"),
]


def _tagged_sql(name: str, source: str) -> str:
    case = lambda i: "CASE " + " ".join(f"WHEN {r[0]} THEN '{r[i]}'" for r in _RULES) + " END"
    return f"{name} AS (SELECT *, {case(1)} AS error_class, {case(2)} AS validator_name, {case(3)} AS error_field_path, {case(4)} AS error_message FROM {source})"


_TAGGED = _tagged_sql("tagged", "ev")
_HARD = f"""hard AS (SELECT * REPLACE (
  CASE WHEN n % 97 = 0 THEN '' WHEN n % 89 = 0 THEN repeat('x', 257) WHEN n % 83 = 0 THEN user_id || chr(10) ELSE user_id END AS user_id,
  CASE WHEN n % 79 = 0 THEN '' ELSE session_id END AS session_id, CASE WHEN n % 7 = 0 THEN 0 WHEN n % 11 = 0 THEN 20000 ELSE quantity END AS quantity,
  CASE WHEN n % 13 = 0 THEN 0 ELSE price_cents END AS price_cents,
  CASE WHEN n % 17 = 0 THEN {NOW_US} + 7200000000 WHEN n % 19 = 0 THEN {NOW_US} - 691200000000 ELSE {NOW_US} - n % 500000 * 1000000 END AS event_us)
  FROM (SELECT *, CAST(event_id AS BIGINT) AS n FROM ev))"""
_MODEL = """hm AS (SELECT *, CASE WHEN event_type = 'CLICK' AND n % 5 = 0 THEN 'element_id' WHEN event_type = 'CLICK' AND n % 6 = 0 THEN 'page_url'
  WHEN event_type = 'PURCHASE' AND quantity < 1 THEN 'quantity' WHEN event_type = 'PURCHASE' AND n % 9 = 0 THEN 'price_cents' WHEN event_type = 'PURCHASE' AND n % 8 = 0 THEN 'currency'
  WHEN event_type = 'PAGE_VIEW' AND n % 6 = 0 THEN 'page_url' WHEN user_id = '' THEN 'user_id' WHEN session_id = '' THEN 'session_id' WHEN n % 10 = 0 THEN 'coupon' END AS error_field_path FROM hard)"""

# -- offline and online ----------------------------------------------------------------------


def raw_events_dedup(spark, d):
    """Two overlapping deliveries of the events; the first arrival of an id counts."""
    e = offline.raw_rows(events_from_table(spark, d)).withColumn("n", F.col("event_id").cast("bigint"))
    again = e.where("n % 3 = 0").withColumn("arrival", F.col("n") + 10_000_000).withColumn("session_id", F.lit("late"))
    return offline.first_arrivals(e.withColumn("arrival", F.col("n")).unionByName(again)).select("event_id", "event_type", "user_id", "session_id", "event_us", "properties", "arrival")


def avro_round_trip(spark, d):
    """Events as framed Avro messages of version 1, read back by version 1.1, every 50th message
    cut short and every 70th of an unknown schema."""
    n = F.col("event_id").cast("bigint")
    kinds = events_from_table(spark, d).where(F.col("event_type").isin("CLICK", "PURCHASE", "PAGE_VIEW")).withColumn("n", n).withColumn("event_id", F.md5("event_id"))
    sent = avro.to_avro(sources.nested(kinds, ["n"]), EVENT_AVRO, schema_id=7, keep=["n"])
    value = F.when(F.col("n") % 50 == 0, F.substring("value", F.lit(1), F.length("value") - 1)).when(F.col("n") % 70 == 0, F.concat(F.lit(b"\0\0\0\0\x09"), F.substring("value", F.lit(6), F.lit(10**6)))).otherwise(F.col("value"))
    got = sources.decode_avro(sent.withColumn("value", value), evolution.add_optional(EVENT_AVRO, "EcommerceEvent", "device_type", "string"), {7: EVENT_AVRO})
    return got.drop("value")


def raw_insert_counts(spark, d):
    e = events_from_table(spark, d).withColumn("arrival", F.col("event_id").cast("bigint"))
    stored = e.where("arrival % 5 = 0")
    return offline.insert_counts(e.unionByName(e.where("arrival % 4 = 0")), stored)


def online_vector(spark, d):
    return online.vector(sliding_all(spark, d))


def online_lookup_zero_fill(spark, d):
    """All users, and as many that no event has."""
    users = events_from_table(spark, d).select("user_id").distinct()
    return online.lookup(users.union(users.select(F.concat("user_id", F.lit("-new")))), online.vector(sliding_all(spark, d)))


def online_ttl(spark, d):
    return online.unexpired(online.vector(sliding_all(spark, d)), NOW_US // 1000).select("user_id", "expires_at_ms")


def online_strings(spark, d):
    return online.as_strings(online.vector(sliding_all(spark, d)))


_VECTOR = "vec AS (SELECT user_id, " + ", ".join(f"CAST(arg_max({f}, window_end_ms) FILTER (window_resolution = '{r}' AND {f} IS NOT NULL) AS {k.upper()}) AS \"{n}\"" for n, r, f, k in online_fields()) + ", max({'e': window_end_ms, 't': CASE window_resolution WHEN '5m' THEN 450000 WHEN '1h' THEN 5400000 ELSE 129600000 END}) AS m FROM alls GROUP BY user_id)"
_FIELDS = ", ".join(f'"{n}"' for n, *_ in online_fields())


def pit_join(spark, d):
    """For each purchase the user's 5-minute features as of then."""
    e = events_from_table(spark, d)
    asked = e.where("event_type = 'PURCHASE'").select("event_id", "user_id", F.expr("event_us div 1000").alias("at_ms"))
    have = sliding_5m(spark, d).select("user_id", "window_end_ms", "click_count", "revenue")
    return offline.as_of(asked, have, "user_id", "at_ms", "window_end_ms", ["window_end_ms", "click_count", "revenue"])


def online_offline_diff(spark, d):
    """Features of all events against those without every 50th."""
    e = events_from_table(spark, d)
    keys, values = ["user_id", "window_end_ms"], ["click_count", "page_view_count", "purchase_count"]
    return offline.consistency(windows.sliding(e.where("cast(event_id as bigint) % 50 <> 0"), R5M), windows.sliding(e, R5M), keys, values)


def freshness(spark, d):
    """How long ago each user's last event was."""
    return events_from_table(spark, d).groupBy("user_id").agg((F.lit(NOW_US) - F.max("event_us")).alias("age_us"))


# -- metrics ---------------------------------------------------------------------------------


def partition_skew(spark, d):
    e = events_from_table(spark, d).groupBy((F.substring("user_id", 3, 6).cast("int") % 12).alias("partition")).agg(F.count("*").alias("n"))
    return metrics.partition_skew(e)


def latency_percentiles(spark, d):
    return metrics.percentiles(spark.read.parquet(f"{d}/events.parquet").select((F.col("value") - 1).alias("ms")), "ms")


def batch_histogram(spark, d):
    e = events_from_table(spark, d).groupBy("user_id", F.expr("event_us div 86400000000").alias("day")).agg(F.count("*").alias("size"))
    return metrics.histogram(e, metrics.batch_bucket(F.col("size")), "edge")


def lag_ramp(spark, d):
    """Events per hour as if they were the lag at that hour."""
    e = events_from_table(spark, d).groupBy(F.expr("event_us div 3600000000").alias("seq")).agg(F.count("*").alias("lag"))
    return metrics.lag_ramp(e)


def delivery_counters(spark, d):
    status = F.when(F.col("event_type") == "ERROR", "failed").when(F.col("event_type") == "SIGNUP", "pending").otherwise("acked")
    return metrics.delivery(events_from_table(spark, d).select(status.alias("status")))


def delivery_errors(spark, d):
    """Failed deliveries by class of error; every fourth has none."""
    status = F.when(F.col("event_type") == "ERROR", "failed").otherwise("acked")
    error = F.element_at(F.array(F.lit("TIMED_OUT"), F.lit("QUEUE_FULL"), F.lit("FENCED"), F.lit(None)), F.col("quantity"))
    return metrics.delivery_errors(events_from_table(spark, d).select(status.alias("status"), error.alias("error")))


def merged_percentiles(spark, d):
    """Latencies of twelve processes, each with a reservoir of 50 samples."""
    e = events_from_table(spark, d).select("event_id", (F.substring("user_id", 3, 6).cast("int") % 12).alias("process"), (F.col("price_cents") - 500).alias("ms"))
    return metrics.merged_percentiles(e, "ms", "event_id", "process", 50)


def sink_counters(spark, d):
    e = events_from_table(spark, d).groupBy(F.expr("event_us div 3600000000").alias("h")).agg(F.count_if(F.col("event_type") != "ERROR").alias("inserted"), F.count_if(F.col("event_type") == "ERROR").alias("skipped"), F.count("*").alias("batch_size"), F.max("quantity").cast("double").alias("latency_ms"), F.count_if(F.col("event_type") == "SIGNUP").alias("failed"))
    return metrics.sink_counts(e)


def mp_merge(spark, d):
    e = events_from_table(spark, d).groupBy((F.substring("user_id", 3, 6).cast("int") % 12).alias("p")).agg(F.count("*").alias("consumed"), F.count_if(F.col("event_type") == "ERROR").alias("failed"), ((F.max("event_us") - F.min("event_us")) / 1e6).alias("seconds"), F.sum("quantity").alias("lag"), (F.count("*") > 1_000_000).alias("ramped"))
    own = metrics.merged(e)
    return own.withColumn("passes", metrics.consume_verdict(F.col("rate"), F.col("failed"), F.col("ramped"), 0.001))


def total_lag(spark, d):
    e = events_from_table(spark, d).groupBy((F.substring("user_id", 3, 6).cast("int") % 12).alias("p")).agg(F.count("*").alias("high"), F.count_if(F.col("quantity") > 1).alias("position"))
    # of one partition the position isn't known, of another it is invalid, of a third beyond the end
    position = F.when(F.col("p") == 3, F.lit(None)).when(F.col("p") == 5, -1001).when(F.col("p") == 7, F.col("high") + 10).otherwise(F.col("position"))
    return metrics.total_lag(e.withColumn("position", position))


def window_ends(spark, d):
    """The five-minute windows that hold each event."""
    e = events_from_table(spark, d)
    return e.select("event_id", windows.pane_index(60).alias("pane"), F.explode(windows.window_ends(R5M)).alias("end_s"))


def retention(spark, d):
    """Dead letters of the last seven days."""
    t = _tagged(spark, d).where("error is not null").withColumn("at_ms", scalars.epoch_ms(F.col("event_us")))
    return sinks.retained(t, "at_ms", NOW_US // 1000, 7).select("event_id", "at_ms")


def consume_counters(spark, d):
    """Events as received a quarter second per piece after the broker had them (without its time
    for those of one piece), errors failing; lag is the events of each hour."""
    e = events_from_table(spark, d).withColumn("broker_ms", F.when(F.col("quantity") == 1, F.lit(0)).otherwise(F.expr("event_us div 1000")))
    ms = metrics.latency_ms(F.expr("event_us div 1000") + F.col("quantity") * 250, F.col("broker_ms"))
    lag = e.groupBy(F.expr("event_us div 3600000000").alias("seq")).agg(F.count("*").alias("lag"))
    failed = F.when(F.col("event_type") == "ERROR", "SCHEMA_MISMATCH").alias("decode_error")
    return metrics.percentiles(e.select(ms.alias("ms")), "ms").crossJoin(metrics.consume_counts(e.select(failed), lag))  # one row each


def message_keys(spark, d):
    """Keys of dead letters and canonical ids."""
    e = events_from_table(spark, d)
    raw = F.upper(F.md5("event_id"))
    return e.select("event_id", scalars.dlq_key(F.lit("t"), F.substring("user_id", 3, 6).cast("int") % 12, F.col("event_id")).alias("dlq_key"), scalars.canonical_uuid(raw).alias("uuid"), scalars.is_currency(F.col("currency")).alias("currency_ok"))


def emission_history(spark, d):
    """emission_seq of repeated deliveries of records: how often the key came before. A record
    is delivered once to three times, by its window."""
    own = windows.emission_keys(sliding_1h(spark, d))
    times = F.sequence(F.lit(1), (F.col("window_end_ms") / 300_000 % 3 + 1).cast("int"))
    sent = own.select("idempotency_key", F.explode(times).alias("n"))
    return metrics.running(windows.dealt(sent, events_from_table(spark, d).count() * R1H.panes * 2, 250_000, "idempotency_key"), "idempotency_key", "n")


QUERIES = {
    f.__name__: f
    for f in (
        sliding_5m, sliding_1h, sliding_24h, sliding_all, panes_1m, emission_keys, emission_counts, fired_windows, late_split, session_features,
        validate_tagged, validated_events, dlq_events, invalid_by_class, invalid_by_validator, invalid_by_field_top10, invalid_rate,
        every_rule, model_violations, internal_errors, raw_events_dedup, avro_round_trip, raw_insert_counts, online_vector, online_lookup_zero_fill, online_ttl, online_strings, pit_join, online_offline_diff, freshness,
        partition_skew, latency_percentiles, batch_histogram, lag_ramp, delivery_counters, delivery_errors, merged_percentiles, sink_counters, mp_merge, total_lag,
        window_ends, retention, consume_counters, message_keys, emission_history,
        replays.refired_windows, replays.warm_windows, replays.paned_windows, routed_outputs, keyed_inserts, accumulated_features, incremental_windows,
    )
}


def _accumulated_sql(r) -> str:
    """Quantiles are the values at the rank rounded up."""
    prices = "list_sort(list(price_cents) FILTER (event_type = 'PURCHASE' AND price_cents IS NOT NULL))"
    p95 = f"{prices}[CAST(ceil(0.95 * len({prices})) AS BIGINT)]" if r is R24H else "NULL"
    return f"""SELECT user_id, '{r.value}' AS window_resolution, e * 1000 AS window_end_ms, count(DISTINCT page_url) FILTER (event_type = 'PAGE_VIEW') AS pages,
  CAST({prices}[CAST(ceil(0.5 * len({prices})) AS BIGINT)] AS DOUBLE) AS median_price, CAST({p95} AS DOUBLE) AS p95_price, max(price_cents) FILTER (event_type = 'PURCHASE') AS top_price,
  count(price_cents) FILTER (event_type = 'PURCHASE') AS priced
FROM (SELECT *, unnest([(CAST(floor(event_us / {r.slide * 1_000_000}) AS BIGINT) + k) * {r.slide} FOR k IN range(1, {r.panes + 1})]) AS e FROM ev) GROUP BY user_id, e"""


_PART = "CAST(substr(user_id, 3, 6) AS INTEGER) % 12"
ORACLE_SQL = {
    "sliding_5m": _with(_raw(R5M)),
    "sliding_1h": _with(_raw(R1H)),
    "sliding_24h": _with(_raw(R24H)),
    "sliding_all": _with(_ALL),
    "panes_1m": _with("SELECT user_id, CAST(floor(event_us / 60000000) AS BIGINT) AS pane, count(*) FILTER (event_type = 'CLICK') AS click_count, count(*) FILTER (event_type = 'PAGE_VIEW') AS page_view_count, count(*) FILTER (event_type = 'PURCHASE') AS purchase_count, CAST(coalesce(sum(price_cents * quantity) FILTER (event_type = 'PURCHASE'), 0) AS BIGINT) AS cents, count(DISTINCT product_id) FILTER (event_type = 'PURCHASE') AS products FROM ev GROUP BY 1, 2"),
    "emission_keys": _with("SELECT user_id || ':' || window_resolution || ':' || window_end_ms || ':0' AS idempotency_key, user_id || ':' || window_resolution AS kafka_key, CASE window_resolution WHEN '5m' THEN 'W_5M_SLIDE_1M' WHEN '1h' THEN 'W_1H_SLIDE_5M' ELSE 'W_24H_SLIDE_1H' END AS symbol, CAST(0 AS INTEGER) AS emission_seq FROM alls", f"alls AS ({_ALL})"),
    "fired_windows": _with(f"SELECT user_id, window_resolution, window_end_ms, purchase_count FROM alls WHERE window_end_ms <= {RUN_MS[1]} AND window_end_ms >= {RUN_MS[0]} - {RUN_MS[0]} % CASE window_resolution WHEN '5m' THEN 60000 WHEN '1h' THEN 300000 ELSE 3600000 END", f"alls AS ({_ALL})"),
    "emission_counts": _with("SELECT window_resolution, count(*) AS emitted FROM alls GROUP BY 1", f"alls AS ({_ALL})"),
    "late_split": _with(
        "SELECT event_id, process, watermark_us, event_us < watermark_us - 30000000 AS is_late FROM w",
        f"a AS (SELECT *, {_PART} AS process, CAST(event_id AS BIGINT) AS id, (CAST(event_id AS BIGINT) + CASE WHEN CAST(event_id AS BIGINT) % 11 = 0 THEN 400 WHEN CAST(event_id AS BIGINT) % 7 = 0 THEN 40 ELSE 0 END) * 1000000 + CAST(event_id AS BIGINT) AS arrival FROM ev)",
        "w AS (SELECT *, max(event_us) OVER (PARTITION BY process ORDER BY arrival ROWS UNBOUNDED PRECEDING) - 5000000 AS watermark_us FROM a)",
    ),
    "session_features": _with(
        "SELECT user_id, min(event_us) AS start_us, max(event_us) + 1800000000 AS end_us, count(*) AS events, count(*) FILTER (event_type = 'PURCHASE') AS purchases FROM n GROUP BY user_id, s",
        "g AS (SELECT *, CASE WHEN event_us - lag(event_us) OVER (PARTITION BY user_id ORDER BY event_us, event_id) < 1800000000 THEN 0 ELSE 1 END AS f FROM ev)",
        "n AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY event_us, event_id ROWS UNBOUNDED PRECEDING) AS s FROM g)",
    ),
    "validate_tagged": _with("SELECT event_id, error_class, validator_name, error_field_path FROM tagged", _TAGGED),
    "validated_events": _with("SELECT event_id, event_type, user_id, session_id, event_us, product_id, price_cents, quantity, currency, element_id, page_url, referrer FROM tagged WHERE error_class IS NULL", _TAGGED),
    "dlq_events": _with(
        f"SELECT CAST(1 AS INTEGER) AS schema_version, 'e-commerce-events' AS original_topic, {_PART} AS original_partition, CAST(event_id AS BIGINT) AS original_offset, event_us // 1000 AS original_timestamp_ms, user_id AS original_key_bytes, "
        """'{"currency": "' || currency || '", "element_id": "' || element_id || '", "event_id": "' || event_id || '", "event_type": "' || event_type || '", "event_us": ' || event_us || ', "page_url": "' || page_url || '", "price_cents": ' || price_cents"""
        """ || ', "product_id": "' || product_id || '", "quantity": ' || quantity || ', "referrer": ' || coalesce('"' || referrer || '"', 'null') || ', "session_id": "' || session_id || '", "user_id": "' || user_id || '"}' AS original_value_bytes, """
        f"CAST({NOW_US // 1000} AS BIGINT) AS rejected_at_ms, error_class, validator_name, error_field_path, error_message, '1.0.0' AS validator_version, 'e-commerce-events:' || ({_PART}) || ':' || event_id AS dlq_key FROM tagged WHERE error_class IS NOT NULL",
        _TAGGED,
    ),
    "every_rule": _with("SELECT event_id, error_class, validator_name, error_field_path, error_message FROM ht", _HARD, _tagged_sql("ht", "hard")),
    "model_violations": _with("SELECT event_id, CASE WHEN error_field_path IS NOT NULL THEN 'NULL_REQUIRED_FIELD' END AS error_class, CASE WHEN error_field_path IS NOT NULL THEN 'PydanticAdapter' END AS validator_name, error_field_path FROM hm", _HARD, _MODEL),
    "internal_errors": _with("SELECT event_id, CASE WHEN b THEN 'PIPELINE_INTERNAL_ERROR' END AS error_class, CASE WHEN b THEN 'SharesValidator' END AS validator_name, CAST(NULL AS VARCHAR) AS error_field_path, CASE WHEN b THEN true END AS raised FROM (SELECT *, event_type = 'PURCHASE' AND quantity = 3 AS b FROM ev)"),
    "invalid_by_class": _with("SELECT error_class AS key, count(*) AS n FROM tagged WHERE error_class IS NOT NULL GROUP BY 1", _TAGGED),
    "invalid_by_validator": _with("SELECT validator_name AS key, count(*) AS n FROM tagged WHERE error_class IS NOT NULL GROUP BY 1", _TAGGED),
    "invalid_by_field_top10": _with("SELECT error_field_path AS key, count(*) AS n FROM tagged WHERE error_field_path IS NOT NULL GROUP BY 1 ORDER BY n DESC, key LIMIT 10", _TAGGED),
    "invalid_rate": _with("SELECT count(*) AS consumed, count(error_class) AS invalid, round(CAST(count(error_class) AS DOUBLE) / count(*), 9) AS rate, CAST(count(error_class) AS DOUBLE) / count(*) > 0.05 AS elevated FROM tagged", _TAGGED),
    "raw_events_dedup": _with("""SELECT event_id, event_type, user_id, session_id, event_us, CAST(event_id AS BIGINT) AS arrival, CASE event_type
  WHEN 'PURCHASE' THEN '{"product_id":"' || product_id || '","quantity":' || quantity || ',"price_cents":' || price_cents || ',"currency":"' || currency || '"}'
  WHEN 'CLICK' THEN '{"element_id":"' || element_id || '","page_url":"' || page_url || '"}'
  WHEN 'PAGE_VIEW' THEN '{"page_url":"' || page_url || '","referrer":' || coalesce('"' || referrer || '"', 'null') || '}' ELSE '{}' END AS properties FROM ev"""),
    "avro_round_trip": _with("""SELECT n, CASE WHEN ok THEN md5(event_id) END AS event_id, CASE WHEN ok THEN event_type END AS event_type, CASE WHEN ok THEN user_id END AS user_id, CASE WHEN ok THEN session_id END AS session_id,
  CASE WHEN ok THEN event_us END AS event_us, CASE WHEN ok AND event_type = 'PURCHASE' THEN product_id END AS product_id, CASE WHEN ok AND event_type = 'PURCHASE' THEN price_cents END AS price_cents,
  CASE WHEN ok AND event_type = 'PURCHASE' THEN quantity END AS quantity, CASE WHEN ok AND event_type = 'PURCHASE' THEN currency END AS currency, CASE WHEN ok AND event_type = 'CLICK' THEN element_id END AS element_id,
  CASE WHEN ok AND event_type <> 'PURCHASE' THEN page_url END AS page_url, CASE WHEN ok AND event_type = 'PAGE_VIEW' THEN referrer END AS referrer, CASE WHEN NOT ok THEN 'SCHEMA_MISMATCH' END AS decode_error
FROM (SELECT *, CAST(event_id AS BIGINT) AS n, CAST(event_id AS BIGINT) % 50 <> 0 AND CAST(event_id AS BIGINT) % 70 <> 0 AS ok FROM ev WHERE event_type IN ('CLICK', 'PURCHASE', 'PAGE_VIEW'))"""),
    "raw_insert_counts": _with("SELECT count(*) FILTER (id % 5 <> 0) AS inserted, count(*) + count(*) FILTER (id % 4 = 0) - count(*) FILTER (id % 5 <> 0) AS skipped FROM (SELECT CAST(event_id AS BIGINT) AS id FROM ev)"),
    "online_vector": _with(f"SELECT user_id, {_FIELDS}, m.e + m.t AS expires_at_ms FROM vec", f"alls AS ({_ALL})", _VECTOR),
    "online_lookup_zero_fill": _with("SELECT u.user_id, v.user_id IS NOT NULL AS key_present, " + ", ".join(f'CAST(coalesce("{n}", 0) AS {k.upper()}) AS "{n}"' for n, _, _, k in online_fields()) + " FROM (SELECT DISTINCT user_id FROM ev UNION ALL SELECT DISTINCT user_id || '-new' FROM ev) u LEFT JOIN vec v USING (user_id)", f"alls AS ({_ALL})", _VECTOR),
    "online_ttl": _with(f"SELECT user_id, m.e + m.t AS expires_at_ms FROM vec WHERE m.e + m.t > {NOW_US // 1000}", f"alls AS ({_ALL})", _VECTOR),
    "online_strings": _with("SELECT * FROM (" + " UNION ALL ".join(f"SELECT user_id, '{n}' AS field, CAST(\"{n}\" AS VARCHAR) AS value FROM vec" for n, *_ in online_fields()) + ") WHERE value IS NOT NULL", f"alls AS ({_ALL})", _VECTOR),
    "pit_join": _with("SELECT e.event_id, e.user_id, e.at_ms, s.window_end_ms, s.click_count, s.revenue FROM (SELECT event_id, user_id, event_us // 1000 AS at_ms FROM ev WHERE event_type = 'PURCHASE') e ASOF LEFT JOIN s ON e.user_id = s.user_id AND e.at_ms >= s.window_end_ms", f"s AS ({_raw(R5M)})"),
    "online_offline_diff": _with(
        "SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.window_end_ms, b.window_end_ms) AS window_end_ms, CASE WHEN a.user_id IS NULL THEN 'missing_online' WHEN b.user_id IS NULL THEN 'missing_offline' ELSE 'different' END AS status FROM a FULL JOIN b ON a.user_id = b.user_id AND a.window_end_ms = b.window_end_ms WHERE a.user_id IS NULL OR b.user_id IS NULL OR a.click_count <> b.click_count OR a.page_view_count <> b.page_view_count OR a.purchase_count <> b.purchase_count",
        f"a AS ({_raw(R5M).replace('FROM ev)', 'FROM ev WHERE CAST(event_id AS BIGINT) % 50 <> 0)')})", f"b AS ({_raw(R5M)})",
    ),
    "freshness": _with(f"SELECT user_id, {NOW_US} - max(event_us) AS age_us FROM ev GROUP BY 1"),
    "partition_skew": _with("SELECT round(max(n) / avg(n), 6) AS skew, max(n) / avg(n) < 2.0 AS passes FROM p", f"p AS (SELECT {_PART} AS k, count(*) AS n FROM ev GROUP BY 1)"),
    "latency_percentiles": "SELECT round(quantile_cont(value - 1, 0.5) FILTER (value >= 1), 6) AS p50, round(quantile_cont(value - 1, 0.95) FILTER (value >= 1), 6) AS p95, round(quantile_cont(value - 1, 0.99) FILTER (value >= 1), 6) AS p99 FROM events",
    "batch_histogram": _with("SELECT coalesce((SELECT min(x) FROM unnest([1, 10, 50, 100, 250, 500, 1000, 2500, 5000, 10000]) t(x) WHERE x >= size), 10000) AS edge, count(*) AS n FROM (SELECT count(*) AS size FROM ev GROUP BY user_id, event_us // 86400000000) GROUP BY 1"),
    "lag_ramp": _with("SELECT count(*) AS n, max(lag) AS max_lag, arg_max(lag, seq) AS end_lag, round(regr_slope(lag, seq), 6) AS slope, count(*) >= 3 AND max(lag) > 0 AND regr_slope(lag, seq) > 0 AND regr_slope(lag, seq) * (count(*) - 1) >= max(lag) * 0.1 AS ramped FROM (SELECT event_us // 3600000000 AS seq, count(*) AS lag FROM ev GROUP BY 1)"),
    "delivery_counters": _with("SELECT count(*) AS produced, count(*) FILTER (event_type NOT IN ('ERROR', 'SIGNUP')) AS acked, count(*) FILTER (event_type = 'ERROR') AS failed, count(*) FILTER (event_type = 'SIGNUP') AS in_flight FROM ev"),
    "delivery_errors": _with("SELECT coalesce(CASE quantity WHEN 1 THEN 'TIMED_OUT' WHEN 2 THEN 'QUEUE_FULL' WHEN 3 THEN 'FENCED' END, 'unknown') AS key, count(*) AS n FROM ev WHERE event_type = 'ERROR' GROUP BY 1"),
    "merged_percentiles": _with("SELECT round(quantile_cont(ms, 0.5), 6) AS p50, round(quantile_cont(ms, 0.95), 6) AS p95, round(quantile_cont(ms, 0.99), 6) AS p99 FROM (SELECT CAST(ms AS DOUBLE) AS ms, row_number() OVER (PARTITION BY process ORDER BY md5('42:' || event_id), event_id) AS r FROM l WHERE ms >= 0) WHERE r <= 50", f"l AS (SELECT event_id, {_PART} AS process, price_cents - 500 AS ms FROM ev)"),
    "sink_counters": _with("SELECT CAST(sum(i) AS BIGINT) AS inserted, CAST(sum(s) AS BIGINT) AS skipped, CAST(sum(f) AS BIGINT) AS failed, count(*) AS batches, round(quantile_cont(b, 0.5), 6) AS batch_p50, round(quantile_cont(b, 0.99), 6) AS batch_p99, round(quantile_cont(l, 0.5), 6) AS flush_p50, round(quantile_cont(l, 0.95), 6) AS flush_p95 FROM (SELECT count(*) FILTER (event_type <> 'ERROR') AS i, count(*) FILTER (event_type = 'ERROR') AS s, count(*) FILTER (event_type = 'SIGNUP') AS f, CAST(count(*) AS DOUBLE) AS b, CAST(max(quantity) AS DOUBLE) AS l FROM ev GROUP BY event_us // 3600000000)"),
    "mp_merge": _with("SELECT CAST(sum(c) AS BIGINT) AS consumed, CAST(sum(f) AS BIGINT) AS failed, max(s) AS seconds, CAST(sum(l) AS BIGINT) AS lag, bool_or(c > 1000000) AS ramped, round(sum(c) / max(s), 6) AS rate, NOT bool_or(c > 1000000) AND sum(f) = 0 AND round(sum(c) / max(s), 6) >= 0.001 AS passes FROM p", f"p AS (SELECT count(*) AS c, count(*) FILTER (event_type = 'ERROR') AS f, (max(event_us) - min(event_us)) / 1e6::DOUBLE AS s, sum(quantity) AS l FROM ev GROUP BY {_PART})"),
    "window_ends": _with("SELECT event_id, CAST(floor(event_us / 60000000) AS BIGINT) AS pane, unnest([(CAST(floor(event_us / 60000000) AS BIGINT) + k) * 60 FOR k IN range(1, 6)]) AS end_s FROM ev"),
    "retention": _with(f"SELECT event_id, event_us // 1000 AS at_ms FROM tagged WHERE error_class IS NOT NULL AND event_us // 1000 >= {NOW_US // 1000} - 604800000", _TAGGED),
    "consume_counters": _with("SELECT * FROM (SELECT round(quantile_cont(quantity * 250.0::DOUBLE, 0.5) FILTER (quantity > 1), 6) AS p50, round(quantile_cont(quantity * 250.0::DOUBLE, 0.95) FILTER (quantity > 1), 6) AS p95, round(quantile_cont(quantity * 250.0::DOUBLE, 0.99) FILTER (quantity > 1), 6) AS p99, count(*) AS polled, count(*) FILTER (event_type = 'ERROR') AS deserialize_failures, count(*) FILTER (event_type <> 'ERROR') AS consumed FROM ev), (SELECT max(lag) AS max_lag, arg_max(lag, seq) AS end_lag FROM (SELECT event_us // 3600000000 AS seq, count(*) AS lag FROM ev GROUP BY 1))"),
    "message_keys": _with(f"SELECT event_id, 't:' || ({_PART}) || ':' || event_id AS dlq_key, regexp_replace(md5(event_id), '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '\\1-\\2-\\3-\\4-\\5') AS uuid, true AS currency_ok FROM ev"),
    "emission_history": _with("SELECT user_id || ':1h:' || window_end_ms || ':0' AS idempotency_key, CAST(n AS INTEGER) AS n, CAST(n - 1 AS INTEGER) AS emission_seq FROM (SELECT *, unnest(range(1, CAST(window_end_ms / 300000 % 3 + 2 AS BIGINT))) AS n FROM r)", f"r AS ({_raw(R1H)})"),
    "routed_outputs": _with("SELECT event_id, CASE WHEN error_class IS NULL THEN 'validated' ELSE 'dead' END AS output, error_class FROM tagged", _TAGGED),
    "keyed_inserts": _with("SELECT event_id, user_id, event_us, b AS arrival, b AS batch FROM (SELECT *, CAST(CASE WHEN n % 10 = 0 THEN least(n % 4, (n + 1) % 4) ELSE n % 4 END AS INTEGER) AS b FROM (SELECT *, CAST(event_id AS BIGINT) AS n FROM ev))"),
    "incremental_windows": _with(_ALL),
    "accumulated_features": _with(" UNION ALL ".join(_accumulated_sql(r) for r in RESOLUTIONS)),
    "refired_windows": replays.REFIRED_SQL,
    "warm_windows": replays.WARM_SQL,
    # what the watermark has closed: the last event's time less the skew of five seconds
    "paned_windows": _with(f"SELECT * FROM ({_ALL}) WHERE window_end_ms <= (SELECT max(event_us) // 1000 FROM ev) - 5000"),
    "total_lag": _with(f"SELECT CAST(count(*) FILTER (quantity <= 1) AS BIGINT) AS lag FROM ev WHERE ({_PART}) NOT IN (3, 5, 7)"),
}
