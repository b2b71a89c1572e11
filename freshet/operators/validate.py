"""Validation: ordered rules, the first failure wins, every event goes one of two ways.

A rule gives a nullable struct (error_class, validator_name, error_field_path, error_message);
``coalesce`` over the rules in order is the pipeline, all inside one projection.
"""

from __future__ import annotations

import traceback
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import json_text
from ..schema import CLICK, EVENT_TYPES, PAGE_VIEW, PURCHASE

ERROR = "struct<error_class:string,validator_name:string,error_field_path:string,error_message:string>"
WEEK_US, HOUR_US = 7 * 86_400_000_000, 3_600_000_000


def error(error_class: str, validator: str, path: Column | str | None, message: Column | str) -> Column:
    text = F.lit(message) if isinstance(message, str) else message
    field = path if isinstance(path, Column) else F.lit(path).cast("string")
    return F.struct(F.lit(error_class).alias("error_class"), F.lit(validator).alias("validator_name"), field.alias("error_field_path"), text.alias("error_message"))


@dataclass(frozen=True)
class Rule:
    """failures: (condition, error class, field, message), tried in order; a null condition is no
    failure. applies_to: an event that a rule doesn't apply to passes it."""

    name: str
    failures: Callable[[], Sequence[tuple[Column, str, str | Column | None, str]]]
    applies_to: tuple[str, ...] | None = None
    struct: Callable[[], Column] | None = None  # instead of failures: the error, its class null if there is none

    def check(self) -> Column:
        if self.struct is not None:
            found = self.struct()
            return F.when(found["error_class"].isNotNull(), found)
        out = None
        for bad, error_class, path, message in self.failures():
            found = error(error_class, self.name, path, message)
            out = F.when(bad, found) if out is None else out.when(bad, found)
        if self.applies_to is None:
            return out
        return F.when(F.col("event_type").isin(*self.applies_to), out)


def decode_rule() -> Rule:
    """What didn't decode (see sources.events.decode_json); goes before all other rules."""
    e = F.col("decode_error")
    return Rule("AvroEventConsumer", lambda: [(e == c, c, None, "the message doesn't decode") for c in ("SCHEMA_MISMATCH", "DESERIALIZE_FAILURE")])


#: Fields of the model: those of every event, and those of each type's payload.
ENVELOPE = ("event_id", "event_type", "user_id", "session_id", "event_us")
PAYLOADS = {CLICK: ("element_id", "page_url"), PURCHASE: ("product_id", "quantity", "price_cents", "currency"), PAGE_VIEW: ("page_url", "referrer")}


def model_rule(columns: Sequence[str] = (*ENVELOPE, *PAYLOADS[PURCHASE])) -> Rule:
    """What the event model itself refuses: the payload is built before the event around it, and
    each checks its fields in their order, then what it doesn't know.

    columns: those of the events at hand; a payload without any column of its own isn't judged.
    ``extra_fields`` (an array of names), if there, holds the fields that the model doesn't have.
    """
    kind, null, have = F.col("event_type"), "NULL_REQUIRED_FIELD", set(columns)
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    bad = {
        "product_id": (empty("product_id"), "product_id is empty"),
        "quantity": (F.coalesce(F.col("quantity"), F.lit(0)) < 1, "quantity is under 1"),
        "price_cents": (F.coalesce(F.col("price_cents"), F.lit(-1)) < 0, "price_cents is negative"),
        "currency": (~F.coalesce(F.col("currency"), F.lit("")).rlike("^[A-Z]{3}$"), "currency is no code of three letters"),
        "element_id": (empty("element_id"), "element_id is empty"),
        "page_url": (empty("page_url"), "page_url is empty"),
    }
    tests = [((kind == t) & bad[f][0], null, f, bad[f][1]) for t, fields in PAYLOADS.items() for f in fields if f in bad and f in have]
    tests += [(empty(c), null, c, f"{c} is empty") for c in ("user_id", "session_id")]
    if "extra_fields" in have:
        tests.append((F.size("extra_fields") > 0, null, F.element_at("extra_fields", 1), "the model has no such field"))
    return Rule("PydanticAdapter", lambda: tests)


def python_rule(name: str, judge: Callable[[dict], tuple[str, str | None, str] | None], columns: Sequence[str], applies_to: tuple[str, ...] | None = None) -> Rule:
    """A rule of Python: judge(fields) gives (error class, field, message), or None for an event
    that passes. What it raises rejects the event as PIPELINE_INTERNAL_ERROR with the traceback
    (8 frames at most) as message; no event stops the job. Run in Arrow batches, and only where
    no built-in expression will do; judge isn't called for events that the rule doesn't apply to.
    """

    @F.pandas_udf(ERROR)
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for fields in rows.to_dict("records"):
            kind = fields.pop("_kind")
            try:
                found = judge(fields) if applies_to is None or kind in applies_to else None
            except Exception:  # noqa: BLE001 - it becomes the event's error
                found = ("PIPELINE_INTERNAL_ERROR", None, traceback.format_exc(limit=8))
            out.append((found[0], name, found[1], found[2]) if found else (None,) * 4)
        return pd.DataFrame(out, columns=["error_class", "validator_name", "error_field_path", "error_message"])

    return Rule(name, lambda: [], applies_to, lambda: run(F.struct(F.col("event_type").alias("_kind"), *columns)))


# The names of the rules below, the classes and paths of their errors.


def required_fields() -> Rule:
    return Rule("RequiredFieldsValidator", lambda: [(F.coalesce(F.col(c), F.lit("")) == "", "NULL_REQUIRED_FIELD", c, f"{c} is empty") for c in ("user_id", "session_id")])


def event_type_allowlist(allowed: Sequence[str] = ()) -> Rule:
    """An empty list means all known types."""
    known = tuple(allowed) or EVENT_TYPES
    return Rule("EventTypeAllowlistValidator", lambda: [(~F.coalesce(F.col("event_type").isin(*known), F.lit(False)), "UNKNOWN_EVENT_TYPE", "event_type", "event type isn't allowed")])


def user_id_shape(longest: int = 256) -> Rule:
    u = F.col("user_id")
    bad = "MALFORMED_RECORD"
    return Rule("UserIdShapeValidator", lambda: [(F.char_length(u) > longest, bad, "user_id", "user_id is too long"), (u.contains("\n") | u.contains("\0"), bad, "user_id", "user_id holds a line break or NUL")])


def price_range(most: int = 1_000_000_000) -> Rule:
    p = F.col("price_cents")
    return Rule("PriceRangeValidator", lambda: [(p <= 0, "OUT_OF_RANGE", "payload.price_cents", "price isn't positive"), (p > most, "OUT_OF_RANGE", "payload.price_cents", "price is too high")], (PURCHASE,))


def quantity_range(least: int = 1, most: int = 10_000) -> Rule:
    q = F.col("quantity")
    return Rule("QuantityRangeValidator", lambda: [((q < least) | (q > most), "OUT_OF_RANGE", "payload.quantity", "quantity out of range")], (PURCHASE,))


def timestamp_range(now_us: int, ahead_us: int = HOUR_US, behind_us: int = WEEK_US) -> Rule:
    """now is a parameter, never the clock; both bounds are valid themselves."""
    t = F.col("event_us")
    return Rule("TimestampRangeValidator", lambda: [(t > F.lit(now_us + ahead_us), "OUT_OF_RANGE", "event_timestamp", "event is in the future"), (t < F.lit(now_us - behind_us), "OUT_OF_RANGE", "event_timestamp", "event is too old")])


def wire_rules(now_us: int, columns: Sequence[str] | None = None, **bounds) -> list[Rule]:
    """For decoded messages: decoding, the model (see model_rule for columns), then the six rules."""
    return [decode_rule(), model_rule(columns) if columns else model_rule(), *default_rules(now_us, **bounds)]


def default_rules(now_us: int, **bounds) -> list[Rule]:
    """The six rules in their order; bounds: allowed, longest, max_price_cents, max_quantity,
    ahead_us and behind_us."""
    return [required_fields(), event_type_allowlist(bounds.get("allowed", ())), user_id_shape(bounds.get("longest", 256)), price_range(bounds.get("max_price_cents", 1_000_000_000)), quantity_range(1, bounds.get("max_quantity", 10_000)), timestamp_range(now_us, bounds.get("ahead_us", HOUR_US), bounds.get("behind_us", WEEK_US))]


def tag(events: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Adds ``error``: the first failure, or null."""
    return events.withColumn("error", F.coalesce(*(r.check() for r in rules), F.lit(None).cast(ERROR)))


def valid(tagged: DataFrame) -> DataFrame:
    return tagged.where(F.col("error").isNull()).drop("error")


#: Columns that tell where a message came from; they aren't part of its value.
METADATA = ("topic", "partition", "offset", "timestamp_ms", "key", "value", "decode_error")


def value_bytes(rows: DataFrame, name: str) -> Column:
    """A message's value as bytes: bytes as they are, structs as JSON with sorted keys, null as
    none, anything else as its text."""
    kind = rows.schema[name].dataType
    if isinstance(kind, T.BinaryType):
        own = F.col(name)
    elif isinstance(kind, T.StructType):
        fields = F.array(*(F.struct(F.lit(f.name).alias("k"), F.regexp_extract(F.to_json(F.array(F.col(name)[f.name])), r"(?s)^\[(.*)\]$", 1).alias("v")) for f in sorted(kind.fields, key=lambda f: f.name)))
        own = F.concat(F.lit("{"), F.array_join(F.transform(fields, lambda x: F.concat(F.lit('"'), x["k"], F.lit('": '), x["v"])), ", "), F.lit("}")).cast("binary")
        own = F.when(F.col(name).isNotNull(), own)
    else:
        own = F.col(name).cast("string").cast("binary")
    return F.coalesce(own, F.lit(b""))


def dead_letters(tagged: DataFrame, topic: str, rejected_at_ms: int, partition: Column | None = None, offset: Column | None = None) -> DataFrame:
    """The envelope of every rejected event; the source's raw value is kept where there is one."""
    t = tagged.where(F.col("error").isNotNull())
    has = set(tagged.columns)
    value = value_bytes(tagged, "value") if "value" in has else json_text(*(c for c in tagged.columns if c not in (*METADATA, "error"))).cast("binary")
    key = F.col("key") if "key" in has else F.col("user_id").cast("binary")
    when = F.coalesce(F.col("timestamp_ms"), F.lit(0)) if "timestamp_ms" in has else F.lit(0)
    return t.select(
        F.lit(1).alias("schema_version"),
        F.lit(topic).alias("original_topic"),
        (partition if partition is not None else F.col("partition") if "partition" in has else F.lit(0)).cast("int").alias("original_partition"),
        (offset if offset is not None else F.col("offset") if "offset" in has else F.lit(0)).cast("bigint").alias("original_offset"),
        when.cast("bigint").alias("original_timestamp_ms"),
        key.alias("original_key_bytes"),
        F.coalesce(value, F.lit(b"")).alias("original_value_bytes"),
        F.lit(rejected_at_ms).cast("bigint").alias("rejected_at_ms"),
        F.col("error.error_class"),
        F.col("error.validator_name"),
        F.col("error.error_field_path"),
        F.col("error.error_message"),
        F.lit("1.0.0").alias("validator_version"),
    )
