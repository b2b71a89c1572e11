"""Sources of events: decoding, union payloads, and a synthetic generator."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import CLICK, EVENT, PAGE_VIEW, PURCHASE
from . import avro

FLAT = "event_id string, event_type string, user_id string, session_id string, event_us bigint, product_id string, price_cents bigint, quantity int, currency string"
UUID = "^[0-9a-fA-F]{8}-?([0-9a-fA-F]{4}-?){3}[0-9a-fA-F]{12}$"


def decode_json(messages: DataFrame, value: str = "value") -> DataFrame:
    """Messages as flat events with the cause of failure, if decoding failed.

    decode_error: SCHEMA_MISMATCH for what isn't the schema's JSON, DESERIALIZE_FAILURE for a bad
    id or an event type that isn't one; the raw value stays either way.
    """
    e = F.from_json(F.col(value).cast("string"), EVENT)
    rows = messages.withColumn("_e", e)
    broken = F.col("_e").isNull() | F.col("_e.event_type").isNull()
    cause = F.when(broken, "SCHEMA_MISMATCH").when(~F.coalesce(F.col("_e.event_id").rlike(UUID), F.lit(False)) | ~F.col("_e.event_type").isin(CLICK, PURCHASE, PAGE_VIEW), "DESERIALIZE_FAILURE")
    return rows.select(*messages.columns, *flat("_e"), cause.alias("decode_error"))


def flat(e: str) -> list[Column]:
    """A nested event's fields, flat."""
    buy = f"{e}.payload.purchase"
    return [
        F.lower(f"{e}.event_id").alias("event_id"), F.col(f"{e}.event_type"), F.col(f"{e}.user_id"), F.col(f"{e}.session_id"),
        F.unix_micros(F.col(f"{e}.event_timestamp")).alias("event_us"), F.col(f"{buy}.product_id"), F.col(f"{buy}.price_cents"), F.col(f"{buy}.quantity"), F.col(f"{buy}.currency"),
        F.col(f"{e}.payload.click.element_id"), F.coalesce(f"{e}.payload.click.page_url", f"{e}.payload.page_view.page_url").alias("page_url"), F.col(f"{e}.payload.page_view.referrer"),
    ]


def decode_avro(messages: DataFrame, read, writers=None, value: str = "value") -> DataFrame:
    """As decode_json, of Avro messages (see avro.from_avro for the schemas): a bad id is a
    DESERIALIZE_FAILURE, too."""
    rows = avro.from_avro(messages, read, writers, value, "_e", "_cause")
    bad_id = F.col("_cause").isNull() & ~F.coalesce(F.col("_e.event_id").rlike(UUID), F.lit(False))
    return rows.select(*messages.columns, *flat("_e"), F.when(bad_id, "DESERIALIZE_FAILURE").otherwise(F.col("_cause")).alias("decode_error"))


def nested(events: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Flat events with their payload as a tagged union: the member of the event's type is set.
    keep: columns that stay beside the event's."""
    kind, have = F.col("event_type"), set(events.columns)
    of = lambda c, other: F.col(c) if c in have else F.lit(other).cast("string").alias(c)
    page = of("page_url", "https://shop.example/")
    payload = F.struct(
        F.when(kind == CLICK, F.struct(of("element_id", "button"), page)).alias("click"),
        F.when(kind == PURCHASE, F.struct("product_id", "quantity", "price_cents", "currency")).alias("purchase"),
        F.when(kind == PAGE_VIEW, F.struct(page, of("referrer", None))).alias("page_view"),
    )
    return events.select(*keep, "event_id", "event_type", "user_id", "session_id", F.timestamp_micros("event_us").alias("event_timestamp"), payload.alias("payload"))


def synthetic(spark: SparkSession, n: int, now_us: int, seed: int = 42, users: int = 100_000, skus: int = 10_000, zipf: float = 1.1, weights=(0.7, 0.05, 0.25), partitions: int = 8) -> DataFrame:
    """n random flat events of the last second before now: Zipf users, click / purchase / view
    by weights, 1 to 4 pieces, log-normal prices from 50 to 500,000 cents. The same seed and
    partitions give the same events."""

    def run(frames):
        for frame in frames:
            ids = frame["id"].to_numpy()
            rng = np.random.default_rng([seed, int(ids[0]) if len(ids) else 0])
            m = len(ids)
            user = (rng.zipf(zipf, m) - 1) % users
            kind = rng.choice([CLICK, PURCHASE, PAGE_VIEW], m, p=weights)
            price = np.clip(rng.lognormal(7.5, 0.6, m).astype(np.int64), 50, 500_000)
            hexed = rng.integers(0, 2**63, (m, 2))
            yield pd.DataFrame({
                "event_id": [f"{a:016x}{b:016x}" for a, b in hexed], "event_type": kind, "user_id": [f"user-{u}" for u in user], "session_id": [f"session-{u}" for u in user],
                "event_us": now_us - rng.integers(0, 1_000_000, m), "product_id": [f"sku-{k}" for k in rng.integers(0, skus, m)], "price_cents": price, "quantity": rng.integers(1, 5, m), "currency": "USD",
            })

    return spark.range(0, n, 1, partitions).mapInPandas(run, FLAT)


def sample(spark: SparkSession, now_us: int) -> DataFrame:
    """A handful of fixed events, one of each type and a second purchase."""
    kinds = [(CLICK, 1), (PURCHASE, 1), (PAGE_VIEW, 2), (PURCHASE, 2)]
    rows = [(f"{i:032x}", kind, f"user-{u}", f"session-{u}", now_us + i * 1_000_000, "sku-1", 1999 + i, i + 1, "USD") for i, (kind, u) in enumerate(kinds)]
    return spark.createDataFrame(rows, FLAT)


def paced(spark: SparkSession, per_second: int = 200, users: int = 100_000, skus: int = 10_000) -> DataFrame:
    """A stream of so many flat events a second, made of the rate source's numbers by hashes."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", per_second).load()
    draw = lambda salt, n: F.pmod(F.xxhash64("value", F.lit(salt)), F.lit(n))
    kind = F.when(draw("kind", 100) < 70, CLICK).when(draw("kind", 100) < 75, PURCHASE).otherwise(PAGE_VIEW)
    user = draw("user", users).cast("string")
    return ticks.select(
        F.md5(F.col("value").cast("string")).alias("event_id"), kind.alias("event_type"), F.concat(F.lit("user-"), user).alias("user_id"), F.concat(F.lit("session-"), user).alias("session_id"),
        F.unix_micros("timestamp").alias("event_us"), F.concat(F.lit("sku-"), draw("sku", skus).cast("string")).alias("product_id"), (draw("price", 499_951) + 50).alias("price_cents"), (draw("quantity", 4) + 1).cast("int").alias("quantity"), F.lit("USD").alias("currency"),
    )
