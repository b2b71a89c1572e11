"""Measured runs: produce events into a topic at a steady rate, and consume until caught up."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metrics
from ..sources import events, sinks
from ..streaming import append
from .sizing import TokenBucket

OUTCOME = "status string, error string, latency_ms double, n bigint"


def load(spark: SparkSession, topic: sinks.Topic, schema: dict, total: int, now_us: int, bucket: TokenBucket | None = None, batch: int = 4096, tries: int = 3, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """Write total synthetic events in batches, paced by the bucket; outcomes (status, error,
    latency_ms, n events) per batch.

    A batch that fails is tried again, up to ``tries`` times, under its own number, so that a topic
    of folders holds it once; one that fails for good is counted by its error and the run goes on.
    """
    bucket = bucket or TokenBucket(None, burst=max(batch, 1))
    rows = []
    for k, at in enumerate(range(0, total, batch)):
        n = min(batch, total - at)
        sleep(bucket.wait(n, clock()))
        messages = sinks.event_messages(events.synthetic(spark, n, now_us, seed=k, partitions=1), schema)
        began, problem = clock(), None
        for _ in range(tries):
            try:
                topic.write(messages, k)
                problem = None
                break
            except Exception as e:  # noqa: BLE001 - counted, not swallowed
                problem = type(e).__name__
        rows.append(("failed" if problem else "acked", problem, -1.0 if problem else (clock() - began) * 1000, n))
    return spark.createDataFrame(rows, OUTCOME)


def consume(spark: SparkSession, folder: str, schema: dict, checkpoint: str, files_per_trigger: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Read a topic of folders until nothing is left: (one row per batch: consumed and
    deserialize_failures, lag samples: seq and lag, the messages not read yet)."""
    schema_of = spark.read.parquet(folder).schema
    total = spark.read.parquet(folder).count()
    seen: list[tuple[int, int, int]] = []

    def count(batch: DataFrame, n: int) -> None:
        got = events.decode_avro(batch, schema)
        row = got.agg(F.count("*").alias("n"), F.count("decode_error").alias("bad")).first()
        seen.append((n, row["n"] - row["bad"], row["bad"]))

    reader = append.read_events(spark, folder, schema_of, files_per_trigger)
    reader.writeStream.foreachBatch(count).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    batches = spark.createDataFrame(seen, "seq bigint, consumed bigint, deserialize_failures bigint")
    left, lag = total, []
    for n, good, bad in seen:
        left -= good + bad
        lag.append((n, left))
    return batches, spark.createDataFrame(lag, "seq bigint, lag bigint")


def merged(outcomes: DataFrame, seconds: float) -> DataFrame:
    """A run's counters: events by status and the sustained rate of those acknowledged."""
    own = outcomes.agg(*(F.coalesce(F.sum(F.when(F.col("status") == s, F.col("n"))), F.lit(0)).alias(s) for s in ("acked", "failed")))
    return own.withColumn("seconds", F.lit(float(seconds))).withColumn("rate", F.round(metrics.sustained("acked", "seconds"), 1)).drop("seconds")
