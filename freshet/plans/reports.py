"""Reports of runs: small tables as Markdown. Counts come in falling order, then by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import metrics


def markdown(title: str, table: DataFrame, most: int = 100) -> str:
    """A table; what is beyond ``most`` rows is left out and counted."""
    rows = table.limit(most + 1).collect()
    lines = [f"# {title}", "", "| " + " | ".join(table.columns) + " |", "|" + "---|" * len(table.columns)]
    lines += ["| " + " | ".join(str(v) for v in r) + " |" for r in rows[:most]]
    if len(rows) > most:
        lines += ["", f"{table.count() - most} more rows are left out."]
    return "\n".join(lines) + "\n"


def joined(*parts: tuple[str, DataFrame]) -> str:
    return "\n".join(markdown(title, table) for title, table in parts)


def _verdict(counts: DataFrame, passes: Column) -> DataFrame:
    return counts.withColumn("verdict", F.when(passes, "PASSED").otherwise("FAILED"))


def load_report(outcomes: DataFrame, seconds: float, floor: float) -> str:
    """Of a producer's run: outcomes (status, error, latency_ms)."""
    counts = metrics.delivery(outcomes).withColumn("rate", F.round(F.col("acked") / F.lit(max(seconds, 1e-9)), 1))
    return joined(
        ("Load", _verdict(counts, metrics.load_verdict(F.col("rate"), F.col("failed"), floor))),
        ("Latency (ms)", metrics.percentiles(outcomes.where("status = 'acked'"), "latency_ms")),
        ("Errors", metrics.delivery_errors(outcomes)),
    )


def consume_report(messages: DataFrame, lag: DataFrame, seconds: float, floor: float) -> str:
    """Of a consumer's run: messages (decode_error, latency_ms), lag samples (seq, lag)."""
    counts = metrics.consume_counts(messages, lag).withColumn("rate", F.round(F.col("consumed") / F.lit(max(seconds, 1e-9)), 1))
    ramp = metrics.lag_ramp(lag)
    counts = counts.crossJoin(ramp.select("ramped"))  # one row each
    return joined(
        ("Consume", _verdict(counts, metrics.consume_verdict(F.col("rate"), F.col("deserialize_failures"), F.col("ramped"), floor))),
        ("End-to-end latency (ms)", metrics.percentiles(messages, "latency_ms")),
        ("Lag", ramp),
    )


def sink_report(flushes: DataFrame, partitions: DataFrame) -> str:
    """Of a sink's run: flushes (inserted, skipped, failed, batch_size, latency_ms), rows per
    partition (partition, n)."""
    return joined(
        ("Sink", metrics.sink_counts(flushes)),
        ("Batch sizes", metrics.histogram(flushes, metrics.batch_bucket(F.col("batch_size")), "up_to").orderBy("up_to")),
        ("Partitions", partitions.orderBy("partition")),
        ("Skew", metrics.partition_skew(partitions)),
    )


def validation_report(tagged: DataFrame) -> str:
    by = lambda c: metrics.in_order(metrics.histogram(tagged, f"error.{c}"))
    return joined(
        ("Validation", metrics.invalid_rate(tagged)),
        ("By class", by("error_class")),
        ("By validator", by("validator_name")),
        ("Top fields", metrics.top(metrics.histogram(tagged, "error.error_field_path"))),
    )


def features_report(features: DataFrame, late: DataFrame) -> str:
    """Of the sliding-window job: records and users per resolution, and very late events."""
    own = features.groupBy("window_resolution").agg(F.count("*").alias("emitted"), F.min("window_end_ms").alias("first_end_ms"), F.max("window_end_ms").alias("last_end_ms"))
    return joined(("Features", own.orderBy("window_resolution")), ("Late events", late.agg(F.count("*").alias("late"))))


def evolution_report(drills: DataFrame) -> str:
    """Of schema changes: drills (change, subject, rule, accepted, reads_old, read_by_old)."""
    return joined(("Schema evolution", drills.orderBy("change", "rule")))
