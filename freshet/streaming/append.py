"""The append path: every closed window once, out of Spark's own watermark and state.

It differs from the stateful path (see stateful.py) under late data: rows too late for one of
their windows still count in the others, nothing is emitted again, and nothing goes to a late
output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.windows import SECOND_US
from ..schema import CLICK, FEATURES, PAGE_VIEW, PURCHASE, Resolution


def read_events(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    """Events from a folder that files are added to."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(path)


def read_kafka(spark: SparkSession, options: dict[str, str]) -> DataFrame:
    """Raw messages with their metadata; needs Spark's Kafka connector on the class path."""
    return spark.readStream.format("kafka").options(**options).load()


def sliding(events: DataFrame, r: Resolution, delay: str = "5 seconds") -> DataFrame:
    """Feature records of closed windows; events: flat events with event_us."""
    timed = events.withColumn("ts", F.timestamp_micros("event_us")).withWatermark("ts", delay)
    bought = F.col("event_type") == PURCHASE
    own = timed.groupBy("user_id", F.window("ts", f"{r.size} seconds", f"{r.slide} seconds").alias("w")).agg(
        F.count_if(F.col("event_type") == CLICK).alias("click_count"),
        F.count_if(F.col("event_type") == PAGE_VIEW).alias("page_view_count"),
        F.count_if(bought).alias("purchase_count"),
        F.coalesce(F.sum(F.when(bought, F.col("price_cents") * F.col("quantity"))), F.lit(0)).alias("cents"),
        F.size(F.collect_set(F.when(bought, F.col("product_id")))).cast("bigint").alias("distinct_products"),
    )
    revenue = F.col("cents") / F.lit(100.0)
    value = {f: F.col(f) for f in ("click_count", "page_view_count", "purchase_count", "distinct_products")}
    value |= {"revenue": revenue, "avg_purchase_amount": F.when(F.col("purchase_count") > 0, revenue / F.col("purchase_count"))}
    return own.select(
        "user_id",
        F.lit(r.value).alias("window_resolution"),
        F.unix_millis("w.start").alias("window_start_ms"),
        F.unix_millis("w.end").alias("window_end_ms"),
        *((value[f] if f in r.features else F.lit(None)).cast(kind).alias(f) for f, kind in FEATURES.items()),
    )


def once(events: DataFrame, within: str = "1 hour") -> DataFrame:
    """Without repeated event ids, as far as the watermark reaches."""
    timed = events.withColumn("ts", F.timestamp_micros("event_us")).withWatermark("ts", within)
    return timed.dropDuplicatesWithinWatermark(["event_id"]).drop("ts")


def sessions(events: DataFrame, gap: str = "30 minutes", delay: str = "5 seconds") -> DataFrame:
    timed = events.withColumn("ts", F.timestamp_micros("event_us")).withWatermark("ts", delay)
    own = timed.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("events"))
    return own.select("user_id", (F.unix_millis("w.start") * (SECOND_US // 1000)).alias("start_us"), (F.unix_millis("w.end") * (SECOND_US // 1000)).alias("end_us"), "events")


def routed(stream: DataFrame, outputs, checkpoint: str, available_now: bool = True):
    """Starts a query that writes each batch to several outputs: {path: function of the batch}.

    A batch's folder is overwritten when the batch is run again, so every output has each batch
    once, whatever failed in between.
    """

    def write(batch: DataFrame, n: int) -> None:
        batch = batch.persist()
        try:
            for path, pick in outputs.items():
                pick(batch).write.mode("overwrite").parquet(f"{path}/batch={n}")
        finally:
            batch.unpersist()

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")).start()
