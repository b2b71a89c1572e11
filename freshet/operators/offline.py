"""The offline table of raw events, and joins against it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import CLICK, PAGE_VIEW, PURCHASE
from .validate import PAYLOADS


def raw_rows(events: DataFrame) -> DataFrame:
    """Events as rows of the offline table, the payload of their type as JSON with all its fields."""
    written = lambda kind: F.to_json(F.struct(*PAYLOADS[kind]), {"ignoreNullFields": "false"})
    payload = F.when(F.col("event_type") == PURCHASE, written(PURCHASE)).when(F.col("event_type") == CLICK, written(CLICK)).when(F.col("event_type") == PAGE_VIEW, written(PAGE_VIEW)).otherwise(F.lit("{}"))
    return events.select("event_id", "event_type", "user_id", "session_id", "event_us", payload.alias("properties"))


def first_arrivals(rows: DataFrame, key: str = "event_id", arrival: str = "arrival") -> DataFrame:
    """One row per key, the first to arrive: one aggregation with partial combine, no sort."""
    own = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.min_by(F.struct(*own), F.col(arrival)).alias("r")).select(key, "r.*")


def new_rows(batch: DataFrame, stored: DataFrame, key: str = "event_id", arrival: str = "arrival") -> DataFrame:
    """What an insert that ignores conflicts would write."""
    return first_arrivals(batch, key, arrival).join(stored.select(key), key, "left_anti")


def insert_counts(batch: DataFrame, stored: DataFrame, key: str = "event_id", arrival: str = "arrival") -> DataFrame:
    """inserted and skipped; repeats within the batch count as skipped."""
    inserted = new_rows(batch, stored, key, arrival).agg(F.count("*").alias("inserted"))
    return inserted.crossJoin(batch.agg(F.count("*").alias("n"))).select("inserted", (F.col("n") - F.col("inserted")).alias("skipped"))  # one row each


def as_of(left: DataFrame, right: DataFrame, by: str, left_at: str, right_at: str, values: list[str], width: int = 86_400_000) -> DataFrame:
    """Point-in-time join: for each row of left the last values of right at or before it; none for
    a row without key or time.

    Both sides go through one window in order of time, linear in both. Times (whole numbers) are
    cut into slices of ``width``; the last values of a key's slices are carried forward, so that
    what is sorted in one task is a slice, not a key's whole history.
    """
    taken = {c.lower() for c in left.columns}
    if {v.lower() for v in values} & taken:
        raise ValueError("left has columns named like values")
    of = lambda c: F.expr(f"(`{c}` - pmod(`{c}`, {width}L)) div {width}L")
    found = right.where(F.col(by).isNotNull() & F.col(right_at).isNotNull()).select(F.col(by).alias("_by"), of(right_at).alias("_slice"), F.col(right_at).alias("_at"), F.struct(*values).alias("_v"))
    asked = left.select(F.col(by).alias("_by"), of(left_at).alias("_slice"), F.col(left_at).alias("_at"), F.struct(*left.columns).alias("_l"))
    ends = found.groupBy("_by", "_slice").agg(F.max_by("_v", "_at").alias("_end")).unionByName(asked.select("_by", "_slice").distinct(), allowMissingColumns=True)
    earlier = Window.partitionBy("_by").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.groupBy("_by", "_slice").agg(F.max("_end").alias("_end"))
    carried = ends.select("_by", "_slice", F.last("_end", ignorenulls=True).over(earlier).alias("_v"))
    # what is carried into a slice comes first in it, then right's rows before left's of one time
    rows = carried.where("_v is not null").select("_by", "_slice", F.lit(0).alias("_side"), F.lit(None).cast("bigint").alias("_at"), "_v")
    rows = rows.unionByName(found.select("_by", "_slice", F.lit(1).alias("_side"), F.col("_at").cast("bigint"), "_v"))
    rows = rows.unionByName(asked.select("_by", "_slice", F.lit(2).alias("_side"), F.col("_at").cast("bigint"), "_l"), allowMissingColumns=True)
    before = Window.partitionBy("_by", "_slice").orderBy(F.col("_at").asc_nulls_first(), "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = rows.withColumn("_last", F.when(F.col("_by").isNotNull() & F.col("_slice").isNotNull(), F.last("_v", ignorenulls=True).over(before))).where("_side = 2")
    return filled.select("_l.*", *(F.col(f"_last.{v}").alias(v) for v in values))


def consistency(online: DataFrame, offline: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Rows in which two tables of features differ: status is missing_online, missing_offline or
    different."""
    a = online.select(*keys, F.struct(*values).alias("a"))
    b = offline.select(*keys, F.struct(*values).alias("b"))
    status: Column = F.when(F.col("a").isNull(), "missing_online").when(F.col("b").isNull(), "missing_offline").when(~F.col("a").eqNullSafe(F.col("b")), "different")
    return a.join(b, keys, "full_outer").select(*keys, status.alias("status")).where("status is not null")
