"""The online vector: the latest value of each field per user, with expiry, read zero-filled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import float_text
from ..schema import RESOLUTIONS, online_fields


def updates(features: DataFrame, order: Column | None = None) -> DataFrame:
    """Feature records as updates of single fields: the order in which they count decides.

    By default a later window end wins, then a later emission (if there are any); give the order of
    arrival to let whatever came last win.
    """
    # a number where one does: what is kept of a struct can't be aggregated by hash, but needs all records sorted
    default = F.struct("window_end_ms", "emission_seq") if "emission_seq" in features.columns else F.col("window_end_ms")
    by = default if order is None else order
    return features.withColumn("_order", by)


def vector(features: DataFrame, order: Column | None = None, ttl_multiplier: float = 1.5) -> DataFrame:
    """One row per user: the 13 fields, each from its last record where it isn't null (a null
    never overwrites), and when the row expires, by the last record written."""
    rows = updates(features, order)
    own = [F.expr(f"max_by({f}, _order) FILTER (WHERE window_resolution = '{r}' AND {f} IS NOT NULL)").cast(kind).alias(field) for field, r, f, kind in online_fields()]
    ttls = {r.value: F.lit(r.ttl_seconds(ttl_multiplier) * 1000) for r in RESOLUTIONS}
    if order is None and "emission_seq" not in features.columns:
        last = F.greatest(*(F.struct(F.max(F.when(F.col("window_resolution") == r, F.col("window_end_ms"))).alias("window_end_ms"), ttl.alias("ttl")) for r, ttl in ttls.items()))
    else:
        ttl = F.element_at(F.create_map(*(x for r, t in ttls.items() for x in (F.lit(r), t))), F.col("window_resolution"))
        last = F.max(F.struct("window_end_ms", "_order", ttl.alias("ttl")))
    return rows.groupBy("user_id").agg(*own, last.alias("_last")).withColumn("expires_at_ms", F.col("_last.window_end_ms") + F.col("_last.ttl")).drop("_last")


def merge(stored: DataFrame, new: DataFrame) -> DataFrame:
    """An upsert: fields of new where they aren't null, else those stored; new's expiry."""
    fields = [f for f, *_ in online_fields()]
    both = stored.select("user_id", *(F.col(f).alias(f"_{f}") for f in fields), F.col("expires_at_ms").alias("_e")).join(new, "user_id", "full_outer")
    return both.select("user_id", *(F.coalesce(f, f"_{f}").alias(f) for f in fields), F.coalesce("expires_at_ms", "_e").alias("expires_at_ms"))


def unexpired(online: DataFrame, now_ms: int) -> DataFrame:
    return online.where(F.col("expires_at_ms") > now_ms)


def lookup(requests: DataFrame, online: DataFrame) -> DataFrame:
    """A full vector for every requested user, zeros where nothing is stored, and key_present."""
    rows = requests.join(online.withColumn("_there", F.lit(True)), "user_id", "left")
    return rows.select("user_id", F.col("_there").isNotNull().alias("key_present"), *(F.coalesce(F.col(f), F.lit(0)).cast(kind).alias(f) for f, _, _, kind in online_fields()))


def as_strings(online: DataFrame) -> DataFrame:
    """user_id, field, value as text: what a hash store keeps; nulls aren't written."""
    text = lambda f, kind: float_text(F.col(f)) if kind == "double" else F.col(f).cast("string")
    pairs = F.array(*(F.struct(F.lit(f).alias("field"), text(f, kind).alias("value")) for f, _, _, kind in online_fields()))
    return online.select("user_id", F.inline(pairs)).where("value is not null")


def from_strings(pairs: DataFrame) -> DataFrame:
    """The typed vector of stored text; unknown fields are ignored, garbage is an error."""
    own = [F.max(F.when(F.col("field") == f, F.col("value"))).cast(kind).alias(f) for f, _, _, kind in online_fields()]
    return pairs.groupBy("user_id").agg(*own)
