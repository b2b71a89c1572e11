"""Sinks: idempotent batches, the offline and the online table as Parquet folders, and messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import offline, online
from ..schema import RESOLUTIONS, online_fields
from . import avro
from .events import nested
from .folders import file_system


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


class OfflineTable:
    """Append-only rows, one per event id; a batch that is written again changes nothing.

    Of the stored rows only the keys are read; ``since`` (a column and how far it may lie back
    from the batch's least) bounds that to recent rows, where repeats can't be older.
    """

    def __init__(self, spark: SparkSession, path: str, key: str = "event_id", since: tuple[str, int] | None = None):
        self.spark, self.path, self.key, self.since = spark, path, key, since

    def append(self, batch: DataFrame, n: int, arrival: str = "arrival") -> None:
        """Write batch n: the first row of each key that no other batch holds."""
        rows = offline.first_arrivals(batch, self.key, arrival)
        stored = self._complete()
        if stored:
            others = self.spark.read.option("basePath", self.path).parquet(*stored).where(F.col("batch") != n)
            if self.since:
                column, back = self.since
                oldest = rows.agg(F.min(column)).first()[0]
                others = others.where(F.col(column) >= oldest - back) if oldest is not None else others
            rows = rows.join(others.select(self.key), self.key, "left_anti")
        rows.write.mode("overwrite").parquet(f"{self.path}/batch={n}")

    def read(self) -> DataFrame:
        """The rows of all complete batches."""
        return self.spark.read.option("basePath", self.path).parquet(*self._complete())

    def _complete(self) -> list[str]:
        """The folders of batches that were written to their end."""
        folder, fs = file_system(self.spark, self.path)
        names = [x.getPath().getName() for x in fs.listStatus(folder)] if fs.exists(folder) else []
        return [f"{self.path}/{x}" for x in sorted(names) if x.startswith("batch=") and exists(self.spark, f"{self.path}/{x}/_SUCCESS")]


_STORED = "user_id string, " + ", ".join(f"{f} {kind}" for f, _, _, kind in online_fields()) + ", expires_at_ms bigint, bucket int"


class OnlineTable:
    """One vector per user, kept as a base and the batches written since.

    A batch writes only its own users' vectors, as ``delta/v=n``: writing it again, by whatever
    process, gives the same folder, and nothing that was stored is touched. Readers take the last
    complete base and the complete batches after it, per field the last value that isn't null,
    and each user's last expiry. ``compact`` makes a new base of that, and a batch that a base
    holds already is skipped. All state is in the folders; they are complete once Spark's
    _SUCCESS file is there.

    Each is cut into ``buckets`` by a hash of the user, a file each, sorted by user and with Bloom
    filters of users, so that ``read_user`` opens one file a version and of that the row group
    that may have the user.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 16):
        self.spark, self.path, self.buckets = spark, path, buckets

    def _write(self, vectors: DataFrame, path: str) -> None:
        dealt = vectors.withColumn("bucket", self._bucket(F.col("user_id"))).repartition(self.buckets, "bucket").sortWithinPartitions("bucket", "user_id")
        dealt.write.mode("overwrite").partitionBy("bucket").option("parquet.bloom.filter.enabled#user_id", "true").parquet(path)

    def _bucket(self, user):
        return F.pmod(F.xxhash64(user), F.lit(self.buckets)).cast("int")

    def _versions(self, kind: str) -> list[int]:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}")
        fs = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [x.getPath().getName() for x in fs.listStatus(folder)] if fs.exists(folder) else []
        return sorted(int(n[2:]) for n in names if n.startswith("v=") and exists(self.spark, f"{self.path}/{kind}/{n}/_SUCCESS"))

    def upsert(self, features: DataFrame, n: int) -> None:
        if n > max(self._versions("base"), default=-1):
            self._write(online.vector(features), f"{self.path}/delta/v={n}")

    def read_user(self, user_id: str, upto: int | None = None) -> DataFrame:
        """The vector of one user, if there is one: no other bucket is listed or opened."""
        bucket = self.spark.sql("SELECT :user AS user_id", {"user": user_id}).select(self._bucket(F.col("user_id"))).first()[0]
        return self.read(upto, bucket).where(F.col("user_id") == user_id)

    def read(self, upto: int | None = None, bucket: int | None = None) -> DataFrame:
        """The vectors after batch ``upto``, or the last one; of one bucket, if given."""
        held = lambda kind: [v for v in self._versions(kind) if upto is None or v <= upto]
        base = held("base")[-1:]
        rest = [v for v in held("delta") if v > max(base, default=-1)]
        folders = [(f"{self.path}/{kind}/v={v}" + ("" if bucket is None else f"/bucket={bucket}"), v) for kind, some in (("base", base), ("delta", rest)) for v in some]
        if bucket is not None and folders:  # not every version has users of it
            folders = [x for x in folders if exists(self.spark, x[0])]
            if not folders:
                return self.spark.createDataFrame([], _STORED).drop("bucket")
        parts = [self.spark.read.schema(_STORED).parquet(path).drop("bucket").withColumn("_v", F.lit(v)) for path, v in folders]
        if not parts:
            raise ValueError(f"nothing was written to {self.path}")
        if len(parts) == 1:
            return parts[0].drop("_v")
        both = parts[0]
        for p in parts[1:]:
            both = both.unionByName(p)
        kept = [f for f, *_ in online_fields()] + ["expires_at_ms"]
        return both.groupBy("user_id").agg(*(F.expr(f"max_by({f}, _v) FILTER (WHERE {f} IS NOT NULL)").alias(f) for f in kept))

    def compact(self) -> int:
        """Write a new base of all complete batches; returns its number. What it replaces stays
        until ``vacuum``, for readers that are under way."""
        n = max(self._versions("delta") + self._versions("base"))
        if n not in self._versions("base"):
            self._write(self.read(), f"{self.path}/base/v={n}")
        return n

    def vacuum(self) -> None:
        """Delete older bases and the batches that the last base holds."""
        last = max(self._versions("base"), default=-1)
        for kind, of in (("base", lambda v: v < last), ("delta", lambda v: v <= last)):
            for v in filter(of, self._versions(kind)):
                folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}/v={v}")
                folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)


# -- messages: what goes to topics ---------------------------------------------------------------


def event_messages(events: DataFrame, schema: dict, schema_id: int | None = None) -> DataFrame:
    """key (user id) and value (Avro) of flat events."""
    return avro.to_avro(nested(events), schema, schema_id=schema_id, keep=["user_id"]).select(F.col("user_id").cast("binary").alias("key"), "value")


def feature_messages(features: DataFrame, schema: dict, schema_id: int | None = None, seq: int = 0) -> DataFrame:
    """key (user:resolution) and value (Avro; the resolution by its symbol) of feature records."""
    own = features if "emission_seq" in features.columns else features.withColumn("emission_seq", F.lit(seq))
    symbol = F.create_map(*(F.lit(x) for r in RESOLUTIONS for x in (r.value, r.symbol)))
    key = F.concat_ws(":", "user_id", "window_resolution")
    rows = own.withColumn("_key", key).withColumn("window_resolution", F.element_at(symbol, F.col("window_resolution")))
    return avro.to_avro(rows, schema, schema_id=schema_id, keep=["_key"]).select(F.col("_key").cast("binary").alias("key"), "value")


def late_messages(late: DataFrame, raw: str = "late_event") -> DataFrame:
    """key (user id) and value of very late events: the event as it came, no aggregate."""
    return late.select(F.col("user_id").cast("binary").alias("key"), F.col(raw).cast("binary").alias("value"))


def dlq_messages(letters: DataFrame, schema: dict, schema_id: int | None = None) -> DataFrame:
    """key (topic:partition:offset) and value (Avro) of dead letters."""
    key = F.concat_ws(":", "original_topic", "original_partition", "original_offset")
    return avro.to_avro(letters.withColumn("_key", key), schema, schema_id=schema_id, keep=["_key"]).select(F.col("_key").cast("binary").alias("key"), "value")


class Topic:
    """Messages as a folder of batches, or a Kafka topic, where Spark's connector for it is there.

    A folder's batch is overwritten when it is written again, so that it holds each batch once.
    Kafka gets them at least once, under keys by which repeats can be told.
    """

    def __init__(self, where: str | dict[str, str]):
        self.where = where

    def write(self, messages: DataFrame, n: int = 0) -> None:
        if isinstance(self.where, dict):
            messages.write.format("kafka").options(**self.where).save()
        else:
            messages.write.mode("overwrite").parquet(f"{self.where}/batch={n}")


def insert_stream(stream: DataFrame, table: OfflineTable, checkpoint: str, seconds: int | None = None):
    """Consume, insert, commit: a query that appends each batch to the offline table.

    Size-or-age batches: the source's cap on a trigger bounds their size, ``seconds`` their age; by
    default all that is there is taken and the query ends. A batch that fails is tried again by
    Spark, and one that was written before changes nothing. Messages that don't decode are
    counted by ``decode_error`` and dropped, as this table takes no dead letters.
    """

    def write(batch: DataFrame, n: int) -> None:
        good = batch.where("decode_error is null").drop("decode_error") if "decode_error" in batch.columns else batch
        table.append(good.withColumn("arrival", F.col("offset") if "offset" in batch.columns else F.monotonically_increasing_id()), n)

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if seconds is None else writer.trigger(processingTime=f"{seconds} seconds")).start()


def ensure_table(spark: SparkSession, path: str, schema: T.StructType) -> tuple[str, list[str]]:
    """CREATED, MATCHING or MISMATCH, with the differences."""
    if not exists(spark, path):
        spark.createDataFrame([], schema).write.parquet(path)
        return "CREATED", []
    have = {f.name: f.dataType.simpleString() for f in spark.read.parquet(path).schema.fields}
    want = {f.name: f.dataType.simpleString() for f in schema.fields}
    diff = [f"{c}: {have.get(c)} -> {want.get(c)}" for c in sorted(have.keys() | want.keys()) if have.get(c) != want.get(c)]
    return ("MISMATCH", diff) if diff else ("MATCHING", [])


def retained(rows: DataFrame, at: str, now_ms: int, days: int) -> DataFrame:
    """Rows young enough to be kept."""
    return rows.where(F.col(at) >= now_ms - days * 86_400_000)
