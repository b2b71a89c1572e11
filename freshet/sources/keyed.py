"""Inserts whose cost follows the batch: an append-only table in buckets, with Bloom filters beside it.

A row lies in the bucket of its key's hash, one folder a batch and bucket. For each of them a Bloom filter of
its keys is kept as rows of 4 KB bitmaps (Spark's own bitmap functions), committed together with the
rows. To insert a batch, the bits of its keys are looked up by a join; only folders whose filter
has all bits of one of the keys are read, their keys alone, and an exact anti-join decides. What is read of the
stored rows are thus the files that hold a repeat, and about one in ``2**hashes`` (at most) of the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import offline
from .commits import Ledger

#: Bits of a bitmap; bits a key in a filter that is just full.
SLOT, ROOM = 32_768, 16


class KeyedTable:
    """One row a key, the first that came; a batch that is written again changes nothing. Rows without
    a key are never repeats of each other's batches; of one batch one stays."""

    def __init__(self, spark: SparkSession, path: str, key: str = "event_id", buckets: int = 32, hashes: int = 6):
        if not 1 <= hashes <= 7:
            raise ValueError("one to seven bits a key")
        self.spark, self.key, self.buckets, self.hashes = spark, key, buckets, hashes
        self.ledger = Ledger(spark, path)
        #: Folders of stored rows, and those that the last insert read.
        self.stored = self.opened = 0

    def append(self, batch: DataFrame, n: int, arrival: str = "arrival") -> bool:
        """Insert batch n; False if it was inserted before."""
        if self.ledger.committed(n):
            return False
        rows = offline.first_arrivals(batch, self.key, arrival).withColumn("bucket", self._bucket()).persist()
        try:
            fresh = rows
            held = self._may_hold(rows)
            if held:
                known = self.spark.read.schema(rows.schema).parquet(*held).select(self.key)
                fresh = rows.join(known, self.key, "left_anti").select(rows.columns)
            return self.ledger.commit(n, {"rows": fresh, "filters": self._filters}, by="bucket")
        finally:
            rows.unpersist()

    def read(self) -> DataFrame:
        return self.ledger.read("rows").drop("bucket")

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _at(self, slots: Column) -> Column:
        """The places of a key's bits in a filter of so many slots."""
        one, two = (F.shiftrightunsigned(F.xxhash64(F.lit(i), self.key), 4) for i in (1, 2))  # room for eight times that
        return F.array(*(F.pmod(one + two * i, slots * SLOT) for i in range(self.hashes)))

    def _filters(self, rows: DataFrame) -> DataFrame:
        """A filter of each bucket of written rows: how many slots it has, and the bitmap of each slot
        that isn't empty. The slots are a power of two, by the bucket's keys."""
        sizes = rows.groupBy("bucket").agg(F.count("*").alias("n")).select("bucket", F.expr(f"bigint(pow(2, greatest(0, ceil(log2(n * {ROOM} / {SLOT})))))").alias("slots"))
        places = rows.select("bucket", self.key).join(F.broadcast(sizes), "bucket").select("bucket", "slots", F.explode(self._at(F.col("slots"))).alias("at"))  # at most a row a bucket
        return places.groupBy("bucket", "slots", F.expr(f"at div {SLOT}").alias("slot")).agg(F.bitmap_construct_agg(F.pmod("at", F.lit(SLOT))).alias("bits"))

    def _may_hold(self, rows: DataFrame) -> list[str]:
        """The folders of stored rows that may have one of the keys."""
        self.stored, self.opened = 0, 0
        if not self.ledger.batches():
            return []
        filters = self.ledger.read("filters", attempts=True)
        shapes = filters.select("bucket", "attempt", "slots").distinct()
        self.stored = shapes.count()
        asked = rows.select(self.key, "bucket").join(shapes.select("bucket", "slots").distinct(), "bucket")
        bits = asked.select(self.key, "bucket", "slots", F.explode(self._at(F.col("slots"))).alias("at")).distinct()
        bits = bits.withColumns({"slot": F.expr(f"at div {SLOT}"), "bit": F.pmod("at", F.lit(SLOT))})
        wanted = bits.groupBy(self.key, "bucket", "slots").agg(F.count("*").alias("wanted"))
        byte = F.conv(F.hex(F.substring(F.col("bits"), F.expr("int(bit div 8) + 1"), F.lit(1))), 16, 10).cast("int")
        there = F.expr("shiftleft(1, int(bit % 8))").bitwiseAND(byte) != 0
        met = bits.join(filters, ["bucket", "slots", "slot"]).where(there).groupBy(self.key, "bucket", "slots", "attempt").agg(F.count("*").alias("met"))
        found = met.join(wanted, [self.key, "bucket", "slots"]).where("met = wanted").select("attempt", "bucket").distinct().collect()  # a row a folder to open
        self.opened = len(found)
        return [f"{self.ledger.folder('rows', r['attempt'])}/bucket={r['bucket']}" for r in found]
