"""Feature records that follow late and corrected events batch by batch.

What is stored are panes (partial aggregates of a minute, by user and product), in a folder a batch and
day, and records. A batch of events is added up to panes, which are stored beside the earlier ones: as
sums of parts they needn't be merged with those. Then only windows that hold a changed pane are kept of those worked out
from the stored panes of the users and days that such windows reach; all other days aren't read. Which these are is a mark
that panes carry through their aggregation, not a table of windows to join with. Panes and
records of a batch exist at once (see commits), and of the records of a window the last one counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import windows
from ..schema import RESOLUTIONS
from .commits import Ledger

DAY_S = 86_400


#: Beside a window's features: whether a pane of it comes from the batch at hand.
CHANGED = windows.Feature("_changed", lambda: F.col("_changed"), "max")


class FeatureTable:
    """Records of all windows over the events of all batches so far."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.panes, self.records = Ledger(spark, f"{path}/panes"), Ledger(spark, f"{path}/records")
        #: Days of panes that the last batch read.
        self.days: list[int] = []

    def fold(self, events: DataFrame, n: int) -> bool:
        """Take in batch n; False if it was taken in before. Batches may come in any order, each once.
        After a failure the batch is to be run again; until then its windows are as they were."""
        slide = min(r.slide for r in RESOLUTIONS)
        day = F.floor(F.col("pane") * slide / DAY_S).cast("int")
        own = windows.product_panes(events.where("event_us is not null")).withColumn("day", day)
        self.panes.commit(n, {"panes": own.hint("rebalance", "day")}, by="day")  # few files a day
        if self.records.committed(n):
            return False
        stored = self.panes.read("panes", attempts=True).withColumn(CHANGED.name, F.col("attempt").startswith(f"{n}-").cast("int")).drop("attempt")
        touched = stored.where(f"{CHANGED.name} = 1").select(F.col("user_id").alias("_user"), F.col("day").alias("_day")).distinct()
        longest = max(r.size for r in RESOLUTIONS) // DAY_S
        changed = [r[0] for r in touched.select("_day").distinct().collect()]  # a row a day
        self.days = sorted({d + k for d in changed for k in range(-longest, longest + 1)})
        read = stored.where(F.col("day").isin(self.days))
        near = touched.select("_user", F.explode(F.sequence(F.col("_day") - longest, F.col("_day") + longest)).alias("_day")).distinct()
        parts = read.join(near, F.col("user_id").eqNullSafe(F.col("_user")) & (F.col("day") == F.col("_day")), "left_semi")
        again = windows.records_of(parts.drop("day"), more=[CHANGED], rows=read.count()).where(f"{CHANGED.name} = 1").drop(CHANGED.name)
        return self.records.commit(n, {"records": again.withColumn("version", F.lit(len(self.records.batches())))})

    def read(self) -> DataFrame:
        """The records as of the last batch (of the batches taken in, whatever their numbers)."""
        rows = self.records.read("records", attempts=True).drop("attempt")
        values = [c for c in rows.columns if c not in ("user_id", "window_resolution", "window_end_ms")]
        # column by column: a struct couldn't be aggregated by hash
        return rows.groupBy("user_id", "window_resolution", "window_end_ms").agg(*(F.max_by(c, "version").alias(c) for c in values if c != "version"))
