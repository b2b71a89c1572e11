"""The events table as a stream that arrives in batches, some events late, through the state operator.

Event times are hurried a hundredfold (a month becomes some seven hours), and an event arrives up to
six minutes after its time, by its id; what arrives within two hours is a batch. So some events come after
windows of theirs have fired, within the lateness or beyond it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import WindowConfig
from ..schema import EVENTS_SQL, FEATURES, RESOLUTIONS, events_from_table
from ..sources.folders import shared_folder
from . import append, stateful

#: 2024-01-01, from which times are hurried; seconds of arrivals a batch; the settings.
BASE_US, HURRY, BATCH_S = 1_704_067_200_000_000, 100, 7200
CONFIG = WindowConfig(lateness=240)
#: Events that users are dealt by to a part and to a partition of the state, on average over all batches: few enough for one's windows to
#: be arrays in Python, and for a partition's rows to be sorted in a task, however much the input.
EVENTS_A_PART, EVENTS_A_PARTITION = 15_000, 500_000


def arrivals(spark: SparkSession, sf_dir: str, tasks: int | None = None) -> DataFrame:
    """Events with hurried times and the number of their batch; tasks: see events_from_table."""
    events = events_from_table(spark, sf_dir, tasks).withColumn("event_us", F.expr(f"{BASE_US} + (event_us - {BASE_US}) div {HURRY}"))
    delay = F.pmod(F.col("event_id").cast("bigint"), F.lit(7)) * 60_000_000
    return events.withColumn("batch", F.floor((F.col("event_us") + delay - BASE_US) / (BATCH_S * 1_000_000)).cast("int"))


def run(
    spark: SparkSession, batches: DataFrame, numbers, folder: str, config: WindowConfig = CONFIG, operator=stateful.refiring, partitions: int | None = None, **start
) -> DataFrame:
    """What the state operator emits, with the number of the batch: each of numbers is added to the
    source's folder and a query started on one checkpoint, which ends when there is nothing left to do. (A query that runs
    while files are added may take some of a batch's before the others, and those are late then.)"""
    own = stateful.state_session(spark, partitions)
    for n in numbers:
        some = batches.where(F.col("batch") == n).drop("batch")
        some.write.mode("append").parquet(f"{folder}/in")
        rows = operator(append.read_events(own, f"{folder}/in", some.schema), config, **start)

        def write(batch: DataFrame, i: int, n: int = n) -> None:
            batch.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{folder}/out/run={n}/part={i}")

        rows.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(*(f"{folder}/out/run={n}/part=*" for n in numbers))


def _dealing(spark: SparkSession, events: DataFrame) -> dict[str, int]:
    """Parts and partitions for so many events."""
    rows, least = events.count(), int(spark.conf.get("spark.sql.shuffle.partitions"))
    partitions = max(least, -(-rows // EVENTS_A_PARTITION))
    return {"partitions": partitions, "parts": max(2 * partitions, -(-rows // EVENTS_A_PART))}


def _numbers(batches: DataFrame) -> list[int]:
    low, high = batches.agg(F.min("batch"), F.max("batch")).first()
    return [0] if low is None else list(range(low, high + 1))


def _shown(emitted: DataFrame) -> DataFrame:
    late = F.get_json_object("late_event", "$.event_id")
    return emitted.select("batch", "kind", "user_id", "window_resolution", "window_start_ms", "window_end_ms", F.col("emission_seq").cast("int").alias("emission_seq"), *FEATURES, late.alias("late_event_id"))


def refired_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All records, repeats and very late events of a stream over the whole table."""
    batches = arrivals(spark, sf_dir)
    dealt = arrivals(spark, sf_dir, spark.sparkContext.defaultParallelism)
    return _shown(run(spark, dealt, _numbers(batches), shared_folder(spark, "refired"), **_dealing(spark, batches)))


def warm_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from the third batch on, by a query that starts there with seeded state."""
    batches = arrivals(spark, sf_dir)
    numbers = _numbers(batches)
    numbers = numbers[2:] or [numbers[-1] + 1]
    last = batches.where(F.col("batch") < numbers[0]).agg(F.max(F.expr("event_us div 1000"))).first()[0]
    mark = None if last is None else last - int(CONFIG.skew * 1000)
    warm = None if mark is None else stateful.warm_panes(in_time(batches, numbers[0]), mark, CONFIG)
    dealt = arrivals(spark, sf_dir, spark.sparkContext.defaultParallelism)
    return _shown(run(spark, dealt, numbers, shared_folder(spark, "warm"), warm=warm, least_mark_ms=mark, **_dealing(spark, batches)))


def paned_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All closed windows of a stream over the whole table in order of time, ten days a batch, by way of panes."""
    by_days = lambda events: events.withColumn("batch", F.floor(F.col("event_us") / 864_000_000_000).cast("int"))
    batches, dealt = by_days(events_from_table(spark, sf_dir)), by_days(events_from_table(spark, sf_dir, spark.sparkContext.defaultParallelism))
    return run(spark, dealt, _numbers(batches), shared_folder(spark, "paned"), operator=stateful.of_panes, **_dealing(spark, batches)).drop("batch")


def in_time(batches: DataFrame, before: int) -> DataFrame:
    """The events of batches before that one that weren't very late in theirs."""
    skew, lateness = int(CONFIG.skew * 1000), int(CONFIG.lateness * 1000)
    most = batches.groupBy("batch").agg(F.max(F.expr("event_us div 1000")).alias("most")).where(F.col("batch") < before).collect()  # a row a batch
    marks = [(n, max(r["most"] for r in most if r["batch"] < n) - skew) for n in sorted(r["batch"] for r in most)[1:]]
    limit = F.lit(None).cast("bigint")
    for n, mark in marks:
        limit = F.when(F.col("batch") == n, F.lit(mark - lateness)).otherwise(limit)
    return batches.where(F.col("batch") < before).where(F.expr("event_us div 1000") >= F.coalesce(limit, F.lit(0)))


def _sql(where: str) -> str:
    published = lambda f: ", ".join(f"'{r.value}'" for r in RESOLUTIONS if f in r.features)
    value = {f: f for f in FEATURES} | {"revenue": "cents / 100.0", "avg_purchase_amount": "CASE WHEN purchase_count > 0 THEN cents / 100.0 / purchase_count END"}
    columns = ", ".join(f"CASE WHEN res IN ({published(f)}) THEN CAST({value[f]} AS {k}) END AS {f}" for f, k in FEATURES.items())
    none = ", ".join(f"NULL AS {f}" for f in FEATURES)
    grid = " UNION ALL ".join(f"SELECT '{r.value}' AS res, {r.size * 1000} AS size, {r.slide * 1000} AS slide, unnest(generate_series(1, {r.panes})) AS k" for r in RESOLUTIONS)
    skew, lateness = int(CONFIG.skew * 1000), int(CONFIG.lateness * 1000)
    return f"""
WITH {EVENTS_SQL},
h AS (SELECT * REPLACE ({BASE_US} + (event_us - {BASE_US}) // {HURRY} AS event_us) FROM ev),
a AS MATERIALIZED (SELECT *, event_us // 1000 AS ms, CAST(floor((event_us + (CAST(event_id AS BIGINT) % 7) * 60000000 - {BASE_US}) / {BATCH_S * 1_000_000}) AS INTEGER) AS batch FROM h),
m AS MATERIALIZED (SELECT batch, lag(top) OVER (ORDER BY batch) AS mark, top AS following FROM
  (SELECT batch, max(max(ms)) OVER (ORDER BY batch) - {skew} AS top FROM a GROUP BY batch)),
t AS MATERIALIZED (SELECT a.*, mark, mark IS NOT NULL AND ms < mark - {lateness} AS late FROM a JOIN m USING (batch)),
g AS ({grid}),
w AS MATERIALIZED (SELECT user_id, res, size, (ms // slide + k) * slide AS end_ms, batch, mark, event_type, product_id,
  CASE WHEN event_type = 'PURCHASE' THEN price_cents * quantity ELSE 0 END AS cents FROM t, g WHERE NOT late),
c AS (SELECT user_id, res, size, end_ms, batch AS own FROM w GROUP BY ALL),
f AS (SELECT c.user_id, c.res, c.size, c.end_ms, m.batch, bool_or(c.own = m.batch) AS fresh, any_value(mark) AS mark, any_value(following) AS following
  FROM c JOIN m ON m.batch >= c.own GROUP BY ALL),
e AS (SELECT *, row_number() OVER (PARTITION BY user_id, res, end_ms ORDER BY batch) - 1 AS seq FROM f
  WHERE (fresh AND mark IS NOT NULL AND end_ms <= mark) OR (end_ms <= following AND (mark IS NULL OR end_ms > mark))),
v AS (SELECT e.batch, e.user_id, e.res, e.size, e.end_ms, e.seq, count(*) FILTER (event_type = 'CLICK') AS click_count, count(*) FILTER (event_type = 'PAGE_VIEW') AS page_view_count,
  count(*) FILTER (event_type = 'PURCHASE') AS purchase_count, sum(cents) AS cents, count(DISTINCT product_id) FILTER (event_type = 'PURCHASE') AS distinct_products
  FROM e JOIN w ON w.user_id = e.user_id AND w.res = e.res AND w.end_ms = e.end_ms AND w.batch <= e.batch GROUP BY e.batch, e.user_id, e.res, e.size, e.end_ms, e.seq)
SELECT batch, 'feature' AS kind, user_id, res AS window_resolution, CAST(end_ms - size AS BIGINT) AS window_start_ms, CAST(end_ms AS BIGINT) AS window_end_ms,
  CAST(seq AS INTEGER) AS emission_seq, {columns}, NULL AS late_event_id FROM v{where}
UNION ALL SELECT batch, 'late', user_id, NULL, NULL, NULL, NULL, {none}, event_id FROM t WHERE late{where.replace(" WHERE", " AND")}
"""


REFIRED_SQL = _sql("")
WARM_SQL = _sql(" WHERE batch >= 2 + (SELECT min(batch) FROM m)")
