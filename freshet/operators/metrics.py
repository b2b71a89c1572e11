"""Run metrics as aggregations: histograms, skew, percentiles, trends and verdicts."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Right edges of the batch-size histogram.
BATCH_EDGES = (1, 10, 50, 100, 250, 500, 1000, 2500, 5000, 10_000)
ELEVATED_RATE = 0.05


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 if b is."""
    return F.when(b > 0, a.cast("double") / b).otherwise(F.lit(0.0))


def histogram(rows: DataFrame, by: str | Column, name: str = "key") -> DataFrame:
    """Rows per key; null keys have no bar."""
    key = F.col(by) if isinstance(by, str) else by
    return rows.where(key.isNotNull()).groupBy(key.alias(name)).agg(F.count("*").alias("n"))


def top(counts: DataFrame, k: int = 10, name: str = "key") -> DataFrame:
    """The k most frequent, ties by name."""
    return counts.orderBy(F.desc("n"), name).limit(k)


def invalid_rate(tagged: DataFrame) -> DataFrame:
    n = tagged.agg(F.count("*").alias("consumed"), F.count("error").alias("invalid"))
    return n.withColumn("rate", ratio(F.col("invalid"), F.col("consumed"))).withColumn("elevated", F.col("rate") > ELEVATED_RATE)


def partition_skew(counts: DataFrame, n: str = "n", limit: float = 2.0) -> DataFrame:
    """Greatest over mean count per partition; passes if 0 or under the limit."""
    skew = ratio(F.max(n), F.avg(n))
    return counts.agg(F.round(F.coalesce(skew, F.lit(0.0)), 6).alias("skew")).withColumn("passes", F.col("skew") < limit)


#: Distinct values up to which one task may hold all of them; bins of a pass beyond that.
HELD, BINS = 1_000_000, 4096


def percentiles(samples: DataFrame, value: str, points=(0.5, 0.95, 0.99)) -> DataFrame:
    """Exact percentiles with linear interpolation, 0 if there is no sample; negative values are
    unsampled ones. NaN counts as unsampled, too.

    The samples are read once: what is kept, on disk, is how often each value occurs. Of up to HELD
    values Spark's own aggregate does the rest, which holds them in a task. Beyond, the values at the
    wanted ranks are narrowed down by histograms of BINS bins, a few passes over the values
    whatever their number.
    """
    own = samples.select(F.col(value).cast("double").alias("v")).where((F.col("v") >= 0) & ~F.isnan("v"))
    names = [f"p{round(x * 100)}" for x in points]
    counts = own.groupBy("v").agg(F.count("*").alias("n")).persist(StorageLevel.DISK_ONLY)
    try:
        n, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
        if distinct <= HELD:
            got = counts.agg(F.percentile("v", F.array(*map(F.lit, points)), F.col("n"))).first()[0] or [0.0] * len(points)
        else:
            at = [x * (n - 1) for x in points]
            ranks = sorted({f(x) for x in at for f in (math.floor, math.ceil)})
            finite = counts.where(F.col("v") < math.inf)
            ends = finite.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]  # infinite values come after all others
            value_at = order_statistics(finite, "v", [r for r in ranks if r < ends], weight="n") | {r: math.inf for r in ranks if r >= ends}
            between = lambda a, b, x: a if a == b else a + (b - a) * x
            got = [between(value_at[math.floor(x)], value_at[math.ceil(x)], x - math.floor(x)) for x in at]
    finally:
        counts.unpersist()
    return samples.sparkSession.range(1).select(*(F.round(F.lit(v), 6).alias(c) for v, c in zip(got, names, strict=True)))


def order_statistics(samples: DataFrame, value: str, ranks: Sequence[int], held: int = 100_000, weight: str | None = None) -> dict[int, float]:
    """The value at each rank (from 0) among finite doubles; weight: how often a row's value counts, else once. Each
    pass counts the values of the bins of the ranges that are left, and keeps the bin that holds the rank; a range of few
    distinct values is then counted value by value."""
    v, times = F.col(value), F.lit(1) if weight is None else F.col(weight)
    low, high = samples.agg(F.min(v), F.max(v)).first()
    open_ = {r: (low, high, 0) for r in ranks}  # rank -> its range, and how many values lie below it
    found: dict[int, float] = {}
    while open_:
        spans = sorted({(a, b) for a, b, _ in open_.values()})
        which = F.array(*(F.struct(F.lit(i).alias("i"), F.least(F.lit(BINS - 1), F.floor((v - a) / (b - a) * BINS) if b > a else F.lit(0)).cast("int").alias("bin"), v.between(a, b).alias("there")) for i, (a, b) in enumerate(spans)))
        bins = samples.select(v.alias("v"), times.alias("times"), F.inline(which)).where("there").groupBy("i", "bin").agg(F.sum("times").alias("n"), F.min("v").alias("a"), F.max("v").alias("b"))
        rows = sorted(map(tuple, bins.collect()))  # at most BINS a range
        for r, (a, b, below) in list(open_.items()):
            for i, _, n, x, y in rows:
                if spans[i] != (a, b):
                    continue
                if r < below + n:
                    if x == y:
                        found[r] = x
                        del open_[r]
                    elif n <= held:
                        values = samples.where(v.between(x, y)).groupBy(v.alias("v")).agg(F.sum(times).alias("n")).orderBy("v").collect()  # at most ``held``
                        for q in values:
                            if r < below + q["n"]:
                                found[r] = q["v"]
                                break
                            below += q["n"]
                        del open_[r]
                    else:
                        open_[r] = (x, y, below)
                    break
                below += n
    return found


def batch_bucket(size: Column) -> Column:
    """The right edge of a batch's bucket; what is beyond the last counts there."""
    edges = F.array(*map(F.lit, BATCH_EDGES))
    return F.get(edges, F.least(F.size(F.filter(edges, lambda e: e < size)), F.lit(len(BATCH_EDGES) - 1)))


def lag_ramp(samples: DataFrame, lag: str = "lag", seq: str = "seq") -> DataFrame:
    """Whether lag climbs: at least 3 samples, a peak, and a least-squares rise over the run of at
    least a tenth of the peak."""
    own = samples.agg(F.count("*").alias("n"), F.max(lag).alias("max_lag"), F.max_by(lag, seq).alias("end_lag"), F.regr_slope(F.col(lag).cast("double"), F.col(seq).cast("double")).alias("slope"))
    rise = F.col("slope") * (F.col("n") - 1)
    ramped = (F.col("n") >= 3) & (F.col("max_lag") > 0) & (F.col("slope") > 0) & (rise >= F.col("max_lag") * 0.1)
    return own.select("n", "max_lag", "end_lag", F.round("slope", 6).alias("slope"), F.coalesce(ramped, F.lit(False)).alias("ramped"))


def delivery(outcomes: DataFrame) -> DataFrame:
    """Counters of a producer: outcomes (status acked / failed / pending)."""
    return outcomes.agg(
        F.count("*").alias("produced"),
        F.count_if(F.col("status") == "acked").alias("acked"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.count_if(F.col("status") == "pending").alias("in_flight"),
    )


def delivery_errors(outcomes: DataFrame) -> DataFrame:
    """Failed deliveries by class of error, the most frequent first."""
    return in_order(histogram(outcomes.where("status = 'failed'"), F.coalesce("error", F.lit("unknown"))))


def in_order(counts: DataFrame, name: str = "key") -> DataFrame:
    """A histogram as reports print it: by falling count, then by key."""
    return counts.orderBy(F.desc("n"), name)


def latency_ms(received_ms: Column, broker_ms: Column) -> Column:
    """End-to-end latency; -1 (unsampled) for a message without a broker's time or from the future."""
    return F.when((broker_ms > 0) & (received_ms >= broker_ms), (received_ms - broker_ms).cast("double")).otherwise(F.lit(-1.0))


def consume_counts(messages: DataFrame, lag: DataFrame) -> DataFrame:
    """Counters of a consumer: messages (decode_error), lag samples (seq, lag); the greatest lag and
    that of the last sample, 0 without samples."""
    counts = messages.agg(F.count("*").alias("polled"), F.count("decode_error").alias("deserialize_failures")).withColumn("consumed", F.col("polled") - F.col("deserialize_failures"))
    ends = lag.agg(F.coalesce(F.max("lag"), F.lit(0)).alias("max_lag"), F.coalesce(F.max_by("lag", "seq"), F.lit(0)).alias("end_lag"))
    return counts.crossJoin(ends)  # one row each


def sink_counts(flushes: DataFrame) -> DataFrame:
    """Counters of a sink: flushes (inserted, skipped, batch_size, latency_ms, and, if there, failed:
    rows of flushes that were given up)."""
    failed = [F.coalesce(F.sum("failed"), F.lit(0)).alias("failed")] if "failed" in flushes.columns else []
    counts = flushes.agg(F.sum("inserted").alias("inserted"), F.sum("skipped").alias("skipped"), *failed, F.count("*").alias("batches"))
    sizes = percentiles(flushes, "batch_size", (0.5, 0.99)).select(F.col("p50").alias("batch_p50"), F.col("p99").alias("batch_p99"))
    times = percentiles(flushes, "latency_ms", (0.5, 0.95)).select(F.col("p50").alias("flush_p50"), F.col("p95").alias("flush_p95"))
    return counts.crossJoin(sizes).crossJoin(times)  # one row each


def merged(parts: DataFrame) -> DataFrame:
    """What several processes report as one: counts add up, wall clocks overlap, lag adds up, a
    ramp in any is a ramp."""
    own = parts.agg(F.sum("consumed").alias("consumed"), F.sum("failed").alias("failed"), F.max("seconds").alias("seconds"), F.sum("lag").alias("lag"), F.bool_or("ramped").alias("ramped"))
    return own.withColumn("rate", F.round(sustained("consumed", "seconds"), 6))


def sustained(n: str, seconds: str) -> Column:
    return F.col(n) / F.greatest(F.col(seconds), F.lit(1e-9))


def load_verdict(rate: Column, failed: Column, floor: float) -> Column:
    return (rate >= floor) & (failed == 0)


def consume_verdict(rate: Column, failed: Column, ramped: Column, floor: float) -> Column:
    return ~ramped & (failed == 0) & (rate >= floor)


def reservoir(samples: DataFrame, key: str, size: int = 4096, seed: int = 42, by: Sequence[str] = ()) -> DataFrame:
    """A uniform sample of fixed size, of each group of ``by`` if given: the rows of the least
    hashes of seed and key. It doesn't depend on how the samples are partitioned, and partial
    samples are cut to size before they are shuffled."""
    order = [F.md5(F.concat_ws(":", F.lit(seed), key)), F.col(key)]
    if not by:
        return samples.orderBy(*order).limit(size)
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return samples.withColumn("_rank", rank).where(F.col("_rank") <= size).drop("_rank")


def merged_percentiles(samples: DataFrame, value: str, key: str, by: str, size: int = 4096) -> DataFrame:
    """Percentiles over the union of the processes' reservoirs: bounded by their number."""
    return percentiles(reservoir(samples.where(F.col(value) >= 0), key, size, by=[by]), value)


def total_lag(partitions: DataFrame) -> DataFrame:
    """Sum of what is left to read per partition (high, position); unknown positions are skipped."""
    return partitions.where("position is not null and position >= 0").agg(F.coalesce(F.sum(F.greatest(F.lit(0), F.col("high") - F.col("position"))), F.lit(0)).alias("lag"))


def running(rows: DataFrame, by: str, order: str) -> DataFrame:
    """emission_seq: how often the key was emitted before."""
    return rows.withColumn("emission_seq", F.row_number().over(Window.partitionBy(by).orderBy(order)) - 1)
