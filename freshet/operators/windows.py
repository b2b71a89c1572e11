"""Sliding windows by shared panes.

Events are dealt out by user, product and pane (one slide long), to more tasks the more events there
are, and aggregated there; a hot user's events are in as many tasks as there are panes. These partial
aggregates are then dealt out by user and *chunk*, a stretch of time that a window's end lies in; each
goes to the one or two chunks that hold windows it counts in. From there on nothing is shuffled any more: all
resolutions, the merge of panes and the windows themselves are worked out where the chunk is, and
no user's history is ever in one task.

Distinct products are counted, not gathered: of a product's panes in a window only the last one
counts, and a pane is the last one in the windows that end before the product's next pane does.

A window ``[end - size, end)`` has a record if any event, of whatever type, lies in it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import CLICK, FEATURES, PAGE_VIEW, PURCHASE, RESOLUTIONS, Resolution

SECOND_US = 1_000_000
#: Seconds of window ends that are worked out together: four times the longest window, so that a
#: pane goes to 1.25 chunks on average.
CHUNK_S = 4 * 86_400
#: Panes that are dealt to a task at most, on average: each becomes as many as 41 windows there, which
#: are far more bytes than what was shuffled.
PANES_A_TASK = 10_000
#: Events that are dealt to a task, on average, to be summed up to panes. Few enough for a task to hold a pane an
#: event twice; up to 200 tasks, the writing side holds none (Spark writes to so few without sorting).
EVENTS_A_TASK = 200_000


def pane_index(slide: int, us: str = "event_us") -> Column:
    """Which pane an event lies in; floors before 1970 too."""
    return F.expr(f"({us} - pmod({us}, {slide * SECOND_US}L)) div {slide * SECOND_US}L")


def window_ends(r: Resolution, us: str = "event_us") -> Column:
    """Ends in seconds of the windows that hold an event, ascending."""
    pane = pane_index(r.slide, us)
    return F.transform(F.sequence(F.lit(1), F.lit(r.panes)), lambda k: (pane + k) * F.lit(r.slide))


def panes(events: DataFrame, slide: int, products: bool = True) -> DataFrame:
    """user_id, pane and its partial aggregate."""
    bought = F.col("event_type") == PURCHASE
    sums = [
        F.count_if(F.col("event_type") == CLICK).alias("click_count"),
        F.count_if(F.col("event_type") == PAGE_VIEW).alias("page_view_count"),
        F.count_if(bought).alias("purchase_count"),
        F.coalesce(F.sum(F.when(bought, F.col("price_cents") * F.col("quantity"))), F.lit(0)).alias("cents"),
    ]
    sets = [F.collect_set(F.when(bought, F.col("product_id"))).alias("products")] if products else []
    return events.groupBy("user_id", pane_index(slide).alias("pane")).agg(*sums, *sets)


def merge_panes(parts: DataFrame, *by: str | Column) -> DataFrame:
    """The merge of partial aggregates: sums, and unions of the product sets."""
    sums = [F.sum(c).alias(c) for c in ("click_count", "page_view_count", "purchase_count", "cents")]
    sets = [F.array_distinct(F.flatten(F.collect_set("products"))).alias("products")] if "products" in parts.columns else []
    return parts.groupBy(*by).agg(*sums, *sets)


@dataclass(frozen=True)
class Accumulator:
    """How values become a feature: ``create`` aggregates a pane's values, ``merge`` aggregates what was
    created or merged (in any order and grouping, which shared panes need), ``result`` reads it."""

    create: Callable[[Column], Column]
    merge: Callable[[Column], Column]
    result: Callable[[Column], Column] = lambda c: c


def _quantile(x: float, size: int = 200) -> Accumulator:
    """By a KLL sketch: the rank is off by 1.33 % of the values at most (99 % sure); of fewer values than ``size`` it is exact."""
    read = lambda c: F.when(F.kll_sketch_get_n_double(c) > 0, F.kll_sketch_get_quantile_double(c, F.lit(x)))
    return Accumulator(lambda v: F.kll_sketch_agg_double(v.cast("double"), size), lambda c: F.kll_merge_agg_double(c, size), read)


#: By name. Null values are left out by all of them. ``distinct`` counts different values by a HyperLogLog
#: sketch of 2**12 registers: off by 1.6 % (one standard error), next to exact below a few hundred.
ACCUMULATORS = {
    "sum": Accumulator(F.sum, F.sum),
    "min": Accumulator(F.min, F.min),
    "max": Accumulator(F.max, F.max),
    "count": Accumulator(F.count, F.sum),
    "distinct": Accumulator(lambda v: F.hll_sketch_agg(v, 12), F.hll_union_agg, F.hll_sketch_estimate),
    "median": _quantile(0.5),
    "p95": _quantile(0.95),
}


def register(name: str, accumulator: Accumulator) -> None:
    """Makes an accumulator of one's own known under a name that isn't taken."""
    if ACCUMULATORS.setdefault(name, accumulator) is not accumulator:
        raise ValueError(f"{name} is taken")


@dataclass(frozen=True)
class Feature:
    """A feature beside those that are built in: an accumulator (by its name) over a value of the
    window's events, null values left out."""

    name: str
    value: Callable[[], Column]
    how: str = "sum"
    resolutions: tuple[str, ...] = tuple(r.value for r in RESOLUTIONS)

    def __post_init__(self):
        if self.how not in ACCUMULATORS or self.name in FEATURES:
            raise ValueError(f"{self.name}: a known accumulator under a name of its own")

    def create(self) -> Column:
        return ACCUMULATORS[self.how].create(self.value()).alias(self.name)

    def merge(self) -> Column:
        return ACCUMULATORS[self.how].merge(F.col(self.name)).alias(self.name)

    def result(self) -> Column:
        return ACCUMULATORS[self.how].result(F.col(self.name))


def _product_panes(events: DataFrame, slide: int, more: Sequence[Feature] = (), rows: int | None = None) -> DataFrame:
    """user_id, pane, product (null for all but purchases) and the sums of their events; rows: how many events
    there are, to deal them out by it, else they are summed up before they are shuffled, too."""
    bought = F.col("event_type") == PURCHASE
    keyed = events.withColumns({"_pane": pane_index(slide), "_product": F.when(bought, F.col("product_id"))})
    if rows is not None:
        keyed = dealt(keyed, rows, EVENTS_A_TASK, "user_id", "_pane", "_product")
    return keyed.groupBy("user_id", F.col("_pane").alias("pane"), F.col("_product").alias("product")).agg(
        F.count_if(F.col("event_type") == CLICK).alias("click_count"),
        F.count_if(F.col("event_type") == PAGE_VIEW).alias("page_view_count"),
        F.count_if(bought).alias("purchase_count"),
        F.coalesce(F.sum(F.when(bought, F.col("price_cents") * F.col("quantity"))), F.lit(0)).alias("cents"),
        *(f.create() for f in more),
    )


_SUMS = ("click_count", "page_view_count", "purchase_count", "cents")


def product_panes(events: DataFrame, more: Sequence[Feature] = ()) -> DataFrame:
    """Panes of the least slide, by product (null for all but purchases): what records are made of.
    Those of parts of the events may be put together in any way, as a pane may have several rows."""
    return _product_panes(events, min(r.slide for r in RESOLUTIONS), more)


def _records(events: DataFrame, resolutions: tuple[Resolution, ...], more: Sequence[Feature] = ()) -> DataFrame:
    rows = events.count()
    return records_of(_product_panes(events, min(r.slide for r in resolutions), more, rows), resolutions, more, rows)


def dealt(rows: DataFrame, n: int, a_task: int, *by: str) -> DataFrame:
    """rows dealt out by columns, so that of n rows a task gets ``a_task`` on average. The number of tasks is said,
    as Spark would join small partitions by their bytes here, not by what they become later."""
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, -(-n // a_task)), *by)


def records_of(parts: DataFrame, resolutions: tuple[Resolution, ...] = RESOLUTIONS, more: Sequence[Feature] = (), rows: int | None = None) -> DataFrame:
    """Feature records out of panes of the resolutions' least slide (see product_panes); rows: how many
    there are at most, else they are counted."""
    slide = min(r.slide for r in resolutions)
    values = (*_SUMS, *(f.name for f in more))
    merges = [*(F.sum(c).alias(c) for c in _SUMS), *(f.merge() for f in more)]
    begin = F.col("pane") * slide
    ends = [(begin - F.pmod(begin, F.lit(r.slide)) + F.lit(r.slide), begin - F.pmod(begin, F.lit(r.slide)) + F.lit(r.size)) for r in resolutions]
    first, last = [e[0] for e in ends], [e[1] for e in ends]
    of = lambda x: F.floor(x / CHUNK_S)
    low, high = (F.least(*first), F.greatest(*last)) if len(ends) > 1 else (first[0], last[0])
    chunks = parts.select("*", F.explode(F.sequence(of(low), of(high))).alias("chunk"))
    own_chunks = dealt(chunks, parts.count() if rows is None else rows, PANES_A_TASK, "user_id", "chunk")
    # panes of each resolution; its number stands for it
    own = F.explode(F.array(*(F.struct(F.lit(i).alias("res"), F.floor(begin / r.slide).alias("own")) for i, r in enumerate(resolutions)))).alias("_own")
    each = own_chunks.select("user_id", "chunk", "product", *values, own).select("user_id", "chunk", "product", *values, "_own.res", "_own.own")
    panes_ = each.groupBy("user_id", "chunk", "res", "own", "product").agg(*merges)
    number = lambda f: F.element_at(F.array(*(F.lit(f(r)) for r in resolutions)), F.col("res") + 1)
    following = F.lead("own").over(Window.partitionBy("user_id", "chunk", "res", "product").orderBy("own"))
    reach = F.when(F.col("product").isNotNull(), F.coalesce(following - F.col("own"), F.lit(2**31))).otherwise(F.lit(0))
    spread = panes_.withColumn("reach", reach).select("user_id", "chunk", "res", "own", "reach", *values, F.explode(F.sequence(F.lit(1), number(lambda r: r.panes))).alias("k"))
    spread = spread.withColumn("end_s", (F.col("own") + F.col("k")) * number(lambda r: r.slide)).where(of(F.col("end_s")) == F.col("chunk"))
    distinct = F.sum(F.when(F.col("reach") >= F.col("k"), F.lit(1)).otherwise(F.lit(0)).cast("bigint")).alias("distinct_products")
    merged = spread.groupBy("user_id", "chunk", "res", "end_s").agg(*merges, distinct)
    revenue = F.col("cents") / F.lit(100.0)
    value = {f: F.col(f) for f in ("click_count", "page_view_count", "purchase_count", "distinct_products")}
    value |= {"revenue": revenue, "avg_purchase_amount": F.when(F.col("purchase_count") > 0, revenue / F.col("purchase_count"))}
    published = lambda f: F.col("res").isin(*(i for i, r in enumerate(resolutions) if f in r.features))
    return merged.select(
        "user_id",
        number(lambda r: r.value).alias("window_resolution"),
        ((F.col("end_s") - number(lambda r: r.size)) * 1000).alias("window_start_ms"),
        (F.col("end_s") * 1000).alias("window_end_ms"),
        *(F.when(published(f), value[f]).cast(kind).alias(f) for f, kind in FEATURES.items()),
        *(F.when(F.col("res").isin(*(i for i, r in enumerate(resolutions) if r.value in f.resolutions)), f.result()).alias(f.name) for f in more),
    )


def sliding(events: DataFrame, r: Resolution, more: Sequence[Feature] = ()) -> DataFrame:
    """Feature records of one resolution; features it doesn't publish are null. more: features
    of one's own, as further columns."""
    return _records(events, (r,), more)


def sliding_all(events: DataFrame, more: Sequence[Feature] = ()) -> DataFrame:
    """All three resolutions by one scan and one shuffle of events, and one shuffle of panes."""
    return _records(events, RESOLUTIONS, more)


def emission_keys(features: DataFrame, seq: Column | None = None) -> DataFrame:
    """Idempotency key, topic key and the resolution's symbol of every record."""
    n = F.lit(0) if seq is None else seq
    symbol = F.create_map(*(F.lit(x) for r in RESOLUTIONS for x in (r.value, r.symbol)))
    return features.select(
        "*",
        n.cast("int").alias("emission_seq"),
        F.concat_ws(":", "user_id", "window_resolution", "window_end_ms", n).alias("idempotency_key"),
        F.concat_ws(":", "user_id", "window_resolution").alias("kafka_key"),
        F.element_at(symbol, F.col("window_resolution")).alias("symbol"),
    )


def fired(features: DataFrame, first_watermark_ms: int, last_watermark_ms: int) -> DataFrame:
    """The records a run emits whose watermark goes from the first to the last: it begins with the
    boundary at or before the first one, and ends with the last window that closed."""
    slide = F.element_at(F.create_map(*(x for r in RESOLUTIONS for x in (F.lit(r.value), F.lit(r.slide * 1000)))), F.col("window_resolution"))
    first = F.lit(first_watermark_ms) - F.pmod(F.lit(first_watermark_ms), slide)
    return features.where((F.col("window_end_ms") >= first) & (F.col("window_end_ms") <= last_watermark_ms))


def late_split(events: DataFrame, order: str = "arrival", by: str = "process", skew_s: float = 5, lateness_s: float = 30, width: int = 10**9) -> DataFrame:
    """Adds watermark_us and is_late in order of arrival per process: the watermark is the
    greatest event time so far, the event's own included, less the skew; an event before it by
    more than the lateness is very late (at exactly that it isn't).

    Arrivals (a whole number) are cut into slices of ``width``; the maxima of a process's slices
    are carried forward, so that what is sorted in one task is a slice, not a process.
    """
    rows = events.withColumn("_slice", F.expr(f"(`{order}` - pmod(`{order}`, {width}L)) div {width}L"))
    slices = rows.groupBy(F.col(by).alias("_by"), "_slice").agg(F.max("event_us").alias("_most"))
    earlier = Window.partitionBy("_by").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = slices.select("_by", F.col("_slice").alias("_of"), F.max("_most").over(earlier).alias("_carried"))
    met = rows.join(carried, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_slice") == F.col("_of")), "left")
    so_far = Window.partitionBy(by, "_slice").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    mark = F.greatest(F.col("_carried"), F.max("event_us").over(so_far)) - F.lit(int(skew_s * SECOND_US))
    timed = met.withColumn("watermark_us", mark).drop("_slice", "_by", "_of", "_carried")
    return timed.withColumn("is_late", F.col("event_us") < F.col("watermark_us") - F.lit(int(lateness_s * SECOND_US)))


def sessions(events: DataFrame, gap_s: int = 1800) -> DataFrame:
    """Session windows: a user's events with gaps under gap_s. Events without time are left out; rows
    without a user are one user.

    Time is cut into stretches as long as the gap. Events of one stretch are in one session, as they are less than
    a gap apart, so they are added up first (with partial aggregation, before anything is shuffled); a user then has a
    row a stretch, however many the events, and stretches are joined where they are less than the gap apart.
    """
    gap = gap_s * SECOND_US
    parts = events.where("event_us is not null").groupBy("user_id", F.expr(f"(event_us - pmod(event_us, {gap}L)) div {gap}L").alias("stretch")).agg(
        F.min("event_us").alias("start_us"),
        F.max("event_us").alias("last_us"),
        F.count("*").alias("events"),
        F.count_if(F.col("event_type") == PURCHASE).alias("purchases"),
    )
    own = Window.partitionBy("user_id").orderBy("stretch")
    fresh = F.coalesce(F.col("start_us") - F.lag("last_us").over(own) >= gap, F.lit(True))
    marked = parts.withColumn("fresh", fresh.cast("int")).withColumn("n", F.sum("fresh").over(own))
    return marked.groupBy("user_id", "n").agg(
        F.min("start_us").alias("start_us"),
        (F.max("last_us") + gap).alias("end_us"),
        F.sum("events").alias("events"),
        F.sum("purchases").alias("purchases"),
    ).drop("n")
