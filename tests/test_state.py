"""The state operator against plain replays: hot users, silence, warm starts, how much state is kept."""

import time

import pytest
from pyspark.sql import functions as F

from freshet.config import WindowConfig
from freshet.operators import windows
from freshet.schema import EVENT_TYPES, PURCHASE, events_from_table
from freshet.streaming import append, replays, stateful

BASE_US = 1_704_067_200_000_000
CONFIG = WindowConfig(lateness=240)


def stream_rows(spark, n, users=1, seconds=7200):
    """n events of few users, shuffled in time by some minutes, in three batches."""
    at = F.lit(BASE_US) + F.col("id") * int(seconds * 1_000_000 / n)
    kind = F.element_at(F.array(*(F.lit(t) for t in (*EVENT_TYPES, "SIGNUP"))), (F.col("id") % 4 + 1).cast("int"))
    rows = spark.range(n).select(
        F.col("id").cast("string").alias("event_id"), kind.alias("event_type"), F.concat(F.lit("u-"), (F.col("id") % users).cast("string")).alias("user_id"),
        (at - F.pmod(F.xxhash64("id"), F.lit(400)) * 1_000_000).alias("event_us"), F.when(F.col("id") % 11 > 0, F.concat(F.lit("sku-"), (F.col("id") % 13).cast("string"))).alias("product_id"),
        (F.col("id") % 5000).alias("price_cents"), (F.col("id") % 3).cast("int").alias("quantity"), F.floor(F.col("id") * 3 / n).cast("int").alias("batch"),
    )
    return rows


def replayed(rows, config):
    """(batch, user, record) of plain replays, and the ids of very late events."""
    out, late, users, mark, most = [], set(), {}, None, None
    for n in range(3):
        own = sorted((r for r in rows if r["batch"] == n), key=lambda r: r["event_us"])
        for r in own:
            state = users.setdefault(r["user_id"], stateful.UserWindows(config))
            cents = r["price_cents"] * r["quantity"] if r["event_type"] == PURCHASE else 0
            product = r["product_id"]
            if not state.fold(r["event_us"] // 1000, r["event_type"], cents, product, mark):
                late.add(r["event_id"])
        most = max(r["event_us"] for r in own) // 1000 if most is None else max(most, max(r["event_us"] for r in own) // 1000)
        following = most - int(config.skew * 1000)
        for m in (mark, following):
            out += [(n, u, r) for u, state in users.items() for r in state.fire(m)]
        mark = following
    return out, late


@pytest.mark.parametrize(("n", "users"), [(100_000, 1), (3000, 7)])
def test_operator_equals_a_plain_replay(spark, tmp_path, n, users):
    rows = stream_rows(spark, n, users).where("product_id is not null").cache()
    want, late = replayed(rows.collect(), CONFIG)
    got = replays.run(spark, rows, range(3), str(tmp_path), CONFIG).collect()
    assert {r["late_event"].split('"event_id":"')[1].split('"')[0] for r in got if r["kind"] == "late"} == late and late
    names = ["window_resolution", "window_start_ms", "window_end_ms", "emission_seq", "click_count", "page_view_count", "purchase_count", "revenue", "distinct_products", "avg_purchase_amount"]
    mine = sorted(str((r["batch"], r["user_id"], *(r[c] for c in names))) for r in got if r["kind"] == "feature")
    assert mine == sorted(str((b, u, *(r[c] for c in names))) for b, u, r in want)
    assert any(r["emission_seq"] for r in got)


def progress_of(spark, rows, tmp_path, operator):
    own = stateful.state_session(spark, 2)
    rows.drop("batch").write.mode("append").parquet(f"{tmp_path}/in")
    out = operator(append.read_events(own, f"{tmp_path}/in", rows.drop("batch").schema))
    q = out.writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    return q.lastProgress


def test_panes_are_kept_not_windows(spark, tmp_path):
    rows = stream_rows(spark, 4000, users=4, seconds=3 * 86_400)
    progress = progress_of(spark, rows, tmp_path, lambda e: stateful.of_panes(e, CONFIG))
    panes = sum(rows.select("user_id", F.expr(f"event_us div {slide * 1_000_000}")).distinct().count() for slide in (60, 300, 3600))
    kept, made = (op["numRowsTotal"] for op in progress["stateOperators"])
    assert made <= rows.count() and kept + made < panes  # of three days those of the last one at most
    assert kept < 4 * (24 + 12 + 5 + 3 * 6)


def test_nulls_and_an_empty_source(spark, tmp_path):
    rows = stream_rows(spark, 40).withColumn("event_us", F.when(F.col("event_id") == "7", None).otherwise(F.col("event_us")))
    rows = rows.withColumn("user_id", F.when(F.col("event_id") == "8", None).otherwise(F.col("user_id"))).withColumn("price_cents", F.lit(None).cast("bigint"))
    got = replays.run(spark, rows, range(3), str(tmp_path / "a"), CONFIG)
    assert got.where("revenue > 0").count() == 0 and got.where("kind = 'feature' and user_id is null").count() > 0
    assert replays.run(spark, rows.limit(0), [0], str(tmp_path / "b"), CONFIG).count() == 0


def test_a_silent_source_lets_windows_close(spark, tmp_path):
    own = stateful.state_session(spark, 1)
    now = int(time.time() * 1_000_000)
    rows = stream_rows(spark, 20).drop("batch").withColumn("event_us", F.lit(now - 150_000_000) + F.col("event_id").cast("int") * 10_000)
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = stateful.refiring(append.read_events(own, f"{tmp_path}/in", rows.schema), WindowConfig(idle=2, lateness=30), idle=True)
    q = stream.writeStream.format("memory").queryName("silent").option("checkpointLocation", f"{tmp_path}/c").trigger(processingTime="1 second").start()
    try:
        for _ in range(60):
            time.sleep(1)
            ends = [r[0] for r in own.table("silent").where("window_resolution = '5m'").select("window_end_ms").collect()]
            if len(set(ends)) >= 2:
                break
        assert len(set(ends)) >= 2 and max(ends) > now // 1000 - 150_000
        # the user's mark is at the time of day now, and doesn't go back: an event as old as the others is late
        rows.limit(1).write.mode("append").parquet(f"{tmp_path}/in")
        for _ in range(30):
            time.sleep(1)
            if own.table("silent").where("kind = 'late'").count():
                break
        assert own.table("silent").where("kind = 'late'").count() == 1
        assert own.table("silent").where("kind = 'feature' and emission_seq > 0").count() == 0
    finally:
        q.stop()


def test_warm_panes_are_those_still_needed(spark):
    events = events_from_table(spark, "/root/testdata/sf0.001")
    mark = events.agg(F.max("event_us")).first()[0] // 1000
    panes = stateful.warm_panes(events, mark, CONFIG)
    day = panes.where("window_resolution = '24h'")
    assert day.agg(F.min("pane")).first()[0] >= (mark - 86_400_000 - 240_000) // 3_600_000
    whole = windows.panes(events, 3600).where(F.col("pane") >= (mark - 86_400_000 - 240_000) // 3_600_000)
    assert day.select("user_id", "pane", "cents").exceptAll(whole.select("user_id", "pane", "cents")).count() == 0 and day.count() == whole.count()


def test_a_user_costs_few_calls_of_the_state_store(monkeypatch):
    """However many panes a batch brings, as each call is a round trip."""
    import numpy as np
    import pandas as pd

    calls = []

    class Held:
        def __init__(self):
            self.value = None

        def get(self):
            calls.append("get")
            return self.value

        def put(self, value):
            calls.append("put")
            self.value = value

        update = put

        def clear(self):
            calls.append("clear")
            self.value = None

    class Handle:
        def getListState(self, *_):  # noqa: N802
            return Held()

        getValueState = getMapState = getListState  # noqa: N815

        def registerTimer(self, _):  # noqa: N802
            calls.append("timer")

        deleteTimer = registerTimer  # noqa: N815

    class Times:
        def __init__(self, mark):
            self.mark = mark

        def getCurrentWatermarkInMs(self):  # noqa: N802
            return self.mark

        def getCurrentProcessingTimeInMs(self):  # noqa: N802
            return 0

    op = stateful.RefiringWindows(CONFIG)
    op.init(Handle())
    at = BASE_US + np.arange(500) * 600_000_000
    rows = pd.DataFrame({"event_us": at, "type": 2, "cents": 5, "product": [f"p{i % 3}" for i in range(500)], "raw": "x"})
    assert list(op.handleInputRows(("u",), iter([rows]), Times(0))) == []
    got = pd.concat(op.handleExpiredTimer(("u",), Times(int(at[-1]) // 1000 + 90_000_000), None))
    assert len(calls) <= 10 and len(got[got["window_resolution"] == "5m"]) == 5 * 500
    day = got[got["window_resolution"] == "24h"]
    assert day["distinct_products"].max() == 3 and day["purchase_count"].max() == 144 and day["purchase_count"].sum() == 24 * 500


def test_users_of_a_part_share_calls_and_state(spark, tmp_path):
    """What a batch costs follows its rows and the parts, not its users; their records are as for each of them alone."""
    rows = stream_rows(spark, 9000, users=450).where("product_id is not null").cache()
    progress = progress_of(spark, rows, tmp_path, lambda e: stateful.refiring(e, CONFIG, parts=3))
    assert progress["stateOperators"][0]["numRowsTotal"] <= 3 * 4  # a value, and a timer with its indexes
    want, late = replayed(rows.collect(), CONFIG)
    got = replays.run(spark, rows, range(3), str(tmp_path / "b"), CONFIG, partitions=2, parts=3).collect()
    names = ["window_resolution", "window_end_ms", "emission_seq", "purchase_count", "revenue", "distinct_products"]
    mine = sorted(str((r["batch"], r["user_id"], *(r[c] for c in names))) for r in got if r["kind"] == "feature")
    assert mine == sorted(str((b, u, *(r[c] for c in names))) for b, u, r in want)
    assert sorted((r["late_event"].split('"event_id":"')[1].split('"')[0], r["user_id"]) for r in got if r["kind"] == "late") == sorted((x, f"u-{int(x) % 450}") for x in late)
    assert {r["user_id"] for r in got if r["emission_seq"]} and late


def test_windows_of_panes_by_parts(spark, tmp_path):
    rows = stream_rows(spark, 6000, users=300, seconds=6 * 3600).cache()
    progress = progress_of(spark, rows, tmp_path, lambda e: stateful.of_panes(e, CONFIG, parts=3))
    assert progress["stateOperators"][0]["numRowsTotal"] <= 3 * 4
    batches = rows.withColumn("batch", F.floor((F.col("event_us") - BASE_US) / 7_200_000_000).cast("int"))  # in order of time
    got = replays.run(spark, batches, range(-1, 3), str(tmp_path / "b"), CONFIG, operator=stateful.of_panes, partitions=2, parts=3)
    mark = rows.agg(F.max("event_us")).first()[0] // 1000 - int(CONFIG.skew * 1000)
    want = windows.sliding_all(rows).where(F.col("window_end_ms") <= mark)
    names = [c for c in want.columns if c != "avg_purchase_amount"]
    assert got.select(names).exceptAll(want.select(names)).count() == 0 and got.count() == want.count() > 0


def test_a_run_goes_on_from_its_checkpoint(spark, tmp_path):
    rows = stream_rows(spark, 2000, users=20).cache()
    whole = replays.run(spark, rows, range(3), str(tmp_path / "a"), CONFIG, partitions=2, parts=5)
    first = replays.run(spark, rows, [0, 1], str(tmp_path / "b"), CONFIG, partitions=2, parts=5)
    rest = replays.run(spark, rows, [2], str(tmp_path / "b"), CONFIG, partitions=2, parts=5)
    text = lambda *parts: sorted(str(r) for p in parts for r in p.collect())
    assert text(first, rest) == text(whole) and rest.where("emission_seq > 0").count()
