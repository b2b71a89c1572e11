import pytest
from pyspark.sql import functions as F

from freshet.config import WindowConfig
from freshet.operators import windows
from freshet.schema import CLICK, PAGE_VIEW, PURCHASE, R1H, R5M, R24H, RESOLUTIONS, online_fields
from freshet.streaming.stateful import UserWindows, Watermark

MINUTE = 60_000
BASE = 1_700_000_040_000 // 86_400_000 * 86_400_000


def frame(spark, rows):
    return spark.createDataFrame(rows, "event_id string, event_type string, user_id string, session_id string, event_us bigint, product_id string, price_cents bigint, quantity int, currency string")


def event(at_ms, kind=CLICK, product="sku-1", cents=1000, n=1, id="e", user="u1"):
    return (id, kind, user, "s", at_ms * 1000, product, cents, n, "USD")


def test_pane_and_window_ends(spark):
    row = frame(spark, [event(130_000)]).select(windows.pane_index(60).alias("p"), windows.window_ends(R5M).alias("e")).first()
    assert (row["p"], row["e"]) == (2, [180, 240, 300, 360, 420])


def test_times_before_1970_floor(spark):
    assert frame(spark, [event(-1)]).select(windows.pane_index(60).alias("p")).first()["p"] == -1


def test_a_click_a_minute(spark):
    got = windows.sliding(frame(spark, [event(BASE + i * MINUTE) for i in range(5)]), R5M).where(f"window_start_ms = {BASE}").first()
    assert (got["click_count"], got["window_end_ms"], got["distinct_products"]) == (5, BASE + 5 * MINUTE, None)


def test_no_record_after_the_last_window(spark):
    assert windows.sliding(frame(spark, [event(BASE)]), R5M).where(f"window_end_ms = {BASE + 6 * MINUTE}").count() == 0


def test_revenue_counts_pieces(spark):
    rows = [event(BASE, PURCHASE, cents=1000, n=2), event(BASE + 1, PURCHASE, cents=500, n=3)]
    got = windows.sliding(frame(spark, rows), R5M).first()
    assert (got["revenue"], got["purchase_count"]) == (35.0, 2)


def test_distinct_products_and_average(spark):
    rows = [event(BASE + i, PURCHASE, p, c) for i, (p, c) in enumerate((("A", 1000), ("B", 3000), ("A", 2000)))]
    got = windows.sliding(frame(spark, rows), R24H).first()
    assert (got["distinct_products"], got["avg_purchase_amount"], got["click_count"]) == (2, 20.0, None)


def test_views_only_give_zeros_and_no_average(spark):
    got = windows.sliding(frame(spark, [event(BASE, PAGE_VIEW)]), R24H).first()
    assert (got["purchase_count"], got["revenue"], got["distinct_products"], got["avg_purchase_amount"]) == (0, 0.0, 0, None)


def test_shared_panes_equal_single_ones(spark):
    rows = [event(BASE + i * 977_777, (CLICK, PURCHASE, PAGE_VIEW, "SIGNUP")[i % 4], f"p{i % 3}", i, 1, str(i), f"u{i % 5}") for i in range(60)]
    e = frame(spark, rows)
    both = windows.sliding_all(e)
    for r in RESOLUTIONS:
        one, other = windows.sliding(e, r), both.where(f"window_resolution = '{r.value}'")
        assert one.exceptAll(other).count() == other.exceptAll(one).count() == 0


def test_thirteen_online_fields():
    assert [f for f, *_ in online_fields()] == ["clicks_5m", "page_views_5m", "purchases_5m", "revenue_5m", "clicks_1h", "page_views_1h", "purchases_1h", "revenue_1h", "distinct_products_1h", "purchases_24h", "revenue_24h", "distinct_products_24h", "avg_purchase_amount_24h"]


def fold(own, at, mark, n=1):
    return [own.fold(at, CLICK, 0, None, mark) for _ in range(n)]


def five(records):
    return [(r["click_count"], r["emission_seq"]) for r in records if r["window_resolution"] == "5m"]


def test_windows_fire_once_each():
    own = UserWindows()
    fold(own, BASE, None)
    ends = [r["window_end_ms"] for r in own.fire(BASE + 5 * MINUTE) if r["window_resolution"] == "5m"]
    assert ends == [BASE + i * MINUTE for i in range(1, 6)]
    assert five(own.fire(BASE + 5 * MINUTE)) == []


def test_a_late_event_fires_the_window_again():
    own = UserWindows()
    fold(own, BASE + 1000, None, 3)
    assert five(own.fire(BASE + MINUTE)) == [(3, 0)]
    assert fold(own, BASE + 59_000, BASE + MINUTE + 20_000) == [True]
    assert five(own.fire(BASE + MINUTE + 20_000)) == [(4, 1)]


def test_very_late_events_change_nothing():
    own = UserWindows()
    assert fold(own, 400_000, 595_000) == [False] and own.empty()
    assert fold(own, 565_000, 595_000) == [True]


def test_state_survives_and_is_dropped():
    own = UserWindows()
    fold(own, BASE, None)
    own.fire(BASE + MINUTE)
    again = UserWindows.load(own.dump(), WindowConfig())
    assert five(again.fire(BASE + 2 * MINUTE)) == [(1, 0)]
    again.fire(BASE + 2 * 86_400_000)
    assert again.empty()


def test_watermark():
    w = Watermark()
    assert w.current(0) is None
    assert w.observe(10_000, 0) == 5_000 and w.observe(9_000, 0) == 5_000
    w.observe(10_000, 940_000)
    assert w.current(1_000_000) == 995_000


@pytest.mark.parametrize("bad", [{"lateness": 300}, {"sink": "validated-events"}, {"workers": 13}])
def test_settings_are_checked(bad):
    with pytest.raises(ValueError):
        WindowConfig(**bad)


def test_late_split_of_a_known_sequence(spark):
    rows = [(i, 0, s * 1_000_000) for i, s in enumerate((0, 600, 590, 400, 565, 2000))]
    got = windows.late_split(spark.createDataFrame(rows, "arrival int, process int, event_us bigint")).orderBy("arrival").collect()
    assert [r["is_late"] for r in got] == [False, False, False, True, False, False]


def test_empty_events(spark):
    assert windows.sliding_all(frame(spark, [])).count() == 0
    assert R1H.panes == 12


def test_features_of_ones_own(spark):
    rows = [(str(i), "PURCHASE" if i % 2 else "CLICK", "u", "s", t * 1_000_000, f"p{i % 3}", 100 + i, 2, "USD") for i, t in enumerate([0, 10, 70, 200, 4000])]
    df = spark.createDataFrame(rows, "event_id string, event_type string, user_id string, session_id string, event_us bigint, product_id string, price_cents bigint, quantity int, currency string")
    more = [windows.Feature("dearest", lambda: F.when(F.col("event_type") == "PURCHASE", F.col("price_cents")), "max", ("1h",)), windows.Feature("pieces", lambda: F.col("quantity"))]
    out = windows.sliding_all(df, more)
    got = {(r["window_resolution"], r["window_end_ms"] // 1000): (r["dearest"], r["pieces"], r["click_count"]) for r in out.collect()}
    assert got["1h", 300] == (103, 8, 2) and got["1h", 4200] == (None, 2, 1) and got["5m", 60] == (None, 4, 1) and got["24h", 7200][1] == 10
    assert windows.sliding_all(df).exceptAll(out.drop("dearest", "pieces")).count() == 0
    for bad in (("x", "avg"), ("revenue", "sum")):
        with pytest.raises(ValueError):
            windows.Feature(bad[0], lambda: F.lit(1), bad[1])
