import pytest
from pyspark.sql import functions as F

from freshet.config import KafkaConfig
from freshet.functions import evolution, scalars
from freshet.operators import metrics, offline, online
from freshet.plans import jobs, reports, sizing
from freshet.schema import FEATURES, events_from_table, online_fields
from freshet.sources import events, sinks
from freshet.streaming import append, stateful

REC = "user_id string, window_resolution string, window_end_ms bigint, emission_seq int, " + ", ".join(f"{f} {k}" for f, k in FEATURES.items())
V1 = {"type": "record", "name": "E", "namespace": "x", "fields": [{"name": "quantity", "type": "int"}, {"name": "referrer", "type": ["null", "string"], "default": None}]}


def test_nulls_never_overwrite_and_the_last_window_wins(spark):
    rows = [("u", "24h", 1000, 0, None, None, 2, 10.0, 1, 5.0), ("u", "24h", 2000, 0, None, None, 0, 0.0, 0, None), ("u", "5m", 900, 0, 3, 1, 0, 0.0, None, None)]
    got = online.vector(spark.createDataFrame(rows, REC)).first()
    assert (got["purchases_24h"], got["avg_purchase_amount_24h"], got["clicks_5m"], got["clicks_1h"]) == (0, 5.0, 3, None)
    assert got["expires_at_ms"] == 2000 + 129_600_000


def test_upsert_and_lookup(spark, tmp_path):
    one = spark.createDataFrame([("u", "5m", 1000, 0, 3, 1, 0, 0.0, None, None)], REC)
    two = spark.createDataFrame([("u", "1h", 2000, 0, 9, 1, 0, 0.0, 4, None), ("v", "5m", 1, 0, 1, 0, 0, 0.0, None, None)], REC)
    table = sinks.OnlineTable(spark, str(tmp_path / "online"))
    table.upsert(one, 0)
    table.upsert(two, 1)
    got = jobs.user_features(table.read(), "u")
    assert got["key_present"] and (got["features"]["clicks_5m"], got["features"]["clicks_1h"], got["features"]["distinct_products_1h"]) == (3, 9, 4)
    none = jobs.user_features(table.read(), "nobody")
    assert not none["key_present"] and set(none["features"].values()) == {0} and len(none["features"]) == 13
    with pytest.raises(ValueError):
        jobs.user_features(table.read(), "a b")


def test_text_round_trip(spark):
    one = online.vector(spark.createDataFrame([("u", "5m", 1000, 0, 3, 1, 0, 2.5, None, None)], REC))
    back = online.from_strings(online.as_strings(one)).first()
    assert (back["clicks_5m"], back["revenue_5m"], back["clicks_1h"]) == (3, 2.5, None)
    garbage = spark.createDataFrame([("u", "clicks_5m", "x")], "user_id string, field string, value string")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        online.from_strings(garbage).collect()


def test_offline_batches_are_idempotent(spark, tmp_path):
    table = sinks.OfflineTable(spark, str(tmp_path / "raw"))
    one = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 3, "z")], "event_id string, arrival int, v string")
    for _ in range(2):
        table.append(one, 0)
    table.append(spark.createDataFrame([("b", 4, "late"), ("c", 5, "w")], one.schema), 1)
    assert sorted((r["event_id"], r["v"]) for r in table.read().collect()) == [("a", "x"), ("b", "z"), ("c", "w")]
    assert tuple(offline.insert_counts(one, one.where("event_id = 'b'")).first()) == (1, 2)


def test_percentiles_skew_and_ramp(spark):
    p = metrics.percentiles(spark.range(1, 11).withColumn("ms", F.col("id").cast("double")), "ms").first()
    assert tuple(p) == (5.5, 9.55, 9.91)
    assert tuple(metrics.percentiles(spark.range(0).withColumn("ms", F.col("id").cast("double")), "ms").first()) == (0.0, 0.0, 0.0)
    assert metrics.partition_skew(spark.createDataFrame([(4,), (0,)], "n int")).first()["skew"] == 2.0
    assert metrics.partition_skew(spark.createDataFrame([], "n int")).first()["passes"]
    ramp = lambda xs: metrics.lag_ramp(spark.createDataFrame(list(enumerate(xs)), "seq int, lag bigint")).first()["ramped"]
    assert ramp([0, 10, 20, 30]) and not ramp([30, 20, 10]) and not ramp([1, 2]) and not ramp([0, 0, 0])


def test_batch_buckets(spark):
    df = spark.createDataFrame([(1,), (2,), (10_000,), (99_999,)], "s int")
    assert [r[0] for r in df.select(metrics.batch_bucket(F.col("s"))).collect()] == [1, 10, 10_000, 10_000]


def test_total_lag_skips_unknown_positions(spark):
    assert metrics.total_lag(spark.createDataFrame([(10, 4), (5, -1), (5, None), (3, 9)], "high bigint, position bigint")).first()["lag"] == 6


def test_as_of_takes_the_last_before(spark):
    left = spark.createDataFrame([(1, "u", 5), (2, "u", 10), (3, "v", 9)], "id int, user_id string, at bigint")
    right = spark.createDataFrame([("u", 5, 1), ("u", 9, 2), ("u", 11, 3)], "user_id string, t bigint, x int")
    got = offline.as_of(left, right, "user_id", "at", "t", ["x"])
    assert sorted((r["id"], r["x"]) for r in got.collect()) == [(1, 1), (2, 2), (3, None)]


def test_evolution(spark):
    wide = evolution.promote(V1, "E", "quantity", "long")
    more = evolution.add_optional(V1, "E", "device", "string")
    less = evolution.remove(V1, "E", "referrer")
    assert evolution.can_read(spark, wide, V1) and not evolution.can_read(spark, V1, wide)
    assert evolution.can_read(spark, more, V1) and evolution.can_read(spark, V1, more) and evolution.can_read(spark, V1, less)
    for bad in (lambda: evolution.promote(V1, "E", "quantity", "string"), lambda: evolution.remove(V1, "E", "quantity"), lambda: evolution.add_optional(V1, "E", "quantity", "int"), lambda: evolution.remove(V1, "F", "x")):
        with pytest.raises(evolution.SchemaError):
            bad()
    registry = evolution.Registry(spark)
    assert registry.register("s-value", V1) == 1 and registry.register("s-value", V1) == 1 and registry.register("s-value", wide) == 2
    with pytest.raises(evolution.SchemaError):
        registry.register("s-value", V1 | {"fields": [{"name": "other", "type": "int"}]})
    old, new = spark.createDataFrame([(1,)], "q int"), spark.createDataFrame([(2, "x")], "q bigint, device string")
    assert sorted(map(tuple, evolution.read_together(old, new).collect())) == [(1, None), (2, "x")]


def test_scalars(spark):
    assert scalars.snake_case("EcommerceEvent") == "ecommerce_event" and scalars.snake_case("HTTPServer") == "http_server"
    assert scalars.valid_user_id("a.b-c:1") and not scalars.valid_user_id("") and not scalars.valid_user_id("x" * 129)
    ids = spark.createDataFrame([("A" * 32,), ("nope",)], "s string")
    assert [r[0] for r in ids.select(scalars.canonical_uuid(F.col("s"))).collect()] == ["aaaaaaaa-aaaa-aaaa-aaaa-aaaaaaaaaaaa", None]


def test_sizing():
    assert sizing.processes(12, cpus=16) == 12 and sizing.processes(12, per_process=2, cpus=16) == 6 and sizing.cpu_budget(on_host=True, cpus=16) == 8
    with pytest.raises(ValueError):
        sizing.processes(4, requested=5, cpus=16)
    bucket = sizing.TokenBucket(100, burst=10)
    assert bucket.wait(10, 0) == 0 and bucket.wait(10, 0) == pytest.approx(0.1) and sizing.TokenBucket(None).wait(1, 0) == 0
    with pytest.raises(ValueError):
        bucket.wait(11, 0)
    assert sizing.transactional_id("g", 2) == "g-2"


def test_kafka_options():
    assert KafkaConfig().sink_options("t", exactly_once=True)["kafka.acks"] == "all"
    assert KafkaConfig(max_per_trigger=500).source_options("t")["maxOffsetsPerTrigger"] == "500"


def test_synthetic_events_repeat_and_decode(spark):
    one, two = (events.synthetic(spark, 500, 1_700_000_000_000_000, partitions=2) for _ in range(2))
    assert one.exceptAll(two).count() == 0 and one.count() == 500
    assert one.where("quantity not between 1 and 4 or price_cents not between 50 and 500000").count() == 0
    sent = events.nested(one).select(F.to_json(F.struct("*")).alias("value")).union(spark.createDataFrame([("{",), ('{"event_id":"x","event_type":"CLICK"}',)], "value string"))
    got = events.decode_json(sent)
    assert {r[0]: r[1] for r in got.groupBy("decode_error").count().collect()} == {None: 500, "SCHEMA_MISMATCH": 1, "DESERIALIZE_FAILURE": 1}


def test_tables_are_checked(spark, tmp_path):
    path = str(tmp_path / "t")
    schema = spark.createDataFrame([], "a int").schema
    assert sinks.ensure_table(spark, path, schema)[0] == "CREATED" and sinks.ensure_table(spark, path, schema)[0] == "MATCHING"
    assert sinks.ensure_table(spark, path, spark.createDataFrame([], "a string").schema) == ("MISMATCH", ["a: int -> string"])


def test_streaming_paths(spark, tmp_path):
    flat = events_from_table(spark, "/root/testdata/sf0.001").where("user_id < 'u-000004'")
    src = str(tmp_path / "in")
    flat.coalesce(1).write.parquet(src)
    stream = append.read_events(spark, src, flat.schema)
    from freshet.operators.windows import sliding
    from freshet.schema import R5M

    query = append.sliding(stream, R5M).writeStream.format("memory").queryName("five").outputMode("append").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    query.awaitTermination()
    got, want = spark.table("five"), sliding(flat, R5M)
    assert got.count() > 0 and got.exceptAll(want).count() == 0
    late = stateful.refiring(append.read_events(spark, src, flat.schema))
    out = str(tmp_path / "out")
    append.routed(late, {out: lambda b: b.where("kind = 'feature' and window_resolution = '5m'")}, str(tmp_path / "c2")).awaitTermination()
    fired = spark.read.parquet(out)
    keys = ["user_id", "window_end_ms", "click_count", "purchase_count", "revenue"]
    assert fired.count() > 0 and fired.select(keys).exceptAll(want.select(keys)).count() == 0
    assert {f for f, *_ in online_fields()} <= set(online.vector(want).columns)


def test_reports(spark):
    text = reports.markdown("T", spark.createDataFrame([(1, None)], "a int, b string"))
    assert text.startswith("# T") and "| 1 | None |" in text
    assert "3 more rows are left out" in reports.markdown("T", spark.range(5), most=2)
