"""Avro messages, sinks that are restarted, the command line and the read interface."""

import json
import threading
import urllib.error
import urllib.request

import pytest
from pyspark.sql import functions as F

from freshet import __main__ as command
from freshet.config import KafkaConfig, ValidatorConfig, WindowConfig
from freshet.functions import evolution, scalars
from freshet.operators import metrics, offline, online, validate, windows
from freshet.plans import drills, reports, runs, serving, sizing
from freshet.schema import DLQ, DLQ_AVRO, EVENT_AVRO, FEATURE_AVRO, FEATURES, R5M, events_from_table
from freshet.sources import avro, events, sinks
from freshet.streaming import append

SF, NOW = "/root/testdata/sf0.001", 1_700_000_000_000_000
REC = "user_id string, window_resolution string, window_end_ms bigint, emission_seq int, " + ", ".join(f"{f} {k}" for f, k in FEATURES.items())


# -- Avro --

MIXED = {
    "type": "record", "name": "M", "namespace": "x", "fields": [
        {"name": "b", "type": "boolean"}, {"name": "i", "type": "int"}, {"name": "l", "type": "long"}, {"name": "f", "type": "float"}, {"name": "d", "type": "double"}, {"name": "s", "type": "string"}, {"name": "y", "type": "bytes"},
        {"name": "a", "type": {"type": "array", "items": "long"}}, {"name": "m", "type": {"type": "map", "values": "int"}}, {"name": "o", "type": ["null", "string"], "default": None},
        {"name": "e", "type": {"type": "enum", "name": "E", "symbols": ["A", "B"]}}, {"name": "x", "type": {"type": "fixed", "name": "F", "size": 2}}, {"name": "again", "type": "E"},
    ],
}
VALUE = {"b": True, "i": -(2**31), "l": 2**62, "f": 0.5, "d": -1e300, "s": "é𝄞", "y": b"\x00\xff", "a": [0, -1, 64, 2**40], "m": {"k": 7}, "o": None, "e": "B", "x": b"zz", "again": "A"}


def test_every_type_goes_there_and_back():
    raw = avro.writer(avro.resolved(MIXED))(VALUE)
    assert avro.decode(raw, MIXED) == VALUE
    for cut in range(len(raw)):
        with pytest.raises((avro.AvroError, ValueError)):
            avro.decode(raw[:cut], MIXED)
    for bad in ({"i": 2**31}, {"e": "C"}, {"x": b"z"}, {"s": 5}):
        with pytest.raises(avro.AvroError):
            avro.writer(avro.resolved(MIXED))(VALUE | bad)


@pytest.mark.parametrize("n,raw", [(0, b"\x00"), (-1, b"\x01"), (1, b"\x02"), (-64, b"\x7f"), (64, b"\x80\x01"), (-(2**63), b"\xff" * 9 + b"\x01")])
def test_numbers_are_written_as_the_format_says(n, raw):
    assert avro.zigzag(n) == raw and avro.Bytes(raw).long() == n


def test_the_avro_library_reads_what_we_write(spark):
    """By the Avro library that comes with Spark, as text."""
    j = spark._jvm.org.apache.avro
    schema = j.Schema.Parser().parse(json.dumps(MIXED))
    raw = avro.writer(avro.resolved(MIXED))(VALUE)
    got = j.generic.GenericDatumReader(schema).read(None, j.io.DecoderFactory.get().binaryDecoder(bytearray(raw), None))
    assert (got.get("l"), str(got.get("s")), str(got.get("e")), list(got.get("a"))) == (2**62, "é𝄞", "B", VALUE["a"])


def test_readers_of_another_version():
    v1 = evolution.promote(EVENT_AVRO, "PurchasePayload", "quantity", "long")
    v2 = evolution.add_optional(evolution.remove(v1, "PageViewPayload", "referrer"), "EcommerceEvent", "device", "string")
    event = {"event_id": "1", "event_type": "PURCHASE", "user_id": "u", "session_id": "s", "event_timestamp": NOW, "payload": {"purchase": {"product_id": "p", "quantity": 3, "price_cents": 5, "currency": "USD"}}}
    raw = avro.writer(avro.resolved(EVENT_AVRO))(event)
    got = avro.decode(raw, EVENT_AVRO, v2)
    assert got["payload"] == event["payload"] and got["device"] is None
    view = event | {"event_type": "PAGE_VIEW", "payload": {"page_view": {"page_url": "x", "referrer": "y"}}}
    assert avro.decode(avro.writer(avro.resolved(EVENT_AVRO))(view), EVENT_AVRO, v2)["payload"] == {"page_view": {"page_url": "x"}}
    with pytest.raises(avro.AvroError):  # a long can't be read as an int
        avro.decode(avro.writer(avro.resolved(v2))(event | {"device": None}), v2, EVENT_AVRO)


def test_what_does_not_decode_is_told_apart(spark):
    put = avro.writer(avro.resolved(EVENT_AVRO))
    event = {"event_id": "0" * 32, "event_type": "CLICK", "user_id": "u", "session_id": "s", "event_timestamp": NOW, "payload": {"click": {"element_id": "e", "page_url": "p"}}}
    good = put(event)
    search = json.loads(json.dumps(EVENT_AVRO))
    search["fields"][1]["type"]["symbols"].append("SEARCH")
    rows = [avro.framed(good, 1), good, avro.framed(good, 9), avro.framed(good[:-1], 1), avro.framed(good + b"x", 1), None, b"", avro.framed(avro.writer(avro.resolved(search))(event | {"event_type": "SEARCH"}), 2), avro.framed(put(event | {"event_id": "no id"}), 1)]
    df = spark.createDataFrame([(i, bytearray(r) if r is not None else None) for i, r in enumerate(rows)], "n int, value binary")
    got = {r["n"]: r for r in events.decode_avro(df, EVENT_AVRO, {1: EVENT_AVRO, 2: search}).collect()}
    assert [got[i]["decode_error"] for i in range(9)] == [None, *["SCHEMA_MISMATCH"] * 6, "DESERIALIZE_FAILURE", "DESERIALIZE_FAILURE"]
    assert (got[0]["event_us"], got[0]["element_id"], got[0]["product_id"]) == (NOW, "e", None)
    assert events.decode_avro(df.limit(0), EVENT_AVRO).count() == 0


def test_messages_of_all_topics(spark):
    flat = events.sample(spark, NOW)
    sent = sinks.event_messages(flat, EVENT_AVRO, 3)
    back = events.decode_avro(sent, EVENT_AVRO, {3: EVENT_AVRO})
    assert sorted(bytes(r["key"]).decode() for r in sent.collect()) == ["user-1", "user-1", "user-2", "user-2"]
    assert back.where("decode_error is null").count() == 4 and back.where("price_cents = 2000 and quantity = 2").count() == 1
    records = windows.sliding(flat, R5M)
    out = avro.from_avro(sinks.feature_messages(records, FEATURE_AVRO), FEATURE_AVRO).select("key", "record.*").collect()
    assert len(out) == records.count() and {r["window_resolution"] for r in out} == {"W_5M_SLIDE_1M"} and {bytes(r["key"]) for r in out} == {b"user-1:5m", b"user-2:5m"}
    letters = validate.dead_letters(validate.tag(flat, [validate.event_type_allowlist(["CLICK"])]), "t", 5)
    dead = avro.from_avro(sinks.dlq_messages(letters, DLQ_AVRO), DLQ_AVRO).select("key", "record.*").collect()
    assert len(dead) == 3 and bytes(dead[0]["key"]) == b"t:0:0" and dead[0]["error_class"] == "UNKNOWN_EVENT_TYPE"
    assert [f.name for f in DLQ.fields] == [f["name"] for f in DLQ_AVRO["fields"]]
    late = sinks.late_messages(spark.createDataFrame([("u", "{}")], "user_id string, late_event string")).first()
    assert (bytes(late["key"]), bytes(late["value"])) == (b"u", b"{}")


def test_a_topic_holds_each_batch_once(spark, tmp_path):
    topic = sinks.Topic(str(tmp_path / "t"))
    sent = sinks.event_messages(events.sample(spark, NOW), EVENT_AVRO)
    for _ in range(2):
        topic.write(sent, 0)
    assert spark.read.parquet(str(tmp_path / "t")).count() == 4


# -- validation --


def test_payloads_of_clicks_and_views_and_unknown_fields(spark):
    schema = events.FLAT + ", element_id string, page_url string, referrer string, extra_fields array<string>"
    base = ("1", "CLICK", "u", "s", NOW, None, None, None, None, "e", "p", None, [])
    cases = [({}, None), ({9: ""}, "element_id"), ({10: None}, "page_url"), ({1: "PAGE_VIEW", 9: None}, None), ({1: "PAGE_VIEW", 10: ""}, "page_url"), ({12: ["coupon", "x"]}, "coupon"), ({2: "", 10: ""}, "page_url")]
    rows = [tuple(c.get(i, v) if i else str(k) for i, v in enumerate(base)) for k, (c, _) in enumerate(cases)]
    df = spark.createDataFrame(rows, schema)
    got = {int(r["event_id"]): r["error"] and r["error"]["error_field_path"] for r in validate.tag(df, [validate.model_rule(df.columns)]).collect()}
    assert [got[k] for k in range(len(cases))] == [p for _, p in cases]


def test_a_rule_that_raises(spark):
    def judge(fields):
        if fields["quantity"] == 2:
            raise KeyError("boom")
        return ("OUT_OF_RANGE", "payload.quantity", "one") if fields["quantity"] == 1 else None

    df = events.sample(spark, NOW).drop("element_id").withColumn("quantity", F.col("quantity") - 1)
    got = validate.tag(df, [validate.python_rule("Own", judge, ["quantity"], ("PURCHASE",))])
    errors = {r["quantity"]: r["error"] for r in got.where("event_type = 'PURCHASE'").collect()}
    assert errors[1]["error_class"] == "OUT_OF_RANGE" and errors[3] is None and got.where("event_type <> 'PURCHASE' and error is not null").count() == 0
    raised = validate.tag(df.withColumn("quantity", F.lit(2)), [validate.python_rule("Own", judge, ["quantity"])]).first()["error"]
    assert raised["error_class"] == "PIPELINE_INTERNAL_ERROR" and raised["validator_name"] == "Own" and "KeyError" in raised["error_message"] and raised["error_field_path"] is None


def test_values_as_bytes(spark):
    df = spark.createDataFrame([(1, bytearray(b"\x00\xff"), ("z", 1), "té"), (2, None, None, None)], "n int, raw binary, s struct<b:string,a:int>, t string")
    got = {r["n"]: [bytes(r[c]) for c in ("raw", "s", "t")] for r in df.select("n", *(validate.value_bytes(df, c).alias(c) for c in ("raw", "s", "t"))).collect()}
    assert got == {1: [b"\x00\xff", b'{"a": 1, "b": "z"}', "té".encode()], 2: [b""] * 3}


@pytest.mark.parametrize("x", [0.0, 59.98, 1e7, 12345678.9, 1.5e15, 1e16, 3e18, 0.001, 0.0005, 0.0001, 1e-05, 1.5e-07, 1e100, -2.5e9, 123456789.0])
def test_doubles_as_text(spark, x):
    assert spark.range(1).select(scalars.float_text(F.lit(x)).alias("t")).first()["t"] == repr(x)


# -- sinks and tables --


def test_the_online_table_survives_restarts_and_replays(spark, tmp_path):
    path = str(tmp_path / "online")
    rec = lambda u, r, end, clicks: (u, r, end, 0, clicks, 1, 0, 0.0, None, None)
    batch = lambda rows: spark.createDataFrame(rows, REC)
    one, two, three = batch([rec("a", "5m", 1000, 1), rec("b", "5m", 1000, 2)]), batch([rec("b", "5m", 2000, 3), rec("c", "1h", 2000, 4)]), batch([rec("a", "1h", 3000, 5)])
    state = lambda: {r["user_id"]: (r["clicks_5m"], r["clicks_1h"], r["expires_at_ms"]) for r in sinks.OnlineTable(spark, path).read().collect()}
    with pytest.raises(ValueError):
        sinks.OnlineTable(spark, path).read()
    sinks.OnlineTable(spark, path).upsert(one, 0)
    sinks.OnlineTable(spark, path).upsert(two, 1)  # another process
    want = {"a": (1, None, 451_000), "b": (3, None, 452_000), "c": (None, 4, 5_402_000)}
    assert state() == want
    for again, n in ((two, 1), (one, 0)):
        sinks.OnlineTable(spark, path).upsert(again, n)
        assert state() == want
    assert sinks.OnlineTable(spark, path).compact() == 1 and state() == want
    sinks.OnlineTable(spark, path).upsert(one, 0)  # the base holds it
    sinks.OnlineTable(spark, path).upsert(three, 2)
    want["a"] = (1, 5, 5_403_000)
    assert state() == want
    sinks.OnlineTable(spark, path).vacuum()
    assert state() == want
    (tmp_path / "online/delta/v=9").mkdir()  # a batch that didn't end
    assert state() == want


def test_a_stream_is_inserted_once(spark, tmp_path):
    src, table = str(tmp_path / "in"), sinks.OfflineTable(spark, str(tmp_path / "raw"), since=("event_us", 86_400_000_000))
    rows = events.sample(spark, NOW).withColumn("decode_error", F.when(F.col("event_type") == "CLICK", "SCHEMA_MISMATCH"))
    rows.write.parquet(src)
    for _ in range(2):
        sinks.insert_stream(append.read_events(spark, src, rows.schema), table, str(tmp_path / "c")).awaitTermination()
        rows.where("event_type = 'PURCHASE'").write.mode("append").parquet(src)
    assert sorted(r["event_type"] for r in table.read().collect()) == ["PAGE_VIEW", "PURCHASE", "PURCHASE"]


def test_point_in_time_over_slices(spark):
    left = spark.createDataFrame([(i, u, t) for i, (u, t) in enumerate([("u", 5), ("u", 25), ("u", 99), ("v", 50), (None, 5), ("u", None), ("u", 4)])], "id int, user_id string, at bigint")
    right = spark.createDataFrame([("u", 5, 1), ("u", 24, 2), ("u", 26, 3), ("v", 51, 4), (None, 1, 5), ("u", None, 6)], "user_id string, t bigint, x int")
    for width in (10, 1000):
        got = {r["id"]: r["x"] for r in offline.as_of(left, right, "user_id", "at", "t", ["x"], width).collect()}
        assert got == {0: 1, 1: 2, 2: 3, 3: None, 4: None, 5: None, 6: None}


# -- windows --


def test_one_scan_and_two_shuffles(spark):
    """Of events, and of panes; nothing is shuffled once panes are dealt out."""
    out = windows.sliding_all(events_from_table(spark, SF))
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString()
    final = plan.partition("Initial Plan")[0]
    assert final.count("Scan parquet") == 1 and final.count("Exchange ") == 2 and "collect_set" not in final


def test_a_products_last_pane_counts(spark):
    at = [0, 30, 70, 400, 401, 3_700]
    rows = [(str(i), "PURCHASE", "u", "s", t * 1_000_000, p, 100, 1, "USD") for i, (t, p) in enumerate(zip(at, ["a", "a", "b", "a", "c", "b"]))]
    got = {(r["window_resolution"], r["window_end_ms"] // 1000): r["distinct_products"] for r in windows.sliding_all(spark.createDataFrame(rows, events.FLAT)).collect()}
    assert got["1h", 300] == 2 and got["1h", 600] == 3 and got["1h", 3600] == 3 and got["1h", 3900] == 3 and got["1h", 4200] == 1 and got["24h", 86_400] == 3 and got["5m", 300] is None


def test_windows_over_the_edge_of_a_chunk(spark):
    day = 86_400_000_000
    rows = [(str(i), "CLICK", "u", "s", 4 * day - 1_000_000 + i * 2_000_000, None, None, None, "USD") for i in range(2)]
    df = spark.createDataFrame(rows, events.FLAT)
    got = windows.sliding_all(df).groupBy("window_resolution").agg(F.count("*").alias("n"), F.max("click_count").alias("most")).collect()
    assert {r["window_resolution"]: (r["n"], r["most"]) for r in got} == {"5m": (6, 2), "1h": (13, 2), "24h": (25, None)}


# -- metrics, reports, settings --


def test_percentiles_by_narrowing_down(spark):
    values = spark.range(0, 50_000, 1, 7).select(F.when(F.col("id") % 10 == 0, 3.25).otherwise(F.pow(F.col("id") % 997, F.lit(2.5)) / 7).alias("ms"))
    exact = values.agg(F.percentile("ms", F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)))).first()[0]
    ranks = [0, 24_999, 25_000, 47_499, 49_500, 49_999]
    ordered = sorted(r["ms"] for r in values.collect())
    assert metrics.order_statistics(values, "ms", ranks, held=20) == {r: ordered[r] for r in ranks}
    held, metrics.HELD = metrics.HELD, 100
    try:
        assert tuple(metrics.percentiles(values, "ms").first()) == tuple(round(x, 6) for x in exact)
    finally:
        metrics.HELD = held


def test_reservoirs_do_not_depend_on_partitions(spark):
    rows = spark.range(5000).withColumn("g", F.col("id") % 3)
    one, two = (metrics.reservoir(rows.repartition(n), "id", 100, by=["g"]) for n in (1, 7))
    assert one.count() == 300 and one.exceptAll(two).count() == 0
    assert metrics.reservoir(rows, "id", 100).count() == 100 and metrics.reservoir(rows.limit(5), "id", 100).count() == 5


def test_all_reports(spark):
    out = spark.createDataFrame([("acked", None, 5.0), ("failed", "B", -1.0), ("failed", "A", -1.0), ("failed", "B", -1.0)], "status string, error string, latency_ms double")
    text = reports.load_report(out, 2.0, 0.1)
    assert "FAILED" in text and text.index("| B | 2 |") < text.index("| A | 1 |")
    messages = spark.createDataFrame([(None, 5.0), ("SCHEMA_MISMATCH", -1.0)], "decode_error string, latency_ms double")
    assert "FAILED" in reports.consume_report(messages, spark.createDataFrame([(1, 5)], "seq int, lag bigint"), 1.0, 0.1)
    assert "PASSED" in reports.consume_report(messages.limit(0), spark.createDataFrame([], "seq int, lag bigint"), 1.0, 0.0)
    flushes = spark.createDataFrame([(5, 1, 0, 6, 2.0), (0, 0, 3, 3, 9.0)], "inserted int, skipped int, failed int, batch_size int, latency_ms double")
    assert "| 5 | 1 | 3 | 2 |" in reports.sink_report(flushes, spark.createDataFrame([(1, 4), (0, 2)], "partition int, n int"))
    flat = events.sample(spark, NOW)
    assert "RequiredFieldsValidator" in reports.validation_report(validate.tag(flat.withColumn("user_id", F.lit("")), validate.default_rules(NOW)))
    assert "| 5m |" in reports.features_report(windows.sliding(flat, R5M), flat.limit(1))
    assert "widen" in reports.evolution_report(spark.createDataFrame([("widen", "s", "BACKWARD", True)], "change string, subject string, rule string, accepted boolean"))


def test_consumer_counters_and_latency(spark):
    df = spark.createDataFrame([(10, 4), (10, 0), (3, 4)], "got bigint, sent bigint").select(metrics.latency_ms(F.col("got"), F.col("sent")).alias("ms"))
    assert sorted(r["ms"] for r in df.collect()) == [-1.0, -1.0, 6.0]
    none = metrics.consume_counts(spark.createDataFrame([], "decode_error string"), spark.createDataFrame([], "seq int, lag bigint")).first()
    assert tuple(none) == (0, 0, 0, 0, 0)


def test_source_profiles():
    own = KafkaConfig().sliding_source(WindowConfig(), 7_200_000)
    assert own["startingTimestamp"] == "3600000" and own["kafka.isolation.level"] == "read_committed" and own["maxOffsetsPerTrigger"] == "500" and own["startingOffsets"] == "latest"
    assert KafkaConfig().validator_source(ValidatorConfig(batch=7))["maxOffsetsPerTrigger"] == "7"


def test_paced_events_are_events(spark):
    stream = events.paced(spark, 50)
    assert stream.isStreaming and [f.name for f in stream.schema.fields] == [c.split()[0] for c in events.FLAT.split(", ")]


# -- the read interface and the command line --


def test_paths_and_their_answers(spark):
    table = online.vector(spark.createDataFrame([("u", "5m", 1000, 0, 3, 1, 0, 2.5, None, None)], REC))
    api = serving.FeatureApi(lambda: table)
    assert api.respond("/healthz")[0] == api.respond("/readyz")[0] == 200 and api.respond("/nothing")[0] == 404
    status, body, _ = api.respond("/v1/features/users/u")
    assert status == 200 and body["key_present"] and body["features"]["revenue_5m"] == 2.5 and len(body["features"]) == 13
    assert api.respond("/v1/features/users/a b")[0] == api.respond("/v1/features/users/")[0] == 422
    broken = serving.FeatureApi(lambda: 1 / 0)
    assert broken.respond("/v1/features/users/u")[::2] == (503, {"Retry-After": "1"}) and broken.respond("/readyz")[0] == 503 and broken.respond("/healthz")[0] == 200
    web = serving.server(api, 0)
    threading.Thread(target=web.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{web.server_address[1]}"
    assert json.load(urllib.request.urlopen(f"{at}/v1/features/users/u"))["features"]["clicks_5m"] == 3
    with pytest.raises(urllib.error.HTTPError, match="422"):
        urllib.request.urlopen(f"{at}/v1/features/users/%20")
    web.shutdown()


def test_jobs_of_the_command_line(spark, tmp_path):
    at = lambda x: str(tmp_path / x)
    run = lambda *a: command.main(list(a), spark)
    assert run("generate", at("e"), "--events", "300", "--now-us", str(NOW)) == 0
    assert run("validate", at("e"), at("v"), at("d"), "--now-us", str(NOW)) == 0
    assert run("features", at("v"), at("f")) == 0 and run("online", at("f"), at("o"), "--compact") == 0
    for _ in range(2):
        assert run("sink", at("v"), at("raw")) == 0
    read = spark.read.parquet
    assert read(at("v")).count() + read(at("d")).count() == 300 and sinks.OfflineTable(spark, at("raw")).read().count() == read(at("v")).count()
    assert sinks.OnlineTable(spark, at("o")).read().count() == read(at("v")).select("user_id").distinct().count()
    (tmp_path / "a.avsc").write_text(json.dumps(EVENT_AVRO))
    (tmp_path / "b.avsc").write_text(json.dumps(evolution.add_optional(EVENT_AVRO, "EcommerceEvent", "device", "string")))
    (tmp_path / "c.avsc").write_text(json.dumps(EVENT_AVRO | {"fields": [*EVENT_AVRO["fields"], {"name": "must", "type": "int"}]}))
    assert [run("register", at("a.avsc"), at(x)) for x in ("b.avsc", "c.avsc", "no.avsc")] == [0, 1, 2]


# -- runs --


def test_a_paced_load_is_consumed_until_nothing_is_left(spark, tmp_path):
    class Flaky(sinks.Topic):
        tries = 0

        def write(self, messages, n=0):
            self.tries += 1
            if n == 2 or self.tries == 1:  # the first try of all, and one batch for good
                raise OSError("full")
            super().write(messages, n)

    now, slept = [0.0], []
    topic = Flaky(str(tmp_path / "t"))
    out = runs.load(spark, topic, EVENT_AVRO, 100, NOW, sizing.TokenBucket(10, burst=30), batch=30, clock=lambda: now[0], sleep=slept.append)
    assert tuple(runs.merged(out, 2.0).first()) == (70, 30, 35.0) and topic.tries == 1 + 1 + 1 + 3 + 1
    assert slept == [0.0, 3.0, 6.0, 7.0] and {r["error"] for r in out.collect()} == {None, "OSError"}
    spark.createDataFrame([(bytearray(b"k"), bytearray(b"junk"))], "key binary, value binary").write.parquet(str(tmp_path / "t/batch=9"))
    batches, lag = runs.consume(spark, str(tmp_path / "t"), EVENT_AVRO, str(tmp_path / "c"), 1)
    assert tuple(batches.agg(F.sum("consumed"), F.sum("deserialize_failures")).first()) == (70, 1)
    assert lag.orderBy(F.desc("seq")).first()["lag"] == 0 and lag.count() == batches.count() > 1


def test_drills_agree_with_what_decoding_says(spark):
    rows = drills.run(spark).collect()
    said = {r["change"]: (r["reads_old"], r["read_by_old"]) for r in rows}
    assert said == {"add an optional field": (True, True), "remove a field with a default": (True, True), "widen a number": (True, False), "remove a field without a default": (True, False), "add a required field": (False, True)}
    for r in rows:
        want = {"BACKWARD": r["reads_old"], "FORWARD": r["read_by_old"], "FULL": r["reads_old"] and r["read_by_old"], "NONE": True}[r["rule"]]
        assert r["accepted"] == want, r
    assert "| widen a number | events-value | BACKWARD | True |" in reports.evolution_report(drills.run(spark))
