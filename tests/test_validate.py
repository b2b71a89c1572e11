import pytest

from freshet.operators import validate
from freshet.plans.jobs import validate_and_route
from freshet.schema import DLQ

NOW = 1_700_000_000_000_000
SCHEMA = "event_id string, event_type string, user_id string, session_id string, event_us bigint, product_id string, price_cents bigint, quantity int, currency string"


def row(**other):
    base = {"event_id": "1", "event_type": "PURCHASE", "user_id": "u", "session_id": "s", "event_us": NOW, "product_id": "p", "price_cents": 100, "quantity": 1, "currency": "USD"}
    return tuple((base | other).values())


CASES = [
    ({}, None, None),
    ({"user_id": ""}, "NULL_REQUIRED_FIELD", "user_id"),
    ({"user_id": None}, "NULL_REQUIRED_FIELD", "user_id"),
    ({"session_id": ""}, "NULL_REQUIRED_FIELD", "session_id"),
    ({"event_type": "SEARCH"}, "UNKNOWN_EVENT_TYPE", "event_type"),
    ({"event_type": None}, "UNKNOWN_EVENT_TYPE", "event_type"),
    ({"user_id": "x" * 257}, "MALFORMED_RECORD", "user_id"),
    ({"user_id": "x" * 256}, None, None),
    ({"user_id": "a\nb"}, "MALFORMED_RECORD", "user_id"),
    ({"price_cents": 0}, "OUT_OF_RANGE", "payload.price_cents"),
    ({"price_cents": 0, "event_type": "CLICK"}, None, None),
    ({"price_cents": 10**9 + 1}, "OUT_OF_RANGE", "payload.price_cents"),
    ({"quantity": 0}, "OUT_OF_RANGE", "payload.quantity"),
    ({"quantity": 10_001}, "OUT_OF_RANGE", "payload.quantity"),
    ({"event_us": NOW + 3_600_000_000}, None, None),
    ({"event_us": NOW + 3_600_000_001}, "OUT_OF_RANGE", "event_timestamp"),
    ({"event_us": NOW - 7 * 86_400_000_000}, None, None),
    ({"event_us": NOW - 7 * 86_400_000_000 - 1}, "OUT_OF_RANGE", "event_timestamp"),
    ({"user_id": "", "price_cents": 0}, "NULL_REQUIRED_FIELD", "user_id"),
]


def test_each_rule_and_the_first_failure_wins(spark):
    df = spark.createDataFrame([row(**c, event_id=str(i)) for i, (c, *_) in enumerate(CASES)], SCHEMA)
    got = {int(r["event_id"]): r["error"] for r in validate.tag(df, validate.default_rules(NOW)).collect()}
    for i, (_, error_class, path) in enumerate(CASES):
        assert (got[i] and (got[i]["error_class"], got[i]["error_field_path"])) == ((error_class, path) if error_class else None), CASES[i]


def test_what_the_model_refuses(spark):
    cases = [({"price_cents": -1}, "price_cents"), ({"quantity": 0}, "quantity"), ({"currency": "usd"}, "currency"), ({}, None)]
    df = spark.createDataFrame([row(**c, event_id=str(i)) for i, (c, _) in enumerate(cases)], SCHEMA)
    got = {int(r["event_id"]): r["error"] and r["error"]["error_field_path"] for r in validate.tag(df, [validate.model_rule()]).collect()}
    assert [got[i] for i in range(len(cases))] == [p for _, p in cases]


def test_the_payload_is_refused_before_the_event(spark):
    df = spark.createDataFrame([row(user_id="", price_cents=-1)], SCHEMA)
    assert validate.tag(df, [validate.model_rule()]).first()["error"]["error_field_path"] == "price_cents"


def test_what_does_not_decode_goes_first(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([row(user_id="")], SCHEMA).withColumn("decode_error", F.lit("SCHEMA_MISMATCH"))
    got = validate.tag(df, validate.wire_rules(NOW)).first()["error"]
    assert (got["error_class"], got["validator_name"], got["error_field_path"]) == ("SCHEMA_MISMATCH", "AvroEventConsumer", None)


def test_an_empty_allowlist_means_all_known(spark):
    df = spark.createDataFrame([row()], SCHEMA)
    assert validate.valid(validate.tag(df, [validate.event_type_allowlist([])])).count() == 1
    assert validate.valid(validate.tag(df, [validate.event_type_allowlist(["CLICK"])])).count() == 0


def test_no_event_is_lost(spark):
    df = spark.createDataFrame([row(**c, event_id=str(i)) for i, (c, *_) in enumerate(CASES)], SCHEMA)
    good, bad = validate_and_route(df, NOW)
    assert good.count() + bad.count() == len(CASES)
    assert [(f.name, f.dataType) for f in bad.schema.fields] == [(f.name, f.dataType) for f in DLQ.fields]


@pytest.mark.parametrize("k", [0])
def test_empty_input(spark, k):
    good, bad = validate_and_route(spark.createDataFrame([], SCHEMA), NOW)
    assert good.count() == bad.count() == k
