"""Whole jobs: validate and route, features, and their reports."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..config import ValidatorConfig
from ..operators import online, validate, windows
from ..sources.sinks import OnlineTable


def validate_and_route(events: DataFrame, now_us: int, config: ValidatorConfig | None = None, **bounds) -> tuple[DataFrame, DataFrame]:
    """(valid events, dead letters): every event is in one of the two."""
    config = config or ValidatorConfig()
    tagged = validate.tag(events, validate.default_rules(now_us, **bounds))
    return validate.valid(tagged), validate.dead_letters(tagged, config.source, now_us // 1000)


def features(events: DataFrame) -> DataFrame:
    return windows.sliding_all(events)


def online_from(events: DataFrame) -> DataFrame:
    return online.vector(features(events))


def user_features(table: DataFrame | OnlineTable, user_id: str) -> dict:
    """What the read interface answers: all 13 fields, zeros where nothing is stored. Of an OnlineTable
    one file a version is opened; vectors given as a DataFrame are filtered."""
    from ..functions.scalars import valid_user_id

    if not valid_user_id(user_id):
        raise ValueError("not a user id")
    own = table.read_user(user_id) if isinstance(table, OnlineTable) else table.where(table["user_id"] == user_id)
    asked = own.sparkSession.createDataFrame([(user_id,)], "user_id string")
    row = online.lookup(asked, own).first().asDict()
    return {"user_id": row.pop("user_id"), "key_present": row.pop("key_present"), "features": row}
