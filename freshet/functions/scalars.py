"""Scalar functions: times, keys, coercions, checks."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

USER_ID = re.compile(r"[\w\-.:]{1,128}")


def epoch_ms(us: Column) -> Column:
    """Milliseconds of microseconds, floored."""
    return F.floor(us / 1000).cast("bigint")


def idempotency_key(user: Column, resolution: Column, end_ms: Column, seq: Column) -> Column:
    return F.concat_ws(":", user, resolution, end_ms, seq)


def dlq_key(topic: Column, partition: Column, offset: Column) -> Column:
    return F.concat_ws(":", topic, partition, offset)


def is_currency(code: Column) -> Column:
    return F.coalesce(code, F.lit("")).rlike("^[A-Z]{3}$")


def canonical_uuid(text: Column) -> Column:
    """Lower-case with dashes; null if it is none."""
    plain = F.regexp_replace(F.lower(text), "-", "")
    return F.when(plain.rlike("^[0-9a-f]{32}$"), F.regexp_replace(plain, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"))


def tagged_value(kind: Column, *members: tuple[str, Column]) -> Column:
    """The member of a union that the tag names, as JSON."""
    out = None
    for name, member in members:
        out = F.when(kind == name, F.to_json(member)) if out is None else out.when(kind == name, F.to_json(member))
    return out


def float_text(x: Column) -> Column:
    """A double as text: plain from 0.0001 to under 1e16, else with an exponent of two digits at
    least (1e-05, 1.5e+16). The digits are the JVM's; some releases don't give the fewest that tell
    a value far from 1 (1.2499999999999999e+22)."""
    s = x.cast("string")
    e = F.try_to_number(F.regexp_extract(s, "E(-?[0-9]+)$", 1), F.lit("S999")).cast("int")
    sign, lead = F.when(s.startswith("-"), "-").otherwise(""), F.regexp_extract(s, r"^-?([0-9])\.([0-9]+)E", 1)
    rest = F.regexp_replace(F.regexp_extract(s, r"^-?([0-9])\.([0-9]+)E", 2), "^0$", "")
    whole = F.concat(lead, F.rpad(F.substring(rest, F.lit(1), e), e, "0"))
    after = F.when(F.length(rest) > e, F.substring(rest, e + 1, F.lit(400))).otherwise("0")
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -e - 1), lead, rest)
    power = F.concat(F.when(e < 0, "-").otherwise("+"), F.lpad(F.abs(e).cast("string"), F.greatest(F.lit(2), F.length(F.abs(e).cast("string"))), "0"))
    far = F.concat(lead, F.when(rest != "", F.concat(F.lit("."), rest)).otherwise(""), F.lit("e"), power)
    return F.when(~s.contains("E"), s).when((e >= 0) & (e < 16), F.concat(sign, whole, F.lit("."), after)).when((e < 0) & (e >= -4), F.concat(sign, small)).otherwise(F.concat(sign, far))


def json_text(*columns: str) -> Column:
    """Columns as one JSON object with sorted keys, ``", "`` and ``": "`` between; nulls are there."""
    value = lambda c: F.coalesce(F.regexp_extract(F.to_json(F.array(c)), r"(?s)^\[(.*)\]$", 1), F.lit("null"))
    own = [F.concat(F.lit(f'"{c}": '), value(c)) for c in sorted(columns)]
    return F.concat(F.lit("{"), F.concat_ws(", ", *own), F.lit("}"))


def valid_user_id(text: str) -> bool:
    """As a path segment of the read interface."""
    return USER_ID.fullmatch(text) is not None


def snake_case(name: str) -> str:
    return re.sub(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", "_", name).lower()
