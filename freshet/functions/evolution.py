"""Schemas as Avro JSON: loading, canonical form, changes, compatibility."""

from __future__ import annotations

import copy
import json
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: To what a type may be widened.
WIDER = {"int": ("long", "float", "double"), "long": ("float", "double"), "float": ("double",)}


class SchemaError(ValueError):
    pass


def canonical(schema: dict) -> str:
    return json.dumps(schema, sort_keys=True, separators=(",", ":"))


def load_set(folder: str, envelope: str = "ecommerce_event.avsc") -> dict:
    """The envelope of a schema folder with the records it names put in place, each once."""
    files = {p.name: json.loads(p.read_text()) for p in Path(folder).glob("*.avsc")}
    if envelope not in files:
        raise SchemaError(f"{folder} has no {envelope}")
    records = {_full_name(s): s for n, s in files.items() if n != envelope}
    placed: set[str] = set()

    def put(node):
        if isinstance(node, str) and "." in node and node not in placed:
            if node not in records:
                raise SchemaError(f"unknown record {node}")
            placed.add(node)
            return put(records[node])
        if isinstance(node, list):
            return [put(x) for x in node]
        if isinstance(node, dict):
            return {k: put(v) if k in ("type", "fields", "items", "values") else v for k, v in node.items()}
        return node

    return put(files[envelope])


def _full_name(schema: dict) -> str:
    return f"{schema['namespace']}.{schema['name']}" if schema.get("namespace") else schema["name"]


def _record(schema: dict, name: str) -> dict:
    found: list[dict] = []

    def walk(node):
        if isinstance(node, list):
            for x in node:
                walk(x)
        elif isinstance(node, dict):
            if node.get("type") == "record" and name in (node["name"], _full_name(node)):
                found.append(node)
            for k in ("type", "fields", "items", "values"):
                if isinstance(node.get(k), (list, dict)):
                    walk(node[k])

    walk(schema)
    if not found:
        raise SchemaError(f"no record {name}")
    return found[0]


def _refit(schema: dict, record: str, change: Callable[[list[dict]], list[dict]]) -> dict:
    """A copy of the schema in which one record has the fields that change makes of its own."""
    out = copy.deepcopy(schema)
    own = _record(out, record)
    own["fields"] = change(own["fields"])
    return out


def _named(fields: list[dict], record: str, field: str) -> int:
    at = [f["name"] for f in fields]
    if field not in at:
        raise SchemaError(f"{record} has no {field}")
    return at.index(field)


def add_optional(schema: dict, record: str, field: str, kind: str, doc: str = "") -> dict:
    """With one more nullable field, null by default: old and new schema read each other's data."""
    more = {"name": field, "type": ["null", kind], "default": None, **({"doc": doc} if doc else {})}

    def change(fields: list[dict]) -> list[dict]:
        if field in (f["name"] for f in fields):
            raise SchemaError(f"{record} has {field} already")
        return [*fields, more]

    return _refit(schema, record, change)


def remove(schema: dict, record: str, field: str, force: bool = False) -> dict:
    """Without a field. The new schema reads old data; the old one reads new data only if the
    field had a default, so that one without goes by force alone."""

    def change(fields: list[dict]) -> list[dict]:
        at = _named(fields, record, field)
        if not force and "default" not in fields[at]:
            raise SchemaError(f"{record}.{field} has no default")
        return fields[:at] + fields[at + 1 :]

    return _refit(schema, record, change)


def promote(schema: dict, record: str, field: str, to: str) -> dict:
    """With a field's type widened, its nullability kept: the new schema reads old data."""

    def widened(kind):
        if isinstance(kind, list):
            return [k if k == "null" else widened(k) for k in kind]
        if not isinstance(kind, str) or to not in WIDER.get(kind, ()):
            raise SchemaError(f"{kind} can't be widened to {to}")
        return to

    def change(fields: list[dict]) -> list[dict]:
        at = _named(fields, record, field)
        return [*fields[:at], fields[at] | {"type": widened(fields[at]["type"])}, *fields[at + 1 :]]

    return _refit(schema, record, change)


def can_read(spark: SparkSession, reader: dict, writer: dict) -> bool:
    """By the Avro library that comes with Spark."""
    avro = spark._jvm.org.apache.avro
    parse = lambda s: avro.Schema.Parser().parse(json.dumps(s))
    return str(avro.SchemaCompatibility.checkReaderWriterCompatibility(parse(reader), parse(writer)).getType()) == "COMPATIBLE"


class Registry:
    """Schemas by subject, in versions that fit the subject's rule."""

    def __init__(self, spark: SparkSession, rule: str = "BACKWARD"):
        self.spark, self.default, self.rules, self.versions = spark, rule, {}, {}

    def set_rule(self, subject: str, rule: str) -> None:
        if rule not in ("BACKWARD", "FORWARD", "FULL", "NONE"):
            raise SchemaError(rule)
        self.rules[subject] = rule

    def register(self, subject: str, schema: dict) -> int:
        """The schema's version; one that is there already keeps its own."""
        known = self.versions.setdefault(subject, [])
        for i, s in enumerate(known):
            if canonical(s) == canonical(schema):
                return i + 1
        rule = self.rules.get(subject, self.default)
        if known and rule in ("BACKWARD", "FULL") and not can_read(self.spark, schema, known[-1]):
            raise SchemaError(f"{subject}: the new schema can't read the last one's data")
        if known and rule in ("FORWARD", "FULL") and not can_read(self.spark, known[-1], schema):
            raise SchemaError(f"{subject}: the last schema can't read the new one's data")
        known.append(copy.deepcopy(schema))
        return len(known)

    def latest(self, subject: str) -> tuple[int, dict]:
        if not self.versions.get(subject):
            raise SchemaError(f"no subject {subject}")
        return len(self.versions[subject]), self.versions[subject][-1]

    def subjects(self) -> list[str]:
        return sorted(s for s, v in self.versions.items() if v)

    def delete(self, subject: str) -> int:
        return len(self.versions.pop(subject, []))


def read_together(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of two schema versions in one: fields that one lacks are null, types the wider."""
    kinds = dict(new.dtypes)
    widened = old.select(*(old[c].cast(kinds[c]).alias(c) if c in kinds else old[c] for c in old.columns))
    return widened.unionByName(new, allowMissingColumns=True)
