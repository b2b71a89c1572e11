"""Avro's binary encoding in Arrow stages: messages to and from columns, by reader and writer schema.

Schemas are Avro's JSON as Python objects (see functions.evolution). A schema is compiled once per
task into functions that write or read one value; a reader schema that differs from the
writer's is resolved while compiling (added and dropped fields, defaults, widened numbers, unions).

In columns a record is a struct. A union with null is the nullable other type; a union of several
records is a struct with one member per record, of which one is set, named like the record in
snake case without a trailing ``_payload``.

Messages may be framed as registries do: a zero byte, the schema's id in four bytes, the value.
"""

from __future__ import annotations

import datetime
import json
import struct
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..functions.scalars import snake_case

PLAIN = {"null": T.NullType(), "boolean": T.BooleanType(), "int": T.IntegerType(), "long": T.LongType(), "float": T.FloatType(), "double": T.DoubleType(), "string": T.StringType(), "bytes": T.BinaryType()}
WIDER = {"int": ("long", "float", "double"), "long": ("float", "double"), "float": ("double",), "string": ("bytes",), "bytes": ("string",)}
EPOCH = datetime.datetime(1970, 1, 1, tzinfo=datetime.timezone.utc)


class AvroError(ValueError):
    """A value or message that doesn't fit its schema."""


def kind_of(schema: Any) -> str:
    return "union" if isinstance(schema, list) else schema["type"] if isinstance(schema, dict) and isinstance(schema["type"], str) else schema if isinstance(schema, str) else kind_of(schema["type"])


def name_of(schema: Any, space: str = "") -> str:
    name = schema["name"]
    space = schema.get("namespace", space)
    return name if "." in name or not space else f"{space}.{name}"


def member(schema: Any) -> str:
    """The name of a record's member in the struct that stands for a union."""
    return snake_case(name_of(schema).rpartition(".")[2]).removesuffix("_payload")


def resolved(schema: Any, known: dict[str, Any] | None = None, space: str = "") -> Any:
    """The schema with the names of types that came before replaced by those types."""
    known = {} if known is None else known
    if isinstance(schema, list):
        return [resolved(s, known, space) for s in schema]
    if isinstance(schema, str):
        if schema in PLAIN:
            return schema
        full = schema if "." in schema or not space else f"{space}.{schema}"
        if full not in known:
            raise AvroError(f"unknown type {schema}")
        return known[full]
    kind = schema["type"]
    if kind in ("record", "enum", "fixed"):
        full = name_of(schema, space)
        own = dict(schema) | {"name": full.rpartition(".")[2], "namespace": full.rpartition(".")[0]}
        known[full] = own
        if kind == "record":
            own["fields"] = [f | {"type": resolved(f["type"], known, own["namespace"])} for f in schema["fields"]]
        return own
    if kind == "array":
        return schema | {"items": resolved(schema["items"], known, space)}
    if kind == "map":
        return schema | {"values": resolved(schema["values"], known, space)}
    if isinstance(kind, (dict, list)):
        return resolved(kind, known, space)
    return schema if schema.get("logicalType") else kind


def spark_type(schema: Any) -> T.DataType:
    """The column type of values of a (resolved) schema."""
    kind = kind_of(schema)
    if kind == "union":
        own = [s for s in schema if kind_of(s) != "null"]
        if len(own) == 1:
            return spark_type(own[0])
        if any(kind_of(s) != "record" for s in own):
            raise AvroError("a union of several types must be one of records")
        return T.StructType([T.StructField(member(s), spark_type(s)) for s in own])
    if kind == "record":
        return T.StructType([T.StructField(f["name"], spark_type(f["type"])) for f in schema["fields"]])
    if kind == "array":
        return T.ArrayType(spark_type(schema["items"]))
    if kind == "map":
        return T.MapType(T.StringType(), spark_type(schema["values"]))
    if kind == "enum":
        return T.StringType()
    if kind == "fixed":
        return T.BinaryType()
    logical = schema.get("logicalType", "") if isinstance(schema, dict) else ""
    if kind == "long" and logical.startswith("timestamp-"):
        return T.TimestampType()
    return PLAIN[kind]


def arrow_type(kind: T.DataType) -> pa.DataType:
    if isinstance(kind, T.StructType):
        return pa.struct([pa.field(f.name, arrow_type(f.dataType)) for f in kind.fields])
    if isinstance(kind, T.ArrayType):
        return pa.list_(arrow_type(kind.elementType))
    if isinstance(kind, T.MapType):
        return pa.map_(pa.string(), arrow_type(kind.valueType))
    plain = {"boolean": pa.bool_(), "int": pa.int32(), "bigint": pa.int64(), "float": pa.float32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(), "timestamp": pa.timestamp("us", "UTC"), "void": pa.null()}
    return plain[kind.simpleString()]


# -- writing -------------------------------------------------------------------------------------


def zigzag(n: int) -> bytes:
    n, out = (n << 1) ^ (n >> 63), bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _ticks(schema: Any) -> int:
    """Microseconds in a unit of a time stamp."""
    return 1000 if schema["logicalType"].endswith("millis") else 1


def writer(schema: Any) -> Callable[[Any], bytes]:
    """A function that gives a value's bytes."""
    kind = kind_of(schema)
    if kind == "union":
        each = [(i, s, writer(s)) for i, s in enumerate(schema)]
        nulls = [i for i, s, _ in each if kind_of(s) == "null"]
        others = [x for x in each if kind_of(x[1]) != "null"]

        def put_union(v: Any) -> bytes:
            if v is None and nulls:
                return zigzag(nulls[0])
            if len(others) == 1:
                return zigzag(others[0][0]) + others[0][2](v)
            for i, s, put in others:
                own = (v or {}).get(member(s))
                if own is not None:
                    return zigzag(i) + put(own)
            raise AvroError("no member of the union is set")

        return put_union
    if kind == "record":
        fields = [(f["name"], writer(f["type"])) for f in schema["fields"]]
        return lambda v: b"".join(put(_of(v, name)) for name, put in fields)
    if kind == "array":
        item = writer(schema["items"])
        return lambda v: (zigzag(len(v)) + b"".join(map(item, v)) if v else b"") + b"\0"
    if kind == "map":
        text, item = writer("string"), writer(schema["values"])
        return lambda v: (zigzag(len(v)) + b"".join(text(k) + item(x) for k, x in dict(v).items()) if v else b"") + b"\0"
    if kind == "enum":
        places = {s: zigzag(i) for i, s in enumerate(schema["symbols"])}

        def put_enum(v: Any) -> bytes:
            if v not in places:
                raise AvroError(f"{v!r} is none of {schema['symbols']}")
            return places[v]

        return put_enum
    if kind == "fixed":
        return lambda v: v if len(v) == schema["size"] else _bad(v, schema)
    if isinstance(schema, dict) and schema.get("logicalType", "").startswith("timestamp-"):
        ticks = _ticks(schema)
        return lambda v: zigzag((v if isinstance(v, int) else (v.astimezone(datetime.timezone.utc) - EPOCH) // datetime.timedelta(microseconds=1)) // ticks)
    if kind in ("int", "long"):
        most = 31 if kind == "int" else 63
        return lambda v: zigzag(int(v)) if -(1 << most) <= int(v) < 1 << most else _bad(v, schema)
    if kind in ("string", "bytes"):

        def put_bytes(v: Any) -> bytes:
            raw = v.encode() if isinstance(v, str) else bytes(v) if isinstance(v, (bytes, bytearray)) else _bad(v, schema)
            return zigzag(len(raw)) + raw

        return put_bytes
    return {"null": lambda v: b"", "boolean": lambda v: b"\1" if v else b"\0", "float": struct.Struct("<f").pack, "double": struct.Struct("<d").pack}[kind]


def _of(v: Any, name: str) -> Any:
    if not isinstance(v, dict):
        raise AvroError(f"no record: {v!r}")
    return v.get(name)


def _bad(v: Any, schema: Any):
    raise AvroError(f"{v!r} doesn't fit {schema}")


# -- reading -------------------------------------------------------------------------------------


class Bytes:
    """A message that is read from its start on."""

    def __init__(self, raw: bytes):
        self.raw, self.at = raw, 0

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.raw):
            raise AvroError("the message ends too soon")
        self.at += n
        return self.raw[self.at - n : self.at]

    def long(self) -> int:
        value = shift = 0
        while True:
            byte = self.take(1)[0]
            value |= (byte & 127) << shift
            if byte < 128:
                return (value >> 1) ^ -(value & 1)
            shift += 7
            if shift > 63:
                raise AvroError("a number of too many bytes")

    def blocks(self) -> Iterator[int]:
        """Items of arrays and maps; a negative count is followed by the block's size in bytes."""
        while n := self.long():
            if n < 0:
                n = -n
                self.long()
            yield from range(n)


def reader(write: Any, read: Any) -> Callable[[Bytes], Any]:
    """A function that reads a value of the writer's schema as one of the reader's."""
    kinds = kind_of(write), kind_of(read)
    if kinds[0] == "union":
        each = []
        for s in write:
            try:
                each.append(reader(s, read))
            except AvroError as problem:  # only a message that has this member is one that can't be read
                each.append(lambda _, problem=problem: _raise(problem))

        def get_union(raw: Bytes) -> Any:
            i = raw.long()
            if not 0 <= i < len(each):
                raise AvroError(f"no member {i} of the union")
            return each[i](raw)

        return get_union
    if kinds[1] == "union":
        own = [s for s in read if kind_of(s) != "null"]
        if kinds[0] == "null" and len(own) < len(read):
            return lambda raw: None
        named = [s for s in own if kinds[0] == kind_of(s) == "record" and member(s) == member(write)]
        for s in named or own:
            try:
                get = reader(write, s)
            except AvroError:
                continue
            if len(own) == 1:
                return get
            return lambda raw, get=get, name=member(s): {name: get(raw)}
        raise AvroError(f"no member of the reader's union takes {kinds[0]}")
    if kinds[0] == kinds[1] == "record":
        return _record_reader(write, read)
    if kinds[0] == kinds[1] == "array":
        item = reader(write["items"], read["items"])
        return lambda raw: [item(raw) for _ in raw.blocks()]
    if kinds[0] == kinds[1] == "map":
        item = reader(write["values"], read["values"])
        return lambda raw: {raw.take(raw.long()).decode(): item(raw) for _ in raw.blocks()}
    if kinds[0] == kinds[1] == "enum":
        return _enum_reader(write["symbols"], read)
    if kinds[0] == kinds[1] == "fixed" and write["size"] == read["size"]:
        return lambda raw: raw.take(write["size"])
    if kinds[0] != kinds[1] and kinds[1] not in WIDER.get(kinds[0], ()):
        raise AvroError(f"{kinds[0]} can't be read as {kinds[1]}")
    get = {
        "null": lambda raw: None, "boolean": lambda raw: raw.take(1) != b"\0", "int": Bytes.long, "long": Bytes.long,
        "float": lambda raw: struct.unpack("<f", raw.take(4))[0], "double": lambda raw: struct.unpack("<d", raw.take(8))[0],
        "string": lambda raw: raw.take(raw.long()), "bytes": lambda raw: raw.take(raw.long()),
    }[kinds[0]]
    if kinds[1] == "string":
        return lambda raw: get(raw).decode()
    if kinds[1] in ("float", "double"):
        return lambda raw: float(get(raw))
    if isinstance(spark_type(read), T.TimestampType):
        ticks = _ticks(read)
        return lambda raw: EPOCH + datetime.timedelta(microseconds=get(raw) * ticks)
    return get


def _raise(problem: Exception):
    raise problem


def _enum_reader(symbols: Sequence[str], read: Any) -> Callable[[Bytes], str]:
    known, default = set(read["symbols"]), read.get("default")

    def get(raw: Bytes) -> str:
        i = raw.long()
        if not 0 <= i < len(symbols):
            raise AvroError(f"no symbol {i}")
        if symbols[i] not in known and default is None:
            raise AvroError(f"{symbols[i]!r} is none of the reader's symbols")
        return symbols[i] if symbols[i] in known else default

    return get


def _record_reader(write: Any, read: Any) -> Callable[[Bytes], dict]:
    wanted = {x: f for f in read["fields"] for x in (f["name"], *f.get("aliases", ()))}
    steps = []
    for f in write["fields"]:
        target = wanted.get(f["name"])
        steps.append((target and target["name"], reader(f["type"], target["type"] if target else f["type"])))
    filled = {name for name, _ in steps}
    rest = {}
    for f in read["fields"]:
        if f["name"] not in filled:
            if "default" not in f:
                raise AvroError(f"the writer has no {f['name']}, and it has no default")
            rest[f["name"]] = f["default"]

    def get(raw: Bytes) -> dict:
        out = dict(rest)
        for name, step in steps:
            value = step(raw)
            if name is not None:
                out[name] = value
        return out

    return get


def decode(raw: bytes, write: Any, read: Any | None = None) -> Any:
    """One message's value; bytes left over are an error."""
    source = Bytes(raw)
    w = resolved(write)
    out = reader(w, resolved(read) if read is not None else w)(source)
    if source.at != len(raw):
        raise AvroError("bytes are left over")
    return out


# -- columns -------------------------------------------------------------------------------------


def framed(raw: bytes, schema_id: int | None) -> bytes:
    return raw if schema_id is None else b"\0" + struct.pack(">I", schema_id) + raw


def to_avro(rows: DataFrame, schema: Any, schema_id: int | None = None, value: str = "value", keep: Sequence[str] = ()) -> DataFrame:
    """The columns of keep, and each row as Avro. Fields are looked up by name; a row that doesn't
    fit the schema is an error, columns that the schema lacks are left out."""
    own = resolved(schema)
    wanted = [f["name"] for f in own["fields"]]
    inputs = rows.select(*keep, *(rows[c] for c in wanted if c in rows.columns and c not in keep))
    out = T.StructType([*(inputs.schema[c] for c in keep), T.StructField(value, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        put = writer(own)
        for batch in batches:
            values = [framed(put(r), schema_id) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(values, pa.binary())], names=out.names)

    return inputs.mapInArrow(run, out)


def from_avro(rows: DataFrame, read: Any, writers: dict[int | None, Any] | None = None, value: str = "value", record: str = "record", error: str = "decode_error") -> DataFrame:
    """Adds record (a struct; null if the message can't be read) and decode_error (null if it can).

    writers: the schemas of messages by the id in their frame; without, or under the key None,
    messages have no frame and are written by the schema given there, or the reader's own.
    decode_error: SCHEMA_MISMATCH if the bytes aren't of the writer's schema, the id is unknown or
    the reader's schema can't take them; DESERIALIZE_FAILURE for anything else, such as an unknown
    symbol. A null value is a SCHEMA_MISMATCH.
    """
    own = resolved(read)
    schemas = {k: resolved(s) for k, s in (writers or {None: read}).items()}
    kind = spark_type(own)
    out = T.StructType([*rows.schema.fields, T.StructField(record, kind), T.StructField(error, T.StringType())])
    at = rows.columns.index(value)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gets: dict[int | None, Callable[[Bytes], Any]] = {}

        def one(raw: bytes | None) -> tuple[Any, str | None]:
            try:
                if raw is None:
                    raise AvroError("no value")
                source, of = Bytes(raw), None
                if None not in schemas:
                    if source.take(1) != b"\0":
                        raise AvroError("no frame")
                    of = struct.unpack(">I", source.take(4))[0]
                if of not in schemas:
                    raise AvroError(f"unknown schema {of}")
                if of not in gets:
                    gets[of] = reader(schemas[of], own)
                found = gets[of](source)
                if source.at != len(raw):
                    raise AvroError("bytes are left over")
                return found, None
            except AvroError as problem:
                return None, "DESERIALIZE_FAILURE" if "symbol" in str(problem) else "SCHEMA_MISMATCH"
            except Exception:  # noqa: BLE001 - any other message that can't be decoded is a dead letter too
                return None, "DESERIALIZE_FAILURE"

        arrow = arrow_type(kind)
        for batch in batches:
            found = [one(raw) for raw in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([f for f, _ in found], arrow), pa.array([e for _, e in found], pa.string())], names=out.names)

    return rows.mapInArrow(run, out)


def parse(text: str) -> Any:
    return resolved(json.loads(text))


