"""Schemas whose columns are told apart by field id."""

from __future__ import annotations

from pyspark.sql import types as T

ID_KEY = "parquet.field.id"
#: The bookkeeping column's id; ordinary columns stay below, fresh ids come after it.
RESERVED_ID = 100_000


class SchemaError(ValueError):
    """Columns that can't be brought together."""


def struct(fields: list[dict]) -> T.StructType:
    """Fields {id, name, type} as a schema that Spark reads and writes by id."""
    return T.StructType([T.StructField(f["name"], T._parse_datatype_string(f["type"]), True, {ID_KEY: f["id"]}) for f in fields])


def fields_of(schema: T.StructType) -> list[dict]:
    """The fields of a schema that carries ids."""
    out = []
    for f in schema.fields:
        if ID_KEY not in f.metadata:
            raise SchemaError(f"column {f.name} has no field id")
        out.append({"id": int(f.metadata[ID_KEY]), "name": f.name, "type": f.dataType.simpleString()})
    return out


def numbered(schema: T.StructType, first: int = 1) -> T.StructType:
    """``schema`` with ids in column order."""
    return T.StructType([T.StructField(f.name, f.dataType, True, {ID_KEY: first + k}) for k, f in enumerate(schema.fields)])


def reserve(fields: list[dict], source_column: str) -> list[dict]:
    """A new target's fields: the first source's with their ids, and the bookkeeping column."""
    if any(f["name"] == source_column for f in fields):
        raise SchemaError(f"{source_column} is a column of the sources; name the bookkeeping column otherwise")
    if any(f["id"] >= RESERVED_ID for f in fields):
        raise SchemaError(f"field ids from {RESERVED_ID} on are reserved")
    out = [*fields, {"id": RESERVED_ID, "name": source_column, "type": "string"}]
    assert find(out, source_column)["id"] == RESERVED_ID
    return out


def known_ids(fields: list[dict]) -> set[int]:
    return {f["id"] for f in fields}


def find(fields: list[dict], key: int | str) -> dict | None:
    """A field by its id or its name."""
    return next((f for f in fields if f["id" if isinstance(key, int) else "name"] == key), None)


def widen(fields: list[dict], name: str, kind: str, field_id: int | None = None) -> list[dict]:
    """One more nullable column, at a given id or at a fresh one."""
    if find(fields, name):
        raise SchemaError(f"{name} is a column already")
    if field_id is None:
        field_id = max(RESERVED_ID, *(f["id"] for f in fields)) + 1
    if field_id in known_ids(fields):
        raise SchemaError(f"field id {field_id} is taken")
    return [*fields, {"id": field_id, "name": name, "type": kind}]
