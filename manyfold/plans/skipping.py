"""Which files may hold rows that a filter wants, by the bounds in the manifest."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .schema import SchemaError, find

#: Types whose bounds compare as their values do. Bounds of floating-point columns leave NaN out,
#: which counts as larger than any number, so they tell nothing about what is larger.
WHOLE = ("tinyint", "smallint", "int", "bigint", "date", "timestamp", "timestamp_ntz", "string", "decimal")
FLOATING = ("float", "double")
_ROWS = {"=": lambda c, v: c == v, "<": lambda c, v: c < v, "<=": lambda c, v: c <= v, ">": lambda c, v: c > v, ">=": lambda c, v: c >= v}

Condition = tuple[str, str, object]


def matches(conditions: list[Condition]) -> Column:
    """The rows' filter: all conditions (column, operator, value)."""
    out = F.lit(True)
    for name, op, value in conditions:
        if op not in _ROWS:
            raise ValueError(f"{op} is none of {', '.join(_ROWS)}")
        out = out & _ROWS[op](F.col("`" + name.replace("`", "``") + "`"), F.lit(value))
    return out


def may_match(fields: list[dict], conditions: list[Condition]) -> Column:
    """Over a manifest's rows: whether a file may hold a row that all conditions accept. A file is
    left out only if a bound or a count says so: it lacks the column, holds nulls alone, or its
    values end before those that are wanted. A file without bounds stays."""
    out = F.lit(True)
    for name, op, value in conditions:
        if not (field := find(fields, name)):
            raise SchemaError(f"no column {name}")
        kind = field["type"].split("(")[0]
        # the id under which the file itself has the column
        mapped = F.filter(F.map_entries(F.coalesce("field_map", F.create_map().cast("map<int,int>"))), lambda e: e["value"] == F.lit(field["id"]))
        own = F.when(F.size(mapped) > 0, F.get(mapped, F.lit(0))["key"]).otherwise(F.lit(field["id"]))
        stats = F.filter("column_stats", lambda s: s["field_id"] == own)
        only = F.get(stats, F.lit(0))
        here = (F.size(stats) > 0) & (only["nested"] | (only["null_count"] < F.col("record_count")))
        low, high = only["lower"].try_cast(field["type"]), only["upper"].try_cast(field["type"])
        wanted = F.lit(value).cast(field["type"])
        fits = F.lit(True)
        if kind in WHOLE or kind in FLOATING and op != ">" and op != ">=":
            if op in ("=", "<", "<="):
                fits = fits & F.coalesce((low < wanted) if op == "<" else (low <= wanted), F.lit(True))
            if op in ("=", ">", ">="):
                fits = fits & F.coalesce((high > wanted) if op == ">" else (high >= wanted), F.lit(True))
        # an entry without columns tells nothing
        out = out & ((F.size("column_stats") == 0) | (here & fits))
    return out
