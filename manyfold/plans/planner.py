"""What a registration has to do, as DataFrame queries over file entries.

``now``: the sources' current files. ``held``: the target's manifest. Neither is collected; what
reaches the driver is one row for each column of a source, and sums.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .schema import SchemaError, find, known_ids, widen


def file_columns(now: DataFrame) -> DataFrame:
    """One row for each column of each file that holds a value that isn't null."""
    cols = now.select("source_id", "source_ordinal", "file_path", "modified", "record_count", F.explode("column_stats").alias("c"))
    return cols.select(
        "source_id", "source_ordinal", "file_path", "modified", F.col("c.field_id").alias("field_id"),
        F.col("c.name").alias("name"), F.col("c.kind").alias("kind"), F.col("c.nested").alias("nested"),
        (F.col("c.null_count") < F.col("record_count")).alias("has_data")
    )


def drift(now: DataFrame, known: set[int]) -> DataFrame:
    """(source_id, file_path, field_id, name): columns with data whose id the target doesn't know."""
    spark = now.sparkSession
    ids = spark.createDataFrame([(i,) for i in sorted(known)], "field_id int")
    return file_columns(now).where("has_data").join(F.broadcast(ids), "field_id", "left_anti")


def drift_report(now: DataFrame, known: set[int]) -> DataFrame:
    """(field_id, source_id, name), each once."""
    return drift(now, known).select("field_id", "source_id", "name").distinct()


def source_columns(now: DataFrame) -> DataFrame:
    """Each source's columns with data, with the newest file's name and type for each id. The number
    of rows is sources times columns, whatever the number of files."""
    cols = file_columns(now).where("has_data")
    newest = F.max_by(F.struct("name", "kind"), F.struct("modified", "file_path")).alias("c")
    return cols.groupBy("source_id", "source_ordinal", "field_id").agg(newest, F.max("nested").alias("nested")).select(
        "source_id", "source_ordinal", "field_id", "c.name", "c.kind", "nested"
    )


def new_files(now: DataFrame, held: DataFrame) -> DataFrame:
    """Current files whose path is not registered, neither as they are nor as a rewrite's origin."""
    return now.join(held.select(F.coalesce("rewrite_of", "file_path").alias("file_path"), "source_id"), ["source_id", "file_path"], "left_anti")


def registered_files(now: DataFrame, held: DataFrame) -> DataFrame:
    return now.join(held.select(F.coalesce("rewrite_of", "file_path").alias("file_path"), "source_id"), ["source_id", "file_path"], "left_semi")


def orphans(now: DataFrame, held: DataFrame, sources: list[str]) -> DataFrame:
    """Entries of the listed sources whose file, or whose rewrite's origin, has left its source."""
    mine = held.where(F.col("source_id").isin(sources)).withColumn("origin_path", F.coalesce("rewrite_of", "file_path"))
    current = now.select("source_id", F.col("file_path").alias("origin_path"))
    return mine.join(current, ["source_id", "origin_path"], "left_anti").drop("origin_path")


def status(now: DataFrame, held: DataFrame, sources: list[str], rewrites: DataFrame | None = None) -> DataFrame:
    """Per source: files and rows spliced, already registered, pending rewrite and orphaned; one
    join. ``rewrites`` has the files (source_id, file_path) whose columns collide. A source that is
    registered and no longer listed has a row of zeros: its files stay as they are."""
    key = ["source_id", "file_path"]
    here = now.select(*key, F.col("record_count").alias("now_rows"))
    if rewrites is None:
        here = here.withColumn("collides", F.lit(False))
    else:
        here = here.join(rewrites.select(*key, F.lit(True).alias("collides")).distinct(), key, "left")
    there = held.select("source_id", F.coalesce("rewrite_of", "file_path").alias("file_path"), F.col("record_count").alias("held_rows"))
    both = here.join(there, key, "full_outer")
    fresh = F.col("held_rows").isNull()
    kind = F.when(~F.col("source_id").isin(sources), "unlisted").when(F.col("now_rows").isNull(), "orphaned").when(
        fresh & F.coalesce("collides", F.lit(False)), "rewrite"
    ).when(fresh, "spliced").otherwise("already")
    both = both.select("source_id", kind.alias("kind"), F.coalesce("now_rows", "held_rows").alias("n"))
    sums = [x for k in ("spliced", "already", "rewrite", "orphaned") for x in (F.sum((F.col("kind") == k).cast("long")).alias(f"{k}_files"), F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)).alias(f"{k}_rows"))]
    return both.groupBy("source_id").agg(*sums)


@dataclass
class Assignment:
    """Where each source's columns go in the target."""

    fields: list[dict]
    registry: list[dict]
    widened: list[dict] = field(default_factory=list)
    renamed: list[dict] = field(default_factory=list)
    #: (source, field id) -> (target id, name in the source): read under another id.
    remaps: dict[tuple[str, int], tuple[int, str]] = field(default_factory=dict)
    #: Those of them that collide: another column has the id.
    rewrites: set[tuple[str, int]] = field(default_factory=set)


def assign(columns: list[dict], fields: list[dict], registry: list[dict], source_column: str) -> Assignment:
    """Give every source's column its target column.

    ``columns`` comes from source_columns in source order, so the first source in the configured
    order owns a new id, on every run alike; the registry keeps that decision. A column that this
    source has had under another name is renamed and stays where it is. A new column whose id
    belongs to another column goes to the column of its own name, or to a fresh id. A changed type
    is an error.
    """
    out = Assignment(list(fields), [dict(r) for r in registry])
    had = {(r["source"], r["id"]): r for r in out.registry}
    for c in columns:
        source, i, name = c["source_id"], c["field_id"], c["name"]
        if i < 0:
            raise SchemaError(f"column {name} of {source} has no field id")
        if name == source_column:
            raise SchemaError(f"{source} has a column {name}, which is the bookkeeping column's name")
        kind = c["kind"]
        if known := had.get((source, i)):
            if known["type"] != kind:
                raise SchemaError(f"column {name} of {source} was {known['type']} and is {kind}")
            if known["name"] != name and name not in known.get("names", []):
                out.renamed.append({"source": source, "id": i, "from": known["name"], "to": name})
                known.setdefault("names", []).append(name)
            target = known["target"]
        else:
            same_id, same_name = find(out.fields, i), find(out.fields, name)
            if same_name and same_name["type"] != kind:
                raise SchemaError(f"column {name} is {same_name['type']} in the target and {kind} in {source}")
            if same_name:
                target = same_name["id"]
            elif c["nested"] and fields:
                raise SchemaError(f"{source} has a new nested column {name}; columns inside columns are not tracked")
            else:
                out.fields = widen(out.fields, name, kind, None if same_id else i)
                target = out.fields[-1]["id"]
                out.widened.append({"id": target, "name": name, "source": source})
            known = {"source": source, "id": i, "name": name, "type": kind, "target": target}
            out.registry.append(known)
            had[source, i] = known
        if target != i:
            out.remaps[source, i] = (target, name)
            if i in known_ids(out.fields):
                out.rewrites.add((source, i))
    taken = known_ids(out.fields)
    out.rewrites |= {k for k in out.remaps if k[1] in taken}
    return out
