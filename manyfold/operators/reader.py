"""The consolidated table as a DataFrame."""

from __future__ import annotations

import json
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.schema import find, struct
from ..plans.skipping import Condition, matches, may_match
from ..sources import Catalog

def by_field_id(spark: SparkSession) -> None:
    """Let Spark resolve Parquet columns by the ids in the requested schema; a schema without ids is
    still resolved by name. Beyond some hundred files, the executors look up their lengths, many
    files to a task."""
    looked_up = "spark.sql.sources.parallelPartitionDiscovery"
    settings = {
        "spark.sql.parquet.fieldId.read.enabled": "true", "spark.sql.parquet.fieldId.write.enabled": "true",
        f"{looked_up}.threshold": "256", f"{looked_up}.parallelism": str(4 * spark.sparkContext.defaultParallelism),
    }
    for k, v in settings.items():
        if spark.conf.get(k, None) != v:
            spark.conf.set(k, v)


def scan_files(spark: SparkSession, fields: list[dict], paths: list[str]) -> DataFrame:
    """One scan of files by field id; ids that a file lacks read as null."""
    by_field_id(spark)
    schema = struct(fields)
    if not paths:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[unquote(p) for p in paths])


def read(catalog: Catalog, namespace: str, table: str, version: int | None = None, where: list[Condition] | None = None) -> DataFrame:
    """All rows of all sources, each with its source; ``version`` gives an earlier state.

    Files are grouped by how their ids map to the target's, nearly always in one way, and a group
    is one scan. Filters on the source prune files, others reach Parquet. ``where``, conditions
    (column, operator, value) that all must hold, leaves files out by the manifest's bounds before
    anything is listed or opened, and filters the rows.
    """
    spark = catalog.spark
    snap = catalog.latest(namespace, table, version)
    if not snap.version:
        raise ValueError(f"no table {namespace}.{table}")
    by_field_id(spark)
    conditions = where or []
    of_source = [c for c in conditions if c[0] == snap.partition_column]
    entries = catalog.manifest(namespace, table, version).where(may_match(snap.schema, [c for c in conditions if c not in of_source]))
    for _, op, value in of_source:
        entries = entries.where(matches([("source_id", op, value)]))
    held = entries.select("file_path", "source_id", F.to_json("field_map").alias("m"), "origin")
    groups: dict[tuple[str, bool], list[str]] = {}
    names: set[str] = set()
    for path, source, mapping, origin in held.collect():
        if origin == "rewritten" and f"/data/{source}/" not in unquote(path):
            raise ValueError(f"{path} doesn't lie in a folder of {source}; register the table anew")
        groups.setdefault((mapping or "{}", origin == "rewritten"), []).append(path)
        names.add(source)
    source_field = find(snap.schema, snap.partition_column)
    data = [f for f in snap.schema if f is not source_field]
    parts = []
    for (mapping, rewritten), paths in sorted(groups.items()):
        to = {int(k): int(v) for k, v in json.loads(mapping).items()}
        back = {v: k for k, v in to.items()}
        # a mapped id reads from the file's own id; the id that the file uses otherwise isn't the target's
        fields = [{**f, "id": back.get(f["id"], f["id"])} for f in data if f["id"] in back or f["id"] not in to]
        df = scan_files(spark, fields, sorted(paths))
        there = {f["name"] for f in fields}
        cols = [F.col(f"`{f['name']}`") if f["name"] in there else F.lit(None).cast(f["type"]).alias(f["name"]) for f in data]
        at = F.col("_metadata.file_path")
        source = catalog.folders_of(f"{catalog.path(namespace, table)}/data", names, at, 1) if rewritten else catalog.source_of(table, names, at)
        parts.append(df.select(*cols, source.alias(snap.partition_column)))
    if not parts:
        return spark.createDataFrame([], struct(snap.schema))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where(matches(conditions)) if conditions else out


def live(df: DataFrame, deleted: str = "_deleted") -> DataFrame:
    """Without the rows that carry a soft-delete flag; the table itself keeps them."""
    return df.where(~F.coalesce(F.col(deleted), F.lit(False)))
