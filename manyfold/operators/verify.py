"""Independent checks of a consolidated table: it shares only names with registration."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import Catalog, Config
from .discovery import common_tables, source_names
from .reader import by_field_id, read

log = logging.getLogger(__name__)


def row_counts(catalog: Catalog, config: Config, table: str, sources: list[str]) -> DataFrame:
    """(source_id, source_rows, target_rows, matches), counted from data on both sides. The sources'
    files are listed by Spark's own reader, in all sub-folders, in one scan: what registration
    has overlooked is counted here."""
    spark, there = catalog.spark, []
    for ns in sources:
        if catalog.has_source(ns, table):
            there.append(ns)
        else:
            log.warning("%s has no table %s; it is left out", ns, table)
    if not there:
        return spark.createDataFrame([], "source_id string, source_rows long, target_rows long, matches boolean")
    by_field_id(spark)
    # no column is read, so which one is named doesn't matter
    rows = spark.read.schema("c int").option("recursiveFileLookup", "true").parquet(*(catalog.source_location(ns, table) for ns in there))
    rows = rows.groupBy(catalog.source_of(table, set(there), F.col("_metadata.file_path")).alias("source_id")).agg(F.count(F.lit(1)).alias("source_rows"))
    here = read(catalog, config.target_namespace, table).groupBy(F.col(f"`{config.source_id_column}`").alias("source_id")).agg(F.count(F.lit(1)).alias("target_rows"))
    both = spark.createDataFrame(
        [(n,) for n in there], "source_id string"
    ).join(rows, "source_id", "left").join(here, "source_id", "left").fillna(0, ["source_rows", "target_rows"])
    return both.select("source_id", "source_rows", "target_rows", (F.col("source_rows") == F.col("target_rows")).alias("matches"))


def duplicate_files(manifest: DataFrame) -> DataFrame:
    """(file_path, n) of paths that are registered more than once."""
    return manifest.groupBy("file_path").agg(F.count("*").alias("n")).where("n > 1")


def pruning(catalog: Catalog, config: Config, table: str, source: str) -> tuple[int, int]:
    """(files of a full scan, files that a filter on one source plans)."""
    df = read(catalog, config.target_namespace, table)
    held = catalog.manifest(config.target_namespace, table)
    return held.count(), planned_files(df.where(F.col(f"`{config.source_id_column}`") == source))


def planned_files(df: DataFrame) -> int:
    """The files that the scans of a query plan to read, after pruning; nothing is read."""
    total, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
            continue
        if "FileSourceScan" in name:
            total += node.selectedPartitions().totalNumberOfFiles()
        kids = node.children()
        todo += [kids.apply(i) for i in range(kids.size())]
    return int(total)


def verify_table(catalog: Catalog, config: Config, table: str, sources: list[str]) -> DataFrame:
    """(table_name, check, ok, detail): existence, rows per source, duplicate files, pruning."""
    spark, ns = catalog.spark, config.target_namespace
    schema = "table_name string, check string, ok boolean, detail string"
    if not catalog.exists(ns, table):
        return spark.createDataFrame([(table, "exists", False, f"no table {ns}.{table}")], schema)
    rows = [(table, "exists", True, "")]
    counts = row_counts(catalog, config, table, sources).collect()
    wrong = [f"{r['source_id']}: {r['source_rows']} and {r['target_rows']}" for r in counts if not r["matches"]]
    rows.append((table, "row_counts", bool(counts) and not wrong, "; ".join(wrong) or ("" if counts else "no source was counted")))
    doubled = duplicate_files(catalog.manifest(ns, table)).count()
    rows.append((table, "duplicate_files", not doubled, f"{doubled} paths" if doubled else ""))
    total, some = pruning(catalog, config, table, sources[0])
    rows.append((table, "pruning", True, f"{some} of {total} files" + (" (nothing is pruned)" if total > 1 and some >= total else "")))
    return spark.createDataFrame(rows, schema)


def verify(catalog: Catalog, config: Config, tables: list[str] | None = None) -> tuple[DataFrame, bool]:
    """All checks of all tables, and whether all are well."""
    sources = source_names(catalog, config)
    tables = tables or [r[0] for r in common_tables(catalog, sources).collect()]
    if not tables:
        raise ValueError("no table is in every source")
    out = None
    for t in tables:
        one = verify_table(catalog, config, t, sources)
        out = one if out is None else out.unionByName(one)
    return out, not out.where("not ok").limit(1).count()
