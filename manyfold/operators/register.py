"""Registration: splice, widen, retire and rewrite, in one version per table and run."""

from __future__ import annotations

import hashlib
import logging
import time
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import planner
from ..plans.schema import find, reserve, struct
from ..sources import Catalog, CommitConflict, Config, file_entries
from .discovery import common_tables, source_names
from .reader import by_field_id, scan_files

log = logging.getLogger(__name__)

#: The folders in which a rewrite keeps its origins apart are named by this and the origin's hash.
ORIGIN = "_origin"


def load_sources(catalog: Catalog, sources: list[str], table: str, workers: int = 8, held: DataFrame | None = None) -> DataFrame:
    """Entries of all current files of all sources of a table; ``held``, the target's manifest,
    spares the footers of files that it knows."""
    with ThreadPoolExecutor(min(workers, max(1, len(sources)))) as pool:
        found = list(pool.map(lambda ns: catalog.source_files(ns, table), sources))
    return file_entries(catalog.spark, [(ns, k, *f) for k, (ns, files) in enumerate(zip(sources, found)) for f in files], held)


def _first_schema(now: DataFrame) -> list[dict]:
    """The first source's columns, in the order of its newest file, whether they hold data or not."""
    first = now.orderBy("source_ordinal", F.desc("modified"), F.desc("file_path")).select("column_stats").first()
    return [{"id": c["field_id"], "name": c["name"], "type": c["kind"]} for c in (first or [[]])[0]]


def register_table(catalog: Catalog, table: str, config: Config, sources: list[str] | None = None) -> dict:
    """Bring one table up to date; plans anew if another writer commits first."""
    for _ in range(5):
        try:
            return _register_once(catalog, table, config, sources or source_names(catalog, config))
        except CommitConflict as e:
            log.warning("%s", e)
    raise CommitConflict(f"{config.target_namespace}.{table}: other writers keep committing")


def _register_once(catalog: Catalog, table: str, config: Config, sources: list[str]) -> dict:
    began, spark, ns = time.time(), catalog.spark, config.target_namespace
    by_field_id(spark)
    catalog.ensure_namespace(ns)
    base = catalog.latest(ns, table)
    held = catalog.manifest(ns, table)
    now = load_sources(catalog, sources, table, config.source_workers, held if base.version else None).cache()
    outs: list[str] = []
    try:
        fields = base.schema or reserve(_first_schema(now), config.source_id_column)
        columns = sorted((r.asDict() for r in planner.source_columns(now).collect()), key=lambda c: (c["source_ordinal"], c["field_id"]))
        plan = planner.assign(columns, fields, base.registry, config.source_id_column)
        fresh, rewrites = planner.new_files(now, held), None
        if plan.remaps:
            remaps = spark.createDataFrame(
                [(s, i, t, (s, i) in plan.rewrites) for (s, i), (t, _) in sorted(plan.remaps.items())],
                "source_id string, field_id int, target_id int, collides boolean"
            )
            # per file: how its ids map, and whether it has to be rewritten
            mapped = planner.file_columns(now).where("has_data").join(F.broadcast(remaps), ["source_id", "field_id"]).groupBy("source_id", "file_path")
            mapped = mapped.agg(
                F.map_from_entries(F.array_sort(F.collect_set(F.struct("field_id", "target_id")))).alias("field_map"),
                F.max("collides").alias("collides")
            )
            rewrites, fresh = mapped.where("collides"), fresh.join(mapped, ["source_id", "file_path"], "left")
        else:
            fresh = fresh.withColumns({"field_map": F.lit(None).cast("map<int,int>"), "collides": F.lit(False)})
        state = {r["source_id"]: r.asDict() for r in planner.status(now, held, sources, rewrites).collect()}
        add = lambda k: sum(r[k] for r in state.values())
        spliced = fresh.where(~F.coalesce("collides", F.lit(False))).select(
            "file_path", "file_format", "source_id", "record_count", "file_size_in_bytes", "column_stats",
            F.lit("spliced").alias("origin"), F.lit(None).cast("string").alias("rewrite_of"), F.col("field_map")
        )
        gone = planner.orphans(now, held, sources)
        written = _rewrite(catalog, ns, table, plan, fresh.where("collides"), outs) if add("rewrite_files") else None
        added = spliced if written is None else spliced.unionByName(written)
        orphaned, new = add("orphaned_files"), add("spliced_files") + add("rewrite_files")
        changed = plan.fields != base.schema or plan.registry != base.registry
        operation = "overwrite" if orphaned else "append" if new else "schema" if changed or not base.version else "none"
        version = base.version
        if operation != "none":
            version = catalog.commit(
                ns, table, base, operation, added if new else None, gone if orphaned else None, plan.fields,
                plan.registry, config.source_id_column
            ).version
        return {
            "table": table, "version": version, "operation": operation, "spliced_files": add("spliced_files"),
            "spliced_rows": add("spliced_rows"), "rewritten_files": add("rewrite_files"),
            "rewritten_rows": add("rewrite_rows"), "already_files": add("already_files"), "orphaned_files": orphaned,
            "orphaned_rows": add("orphaned_rows"), "widened": plan.widened, "renamed": plan.renamed,
            "collisions": [{"source": s, "id": i, "name": plan.remaps[s, i][1]} for s, i in sorted(plan.rewrites)] if add("rewrite_files") else [],
            "unlisted": sorted(set(state) - set(sources)), "sources": state, "elapsed": time.time() - began
        }
    except CommitConflict:
        for out in outs:  # another writer was first; what was rewritten for this plan is no one's
            catalog.storage.delete(out)
        raise
    finally:
        now.unpersist()


def _rewrite(catalog: Catalog, ns: str, table: str, plan: planner.Assignment, files: DataFrame, outs: list[str]) -> DataFrame:
    """Write the rows of colliding files under the target's ids, each file once, all its rows.

    Files of a source with the same ids are one scan and one write, into a folder of the source that
    goes into ``outs``. An origin's rows stay apart from the others', in a folder of their own, so
    that it can be retired alone."""
    spark, storage = catalog.spark, catalog.storage
    columns = F.sort_array(F.transform("column_stats", lambda c: F.struct(c["field_id"], c["name"])))
    groups = files.groupBy("source_id", columns.alias("c")).agg(F.sort_array(F.collect_list("file_path")).alias("paths")).collect()
    source_field = plan.fields[[f["id"] for f in plan.fields].index(100_000)]
    data = [f for f in plan.fields if f is not source_field]
    schema = struct([*data, source_field])
    listed: list[tuple] = []
    origins: list[tuple[str, str]] = []
    for group in sorted(groups, key=lambda g: (g["source_id"], g["paths"])):
        source, paths = group["source_id"], group["paths"]
        to = {i: plan.remaps.get((source, i), (i, n))[0] for i, n in group["c"]}
        own = [{**find(data, t), "id": i} for i, t in to.items() if find(data, t)]
        out = f"{catalog.path(ns, table)}/data/{source}/rewritten-{uuid.uuid4().hex[:12]}"
        outs.append(out)
        names = {f["name"] for f in own}
        cols = [F.col(f"`{f['name']}`") if f["name"] in names else F.lit(None).cast(f["type"]).alias(f["name"]) for f in data]
        rows = scan_files(spark, own, paths).select(*cols, F.lit(source).alias(source_field["name"]), F.sha1("_metadata.file_path").alias(ORIGIN))
        rows = rows.select(*(F.col(f"`{f.name}`").alias(f.name, metadata=f.metadata) for f in schema.fields), ORIGIN)
        rows.write.partitionBy(ORIGIN).parquet(out)
        of = {hashlib.sha1(catalog.address(p).encode()).hexdigest(): p for p in paths}
        for at, size, modified in storage.walk(out):
            listed.append((source, 0, at, size, modified))
            origins.append((at, of[at.rsplit(f"/{ORIGIN}=", 1)[1].split("/")[0]]))
    entries = file_entries(spark, listed)
    pairs = spark.createDataFrame(sorted(origins), "file_path string, rewrite_of string")
    return entries.join(pairs, "file_path").select(
        "file_path", "file_format", "source_id", "record_count", "file_size_in_bytes", "column_stats",
        F.lit("rewritten").alias("origin"), "rewrite_of", F.lit(None).cast("map<int,int>").alias("field_map")
    )


def slowest(times: DataFrame, most: int = 5) -> DataFrame:
    """(table_name, seconds): of (table_name, elapsed), the tables that took longest, to a tenth."""
    return times.orderBy(F.desc("elapsed"), "table_name").limit(most).select("table_name", F.round("elapsed", 1).alias("seconds"))


def run(catalog: Catalog, config: Config, tables: list[str] | None = None) -> dict:
    """All tables, ``table_workers`` at a time, each a Spark job of its own. A failure is raised
    after the other tables have ended; their versions stay."""
    began = time.time()
    sources = source_names(catalog, config)
    tables = tables or [r[0] for r in common_tables(catalog, sources).collect()]
    if not tables:
        raise ValueError("no table is in every source")
    done, failed = [], []
    with ThreadPoolExecutor(min(config.table_workers, len(tables))) as pool:
        for table, job in [(t, pool.submit(register_table, catalog, t, config, sources)) for t in tables]:
            try:
                done.append(job.result())
            except Exception as e:
                log.error("%s.%s: %s", config.target_namespace, table, e)
                failed.append(e)
    if failed:
        raise failed[0]
    add = lambda k: sum(r[k] for r in done)
    times = catalog.spark.createDataFrame([(r["table"], r["elapsed"]) for r in done], "table_name string, elapsed double")
    return {
        "tables": len(done), "sources": len(sources), "spliced_rows": add("spliced_rows"),
        "rewritten_rows": add("rewritten_rows"), "grand_total": add("spliced_rows") + add("rewritten_rows"),
        "orphaned_files": add("orphaned_files"), "orphaned_rows": add("orphaned_rows"),
        "slowest": [tuple(r) for r in slowest(times).collect()], "seconds": round(time.time() - began, 1),
        "results": {r["table"]: r for r in done}
    }


