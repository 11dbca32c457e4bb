"""The engine's queries over fixtures, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .fixtures import OFFSET, SOURCE, TENANTS, World, base, world
from .operators import common_tables, live, read, resolve_namespaces, skipped_tables
from .operators.register import load_sources, slowest
from .operators.verify import duplicate_files, pruning, row_counts, verify
from .plans import planner
from .plans.schema import known_ids


def _read(w: World, table: str = "customer", version: int | None = None) -> DataFrame:
    return read(w.catalog, w.config.target_namespace, table, version)


def _of(fixture: str, table: str = "customer") -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: _read(world(spark, sf_dir, fixture), table)


def source_filter(spark, sf_dir):
    return _of("F1")(spark, sf_dir).where(F.col(SOURCE) == "tenant_1")


def rows_per_source(spark, sf_dir):
    return _of("F1")(spark, sf_dir).groupBy(SOURCE).agg(F.count("*").alias("n_rows"), F.sum("c_custkey").cast("long").alias("sum_key"))


def manifest_rows(spark, sf_dir):
    w = world(spark, sf_dir, "F1")
    return w.catalog.manifest(w.config.target_namespace, "customer").groupBy("source_id").agg(F.sum("record_count").alias("n_rows"), F.count("*").alias("n_files"))


def resolved(spark, sf_dir):
    w = world(spark, sf_dir, "F10")
    return resolve_namespaces(w.catalog, w.config)


def tables_in_common(spark, sf_dir):
    return common_tables(world(spark, sf_dir, "F10").catalog, list(TENANTS)).withColumnRenamed("table", "table_name")


def tables_skipped(spark, sf_dir):
    return skipped_tables(world(spark, sf_dir, "F10").catalog, list(TENANTS)).withColumnRenamed("table", "table_name")


def target_schema(spark, sf_dir):
    w = world(spark, sf_dir, "F1")
    fields = w.catalog.latest(w.config.target_namespace, "customer").schema
    return spark.createDataFrame([(f["id"], f["name"], f["type"]) for f in fields], "field_id int, name string, type string")


def drift_report(spark, sf_dir):
    w = world(spark, sf_dir, "F4")
    first = w.catalog.latest(w.config.target_namespace, "customer", version=1)
    return planner.drift_report(load_sources(w.catalog, list(TENANTS), "customer"), known_ids(first.schema))


def soft_delete_live(spark, sf_dir):
    return live(_of("F6")(spark, sf_dir))


def rename_report(spark, sf_dir):
    w = world(spark, sf_dir, "F9")
    return spark.createDataFrame([(r["source"], r["id"], r["from"], r["to"]) for x in w.runs for r in x["renamed"]], "source_id string, field_id int, old_name string, new_name string")


def rerun_noop(spark, sf_dir):
    w = world(spark, sf_dir, "F1")
    r = w.runs[-1]
    return spark.createDataFrame([(r["spliced_files"], r["rewritten_files"], r["orphaned_files"], r["already_files"], r["version"] - w.runs[-2]["version"])], "spliced long, rewritten long, retired long, already long, new_versions long")


def snapshot_ops(spark, sf_dir):
    w = world(spark, sf_dir, "F5")
    return spark.createDataFrame([(s.version, s.operation) for s in w.catalog.history(w.config.target_namespace, "customer")], "version int, operation string")


def verify_counts(spark, sf_dir):
    w = world(spark, sf_dir, "F5")
    return row_counts(w.catalog, w.config, "customer", list(TENANTS))


def source_status(spark, sf_dir):
    """What a run would do after a copy-on-write update, seen from the version before it."""
    w = world(spark, sf_dir, "F5")
    now, held = load_sources(w.catalog, list(TENANTS), "customer"), w.catalog.manifest(w.config.target_namespace, "customer", version=1)
    return planner.status(now, held, list(TENANTS))


def duplicates(spark, sf_dir):
    w = world(spark, sf_dir, "F11")
    return duplicate_files(w.catalog.manifest(w.config.target_namespace, "customer")).agg(F.count("*").alias("n_paths"), F.sum("n").alias("n_entries"))


def prune_check(spark, sf_dir):
    w = world(spark, sf_dir, "F1")
    total, some = pruning(w.catalog, w.config, "customer", "tenant_1")
    return spark.createDataFrame([(total, some)], "total_files long, planned_files long")


def verify_all(spark, sf_dir):
    w = world(spark, sf_dir, "F12")
    return verify(w.catalog, w.config)[0].select("table_name", "check", "ok")


def run_summary(spark, sf_dir):
    r = world(spark, sf_dir, "F12").runs[-1]
    return spark.createDataFrame([tuple(r[k] for k in ("tables", "sources", "spliced_rows", "rewritten_rows", "grand_total", "orphaned_files"))], "n_tables long, n_sources long, spliced_rows long, rewritten_rows long, grand_total long, orphaned_files long")


def slowest_tables(spark, sf_dir):
    """The report's top five over times that don't vary: a seventh of a second for each customer of
    a nation, as if nations were tables."""
    nations = base(spark, sf_dir, "nation").join(base(spark, sf_dir, "customer"), F.col("n_nationkey") == F.col("c_nationkey"))
    return slowest(nations.groupBy(F.col("n_name").alias("table_name")).agg((F.count("*") / 7).alias("elapsed")))


def splice_subfolders(spark, sf_dir):
    return _of("F15")(spark, sf_dir)


def time_travel_rows(spark, sf_dir):
    """The rows of the version before a file with a new column came; its files are all there still."""
    return _read(world(spark, sf_dir, "F2"), version=1)


def consolidated_revenue(spark, sf_dir):
    w = world(spark, sf_dir, "F12")
    o, li = _read(w, "orders"), _read(w, "lineitem").withColumnRenamed(SOURCE, "line_source")
    both = o.join(li, (F.col("o_orderkey") == F.col("l_orderkey")) & (F.col(SOURCE) == F.col("line_source")))
    return both.groupBy(SOURCE, "o_orderstatus").agg(F.count("*").alias("n_lines"), F.sum("l_quantity").alias("sum_qty"), F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("sum_cents"))


def time_travel(spark, sf_dir):
    """The state before the copy-on-write update; its replaced file's rows are gone, as its source
    dropped the file, so the query counts what the old manifest says."""
    w = world(spark, sf_dir, "F5")
    ns = w.config.target_namespace
    parts = [w.catalog.manifest(ns, "customer", v).agg(F.lit(v).alias("version"), F.sum("record_count").alias("n_rows"), F.count("*").alias("n_files")) for v in (1, 2)]
    return parts[0].unionByName(parts[1])


def vectors_prefix(spark, sf_dir):
    return _of("F14", "embeddings")(spark, sf_dir).select("vec_id", "label", SOURCE, F.size("embedding").alias("dims"))


def bounds_skip(spark, sf_dir):
    """A filtered read that leaves files out by their bounds: the copies' keys are all beyond the offset."""
    w = world(spark, sf_dir, "F4c")
    return read(w.catalog, w.config.target_namespace, "customer", where=[("c_custkey", ">=", OFFSET), (SOURCE, "=", "tenant_1")])


def vector_values(spark, sf_dir):
    """Every component of every spliced array, in its place."""
    rows = _of("F14", "embeddings")(spark, sf_dir)
    return rows.select("vec_id", SOURCE, F.posexplode("embedding").alias("place", "component")).withColumn("component", F.col("component").cast("double"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "splice_customer": _of("F1"), "source_filter": source_filter, "rows_per_source": rows_per_source, "manifest_rows": manifest_rows,
        "resolve_namespaces": resolved, "common_tables": tables_in_common, "skipped_tables": tables_skipped, "target_schema": target_schema,
        "widen_other_source": _of("F2"), "widen_first_source": _of("F3"), "late_widen_recovery": _of("F3b"), "drift_report": drift_report,
        "collision_resolved": _of("F4"), "collision_rerun_stable": _of("F4again"), "collision_later_run": _of("F4b"), "collision_multi_file_nulls": _of("F4c"),
        "same_name_other_id": _of("F4d"), "two_new_columns": _of("F4e"), "cow_update": _of("F5"), "soft_delete": _of("F6"), "soft_delete_live": soft_delete_live,
        "two_cycles": _of("F7"), "rename_switch": _of("F8"), "true_rename": _of("F9"), "rename_report": rename_report, "rerun_noop": rerun_noop,
        "snapshot_ops": snapshot_ops, "source_status": source_status, "verify_counts": verify_counts, "duplicate_files": duplicates, "prune_check": prune_check,
        "verify_all": verify_all, "run_summary": run_summary, "slowest_tables": slowest_tables, "consolidated_revenue": consolidated_revenue,
        "time_travel": time_travel, "time_travel_rows": time_travel_rows, "splice_vectors": vectors_prefix, "splice_vector_values": vector_values, "splice_subfolders": splice_subfolders,
        "bounds_skip": bounds_skip,
    }


_T = f"'tenant_' || (c_custkey % 3) AS {SOURCE}"
_ALL = f"SELECT *, {_T} FROM customer"
_COLS = "c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment"
_COPY = "c_custkey + 900000 AS c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment"


def _plus(*parts: str, extra: str = "CAST(NULL AS VARCHAR) AS hue") -> str:
    return f"SELECT {_COLS}, {extra}, {_T} FROM customer" + "".join(f" UNION ALL {p}" for p in parts)


def _copy(k: int, extra: str, where: str = "c_custkey < 100", cols: str = _COPY) -> str:
    return f"SELECT {cols}, {extra}, 'tenant_{k}' FROM customer WHERE c_custkey % 3 = {k} AND {where}"


_HUE = "lower(c_mktsegment)"
_SHADE = "c_mktsegment || '!'"
_BOTH = _plus(_copy(0, f"{_HUE}, NULL"), _copy(1, f"NULL, {_SHADE}"), extra="CAST(NULL AS VARCHAR) AS hue, CAST(NULL AS VARCHAR) AS shade")


def oracle_sql() -> dict[str, str]:
    count = "SELECT CAST(count(*) AS BIGINT) FROM"
    at = "c_custkey // 3"
    segment = f"CASE WHEN {at} IN (10, 11, 12) THEN 'UPD1' WHEN {at} IN (20, 21, 22) THEN 'UPD2' ELSE c_mktsegment END AS c_mktsegment"
    soft = f"SELECT *, c_custkey % 50 = 0 AS _deleted, {_T} FROM customer"
    even = f"CASE WHEN (c_custkey + 900000) % 2 = 0 THEN {_SHADE} END"
    new = ", ".join(f"({900000 * c + k + 3 * j}, {c})" for c in (1, 2) for k in range(3) for j in range(5))
    return {
        "splice_customer": _ALL,
        "source_filter": f"{_ALL} WHERE c_custkey % 3 = 1",
        "rows_per_source": f"SELECT {_T}, count(*) AS n_rows, CAST(sum(c_custkey) AS BIGINT) AS sum_key FROM customer GROUP BY 1",
        "manifest_rows": "SELECT 'tenant_' || (c_custkey % 3) AS source_id, count(*) AS n_rows, CAST(1 AS BIGINT) AS n_files FROM customer GROUP BY 1",
        "resolve_namespaces": "SELECT * FROM (VALUES ('tenant_0'), ('tenant_1'), ('tenant_2')) t(namespace)",
        "common_tables": "SELECT 'customer' AS table_name",
        "skipped_tables": "SELECT 'orders' AS table_name, CAST(2 AS BIGINT) AS namespaces",
        "target_schema": f"SELECT * FROM (VALUES (1, 'c_custkey', 'bigint'), (2, 'c_name', 'string'), (3, 'c_nationkey', 'int'), (4, 'c_acctbal', 'double'), (5, 'c_mktsegment', 'string'), (100000, '{SOURCE}', 'string')) t(field_id, name, type)",
        "widen_other_source": _plus(_copy(1, _HUE)),
        "widen_first_source": _plus(_copy(0, _HUE)),
        "late_widen_recovery": _plus(_copy(0, _HUE)),
        "drift_report": "SELECT * FROM (VALUES (6, 'tenant_0', 'hue'), (6, 'tenant_1', 'shade')) t(field_id, source_id, name)",
        "collision_resolved": _BOTH,
        "collision_rerun_stable": _BOTH,
        "collision_later_run": _BOTH,
        "collision_multi_file_nulls": _plus(_copy(0, f"{_HUE}, NULL"), _copy(1, f"NULL, {even}", "c_custkey < 200"), extra="CAST(NULL AS VARCHAR) AS hue, CAST(NULL AS VARCHAR) AS shade"),
        "same_name_other_id": _plus(_copy(0, _HUE), _copy(1, _HUE)),
        "two_new_columns": _plus(_copy(1, f"{_HUE}, c_nationkey % 5"), extra="CAST(NULL AS VARCHAR) AS hue, CAST(NULL AS INTEGER) AS grade"),
        "cow_update": f"SELECT c_custkey, c_name, c_nationkey, c_acctbal, CASE WHEN c_custkey % 30 = 0 THEN 'UPDATED' ELSE c_mktsegment END AS c_mktsegment, {_T} FROM customer",
        "soft_delete": soft,
        "soft_delete_live": f"SELECT * FROM ({soft}) WHERE NOT _deleted",
        "two_cycles": f"SELECT c_custkey, c_name, c_nationkey, c_acctbal, {segment}, {at} IN (15, 16, 25, 26) AS _deleted, {_T} FROM customer UNION ALL SELECT CAST(k AS BIGINT), 'new', 0, CAST(c AS DOUBLE), 'NEW', false, 'tenant_' || (k % 3) FROM (VALUES {new}) t(k, c)",
        "rename_switch": _plus(*(_copy(k, _HUE, cols="c_custkey + 900000, c_name, c_nationkey, c_acctbal, NULL") for k in range(3))),
        "true_rename": f"{_ALL} UNION ALL SELECT {_COPY}, 'tenant_0' FROM customer WHERE c_custkey % 3 = 0 AND c_custkey < 100",
        "rename_report": "SELECT 'tenant_0' AS source_id, 5 AS field_id, 'c_mktsegment' AS old_name, 'segment' AS new_name",
        "rerun_noop": "SELECT CAST(0 AS BIGINT) AS spliced, CAST(0 AS BIGINT) AS rewritten, CAST(0 AS BIGINT) AS retired, CAST(3 AS BIGINT) AS already, CAST(0 AS BIGINT) AS new_versions",
        "snapshot_ops": "SELECT * FROM (VALUES (1, 'append'), (2, 'overwrite')) t(version, operation)",
        "source_status": f"SELECT 'tenant_' || (c_custkey % 3) AS source_id, {', '.join(f'CAST(CASE WHEN c_custkey % 3 = 0 THEN {a} ELSE {b} END AS BIGINT) AS {k}_files, CAST(CASE WHEN c_custkey % 3 = 0 THEN {int(a > 0)} ELSE {int(b > 0)} END * count(*) AS BIGINT) AS {k}_rows' for k, a, b in (('spliced', 2, 0), ('already', 0, 1), ('rewrite', 0, 0), ('orphaned', 1, 0)))} FROM customer GROUP BY c_custkey % 3",
        "verify_counts": "SELECT 'tenant_' || (c_custkey % 3) AS source_id, count(*) AS source_rows, count(*) AS target_rows, true AS matches FROM customer GROUP BY 1",
        "duplicate_files": "SELECT CAST(1 AS BIGINT) AS n_paths, CAST(2 AS BIGINT) AS n_entries",
        "prune_check": "SELECT CAST(3 AS BIGINT) AS total_files, CAST(1 AS BIGINT) AS planned_files",
        "verify_all": "SELECT t AS table_name, c AS \"check\", true AS ok FROM (VALUES ('customer'), ('lineitem'), ('orders')) a(t), (VALUES ('exists'), ('row_counts'), ('duplicate_files'), ('pruning')) b(c)",
        "run_summary": f"SELECT CAST(3 AS BIGINT) AS n_tables, CAST(3 AS BIGINT) AS n_sources, n AS spliced_rows, CAST(0 AS BIGINT) AS rewritten_rows, n AS grand_total, CAST(0 AS BIGINT) AS orphaned_files FROM (SELECT ({count} customer) + ({count} orders) + ({count} lineitem) AS n)",
        "consolidated_revenue": f"SELECT 'tenant_' || (o_custkey % 3) AS {SOURCE}, o_orderstatus, count(*) AS n_lines, sum(l_quantity) AS sum_qty, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS sum_cents FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2",
        "slowest_tables": "SELECT n_name AS table_name, round(count(*) / 7.0::DOUBLE, 1) AS seconds FROM nation JOIN customer ON n_nationkey = c_nationkey GROUP BY n_name ORDER BY count(*) DESC, n_name LIMIT 5",
        "splice_subfolders": f"SELECT {_COLS}, {_T} FROM customer UNION ALL SELECT {_COPY}, 'tenant_1' FROM customer WHERE c_custkey % 3 = 1 AND c_custkey < 100",
        "time_travel_rows": _ALL,
        "bounds_skip": f"SELECT {_COPY}, NULL::VARCHAR AS hue, {even} AS shade, 'tenant_1' AS {SOURCE} FROM customer WHERE c_custkey % 3 = 1 AND c_custkey < 200",
        "time_travel": f"SELECT v AS version, ({count} customer) AS n_rows, n AS n_files FROM (VALUES (1, CAST(3 AS BIGINT)), (2, CAST(4 AS BIGINT))) t(v, n)",
        "splice_vector_values": f"SELECT vec_id, 'tenant_' || (vec_id % 3) AS {SOURCE}, CAST(i - 1 AS INTEGER) AS place, CAST(embedding[i] AS DOUBLE) AS component FROM embeddings, generate_series(1, len(embedding)) g(i)",
        "splice_vectors": f"SELECT vec_id, label, 'tenant_' || (vec_id % 3) AS {SOURCE}, CAST(len(embedding) AS INTEGER) AS dims FROM embeddings",
    }


__all__ = ["base", "oracle_sql", "queries"]
