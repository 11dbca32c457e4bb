"""Tenants cut from the base tables by rules that are plain SQL too, and what happens to them."""

from __future__ import annotations

import threading
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import register_table, run
from .plans.schema import numbered, struct
from .sources import Catalog, Config
from .sources.storage import workspace

SOURCE = "source_connection_id"
TENANTS = ("tenant_0", "tenant_1", "tenant_2")
OFFSET = 900_000  # divisible by three, so that the tenant rule still holds
#: So many lines go to a task that joins them with their orders, however many there are.
LINES = 500_000


@dataclass
class World:
    catalog: Catalog
    config: Config
    runs: list[dict] = field(default_factory=list)

    def register(self, table: str = "customer") -> dict:
        self.runs.append(register_table(self.catalog, table, self.config))
        return self.runs[-1]


_made: dict[tuple, World] = {}
_lock = threading.Lock()


def world(spark: SparkSession, sf_dir: str, name: str) -> World:
    """A fixture, built once for an application and data folder; it outlives lazy results."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    with _lock:
        if key not in _made:
            w = World(Catalog(spark, workspace(spark, f"warehouse-{name}")), Config("tenant_consolidated", SOURCE, TENANTS))
            _BUILD[name](spark, sf_dir, w)
            _made[key] = w
        return _made[key]


def base(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_ids(df: DataFrame, ids: dict[str, int] | None = None) -> DataFrame:
    """``df`` with field ids: in column order, or those given for new columns."""
    schema = numbered(df.schema)
    for f in schema.fields:
        if ids and f.name in ids:
            f.metadata = {"parquet.field.id": ids[f.name]}
    return df.select(*(F.col(f"`{f.name}`").alias(f.name, metadata=f.metadata) for f in schema.fields))


def put(w: World, namespace: str, df: DataFrame, table: str = "customer", ids: dict[str, int] | None = None, replace: bool = False, files: int | None = 1) -> None:
    """Add files to a source's table; ``replace`` removes its files first, as a copy-on-write update does.

    A file is written by one task. So a whole table goes without a number of files, and each task
    writes the rows that it has; a number is for a few rows, and where a query's SQL counts files."""
    at = w.catalog.path(namespace, table)
    old = [p for p, *_ in w.catalog.source_files(namespace, table)] if replace else []
    rows = with_ids(df, ids)
    (rows.repartition(files) if files else rows).write.mode("append").parquet(at)
    for p in old:
        w.catalog.storage.delete(p)


def tenant(df: DataFrame, k: int, key: str = "c_custkey") -> DataFrame:
    return df.where(F.col(key) % 3 == k)


def copies(df: DataFrame, k: int, low: int = 0, high: int = 100) -> DataFrame:
    """A tenant's keys in a range, again, under new keys."""
    some = tenant(df, k).where((F.col("c_custkey") >= low) & (F.col("c_custkey") < high))
    return some.withColumn("c_custkey", F.col("c_custkey") + OFFSET)


def hued(df: DataFrame, name: str = "hue") -> DataFrame:
    value = F.lower("c_mktsegment") if name == "hue" else F.concat("c_mktsegment", F.lit("!"))
    return df.withColumn(name, value)


def _plain(spark: SparkSession, sf_dir: str, w: World, register: bool = True, files: int | None = None) -> DataFrame:
    df = base(spark, sf_dir, "customer")
    for k, ns in enumerate(TENANTS):
        put(w, ns, tenant(df, k), files=files)
    if register:
        w.register()
    return df


def _f1(spark, sf_dir, w):
    _plain(spark, sf_dir, w, files=1)
    w.register()


def _new_column(k: int) -> Callable:
    def build(spark, sf_dir, w):
        df = _plain(spark, sf_dir, w)
        put(w, TENANTS[k], hued(copies(df, k)))
        w.register()

    return build


def _late(spark, sf_dir, w):
    """A version that splices a file without widening, as if by an older writer; then a run."""
    from .operators.register import load_sources
    from .plans import planner

    df = _plain(spark, sf_dir, w)
    put(w, TENANTS[0], hued(copies(df, 0)))
    c, ns = w.catalog, w.config.target_namespace
    snap, held = c.latest(ns, "customer"), c.manifest(ns, "customer")
    fresh = planner.new_files(load_sources(c, list(TENANTS), "customer"), held).select(
        "file_path", "file_format", "source_id", "record_count", "file_size_in_bytes", "column_stats",
        F.lit("spliced").alias("origin"), F.lit(None).cast("string").alias("rewrite_of"),
        F.lit(None).cast("map<int,int>").alias("field_map")
    )
    c.commit(ns, "customer", snap, "append", fresh, None, snap.schema, snap.registry, SOURCE)
    w.register()


def _collision(spark, sf_dir, w):
    df = _plain(spark, sf_dir, w)
    put(w, TENANTS[0], hued(copies(df, 0)))
    put(w, TENANTS[1], hued(copies(df, 1), "shade"))
    w.register()


def _collision_again(spark, sf_dir, w):
    _collision(spark, sf_dir, w)
    w.register()
    w.register()


def _collision_later(spark, sf_dir, w):
    df = _plain(spark, sf_dir, w)
    put(w, TENANTS[0], hued(copies(df, 0)))
    w.register()
    put(w, TENANTS[1], hued(copies(df, 1), "shade"))
    w.register()
    w.register()


def _collision_nulls(spark, sf_dir, w):
    df = _plain(spark, sf_dir, w)
    put(w, TENANTS[0], hued(copies(df, 0)))
    half = lambda d: d.withColumn("shade", F.when(F.col("c_custkey") % 2 == 0, F.col("shade")))
    put(w, TENANTS[1], half(hued(copies(df, 1), "shade")))
    put(w, TENANTS[1], half(hued(copies(df, 1, 100, 200), "shade")))
    w.register()
    w.register()


def _same_name(spark, sf_dir, w):
    df = _plain(spark, sf_dir, w)
    put(w, TENANTS[0], hued(copies(df, 0)))
    w.register()
    put(w, TENANTS[1], hued(copies(df, 1)), ids={"hue": 7})
    w.register()


def _two_columns(spark, sf_dir, w):
    df = _plain(spark, sf_dir, w)
    put(w, TENANTS[1], hued(copies(df, 1)).withColumn("grade", F.col("c_nationkey") % 5))
    w.register()


def _cow(spark, sf_dir, w):
    df = _plain(spark, sf_dir, w, files=1)
    seg = F.when(F.col("c_custkey") % 30 == 0, F.lit("UPDATED")).otherwise(F.col("c_mktsegment"))
    put(w, TENANTS[0], tenant(df, 0).withColumn("c_mktsegment", seg), replace=True, files=2)
    w.register()


def _soft(spark, sf_dir, w):
    df = base(spark, sf_dir, "customer").withColumn("_deleted", F.lit(False))
    for k, ns in enumerate(TENANTS):
        put(w, ns, tenant(df, k), files=None)
    w.register()
    for k, ns in enumerate(TENANTS):
        put(w, ns, tenant(df, k).withColumn("_deleted", F.col("c_custkey") % 50 == 0), replace=True, files=None)
    w.register()


def cycled(df: DataFrame, k: int, cycles: int) -> DataFrame:
    """A tenant's rows after some cycles of 5 inserts, 3 updates and 2 soft deletes."""
    rows = tenant(df, k).withColumn("_deleted", F.lit(False))
    at = F.floor(F.col("c_custkey") / 3)
    for c in range(1, cycles + 1):
        rows = rows.withColumn("c_mktsegment", F.when(at.isin([10 * c, 10 * c + 1, 10 * c + 2]), F.lit(f"UPD{c}")).otherwise(F.col("c_mktsegment")))
        rows = rows.withColumn("_deleted", F.col("_deleted") | at.isin([10 * c + 5, 10 * c + 6]))
        new = df.sparkSession.range(0, 5, 1, 1).select(
            (F.lit(OFFSET * c + k) + 3 * F.col("id")).alias("c_custkey"), F.lit("new").alias("c_name"),
            F.lit(0).alias("c_nationkey"), F.lit(float(c)).alias("c_acctbal"), F.lit("NEW").alias("c_mktsegment"),
            F.lit(False).alias("_deleted")
        )
        rows = rows.unionByName(new)
    return rows


def _cycles(spark, sf_dir, w):
    df = base(spark, sf_dir, "customer")
    for c in range(3):
        for k, ns in enumerate(TENANTS):
            put(w, ns, cycled(df, k, c), replace=c > 0, files=None)
        w.register()


def _switch(spark, sf_dir, w):
    df = _plain(spark, sf_dir, w)
    for k, ns in enumerate(TENANTS):
        put(w, ns, hued(copies(df, k)).drop("c_mktsegment"), ids={"hue": 6})
    w.register()


def _rename(spark, sf_dir, w):
    df = _plain(spark, sf_dir, w)
    put(w, TENANTS[0], copies(df, 0).withColumnRenamed("c_mktsegment", "segment"))
    w.register()


def _discovery(spark, sf_dir, w):
    c = w.catalog
    for ns, tables in {
        "tenant_0": ("customer", "orders"), "tenant_1": ("customer", "orders"), "tenant_2": ("customer",),
        "other_1": ("customer",), "tenant_consolidated": ("customer",)
    }.items():
        for t in tables:
            c.storage.mkdirs(c.path(ns, t))
    w.config = Config("tenant_consolidated", SOURCE, source_namespace_pattern="tenant_*")


def _doubled(spark, sf_dir, w):
    _plain(spark, sf_dir, w, files=1)
    c, ns = w.catalog, w.config.target_namespace
    snap = c.latest(ns, "customer")
    again = c.manifest(ns, "customer").where(F.col("source_id") == "tenant_0").drop("added_version")
    c.commit(ns, "customer", snap, "append", again, None, snap.schema, snap.registry, SOURCE)


def _several(spark, sf_dir, w):
    customer, orders, lines = (base(spark, sf_dir, t) for t in ("customer", "orders", "lineitem"))
    parts = max(1, -(-lines.count() // LINES))
    owner = orders.select(F.col("o_orderkey").alias("k"), (F.col("o_custkey") % 3).alias("t")).repartition(parts, "k")
    lines = lines.repartition(parts, "l_orderkey").join(owner, F.col("l_orderkey") == F.col("k")).drop("k")
    for k, ns in enumerate(TENANTS):
        put(w, ns, tenant(customer, k), files=None)
        put(w, ns, tenant(orders, k, "o_custkey"), "orders", files=None)
        put(w, ns, lines.where(F.col("t") == k).drop("t"), "lineitem", files=None)
    w.runs.append(run(w.catalog, w.config))


def _vectors(spark, sf_dir, w):
    df = base(spark, sf_dir, "embeddings")
    for k, ns in enumerate(TENANTS):
        put(w, ns, tenant(df, k, "vec_id"), "embeddings", files=None)
    w.register("embeddings")


def _folders(spark, sf_dir, w):
    df = _plain(spark, sf_dir, w)
    with_ids(copies(df, 1)).repartition(1).write.parquet(f"{w.catalog.path(TENANTS[1], 'customer')}/data/2024")
    w.register()


_BUILD: dict[str, Callable] = {
    "F1": _f1, "F2": _new_column(1), "F3": _new_column(0), "F3b": _late, "F4": _collision, "F4again": _collision_again, "F4b": _collision_later, "F4c": _collision_nulls, "F4d": _same_name, "F4e": _two_columns, "F5": _cow, "F6": _soft, "F7": _cycles, "F8": _switch, "F9": _rename, "F10": _discovery, "F11": _doubled, "F12": _several, "F14": _vectors, "F15": _folders,
}

__all__ = ["OFFSET", "SOURCE", "TENANTS", "World", "base", "copies", "hued", "put", "struct", "tenant", "with_ids", "world"]
