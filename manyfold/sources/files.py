"""File entries from Parquet footers, read on the executors; no data page is touched."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def columns(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in kinds.items()])


_S, _L, _I = T.StringType(), T.LongType(), T.IntegerType()
STATS = T.ArrayType(columns(field_id=_I, name=_S, kind=_S, value_count=_L, null_count=_L, lower=_S, upper=_S, nested=T.BooleanType()))
LISTED = columns(source_id=_S, source_ordinal=_I, file_path=_S, file_size_in_bytes=_L, modified=_L)
ENTRY = columns(source_id=_S, source_ordinal=_I, file_path=_S, file_format=_S, file_size_in_bytes=_L, modified=_L, record_count=_L, column_stats=STATS)


def _address(path: str) -> str:
    """The address by which pyarrow knows a file: Hadoop's s3a and s3n are its s3."""
    scheme, sep, rest = path.partition("://")
    return f"s3://{rest}" if sep and scheme.lower() in ("s3a", "s3n") else path


def store_of(path: str) -> tuple[fs.FileSystem, str]:
    """The store of an address and the file's name in it, for executors."""
    return fs.FileSystem.from_uri(_address(path))


def _footer(path: str) -> tuple[int, list[dict]]:
    import pyarrow.parquet as pq

    store, at = store_of(path)
    with store.open_input_file(at) as f:
        meta = pq.ParquetFile(f).metadata
        columns: dict[str, dict] = {}
        arrow = meta.schema.to_arrow_schema()
        ids = {field.name: int((field.metadata or {}).get(b"PARQUET:field_id", -1)) for field in arrow}
        kinds = _kinds(arrow, (meta.metadata or {}).get(b"org.apache.spark.sql.parquet.row.metadata"))
        blank = lambda n: {"field_id": ids[n], "name": n, "kind": kinds[n], "value_count": 0, "null_count": 0, "lower": None, "upper": None, "nested": pa.types.is_nested(arrow.field(n).type)}
        for g in range(meta.num_row_groups):
            for c in range(meta.num_columns):
                col = meta.row_group(g).column(c)
                top = col.path_in_schema.split(".")[0]
                nested = "." in col.path_in_schema
                x = columns.setdefault(top, blank(top))
                s = col.statistics
                # a column without a null count may hold anything: count no nulls, so that it drifts
                nulls = s.null_count if s is not None and s.has_null_count and not nested else 0
                x["value_count"] += meta.row_group(g).num_rows if not nested else 0
                x["null_count"] += nulls
                if s is not None and s.has_min_max and not nested:
                    # compared as values, written as text at the end
                    x["lower"] = s.min if x["lower"] is None or s.min < x["lower"] else x["lower"]
                    x["upper"] = s.max if x["upper"] is None or s.max > x["upper"] else x["upper"]
        for field in arrow:
            x = columns.setdefault(field.name, blank(field.name))
            x.update({k: None if x[k] is None else str(x[k]) for k in ("lower", "upper")})
        return meta.num_rows, [columns[field.name] for field in arrow]


def _kinds(arrow: pa.Schema, written: bytes | None) -> dict[str, str]:
    """Each column's Spark type: as Spark noted it in the file, else as Arrow's type maps to one."""
    from pyspark.sql.pandas.types import from_arrow_type

    noted = {f.name: f.dataType.simpleString() for f in T.StructType.fromJson(json.loads(written))} if written else {}
    return {f.name: noted.get(f.name) or from_arrow_type(f.type, prefer_timestamp_ntz=True).simpleString() for f in arrow}


def file_entries(spark: SparkSession, listed: list[tuple], held: DataFrame | None = None) -> DataFrame:
    """ENTRY rows of (source, ordinal, path, bytes, modified) tuples; footers are read in parallel.

    ``held``, a manifest, spares the footers of files that it has at the same size. A rewritten
    file's origin has no columns then: the manifest knows those of the rewrite, and what the
    origin's were is in the registry."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            for r in rows:
                r["record_count"], r["column_stats"] = _footer(r["file_path"])
                r["file_format"] = "PARQUET"
            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    if not listed:
        return spark.createDataFrame([], ENTRY)
    every = spark.createDataFrame(listed, LISTED)
    slices = max(1, min(len(listed) // 16, 4 * spark.sparkContext.defaultParallelism))
    if held is None:
        return every.repartition(slices).mapInArrow(f, ENTRY)
    rewritten, key = F.col("rewrite_of").isNotNull(), ["source_id", "file_path"]
    there = held.select(
        "source_id", F.coalesce("rewrite_of", "file_path").alias("file_path"), "file_format", "record_count",
        F.when(rewritten, F.array().cast(STATS)).otherwise(F.col("column_stats")).alias("column_stats"),
        F.when(~rewritten, F.col("file_size_in_bytes")).alias("size")
    )
    both = every.join(there.dropDuplicates(key), key, "left")
    same = F.col("record_count").isNotNull() & F.coalesce(F.col("size") == F.col("file_size_in_bytes"), F.lit(True))
    opened = both.where(~same).select(*LISTED.names).repartition(slices).mapInArrow(f, ENTRY)
    return both.where(same).select(*ENTRY.names).unionByName(opened)


_ARROW = pa.schema(
    [
        ("source_id", pa.string()), ("source_ordinal", pa.int32()), ("file_path", pa.string()), ("file_format", pa.string()), ("file_size_in_bytes", pa.int64()), ("modified", pa.int64()), ("record_count", pa.int64()),
        (
            "column_stats",
            pa.list_(pa.struct([("field_id", pa.int32()), ("name", pa.string()), ("kind", pa.string()), ("value_count", pa.int64()), ("null_count", pa.int64()), ("lower", pa.string()), ("upper", pa.string()), ("nested", pa.bool_())]))
        ),
    ]
)
