"""Sharding by jump consistent hashing (Lamping and Veach): no ring table, and appending a shard
moves rows only into the new one."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import partitions_for, quoted, ship, stage, text_of

#: Fixed values of jump consistent hashing.
MULTIPLIER, SCALE = np.uint64(2862933555777941757), float(1 << 31)


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each unsigned 64-bit key: about ln(shards) vectorised steps."""
    if shards < 1:
        raise ValueError("at least one shard is needed")
    out = np.zeros(len(keys), dtype=np.int64)
    open_, key, at = np.arange(len(keys)), keys.astype(np.uint64), np.zeros(len(keys), dtype=np.int64)
    while len(open_):
        out[open_] = at
        with np.errstate(over="ignore"):
            key = key * MULTIPLIER + np.uint64(1)
        at = np.floor((at + 1) * (SCALE / ((key >> np.uint64(33)) + np.uint64(1)).astype(np.float64))).astype(np.int64)
        on = at < shards
        open_, key, at = open_[on], key[on], at[on]
    return out


def shard_of(key: Column, shards: int) -> Column:
    """The shard of a long key; null counts as key 0."""

    @F.pandas_udf("int")
    def f(keys: pd.Series) -> pd.Series:
        return pd.Series(jump(keys.to_numpy(dtype=np.int64).view(np.uint64), shards).astype(np.int32))

    return f(F.coalesce(key.cast("long"), F.lit(0).cast("long")))


def shard(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", overhead: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of each row.

    Law ``key``: the identifier and the number of shards decide, so equal identifiers meet in a
    shard. Slots are gapless from 0 in identifier order (null first), ties by checksum and size;
    rows alike in all of these are interchangeable. A null text has no bytes. No shard is ever in
    one task: rows are range partitioned by identifier, and a partition's slots start behind the
    rows that its predecessors have in the same shard.
    """
    spark = docs.sparkSession
    ship(spark)
    text = text_of(text_col)
    rows = docs.select(
        quoted(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + overhead).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32")
    )
    rows = rows.withColumns({"shard": shard_of(F.col("doc_id"), shards), "grown_shard": shard_of(F.col("doc_id"), shards + 1), "salt": F.hash(F.monotonically_increasing_id())})
    rows = stage(spark, rows, "sharded")
    n = partitions_for(spark, rows.count(), 1_000_000)
    order = ("doc_id", "text_crc32", "size", "salt")
    rows = stage(spark, rows.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()), "ranged")
    starts = rows.groupBy("part", "shard").agg(F.count("*").alias("n"))
    starts = starts.select(
        F.col("part").alias("p"), F.col("shard").alias("s"),
        (F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n")).alias("start")
    )
    local = F.row_number().over(Window.partitionBy("part", "shard").orderBy(*order)) - 1
    rows = rows.withColumn("local", local).join(starts, (F.col("part") == F.col("p")) & (F.col("shard") == F.col("s")))
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
        (F.col("start") + F.col("local")).cast("long").alias("slot"), "grown_shard"
    )
