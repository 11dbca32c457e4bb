"""A stream over the sources' folders that registers when files have arrived.

The stream only tells that something is new; what to do is planned from the listing, as always, so a
batch that is run twice changes nothing. With ``availableNow`` it is one scheduled run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators import register_table
from ..operators.discovery import source_names
from ..sources import Catalog, Config


def register_available(catalog: Catalog, config: Config, table: str, checkpoint: str) -> StreamingQuery:
    """Register ``table`` if its sources hold files that this stream has not seen yet."""
    spark = catalog.spark
    binary = T.StructType([T.StructField("path", T.StringType()), T.StructField("modificationTime", T.TimestampType()), T.StructField("length", T.LongType()), T.StructField("content", T.BinaryType())])
    stream = None
    for ns in source_names(catalog, config):
        one = spark.readStream.format("binaryFile").schema(binary).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(catalog.path(ns, table)).select("path")
        stream = one if stream is None else stream.union(one)

    def arrived(batch: DataFrame, _: int) -> None:
        if batch.limit(1).count():
            register_table(catalog, table, config)

    return stream.writeStream.foreachBatch(arrived).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
