"""Which namespaces and tables take part."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import glob_matches
from ..sources import Catalog, Config, ConfigError

log = logging.getLogger(__name__)


def resolve_namespaces(catalog: Catalog, config: Config) -> DataFrame:
    """(namespace) in source order: the listed ones as they are, or those that match the pattern,
    without the target, sorted. A pattern is resolved anew on every run."""
    spark = catalog.spark
    if config.source_namespaces:
        listed = [(k, n) for k, n in enumerate(config.source_namespaces)]
        return spark.createDataFrame(listed, "k int, namespace string").orderBy("k").select("namespace")
    found = catalog.namespaces().where(glob_matches(F.col("namespace"), config.source_namespace_pattern) & (F.col("namespace") != config.target_namespace)).orderBy("namespace")
    return found


def source_names(catalog: Catalog, config: Config) -> list[str]:
    """The namespaces of a run; fewer than two are an error."""
    names = [r[0] for r in resolve_namespaces(catalog, config).collect()]
    if len(names) < 2:
        raise ConfigError(f"the pattern {config.source_namespace_pattern} matches {len(names)} namespaces ({', '.join(names) or 'none'}); at least two are needed")
    log.info("sources: %s", ", ".join(names))
    return names


def common_tables(catalog: Catalog, namespaces: list[str]) -> DataFrame:
    """(table) in every namespace, sorted."""
    every = catalog.tables(namespaces).groupBy("table").agg(F.countDistinct("namespace").alias("n"))
    return every.where(F.col("n") == len(set(namespaces))).select("table").orderBy("table")


def skipped_tables(catalog: Catalog, namespaces: list[str]) -> DataFrame:
    """(table, namespaces): in some namespaces but not in all, sorted."""
    every = catalog.tables(namespaces).groupBy("table").agg(F.countDistinct("namespace").alias("namespaces"))
    return every.where(F.col("namespaces") < len(set(namespaces))).orderBy("table")
