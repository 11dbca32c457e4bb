"""The scheduled form: one call is one full run, configured by the environment."""

from __future__ import annotations

import os
from collections.abc import Mapping

from pyspark.sql import SparkSession

from .operators import run
from .sources import Catalog, from_environment


def handler(event: Mapping | None = None, spark: SparkSession | None = None, env: Mapping[str, str] | None = None) -> dict:
    """Run for all common tables, or for those the event names under ``tables``; gives the summary
    as plain values. WAREHOUSE names the folder with the namespaces."""
    env = os.environ if env is None else env
    config = from_environment(env)
    spark = spark or SparkSession.builder.appName("manyfold").config("spark.scheduler.mode", "FAIR").getOrCreate()
    got = run(Catalog(spark, env["WAREHOUSE"]), config, list((event or {}).get("tables") or []) or None)
    return {k: v for k, v in got.items() if k != "results"} | {"slowest": [list(x) for x in got["slowest"]]}


if __name__ == "__main__":
    print(handler())
