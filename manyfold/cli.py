"""Command line: ``python -m manyfold.cli register|verify --warehouse DIR --config FILE [TABLE...]``."""

from __future__ import annotations

import argparse
import logging
import os
import sys

from pyspark.sql import SparkSession

from .operators import run, verify
from .sources import Catalog, ConfigError, load_config
from .sources.config import load_env


def summary(r: dict) -> str:
    """The report of a run; notes only where there is something to note."""
    lines = [
        f"{r['tables']} tables from {r['sources']} sources in {r['seconds']} s",
        f"rows spliced {r['spliced_rows']}, rewritten {r['rewritten_rows']}, together {r['grand_total']}"
    ]
    if r["orphaned_files"]:
        lines.append(f"retired {r['orphaned_files']} files with {r['orphaned_rows']} rows that their sources have replaced; their entries alone were changed, and the version is an overwrite")
    for t, x in r["results"].items():
        lines += [f"{t}: new column {w['name']} (id {w['id']}) from {w['source']}" for w in x["widened"]]
        lines += [f"{t}: {n['source']} calls {n['from']} now {n['to']}; the table keeps {n['from']}" for n in x["renamed"]]
        lines += [f"{t}: rows of {c['source']} were rewritten, as its column {c['name']} has id {c['id']}, which is another column's" for c in x["collisions"]]
        lines += [f"{t}: {s} is registered and no longer a source; its rows stay" for s in x["unlisted"]]
    if r["rewritten_rows"]:
        lines.append("a rewrite is due once for each file with a collision; a source that has rewrites in every run changes its columns more than it should")
    lines.append("slowest: " + ", ".join(f"{t} {s} s" for t, s in r["slowest"]))
    return "\n".join(lines)


def session(settings: dict[str, str]) -> SparkSession:
    builder = SparkSession.builder.appName("manyfold").config("spark.scheduler.mode", "FAIR")
    for k, v in settings.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="manyfold", description=__doc__)
    p.add_argument("action", choices=("register", "verify"))
    p.add_argument("tables", nargs="*")
    p.add_argument("--config", default="config.yaml")
    p.add_argument("--warehouse", required=True)
    p.add_argument("--levels", type=int, default=1, help="folders that a namespace's name joins")
    p.add_argument("--env", default=".env", help="a file of credentials and settings, if it is there")
    a = p.parse_intermixed_args(args)
    logging.basicConfig(level=os.environ.get("LOG_LEVEL", "INFO"))
    try:
        settings = load_env(a.env)
        config = load_config(a.config)
        catalog = Catalog(spark or session(settings), a.warehouse, a.levels)
        if a.action == "register":
            print(summary(run(catalog, config, a.tables or None)))
            return 0
        checks, well = verify(catalog, config, a.tables or None)
        for r in checks.collect():
            print("ok  " if r["ok"] else "FAIL", r["table_name"], r["check"], r["detail"])
        return int(not well)
    except (ConfigError, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
