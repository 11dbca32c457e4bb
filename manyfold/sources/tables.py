"""Sources that are tables of Spark's own catalog, in place of folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .catalog import Catalog


class TableCatalog(Catalog):
    """Namespaces are the databases of the session's catalog, source tables its unpartitioned Parquet
    tables, wherever they lie. Consolidated tables stay in the warehouse folder."""

    def namespaces(self) -> DataFrame:
        return self.spark.createDataFrame([(d.name,) for d in self.spark.catalog.listDatabases()], "namespace string")

    def tables(self, namespaces: list[str]) -> DataFrame:
        rows = [(ns, t.name) for ns in namespaces for t in self.spark.catalog.listTables(ns) if not t.isTemporary and t.tableType != "VIEW"]
        return self.spark.createDataFrame(rows, "namespace string, table string")

    def _described(self, namespace: str, table: str) -> dict[str, str]:
        rows = self.spark.sql(f"DESCRIBE TABLE EXTENDED {_name(namespace)}.{_name(table)}").collect()
        at = next(k for k, r in enumerate(rows) if r[0].startswith("# Detailed"))
        if any(r[0].startswith("# Partition") for r in rows[:at]):
            raise ValueError(f"{namespace}.{table} is partitioned; a column that only folders' names hold can't be spliced")
        return {r[0]: r[1] for r in rows[at + 1 :]}

    def source_location(self, namespace: str, table: str) -> str:
        return self.storage.qualified(self._described(namespace, table)["Location"])

    def has_source(self, namespace: str, table: str) -> bool:
        return self.spark.catalog.tableExists(f"{_name(namespace)}.{_name(table)}")

    def source_files(self, namespace: str, table: str) -> list[tuple[str, int, int]]:
        found = self._described(namespace, table)
        if found.get("Provider", "").lower() != "parquet":
            raise ValueError(f"{namespace}.{table} is no Parquet table")
        return [f for f in self.storage.walk(self.storage.qualified(found["Location"])) if f[0].endswith(".parquet") and f[1]]

    def source_of(self, table: str, names: set[str], file_path: Column) -> Column:
        """The source whose table's folder holds the file: the folder that tells the sources apart."""
        there = {n: self.address(self.source_location(n, table)).split("/") for n in names if self.has_source(n, table)}
        if not there:
            return F.lit(None).cast("string")
        short = min(map(len, there.values()))
        k = next((k for k in range(short) if len({p[k] for p in there.values()}) == len(there)), None)
        if k is None:  # no one folder does: by the whole one
            starts = [F.when(F.startswith(file_path, F.lit("/".join(p) + "/")), F.lit(n)) for n, p in sorted(there.items())]
            return F.coalesce(*starts)
        part, by = F.split_part(file_path, F.lit("/"), F.lit(k + 1)), {p[k]: n for n, p in there.items()}
        if all(p == f"{n}.db" for p, n in by.items()):
            return F.substring_index(part, ".db", 1)
        if all(p == n for p, n in by.items()):
            return part
        return F.element_at(F.create_map(*(F.lit(x) for pair in sorted(by.items()) for x in pair)), part)


def _name(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"
