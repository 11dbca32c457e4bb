"""Every engine query against its SQL on DuckDB."""

import duckdb
import pytest
from pyspark.sql import functions as F

from manyfold import fixtures, queries as q
from manyfold.fixtures import world

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_query_matches_sql(spark, sf_dir, duck, name):
    df = q.queries()[name](spark, sf_dir)
    want = duck.sql(q.oracle_sql()[name])
    cols = sorted(df.columns)
    assert cols == sorted(want.columns)
    at = [want.columns.index(c) for c in cols]
    got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)
    assert got == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=str)


def test_slowest_tables_of_a_run(spark, sf_dir):
    slow = world(spark, sf_dir, "F12").runs[-1]["slowest"]
    assert len(slow) == 3 and [t for _, t in slow] == sorted((t for _, t in slow), reverse=True)


@pytest.fixture
def parted(spark, sf_dir, tmp_path):
    """The tables that tenants are cut from, in three files each."""
    for t in ("customer", "orders", "lineitem", "embeddings"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").repartition(3).write.parquet(f"{tmp_path}/{t}.parquet")
    return str(tmp_path)


def _matches(spark, parted, names):
    c = duckdb.connect()
    for t in ("customer", "orders", "lineitem", "embeddings"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{parted}/{t}.parquet/*.parquet'")
    for name in names:
        df, want = q.queries()[name](spark, parted), c.sql(q.oracle_sql()[name])
        at = [want.columns.index(x) for x in df.columns]
        assert sorted(map(tuple, df.collect()), key=str) == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=str), name


def _largest_shares(spark, parted, fixture, table):
    """Of each source's rows, the share of its largest file, which one task has written."""
    w = world(spark, parted, fixture)
    held = w.catalog.manifest(w.config.target_namespace, table).groupBy("source_id").agg((F.max("record_count") / F.sum("record_count")).alias("share"))
    return [r["share"] for r in held.collect()]


def test_no_task_writes_a_whole_table_of_a_run(spark, parted, monkeypatch):
    monkeypatch.setattr(fixtures, "LINES", 1500, raising=False)
    _matches(spark, parted, ["run_summary", "consolidated_revenue"])
    for t in ("customer", "orders", "lineitem"):
        found = _largest_shares(spark, parted, "F12", t)
        assert len(found) == 3 and max(found) < 0.6, t


@pytest.mark.parametrize("fixture,table,names", [
    ("F12", "lineitem", ["verify_all"]), ("F2", "customer", ["widen_other_source", "time_travel_rows"]), ("F6", "customer", ["soft_delete"]),
    ("F7", "customer", ["two_cycles"]), ("F14", "embeddings", ["splice_vectors", "splice_vector_values"]), ("F15", "customer", ["splice_subfolders"])
])
def test_no_task_writes_a_whole_table_elsewhere(spark, parted, monkeypatch, fixture, table, names):
    monkeypatch.setattr(fixtures, "LINES", 1500, raising=False)
    _matches(spark, parted, names)
    assert max(_largest_shares(spark, parted, fixture, table)) < 0.6
