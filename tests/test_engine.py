"""Configuration, globs, schemas, commits, refusals, the command line and the stream."""

import fnmatch
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from manyfold import cli, fixtures as fx, job
from manyfold.functions import glob_matches, glob_regex
from manyfold.operators import read, register_table, verify
from manyfold.operators.discovery import source_names
from manyfold.plans.schema import SchemaError, find, reserve, widen
from manyfold.sources import Catalog, CommitConflict, Config, ConfigError, from_environment, load_config


def test_config_errors(tmp_path):
    for kw, said in (({"source_namespaces": ("a", "b"), "source_namespace_pattern": "x*"}, "both"), ({}, "neither"), ({"source_namespaces": ("a",)}, "two"), ({"source_namespaces": ("a", "a")}, "repeats"), ({"source_namespaces": ("a", "t")}, "target")):
        with pytest.raises(ConfigError, match=said):
            Config("t", "src", **kw)
    with pytest.raises(ConfigError, match="target_namespace"):
        Config("", "src", ("a", "b"))
    with pytest.raises(ConfigError, match="no configuration"):
        load_config(tmp_path / "none.yaml")


def test_config_files(tmp_path):
    (tmp_path / "c.yaml").write_text("# a comment\ntarget_namespace: t\nsource_id_column: src\nsource_namespaces:\n  - a\n  - b\ntable_workers: 3\n")
    assert load_config(tmp_path / "c.yaml") == Config("t", "src", ("a", "b"), table_workers=3)
    (tmp_path / "c.json").write_text(json.dumps({"target_namespace": "t", "source_id_column": "src", "source_namespace_pattern": "a*"}))
    assert load_config(tmp_path / "c.json") == Config("t", "src", source_namespace_pattern="a*")
    assert from_environment({"TARGET_NAMESPACE": "t", "SOURCE_ID_COLUMN": "src", "SOURCE_NAMESPACES": " a , b "}) == Config("t", "src", ("a", "b"))
    with pytest.raises(ConfigError, match="whole"):
        from_environment({"TABLE_WORKERS": "x"})


@settings(max_examples=300, deadline=None)
@given(st.text("ab_0*?[]!-.", max_size=8), st.text("ab_0.-", max_size=6))
def test_glob_is_posix(pattern, name):
    import re

    java = glob_regex(pattern).replace("\\z", "\\Z")
    try:
        got = bool(re.match(java, name))
    except re.error:
        return
    assert got == fnmatch.fnmatchcase(name, pattern)


def test_glob_in_spark(spark):
    names = ["tenant_1", "tenant_12", "Tenant_1", "other", "tenant.1"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    for p in ("tenant_?", "tenant_*", "[!t]*", "tenant.1", "*"):
        assert {r.n for r in df.where(glob_matches(F.col("n"), p)).collect()} == {n for n in names if fnmatch.fnmatchcase(n, p)}


def test_schema_rules():
    f = reserve([{"id": 1, "name": "a", "type": "int"}], "src")
    assert find(f, "src")["id"] == 100_000
    assert find(widen(f, "b", "int", 7), "b")["id"] == 7
    assert find(widen(f, "b", "int"), "b")["id"] == 100_001
    for bad in (lambda: widen(f, "a", "int"), lambda: widen(f, "c", "int", 1), lambda: reserve(f, "a")):
        with pytest.raises(SchemaError):
            bad()


def _world(spark, tmp_path, sf_dir, n=60):
    w = fx.World(Catalog(spark, f"file://{tmp_path}/wh"), Config("tenant_consolidated", fx.SOURCE, fx.TENANTS))
    df = fx.base(spark, sf_dir, "customer").where(F.col("c_custkey") < n)
    for k, ns in enumerate(fx.TENANTS):
        fx.put(w, ns, fx.tenant(df, k))
    return w, df


def test_lost_race_is_planned_again(spark, tmp_path, sf_dir, monkeypatch):
    w, _ = _world(spark, tmp_path, sf_dir)
    ns = w.config.target_namespace
    w.catalog.ensure_namespace(ns)
    real, raced = Catalog.commit, []

    def late(self, *a, **b):
        if not raced:
            raced.append(1)
            raise CommitConflict("another writer")
        return real(self, *a, **b)

    monkeypatch.setattr(Catalog, "commit", late)
    assert w.register()["version"] == 1 and raced
    snap = w.catalog.latest(ns, "customer")
    snap.version -= 1
    monkeypatch.undo()
    with pytest.raises(CommitConflict):
        w.catalog.commit(ns, "customer", snap, "append", None, None, snap.schema, snap.registry, fx.SOURCE)


def test_changed_type_is_refused(spark, tmp_path, sf_dir):
    w, df = _world(spark, tmp_path, sf_dir)
    w.register()
    fx.put(w, "tenant_1", fx.copies(df, 1).withColumn("c_nationkey", F.col("c_nationkey").cast("string")))
    with pytest.raises(SchemaError, match="c_nationkey"):
        register_table(w.catalog, "customer", w.config)


def test_checkpoint_and_lifecycle(spark, tmp_path, sf_dir, monkeypatch):
    monkeypatch.setattr("manyfold.sources.catalog.CHECKPOINT", 2)
    w, df = _world(spark, tmp_path, sf_dir)
    w.register()
    for k in range(3):
        fx.put(w, "tenant_0", fx.tenant(df, 0).withColumn("c_mktsegment", F.lit(f"V{k}")), replace=True)
        r = w.register()
        assert (r["spliced_files"], r["orphaned_files"]) == (1, 1)
    got = read(w.catalog, "tenant_consolidated", "customer")
    assert got.count() == df.count()
    assert {r[0] for r in got.where(F.col(fx.SOURCE) == "tenant_0").select("c_mktsegment").distinct().collect()} == {"V2"}
    assert [s.operation for s in w.catalog.history("tenant_consolidated", "customer")] == ["append", *["overwrite"] * 3]


def test_all_null_column_is_no_drift(spark, tmp_path, sf_dir):
    w, df = _world(spark, tmp_path, sf_dir)
    w.register()
    fx.put(w, "tenant_1", fx.copies(df, 1).withColumn("hue", F.lit(None).cast("string")))
    r = w.register()
    assert r["spliced_files"] == 1 and not r["widened"]


def test_source_that_is_no_longer_listed_stays(spark, tmp_path, sf_dir):
    w, df = _world(spark, tmp_path, sf_dir)
    w.register()
    w.config = Config("tenant_consolidated", fx.SOURCE, fx.TENANTS[:2])
    r = w.register()
    assert r["unlisted"] == ["tenant_2"] and r["operation"] == "none"
    assert read(w.catalog, "tenant_consolidated", "customer").count() == df.count()


def test_files_in_sub_folders(spark, tmp_path, sf_dir):
    w, df = _world(spark, tmp_path, sf_dir)
    for k, at in ((0, "data"), (1, "a/b")):
        fx.with_ids(fx.copies(df, k), None).coalesce(1).write.parquet(f"{w.catalog.path(fx.TENANTS[k], 'customer')}/{at}")
    w.register()
    assert read(w.catalog, "tenant_consolidated", "customer").count() == 60 + fx.copies(df, 0).count() + fx.copies(df, 1).count()
    assert w.register()["operation"] == "none" and verify(w.catalog, w.config, ["customer"])[1]
    fx.with_ids(fx.copies(df, 2), None).coalesce(1).write.parquet(f"{w.catalog.path(fx.TENANTS[2], 'customer')}/day=1")
    with pytest.raises(ValueError, match="partition folder"):
        w.register()


def test_addresses_of_footers():
    from manyfold.sources.files import _address

    assert [_address(p) for p in ("s3a://b/k%20x.parquet", "s3n://b/k", "s3://b/k", "file:///s3a://k", "/a/b")] == ["s3://b/k%20x.parquet", "s3://b/k", "s3://b/k", "file:///s3a://k", "/a/b"]


def test_spliced_vectors_keep_their_values(spark, sf_dir):
    got = read(fx.world(spark, sf_dir, "F14").catalog, "tenant_consolidated", "embeddings").select("vec_id", "embedding")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, fx.base(spark, sf_dir, "embeddings").select("vec_id", "embedding").collect()))


def test_too_few_sources(spark, tmp_path, sf_dir):
    w, _ = _world(spark, tmp_path, sf_dir)
    with pytest.raises(ConfigError, match="at least two"):
        source_names(w.catalog, Config("tenant_consolidated", fx.SOURCE, source_namespace_pattern="tenant_2*"))


def test_command_line_and_job(spark, tmp_path, sf_dir, capsys):
    _world(spark, tmp_path, sf_dir)
    (tmp_path / "c.yaml").write_text(f"target_namespace: tenant_consolidated\nsource_id_column: {fx.SOURCE}\nsource_namespace_pattern: tenant_?\n")
    at = ["--warehouse", f"file://{tmp_path}/wh", "--config", str(tmp_path / "c.yaml")]
    assert cli.main(["verify", *at, "customer"], spark) == 1
    assert cli.main(["register", *at], spark) == 0
    assert cli.main(["verify", *at], spark) == 0
    assert "rows spliced 60" in capsys.readouterr().out
    env = {"TARGET_NAMESPACE": "tenant_consolidated", "SOURCE_ID_COLUMN": fx.SOURCE, "SOURCE_NAMESPACE_PATTERN": "tenant_?", "WAREHOUSE": f"file://{tmp_path}/wh"}
    assert job.handler({"tables": ["customer"]}, spark, env)["grand_total"] == 0


def test_env_file(tmp_path):
    from manyfold.sources.config import load_env

    (tmp_path / ".env").write_text("# c\nA=1\nexport B = 'x=y'\nC=\"q\"\nnothing\nspark.hadoop.fs.s3a.access.key=k\n")
    env = {"A": "old"}
    assert load_env(tmp_path / ".env", env) == {"spark.hadoop.fs.s3a.access.key": "k"}
    assert env == {"A": "old", "B": "x=y", "C": "q"} and load_env(tmp_path / "none", env) == {}


def test_summary_says_why_rows_were_rewritten(spark, tmp_path, sf_dir):
    w, df = _world(spark, tmp_path, sf_dir)
    w.register()
    fx.put(w, "tenant_0", fx.hued(fx.copies(df, 0)))
    fx.put(w, "tenant_1", fx.hued(fx.copies(df, 1), "shade"))
    r = w.register()
    assert r["collisions"] == [{"source": "tenant_1", "id": 6, "name": "shade"}]
    whole = {"tables": 1, "sources": 3, "seconds": 1, "slowest": [], "results": {"customer": r}} | {k: r[k] for k in ("spliced_rows", "rewritten_rows", "orphaned_files", "orphaned_rows")}
    said = cli.summary(whole | {"grand_total": 0})
    assert "its column shade has id 6" in said and "rewrites in every run" in said
    r = w.register()
    assert not r["collisions"] and "rewrit" not in cli.summary(whole | {"rewritten_rows": 0, "results": {"customer": r}, "grand_total": 0}).replace("rewritten 0", "")


def test_stream_registers_what_has_arrived(spark, tmp_path, sf_dir):
    from manyfold.streaming import register_available

    w, df = _world(spark, tmp_path, sf_dir)
    go = lambda: register_available(w.catalog, w.config, "customer", f"file://{tmp_path}/ck").awaitTermination()
    go()
    fx.put(w, "tenant_2", fx.copies(df, 2))
    go()
    go()
    assert read(w.catalog, "tenant_consolidated", "customer").count() == 60 + 20
    assert w.catalog.latest("tenant_consolidated", "customer").version == 2


def _meta(w):
    return w.catalog._meta("tenant_consolidated", "customer")


def test_torn_version_is_no_version(spark, tmp_path, sf_dir):
    w, df = _world(spark, tmp_path, sf_dir)
    w.register()
    for torn in ("", '{"version": 2, "oper'):
        at = tmp_path / "wh/tenant_consolidated/customer/_meta" / f"{w.catalog.latest('tenant_consolidated', 'customer').version + 1:08d}.json"
        at.write_text(torn)
        assert read(w.catalog, "tenant_consolidated", "customer").count() == w.catalog.manifest("tenant_consolidated", "customer").agg(F.sum("record_count")).first()[0]
        fx.put(w, "tenant_2", fx.copies(df, 2))
        assert w.register()["spliced_files"] == 1
    assert read(w.catalog, "tenant_consolidated", "customer").count() == 60 + 40


def test_a_version_is_published_whole_and_once(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    from manyfold.sources.storage import Storage

    s, at = Storage(spark), f"file://{tmp_path}/v 1/00000001.json"
    s.mkdirs(f"file://{tmp_path}/v 1")
    texts = [json.dumps({"writer": k, "filling": "x" * 200_000}) for k in range(8)]
    seen, ended = [], []

    def watch():
        while not ended:
            if s.versions(f"file://{tmp_path}/v 1"):
                seen.append(json.loads(s.read_text(at)))

    with ThreadPoolExecutor(9) as pool:
        watching = pool.submit(watch)
        won = list(pool.map(lambda t: s.create(at, t), texts))
        ended.append(1)
        watching.result()
    assert sum(won) == 1 and s.read_text(at) == texts[won.index(True)]
    assert all(x == json.loads(texts[won.index(True)]) for x in seen)
    assert [p.name for p in (tmp_path / "v 1").iterdir() if not p.name.endswith(".crc")] == ["00000001.json"]


def test_no_footer_is_read_twice(spark, tmp_path, sf_dir, monkeypatch):
    from manyfold.operators.register import load_sources

    w, df = _world(spark, tmp_path, sf_dir)
    w.register()
    for p in (tmp_path / "wh").glob("tenant_[0-2]/customer/*.parquet"):
        size = p.stat().st_size
        p.write_bytes(b"\0" * size)  # a footer that is opened fails
    for p in (tmp_path / "wh").glob("tenant_[0-2]/customer/.*.crc"):
        p.unlink()
    r = w.register()
    assert (r["operation"], r["already_files"], r["already_rows"] if "already_rows" in r else 60) == ("none", 3, 60)
    fx.put(w, "tenant_1", fx.hued(fx.copies(df, 1)))
    assert w.register()["widened"] == [{"id": 6, "name": "hue", "source": "tenant_1"}]
    held = w.catalog.manifest("tenant_consolidated", "customer")
    now = load_sources(w.catalog, list(fx.TENANTS), "customer", held=held)
    assert now.agg(F.sum("record_count")).first()[0] == 80 and now.where("size(column_stats) >= 5").count() == 4


def test_bounds_are_compared_as_values(tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    from manyfold.sources.files import _footer

    at = tmp_path / "f.parquet"
    pq.write_table(pa.table({"n": [9, 10, 100, 2], "s": ["9", "10", "100", "2"], "d": [9.5, -10.0, 1e3, None], "none": pa.nulls(4, pa.int32())}), at, row_group_size=1)
    got = {c["name"]: (c["lower"], c["upper"], c["null_count"]) for c in _footer(f"file://{at}")[1]}
    assert got == {"n": ("2", "100", 0), "s": ("10", "9", 0), "d": ("-10.0", "1000.0", 1), "none": (None, None, 4)}


def test_one_rewrite_for_many_files(spark, tmp_path, sf_dir):
    w, df = _world(spark, tmp_path, sf_dir)
    w.register()
    fx.put(w, "tenant_0", fx.hued(fx.copies(df, 0)))
    fx.put(w, "tenant_1", fx.hued(fx.copies(df, 1), "shade"), files=4)
    r = w.register()
    assert r["rewritten_files"] == 4
    held = w.catalog.manifest("tenant_consolidated", "customer").where("origin = 'rewritten'").collect()
    assert len({h["file_path"].split("/rewritten-")[1].split("/")[0] for h in held}) == 1 and len({h["rewrite_of"] for h in held}) == 4
    gone = next(p for p in (tmp_path / "wh/tenant_1/customer").glob("*.parquet") if p.name in {h["rewrite_of"].rsplit("/", 1)[1] for h in held})
    rows = spark.read.parquet(f"file://{gone}").count()
    gone.unlink()
    assert w.register()["orphaned_rows"] == rows
    assert read(w.catalog, "tenant_consolidated", "customer").where(F.col(fx.SOURCE) == "tenant_1").count() == 20 + 20 - rows


def test_lost_race_leaves_no_rewritten_files(spark, tmp_path, sf_dir, monkeypatch):
    w, df = _world(spark, tmp_path, sf_dir)
    w.register()
    fx.put(w, "tenant_0", fx.hued(fx.copies(df, 0)))
    fx.put(w, "tenant_1", fx.hued(fx.copies(df, 1), "shade"))
    real, raced = Catalog.commit, []

    def late(self, *a, **b):
        if not raced:
            raced.append(1)
            raise CommitConflict("another writer")
        return real(self, *a, **b)

    monkeypatch.setattr(Catalog, "commit", late)
    w.register()
    data = tmp_path / "wh/tenant_consolidated/customer/data/tenant_1"
    assert raced and len(list(data.iterdir())) == 1
    (data / "rewritten-of-a-crash").mkdir()
    (tmp_path / "wh/tenant_consolidated/customer/_meta/data/00000009-dead").mkdir()
    before = sorted(map(str, read(w.catalog, "tenant_consolidated", "customer").collect()))
    assert not w.catalog.clean_up("tenant_consolidated", "customer")
    assert len(w.catalog.clean_up("tenant_consolidated", "customer", older_than=-5)) == 2
    assert sorted(map(str, read(w.catalog, "tenant_consolidated", "customer").collect())) == before


def test_namespaces_of_several_levels(spark, tmp_path, sf_dir):
    df = fx.base(spark, sf_dir, "customer").where("c_custkey < 60")
    names = ["eu.a b", "eu.b", "us.a+c%d"]
    w = fx.World(Catalog(spark, f"file://{tmp_path}/wh", levels=2), Config("all.one", fx.SOURCE, source_namespace_pattern="[eu]*"))
    for k, ns in enumerate(names):
        fx.put(w, ns, fx.tenant(df, k))
    assert source_names(w.catalog, w.config) == names
    w.register()
    got = read(w.catalog, "all.one", "customer").groupBy(fx.SOURCE).count().collect()
    assert sorted(map(tuple, got)) == [(n, 20) for n in names]
    checks, well = verify(w.catalog, w.config, ["customer"])
    assert well
    for n in names:
        assert read(w.catalog, "all.one", "customer").where(F.col(fx.SOURCE) == n).count() == 20


def test_verification_sees_what_registration_overlooked(spark, tmp_path, sf_dir, monkeypatch):
    w, df = _world(spark, tmp_path, sf_dir)
    fx.with_ids(fx.copies(df, 0)).coalesce(1).write.parquet(f"{w.catalog.path('tenant_0', 'customer')}/deep")
    real = Catalog.source_files
    monkeypatch.setattr(Catalog, "source_files", lambda self, ns, t: [f for f in real(self, ns, t) if "/deep/" not in f[0]])
    w.register()
    checks, well = verify(w.catalog, w.config, ["customer"])
    assert not well and "tenant_0: 40 and 20" in [r["detail"] for r in checks.collect() if not r["ok"]][0]


def test_tables_of_the_sessions_catalog(spark, tmp_path, sf_dir):
    from manyfold.sources import TableCatalog

    df = fx.base(spark, sf_dir, "customer").where("c_custkey < 60")
    w = fx.World(TableCatalog(spark, f"file://{tmp_path}/wh"), Config("joined", fx.SOURCE, source_namespace_pattern="crm_?"))
    spark.conf.set("spark.sql.parquet.fieldId.write.enabled", "true")
    try:
        for k, ns in enumerate(("crm_0", "crm_1", "crm_2")):
            at = {"crm_0": "a/crm_0.db", "crm_1": "b/elsewhere", "crm_2": "c/crm_2.db"}[ns]
            spark.sql(f"CREATE DATABASE {ns} LOCATION 'file://{tmp_path}/{at}'")
            fx.with_ids(fx.tenant(df, k)).write.format("parquet").saveAsTable(f"{ns}.customer")
        assert source_names(w.catalog, w.config) == ["crm_0", "crm_1", "crm_2"]
        w.register()
        fx.with_ids(fx.hued(fx.copies(df, 0))).write.format("parquet").saveAsTable("crm_0.more")
        fx.with_ids(fx.hued(fx.copies(df, 1))).write.format("parquet").mode("append").save(f"file://{tmp_path}/b/elsewhere/customer")
        r = w.register()
        assert r["spliced_files"] >= 1 and [x["name"] for x in r["widened"]] == ["hue"]
        got = read(w.catalog, "joined", "customer").groupBy(fx.SOURCE).count().collect()
        assert sorted(map(tuple, got)) == [("crm_0", 20), ("crm_1", 40), ("crm_2", 20)]
        assert read(w.catalog, "joined", "customer").where(F.col(fx.SOURCE) == "crm_1").where("hue IS NOT NULL").count() == 20
        assert verify(w.catalog, w.config)[1]
    finally:
        for ns in ("crm_0", "crm_1", "crm_2"):
            spark.sql(f"DROP DATABASE IF EXISTS {ns} CASCADE")


def test_bounds_leave_files_out(spark, tmp_path, sf_dir):
    from manyfold.operators.verify import planned_files

    w, df = _world(spark, tmp_path, sf_dir)
    nan = F.when(F.col("c_custkey") % 2 == 0, F.lit(float("nan"))).otherwise(F.col("c_acctbal"))
    for k, (a, b) in enumerate(((0, 20), (20, 40), (40, 60))):
        some = fx.copies(df, k, a, b).withColumn("c_acctbal", nan)
        fx.put(w, fx.TENANTS[k], fx.hued(some, "hue" if k else "shade"))
    w.register()
    fx.put(w, "tenant_0", fx.copies(df, 0).withColumn("c_name", F.lit(None).cast("string")))
    w.register()
    whole = read(w.catalog, "tenant_consolidated", "customer")
    total = planned_files(whole)
    assert total == 7
    few = 0
    for where in ([("c_custkey", "=", 900_041)], [("c_custkey", "<", 3), ("c_custkey", ">", 0)], [("c_custkey", ">=", 900_059)], [("c_acctbal", ">", 1e12)], [("c_acctbal", "<", -1e12)], [("c_name", "<=", "Customer#000000010")], [("hue", ">", "a")], [("shade", "=", "BUILDING!")], [(fx.SOURCE, "=", "tenant_2"), ("c_custkey", "<", 30)], [("c_nationkey", "=", 7)]):
        got = read(w.catalog, "tenant_consolidated", "customer", where=where)
        ops = {"=": "=", "<": "<", ">": ">", "<=": "<=", ">=": ">="}
        want = whole.where(" AND ".join(f"`{c}` {ops[o]} {v!r}" for c, o, v in where))
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
        few += planned_files(got) < total
    assert few >= 7
    with pytest.raises(SchemaError, match="none_such"):
        read(w.catalog, "tenant_consolidated", "customer", where=[("none_such", "=", 1)])
