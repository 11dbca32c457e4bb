"""The pipeline's stages against brute-force versions, each on its own input."""

import re
import zlib

import corpus_pipeline as cp
import duckdb
import numpy as np
import pytest
from brute import components, fingerprint
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from manyfold.llm import queries as q


@pytest.fixture(scope="module")
def steps(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [docs.collect()]
    for name, f in cp.STAGES:
        docs = spark.createDataFrame(out[-1], docs.schema)
        docs = f(spark, docs, sf_dir)
        out.append(docs.collect())
    return out


def test_stages_return_the_columns_of_documents(steps):
    for rows in steps[1:-1]:
        assert rows[0].__fields__ == steps[0][0].__fields__


def test_filters_keep_clean_documents(steps, spark, sf_dir):
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    for before, after, bad in ((steps[0], steps[1], lambda r: r["toxic"] == 1), (steps[1], steps[2], lambda r: r["quality"] == 0)):
        kept = {r["doc_id"] for r in after}
        seen = [(bad(labels[r["doc_id"]]), r["doc_id"] in kept) for r in before if r["doc_id"] in labels]
        clean = [k for b, k in seen if not b]
        assert sum(clean) / len(clean) > 0.95
        assert [r for r in before if r["doc_id"] in kept] == sorted(after, key=lambda r: [x["doc_id"] for x in before].index(r["doc_id"]))


def test_exact_stage(steps):
    best = {}
    for r in steps[2]:
        k = re.sub(r"[\x20\x09-\x0D]", "", r["text"] or "")
        best[k] = min(best.get(k, (1, None)), (-len(r["text"] or ""), r["doc_id"]))
    assert sorted(r["doc_id"] for r in steps[3]) == sorted(i for _, i in best.values())


def test_near_stage(steps):
    rows = sorted(steps[3], key=lambda r: r["doc_id"])
    fp = [fingerprint(r["text"]) for r in rows]
    roots = components(len(rows), [(a, b) for a in range(len(rows)) for b in range(a) if (fp[a] ^ fp[b]).bit_count() <= 3])
    assert sorted(r["doc_id"] for r in steps[4]) == [rows[k]["doc_id"] for k in range(len(rows)) if roots[k] == k]


def test_packing_stage(steps):
    t = Tokenizer.from_file(q.tokenizer_file("byte_bpe_50k.json"))
    ids = {r["doc_id"]: np.array([*t.encode(r["text"] or "", add_special_tokens=False).ids, 1], dtype="<u4") for r in steps[4]}
    assert {r["doc_id"] for r in steps[5]} == set(ids)
    assert sum(r["length"] for r in steps[5]) == sum(map(len, ids.values()))
    for r in steps[5]:
        assert zlib.crc32(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"]


def test_odd_and_empty_tables(spark, sf_dir, odd, none, rows):
    docs, empty = (d.withColumn("n_chars", F.length("text").cast("long")) for d in (odd, none))
    for name, f in cp.STAGES:
        out = f(spark, docs, sf_dir)
        assert f(spark, empty, sf_dir).count() == 0
        if name != "packing":
            assert out.columns == docs.columns
    assert out.select("doc_id").distinct().count() == len({i for i, *_ in rows})
    assert {"a.b", "a`b", "__row", "_toxicity", "_quality", "_quality_host"} <= set(docs.columns)
    for f in (cp.exact, cp.near, cp.not_toxic, cp.good_quality):  # what passes is as it was
        assert {r[docs.columns.index("a.b")] for r in f(spark, docs, sf_dir).collect()} == {"clash"}


def test_run_leaves_only_its_last_tables(spark, sf_dir):
    from manyfold.llm import _common

    before = _common.mark()
    out = cp.run(spark, sf_dir)
    left = [p.rsplit("/", 1)[1].rsplit("-", 1)[0] for p in _common._staged[before:] if p]
    assert left == ["simhash_near_dedup", "curve"] and out.where("ids IS NULL OR length * 4 <> octet_length(ids)").count() == 0


def test_dedup_stages_keep_one_row_of_a_group(spark, sf_dir):
    t = [" ".join(f"{c}{k}" for k in range(40)) for c in "abcdef"]
    rows = [(1, t[0]), (1, t[0]), (1, t[0]), (2, t[1] + " "), (3, t[1]), (3, t[2]), (None, t[3]), (None, t[0]), (None, t[4]), (None, t[4]), (5, t[5])]
    want = [(1, t[0]), (2, t[1] + " "), (3, t[2]), (5, t[5]), (None, t[3]), (None, t[4])]
    docs = spark.createDataFrame([(i, x, "en", "s", len(x)) for i, x in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    for f in (cp.exact, cp.near):
        out = f(spark, docs, sf_dir)
        assert out.columns == docs.columns
        assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str) == sorted(want, key=str)


def test_embedding_sql(spark, sf_dir):
    c = duckdb.connect()
    c.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet'")
    got = [tuple(r) for r in q.op6_epsilon_grid_join(spark, sf_dir).collect()]
    assert sorted(got) == sorted(c.sql(q.oracle_sql()["op6_epsilon_grid_join"]).fetchall())
