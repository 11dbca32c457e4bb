import hashlib
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from brute import components, fingerprint, least

from manyfold.llm import embedding_dedup, queries as q, simhash
from manyfold.llm._graph import connected_components, local_roots
from manyfold.llm.exact_dedup import exact_dedup


def test_exact_dedup_odd_rows(odd, rows):
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is None, i))
    keep = {k: min(v, key=lambda x: (x[0], x[1], x[2] or 0))[2] for k, v in groups.items()}
    want = []
    for i, t, *_ in rows:
        k = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        want.append((i, keep[k], len(groups[k]), hashlib.sha256(k.encode()).hexdigest()))
    for fan_in in (2, 8):
        got = [tuple(r) for r in exact_dedup(odd, fan_in=fan_in).collect()]
        assert sorted(((a, b, c, e) for a, b, c, _, e in got), key=str) == sorted(want, key=str)
        # one row of a group is kept, of repeated rows too
        kept = [(e, a) for a, b, _, k, e in got if k]
        assert sorted(kept, key=str) == sorted({(hashlib.sha256(k.encode()).hexdigest(), v) for k, v in keep.items()}, key=str)


def test_exact_dedup_of_many_runs(spark):
    df = spark.createDataFrame([(k, f"text {k % 70} " + "hot" * (k % 3 == 0) * 5) if k % 3 else (k, "hot") for k in range(900)], "doc_id long, text string").repartition(19)
    groups = defaultdict(list)
    for r in df.collect():
        groups[re.sub(r"\s", "", r["text"])].append(r["doc_id"])
    for fan_in in (2, 4, 8, 64):
        got = exact_dedup(df, fan_in=fan_in).collect()
        assert sorted((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in got) == sorted((i, min(v), len(v), i == min(v)) for v in groups.values() for i in v)


def test_merges_are_sorted_and_runs_go_to_partners(spark):
    from manyfold.llm.exact_dedup import digest_rows, merge_runs

    rows = digest_rows(spark.range(100).selectExpr("id AS doc_id", "string(id % 9) AS text").repartition(40))
    plan = merge_runs(rows, 64, 8)._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" not in plan and plan.count("SortAggregate") == 4  # two rounds, each partial and final
    assert len(re.findall(r"Exchange (hash|direct|shuffle)", plan, re.I)) == 2, plan


def test_exact_dedup_query(spark, sf_dir):
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    got = [tuple(r) for r in q.op8_exact_dedup(spark, sf_dir).collect()]
    assert sorted(got) == sorted(c.sql(q.oracle_sql()["op8_exact_dedup"]).fetchall())


def test_exact_dedup_is_native(odd):
    plan = exact_dedup(odd)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_simhash_odd_rows(odd, rows):
    fp = [fingerprint(t) for _, t, *_ in rows]
    roots = components(len(rows), [(a, b) for a in range(len(rows)) for b in range(a) if (fp[a] ^ fp[b]).bit_count() <= 3])
    ids = defaultdict(list)
    for k, r in enumerate(roots):
        ids[r].append(rows[k][0])
    want = [(rows[k][0], np.uint64(fp[k]).view(np.int64).item(), least(ids[roots[k]])) for k in range(len(rows))]
    assert sorted((tuple(r) for r in simhash.near_dedup(odd).collect()), key=str) == sorted(want, key=str)


def test_simhash_kernel_with_hot_groups():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 2, dtype=np.uint64)
    flips = lambda k, n: np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (n, k)).astype(np.uint64), axis=1)
    x = np.unique(np.concatenate([rng.integers(0, 2**63, 1500, dtype=np.uint64)] + [b ^ flips(k, 1000) for b in base for k in (1, 2, 4)]))
    cell, index, visits = simhash.cells(x)
    o = np.lexsort((visits, cell))
    a, b = simhash.cell_links(cell[o], x[index[o]], visits[o])
    assert (np.bitwise_count(a ^ b) <= 3).all()
    d = np.bitwise_count(x[:, None] ^ x[None, :]) <= 3
    i, j = np.nonzero(np.triu(d, 1))
    got, want = local_roots(a, b), local_roots(x[i], x[j])
    assert (got[0] == want[0]).all() and (got[1] == want[1]).all()
    assert len(a) < 40 * len(x)  # no pairs of whole groups
    # cells cut into blocks give the same components
    cell, index, visits = simhash.cells(x)
    heavy, n = np.unique(cell[~visits], return_counts=True)
    heavy, n = heavy[n > 20], n[n > 20]
    assert len(heavy)
    cell, part, index, visits = simhash.blocked(cell, index, visits, x, heavy, -(-n // 20))
    o = np.lexsort((visits, part, cell))
    a, b = simhash.cell_links(cell[o] << 32 | part[o], x[index[o]], visits[o])
    got = local_roots(a, b)
    assert (got[0] == want[0]).all() and (got[1] == want[1]).all()


def test_simhash_with_blocks(spark, monkeypatch):
    rng = np.random.default_rng(2)
    flips = np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (600, 4)).astype(np.uint64), axis=1)
    x = np.unique(np.concatenate([flips, rng.integers(0, 2**63, 300, dtype=np.uint64)]))
    df = spark.createDataFrame([(int(v),) for v in x.view(np.int64)], "fp long")
    i, j = np.nonzero(np.triu(np.bitwise_count(x[:, None] ^ x[None, :]) <= 3, 1))
    want = local_roots(x[i], x[j])
    for most in (10, 100_000):
        monkeypatch.setattr(simhash, "CELL_ROWS", most)
        got = np.array([tuple(r) for r in simhash.fingerprint_links(df).collect()], dtype=np.int64).view(np.uint64)
        got = local_roots(got[:, 0], got[:, 1])
        assert (got[0] == want[0]).all() and (got[1] == want[1]).all()


def test_components_of_chains_and_hubs(spark):
    links = [(k, k + 1) for k in range(0, 60)] + [(1000, 1000 + k) for k in range(1, 300)] + [(5, 5), (2000, 2001), (-7, 2001)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(links, "a long, b long")).collect()))
    want = {k: 0 for k in range(61)} | {1000 + k: 1000 for k in range(300)} | {2000: -7, 2001: -7, -7: -7}
    assert got == want
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def _vectors():
    rng = np.random.default_rng(3)
    c = rng.normal(size=(8, 16))
    x = c[rng.integers(0, 8, 700)] + rng.normal(size=(700, 16)) * rng.choice([0.1, 0.2, 0.4], 700)[:, None]
    x[:80] = x[0]
    out = [v.tolist() for v in x.astype(np.float32)]
    return out + [None, [0.0] * 16, [1.0] * 15 + [None], [float("nan")] * 16, [float("inf")] * 16, [1.0] * 5, []]


def test_embeddings_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "INTERVAL", 150)
    monkeypatch.setattr(embedding_dedup, "LEAF", 32)
    v = _vectors()
    ok = np.array([k < 700 for k in range(len(v))])
    x = np.array([a if o else [0.0] * 16 for a, o in zip(v, ok)], dtype=float)
    n = x / np.maximum(1e-12, np.sqrt((x * x).sum(axis=1)))[:, None]
    near = (n @ n.T >= 0.95) & ~np.eye(len(v), dtype=bool)
    roots = components(len(v), list(zip(*(a.tolist() for a in np.nonzero(near)))))
    want = [(k, int(near[k].sum()), roots[k], roots[k] == k) for k in range(len(v))] + [(None, 0, None, False)]
    df = spark.createDataFrame([(k, a, "clash") for k, a in enumerate(v)] + [(None, v[0], "clash")], "vec_id long, embedding array<float>, h string")
    got = [tuple(r) for r in embedding_dedup.near_vectors(df).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_embeddings_of_several_lengths(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "INTERVAL", 60)
    monkeypatch.setattr(embedding_dedup, "LEAF", 16)
    rng = np.random.default_rng(8)
    v = [[]] * 300  # the commonest length
    for d, n in ((16, 170), (24, 110), (3, 20), (1, 4)):
        c = rng.normal(size=(6, d))
        x = c[rng.integers(0, 6, n)] + rng.normal(size=(n, d)) * rng.choice([0.05, 0.1, 0.3], n)[:, None]
        x[: n // 4] = x[0]
        v += x.astype(np.float32).tolist()
    v = [v[k] for k in rng.permutation(len(v))]
    links = []
    for d in {len(a) for a in v} - {0}:
        at = [k for k, a in enumerate(v) if len(a) == d]
        x = np.array([v[k] for k in at])
        x /= np.sqrt((x * x).sum(axis=1))[:, None]
        near = (x @ x.T >= 0.95) & ~np.eye(len(at), dtype=bool)
        assert near.any()
        links += [(at[a], at[b]) for a, b in zip(*(i.tolist() for i in np.nonzero(near)))]
    roots, n = components(len(v), links), Counter(a for a, _ in links)
    df = spark.createDataFrame(list(enumerate(v)), "vec_id long, embedding array<float>")
    got = [tuple(r) for r in embedding_dedup.near_vectors(df).collect()]
    assert sorted(got) == [(k, n[k], roots[k], roots[k] == k) for k in range(len(v))]


def test_embeddings_of_any_size(spark):
    v = [[1e200, 1e200], [1e200, 1e200], [2.0, 2.0], [1e-320, 1e-320], [1e200, -1e200], [1.0, 2.0], [0.0, -0.0], [5e-324, 0.0], [1e308, 0.0]]
    df = spark.createDataFrame(list(enumerate(v)), "vec_id long, embedding array<double>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.near_vectors(df).collect()}
    n = (3, 0)
    assert got == {0: n, 1: n, 2: n, 3: n, 4: (0, 4), 5: (0, 5), 6: (0, 6), 7: (1, 7), 8: (1, 7)}


def test_bounds_skip_only_what_is_apart():
    rng = np.random.default_rng(4)
    width = np.sqrt(0.1)
    skipped = 0
    for spread in (0.02, 0.1, 0.3):
        c = rng.normal(size=(30, 12))
        u = [x / np.sqrt((x * x).sum(axis=1))[:, None] for x in (a + rng.normal(size=(700, 12)) * spread for a in c)]
        basis = np.linalg.qr(rng.normal(size=(12, 8)))[0]
        b = [embedding_dedup.bounds(x, basis) for x in u]
        for i in range(30):
            for j in range(i):
                if not embedding_dedup.may_link(b[i], b[j], 12, 8, width):
                    skipped += 1
                    assert (u[i] @ u[j].T).max() < 0.95
    assert skipped > 100


@pytest.mark.parametrize("f", [exact_dedup, simhash.near_dedup])
def test_empty_table(none, f):
    assert f(none).count() == 0


def test_no_vectors(spark):
    assert embedding_dedup.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
