import math
import zlib
from collections import Counter

import numpy as np
import pytest
from brute import LOW, words
from pyspark.sql import functions as F

from manyfold.llm import ngram_lm, quality, queries as q, toxicity
from manyfold.llm._words import PUNCTUATION, Words, chunks, pair


def _fold(i, n):
    return zlib.crc32(str(i).encode()) % n


def test_words_against_plain_split(rows):
    texts = [t for _, t, *_ in rows]
    w = Words(texts)
    got = [w.lower[a:b].decode() for a, b in zip(w.starts, w.ends)]
    want = [words(t) for t in texts]
    assert got == [x for y in want for x in y] and w.counts.tolist() == [len(x) for x in want]
    hashes = dict(zip(got, w.hash.tolist()))
    assert len(set(hashes.values())) == len(hashes) and all(hashes[g] == h for g, h in zip(got, w.hash.tolist()))
    assert [s for s in chunks(texts, 100)][-1].stop == len(texts)
    assert Words([]).hash.size == 0 and Words(["", None]).counts.tolist() == [0, 0]
    assert Words(["a###b"], PUNCTUATION).counts.tolist() == [2]


def test_lm_against_brute_force(odd, rows, monkeypatch):
    monkeypatch.setattr(ngram_lm, "BLOCK_BYTES", 3000)
    monkeypatch.setattr(ngram_lm, "BUCKET_TOKENS", 500)
    fold = F.crc32(F.col("doc_id").cast("string")) % 7
    got = [r.asDict() for r in ngram_lm.score(odd, F.coalesce(fold != 2, F.lit(True)), fold == 3).collect()]
    trained = lambda i: i is None or _fold(i, 7) != 2
    count, pairs, starts = Counter(), Counter(), 0
    for i, t, *_ in rows:
        if trained(i):
            w = [*words(t), None]
            count.update(w)
            pairs.update(zip(["<s>", *w[:-1]], w))
            starts += 1
    n, v = sum(count.values()), len(count)
    want = sorted((str(i), len(w := [*words(t), None]), sum(x in count for x in w), round(sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w), 6)) for i, t, *_ in rows)
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in got) == want
    assert {r["train_tokens"] for r in got} == {n} and all(r["score"] < 0 for r in got)
    weights = _plain_weights(rows, trained)
    scores = []
    for i, t, *_ in rows:
        w, total = [*words(t), None], 0.0
        for u, x in zip(["<s>", *w[:-1]], w):
            c = starts if u == "<s>" else count[u]
            l0, l1, l2 = weights[math.floor(math.log2(c)) + 1 if c else 0]
            total += math.log10(l0 / (v + 1) + l1 * count[x] / n + l2 * (pairs[u, x] / c if c else 0))
        scores.append((str(i), round(total, 4)))
    assert sorted((str(r["doc_id"]), round(r["score"], 4)) for r in got) == sorted(scores)
    # the model is a distribution over the next token: known words, and one share for all others
    weights = ngram_lm.learn_weights(np.array([1, 1, 2]), np.array([[0.1, 0.2, 0.0], [0.1, 0.1, 0.5], [0.1, 0.3, 0.9]]), np.array([5.0, 2.0, 9.0]))
    assert np.allclose(weights.sum(axis=1), 1) and weights[2, 2] > weights[1, 2]


def _plain_weights(rows, trained):
    """Deleted interpolation in plain loops: the weights of each bucket of the context's frequency, by
    EM over the tokens of the fold, whose texts are taken out of the counts."""
    count, pairs, starts, fold = Counter(), Counter(), 0, []
    for i, t, *_ in rows:
        w = [*words(t), None]
        if trained(i) and i is not None and _fold(i, 7) == 3:
            fold += list(zip(["<s>", *w[:-1]], w))
        elif trained(i):
            count.update(w)
            pairs.update(zip(["<s>", *w[:-1]], w))
            starts += 1
    n, v = sum(count.values()), len(count)
    step = lambda p: 2 ** (min(0, round(8 * math.log2(p))) / 8) if p else 0.0
    tokens = Counter()
    for u, x in fold:
        c = starts if u == "<s>" else count[u]
        tokens[math.floor(math.log2(c)) + 1 if c else 0, step(count[x] / n), step(pairs[u, x] / c if c else 0.0)] += 1
    first = {b: (0.1, 0.6, 0.3) if b else (0.25, 0.75, 0.0) for b in range(64)}
    out = dict(first)
    for _ in range(200):
        share = {b: [0.0, 0.0, 0.0] for b in out}
        for (b, p1, p2), k in tokens.items():
            part = [w * p for w, p in zip(out[b], (1 / (v + 1), p1, p2))]
            for j in range(3):
                share[b][j] += k * part[j] / sum(part)
        new = {}
        for b in out:
            back = (0.1, 0.6, 0.0 if out[0][2] == 0 else 0.3)  # a token's worth of the start
            new[b] = [(x + y) / (sum(share[b]) + sum(back)) for x, y in zip(share[b], back)]
        new[0] = [x / sum(new[0][:2]) for x in (*new[0][:2], 0.0)]
        if max(abs(x - y) for b in out for x, y in zip(out[b], new[b])) < 1e-7:
            break
        out = new
    seen = {b for b, *_ in tokens}
    return {b: w if b in seen else first[b] for b, w in out.items()}


def test_counts_beyond_32_bits():
    big = np.array([0, 1, 2**32 - 1, 2**32, 2**45 + 7], dtype=np.uint64)
    for x in (big, big[:3], big[:0]):
        assert (ngram_lm.unpacked(ngram_lm.packed(x)) == x).all()


def test_lm_beats_the_base_on_held_out_texts(spark, sf_dir):
    r = q.op2_deleted_interpolation(spark, sf_dir).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert r[0] > r[1]


def test_lm_without_training_or_rows(odd, none):
    got = ngram_lm.score(odd, F.lit(False), F.lit(False)).collect()
    assert all(r["n_known"] == 0 and r["train_tokens"] == 0 for r in got)
    assert ngram_lm.score(none, F.lit(True), F.lit(False)).count() == 0


def _held_out(spark, sf_dir, got, label):
    labels = {r["doc_id"]: r[label] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    return [(r["predicted"], labels[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in labels]


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    got = q.op4_ftrl_toxicity(spark, sf).collect()
    pairs = _held_out(spark, sf, got, "toxic")
    hit = sum(p and y for p, y in pairs)
    assert hit / sum(y for _, y in pairs) > 0.7 and hit / max(1, sum(p for p, _ in pairs)) > 0.9
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)


def test_ftrl_against_plain_loops():
    """McMahan et al., 2013, algorithm 1, with dictionaries."""
    rng = np.random.default_rng(0)
    model, (alpha, beta, l1, l2) = toxicity.Ftrl(0.3, 1.0, 0.5, 0.2), (0.3, 1.0, 0.5, 0.2)
    z, n, bias = Counter(), Counter(), 1 << toxicity.BITS

    def weight(i):
        reg = 0.0 if i == bias else l1
        if abs(z[i]) <= reg:
            return 0.0
        return -(z[i] - math.copysign(reg, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)

    for _ in range(300):
        at = np.unique(rng.integers(0, 40, 6))
        y = int(7 in at or (3 in at and 5 in at))
        model.learn(at, y)
        w = {i: weight(i) for i in [*at.tolist(), bias]}
        g = 1 / (1 + math.exp(-sum(w.values()))) - y
        for i in w:
            sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha
            z[i] += g - sigma * w[i]
            n[i] += g * g
    every = np.array([*range(40), bias])
    assert np.allclose(model.weights(every), [weight(i) for i in every.tolist()]) and (model.weights(every) == 0).any()


def test_toxicity_score_against_plain_loops(odd, rows):
    """The probability from the learned weights, over the n-grams and skip-grams of each text."""
    import re

    labels = odd.select("doc_id").distinct().where("doc_id < 40").selectExpr("doc_id", "cast(doc_id % 3 = 0 as int) AS toxic")
    coords, weights, bias = toxicity.train(odd, labels, l1=0.01)
    assert len(coords)
    by, cut = dict(zip(coords.tolist(), weights.tolist())), re.compile("[^" + re.escape("".join(chr(c) for c in range(128) if not chr(c).isalnum())) + "]+")
    want = []
    for i, t, *_ in rows:
        w = cut.findall((t or "").translate(LOW))
        h = [int(Words([x], PUNCTUATION).hash[0]) for x in w] if len(w) < 500 else Words([t], PUNCTUATION).hash.tolist()
        one = lambda a, b, k: int(pair(*np.array([[a], [b]], dtype=np.uint64), k)[0])
        grams = {*h, *(one(a, b, 2) for a, b in zip(h, h[1:])), *(one(a, b, 3) for a, b in zip(h, h[2:]))}
        logit = bias + sum(by.get(c, 0.0) for c in {g >> (64 - toxicity.BITS) for g in grams})
        want.append((str(i), round(1 / (1 + math.exp(-logit)), 6)))
    with np.errstate(over="ignore"):
        got = toxicity.with_score(odd, (coords, weights, bias), name="tox").select("doc_id", "tox").collect()
    assert sorted((str(r[0]), round(r[1], 6)) for r in got) == sorted(want)


def test_quality_against_plain_loops(spark, sf_dir):
    """Hosts' and paths' posteriors and each document's, in plain Python from the evidence."""
    got = [r.asDict() for r in q.op9_quality_bayes(spark, sf_dir).collect()]
    site = {r["doc_id"]: (r["source"], r["lang"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    at = [(site[r["doc_id"]], r["evidence"]) for r in got]
    mean = sum(p for _, p in at) / len(at)
    groups = [{}, {}]
    for (h, path), p in at:
        groups[0].setdefault(h, []).append(p)
        groups[1].setdefault((h, path), []).append(p)

    def moments(sites, prior):
        n, m = sum(map(len, sites.values())), len(sites)
        between = sum(len(x) * (sum(x) / len(x) - prior(s)) ** 2 for s, x in sites.items())
        noise = sum(sum((y - sum(x) / len(x)) ** 2 for y in x) for x in sites.values()) / n
        spread = max(1e-9, (between - (m - 1) * noise) / max(1e-9, n - sum(len(x) ** 2 for x in sites.values()) / n))
        return min(1e6, max(5.0, noise / spread)) if m > 1 and n > m else 1000.0

    k = moments(groups[0], lambda s: mean)
    host = {s: (sum(x) + k * mean) / (len(x) + k) for s, x in groups[0].items()}
    k = moments(groups[1], lambda s: host[s[0]])
    path = {s: (sum(x) + k * host[s[0]]) / (len(x) + k) for s, x in groups[1].items()}
    odds = lambda p: math.log(min(1 - 1e-6, max(1e-6, p)) / (1 - min(1 - 1e-6, max(1e-6, p))))
    for r, (s, p) in zip(got, at):
        assert r["host_prior"] == pytest.approx(host[s[0]], abs=1e-7) and r["path_prior"] == pytest.approx(path[s], abs=1e-7)
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-odds(p) - 0.25 * (odds(path[s]) - odds(mean)))), abs=1e-7)


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.1"
    pairs = _held_out(spark, sf, q.op9_quality_bayes(spark, sf).collect(), "quality")
    assert sum(p == y for p, y in pairs) / len(pairs) > 0.97


def test_scores_of_odd_rows(spark, odd, none, rows):
    labels = spark.createDataFrame([(k, k % 2, k % 2, "clash") for k in range(30)] + [(None, 1, 1, "clash"), (3, None, None, "clash")], "doc_id long, toxic int, quality int, score string")
    model = toxicity.train(odd, labels)
    got = toxicity.with_score(odd, model)
    assert got.count() == len(rows) and got.columns.count("score") == 1
    assert toxicity.with_score(none, model).count() == 0
    assert toxicity.train(none, labels)[0].size == 0
    fitted = quality.fit(odd, labels)
    got = quality.with_quality(odd, fitted, F.col("source"), F.col("lang"), name="score")
    out = [r.asDict() for r in got.collect()]
    assert len(out) == len(rows) and all(0 <= r["score"] <= 1 for r in out)
    assert quality.with_quality(none, fitted, F.col("source"), F.col("lang")).count() == 0
    assert (quality.fit(none, labels)[2] == 0).all()


def test_sparse_sites_shrink(spark):
    rows = [("big", "a", 0.9)] * 400 + [("bad", "a", 0.1)] * 400 + [("mid", m, p) for m, p in (("a", 0.5), ("b", 0.6))] * 100 + [("tiny", "a", 0.0)]
    sites, mean = quality.site_posteriors(spark.createDataFrame(rows, "host string, path string, p double"))
    got = {(r["h"], r["q"]): r["path_prior"] for r in sites.collect()}
    assert got["big", "a"] > 0.85 and got["bad", "a"] < 0.15 and 0.2 < got["tiny", "a"] < mean


@pytest.mark.parametrize("text", ["", None, "\n\n", "word", "A" * 5000, "x " * 9000])
def test_statistics_are_finite(text):
    s = quality.statistics([text, "plain text here"])
    assert s.shape == (2, len(quality.FEATURES)) and np.isfinite(s).all()
