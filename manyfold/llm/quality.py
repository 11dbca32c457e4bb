"""Quality by hierarchical empirical Bayes: what a document's own text says, combined with what
its host and the path below the host are like.

1. A logistic regression on a few text statistics gives every document a probability p of good
   quality (fitted by iterated least squares on a bounded sample of labelled rows).
2. One grouped aggregation over all documents sums p by path; paths add up to hosts, hosts to the
   corpus. Spark combines sums before the exchange, so a host with a third of all rows is one row
   per task.
3. A host's posterior mean is (sum of p + k * global mean) / (n + k): hosts with few documents
   shrink towards the corpus, paths likewise towards their host. k comes from the data by the
   method of moments: the smaller the spread between sites beyond chance, the larger k.
4. The document's log odds move by the path's log odds against the corpus' log odds.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import quoted, ship, stage, unused, with_batch_column
from ._words import Words, chunks

TRAIN_ROWS = 20_000
#: So many hosts or paths are broadcast at most; more are joined by a shuffle.
BROADCAST_SITES = 50_000
FEATURES = ("log_words", "distinct", "repeat", "top", "upper", "punct", "pipe", "digit", "mean_len", "line_repeat", "bang", "empty")

#: What a byte counts as: letters (bytes beyond ASCII too), blanks and control characters are 0.
UPPER, PIPE, BANG, PUNCT, DIGIT, MARK = range(1, 7)
_KIND = np.zeros(256, dtype=np.uint8)
for _c in range(33, 127):
    _KIND[_c] = UPPER if 65 <= _c <= 90 else 0 if 97 <= _c <= 122 else DIGIT if 48 <= _c <= 57 else PIPE if chr(_c) == "|" else BANG if chr(_c) == "!" else MARK if chr(_c) in ".,'-" else PUNCT


def statistics(texts: list[str | None]) -> np.ndarray:
    """A row of FEATURES for each text, all from the whole text; all but ``empty`` are 0 for none."""
    w = Words(texts)
    n, m = len(texts), w.counts.astype(np.float64)
    per = lambda a, b: np.divide(a, b, out=np.zeros(n), where=b > 0)
    kind = _KIND[np.frombuffer(w.raw, dtype=np.uint8)]
    at = np.flatnonzero(kind)
    k = np.bincount(np.searchsorted(w.text_ends, at, side="right") * 8 + kind[at], minlength=8 * n).reshape(n, 8).astype(np.float64)
    size = np.bincount(w.text, weights=w.size, minlength=n)
    # words sorted within each text: 24 bits of the text's number and 40 of the word's hash
    key = np.sort(w.text.astype(np.uint64) << np.uint64(40) | w.hash >> np.uint64(24))
    new = np.flatnonzero(np.diff(key, prepend=key[:1] ^ np.uint64(1)))
    runs, of = np.diff(np.append(new, len(key))), (key[new] >> np.uint64(40)).astype(np.int64)
    top = np.zeros(n)
    np.maximum.at(top, of, runs)
    same = np.bincount(w.text[1:][(w.hash[1:] == w.hash[:-1]) & (w.text[1:] == w.text[:-1])], minlength=n).astype(np.float64)
    lines = np.zeros((n, 2))
    for i, t in enumerate(texts):
        if t and "\n" in t:
            x = [s for s in t.split("\n") if s and not s.isspace()]
            lines[i] = len(x), len(x) - len(set(x))
    letters = size - k[:, PIPE:].sum(axis=1)
    return np.column_stack((np.log1p(m), per(np.bincount(of, minlength=n).astype(float), m), per(same, m), per(top, m), per(k[:, UPPER], letters), per(k[:, [PIPE, BANG, PUNCT]].sum(axis=1), size), per(k[:, PIPE], m), per(k[:, DIGIT], size), per(size, m), per(lines[:, 1], lines[:, 0]), per(k[:, BANG], m), (m == 0).astype(float)))


def with_statistics(docs: DataFrame, text_col: str, name: str) -> DataFrame:
    """``docs`` with a column ``name``: the array of FEATURES."""
    at = docs.columns.index(text_col)

    def column(batch: pa.RecordBatch) -> pa.Array:
        texts = batch.column(at).to_pylist()
        x = np.concatenate([statistics(texts[s]) for s in chunks(texts)]) if texts else np.zeros((0, len(FEATURES)))
        return pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(FEATURES)).cast(pa.list_(pa.float64()))

    return with_batch_column(docs, name, T.ArrayType(T.DoubleType()), lambda: column)


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    most: int = TRAIN_ROWS, ridge: float = 1.0, seed: int = 7
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(means, scales, coefficients with the constant last). The labelled rows used are the
    ``most`` with the smallest hash of their identifier; rows without label or identifier teach
    nothing. With no labelled row, all coefficients are 0."""
    ship(docs.sparkSession)
    some = labels.select(quoted(id_col).cast("long").alias("i"), quoted(label_col).cast("int").alias("y")).where("i is not null and y is not null")
    some = some.groupBy("i").agg(F.max("y").alias("y")).orderBy(F.xxhash64("i", F.lit(seed)), "i").limit(most)
    texts = docs.select(quoted(id_col).cast("long").alias("d"), quoted(text_col).alias("t"))
    # the sample's size is bounded by ``most``, and a row of it is a dozen numbers
    got = with_statistics(texts.join(F.broadcast(some), F.col("d") == F.col("i")).select("y", "t"), "t", "x").select("y", "x").toPandas()
    k = len(FEATURES)
    if not len(got):
        return np.zeros(k), np.ones(k), np.zeros(k + 1)
    x, y = np.stack(got["x"].to_numpy()), got["y"].to_numpy(dtype=float)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    x = np.column_stack(((x - mean) / scale, np.ones(len(x))))
    w, pen = np.zeros(k + 1), np.diag([ridge] * k + [1e-3])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + pen, x.T @ (y - p) - pen @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return mean, scale, w


def _odds(p: Column) -> Column:
    p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return F.log(p / (1 - p))


def _shrink(sites: DataFrame, prior: Column, least: float = 5.0) -> float:
    """k by the method of moments: the variance between sites beyond what their sizes explain."""
    # sums over all sites: n, and squared deviations weighted by n
    r = sites.agg(F.sum("n"), F.count("*"), F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - prior, 2)), F.sum("v"), F.sum(F.pow("n", F.lit(2)))).first()
    n, m, between, within, squares = (float(x or 0) for x in r)
    if m < 2 or n <= m:
        return 1000.0
    noise = within / n  # mean variance of one document's p within its site
    spread = max(1e-9, (between - (m - 1) * noise) / max(1e-9, n - squares / n))
    return float(min(1e6, max(least, noise / spread)))


def site_posteriors(docs: DataFrame, host: str = "host", path: str = "path", p: str = "p") -> tuple[DataFrame, float]:
    """(host, path, prior) for each pair, nulls being a site of their own, and the corpus' mean."""
    paths = docs.groupBy(quoted(host).alias("h"), quoted(path).alias("q")).agg(
        F.count("*").cast("double").alias("n"), F.sum(quoted(p)).alias("s"), F.sum(quoted(p) * quoted(p)).alias("s2")
    )
    paths = stage(docs.sparkSession, paths, "site-sums")  # a row per site, so that texts are read once
    paths = paths.withColumn("v", F.greatest(F.lit(0.0), F.col("s2") - F.col("s") * F.col("s") / F.col("n")))
    total = paths.agg(F.sum("s"), F.sum("n")).first()
    mean = float(total[0] / total[1]) if total[1] else 0.5
    hosts = paths.groupBy("h").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("s2").alias("s2")).withColumn(
        "v", F.greatest(F.lit(0.0), F.col("s2") - F.col("s") * F.col("s") / F.col("n"))
    )
    k = _shrink(hosts, F.lit(mean))
    hosts = hosts.select(F.col("h").alias("hh"), ((F.col("s") + k * mean) / (F.col("n") + k)).alias("host_prior"))
    paths = paths.join(hosts, F.col("h").eqNullSafe(F.col("hh"))).drop("hh")
    k = _shrink(paths, F.col("host_prior"))
    return paths.select("h", "q", "host_prior", ((F.col("s") + k * F.col("host_prior")) / (F.col("n") + k)).alias("path_prior")), mean


def with_quality(
    docs: DataFrame, model: tuple[np.ndarray, np.ndarray, np.ndarray], host: Column, path: Column,
    text_col: str = "text", name: str = "quality_score", weight: float = 0.25, keep_text: bool = True
) -> DataFrame:
    """``docs`` with four columns: ``name`` (posterior probability of good quality), ``name`` +
    _evidence (from the text alone), _host and _path (the sites' posterior means).

    ``weight`` is how much of the site's shift in log odds a document takes. A null text is an
    empty one; a null host or path is a site of its own. Columns of these names are replaced; others
    of any name stay as they are. Without ``keep_text`` the text is left out, and is then read once:
    the rows with their evidence are staged.
    """
    spark = docs.sparkSession
    ship(spark)
    mean, scale, w = model
    new = [name, f"{name}_evidence", f"{name}_host", f"{name}_path"]
    kept = [c for c in docs.columns if c not in new]
    h, q, x, p, sh, sq, hp, qp = (unused([*docs.columns, *new], c) for c in ("_host", "_path", "_x", "_p", "_site_host", "_site_path", "_host_prior", "_path_prior"))
    rows = docs.select(*map(quoted, kept), host.cast("string").alias(h), path.cast("string").alias(q))
    rows = with_statistics(rows, text_col, x)
    coef = w[:-1] / scale
    logit = F.lit(float(w[-1] - (coef * mean).sum()))
    for i, c in enumerate(coef):
        logit = logit + F.col(x)[i] * float(c)
    if not keep_text:
        kept = [c for c in kept if c != text_col]
    rows = rows.select(*map(quoted, kept), h, q, (1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), logit))))).alias(p))
    if not keep_text:
        rows = stage(spark, rows, "evidence")
    sites, mean_p = site_posteriors(rows, h, q, p)
    sites = stage(spark, sites.select(F.col("h").alias(sh), F.col("q").alias(sq), F.col("host_prior").alias(hp), F.col("path_prior").alias(qp)), "sites")
    few = sites.limit(BROADCAST_SITES + 1).count() <= BROADCAST_SITES
    rows = rows.join(F.broadcast(sites) if few else sites, F.col(h).eqNullSafe(F.col(sh)) & F.col(q).eqNullSafe(F.col(sq)), "left")
    z = _odds(F.col(p)) + weight * (_odds(F.col(qp)) - _odds(F.lit(mean_p)))
    return rows.select(*map(quoted, kept), (1 / (1 + F.exp(-z))).alias(new[0]), F.col(p).alias(new[1]), F.col(hp).alias(new[2]), F.col(qp).alias(new[3]))
