"""LM scoring by deleted interpolation of unigram and bigram estimates.

    p(v | u) = l0(b) / (V + 1) + l1(b) c(v) / N + l2(b) c(u v) / c(u),   b the bucket of c(u)

c counts training texts, N their tokens, V their distinct tokens. The weights l of each bucket (by
powers of two of the context's frequency) come from expectation-maximisation on held-out counts: one
fold of the training texts is scored with the counts of the others.

Counts are whole and grow with the corpus, so they stay distributed, and no row is made per token:

1. Texts are tokenised and hashed in blocks of about BLOCK_BYTES, written once: the block's distinct
   words and, for each token, the place of its word among them.
2. A block sends each bucket of the hash space its distinct n-grams, sorted, with their counts.
3. A bucket adds up all blocks' counts and answers each with the totals of what it sent, in order.
4. A block with its answers knows the counts of all its tokens: once for the held-out fold, which
   gives a histogram that is small at any size (quantised logarithms), once for the scores.

N-grams are told apart by 64-bit hashes. A frequent n-gram is one entry of a block, not a row for
each occurrence, so no bucket is hot.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import quoted, release, ship, stage
from ._words import Words, chunks, mix, pair

BLOCK_BYTES = 8 << 20
#: Tokens whose n-grams share a bucket of the hash space.
BUCKET_TOKENS = 4_000_000
END, START = np.uint64(0x5E2D58D8B3BCDEF1), np.uint64(0x1F83D9ABFB41BD6B)
#: Weights of a bucket that no held-out token reaches.
DEFAULT = np.array([0.1, 0.6, 0.3])
BUCKETS, STEPS = 64, 8


def planes(x: np.ndarray) -> bytes:
    """Numbers as planes of bytes, which compress well where high bytes are zero."""
    return x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def unplanes(data: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.frombuffer(data, dtype=np.uint8).reshape(size, -1).T.copy().view(kind).ravel()


def packed(counts: np.ndarray) -> bytes:
    """Counts, most of them small, as compressed planes of 32-bit numbers, or of 64-bit ones where a
    count needs them; the first byte says which."""
    kind = "<u4" if counts.max(initial=0) < 1 << 32 else "<u8"
    return kind[2].encode() + zlib.compress(planes(counts.astype(kind)), 1)


def unpacked(data: bytes) -> np.ndarray:
    return unplanes(zlib.decompress(data[1:]), f"<u{chr(data[0])}").astype("<u8")


def tokenised(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct hashes, the frequent ones first, place of each token's hash, tokens of each text); a
    text's last token is its end."""
    parts, counts = [], []
    for s in chunks(texts):
        w = Words(texts[s])
        parts.append(np.insert(w.hash, w.word_ends, END))
        counts.append(w.counts + 1)
    hashes = np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint64)
    words, place, n = np.unique(hashes, return_inverse=True, return_counts=True)
    order = np.argsort(-n, kind="stable")
    rank = np.empty(len(words), dtype=np.uint32)
    rank[order] = np.arange(len(words))
    return words[order], rank[place], np.concatenate(counts) if counts else np.zeros(0, dtype=np.int64)


class Block:
    """A block's n-grams: keys (hashes, ascending) of words and pairs, and for each token where its
    word, its context and its pair lie in them (context -1: the start of a text)."""

    def __init__(self, words: np.ndarray, place: np.ndarray, counts: np.ndarray):
        n, order = len(words), np.argsort(words)
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.arange(n)
        self.words, self.v = words[order], rank[place]
        words = self.words
        self.ends = np.cumsum(counts)
        before = np.empty(len(place), dtype=np.int64)
        before[1:] = self.v[:-1]
        before[self.ends - counts] = n
        code, inverse = np.unique(before * (n + 1) + self.v, return_inverse=True)
        with np.errstate(over="ignore"):
            keys = pair(np.append(words, START)[code // (n + 1)], words[code % (n + 1)]) if n else np.zeros(0, dtype=np.uint64)
        order = np.argsort(keys)
        rank = np.empty(len(keys), dtype=np.int64)
        rank[order] = np.arange(len(keys))
        self.pairs, self.uv, self.u = keys[order], rank[inverse], np.where(before == n, -1, before)

    def answers(self, replies: list[tuple[int, int, bytes, bytes]]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """(counts, counts in the fold) of all words (1) and of all pairs (2)."""
        out = {}
        for kind, size in ((1, len(self.words)), (2, len(self.pairs))):
            mine = sorted(r for r in replies if r[0] == kind)
            out[kind] = tuple(np.concatenate([np.zeros(0, dtype="<u8"), *(unpacked(r[k]) for r in mine)]).astype(np.float64) for k in (2, 3))
            assert len(out[kind][0]) == size
        return out


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Ascending with the key."""
    return ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _block_of(t: pa.Table | pa.RecordBatch, i: int = 0) -> tuple[Block, dict[str, np.ndarray]]:
    row = {c: t.column(c)[i].as_py() for c in ("block", "words", "place", "counts", "train")}
    counts = np.frombuffer(row["counts"], dtype="<i8")
    train = np.repeat(np.frombuffer(row["train"], dtype=np.uint8), counts).astype(bool)
    flags = {"train": train, "fold": train & (row["block"] % 2 == 1)}
    return Block(np.frombuffer(row["words"], dtype="<u8"), unplanes(row["place"], "<u4"), counts), flags


def _frequency_bucket(c: np.ndarray) -> np.ndarray:
    """0 for an unseen context, else 1 + floor(log2(c))."""
    return np.where(c > 0, np.frexp(np.maximum(c, 1))[1], 0).clip(0, BUCKETS - 1)


def learn_weights(bucket: np.ndarray, p: np.ndarray, n: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Weights (BUCKETS x 3) that maximise the likelihood of the held-out tokens by EM; p has the
    three estimates of each row, n how many tokens it stands for."""
    w = np.tile(DEFAULT, (BUCKETS, 1))
    w[0] = (0.25, 0.75, 0.0)
    mass = np.bincount(bucket, weights=n, minlength=BUCKETS)
    for _ in range(rounds):
        share = w[bucket] * p
        share *= (n / np.maximum(share.sum(axis=1), 1e-300))[:, None]
        new = np.column_stack([np.bincount(bucket, weights=share[:, k], minlength=BUCKETS) for k in range(3)])
        # a token's worth of the start keeps every estimate alive
        new = (new + np.where(w[:1] == 0, 0, DEFAULT)) / (mass + np.where(w[:1] == 0, 0, DEFAULT).sum())[:, None]
        new[0] = np.array([new[0, 0], new[0, 1], 0.0]) / max(1e-300, new[0, :2].sum())
        if np.abs(new - w).max() < 1e-7:
            break
        w = new
    w[mass == 0] = np.where(np.arange(BUCKETS)[mass == 0, None] == 0, (0.25, 0.75, 0.0), DEFAULT)
    return w


def score(docs: DataFrame, training: Column, fold: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, trained, n_tokens, n_known, train_tokens, base_score, score.

    ``training`` tells which rows are learned from, ``fold`` which of these are held out to learn
    the weights. A null text is empty: its end alone. Rows with equal or null identifiers are
    scored each. Without training rows, N and V are 0, and every estimate but the uniform one is 0.
    """
    spark = docs.sparkSession
    ship(spark)

    def blocked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bool, list[tuple]] = {False: [], True: []}
        size, number = {False: 0, True: 0}, 0

        def full(in_fold: bool) -> pa.RecordBatch:
            nonlocal number
            names, texts, flags, part = (list(x) for x in zip(*held[in_fold]))
            words, place, counts = tokenised(texts)
            train = np.array([x & 1 for x in flags], dtype=np.uint8)
            block = ((part[0] << 32) + number) * 2 + in_fold
            held[in_fold], size[in_fold], number = [], 0, number + 1
            plain = {"block": block, "tokens": int(counts.sum()), "train_tokens": int(counts[train > 0].sum()), "train_docs": int(train.sum())}
            data = {"counts": counts.astype("<i8").tobytes(), "train": train.tobytes(), "words": words.tobytes(), "place": planes(place)}
            return pa.RecordBatch.from_pydict({"ids": pa.array([names], pa.list_(pa.int64()))} | {k: pa.array([v], pa.int64()) for k, v in plain.items()} | {k: pa.array([v], pa.binary()) for k, v in data.items()})

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                in_fold = row[2] > 1
                held[in_fold].append(row)
                size[in_fold] += len(row[1] or "") + 1
                if size[in_fold] >= BLOCK_BYTES:
                    yield full(in_fold)
        for in_fold in (False, True):
            if held[in_fold]:
                yield full(in_fold)

    train = F.coalesce(training, F.lit(False))
    flags = F.when(train, 1 + 2 * F.coalesce(fold, F.lit(False)).cast("int")).otherwise(0)
    rows = docs.select(
        quoted(id_col).cast("long").alias("i"), quoted(text_col).cast("string").alias("t"), flags.alias("f"),
        F.spark_partition_id().cast("long").alias("p")
    )
    blocks = stage(
        spark,
        rows.mapInArrow(
            blocked,
            "ids array<long>, block long, tokens long, train_tokens long, train_docs long, counts binary, train binary, words binary, place binary"
        ),
        "lm-blocks"
    )
    in_fold = F.col("block") % 2 == 1  # a block holds the fold's texts only, or none of them
    sums = [F.sum(c) for c in ("tokens", "train_tokens", "train_docs")] + [F.sum(F.when(in_fold, F.col(c))) for c in ("train_tokens", "train_docs")]
    tokens, n_train, train_docs, fold_tokens, fold_docs = (int(x or 0) for x in blocks.agg(*sums).first())
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-tokens // BUCKET_TOKENS), 1)

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                b, flag = _block_of(batch, i)
                name, out = batch.column("block")[i].as_py(), []
                for kind, keys, at in ((1, b.words, b.v), (2, b.pairs, b.uv)):
                    counts = [np.bincount(at[flag[k]], minlength=len(keys)) for k in ("train", "fold")]
                    cut = np.searchsorted(bucket_of(keys, buckets), np.arange(buckets + 1))
                    for k in np.flatnonzero(np.diff(cut)):
                        s = slice(cut[k], cut[k + 1])
                        out.append((int(k), kind, name, planes(np.diff(keys[s], prepend=np.uint64(0))), packed(counts[0][s]), packed(counts[1][s]) if name % 2 else b""))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, t) for x, t in zip(zip(*out), (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()))],
                    names=["bucket", "kind", "block", "keys", "train", "fold"]
                )

    def answered(t: pa.Table) -> pa.Table:
        keys = [np.cumsum(unplanes(x, "<u8"), dtype=np.uint64) for x in t.column("keys").to_pylist()]
        counts = [np.concatenate([unpacked(x) if x else np.zeros(len(k), dtype="<u8") for x, k in zip(t.column(c).to_pylist(), keys)]).astype(np.float64) for c in ("train", "fold")]
        distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
        sums = [np.bincount(at, weights=c, minlength=len(distinct)) for c in counts]
        ends = np.cumsum([len(k) for k in keys])
        every = [s[at].astype("<u8") for s in sums]
        mine = [[True] * len(keys), [b % 2 == 1 for b in t.column("block").to_pylist()]]
        back = [[packed(e[b - len(k) : b] if m else e[:0]) for k, b, m in zip(keys, ends, ms)] for e, ms in zip(every, mine)]
        one = np.zeros(t.num_rows, dtype=np.int64)
        seen, rest = one.copy(), one.copy()
        if t.column("kind")[0].as_py() == 1:
            seen[0], rest[0] = (sums[0] > 0).sum(), (sums[0] > sums[1]).sum()
        return pa.table({"block": t.column("block"), "kind": t.column("kind"), "bucket": t.column("bucket"), "train": pa.array(back[0], pa.binary()), "fold": pa.array(back[1], pa.binary()), "seen": seen, "rest": rest})

    # nothing needs the plain texts from here on
    grams = blocks.select("block", "counts", "train", "words", "place").mapInArrow(
        sent, "bucket int, kind int, block long, keys binary, train binary, fold binary"
    )
    replies = grams.groupBy("kind", "bucket").applyInArrow(answered, "block long, kind int, bucket int, train binary, fold binary, seen long, rest long")
    replies = stage(spark, replies, "lm-counts")
    del grams
    seen, rest = (int(x or 0) for x in replies.agg(F.sum("seen"), F.sum("rest")).first())
    release(spark)

    def answers(b: Block, t: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        return b.answers(list(zip(*(t.column(c).to_pylist() for c in ("kind", "bucket", "train", "fold")))))

    def estimates(b: Block, word: np.ndarray, two: np.ndarray, n: int, starts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The context's count, and the unigram and bigram estimates of each token."""
        context = np.where(b.u < 0, starts, word[b.u])
        p2 = np.divide(two[b.uv], context, out=np.zeros(len(b.v)), where=context > 0)
        return context, word[b.v] / max(n, 1), p2, word[b.v]

    def held_out(left: pa.Table, right: pa.Table) -> pa.Table:
        b, flag = _block_of(left)
        a = answers(b, right)
        context, p1, p2, _ = estimates(b, a[1][0] - a[1][1], a[2][0] - a[2][1], n_train - fold_tokens, train_docs - fold_docs)
        on = flag["fold"]
        step = lambda p: np.where(p > 0, np.rint(STEPS * np.log2(np.maximum(p, 1e-300))), 1).astype(np.int64)
        rows, n = np.unique(np.column_stack((_frequency_bucket(context[on]), step(p1[on]), step(p2[on]))), axis=0, return_counts=True)
        return pa.table({"b": rows[:, 0].astype(np.int64), "p1": rows[:, 1].astype(np.int64), "p2": rows[:, 2].astype(np.int64), "n": n.astype(np.int64)})

    weights = learn_weights(np.zeros(0, dtype=np.int64), np.zeros((0, 3)), np.zeros(0))
    by_block = lambda df: df.groupBy("block")
    if fold_tokens:
        cells = by_block(blocks.where(in_fold).select("block", "counts", "train", "words", "place")).cogroup(by_block(replies.where(in_fold).select("block", "kind", "bucket", "train", "fold"))).applyInArrow(
            held_out, "b long, p1 long, p2 long, n long"
        )
        # at most BUCKETS times the steps of two quantised logarithms
        got = cells.groupBy("b", "p1", "p2").agg(F.sum("n").alias("n")).toPandas()
        back = lambda s: np.where(s == 1, 0.0, np.exp2(np.minimum(s, 0) / STEPS))
        p = np.column_stack((np.full(len(got), 1 / (rest + 1)), back(got["p1"].to_numpy()), back(got["p2"].to_numpy())))
        weights = learn_weights(got["b"].to_numpy(), p, got["n"].to_numpy(dtype=float))
        del cells
        release(spark)

    def scored(left: pa.Table, right: pa.Table) -> pa.Table:
        b, flag = _block_of(left)
        a = answers(b, right)
        context, p1, p2, count = estimates(b, a[1][0], a[2][0], n_train, train_docs)
        w = weights[_frequency_bucket(context)]
        value = np.log10(w[:, 0] / (seen + 1) + w[:, 1] * p1 + w[:, 2] * p2)
        base = np.log10((count + 1) / (n_train + seen + 1))
        starts = np.concatenate(([0], b.ends[:-1]))
        add = lambda x: np.add.reduceat(x, starts)
        return pa.table({"doc_id": left.column("ids").combine_chunks().flatten(), "trained": flag["train"][starts], "n_tokens": b.ends - starts, "n_known": add((count > 0).astype(np.int64)), "train_tokens": np.full(len(starts), n_train), "base_score": add(base), "score": add(value)})

    return by_block(blocks.select("block", "ids", "counts", "train", "words", "place")).cogroup(by_block(replies.select("block", "kind", "bucket", "train", "fold"))).applyInArrow(
        scored,
        "doc_id long, trained boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )
