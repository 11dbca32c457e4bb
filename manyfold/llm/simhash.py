"""SimHash near-dedup by a segment-popcount embedding.

A fingerprint is cut into 32 segments of 2 bits, and each segment is mapped to its number of set
bits: a point with 32 coordinates from 0 to 2. Flipping a bit moves one coordinate by one, so the
Manhattan distance of two points is a lower bound of their fingerprints' Hamming distance. Within
distance 3 of 32 coordinates, one half of the coordinates is within distance 1 (if both were at 2
or more, the sum would exceed 3). So the range join runs on two grids, one for each half, whose
cells are the half's 16 coordinates: pairs in one cell or in cells that differ by one in one
coordinate are compared exactly. A fingerprint goes to its own cell and to its upper neighbours.
Of random pairs about 7 in a million meet in a cell.

Only distinct fingerprints take part, and what leaves a task is a spanning forest of the links it
found, never all pairs of a group. Cells that many fingerprints share are cut into blocks, and pairs of
blocks go to tasks of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import partitions_for, quoted, ship, stage, with_batch_column
from ._graph import connected_components, local_roots
from ._words import chunks, mix

DISTANCE = 3
SEED = 42
#: Cells with more fingerprints are joined around pivots, smaller ones many at a time.
SMALL_CELL = 512
#: Fingerprints at home in a cell that one task joins, at most (or a thousandth of all).
CELL_ROWS = 100_000
_PAIRS_AT_ONCE = 2_000_000

_SPREAD = np.zeros(256, dtype=np.uint64)
for _b in range(8):
    _SPREAD |= ((np.arange(256, dtype=np.uint64) >> np.uint64(_b)) & np.uint64(1)) << np.uint64(8 * _b)


def fingerprints(texts: list[str | None], words: int = 3) -> np.ndarray:
    """The fingerprint of each text: a bit is set if it is set in over half of the shingles' XXH64."""
    from xxhash import xxh64_intdigest as digest

    hashes, counts = [], []
    for t in texts:
        w = (t or "").encode("utf-8", "replace").lower().split()
        if len(w) <= words:
            got = [digest(b" ".join(w), SEED)] if w else []
        else:
            joined = b" ".join(w)
            ends = np.cumsum(np.fromiter(map(len, w), dtype=np.int64, count=len(w)) + 1)
            starts = [0, *ends[: -words].tolist()]
            got = [digest(joined[a:b], SEED) for a, b in zip(starts, (ends[words - 1 :] - 1).tolist())]
        hashes += got
        counts.append(len(got))
    n = np.array(counts, dtype=np.int64)
    out = np.zeros(len(texts), dtype=np.uint64)
    full = np.flatnonzero(n)
    if not len(full):
        return out
    octets = np.array(hashes, dtype=np.uint64).view(np.uint8).reshape(-1, 8)
    # sums of at most 255 ones fit the eight one-byte lanes of a number
    runs = -(-n[full] // 255)
    first = np.cumsum(n[full]) - n[full]
    run = np.repeat(first, runs) + 255 * (np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs))
    lanes = np.add.reduceat(_SPREAD[octets], run, axis=0).view(np.uint8).reshape(len(run), 64)
    ones = np.add.reduceat(lanes.astype(np.int64), np.cumsum(runs) - runs, axis=0)
    out[full] = np.packbits(2 * ones > n[full][:, None], axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def homes(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cell, its coordinates, packed in 2 bits each) of each fingerprint: a row for each half."""
    at, packed = [], []
    for half in (0, 1):
        bits = (prints >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF)
        ones = (bits - ((bits >> np.uint64(1)) & np.uint64(0x55555555))).astype(np.int64)
        home = np.full(len(prints), half * 3**16, dtype=np.int64)
        for k in range(16):
            home += (ones >> (2 * k) & 3) * 3**k
        at.append(home)
        packed.append(ones)
    return np.stack(at), np.stack(packed)


def cells(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cell, index of the fingerprint, True if it only visits): each goes to its cell in both
    grids and to the cells one higher in one coordinate."""
    at, index, visits = [], [], []
    for home, ones in zip(*homes(prints)):
        at.append(home)
        index.append(np.arange(len(prints)))
        visits.append(np.zeros(len(prints), dtype=bool))
        for k in range(16):
            up = np.flatnonzero((ones >> (2 * k) & 3) < 2)
            at.append(home[up] + 3**k)
            index.append(up)
            visits.append(np.ones(len(up), dtype=bool))
    return np.concatenate(at), np.concatenate(index), np.concatenate(visits)


def blocked(
    cell: np.ndarray, index: np.ndarray, visits: np.ndarray, fp: np.ndarray, heavy: np.ndarray, blocks: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(cell, part, index, visits) with the rows of ``heavy`` cells (ascending) dealt to parts.

    A cell of n blocks has a part for each pair of blocks i <= j: at home in it are the rows of
    block i, its visitors are those of block j; visitors of the cell go to every part i = j."""
    where = np.minimum(np.searchsorted(heavy, cell), max(0, len(heavy) - 1))
    hot = heavy[where] == cell if len(heavy) else np.zeros(len(cell), dtype=bool)
    out = [(cell[~hot], np.zeros((~hot).sum(), dtype=np.int64), index[~hot], visits[~hot])]
    for c in np.unique(cell[hot]):
        n = int(blocks[np.searchsorted(heavy, c)])
        at = np.flatnonzero(cell == c)
        i = index[at]
        own = (mix(fp[i] + np.uint64(1)) % np.uint64(n)).astype(np.int64)
        for k in range(n):
            mine, far = ~visits[at] & (own == k), ~visits[at] & (own > k)
            first = np.flatnonzero(mine | visits[at])
            out.append((np.full(len(first), c), np.full(len(first), k * n + k), i[first], visits[at][first]))
            # block k meets each later block: at home there, and visited by the later one's rows
            home, later = np.flatnonzero(mine), np.flatnonzero(far)
            others = np.arange(k + 1, n)
            out.append((np.full(len(home) * len(others), c), np.tile(k * n + others, len(home)), np.repeat(i[home], len(others)), np.zeros(len(home) * len(others), dtype=bool)))
            out.append((np.full(len(later), c), k * n + own[later], i[later], np.ones(len(later), dtype=bool)))
    return tuple(np.concatenate(x) for x in zip(*out))


def cell_links(cell: np.ndarray, fp: np.ndarray, visits: np.ndarray, distance: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what is connected in each cell. Rows are sorted by cell, and in a cell
    those at home come first; a pair of visitors is another cell's matter."""
    edge = np.flatnonzero(np.diff(cell)) + 1
    first = np.concatenate(([0], edge))
    size = np.diff(np.concatenate((first, [len(cell)])))
    home = np.add.reduceat(~visits, first) if len(cell) else np.zeros(0, dtype=np.int64)
    a_out, b_out = [], []
    for g in np.flatnonzero(size > SMALL_CELL):
        a, b = pivot_links(fp[first[g] : first[g] + home[g]], fp[first[g] + home[g] : first[g] + size[g]], distance)
        a_out.append(a)
        b_out.append(b)
    small = np.flatnonzero((size <= SMALL_CELL) & (size > 1) & (home > 0))
    first, size, home = first[small], size[small], home[small]
    # row k of a group's home rows meets the rows behind it
    left = np.repeat(first, home) + _within(home)
    right = np.repeat(first + size, home)
    n = right - left - 1
    at = 0
    total = np.cumsum(n)
    while at < len(n):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + _PAIRS_AT_ONCE, side="right")))
        a = np.repeat(left[at:to], n[at:to])
        b = a + 1 + _within(n[at:to])
        hit = np.bitwise_count(fp[a] ^ fp[b]) <= distance
        a_out.append(fp[a[hit]])
        b_out.append(fp[b[hit]])
        at = to
    if not a_out:
        return np.zeros(0, dtype=fp.dtype), np.zeros(0, dtype=fp.dtype)
    return np.concatenate(a_out), np.concatenate(b_out)


def _within(n: np.ndarray) -> np.ndarray:
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def pivot_links(home: np.ndarray, guests: np.ndarray, distance: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what is connected in a large cell, without all pairs of a large group.

    A home row becomes a pivot; rows within the distance are its members. What links to a member is
    within twice the distance of the pivot, and such a row leaves the search once it is linked, as
    one link is enough to connect it with a pivot's members."""
    a_out, b_out = [], []
    left, points = home, np.concatenate((home, guests))
    while len(left):
        p = left[0]
        d = np.bitwise_count(left ^ p)
        members = left[d <= distance]
        left = left[d > distance]
        d = np.bitwise_count(points ^ p)
        near = points[(d > 0) & (d <= distance)]
        a_out.append(np.full(len(near), p))
        b_out.append(near)
        open_ = points[(d > distance) & (d <= 2 * distance)]
        step = max(1, 2_000_000 // max(1, len(open_)))
        for i in range(0, len(members), step):
            if not len(open_):
                break
            hit = np.bitwise_count(members[i : i + step, None] ^ open_[None, :]) <= distance
            one = hit.any(axis=0)
            a_out.append(members[i : i + step][hit.argmax(axis=0)[one]])
            b_out.append(open_[one])
            open_ = open_[~one]
    if not a_out:
        return np.zeros(0, dtype=points.dtype), np.zeros(0, dtype=points.dtype)
    return np.concatenate(a_out), np.concatenate(b_out)


def with_fingerprint(docs: DataFrame, text_col: str = "text", name: str = "fp") -> DataFrame:
    """``docs`` with a long column ``name``; its bits are the fingerprint of the whole text."""
    ship(docs.sparkSession)
    at = docs.columns.index(text_col)

    def column(batch: pa.RecordBatch) -> pa.Array:
        texts = batch.column(at).to_pylist()
        out = np.concatenate([np.zeros(0, dtype=np.uint64), *(fingerprints(texts[s]) for s in chunks(texts))])
        return pa.array(out.view(np.int64))

    return with_batch_column(docs, name, T.LongType(), lambda: column)


def fingerprint_links(prints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints (column fp) that are connected."""
    if distance > 3:
        raise ValueError("the two grids find distances up to 3")
    spark = prints.sparkSession
    total = prints.count()
    most = max(CELL_ROWS, total // 1000)  # so that at most 2000 cells are heavy

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, n = np.unique(homes(batch.column(0).to_numpy().view(np.uint64))[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(n)], names=["cell", "n"])

    heavy, blocks = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    if total > most:
        got = prints.select("fp").mapInArrow(counted, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).where(F.col("n") > most).orderBy("cell").toPandas()
        heavy, blocks = got["cell"].to_numpy(dtype=np.int64), -(-got["n"].to_numpy(dtype=np.int64) // most)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                fp = batch.column(0).slice(i, 4096).to_numpy()
                cell, part, index, visits = blocked(*cells(fp.view(np.uint64)), fp.view(np.uint64), heavy, blocks)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cell.astype(np.int32)), pa.array(part.astype(np.int32)), pa.array(visits), pa.array(fp[index])],
                    names=["cell", "part", "visits", "fp"]
                )

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        rows = 0

        def links(part: tuple[np.ndarray, ...]) -> pa.RecordBatch:
            a, b = cell_links(part[0], part[2].view(np.uint64), part[1], distance)
            node, root = local_roots(a, b)
            on = node != root
            return pa.RecordBatch.from_arrays([pa.array(node[on].view(np.int64)), pa.array(root[on].view(np.int64))], names=["a", "b"])

        for batch in batches:
            held.append((batch.column(0).to_numpy().astype(np.int64) << 32 | batch.column(1).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False), batch.column(3).to_numpy()))
            rows += batch.num_rows
            if rows >= 200_000 and held[0][0][0] != held[-1][0][-1]:
                whole = tuple(np.concatenate(x) for x in zip(*held))
                cut = int(np.searchsorted(whole[0], whole[0][-1]))
                yield links(tuple(x[:cut] for x in whole))
                held, rows = [tuple(x[cut:] for x in whole)], len(whole[0]) - cut
        if held:
            yield links(tuple(np.concatenate(x) for x in zip(*held)))

    n = partitions_for(spark, 26 * total, 4_000_000)
    rows = prints.select("fp").mapInArrow(dealt, "cell int, part int, visits boolean, fp long")
    return rows.repartition(n, "cell", "part").sortWithinPartitions("cell", "part", "visits").mapInArrow(joined, "a long, b long")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE, row_col: str | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, fp (long), component_id.

    Texts without a word, null ones too, have fingerprint 0 and link like any other. component_id
    is the smallest identifier reachable over links; null identifiers don't count, and a component
    of such rows alone has null. With ``row_col``, a unique key of the rows, there are also ``row``
    (the key) and ``kept``: true for one row of a component, the one with the smallest identifier,
    then the smallest key; a null identifier comes last. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = docs.select(quoted(id_col).cast("long").alias("doc_id"), quoted(text_col).alias("t"), *([quoted(row_col).alias("row")] if row_col else []))
    rows = stage(spark, with_fingerprint(rows, "t").drop("t"), "fingerprints")
    first, more = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row"), ["first"] if row_col else []
    least = [F.min("doc_id").alias("least"), *([F.min(first).alias("first")] if row_col else [])]
    prints = stage(spark, rows.groupBy("fp").agg(*least), "distinct")
    found = connected_components(fingerprint_links(prints, distance)).select(F.col("node"), F.col("component").alias("root"))
    prints = prints.join(found, F.col("fp") == F.col("node"), "left").select("fp", "least", *more, F.coalesce("root", "fp").alias("root"))
    roots = prints.groupBy("root").agg(F.min("least").alias("component_id"), *(F.min(c).alias("kept_row") for c in more)).withColumnRenamed("root", "r")
    prints = prints.join(roots, F.col("root") == F.col("r")).select(
        F.col("fp").alias("f"), "component_id", *(F.col("kept_row.row").alias("kept_row") for _ in more)
    )
    kept = ["row", (F.col("row") == F.col("kept_row")).alias("kept")] if row_col else []
    return rows.join(prints, F.col("fp") == F.col("f")).select("doc_id", "fp", "component_id", *kept)
