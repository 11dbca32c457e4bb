"""Packing along a space-filling curve.

1. A document's token ids are hashed into DIMENSIONS counts; the unit vector of these is projected
   by fixed random signs to AXES coordinates, and those give a Hilbert key. The ids and the key are
   written once, so that nothing is tokenised twice.
2. Rows are range partitioned and sorted by (key, doc_id). Copies share a key; the identifier parts
   them, so a hot key spreads over partitions.
3. Each partition is one stream of ids along the curve, cut at every ``length`` ids: only the last
   sequence of a partition has padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import quoted, ship, stage, text_of
from ._words import mix
from .tokens import encoder

DIMENSIONS, AXES, AXIS_BITS, SPAN = 1024, 4, 10, 4.0
DOCS_AT_ONCE = 256
#: Ids of a batch of pieces that a task returns, about.
BATCH_IDS = 1 << 20
#: Bytes of ids, as they are staged, of a partition, about: the last sequence of each has padding.
PART_BYTES = 16 << 20


def hilbert_key(points: np.ndarray, bits: int = AXIS_BITS) -> np.ndarray:
    """The position of each point, a row of unsigned coordinates of ``bits`` bits, on the Hilbert
    curve (after Skilling, 2004)."""
    x = [points[:, i].astype(np.int64) for i in range(points.shape[1])]
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(len(x)):
            on, p = (x[i] & q) > 0, q - 1
            t = np.where(on, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(on, x[0] ^ p, x[0] ^ t)
            if i:
                x[i] = x[i] ^ t
        q >>= 1
    for i in range(1, len(x)):
        x[i] = x[i] ^ x[i - 1]
    t, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        t = np.where((x[-1] & q) > 0, t ^ (q - 1), t)
        q >>= 1
    key = np.zeros_like(t)
    for b in range(bits - 1, -1, -1):
        for a in x:
            key = key << 1 | ((a ^ t) >> b) & 1
    return key


def curve_keys(ids: list[np.ndarray]) -> np.ndarray:
    """The Hilbert key of each document's hashed and projected vector; a document without ids has
    the key of the origin."""
    n = len(ids)
    doc = np.repeat(np.arange(n), [len(x) for x in ids])
    all_ids = np.concatenate(ids) if n else np.zeros(0, dtype=np.uint32)
    with np.errstate(over="ignore"):
        place = (mix(np.arange(int(all_ids.max(initial=0)) + 1, dtype=np.uint64)) >> np.uint64(54)).astype(np.int64)
        counts = np.bincount(doc * DIMENSIONS + place[all_ids], minlength=n * DIMENSIONS).reshape(n, DIMENSIONS).astype(np.float64)
        signs = np.where(mix(np.arange(DIMENSIONS * AXES, dtype=np.uint64) + np.uint64(1 << 32)) >> np.uint64(63), 1.0, -1.0).reshape(DIMENSIONS, AXES)
    norm = np.sqrt((counts * counts).sum(axis=1))
    at = (counts @ signs) / np.maximum(norm, 1e-12)[:, None]
    cells = np.clip((at + SPAN) / (2 * SPAN) * (1 << AXIS_BITS), 0, (1 << AXIS_BITS) - 1).astype(np.int64)
    return hilbert_key(cells)


def pack(
    docs: DataFrame, tokenizer: str, length: int = 2048, end_id: int = 1, id_col: str = "doc_id",
    text_col: str = "text", with_ids: bool = True
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and,
    if asked for, ids (little-endian unsigned 32-bit bytes).

    A null text is empty and packs as its end id alone. Every row of ``docs`` is packed, rows with
    equal or null identifiers too; an empty table gives no piece. sequence_id is the partition
    times 2 ** 32 plus the sequence's number in it.
    """
    spark = docs.sparkSession
    ship(spark)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = encoder(tokenizer)
        small = np.dtype("<u2") if max(made.library.get_vocab_size(), end_id + 1) <= 1 << 16 else np.dtype("<u4")
        for batch in batches:
            for at, part in made.parts(batch.column(1)):
                for i in range(0, len(part), DOCS_AT_ONCE):
                    ids = [np.frombuffer(x, dtype="<u4") for x in part[i : i + DOCS_AT_ONCE]]
                    cells = pa.array([x.astype(small).tobytes() for x in ids], pa.binary())
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(at + i, len(ids)), pa.array(curve_keys(ids)), pa.array([small.itemsize] * len(ids), pa.int32()), cells],
                        names=["doc_id", "key", "width", "ids"]
                    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([end_id], dtype="<u4")
        sequence, offset, size = 0, 0, 0
        for batch in batches:
            part, width, names, cells = (batch.column(i) for i in range(4))
            rows: list[list] = [[] for _ in range(8)]
            for i in range(batch.num_rows):
                ids = np.concatenate((np.frombuffer(cells[i].as_buffer(), dtype=f"<u{width[i].as_py()}").astype("<u4"), end))
                name, base, start = names[i].as_py(), part[i].as_py() << 32, 0
                while start < len(ids):
                    n = min(length - offset, len(ids) - start)
                    piece = ids[start : start + n]
                    for to, x in zip(rows, (name, start, n, zlib.crc32(piece.data), len(ids), base + sequence, offset, piece.tobytes() if with_ids else None)):
                        to.append(x)
                    start, offset = start + n, offset + n
                    if offset == length:
                        sequence, offset = sequence + 1, 0
                    size += n + 64  # what a row costs beside its ids
                    if size >= BATCH_IDS:
                        yield _pieces(rows, with_ids)
                        rows, size = [[] for _ in range(8)], 0
            if rows[0]:
                yield _pieces(rows, with_ids)
                size = 0

    rows = docs.select(quoted(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    rows = stage(spark, rows.mapInArrow(keyed, "doc_id long, key long, width int, ids binary").withColumn("h", F.xxhash64("ids")), "curve")
    n = max(1, -(-(rows.agg(F.sum(F.octet_length("ids"))).first()[0] or 0) // PART_BYTES))
    order = ("key", "doc_id", "h")
    rows = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).select(F.spark_partition_id().cast("long").alias("part"), "width", "doc_id", "ids")
    return rows.mapInArrow(
        cut,
        "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + (", ids binary" if with_ids else "")
    )


def _pieces(rows: list[list], with_ids: bool) -> pa.RecordBatch:
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    out = {k: pa.array(v, pa.int64()) for k, v in zip(names, rows)}
    return pa.RecordBatch.from_pydict(out | ({"ids": pa.array(rows[7], pa.binary())} if with_ids else {}))
