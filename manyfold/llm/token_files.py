"""Token-ID output in patched frame-of-reference blocks, and reading it back.

A file image holds whole documents. Layout, little endian:

    magic "PFB1", u32 block length, u64 documents, u64 ids, u64 blocks
    documents   i64 doc_id each, then u8 null flag each, u64 ids each
    block index u64 byte offset of each block from the start of the blocks
    blocks      u32 minimum, u8 width, u16 exceptions, then the packed differences
                (for each of the width's bits a plane of block length / 8 bytes; the low byte of a
                width of 8 or more lies as plain bytes), u16 exception positions, u32 exception values

A block's width is the bit length of a percentile of its differences from the minimum; larger
differences are exceptions.

Spark has no writer for raw files, so tasks write images as files of names that no other attempt
has, below ``data``, and the table ``listing``, which Spark commits whole, names those that count. A
folder without a listing holds nothing; what a lost attempt has left is not listed.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.files import store_of
from ..sources.storage import Storage
from ._common import quoted, ship, text_of
from .tokens import encoder

MAGIC, HEAD = b"PFB1", 32
BLOCK = 256
#: Blocks that are packed or unpacked together, at most.
BLOCKS_AT_ONCE = 2048
#: Bytes of text that a task encodes and writes, about.
PART_BYTES = 16 << 20
_BLOCK_HEAD = np.dtype([("low", "<u4"), ("width", "u1"), ("n", "<u2")])


def _widths(diff: np.ndarray, percentile: float) -> np.ndarray:
    k = min(diff.shape[1] - 1, int(np.ceil(diff.shape[1] * percentile / 100)) - 1)
    return np.frexp(np.partition(diff, k, axis=1)[:, k].astype(np.float64))[1].astype(np.int64)


def pack_blocks(ids: np.ndarray, percentile: float = 98.0, block: int = BLOCK) -> tuple[bytes, np.ndarray]:
    """The blocks' bytes and each block's offset; the last block is filled with its first id."""
    return _joined([x for i in range(0, len(ids), BLOCKS_AT_ONCE * block) for x in _packed(ids[i : i + BLOCKS_AT_ONCE * block], percentile, block)])


def _joined(blocks: list[bytes]) -> tuple[bytes, np.ndarray]:
    size = np.fromiter(map(len, blocks), dtype=np.int64, count=len(blocks))
    return b"".join(blocks), (np.cumsum(size) - size).astype("<u8")


def _packed(ids: np.ndarray, percentile: float, block: int) -> list[bytes]:
    """The bytes of each block."""
    n = -(-len(ids) // block)
    full = np.empty(n * block, dtype=np.uint32)
    full[: len(ids)] = ids
    full[len(ids) :] = ids[(n - 1) * block]
    full = full.reshape(n, block)
    low = full.min(axis=1)
    diff = full - low[:, None]
    width = _widths(diff, percentile)
    out = [b""] * n
    for w in np.unique(width):
        at = np.flatnonzero(width == w)
        d, w = diff[at], int(w)
        over = (d >> np.uint32(w)) > 0 if w < 32 else np.zeros(d.shape, dtype=bool)
        planes = []
        if w >= 8:
            planes.append((d & np.uint32(255)).astype(np.uint8))
        for b in range(8 if w >= 8 else 0, w):
            planes.append(np.packbits(((d >> np.uint32(b)) & np.uint32(1)).astype(np.uint8), axis=1, bitorder="little"))
        body = np.concatenate(planes, axis=1) if planes else np.zeros((len(at), 0), dtype=np.uint8)
        head = np.zeros(len(at), dtype=_BLOCK_HEAD)
        head["low"], head["width"], head["n"] = low[at], w, over.sum(axis=1)
        for k, i in enumerate(at):
            tail = b""
            if head["n"][k]:
                where = np.flatnonzero(over[k])
                tail = where.astype("<u2").tobytes() + d[k, where].astype("<u4").tobytes()
            out[i] = head[k].tobytes() + body[k].tobytes() + tail
    return out


def unpack_blocks(data: memoryview | bytes, index: np.ndarray, ids: int, block: int = BLOCK) -> np.ndarray:
    """The ids of all blocks; blocks of a width are unpacked together."""
    n = len(index)
    out = np.empty((n, block), dtype=np.uint32)
    raw, index = np.frombuffer(data, dtype=np.uint8), index.astype(np.int64)
    if not n:
        return out.reshape(-1)
    head = raw[index[:, None] + np.arange(_BLOCK_HEAD.itemsize)].copy().view(_BLOCK_HEAD).reshape(n)
    index = index + _BLOCK_HEAD.itemsize
    alike = [(int(w), np.flatnonzero(head["width"] == w)) for w in np.unique(head["width"])]
    for w, at in ((w, at[i : i + BLOCKS_AT_ONCE]) for w, at in alike for i in range(0, len(at), BLOCKS_AT_ONCE)):
        planes, low = max(0, w - 8) if w >= 8 else w, 8 if w >= 8 else 0
        size = (block if low else 0) + planes * block // 8
        body = raw[index[at][:, None] + np.arange(size)]
        d = body[:, :block].astype(np.uint32) if low else np.zeros((len(at), block), dtype=np.uint32)
        bits = np.unpackbits(body[:, block if low else 0 :], axis=1, bitorder="little").reshape(len(at), planes, block)
        for b in range(planes):
            d |= bits[:, b].astype(np.uint32) << np.uint32(low + b)
        for k in np.flatnonzero(head["n"][at]):
            m, a = int(head["n"][at[k]]), int(index[at[k]]) + size
            d[k, raw[a : a + 2 * m].view("<u2")] = raw[a + 2 * m : a + 6 * m].view("<u4")
        out[at] = d + head["low"][at][:, None]
    return out.reshape(-1)[:ids]


class Image:
    """A file image that documents are added to; only the last ids wait to be packed."""

    def __init__(self, percentile: float = 98.0):
        self.percentile, self.names, self.sizes = percentile, [], []
        self.blocks: list[bytes] = []
        self.open: list[bytes] = []
        self.waiting = 0

    def add(self, name: int | None, ids: bytes) -> None:
        """``ids`` are little-endian unsigned 32-bit bytes."""
        self.names.append(name)
        self.sizes.append(len(ids) // 4)
        self.open.append(ids)
        self.waiting += len(ids)
        if self.waiting >= 4 * BLOCK * BLOCKS_AT_ONCE:
            self._pack(self.waiting // (4 * BLOCK) * BLOCK)

    def _pack(self, n: int) -> None:
        ids = np.frombuffer(b"".join(self.open), dtype="<u4")
        for i in range(0, n, BLOCK * BLOCKS_AT_ONCE):
            self.blocks += _packed(ids[i : min(n, i + BLOCK * BLOCKS_AT_ONCE)], self.percentile, BLOCK)
        self.open, self.waiting = [ids[n:].tobytes()], 4 * (len(ids) - n)

    def bytes(self) -> bytes:
        self._pack(self.waiting // 4)
        data, index = _joined(self.blocks)
        names = np.array([0 if i is None else i for i in self.names], dtype="<i8")
        null = np.array([i is None for i in self.names], dtype=np.uint8)
        sizes = np.array(self.sizes, dtype="<u8")
        head = MAGIC + np.array([BLOCK], dtype="<u4").tobytes() + np.array([len(names), sum(self.sizes), len(index)], dtype="<u8").tobytes()
        return b"".join([head, names.tobytes(), null.tobytes(), sizes.tobytes(), index.tobytes(), data])


def write_image(docs: list[tuple[int | None, bytes]], percentile: float = 98.0) -> bytes:
    """A file image of documents given as (doc_id, ids as little-endian unsigned 32-bit bytes)."""
    image = Image(percentile)
    for name, ids in docs:
        image.add(name, ids)
    return image.bytes()


def _parts(image: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int, int]:
    if image[:4] != MAGIC:
        raise ValueError("not a token file")
    docs, ids, blocks = (int(x) for x in np.frombuffer(image, dtype="<u8", count=3, offset=8))
    at = HEAD
    names = np.frombuffer(image, dtype="<i8", count=docs, offset=at)
    null = np.frombuffer(image, dtype=np.uint8, count=docs, offset=at + 8 * docs)
    sizes = np.frombuffer(image, dtype="<u8", count=docs, offset=at + 9 * docs).astype(np.int64)
    index = np.frombuffer(image, dtype="<u8", count=blocks, offset=at + 17 * docs)
    return names, null, sizes, index, ids, at + 17 * docs + 8 * blocks


def read_image(image: bytes) -> Iterator[tuple[int | None, np.ndarray]]:
    """(doc_id, ids) of each document of a file image, in its order."""
    names, null, sizes, index, n, at = _parts(image)
    ids = unpack_blocks(memoryview(image)[at:], index, n)
    ends = np.cumsum(sizes)
    for name, no, end, size in zip(names.tolist(), null, ends.tolist(), sizes.tolist()):
        yield None if no else name, ids[end - size : end]


def read_range(image: bytes, start: int, stop: int) -> np.ndarray:
    """Ids start to stop of an image; only the blocks that hold them are unpacked."""
    _, _, _, index, n, at = _parts(image)
    start, stop = max(0, start), min(n, stop)
    if start >= stop:
        return np.zeros(0, dtype=np.uint32)
    a, b = start // BLOCK, -(-stop // BLOCK)
    got = unpack_blocks(memoryview(image)[at:], index[a:b], (b - a) * BLOCK)
    return got[start - a * BLOCK : stop - a * BLOCK]


def write_token_files(
    docs: DataFrame, tokenizer: str, path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text",
    image_bytes: int = 8 << 20
) -> DataFrame:
    """Write the token files of all rows below ``path``, which must hold none yet, and return their
    listing: part, number, docs, ids, bytes, file.

    Parts hold ascending identifiers (null first), numbers run within a part, a file ends after the
    document that fills it. A null text is empty and is its end id alone; rows of equal or null
    identifiers are written each. An empty table writes an empty listing.
    """
    spark = docs.sparkSession
    ship(spark)
    address = Storage(spark).qualified(path)
    end = np.array([end_id], dtype="<u4").tobytes()

    def images(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, held, size, number, part = encoder(tokenizer).parts, Image(), 0, 0, TaskContext.get().partitionId()

        def full() -> pa.RecordBatch:
            file, image = f"{address}/data/part-{part:06d}-{number:06d}-{uuid.uuid4().hex}.pfb", held.bytes()
            store, at = store_of(file)
            store.create_dir(at.rpartition("/")[0], recursive=True)
            with store.open_output_stream(at) as f:
                f.write(image)
            counts = {"number": number, "docs": len(held.names), "ids": sum(held.sizes), "bytes": len(image)}
            return pa.RecordBatch.from_pydict({k: pa.array([v], pa.int64()) for k, v in counts.items()} | {"file": pa.array([file])})

        for batch in batches:
            names = batch.column(0).to_pylist()
            for i, cells in encode(batch.column(1)):
                for name, ids in zip(names[i : i + len(cells)], cells):
                    held.add(name, ids + end)
                    size += len(ids) + 4
                    if size >= 2 * image_bytes:  # an id takes about half of its four bytes
                        yield full()
                        held, size, number = Image(), 0, number + 1
        if held.names:
            yield full()

    rows = docs.select(quoted(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    n = max(1, -(-(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // PART_BYTES))
    # copies of an identifier may be many, so their texts' hashes may part them
    rows = rows.withColumn("h", F.xxhash64("text")).repartitionByRange(n, "doc_id", "h").sortWithinPartitions("doc_id", "h")
    files = rows.select("doc_id", "text").mapInArrow(images, "number long, docs long, ids long, bytes long, file string")
    files = files.withColumn("part", F.spark_partition_id())
    files.write.parquet(f"{path}/listing")
    return listing(spark, path)


def listing(spark: SparkSession, path: str) -> DataFrame:
    """part, number, docs, ids, bytes, file of the token files below ``path``."""
    return spark.read.schema("number long, docs long, ids long, bytes long, file string, part int").parquet(f"{path}/listing")


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids (little-endian unsigned 32-bit bytes) of each document in the
    listed files; start counts the ids of all files before, from sums over parts and then within a
    part, and of the documents before in the file."""
    ship(spark)
    files = listing(spark, path)
    parts = files.groupBy("part").agg(F.sum("ids").alias("n"))
    parts = parts.select(F.col("part").alias("p"), (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    within = F.sum("ids").over(Window.partitionBy("part").orderBy("number")) - F.col("ids")
    starts = files.withColumn("within", within).join(parts, F.col("part") == F.col("p")).select("file", (F.col("before") + F.col("within")).alias("first_id"))
    count, cores = files.count(), spark.sparkContext.defaultParallelism

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, first in zip(*(c.to_pylist() for c in batch.columns)):
                store, at = store_of(file)
                with store.open_input_stream(at) as f:
                    names, ids = (list(x) for x in zip(*read_image(f.read())))
                for i in range(0, len(names), 4096):
                    n = np.array([len(x) for x in ids[i : i + 4096]], dtype=np.int64)
                    cells = [x.astype("<u4", copy=False).tobytes() for x in ids[i : i + 4096]]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(names[i : i + 4096], pa.int64()), pa.array(first + np.cumsum(n) - n), pa.array(n), pa.array(cells, pa.binary())],
                        names=["doc_id", "start", "n_tokens", "ids"]
                    )
                    first += int(n.sum())

    starts = starts.repartition(max(1, min(count, max(4 * cores, count // 8))))
    return starts.mapInArrow(decoded, "doc_id long, start long, n_tokens long, ids binary")
