"""Embedding near-dedup by an epsilon grid order join.

1. Equal vectors form a class; only classes take part, weighted by their size. Vectors of one
   length are compared with one another, each length on dimensions and in intervals of its own.
2. The covariance of a length's vectors, summed up on the executors, gives leading principal
   dimensions. Unit vectors with cosine >= c are within epsilon = sqrt(2 - 2c), in any of these
   dimensions too. A length of one interval at most has nothing to skip and takes its first ones.
3. Classes are sorted by their grid cells of width epsilon on these dimensions (epsilon grid order,
   Boehm et al., 2001) and cut into sequence intervals of INTERVAL classes. An interval knows the
   bounds of its runs of LEAF classes: a box on the leading dimensions, a centre and a radius.
4. Neighbouring intervals form groups, and a task has two groups, so an interval is sent once for each
   group and not for each interval. First only bounds are sent: a pair of intervals is joined if two
   of their runs may be within epsilon by box and by centres, and only intervals with a partner are
   sent to the task at all. A join halves its intervals again and again, skipping parts whose boxes
   are farther apart, down to leaves. A leaf is a product in single precision; what is near the
   threshold is decided in double precision.
5. A task returns counts of links, and a spanning forest of its links, never all pairs.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import drop, mark, partitions_for, quoted, ship, stage
from ._graph import connected_components, local_roots

AXES = 8
INTERVAL = 4096
LEAF = 512
#: Bytes of the vectors that a task has of each of its two groups, about.
GROUP_BYTES = 16 << 20
#: Single-precision products are this near to the true ones by a wide margin.
DOUBT = 1e-4

log = logging.getLogger(__name__)


def clean(column: pa.ListArray, kind: str = "<f8") -> list[bytes | None]:
    """Each vector as little-endian numbers of a kind; None where it is null, empty, zero, or holds
    null or non-finite components."""
    size = np.zeros(len(column), dtype=np.int64)
    there = ~column.is_null().to_numpy(zero_copy_only=False)
    size[there] = np.diff(column.offsets.to_numpy().astype(np.int64))[there]
    flat = column.flatten()  # without what lies under nulls
    x = flat.to_numpy(zero_copy_only=False).astype(kind) + np.array(0, dtype=kind)  # -0 becomes 0
    ends = np.cumsum(size)
    bad = np.concatenate(([0], np.cumsum(~np.isfinite(x) | flat.is_null().to_numpy(zero_copy_only=False))))
    some = np.concatenate(([0], np.cumsum(x != 0)))
    ok = (bad[ends] == bad[ends - size]) & (some[ends] > some[ends - size])
    data, width = x.tobytes(), x.itemsize
    return [data[width * (e - n) : width * e] if k else None for e, n, k in zip(ends.tolist(), size.tolist(), ok.tolist())]


def _units(blob: bytes, dims: int, kind: str = "<f8") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors, each times a power of two that brings its largest component near 1 (which is exact,
    and squares neither overflow nor vanish), their norms and the unit vectors."""
    v = np.frombuffer(blob, dtype=kind).reshape(-1, dims).astype("<f8")
    v = np.ldexp(v, -np.frexp(np.abs(v).max(axis=1))[1][:, None])
    norm = np.sqrt(np.einsum("ij,ij->i", v, v))
    return v, norm, v / norm[:, None]


def principal_axes(classes: DataFrame, dims: int, axes: int = AXES, kind: str = "<f8") -> np.ndarray:
    """dims x axes: the leading eigenvectors of the unit vectors' covariance over all classes.
    What reaches the driver is one row for each pair of dimensions."""
    at = np.triu_indices(dims)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, second, n = np.zeros(dims), np.zeros((dims, dims)), 0
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                u = _units(b"".join(batch.column(0).slice(i, 4096).to_pylist()), dims, kind)[2]
                total, second, n = total + u.sum(axis=0), second + u.T @ u, n + len(u)
        flat = np.concatenate(([n], total, second[at]))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], names=["k", "x"])

    flat = np.array([r[1] for r in classes.select("v").mapInArrow(sums, "k long, x double").groupBy("k").agg(F.sum("x")).orderBy("k").collect()])
    if not len(flat) or flat[0] == 0:
        return np.eye(dims, min(axes, dims))
    mean = flat[1 : dims + 1] / flat[0]
    second = np.zeros((dims, dims))
    second[at] = flat[dims + 1 :] / flat[0]
    second = second + np.triu(second, 1).T - np.outer(mean, mean)
    return np.linalg.eigh(second)[1][:, ::-1][:, : min(axes, dims)].copy()


def _gap(lo_a: np.ndarray, hi_a: np.ndarray, lo_b: np.ndarray, hi_b: np.ndarray) -> float:
    """The squared distance of two boxes."""
    d = np.maximum(0, np.maximum(lo_a - hi_b, lo_b - hi_a))
    return float(d @ d)


def join_tile(a: tuple, b: tuple, same: bool, basis: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of two intervals (vectors, norms, units, ids, sizes): linked rows of others for each row of
    a and of b (of a alone if they are the same), and links (x, y) that connect what is connected."""
    limit = 2 - 2 * cosine + 1e-9
    pa_, pb = a[2] @ basis, b[2] @ basis
    ua, ub = a[2].astype(np.float32), b[2].astype(np.float32)
    na, nb = np.zeros(len(ua), dtype=np.int64), np.zeros(len(ub), dtype=np.int64)
    xs, ys = [], []
    todo = [(0, len(ua), 0, len(ub))]
    while todo:
        i, j, k, m = todo.pop()
        if same and j <= k:
            continue  # its mirror image is joined
        if _gap(pa_[i:j].min(axis=0), pa_[i:j].max(axis=0), pb[k:m].min(axis=0), pb[k:m].max(axis=0)) > limit:
            continue
        if j - i > LEAF or m - k > LEAF:
            if j - i >= m - k and not (same and (i, j) == (k, m)):
                h = i + max(LEAF, (j - i) // 2)
                todo += [(i, h, k, m), (h, j, k, m)]
            elif same and (i, j) == (k, m):
                h = i + max(LEAF, (j - i) // 2)
                todo += [(i, h, i, h), (h, j, i, h), (h, j, h, j)]
            else:
                h = k + max(LEAF, (m - k) // 2)
                todo += [(i, j, k, h), (i, j, h, m)]
            continue
        s = ua[i:j] @ ub[k:m].T
        hit = s >= cosine + DOUBT
        r, c = np.nonzero(np.abs(s - cosine) < DOUBT)
        for t in range(0, len(r), 20_000):
            rr, cc = r[t : t + 20_000], c[t : t + 20_000]
            exact = np.einsum("ij,ij->i", a[0][i + rr], b[0][k + cc]) / (a[1][i + rr] * b[1][k + cc])
            hit[rr, cc] = exact >= cosine
        mirror = same and (i, j) == (k, m)
        if mirror:
            np.fill_diagonal(hit, False)
        if not hit.any():
            continue
        na[i:j] += hit @ b[4][k:m]
        if not mirror:
            (na if same else nb)[k:m] += a[4][i:j] @ hit
        r, c = np.nonzero(hit)
        node, root = local_roots(a[3][i:j][r], b[3][k:m][c])
        xs.append(node[node != root])
        ys.append(root[node != root])
    if not xs:
        return na, nb, np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    node, root = local_roots(np.concatenate(xs), np.concatenate(ys))
    return na, nb, node[node != root], root[node != root]


def bounds(units: np.ndarray, basis: np.ndarray) -> bytes:
    """Of each run of LEAF unit vectors: the box on the basis, the centre and the radius."""
    p, out = units @ basis, []
    for i in range(0, len(units), LEAF):
        u, q = units[i : i + LEAF], p[i : i + LEAF]
        centre = u.mean(axis=0)
        radius = np.sqrt(((u - centre) ** 2).sum(axis=1).max())
        out.append(np.concatenate((q.min(axis=0), q.max(axis=0), centre, [radius])))
    return np.array(out, dtype="<f8").tobytes()


def may_link(a: bytes, b: bytes, dims: int, axes: int, width: float) -> bool:
    """Whether vectors of two intervals may be within ``width``, by their runs' bounds."""
    x, y = (np.frombuffer(v, dtype="<f8").reshape(-1, 2 * axes + dims + 1) for v in (a, b))
    gap = np.maximum(0, np.maximum(x[:, None, :axes] - y[None, :, axes : 2 * axes], y[None, :, :axes] - x[:, None, axes : 2 * axes]))
    near = (gap * gap).sum(axis=2) <= width * width + 1e-9
    if not near.any():
        return False
    i, j = np.nonzero(near)
    apart = np.sqrt(((x[i, 2 * axes : -1] - y[j, 2 * axes : -1]) ** 2).sum(axis=1)) - x[i, -1] - y[j, -1]
    return bool((apart <= width + 1e-6).any())


def near_vectors(vectors: DataFrame, cosine: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links, component_id, kept.

    Vectors link with vectors of their length. Those that are null, empty, zero, or hold null or
    non-finite components link with nothing; neither do rows without an identifier, whose
    component_id is null. Components of any finite size will do. Copies link with one another. An
    empty table gives an empty result; further columns are not looked at.
    """
    spark = vectors.sparkSession
    ship(spark)
    # single-precision input is kept and sent as that; all computing is in double precision
    single = vectors.select(quoted(vector_col).alias("e")).schema["e"].dataType == T.ArrayType(T.FloatType())
    kind, item = ("<f4", 4) if single else ("<f8", 8)
    rows = vectors.select(quoted(id_col).cast("long").alias("vec_id"), quoted(vector_col).cast("array<float>" if single else "array<double>").alias("e"))

    def cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(clean(batch.column(1), kind), pa.binary())], names=["vec_id", "v"])

    rows = rows.mapInArrow(cleaned, "vec_id long, v binary")
    rows = rows.withColumn("h", F.when(F.col("vec_id").isNotNull(), F.unhex(F.sha2("v", 256))))
    rows = stage(spark, rows, "vectors")
    classes = stage(
        spark,
        rows.where("h is not null").groupBy("h").agg(
            F.min("vec_id").alias("id"), F.count("*").alias("n"), F.first("v").alias("v")
        ).withColumn("d", (F.octet_length("v") / item).cast("int")),
        "classes"
    )
    began = mark()
    lengths = {r["d"]: r["count"] for r in classes.groupBy("d").count().collect()}
    bases = {d: principal_axes(classes.where(F.col("d") == d), d, kind=kind) for d, c in sorted(lengths.items()) if c > INTERVAL}
    basis_of = lambda d: bases[d] if d in bases else np.eye(d, min(AXES, d))
    width = float(np.sqrt(2 - 2 * cosine))

    def gridded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v, ds, cells = batch.column(3).to_pylist(), batch.column(0).to_numpy(), [b""] * batch.num_rows
            for d in np.unique(ds).tolist():
                at = np.flatnonzero(ds == d).tolist()
                p = _units(b"".join([v[i] for i in at]), d, kind)[2] @ basis_of(d)
                for i, c in zip(at, np.floor((p + 1) / width).clip(0, 65535).astype(">u2")):
                    cells[i] = c.tobytes()
            yield pa.RecordBatch.from_arrays([pa.array(cells, pa.binary()), *batch.columns], names=["cell", "d", "id", "n", "v"])

    n = partitions_for(spark, sum(lengths.values()), 16 * INTERVAL)
    grid = classes.select("d", "id", "n", "v").mapInArrow(gridded, "cell binary, d int, id long, n long, v binary")
    grid = grid.repartitionByRange(n, "d", "cell", "id").sortWithinPartitions("d", "cell", "id").select(
        "cell", "d", "id", "n", "v", F.spark_partition_id().alias("part"),
        F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("row")
    )
    grid = stage(spark, grid, "grid-order")
    parts = grid.groupBy("part").agg(F.count("*").alias("c"))
    parts = parts.select(F.col("part").alias("p"), (F.sum("c").over(Window.orderBy("part")) - F.col("c")).alias("before"))
    grid = grid.join(parts, F.col("part") == F.col("p")).withColumn("interval", F.floor((F.col("before") + F.col("row")) / INTERVAL).cast("long"))

    def packed(t: pa.Table) -> pa.Table:
        t = t.sort_by([("cell", "ascending"), ("id", "ascending")])
        blob, d = b"".join(t.column("v").to_pylist()), t.column("d")[0].as_py()
        as_bytes = lambda c: t.column(c).to_numpy().astype("<i8").tobytes()
        blobs = {"ids": as_bytes("id"), "sizes": as_bytes("n"), "vectors": blob, "bounds": bounds(_units(blob, d, kind)[2], basis_of(d))}
        return pa.table({"d": t.column("d").slice(0, 1), "interval": t.column("interval").slice(0, 1)} | {k: pa.array([v], pa.binary()) for k, v in blobs.items()})

    blocks = grid.select("d", "interval", "cell", "id", "n", "v").groupBy("d", "interval").applyInArrow(
        packed, "d int, interval long, ids binary, sizes binary, vectors binary, bounds binary"
    )
    blocks = stage(spark, blocks, "intervals")
    # groups of neighbouring intervals: as many as fit a task, fewer while there are not tasks for all cores
    cores = spark.sparkContext.defaultParallelism
    each = {}
    for d, c in lengths.items():
        intervals = -(-c // INTERVAL) + 1  # an interval may lie across two lengths' ends
        groups = min(intervals, max(-(-intervals * INTERVAL * d * item // GROUP_BYTES), int(np.ceil(np.sqrt(4 * cores)))))
        each[d] = -(-intervals // groups)
    sizes = spark.createDataFrame(sorted(each.items()), "gd int, each int")  # a row for each length
    grouped = blocks.join(F.broadcast(sizes), F.col("d") == F.col("gd")).withColumn(
        "g", F.floor(F.col("interval") / F.col("each")).cast("int")
    ).drop("gd", "each")
    meet = grouped.select("d", "g").distinct()
    meet = meet.select("d", F.col("g").alias("i")).join(
        meet.select(F.col("d").alias("e"), F.col("g").alias("j")),
        (F.col("d") == F.col("e")) & (F.col("i") <= F.col("j"))
    ).drop("e")
    meet = meet.withColumn("g", F.explode(F.array_distinct(F.array("i", "j")))).select(F.col("d").alias("md"), "i", "j", F.col("g").alias("mg"))
    same = (F.col("d") == F.col("md")) & (F.col("g") == F.col("mg"))

    def paired(t: pa.Table) -> pa.Table:
        d, i, j = (t.column(c)[0].as_py() for c in ("d", "i", "j"))
        held = sorted(zip(t.column("g").to_pylist(), t.column("interval").to_pylist(), t.column("bounds").to_pylist()))
        axes, left, right = min(AXES, d), [x for x in held if x[0] == i], [x for x in held if x[0] == j]
        pairs = [(x, y) for x in left for y in right if x[1] <= y[1]]
        near = [(x[1], y[1]) for x, y in pairs if x[1] == y[1] or may_link(x[2], y[2], d, axes, width)]
        partners: dict[int, list[int]] = {k: [] for p in near for k in p}
        for x, y in near:
            partners[x].append(y)
        # the last row is no interval's: it says how many pairs there were
        n = len(partners) + 1
        return pa.table({"d": pa.array([d] * n, pa.int32()), "i": pa.array([i] * n, pa.int32()), "j": pa.array([j] * n, pa.int32()), "interval": pa.array([*partners, -1], pa.int64()), "partners": pa.array([*partners.values(), []], pa.list_(pa.int64())), "pairs": pa.array([0] * (n - 1) + [len(pairs)], pa.int64())})

    tasks = grouped.select("d", "g", "interval", "bounds").join(meet, same).groupBy("d", "i", "j").applyInArrow(
        paired, "d int, i int, j int, interval long, partners array<long>, pairs long"
    )
    tasks = stage(spark, tasks, "pairs")
    joined, every = (int(x or 0) for x in tasks.agg(F.sum(F.size("partners")), F.sum("pairs")).first())
    log.info("%d of %d pairs of intervals are joined", joined, every)

    def tiled(t: pa.Table) -> pa.Table:
        d, got, todo, counts, xs, ys = t.column("d")[0].as_py(), {}, [], [], [], []
        for r in t.select(["interval", "partners", "ids", "sizes", "vectors"]).to_pylist():
            got[r["interval"]] = (*_units(r["vectors"], d, kind), np.frombuffer(r["ids"], dtype="<i8"), np.frombuffer(r["sizes"], dtype="<i8"))
            todo += [(r["interval"], k) for k in r["partners"]]
        links = {k: np.zeros(len(x[3]), dtype=np.int64) for k, x in got.items()}
        for i, j in sorted(todo):
            na, nb, x, y = join_tile(got[i], got[j], i == j, basis_of(d), cosine)
            links[i] += na
            links[j] += nb
            xs.append(x)
            ys.append(y)
        for k, n in links.items():
            at = np.flatnonzero(n)
            counts.append((got[k][3][at], n[at]))
        node, root = local_roots(np.concatenate(xs), np.concatenate(ys))
        node, root = node[node != root], root[node != root]
        ids, n = (np.concatenate(x) for x in zip(*counts))
        return pa.table({"x": np.concatenate((ids, node)), "y": np.concatenate((n, root)), "link": np.concatenate((np.zeros(len(ids), dtype=bool), np.ones(len(node), dtype=bool)))})

    found = tasks.drop("pairs").join(
        blocks.select(F.col("d").alias("bd"), F.col("interval").alias("bi"), "ids", "sizes", "vectors"),
        (F.col("d") == F.col("bd")) & (F.col("interval") == F.col("bi"))
    ).drop("bd", "bi")
    found = stage(spark, found.groupBy("d", "i", "j").applyInArrow(tiled, "x long, y long, link boolean"), "tiles")
    drop(spark, began, keep=[found])  # the grid, its intervals and their pairs
    counts = found.where("not link").groupBy(F.col("x").alias("ci")).agg(F.sum("y").alias("links"))
    parts = connected_components(found.where("link").select(F.col("x").alias("a"), F.col("y").alias("b")))
    known = classes.select("h", "id", "n").join(counts, F.col("id") == F.col("ci"), "left").join(parts, F.col("id") == F.col("node"), "left")
    known = known.select(
        F.col("h").alias("kh"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).cast("long").alias("links"),
        F.coalesce("component", "id").alias("component")
    )
    out = rows.select("vec_id", "h").join(known, F.col("h") == F.col("kh"), "left")
    component = F.coalesce("component", "vec_id")
    return out.select(
        "vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(component == F.col("vec_id"), F.lit(False)).alias("kept")
    )
