"""What the operators share: the code on the executors, the shared folder, plain columns."""

from __future__ import annotations

import atexit
import contextlib
import gc
import os
import tempfile
import uuid
import weakref
import zipfile
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path
from typing import TypeVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: ASCII white space as the contracts have it.
SPACE_CLASS = r"[\x20\x09-\x0D]"

Held = TypeVar("Held")

_shipped: set[str] = set()
_held: dict[str, object] = {}
_roots: set[str] = set()
#: Folders that were staged, in order, and those of the tables that still have a name.
_staged: list[str] = []
_at: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that functions sent to
    them are imported there by name and what a worker caches outlives a task."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = Path(__file__).resolve().parents[1]
    to = Path(tempfile.mkdtemp(prefix="ship-")) / f"{package.name}.zip"
    with zipfile.ZipFile(to, "w", zipfile.ZIP_DEFLATED) as z:
        for f in package.rglob("*.py"):
            z.write(f, f.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(to))
    _shipped.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; where that is unset in
    a local session, as in tests, a temporary folder of this machine. On a cluster it must be set."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="checkpoint-")
        spark.conf.set("spark.checkpoint.dir", found)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(found)
    return found


def own_folder(spark: SparkSession, name: str) -> str:
    """The name of a new folder in the shared one, deleted at the end of the application."""
    root = f"{shared_dir(spark)}/llm-{spark.sparkContext.applicationId}"
    if root not in _roots:
        _roots.add(root)
        atexit.register(clean, spark)
    return f"{root}/{name}-{uuid.uuid4().hex}"


def stage(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: lineage is cut, lost
    executors lose nothing, and what follows sees one fixed result. Results are lazy and may read
    it at any time, so it stays until ``clean`` or the end of the application."""
    path = own_folder(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _staged.append(path)
    _at[out] = path
    return out


def mark() -> int:
    """A point in what this application has staged, for ``drop``."""
    return len(_staged)


def drop(spark: SparkSession, since: int, keep: Iterable[DataFrame] = (), until: int | None = None) -> None:
    """Delete what was staged from one mark to another, but for ``keep``: when all that reads it has
    been written."""
    until = len(_staged) if until is None else until
    kept = {_at.get(df) for df in keep}
    for k in range(since, until):
        if _staged[k] and _staged[k] not in kept:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_staged[k])
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
            _staged[k] = ""


def unused(columns: Iterable[str], name: str) -> str:
    """``name``, or a longer one that no column has in any case of letters."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def quoted(name: str) -> Column:
    """The column of exactly this name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def clean(spark: SparkSession) -> None:
    """Delete what this application has staged; lazy results that read it are void from then on."""
    with contextlib.suppress(Exception):  # at the end of the application the session may be gone
        root = f"{shared_dir(spark)}/llm-{spark.sparkContext.applicationId}"
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        _roots.discard(root)


def text_of(name: str = "text") -> Column:
    """A text column where null counts as empty."""
    return F.coalesce(quoted(name).cast("string"), F.lit(""))


def partitions_for(spark: SparkSession, rows: int, each: int) -> int:
    """So many partitions that each holds about ``each`` rows, the session's number at least."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // each), 1)


def worker_threads_off() -> None:
    """One thread for each Python worker: the executor's cores are taken by its tasks."""
    for k, v in (("TOKENIZERS_PARALLELISM", "false"), ("RAYON_NUM_THREADS", "1"), ("OMP_NUM_THREADS", "1"), ("OPENBLAS_NUM_THREADS", "1")):
        os.environ.setdefault(k, v)


def held(key: str, make: Callable[[], Held]) -> Held:
    """What a worker keeps from task to task: one thing at a time, so that what operators keep that
    follow one another in the same workers doesn't add up."""
    if key not in _held:
        _held.clear()
        gc.collect()
        _held[key] = make()
    return _held[key]


def with_batch_column(df: DataFrame, name: str, kind: T.DataType, make: Callable[[], Callable[[pa.RecordBatch], pa.Array]]) -> DataFrame:
    """``df`` with one more column, which a function makes from a batch; ``make`` gives it, and a worker
    keeps it for this column's tasks. The columns go through by their places, so that their names may have any characters."""
    plain = df.toDF(*(f"c{k}" for k in range(len(df.columns))))
    new, key = f"c{len(df.columns)}", uuid.uuid4().hex

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        column = held(key, make)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, column(batch)], names=[*batch.schema.names, new])

    return plain.mapInArrow(f, T.StructType([*plain.schema.fields, T.StructField(new, kind)])).toDF(*df.columns, name)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of what is written and no longer referred to."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
