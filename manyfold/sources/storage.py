"""Folders and small files by Hadoop's file system interface: any store that Spark reads. Footers of
source files are read by pyarrow (``files.py``), so sources must be in a store that it reads too."""

from __future__ import annotations

import os
import tempfile
import uuid
from urllib.parse import unquote, urlparse

from pyspark.sql import SparkSession


class Storage:
    def __init__(self, spark: SparkSession):
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.conf)

    def qualified(self, path: str) -> str:
        p, fs = self._at(path)
        return fs.makeQualified(p).toUri().toString()

    def exists(self, path: str) -> bool:
        p, fs = self._at(path)
        return fs.exists(p)

    def mkdirs(self, path: str) -> None:
        p, fs = self._at(path)
        fs.mkdirs(p)

    def listed(self, path: str) -> list[tuple[str, bool, int, int, str]]:
        """(name, is a folder, bytes, modified, address) of what a folder holds, by name; a missing
        folder is an error."""
        p, fs = self._at(path)
        found = [(s.getPath().getName(), s.isDirectory(), s.getLen(), s.getModificationTime(), s.getPath().toUri().toString()) for s in fs.listStatus(p)]
        return sorted(x for x in found if not x[0].startswith((".", "_")) or x[0] == "_meta")

    def versions(self, path: str) -> list[str]:
        p, fs = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.getPath().getName().endswith(".json")) if fs.exists(p) else []

    def read_text(self, path: str) -> str:
        p, fs = self._at(path)
        stream = fs.open(p)
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def walk(self, path: str) -> list[tuple[str, int, int]]:
        """(address, bytes, modified) of all files below a folder, hidden ones left out."""
        p, fs = self._at(path)
        found, files = [], fs.listFiles(p, True)
        while files.hasNext():
            s = files.next()
            if not s.getPath().getName().startswith((".", "_")):
                found.append((s.getPath().toUri().toString(), s.getLen(), s.getModificationTime()))
        return sorted(found)

    def create(self, path: str, text: str) -> bool:
        """Publish a new file, whole or not at all; False if one is there already, which then stays
        as it is. The text is written under another name, which no reader looks at. On a local file
        system a link to it takes the name, in HDFS a rename, and both fail where the name is taken.
        Object stores have no such step: there, one writer at a time must be seen to."""
        p, fs = self._at(path)
        if fs.exists(p):
            return False
        part = self.jvm.org.apache.hadoop.fs.Path(p.getParent(), f".{uuid.uuid4().hex}.tmp")
        stream = fs.create(part, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        try:
            if fs.getUri().getScheme() != "file":
                return bool(fs.rename(part, p))
            local = lambda x: unquote(urlparse(fs.makeQualified(x).toUri().toString()).path)
            try:
                os.link(local(part), local(p))
            except FileExistsError:
                return False
            return True
        finally:
            fs.delete(part, False)

    def move(self, path: str, to: str) -> None:
        p, fs = self._at(path)
        fs.rename(p, self.jvm.org.apache.hadoop.fs.Path(to))

    def delete(self, path: str) -> None:
        p, fs = self._at(path)
        fs.delete(p, True)


def workspace(spark: SparkSession, name: str) -> str:
    """A new folder that all executors see: under spark.checkpoint.dir, or on this machine where
    that is unset and all executors are on it."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{shared or 'file://' + tempfile.mkdtemp(prefix='manyfold-')}/{name}-{uuid.uuid4().hex[:12]}"
