"""Shared storage for cut lineage and for the files that operators write.

Everything lands under the folder that the cluster names in
``spark.checkpoint.dir``; where it is unset, a temporary folder is made on a
master of one machine, as in tests, and an error raised on any other.  Executors open files through ``pyarrow.fs``, so any
store it knows by URI will do.
"""

from __future__ import annotations

import posixpath
import re
import tempfile
import uuid

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder shared by driver and executors."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="touchline-")
        spark.sparkContext.setCheckpointDir(root)
    elif not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(root)
    return root


def new_folder(spark: SparkSession, kind: str) -> str:
    """A fresh, unique folder name below the shared root (not yet made)."""
    return posixpath.join(shared_root(spark), f"{kind}-{uuid.uuid4().hex}")


def cut(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and keep its rows in reliable shared storage."""
    shared_root(df.sparkSession)
    return df.checkpoint(eager=True)


def store(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI, and the path in it."""
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return pafs.FileSystem.from_uri(uri)


class AtomicFile:
    """A file that appears under its name only when complete.

    Each task attempt writes a name of its own and renames it at the end, so a
    retried or speculative attempt replaces the file by the same bytes.
    """

    def __init__(self, folder: str, name: str):
        self.fs, path = store(folder)
        self.fs.create_dir(path, recursive=True)
        self.target = posixpath.join(path, name)
        self.temp = f"{self.target}.{uuid.uuid4().hex}.tmp"
        self.out = self.fs.open_output_stream(self.temp)
        self.size = 0

    def write(self, data) -> int:
        """Append; returns the offset at which ``data`` begins."""
        at = self.size
        self.out.write(data)
        self.size += len(data)
        return at

    def commit(self) -> None:
        self.out.close()
        self.fs.move(self.temp, self.target)

    def abandon(self) -> None:
        self.out.close()
        self.fs.delete_file(self.temp)
