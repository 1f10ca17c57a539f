"""Folders that driver and executors share, and small files in them.

Tables that a computation writes for itself lie below ``spark.checkpoint.dir``; a local
session that leaves it empty gets a temporary folder of its own.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = os.path.join(tempfile.gettempdir(), "checkpoints")
        os.makedirs(base, exist_ok=True)
        root = tempfile.mkdtemp(dir=base)
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to a new folder and read again: computed once, the same rows in each
    use, not lost with an executor."""
    path = new_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Store:
    """Files of a folder's store, by the paths that Spark takes."""

    def __init__(self, spark: SparkSession, root: str):
        self._jvm = spark._jvm
        self.root = root.rstrip("/")
        self._fs = self._path("").getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, folder: str) -> list[str]:
        """Names in a folder; none if there is no such folder."""
        path = self._path(folder)
        return [s.getPath().getName() for s in self._fs.listStatus(path)] if self._fs.exists(path) else []

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(name))

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(name), True)

    def rename(self, old: str, new: str) -> bool:
        self._fs.mkdirs(self._path(new).getParent())
        return self._fs.rename(self._path(old), self._path(new))

    def read(self, name: str) -> str:
        stream = self._fs.open(self._path(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        out = self._fs.create(self._path(name), True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def put_new(self, name: str, text: str) -> bool:
        """Writes a whole file under a name that no file has; False if one has it. Of
        several writers exactly one succeeds. The store must refuse to rename onto a file,
        as HDFS does; on a mounted one, a link is made, which never replaces."""
        part = f"{os.path.dirname(name)}/.{uuid.uuid4().hex}.tmp".lstrip("/")
        self.write(part, text)
        uri = urlparse(self._fs.makeQualified(self._path(part)).toString())
        try:
            if uri.scheme == "file":
                try:
                    os.link(uri.path, urlparse(self._fs.makeQualified(self._path(name)).toString()).path)
                except FileExistsError:
                    return False
                return True
            return not self.exists(name) and self._fs.rename(self._path(part), self._path(name))
        finally:
            self.delete(part)
