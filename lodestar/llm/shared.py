"""The folder that driver and executors share, and files in it.

A table that cuts lineage, a block of queries or a token file must be visible to
every executor, so it goes below ``spark.checkpoint.dir``. Only a local session
that leaves the setting empty (tests, notebooks) gets a folder of its own.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """Folder below ``spark.checkpoint.dir``; a temporary one in a local session without it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = os.path.join(tempfile.gettempdir(), "checkpoints")
        os.makedirs(base, exist_ok=True)
        root = tempfile.mkdtemp(dir=base)
        spark.conf.set("spark.checkpoint.dir", root)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


#: Bytes of rows that a Python task gets at once: long texts then need no more memory.
BATCH_BYTES = 4 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, after bounding the session's Arrow batches by bytes as well as by rows."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


#: Ids that a broadcast may hold, about 100 MB as a hash table in each executor.
BROADCAST_IDS = 2_000_000


def checked(ids: DataFrame, rows: int) -> DataFrame:
    """``ids`` to be joined: broadcast if their number of rows is within the bound, else
    left to a shuffled join."""
    return F.broadcast(ids) if rows <= BROADCAST_IDS else ids


def fresh(name: str, taken: list[str]) -> str:
    """``name``, lengthened until no column of the input is called so."""
    while name.lower() in {c.lower() for c in taken}:
        name += "_"
    return name


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: computed once,
    without lineage, and not lost with an executor."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables of one computation, in a folder of their own that goes when the context
    ends: what is needed after it has to be written elsewhere before."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.n = spark, new_path(spark, "scratch"), 0

    def path(self, df: DataFrame, label: str) -> str:
        """The path of a new table with the rows of ``df``."""
        self.n += 1
        path = f"{self.folder}/{self.n:04d}-{label}"
        df.write.parquet(path)
        return path

    def remove(self, path: str) -> None:
        """Removes a table that nothing reads any more."""
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)

    def table(self, df: DataFrame, label: str) -> DataFrame:
        return self.spark.read.schema(df.schema).parquet(self.path(df, label))

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def quoted(names: list[str]) -> list[Column]:
    """Columns by these names, dots and other marks in them taken as they are."""
    return [F.col("`" + n.replace("`", "``") + "`") for n in names]


def numbered(df: DataFrame, keep: list[str], **more: Column) -> DataFrame:
    """The columns ``keep`` under the names c0, c1, ..., and others, for a function on
    batches: such functions can't take names with dots."""
    return df.select(*(c.alias(f"c{i}") for i, c in enumerate(quoted(keep))), *(c.alias(n) for n, c in more.items()))


def _local(uri: str) -> str | None:
    parts = urlparse(uri)
    if parts.scheme in ("", "file"):
        return parts.path
    return None


def write_file(uri: str, payload) -> None:
    """Writes bytes under a temporary name and renames: a second attempt of a task
    replaces the file by the same bytes and no reader sees a part of it."""
    part = f"{uri}.{uuid.uuid4().hex}.tmp"
    if path := _local(uri):
        os.makedirs(os.path.dirname(path), exist_ok=True)
        part = _local(part)
        with open(part, "wb") as out:
            for piece in payload:
                out.write(piece)
        os.replace(part, path)
        return
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    part = f"{path}.{uuid.uuid4().hex}.tmp"
    store.create_dir(os.path.dirname(path), recursive=True)
    with store.open_output_stream(part) as out:
        for piece in payload:
            out.write(piece)
    store.move(part, path)


class open_mapped:
    """Context with a local path to the file: the file itself where the store is
    mounted, else a copy that goes when the context ends."""

    def __init__(self, uri: str):
        self.uri, self.copy = uri, None

    def __enter__(self) -> str:
        if path := _local(self.uri):
            return path
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(self.uri)
        handle, self.copy = tempfile.mkstemp()
        with os.fdopen(handle, "wb") as out, store.open_input_stream(path) as src:
            while piece := src.read(1 << 22):
                out.write(piece)
        return self.copy

    def __exit__(self, *_):
        if self.copy:
            os.unlink(self.copy)
