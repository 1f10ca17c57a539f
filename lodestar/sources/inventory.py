"""Inventories of files of any size: tasks read them piece by piece."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import listing
from .formats import located

#: Bytes that a task holds of a file.
PIECE = 4 << 20
#: Bytes of files that one task reads, about; a larger file is a task of its own.
TASK_BYTES = 256 << 20


def inventory(spark: SparkSession, root: str) -> DataFrame:
    """name below ``root``, bytes and SHA-256 of every file, sorted into tasks by bytes. A
    file's hash is one fold over its pieces, so its size has no bound."""
    listed = listing(spark, root).select("path", "name", "bytes")
    total = listed.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.count("*")).first()
    tasks = max(1, min(total[1], -(-total[0] // TASK_BYTES)))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, name, size in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                store, inner = located(path)
                state = hashlib.sha256()
                with store.open_input_stream(inner) as src:
                    while piece := src.read(PIECE):
                        state.update(piece)
                yield pa.RecordBatch.from_pydict({"name": [name], "bytes": [size], "sha256": [state.hexdigest()]})

    return listed.repartition(tasks, "path").mapInArrow(digest, "name string, bytes long, sha256 string")
