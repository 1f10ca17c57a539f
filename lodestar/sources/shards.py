"""Sinks that can be resumed, and exports.

A sharded sink writes each shard as a Parquet file and, of its vectors, a .npy matrix in
the same order. A shard is written under temporary names and renamed once it is whole, the
Parquet file last: a shard is there when that file is. So a run that is killed keeps what
it has finished, and the next one writes the rest.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from .formats import located
from .folders import Store


@dataclass
class _Written(WriterCommitMessage):
    shards: dict[int, int]


class _Writer(DataSourceArrowWriter):
    def __init__(self, options):
        self.folder = options["path"].rstrip("/")
        self.vector = options.get("vector")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        """The rows of some shards, those of a shard together."""
        store, inner = located(self.folder)
        store.create_dir(inner, recursive=True)
        done: dict[int, int] = {}
        now: int | None = None
        out: pq.ParquetWriter | None = None
        part = ""
        for batch in iterator:
            at = batch.schema.get_field_index("shard")
            shards = batch.column(at).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(np.diff(shards)) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if hi == lo:
                    continue
                rows = batch.slice(lo, hi - lo)
                if now != int(shards[lo]):
                    if out is not None:
                        out.close()
                        done[now] = self._finish(store, inner, now, part)
                    now = int(shards[lo])
                    if now in done:
                        raise ValueError(f"the rows of shard {now} don't stand together")
                    part = f"{inner}/.{uuid.uuid4().hex}.parquet.tmp"
                    out = pq.ParquetWriter(part, rows.schema.remove(at), filesystem=store)
                out.write_batch(rows.select([n for n in rows.schema.names if n != "shard"]))
        if out is not None:
            out.close()
            done[now] = self._finish(store, inner, now, part)
        return _Written(done)

    def _finish(self, store, inner: str, shard: int, part: str) -> int:
        """The matrix of a shard from its Parquet file, then both under their names."""
        with store.open_input_file(part) as src:
            rows = pq.ParquetFile(src)
            n = rows.metadata.num_rows
            if self.vector:
                matrix = f"{part}.npy"
                with store.open_output_stream(matrix) as out:
                    width = None
                    for batch in rows.iter_batches(4096, columns=[self.vector]):
                        v = batch.column(0)
                        sizes = v.value_lengths()
                        width = sizes[0].as_py() if width is None else width
                        flat = v.flatten()
                        if v.null_count or flat.null_count or set(sizes.unique().to_pylist()) != {width}:
                            raise ValueError(f"shard {shard} has vectors without a value or of other lengths")
                        if out.tell() == 0:
                            np.lib.format.write_array_header_1_0(out, {"descr": "<f4", "fortran_order": False, "shape": (n, width)})
                        out.write(flat.cast(pa.float32()).to_numpy(zero_copy_only=False).astype("<f4").tobytes())
                store.move(matrix, f"{inner}/shard-{shard:05d}.npy")
        store.move(part, f"{inner}/shard-{shard:05d}.parquet")
        return n

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        """All shards are there already; what broken attempts left goes."""
        self._sweep()

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        """Finished shards stay."""
        self._sweep()

    def _sweep(self) -> None:
        from pyarrow import fs

        store, inner = located(self.folder)
        for f in store.get_file_info(fs.FileSelector(inner, allow_not_found=True)):
            if posixpath.basename(f.path).startswith("."):
                store.delete_file(f.path)


class Shards(DataSource):
    @classmethod
    def name(cls) -> str:
        return "shards"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options)


def write_shards(rows: DataFrame, folder: str, key: str, shards: int, vector: str | None = None) -> int:
    """Writes rows by shard of ``key`` and returns how many shards were written; those that
    are there are left out. In a shard, rows stand by key. ``key`` and ``shards`` must stay
    the same between the runs. With ``vector``, each shard has a matrix of it as well, and
    a row without a whole vector is an error."""
    rows.sparkSession.dataSource.register(Shards)
    made = rows.withColumn("shard", F.pmod(F.xxhash64(key), F.lit(shards)).cast("int"))
    done = completed(rows, folder)
    if len(done) >= shards:
        return 0
    # a number per shard: few
    todo = made.where(~F.col("shard").isin(done)) if done else made
    options = {"path": folder} | ({"vector": vector} if vector else {})
    todo.repartition(shards, "shard").sortWithinPartitions("shard", key).write.format("shards").options(**options).mode("append").save()
    return len(set(completed(rows, folder)) - set(done))


def completed(rows: DataFrame, folder: str) -> list[int]:
    """Shards that are there."""
    return sorted(int(n[6:-8]) for n in Store(rows.sparkSession, folder).names("") if n.startswith("shard-") and n.endswith(".parquet"))


def read_shards(rows: DataFrame, folder: str) -> DataFrame:
    """The rows of all finished shards, with their shard."""
    found = rows.sparkSession.read.option("pathGlobFilter", "shard-*.parquet").parquet(folder)
    return found.withColumn("shard", F.regexp_extract("_metadata.file_name", r"shard-(\d+)", 1).cast("int"))


def overlapping(rows: DataFrame, key: str) -> DataFrame:
    """Keys that stand in several shards, with the number of these."""
    return rows.groupBy(key).agg(F.countDistinct("shard").alias("shards")).where("shards > 1")


def export_csv(rows: DataFrame, folder: str) -> None:
    """Result rows, which are few, as one CSV file with a header below ``folder``."""
    rows.coalesce(1).write.mode("overwrite").option("header", "true").csv(folder)
