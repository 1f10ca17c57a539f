"""Token-ID files: flat unsigned integers beside 64-bit document offsets, memory-mapped.

Per partition, in ascending document order:

* ``part-NNNNN.bin``: all ids, little-endian, two bytes each if the vocabulary fits,
  else four;
* ``part-NNNNN.idx``: a header of five int64 (mark, bytes an id, documents, ids,
  1 if there is a document id column), then documents + 1 offsets into the ids and
  the document ids, all int64.

``manifest.parquet`` has a row per partition with the ids and documents before it:
prefix sums over the partitions' counts, so the place of a document in the whole
corpus is its partition's base plus its offset.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import new_path, open_mapped, small_batches, write_file
from .textbytes import column, passes
from .tokens import END_ID, encoder

_MARK = 0x58444954
#: Stands for a null document id in the index file.
NULL_ID = np.iinfo(np.int64).min


def write(docs: DataFrame, tokenizer: str, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", files: int | None = None, end_id: int = END_ID) -> str:
    """Encodes every whole text and writes the files; returns their folder.

    Null texts are empty (only ``end_id``); null ids come first; rows with equal ids
    are documents of their own, ordered by text hash. Other columns are not read. An
    empty table gives files without ids. Order comes from a range exchange on id,
    text hash and row number, so that a repeated id doesn't fill one file.
    """
    spark = docs.sparkSession
    folder = folder or new_path(spark, "tokens")
    files = files or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, lib = TaskContext.get().partitionId(), encoder(tokenizer)
        kind = np.dtype("<u2" if lib.vocab_size <= 1 << 16 else "<u4")
        sizes, ids = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

        def tokens() -> Iterator[memoryview]:
            for batch in batches:
                buf, offs = column(batch, "text")
                ids.append(batch.column(0).fill_null(NULL_ID).to_numpy(zero_copy_only=False).astype(np.int64))
                for lo, hi in passes(offs):
                    got, bounds = lib.encode(buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], end_id)
                    sizes.append(np.diff(bounds))
                    yield got.astype(kind).data

        write_file(f"{folder}/part-{part:05d}.bin", tokens())
        size, own = np.concatenate(sizes), np.concatenate(ids)
        offsets = np.append(0, np.cumsum(size)).astype("<i8")
        head = np.array([_MARK, kind.itemsize, len(size), offsets[-1], 1], "<i8")
        write_file(f"{folder}/part-{part:05d}.idx", [head.data, offsets.data, own.astype("<i8").data])
        yield pa.RecordBatch.from_pydict({"part": [part], "documents": [len(size)], "ids": [int(offsets[-1])]})

    rows = small_batches(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    keyed = rows.withColumns({"_h": F.xxhash64("text"), "_row": F.monotonically_increasing_id()})
    order = ["id", "_h", "_row"]
    placed = keyed.repartitionByRange(files, *order).sortWithinPartitions(*order).select("id", "text")
    counts = placed.mapInArrow(save, "part long, documents long, ids long")
    counts.write.parquet(f"{folder}/counts.parquet")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # a row per file: small however large the corpus is
    done = spark.read.parquet(f"{folder}/counts.parquet").coalesce(1)
    done.withColumns({f"{c}_before": F.coalesce(F.sum(c).over(before), F.lit(0)) for c in ("documents", "ids")}).write.parquet(f"{folder}/manifest.parquet")
    return folder


def read(spark: SparkSession, folder: str, ids: bool = False) -> DataFrame:
    """A row per document: id, start (ids of all documents before), n_tokens, crc32 of
    its ids as little-endian 32-bit integers and, if asked for, the ids themselves."""
    manifest = spark.read.parquet(f"{folder}/manifest.parquet")
    files = max(1, manifest.count())
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * ids

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with open_mapped(f"{folder}/part-{part:05d}.idx") as idx, open_mapped(f"{folder}/part-{part:05d}.bin") as flat:
                    yield from _documents(idx, flat, base, ids)

    # one file a task: dealt in turn from one partition, a row per file
    return manifest.select("part", "ids_before").coalesce(1).repartition(files).mapInArrow(load, schema)


def _documents(idx: str, flat: str, base: int, ids: bool) -> Iterator[pa.RecordBatch]:
    head = np.fromfile(idx, "<i8", 5)
    if head[0] != _MARK:
        raise ValueError(f"{idx} is no index of token ids")
    n = int(head[2])
    body = np.memmap(idx, "<i8", "r", offset=40)
    offsets, own = body[: n + 1], body[n + 1 : 2 * n + 1]
    data = np.memmap(flat, f"<u{head[1]}", "r") if head[3] else np.zeros(0, f"<u{head[1]}")
    for lo in range(0, n, 4096):
        hi = min(n, lo + 4096)
        at = np.asarray(offsets[lo : hi + 1])
        block = np.asarray(data[at[0] : at[-1]]).astype("<u4")
        at = at - at[0]
        out = {
            "doc_id": pa.array(own[lo:hi], mask=np.asarray(own[lo:hi]) == NULL_ID),
            "start": np.asarray(offsets[lo:hi]) + base,
            "n_tokens": np.diff(at),
            "ids_crc32": np.fromiter((zlib.crc32(block[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)), np.int64, hi - lo),
        }
        if ids:
            out["ids"] = pa.LargeListArray.from_arrays(at, block.astype(np.int64)).cast(pa.list_(pa.int64()))
        yield pa.RecordBatch.from_pydict(out)
