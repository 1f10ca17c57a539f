"""Packing of token sequences by Karmarkar-Karp multiway differencing.

A document's ids are cut into whole windows, and its rest into pieces. Pieces meet
in batches of bounded size; in a batch, each piece starts as a partition of its own
over k windows, and the two partitions with the largest imbalance are merged again
and again, the fullest window of one with the emptiest of the other. The result is
k windows of nearly equal load. k starts at the least number that could hold the
batch and rises while a window exceeds its capacity.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import small_batches
from .textbytes import column, passes
from .tokens import END_ID, encoder

#: Pieces that one differencing takes; bounds its memory (pieces x windows).
BATCH = 2048


def difference(sizes: np.ndarray, k: int) -> np.ndarray:
    """The window, 0 to k - 1, of each size by multiway differencing."""
    n = len(sizes)
    if k == 1 or n == 0:
        return np.zeros(n, np.int64)
    loads: list[np.ndarray | None] = []
    for s in sizes.tolist():
        load = np.zeros(k, np.int32)
        load[0] = s
        loads.append(load)  # descending
    heap = [(-int(s), i) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    merged: list[tuple[int, int, np.ndarray]] = []
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        both = loads[a] + loads[b][::-1]
        order = np.argsort(-both, kind="stable")
        both = both[order]
        both -= both[-1]
        loads[a] = loads[b] = None
        loads.append(both)
        merged.append((a, b, order))
        heapq.heappush(heap, (-int(both[0]), len(loads) - 1))
    place: list[np.ndarray | None] = [None] * len(loads)
    place[-1] = np.arange(k)
    for node in range(len(loads) - 1, n - 1, -1):
        a, b, order = merged[node - n]
        own, place[node] = place[node], None
        left = np.empty(k, np.int64)
        left[order] = own
        place[a], place[b] = left, left[::-1]
    return np.fromiter((place[i][0] for i in range(n)), np.int64, n)


def fill(sizes: np.ndarray, window: int) -> np.ndarray:
    """Windows of at most ``window`` ids for sizes that don't exceed it each."""
    k = max(1, -(-int(sizes.sum()) // window))
    while True:
        to = difference(sizes, k)
        if np.bincount(to, sizes, k).max(initial=0) <= window:
            return to
        k += max(1, k // 200)


def pieces(docs: DataFrame, tokenizer: str, window: int = 1024, rest: int = 256, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> DataFrame:
    """Every whole text as ids, ``end_id`` after each, cut into whole windows and a
    rest in pieces of at most ``rest`` ids (small pieces leave little padding)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lib, row = encoder(tokenizer), 0
        for batch in batches:
            buf, offs = column(batch, "text")
            for lo, hi in passes(offs):
                ids, bounds = lib.encode(buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], end_id)
                size = np.diff(bounds)
                whole, small = size // window, -(-(size % window) // rest)
                doc = np.repeat(np.arange(hi - lo), whole + small)
                nth = np.arange(len(doc)) - np.repeat(np.cumsum(whole + small) - whole - small, whole + small)
                full = nth < whole[doc]
                start = np.where(full, nth * window, whole[doc] * window + (nth - whole[doc]) * rest)
                length = np.where(full, window, np.minimum(rest, size[doc] - start))
                raw = ids.astype("<u4")
                at = bounds[doc] + start
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo).take(pa.array(doc)),
                        pa.array(start),
                        pa.array(length),
                        pa.array(np.fromiter((zlib.crc32(raw[a:b]) for a, b in zip(at, at + length, strict=True)), np.int64, len(doc))),
                        pa.array(size[doc]),
                        pa.array(row + doc),
                    ],
                    names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "row"],
                )
                row += hi - lo

    rows = small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, row long")


def pack(docs: DataFrame, tokenizer: str, window: int = 1024, rest: int = 256, partitions: int | None = None, **columns) -> DataFrame:
    """A row per piece with its sequence and its offset there.

    Null or empty texts are the end id alone; null ids are kept; rows with equal ids
    are documents of their own; an empty table gives no rows; other columns are not
    read. Pieces are dealt by hash, so a task gets an even share of any corpus, and
    ordered within it, so a repeated task gives the same sequences.
    """
    made = pieces(docs, tokenizer, window, rest, **columns)
    partitions = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["doc_id", "start", "row", "ids_crc32", "doc_tokens"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, held, count = TaskContext.get().partitionId() << 32, [], 0

        def close(table: pa.Table) -> pa.RecordBatch:
            nonlocal first
            size = table.column("length").to_numpy()
            small = np.flatnonzero(size < window)
            to = np.empty(len(size), np.int64)
            to[small] = fill(size[small], window)
            used = int(to[small].max(initial=-1)) + 1
            to[size == window] = used + np.arange(len(size) - len(small))
            by = np.argsort(to, kind="stable")
            before = np.cumsum(size[by]) - size[by]
            new = np.append(True, to[by][1:] != to[by][:-1])
            offset = before - before[new][np.cumsum(new) - 1]
            out = table.drop_columns(["row"]).take(pa.array(by)).append_column("sequence_id", pa.array(first + to[by])).append_column("offset", pa.array(offset))
            first += used + len(size) - len(small)
            return out.combine_chunks().to_batches()[0]

        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, BATCH - count)
                held.append(part)
                count += part.num_rows
                batch = batch.slice(part.num_rows)
                if count == BATCH:
                    yield close(pa.Table.from_batches(held))
                    held, count = [], 0
        if count:
            yield close(pa.Table.from_batches(held))

    dealt = made.repartition(partitions, "doc_id", "start", "row").sortWithinPartitions(*order)
    return dealt.mapInArrow(place, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
