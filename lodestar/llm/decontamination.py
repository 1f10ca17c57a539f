"""Benchmark decontamination with suffix arrays over the training words.

Every batch of whole documents is a shard: its words, as hashes, are sorted by the
suffixes that begin at them, to the documents' ends. Every suffix of a benchmark item is
looked up by binary search; its neighbours in the order hold its longest verbatim match.
Where that is as long as a window, all places of the window are one interval around it,
and their words are hit. The benchmark is split into block files in the shared folder;
each shard searches all blocks, one in memory at a time, so neither side has to fit
anywhere. A document lies in one shard whole: its counts need no exchange. A longer
document is a shard of its own; its task needs some 60 bytes a word.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z. A window is
``window`` consecutive words of an item, or all words of a shorter item.

Null or empty texts have no words: a document without words is clean, an item
without words has no window. Items with a null id take no part; equal ids are one
item. Equal texts and repeated rows are judged alike, each on its own. Input columns
named like a result, in any case, are replaced. Empty tables give no rows (documents) or
only clean documents (benchmark).
"""

from __future__ import annotations

import hashlib
import io
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, LongType, StringType, StructField, StructType

from .shared import new_path, numbered, open_mapped, quoted, small_batches, write_file
from .textbytes import column, passes, words

#: Bytes of text in a shard and in a benchmark block.
SHARD_BYTES, BLOCK_BYTES = 4 << 20, 8 << 20
#: Words of an item's suffix that are looked up at once; longer ones are told apart
#: by comparison with the suffixes that begin so. Suffixes looked up in one pass.
DEPTH, PASS_SUFFIXES = 16, 1 << 16
#: Benchmark words whose best matches a task holds (25 bytes each).
HELD_WORDS = 4 << 20
_RESULT = {"n_words": LongType(), "n_hit": LongType(), "n_items": LongType(), "items": ArrayType(StringType()), "items_sha256": StringType(), "contaminated": BooleanType()}


def write_blocks(benchmark: DataFrame, item_col: str, text_col: str) -> list[str]:
    """The items' words as block files; an empty table needs none."""
    folder = new_path(benchmark.sparkSession, "benchmark")
    rows = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text")).where("item is not null")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = 1 + size // BLOCK_BYTES

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, items, hashes, counts = TaskContext.get().partitionId(), [], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for batch in batches:
            buf, offs = column(batch, "text")
            got, bounds = words(buf, offs)
            hashes.append(got)
            counts.append(np.diff(bounds))
            items += batch.column(0).to_pylist()
        out = io.BytesIO()
        np.savez(out, words=np.concatenate(hashes), counts=np.concatenate(counts), items=np.frombuffer(json.dumps(items).encode(), np.uint8))
        write_file(f"{folder}/{part:05d}.npz", [out.getvalue()])
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int64())})

    # a row per block
    written = rows.repartition(blocks, F.xxhash64("item", "text")).mapInArrow(save, "part long").collect()
    return [f"{folder}/{part:05d}.npz" for part in sorted({r.part for r in written})]


class Block:
    """A block's items: their words, and for each word its item, its place there and how
    many words follow to the item's end, itself included."""

    def __init__(self, uri: str):
        with open_mapped(uri) as path, np.load(path) as z:
            self.words, self.counts, names = z["words"], z["counts"], z["items"]
        self.names: list[str] = json.loads(names.tobytes())
        self.item = np.repeat(np.arange(len(self.counts)), self.counts)
        self.place = np.arange(len(self.words)) - np.repeat(np.cumsum(self.counts) - self.counts, self.counts)
        self.left = np.repeat(self.counts, self.counts) - self.place


@lru_cache(maxsize=2)
def block(uri: str) -> Block:
    return Block(uri)


class Shard:
    """Words of whole documents and their suffix array, in order to the end of each
    suffix's document."""

    def __init__(self, hashes: np.ndarray, bounds: np.ndarray):
        docs = len(bounds) - 1
        n = len(hashes) + docs
        self.begin = bounds + np.arange(docs + 1)  # a zero ends each document
        own = np.ones(n, bool)
        own[self.begin[1:] - 1] = False
        text = np.zeros(n, np.uint64)
        text[own] = np.maximum(hashes, np.uint64(1))
        self.vocabulary, rank = np.unique(text, return_inverse=True)
        # even ranks for known words leave odd ones for words that only the benchmark has
        self.rank = np.append(2 * rank, 0).astype(np.int64)
        # each document's end differs from all others, so no tie goes on beyond it
        key = rank.astype(np.int64) + docs
        key[~own] = np.arange(docs)
        self.suffix = np.argsort(key, kind="stable")
        new = np.append(True, np.diff(key[self.suffix]) != 0)
        place = np.arange(n)
        first = np.maximum.accumulate(np.where(new, place, 0))
        order, step = np.empty(n, np.int64), 1
        order[self.suffix] = first
        while True:
            tied = np.flatnonzero(~(new & np.append(new[1:], True)))
            if not tied.size:
                break
            at = self.suffix[tied]
            key = (first[tied] << 32) | order[at + step]
            by = np.argsort(key)
            at, key = at[by], key[by]
            self.suffix[tied] = at
            new[tied] = np.append(True, np.diff(key) != 0)
            first[tied] = np.maximum.accumulate(np.where(new[tied], tied, 0))
            order[at] = first[tied]
            step *= 2

    def ranked(self, grid: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.vocabulary, grid)
        known = self.vocabulary[np.minimum(at, len(self.vocabulary) - 1)] == grid if len(self.vocabulary) else np.zeros(grid.shape, bool)
        return np.where(known, 2 * at, 2 * at - 1)

    def bound(self, grid: np.ndarray, lengths: np.ndarray, after: bool) -> np.ndarray:
        """Where rows of words would stand among the suffixes: before the first that
        is not smaller, or ``after`` the last that begins with the row."""
        lo, hi = np.zeros(len(grid), np.int64), np.full(len(grid), len(self.suffix))
        cols = np.arange(grid.shape[1])
        real = cols < lengths[:, None]
        while (open_ := np.flatnonzero(lo < hi)).size:
            mid = (lo[open_] + hi[open_]) >> 1
            there = self.rank[np.minimum(self.suffix[mid][:, None] + cols, len(self.rank) - 1)]
            differs = (there != grid[open_]) & real[open_]
            first = differs.argmax(1)
            rows = np.arange(len(open_))
            right = np.where(differs[rows, first], there[rows, first] < grid[open_][rows, first], after)
            lo[open_[right]] = mid[right] + 1
            hi[open_[~right]] = mid[~right]
        return lo

    def windows(self, b: Block, window: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
        """Distinct windows of the block whose suffixes' longest matches reach their ends:
        positions where they stand with the number of the window, each window's items and
        its length."""
        size = np.minimum(window, b.counts)[b.item]
        full = self.ranked(b.words)
        # a match of the whole window needs all its words to be known here
        unknown = np.append(0, np.cumsum(full % 2 != 0))
        own = np.flatnonzero(b.left >= size)
        own = own[unknown[own + size[own]] == unknown[own]]
        best, _ = self.longest(b, own)
        own = own[best >= size[own]]
        cols = np.arange(window if len(own) else 0)
        grid = np.where(cols < size[own][:, None], full[np.minimum(own[:, None] + cols, len(full) - 1)], -1)
        grid, first, which = np.unique(grid, axis=0, return_index=True, return_inverse=True) if len(own) else (grid, own, own)
        pairs = np.unique(np.stack([which.ravel(), b.item[own]], 1), axis=0)
        owners = np.split(pairs[:, 1], np.searchsorted(pairs[:, 0], np.arange(1, len(grid))))
        lengths = size[own[first]]
        lo, hi = self.bound(grid, lengths, False), self.bound(grid, lengths, True)
        count = hi - lo
        at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count - lo, count)
        return self.suffix[at], np.repeat(np.arange(len(grid)), count), owners, lengths

    def common(self, pos: np.ndarray, full: np.ndarray, at: np.ndarray, left: np.ndarray) -> np.ndarray:
        """How many of the ``left`` words of ``full`` from ``at`` stand at ``pos``."""
        n, going, cols = np.zeros(len(pos), np.int64), np.arange(len(pos)), np.arange(2 * DEPTH)
        while going.size:
            k = n[going][:, None] + cols
            there = self.rank[np.minimum(pos[going][:, None] + k, len(self.rank) - 1)]
            same = (k < left[going][:, None]) & (there == full[np.minimum(at[going][:, None] + k, len(full) - 1)])
            run = np.where(same.all(1), len(cols), same.argmin(1))
            n[going] += run
            going = going[run == len(cols)]
        return n

    def longest(self, b: Block, of: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """For each suffix of the block's items, or those that begin at the words ``of``,
        its longest match in words and its place."""
        of = np.arange(len(b.words)) if of is None else of
        full, known = self.ranked(b.words), len(self.suffix)
        best, where = np.zeros(len(of), np.int64), np.zeros(len(of), np.int64)
        for a in range(0, len(of), PASS_SUFFIXES):
            own, to = of[a : a + PASS_SUFFIXES], np.arange(a, min(len(of), a + PASS_SUFFIXES))
            left = b.left[own]
            lengths = np.minimum(left, DEPTH)
            grid = full[np.minimum(own[:, None] + np.arange(DEPTH), len(full) - 1)]
            lo, hi = self.bound(grid, lengths, False), self.bound(grid, lengths, True)
            hi = np.where(left > DEPTH, hi, lo)
            while (open_ := np.flatnonzero(lo < hi)).size:
                mid = (lo[open_] + hi[open_]) >> 1
                pos = self.suffix[mid]
                n = self.common(pos, full, own[open_], left[open_])
                # a suffix that ends first, or goes on with a smaller word, stands before
                less = n < left[open_]
                less[less] = self.rank[pos[less] + n[less]] < full[own[open_[less]] + n[less]]
                lo[open_[less]] = mid[less] + 1
                hi[open_[~less]] = mid[~less]
            for near in (lo - 1, lo):
                ok = np.flatnonzero((near >= 0) & (near < known))
                pos = self.suffix[near[ok]]
                n = self.common(pos, full, own[ok], left[ok])
                better = n > best[to[ok]]
                best[to[ok[better]]], where[to[ok[better]]] = n[better], pos[better]
        return best, where


def _judge(buf: np.ndarray, offs: np.ndarray, uris: list[str], window: int) -> tuple[np.ndarray, np.ndarray, list[list[str]]]:
    hashes, bounds = words(buf, offs)
    n = len(offs) - 1
    items: list[set[str]] = [set() for _ in range(n)]
    if not len(hashes):
        return np.diff(bounds), np.zeros(n, np.int64), [[] for _ in items]
    shard = Shard(hashes, bounds)
    change = np.zeros(len(shard.suffix) + 1, np.int64)
    for uri in uris:
        b = block(uri)
        pos, which, owners, lengths = shard.windows(b, window)
        change += np.bincount(pos, minlength=len(change)) - np.bincount(pos + lengths[which], minlength=len(change))
        doc = np.searchsorted(shard.begin, pos, side="right") - 1
        for d, w in np.unique(np.stack([doc, which], 1), axis=0).tolist():
            items[d].update(b.names[i] for i in owners[w])
    hit = np.append(0, np.cumsum(np.cumsum(change[:-1]) > 0))
    return np.diff(bounds), hit[shard.begin[1:]] - hit[shard.begin[:-1]], [sorted(x) for x in items]


def annotate(docs: DataFrame, benchmark: DataFrame, window: int = 13, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", keep: list[str] | None = None, percent: int = 5, clean_only: bool = False) -> DataFrame:
    """``keep`` (all columns by default) of each document with its number of words,
    words inside any window's occurrence, items with such a window, their ids, the
    ids' SHA-256, and whether at least ``percent`` of the words (and one) are hit.
    ``clean_only`` removes the contaminated documents and the added columns."""
    keep = [c for c in (docs.columns if keep is None else keep) if clean_only or c.lower() not in _RESULT]
    uris = write_blocks(benchmark, item_col, item_text_col)
    rows = numbered(small_batches(docs), keep, text=F.col(text_col).cast("string"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offs = column(batch, "text")
            for lo, hi in passes(offs, SHARD_BYTES):
                n, hit, items = _judge(buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], uris, window)
                bad = (hit > 0) & (100 * hit >= percent * n)
                part = pa.RecordBatch.from_arrays(batch.slice(lo, hi - lo).columns[: len(keep)], names=keep)
                if clean_only:
                    yield part.filter(pa.array(~bad))
                    continue
                ids = [",".join(x) for x in items]
                made = [pa.array(n), pa.array(hit), pa.array([len(x) for x in items], pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in ids]), pa.array(bad)]
                yield pa.RecordBatch.from_arrays([*part.columns, *made], names=[*keep, *_RESULT])

    made = [] if clean_only else [StructField(k, v) for k, v in _RESULT.items()]
    return rows.mapInArrow(judge, StructType([*docs.select(*quoted(keep)).schema.fields, *made]))


def remove(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that are not contaminated, with all their columns."""
    return annotate(docs, benchmark, clean_only=True, **options)


def longest_matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """For every suffix of every item (item, item_word) its longest verbatim match in
    words over all shards, and one place of it (doc_id, doc_word); suffixes whose
    first word occurs nowhere are left out."""
    uris = write_blocks(benchmark, item_col, item_text_col)
    rows = small_batches(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("_text"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # of each block: words, id (and whether there is one) and place of the best matches
        # that this task has seen
        held: dict[str, tuple[np.ndarray, ...]] = {}

        def told(uri: str) -> pa.RecordBatch:
            b, (best, ids, known, place) = block(uri), held.pop(uri)
            on = np.flatnonzero(best)
            return pa.RecordBatch.from_pydict(
                {
                    "item": pa.array([b.names[i] for i in b.item[on]], pa.string()),
                    "item_word": b.place[on],
                    "words": best[on],
                    "doc_id": pa.array(ids[on], mask=~known[on]),
                    "doc_word": place[on],
                }
            )

        for batch in batches:
            buf, offs = column(batch, "_text")
            own = batch.column(0)
            number, there = own.fill_null(0).to_numpy(zero_copy_only=False), np.asarray(own.is_valid())
            for lo, hi in passes(offs, SHARD_BYTES):
                hashes, bounds = words(buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
                if not len(hashes):
                    continue
                shard = Shard(hashes, bounds)
                for uri in uris:
                    b = block(uri)
                    found, where = shard.longest(b)
                    if uri not in held:
                        held[uri] = (np.zeros(len(b.words), np.int64), np.zeros(len(b.words), np.int64), np.zeros(len(b.words), bool), np.zeros(len(b.words), np.int64))
                    best, ids, known, place = held[uri]
                    on = np.flatnonzero(found > best)
                    doc = np.searchsorted(shard.begin, where[on], side="right") - 1
                    best[on], ids[on], known[on], place[on] = found[on], number[lo + doc], there[lo + doc], where[on] - shard.begin[doc]
                    # blocks of a large benchmark are told before they fill the task
                    if sum(len(h[0]) for h in held.values()) > HELD_WORDS:
                        yield told(uri)
        for uri in list(held):
            yield told(uri)

    found = rows.mapInArrow(search, "item string, item_word long, words long, doc_id long, doc_word long")
    best = F.max(F.struct("words", "doc_id", "doc_word")).alias("m")
    return found.groupBy("item", "item_word").agg(best).select("item", "item_word", "m.*")
