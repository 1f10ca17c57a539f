"""Spelling variants by a rare-first q-gram prefix filter.

Two words that one edit parts lose two bigrams of each at most, so of the three rarest of
each word, in one order of all bigrams by their frequency, at least one is shared, with
positions that differ by the edit alone. What stands left of it is then equal, or what
stands right of it: words meet only on a shared rare bigram with that side of the word and
the length that the other side leaves. A group of more than ``GROUP`` words is split: its
words agree in all but a segment, the edit is in one half of the segment, and the other half
joins the key. Groups are so bounded by the letters that a segment of one can hold. All
pairs of a group are verified as rows of letter matrices; tasks return near pairs only.

A word is its letters in one byte each (all are below U+0100), so bytes sort and count as
code points do.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, materialize, small_batches
from .similarity_join import _cuts, _groups
from .textbytes import column, passes

LEAST_CHARS, LEAST_COUNT, EVERY = 5, 3, 97
#: Rarest bigrams of a word that meet others: one more than an edit takes away.
RAREST = 3
#: Words of a group that are compared without a further split, and pairs at once.
GROUP, PAIRS = 2048, 1 << 19
#: Distinct words that a task counts before it hands them on.
WORDS = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
#: The lead byte of U+00C0 to U+00FF.
_LEAD = 0xC3
_TYPES = "len int, key binary, lo int, hi int, longer boolean, word binary, n long"


def _table() -> np.ndarray:
    """The step table of the reflected CRC-32 polynomial."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, np.uint32(0xEDB88320) ^ (c >> np.uint32(1)), c >> np.uint32(1))
    return c


_STEPS = _table()


def _checksums(prefix: np.ndarray, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 of each segment after bytes whose CRC-32 is ``prefix``."""
    size = end - start
    order = np.argsort(-size, kind="stable")
    at, left = start[order], size[order]
    state = prefix[order] ^ np.uint32(0xFFFFFFFF)
    live = np.searchsorted(-left, -np.arange(int(left[0]) if len(left) else 0), side="left")
    for j, n in enumerate(live.tolist()):
        # those with more than j bytes come first
        state[:n] = _STEPS[(state[:n] ^ buf[at[:n] + j]) & np.uint32(255)] ^ (state[:n] >> np.uint32(8))
    out = np.empty(len(size), np.uint32)
    out[order] = state ^ np.uint32(0xFFFFFFFF)
    return out


def _runs(low: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which bytes of lower-cased texts are in runs of letters, and the runs' bounds."""
    lead = low == _LEAD
    inside = _LETTER[low] | lead
    inside[1:] |= lead[:-1]
    cut = np.zeros(len(low) + 1, bool)
    cut[offs] = True
    start = np.flatnonzero(inside & (np.append(True, ~inside[:-1]) | cut[:-1])[: len(low)])
    end = np.flatnonzero(inside & (np.append(~inside[1:], True) | cut[1:])[: len(low)]) + 1
    return inside, start, end


def _read(low: np.ndarray, offs: np.ndarray, ids: list[str], every: int) -> tuple[np.ndarray, np.ndarray]:
    """Letters and bounds of all words of the texts, after the deletions."""
    inside, start, end = _runs(low, offs)
    doc = np.searchsorted(offs, start, side="right") - 1
    prefix = np.array([zlib.crc32(f"{i}:".encode()) for i in ids], np.uint32)
    h = _checksums(prefix[doc], low, start, end)
    # a letter of two bytes counts at its second one, which tells it
    head = inside & (low != _LEAD)
    letter = np.where(low < 0x80, low, low | 0x40)
    places = np.append(0, np.cumsum(head, dtype=np.int64))
    size = places[end] - places[start]
    hit = np.flatnonzero(h % np.uint32(every) == 0)
    heads = np.flatnonzero(head)
    head[heads[places[start[hit]] + h[hit].astype(np.int64) % size[hit]]] = False
    size[hit] -= 1
    return letter[head], np.append(0, np.cumsum(size))


def _binary(buf: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(buf))])


def words(docs: DataFrame, least_chars: int = LEAST_CHARS, every: int = EVERY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n), the words of ``least_chars`` letters in one byte a letter, counted in
    each task: the same word may come in several rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def told(parts: list[pa.Table]) -> pa.Table:
            return pa.concat_tables(parts).group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"])

        for batch in batches:
            buf, offs = column(batch, "text")
            ids = batch.column(0).to_pylist()
            for lo, hi in passes(offs):
                low = _LOWER[buf[offs[lo] : offs[hi]]]
                letters, bounds = _read(low, offs[lo : hi + 1] - offs[lo], ids[lo:hi], every)
                coded = _binary(letters, bounds).dictionary_encode()
                n = np.bincount(np.asarray(coded.indices), minlength=len(coded.dictionary)) if len(coded) else np.zeros(0, np.int64)
                own = pa.table({"word": coded.dictionary, "n": pa.array(n.astype(np.int64))})
                held.append(own.filter(pc.greater_equal(pc.binary_length(own["word"]), least_chars)))
            if sum(t.num_rows for t in held) >= WORDS:
                held = [told(held)]
                if held[0].num_rows >= WORDS // 2:
                    yield from _plain(held[0])
                    held = []
        if held:
            yield from _plain(told(held))

    rows = small_batches(docs).select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(count, "word binary, n long")


def _plain(table: pa.Table) -> Iterator[pa.RecordBatch]:
    return iter(table.select(["word", "n"]).cast(pa.schema([("word", pa.binary()), ("n", pa.int64())])).combine_chunks().to_batches(max_chunksize=1 << 16))


def _matrices(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length of words, rows of the batch and their letters as a matrix."""
    c = batch.column(0).cast(pa.large_binary())
    at = np.frombuffer(c.buffers()[1], np.int64)[c.offset : c.offset + len(c) + 1]
    raw = np.frombuffer(c.buffers()[2], np.uint8) if len(c) else np.zeros(0, np.uint8)
    size = np.diff(at)
    for n in np.unique(size).tolist():
        rows = np.flatnonzero(size == n)
        yield rows, raw[at[rows][:, None] + np.arange(n)]


def _bigrams(letters: np.ndarray) -> np.ndarray:
    return letters[:, :-1].astype(np.int64) << 8 | letters[:, 1:]


def frequencies(known: DataFrame) -> np.ndarray:
    """The number of places of each bigram in the words; 65,536 numbers at most come to
    the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, np.int64)
        for batch in batches:
            for _, letters in _matrices(batch):
                total += np.bincount(_bigrams(letters).ravel(), minlength=1 << 16)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["gram", "n"])

    out = np.zeros(1 << 16, np.int64)
    for row in known.select("word").mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect():
        out[row.gram] = row.n
    return out


def entries(known: DataFrame, frequency: np.ndarray) -> DataFrame:
    """A word's rows in the groups of its rarest bigrams: the length of the shorter word
    of a pair, the key, the segment that the shorter one's letters may differ in, and
    whether the word is the longer one there."""
    rank = np.empty(1 << 16, np.int32)
    rank[np.lexsort((np.arange(1 << 16), frequency))] = np.arange(1 << 16)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, letters in _matrices(batch):
                size = letters.shape[1]
                # equal bigrams of a word in order of their places
                rarest = np.argsort(rank[_bigrams(letters)], axis=1, kind="stable")[:, :RAREST]
                own = batch.take(pa.array(rows))
                raw = [w.tobytes() for w in letters]
                for spots in rarest.T:
                    p = spots.tolist()
                    left = [b"L" + w[: i + 2] for w, i in zip(raw, p, strict=True)]
                    right = [b"R" + w[i:] for w, i in zip(raw, p, strict=True)]
                    for longer in (False, True):
                        base = size - longer
                        # left of the bigram's end equal; or right of its begin, where a longer word has one letter more before it
                        for key, lo, hi in ((left, spots + 2, np.full(len(spots), base)), (right, np.zeros(len(spots), np.int64), spots - longer)):
                            fits = np.flatnonzero(hi >= lo)
                            at = pa.array(fits)
                            yield pa.RecordBatch.from_arrays(
                                [pa.array(np.full(len(fits), base, np.int32)), pa.array(key, pa.binary()).take(at), pa.array(lo[fits].astype(np.int32)), pa.array(hi[fits].astype(np.int32)), pa.array(np.full(len(fits), longer)), own.column(0).take(at), own.column(1).take(at)],
                                names=["len", "key", "lo", "hi", "longer", "word", "n"],
                            )

    return small_batches(known.select("word", "n")).mapInArrow(place, _TYPES)


def _halved(large: DataFrame) -> DataFrame:
    """Rows of the next split: one half of the segment joins the key, the edit is in the
    other one."""
    half = F.expr("(hi - lo) div 2").cast("int")
    more = F.col("longer").cast("int")
    first = large.withColumns({"key": F.concat("key", F.lit(b"A"), F.expr("substring(word, lo + 1, (hi - lo) div 2)")), "lo": F.col("lo") + half})
    last = large.withColumns({"_c": half, "_more": more}).withColumns({"key": F.concat("key", F.lit(b"B"), F.expr("substring(word, lo + _c + _more + 1, hi - lo - _c)")), "hi": F.col("lo") + F.col("_c")})
    return first.union(last.drop("_c", "_more"))


def _near(home: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Which rows of two letter matrices one edit parts; ``other`` has the same width or
    one more."""
    n = home.shape[1]
    if other.shape[1] == n:
        return (home != other).sum(1) == 1
    front = np.logical_and.accumulate(home == other[:, :n], axis=1).sum(1)
    back = np.logical_and.accumulate((home == other[:, 1:])[:, ::-1], axis=1).sum(1)
    return front + back >= n


def _pairs(cut: np.ndarray, home: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (shorter or equal, other) of places within groups, of which at most ``PAIRS``
    and a row's more at once: each home row with the home rows after it and all others."""
    at = np.flatnonzero(home)
    group = np.searchsorted(cut, at, side="right") - 1
    count = cut[group + 1] - at - 1
    before = np.append(0, np.cumsum(count))
    lo = 0
    while lo < len(at):
        hi = max(lo + 1, int(np.searchsorted(before, before[lo] + PAIRS, side="right")) - 1)
        own = np.repeat(at[lo:hi], count[lo:hi])
        yield own, own + 1 + np.arange(len(own)) - np.repeat(before[lo:hi] - before[lo], count[lo:hi])
        lo = hi


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near pairs, both ways round, of rows that stand by (len, key), homes first."""
    for table in _groups(batches, ["len", "key", "lo"]):
        table = table.combine_chunks()
        cut = _cuts(table, ["len", "key", "lo"])
        word, n = table.column("word").chunk(0).cast(pa.large_binary()), table.column("n").to_numpy()
        at = np.frombuffer(word.buffers()[1], np.int64)[word.offset : word.offset + len(word) + 1]
        raw = np.frombuffer(word.buffers()[2], np.uint8)
        size, home = table.column("len").to_numpy(), ~table.column("longer").to_numpy(zero_copy_only=False)
        for a, b in _pairs(cut, home):
            for width in np.unique(size[a]).tolist():
                for more in (0, 1):
                    some = np.flatnonzero((size[a] == width) & (home[b] == (more == 0)))
                    if not some.size:
                        continue
                    x, y = a[some], b[some]
                    near = np.zeros(len(x), bool)
                    step = max(1, (8 << 20) // (width + 1))
                    for s in range(0, len(x), step):
                        near[s : s + step] = _near(raw[at[x[s : s + step], None] + np.arange(width)], raw[at[y[s : s + step], None] + np.arange(width + more)])
                    u, v = np.concatenate([x[near], y[near]]), np.concatenate([y[near], x[near]])
                    yield pa.RecordBatch.from_arrays([word.take(pa.array(u)).cast(pa.binary()), word.take(pa.array(v)).cast(pa.binary()), pa.array(n[v])], names=["word", "other", "other_n"])


def near_pairs(known: DataFrame, scratch: Scratch, group: int = GROUP) -> DataFrame:
    """(word, other, other_n), every pair of words (word, n) that one edit parts, both ways
    round; a pair that shares several rare bigrams comes as often."""
    level = scratch.table(entries(known, frequencies(known)), "entries")
    keys = ["len", "key", "lo"]
    out = None
    while True:
        # groups whose segment has one letter are bounded by the alphabet
        large = scratch.table(level.groupBy(*keys, "hi").count().where(F.col("count") > group).where("hi - lo > 1").select(*keys), "large")
        split = not large.isEmpty()
        rows = level.join(large, keys, "left_anti") if split else level
        # a number first: it orders nearly all rows, and equal keys still stand together
        placed = rows.repartition(*keys).sortWithinPartitions(F.xxhash64(*keys), *keys, "longer")
        found = small_batches(placed.select(*keys, "longer", "word", "n")).mapInArrow(_verified, "word binary, other binary, other_n long")
        out = found if out is None else out.union(found)
        if not split:
            return out
        level = scratch.table(_halved(level.join(large, keys, "left_semi")), "entries")


def _rooted(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, root) for rows (word, form): the last word that forms lead to. Each round
    doubles the steps; a form has twice the count at least, so rounds are few."""
    now = scratch.table(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        then = scratch.table(now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if then.where("moved").isEmpty():
            return then.select("word", "root")
        now = then.select("word", "root")


def group(docs: DataFrame, least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT, every: int = EVERY, limit: int = GROUP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per word: word, form, root, n, n_near, form_n.

    Words are maximal runs ``[A-Za-z\\u00C0-\\u00FF]+`` with A-Z lower-cased; where the
    CRC-32 of ``<id>:<run>`` is divided by ``every``, the code point at its remainder by
    the length is deleted. Words of ``least_chars`` code points that occur ``least_count``
    times are compared: near ones differ by one inserted, deleted or replaced code point.
    The form is the near word of largest n (ties: the smallest), if it has twice the count.

    Null texts have no words; a null id counts as an empty one; repeated rows count again.
    Words of any length take part. Other columns are not read. An empty table gives no rows.
    """
    if least_chars < RAREST + 1:
        raise ValueError(f"words need {RAREST + 1} letters: three bigrams of each must be left to meet")
    with Scratch(docs.sparkSession) as scratch:
        counted = words(docs, least_chars, every, id_col, text_col).groupBy("word").agg(F.sum("n").alias("n"))
        known = scratch.table(counted.where(F.col("n") >= least_count), "words")
        pairs = near_pairs(known, scratch, limit).groupBy("word", "other").agg(F.first("other_n").alias("other_n"))
        best = pairs.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("m"), "other")).alias("best"))
        met = known.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), (-F.col("best.m")).alias("most"), F.col("best.other").alias("other"))
        formed = F.col("most") >= F.col("n") * 2
        told = scratch.table(met.select("word", F.when(formed, F.col("other")).alias("form"), "n", "n_near", F.when(formed, F.col("most")).alias("form_n")), "told")
        roots = _rooted(told.where("form is not null").select("word", "form"), scratch)
        text = lambda c: F.decode(c, "ISO-8859-1")
        out = told.join(roots, "word", "left").select(text("word").alias("word"), text("form").alias("form"), text(F.coalesce("root", "word")).alias("root"), "n", "n_near", "form_n")
        return materialize(out, "spelling")
