"""Phrase collocations by depth-limited count tries.

Texts are read in shards of bounded size. A shard's words are a dictionary in byte order;
a phrase is a node of its trie, numbered by its parent and its last word, so counting the
nodes of a depth is a sort of integers and their order is that of the trie; it is done in
blocks, cut between first words, so a task holds little beside a shard's codes. Shards are
serialised sorted; a range exchange on language and phrase merges their runs, and each
merge task sums neighbours as they come.

The trie grows by one level a pass. A node is only grown where its parent and the phrase
that its suffix link leads to are frequent in the whole corpus: a part of a phrase is never
rarer than the phrase, so nothing is lost. The frequent phrases of a level are told to the
next pass by a bitmap of their hashes, of fixed size; a hash that two phrases share costs a
count, not a result. From the third level on, a pass also writes what may still grow, and
the next one reads that in place of the texts.

Left parts of a phrase are its ancestors, counts that a join with the parents of the level
above hands down; right parts are the suffix link and what it has for right parts.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import Scratch, checked, materialize, small_batches
from .textbytes import PASS_BYTES, column, mix, passes, release, segment_hashes

DEPTH, LEAST, TOP = 5, 100, 2000
#: Bytes of text in a shard; a single piece of more makes a shard of its own.
SHARD_BYTES = 16 << 20
#: Words of a shard; short ones reach this before the bytes.
SHARD_WORDS = 4 << 20
#: Phrases that are hashed, sorted or put together at once.
BLOCK = 1 << 17
#: The bitmap of a level has 2 ** BITS bits (32 MB).
BITS = 28
#: A language's best phrases are first chosen in so many parts.
PARTS = 64
UNKNOWN = "und"

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[ord(c) for c in ".,;:!?"]] = _SEPARATOR[10:14] = True
_OUTSIDE = _SEPARATOR.copy()
_OUTSIDE[[9, 32]] = True
_STEP = np.uint64(0xD1342543DE82EF95)


def _binary(buf: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(buf))])


def _text(values: pa.Array) -> pa.Array:
    """Binary values as strings; their bytes come from strings."""
    values = values.cast(pa.binary())
    return pa.Array.from_buffers(pa.string(), len(values), values.buffers(), offset=values.offset)


def _hashes(values: pa.Array) -> np.ndarray:
    """Hash of each value of a large binary array without nulls."""
    at = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1]
    data = values.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and len(values) else np.zeros(0, np.uint8)
    out = np.empty(len(values), np.uint64)
    for lo, hi in passes(at, BLOCK):
        bounds = at[lo : hi + 1] - at[lo]
        out[lo:hi] = segment_hashes(raw[at[lo] : at[hi]], bounds[:-1], bounds[1:])
    return out


class Words:
    """The words of some texts by a dictionary of their own: of each word its code and
    whether it begins a piece, and of each text its number of words. Small beside the arrays
    that find them, so a shard is put together from these."""

    def __init__(self, langs: pa.Array, buf: np.ndarray, offs: np.ndarray):
        low = _LOWER[buf]
        cut = np.zeros(len(low) + 1, bool)
        cut[offs] = True
        separator, outside = _SEPARATOR[low], _OUTSIDE[low]
        inside = ~outside
        start = np.flatnonzero(inside & (np.append(True, outside[:-1]) | cut[:-1])[: len(low)])
        end = np.flatnonzero(inside & (np.append(outside[1:], True) | cut[1:])[: len(low)]) + 1
        coded = _binary(low[inside], np.append(0, np.cumsum(end - start))).dictionary_encode()
        self.words, self.code = coded.dictionary, np.asarray(coded.indices)
        piece = np.cumsum(separator | cut[:-1], dtype=np.int32)[start]
        self.new = np.append(True, piece[1:] != piece[:-1])[: len(piece)]
        self.langs, self.of_text = langs, np.diff(np.searchsorted(start, offs))
        self.bytes = len(buf)


class Shard:
    """A dictionary of words, ``words`` in byte order, and for each word of the texts its
    rank there, whether it begins a piece, and its language. Empties ``parts``."""

    def __init__(self, parts: list[Words]):
        known = pa.concat_arrays([p.words for p in parts]).dictionary_encode()
        order = np.asarray(pc.array_sort_indices(known.dictionary))
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        self.words = known.dictionary.take(pa.array(order))
        of_code = np.split(rank[np.asarray(known.indices)], np.cumsum([len(p.words) for p in parts])[:-1])
        self.rank = np.concatenate([own[p.code] for own, p in zip(of_code, parts, strict=True)])
        self.new = np.concatenate([p.new for p in parts])
        named = pa.concat_arrays([p.langs for p in parts]).fill_null(UNKNOWN).cast(pa.large_binary()).dictionary_encode()
        self.langs = named.dictionary
        self.lang = np.repeat(np.asarray(named.indices), np.concatenate([p.of_text for p in parts]))
        parts.clear()

    @functools.cached_property
    def hashes(self) -> tuple[np.ndarray, np.ndarray]:
        """Of the words and of the languages."""
        return _hashes(self.words), mix(_hashes(self.langs))

    def chained(self, size: int, lo: int, hi: int) -> np.ndarray:
        """Hash of language and phrase for the phrases of ``size`` words that begin at words
        ``lo`` to ``hi``, whether in one piece or not."""
        word, root = self.hashes
        n, own = hi - lo, word[self.rank[lo : hi + size - 1]]
        with np.errstate(over="ignore"):
            out = mix(own[:n] ^ root[self.lang[lo:hi]])
            for d in range(1, size):
                out = mix(out * _STEP + own[d : d + n])
        return out

    def starts(self, size: int, frequent: np.ndarray | None) -> np.ndarray:
        """Whether a phrase of ``size`` words that may be frequent begins at each word."""
        n = max(0, len(self.rank) - size + 1)
        begins = np.ones(n, bool)
        for d in range(1, size):
            begins &= ~self.new[d : d + n]
        if frequent is not None and n:
            known = np.empty(n + 1, bool)
            for lo in range(0, n + 1, BLOCK):
                at = self.chained(size - 1, lo, min(n + 1, lo + BLOCK)) >> np.uint64(64 - BITS)
                known[lo : lo + BLOCK] = (frequent[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) > 0
            begins &= known[:n] & known[1:]
        return begins

    def counted(self, begins: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """A place of each node among the phrases that begin so, and its count, in the order
        of the trie. They come in blocks, cut between first words."""
        n, wide = len(begins), max(1, len(self.words))
        first = self.lang[:n].astype(np.int64)
        first *= wide
        first += self.rank[:n]
        # a sample tells where blocks are cut, nothing else
        some = np.random.default_rng(0).integers(0, max(1, n), n >> 6)
        cuts = np.unique(np.sort(first[some[begins[some]]])[BLOCK >> 6 :: max(1, BLOCK >> 6)])
        for lo, hi in itertools.pairwise([0, *cuts.tolist(), np.iinfo(np.int64).max]):
            at = np.flatnonzero(begins & (first >= lo) & (first < hi))
            node, top = self.lang[at].astype(np.int64), max(1, len(self.langs))
            for d in range(size):
                if top * wide >= 1 << 62:
                    known, node = np.unique(node, return_inverse=True)
                    top = len(known)
                node, top = node * wide + self.rank[at + d], top * wide
            _, place, count = np.unique(node, return_index=True, return_counts=True)
            yield at[place], count

    def phrases(self, at: np.ndarray, size: int) -> pa.Array:
        parts = [self.words.take(pa.array(self.rank[at + d])) for d in range(size)]
        return parts[0] if size == 1 else pc.binary_join_element_wise(*parts, pa.scalar(b" ", pa.large_binary()))

    def stretches(self, begins: np.ndarray, size: int) -> Iterator[tuple[pa.Array, pa.Array]]:
        """Language and words of the stretches that hold longer phrases, each of which has
        its phrases of ``size`` words among those that begin so."""
        edge = np.flatnonzero(np.diff(begins, prepend=False, append=False))
        first, length = edge[::2], edge[1::2] - edge[::2]
        first, length = first[length > 1], length[length > 1] + size - 1
        bounds = np.append(0, np.cumsum(length))
        for lo, hi in passes(bounds, BLOCK):
            spot = np.repeat(first[lo:hi] - bounds[lo:hi], length[lo:hi]) + np.arange(bounds[lo], bounds[hi])
            words = pa.LargeListArray.from_arrays(pa.array(bounds[lo : hi + 1] - bounds[lo]), self.words.take(pa.array(self.rank[spot])))
            yield self.langs.take(pa.array(self.lang[first[lo:hi]])), pc.binary_join(words, pa.scalar(b" ", pa.large_binary()))


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[Words]:
    """Words of rows (lang, text), a few texts at a time; a text that is longer is cut
    between pieces."""
    most = min(PASS_BYTES, SHARD_BYTES)
    for batch in batches:
        buf, offs = column(batch, "text")
        lang = batch.column(0).cast(pa.large_string())
        for lo, hi in passes(offs, most):
            text, size = buf[offs[lo] : offs[hi]], int(offs[hi] - offs[lo])
            if size <= most:
                yield Words(lang.slice(lo, hi - lo), text, offs[lo : hi + 1] - offs[lo])
                continue
            # pieces stay whole
            ends, at = np.append(np.flatnonzero(_SEPARATOR[text]) + 1, size), 0
            while at < size:
                k = int(np.searchsorted(ends, at + most, side="right"))
                stop = int(ends[k - 1] if k and ends[k - 1] > at else ends[k])
                yield Words(lang.slice(lo, 1), text[at:stop], np.array([0, stop - at]))
                at = stop


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[Shard]:
    """Rows (lang, text) as shards of at most ``SHARD_BYTES`` and ``SHARD_WORDS``; a piece
    of more makes a shard of its own."""
    parts: list[Words] = []
    size = words = 0
    for part in _parts(batches):
        if parts and (size + part.bytes > SHARD_BYTES or words + len(part.code) > SHARD_WORDS):
            yield Shard(parts)
            size = words = 0
            release()
        parts.append(part)
        size, words = size + part.bytes, words + len(part.code)
    if parts:
        yield Shard(parts)


@functools.lru_cache(maxsize=1)
def _bitmap(path: str) -> np.ndarray:
    """The bits of the table at ``path``, read once in each worker."""
    from pyarrow import dataset, fs

    store, inner = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    out = np.zeros(1 << (BITS - 6), np.uint64)
    for batch in dataset.dataset(inner, filesystem=store, format="parquet").to_batches(columns=["at", "bits"], batch_readahead=1, fragment_readahead=1, use_threads=False):
        out[batch.column(0).to_numpy()] = batch.column(1).to_numpy().view(np.uint64)
    return out


def _counts(texts: DataFrame, size: int, frequent: str | None, rest: bool) -> DataFrame:
    """Sorted runs (lang, phrase, n) of the shards' nodes of this depth, and if asked for
    the stretches that may hold longer phrases, with n = 0."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in _shards(batches):
            release()
            begins = shard.starts(size, _bitmap(frequent) if frequent else None)
            release()
            for spot, n in shard.counted(begins, size):
                for lo in range(0, len(spot), BLOCK):
                    part = spot[lo : lo + BLOCK]
                    yield pa.RecordBatch.from_arrays([_text(shard.langs.take(pa.array(shard.lang[part]))), _text(shard.phrases(part, size)), pa.array(n[lo : lo + BLOCK])], names=["lang", "phrase", "n"])
            for lang, words in shard.stretches(begins, size) if rest else ():
                yield pa.RecordBatch.from_arrays([_text(lang), _text(words), pa.array(np.zeros(len(lang), np.int64))], names=["lang", "phrase", "n"])
            del shard, begins
        # workers live on: what the last shard took goes back
        release()

    return small_batches(texts).mapInArrow(count, "lang string, phrase string, n long")


def _merged(runs: DataFrame, least: int) -> DataFrame:
    """(lang, phrase, a) of the phrases that the sorted runs count ``least`` times."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["lang", "phrase", "a"]
        held: pa.RecordBatch | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([*([held] if held is not None else []), batch]).combine_chunks()
            lang, phrase, n = (rows.column(i).chunk(0) for i in range(3))
            new = np.ones(len(n), bool)
            new[1:] = np.asarray(pc.or_(pc.not_equal(phrase.slice(1), phrase.slice(0, len(n) - 1)), pc.not_equal(lang.slice(1), lang.slice(0, len(n) - 1))))
            first = np.flatnonzero(new)
            total = np.add.reduceat(n.to_numpy(), first)
            found = np.flatnonzero(total[:-1] >= least)
            spot = pa.array(first[found])
            yield pa.RecordBatch.from_arrays([lang.take(spot), phrase.take(spot), pa.array(total[:-1][found])], names=names)
            held = pa.RecordBatch.from_arrays([lang.slice(first[-1], 1), phrase.slice(first[-1], 1), pa.array(total[-1:])], schema=batch.schema)
        if held is not None and held.column(2)[0].as_py() >= least:
            yield pa.RecordBatch.from_arrays(held.columns, names=names)
        release()

    order = ["lang", "phrase"]
    placed = runs.where("n > 0").repartitionByRange(*order).sortWithinPartitions(*order)
    return small_batches(placed).mapInArrow(merge, "lang string, phrase string, a long")


def _bits(level: DataFrame, size: int) -> DataFrame:
    """The bitmap (at, bits) of the level's phrases: 64 of its bits a row, none empty."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in _shards(batches):
            # each text is a phrase
            for lo in range(0, len(shard.rank), BLOCK * size):
                at = shard.chained(size, lo, min(len(shard.rank), lo + BLOCK * size) - size + 1)[::size] >> np.uint64(64 - BITS)
                yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))], names=["at", "bits"])

    one = small_batches(level.select("lang", F.col("phrase").alias("text"))).mapInArrow(places, "at long, bits long")
    return one.groupBy("at").agg(F.bit_or("bits").alias("bits"))


def _linked(level: DataFrame, above: DataFrame, size: int) -> DataFrame:
    """``level`` with the counts of its left parts, shortest first, and of its right parts,
    longest first: from its parent, and from where its suffix link leads."""
    parent = above.select("lang", F.col("phrase").alias("_p"), F.array_append("ls", F.col("a")).alias("ls"))
    suffix = above.select("lang", F.col("phrase").alias("_s"), F.array_prepend("rs", F.col("a")).alias("rs"))
    own = level.select("lang", "phrase", "a", F.substring_index("phrase", " ", size - 1).alias("_p"), F.substring_index("phrase", " ", 1 - size).alias("_s"))
    return own.join(parent, ["lang", "_p"]).join(suffix, ["lang", "_s"]).select("lang", "phrase", "a", "ls", "rs", "_p", "_s")


def _score() -> Column:
    """The lowest-scoring cut of a phrase with its parts' counts; exact in decimals."""
    return F.expr(
        "array_min(transform(sequence(1, size(ls)), k -> named_struct('score', "
        "(cast(1000 * a as decimal(19, 0)) * cast(n as decimal(19, 0))) div (cast(ls[k - 1] as decimal(19, 0)) * cast(rs[k - 1] as decimal(19, 0))), "
        "'k', k, 'l', ls[k - 1], 'r', rs[k - 1])))"
    )


def mine(docs: DataFrame, depth: int = DEPTH, least: int = LEAST, top: int | None = TOP, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """Each language's best phrases: lang, rank, phrase, a, l, r, n, score.

    A-Z are lower-cased, texts are split at ``[.,;:!?\\x0A-\\x0D]`` into pieces and these
    into words ``[^\\x20\\x09]+``; phrases of 2 to ``depth`` words that stand at least
    ``least`` times in pieces of a language are scored by 1000 a n / (l r) at their
    lowest-scoring cut, rounded down. Those that stand inside a longer one just as often
    are left out. ``top`` is the number of rows for a language, None for all.

    Null texts are empty, a null language is ``und``. Repeated rows count again. Texts of
    any length are read whole. Other columns are not read. An empty table gives no rows.
    """
    if depth < 2 or least < 1:
        raise ValueError("phrases have two words at least and occur at least once")
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col(text_col).cast("string").alias("text"))
    with Scratch(docs.sparkSession) as scratch:
        source, frequent, langs, read = texts, None, None, None
        levels: list[DataFrame] = []
        for size in range(1, depth + 1):
            counted = _counts(source, size, frequent, 3 <= size < depth)
            path = scratch.path(counted, "runs")
            runs = scratch.spark.read.schema(counted.schema).parquet(path)
            if size == 1:
                langs = scratch.table(runs.groupBy("lang").agg(F.sum("n").alias("n")), "totals")
            level = scratch.table(_merged(runs, least), "level")
            # runs are the largest tables: each goes once it is merged and read
            done = [p for p in (read, path if size < 3 else None) if p]
            if size >= 3:
                source, read = runs.where("n = 0").select("lang", F.col("phrase").alias("text")), path
            for p in done:
                scratch.remove(p)
            if level.isEmpty():
                break
            levels.append(level)
            if size < depth:
                frequent = scratch.path(_bits(level, size), "bits")
        linked: list[DataFrame] = []
        for size, level in enumerate(levels, 1):
            none = F.array().cast("array<long>")
            linked.append(level.withColumns({"ls": none, "rs": none}) if size == 1 else scratch.table(_linked(level, linked[-1], size), "linked"))
        found = linked[0].limit(0).select("lang", "phrase", "a", "ls", "rs") if linked else docs.sparkSession.createDataFrame([], "lang string, phrase string, a long, ls array<long>, rs array<long>")
        for size, level in enumerate(linked[1:], 2):
            own = level.select("lang", "phrase", "a", "ls", "rs")
            if size < len(linked):
                longer = linked[size]
                inside = longer.where(F.col("a") == F.element_at("ls", -1)).select("lang", F.col("_p").alias("phrase")).union(longer.where(F.col("a") == F.element_at("rs", 1)).select("lang", F.col("_s").alias("phrase")))
                own = own.join(inside, ["lang", "phrase"], "left_anti")
            found = found.union(own)
        scored = found.join(checked(langs, langs.count()), "lang").withColumn("_b", _score()).select("lang", "phrase", "a", F.col("_b.l").alias("l"), F.col("_b.r").alias("r"), "n", F.col("_b.score").alias("score"))
        order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
        rank = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(*order))
        if top is not None:
            # a language may hold most phrases: parts of it choose first
            scored = scored.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS))).withColumn("rank", rank("lang", "_part")).where(F.col("rank") <= top)
        ranked = scored.withColumn("rank", rank("lang").cast("long"))
        if top is not None:
            ranked = ranked.where(F.col("rank") <= top)
        return materialize(ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "collocations")
