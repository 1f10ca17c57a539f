"""Jaccard join on word shingles by chosen paths.

A document is the set of its shingles of five words (all words, if fewer); its
MinHash values are its tokens. Documents with equal words are one class. In each
run, a set is split on sampled token positions: classes that share the value there
meet in a bucket. Members of a large bucket are compared with one of them first, so a
group of near copies becomes one component at once, and buckets of one component need
no more work. Small buckets are compared by brute force on the values; larger ones are
split again, to ``depth`` levels, on values at several positions drawn for the bucket,
so that one frequent shingle does not carry a bucket on; what stays too large is
compared block by block, each pair of blocks a task of its own. A pair at the threshold
survives all levels of one run with a probability that has a lower bound, so the number
of runs follows from the target recall.

Pairs that look similar only join candidate components. One text of each of their
classes is then sent to its component's blocks, once, and every block becomes one row of
shingle sets. All pairs in a block and between the blocks of a component are compared
exactly on their shingles; tasks return counts of links and star edges, never pairs. So
a group of thousands of near copies costs comparisons, not rows.
"""

from __future__ import annotations

import io
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from .components import connected_components
from .shared import BROADCAST_IDS, Scratch, checked, fresh, materialize, numbered, quoted, small_batches
from .textbytes import column, mix, passes, words

SHINGLE = 5
POSITIONS = 64
#: Classes in a bucket that brute force takes; in a block that exact comparison takes.
BUCKET, EXACT = 1024, 256
#: Words of text in such a block.
EXACT_WORDS = 1 << 20
_SEEDS = np.random.default_rng(20240229).integers(1, 1 << 32, (2, POSITIONS), dtype=np.uint64).astype(np.uint32)
_ODD = np.random.default_rng(7).integers(1, 1 << 63, SHINGLE + 1, dtype=np.uint64) | np.uint64(1)


def branching(threshold: float) -> tuple[int, int]:
    """Positions that a split below the first takes together, and branches of a split: as
    many as keep a pair at the threshold in 1.2 of them on the average."""
    joint = 2 if threshold >= 0.75 else 1
    return joint, max(2, math.ceil(1.2 / threshold**joint))


def runs_for(recall: float, threshold: float, depth: int) -> int:
    """Runs that find a pair at the threshold with this probability: where the levels
    below keep it with probability s, a level keeps it with 1 - (1 - p s) ** branches."""
    joint, branches = branching(threshold)
    s = 1.0
    for level in range(depth - 1, -1, -1):
        s = 1 - (1 - threshold ** (joint if level else 1) * s) ** branches
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - s)))


def shingles(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Shingle hashes of all documents with bounds, their numbers of words, and a
    128-bit hash (two columns) of each document's sequence of words."""
    w, at = words(buf, offs)
    n = np.diff(at)
    with np.errstate(over="ignore"):
        padded = np.append(w, np.zeros(SHINGLE - 1, np.uint64))
        full = sum(padded[i : len(w) + i] * _ODD[i] for i in range(SHINGLE)) if len(w) else w
        count = np.where(n >= SHINGLE, n - SHINGLE + 1, np.minimum(n, 1))
        bounds = np.append(0, np.cumsum(count))
        doc = np.repeat(np.arange(len(n)), count)
        place = at[doc] + np.arange(len(doc)) - bounds[doc]
        values = full[place]
        short = np.flatnonzero((n > 0) & (n < SHINGLE))
        for d in short.tolist():
            values[bounds[d]] = sum(w[at[d] + i] * _ODD[i] for i in range(n[d])) + _ODD[SHINGLE] * np.uint64(n[d])
        key = np.zeros((len(n), 2), np.uint64)
        some = np.flatnonzero(n)
        if some.size:
            nth = (np.arange(len(w)) - np.repeat(at[:-1], n)).astype(np.uint64)
            for c, salt in enumerate((np.uint64(0x632BE59BD9B4E019), np.uint64(0xD6E8FEB86659FD93))):
                key[some, c] = mix(np.add.reduceat(mix(w ^ salt) * mix(nth + salt), at[some]) + n[some].astype(np.uint64))
        return mix(values), bounds, n, key


def _signatures(values: np.ndarray, bounds: np.ndarray, some: np.ndarray) -> np.ndarray:
    out = np.zeros((len(some), POSITIONS), np.uint32)
    if len(some):
        low = (values >> np.uint64(32)).astype(np.uint32)
        with np.errstate(over="ignore"):
            for i in range(POSITIONS):
                out[:, i] = np.minimum.reduceat((low ^ _SEEDS[0, i]) * (_SEEDS[1, i] | np.uint32(1)), bounds[some])
    return out


def _fixed(rows: np.ndarray) -> pa.Array:
    """Rows of a 2-d array as one binary value each."""
    width = rows.shape[1] * rows.itemsize
    at = (np.arange(len(rows) + 1) * width).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(rows))])


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the class key ``sid`` (null without words), words and MinHash values."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offs = column(batch, "text")
            for lo, hi in passes(offs):
                values, bounds, n, key = shingles(buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
                some = np.flatnonzero(n)
                sig = _fixed(_signatures(values, bounds, some))
                back = np.full(hi - lo, -1)
                back[some] = np.arange(len(some))
                spot = pa.array(back, mask=back < 0)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), _fixed(key[some]).take(spot), pa.array(n), sig.take(spot)], names=["doc_id", "sid", "words", "sig"])

    rows = small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(make, "doc_id long, sid binary, words long, sig binary")


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Rows of equal keys that stand together, as tables of whole groups."""
    held: list[pa.RecordBatch] = []

    def edges(b: pa.RecordBatch) -> np.ndarray:
        new = np.zeros(b.num_rows, bool)
        for k in keys:
            c = b.column(b.schema.get_field_index(k))
            c = c.cast(pa.large_binary()) if pa.types.is_binary(c.type) else c
            new[1:] |= np.asarray(pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)))
        return np.flatnonzero(new)

    for batch in batches:
        if not batch.num_rows:
            continue
        if held and any(held[-1].column(held[-1].schema.get_field_index(k))[-1] != batch.column(batch.schema.get_field_index(k))[0] for k in keys):
            yield pa.Table.from_batches(held)
            held = []
        cuts = edges(batch)
        if cuts.size:
            last = int(cuts[-1])
            yield pa.Table.from_batches([*held, batch.slice(0, last)])
            held = [batch.slice(last)]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def _cuts(table: pa.Table, keys: list[str]) -> np.ndarray:
    new = np.ones(table.num_rows, bool)
    same = np.ones(table.num_rows - 1, bool)
    for k in keys:
        c = table.column(k).combine_chunks()
        same &= np.asarray(pc.equal(c.slice(1), c.slice(0, len(c) - 1)))
    new[1:] = ~same
    return np.append(np.flatnonzero(new), table.num_rows)


def _roots(linked: np.ndarray) -> np.ndarray:
    """The first member of each row's component in a symmetric boolean matrix."""
    root = np.full(len(linked), -1)
    for i in range(len(linked)):
        if root[i] < 0:
            wave = np.zeros(len(linked), bool)
            wave[i] = True
            reached = wave.copy()
            while wave.any():
                wave = linked[wave].any(0) & ~reached
                reached |= wave
            root[reached] = i
    return root


def _compare(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Star edges between classes of a bucket that agree in ``least`` positions."""
    for table in _groups(batches, ["path"]):
        table = table.combine_chunks()
        cut = _cuts(table, ["path"])
        sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint32).reshape(-1, POSITIONS)
        size = np.diff(cut)
        two = cut[:-1][size == 2]
        two = two[(sig[two] == sig[two + 1]).sum(1) >= least]
        left, right = [two], [two + 1]
        for lo, n in zip(cut[:-1][size > 2].tolist(), size[size > 2].tolist(), strict=True):
            own = sig[lo : lo + n]
            linked = np.zeros((n, n), bool)
            for a in range(0, n, 32):
                linked[a : a + 32] = (own[a : a + 32, None] == own[None]).sum(2, dtype=np.uint8) >= least
            root = _roots(linked)
            other = np.flatnonzero(root != np.arange(n))
            left.append(lo + root[other])
            right.append(lo + other)
        sid = table.column("sid")
        yield from pa.table({"u": sid.take(pa.array(np.concatenate(left))), "v": sid.take(pa.array(np.concatenate(right)))}).combine_chunks().to_batches()


def starts_for(recall: float, threshold: float, depth: int) -> list[int]:
    """The positions at which the runs start, each run at positions of its own."""
    need = runs_for(recall, threshold, depth) * branching(threshold)[1]
    if need > POSITIONS:
        raise ValueError(f"recall {recall} at threshold {threshold} needs more than {POSITIONS} positions")
    return np.random.default_rng(11).permutation(POSITIONS)[:need].tolist()


def _least(threshold: float) -> int:
    """Equal positions from which two classes look similar: four standard deviations of
    their share below the threshold."""
    return max(1, math.floor(POSITIONS * threshold - 4 * math.sqrt(POSITIONS * threshold * (1 - threshold))))


def _token(position: int | Column) -> Column:
    return F.substring("sig", F.lit(position) * 4 + 1, F.lit(4))


def _paths(starts: list[int]) -> Column:
    return F.explode(F.array(*(F.xxhash64(F.lit(i), _token(i)) for i in starts))).alias("path")


def _near_pivot(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        own, pivot = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint32).reshape(-1, POSITIONS) for i in (2, 3))
        alike = pa.array((own == pivot).sum(1) >= least)
        yield pa.RecordBatch.from_arrays([batch.column(i).filter(alike) for i in (0, 1)], names=["u", "v"])


def pivot_edges(classes: DataFrame, threshold: float, starts: list[int]) -> DataFrame:
    """Edges (u, v) from the classes (sid, sig) of each bucket that is too large for
    brute force to its pivot, the class with the least key, where they look similar. A
    group of near copies is then one component before any of its buckets is split."""
    narrow = classes.select("sid", _paths(starts))
    large = narrow.groupBy("path").agg(F.count("*").alias("n"), F.min("sid").alias("pivot")).where(F.col("n") > BUCKET).select("path", "pivot")
    met = narrow.join(large, "path").where("sid != pivot").select("sid", "pivot").distinct()
    both = met.join(classes.select("sid", "sig"), "sid").join(classes.select(F.col("sid").alias("pivot"), F.col("sig").alias("other")), "pivot")
    least = _least(threshold)
    return small_batches(both.select("sid", "pivot", "sig", "other")).mapInArrow(lambda it: _near_pivot(it, least), "u binary, v binary")


def _split(level: DataFrame, threshold: float) -> DataFrame:
    """Rows (sid, sig, comp, path) of the next level: in each branch, the classes of a
    bucket that agree at all positions drawn for the bucket and the branch."""
    joint, branches = branching(threshold)
    spot = lambda i: F.pmod(F.xxhash64("path", F.lit(i)), F.lit(POSITIONS)).cast("int")
    paths = [F.xxhash64("path", F.lit(b), *(_token(spot(b * joint + j)) for j in range(joint))) for b in range(branches)]
    return level.select("sid", "sig", "comp", F.explode(F.array(*paths)).alias("path"))


def candidate_edges(classes: DataFrame, threshold: float, starts: list[int], depth: int, scratch: Scratch) -> DataFrame:
    """Star edges (u, v) of classes (sid, sig, comp) that meet in a bucket and look
    similar. Buckets of one component are left out: all its pairs are compared anyway.
    Large buckets of one component and few others are not split: blocks of the
    component meet all the others."""
    least = _least(threshold)
    level = classes.select("sid", "sig", "comp", _paths(starts))
    found: list[DataFrame] = []
    compare = lambda rows: rows.select("path", "sid", "sig").repartition("path").sortWithinPartitions("path").mapInArrow(lambda it: _compare(it, least), "u binary, v binary")
    for at in range(depth):
        narrow = level.select("path", "sid", "comp")
        shared = narrow.groupBy("path").agg(F.count("*").alias("n"), F.min("comp").alias("_a"), F.max("comp").alias("_b")).where("n > 1 and _a != _b").select("path", "n")
        met = narrow.drop("comp").join(shared, "path")
        rows = scratch.table(met.join(classes.select("sid", "sig", "comp"), "sid") if at == 0 else level.join(shared, "path"), "buckets")
        found.append(compare(rows.where(F.col("n") <= BUCKET)))
        large = rows.where(F.col("n") > BUCKET)
        sizes = large.groupBy("path", "comp").count().groupBy("path").agg(F.max_by("comp", "count").alias("main"), F.max("count").alias("most"), (F.sum("count") - F.max("count")).alias("rest"))
        sizes = scratch.table(sizes, "sizes")
        half = BUCKET // 2
        few = large.join(sizes.where(F.col("rest") <= half), "path").withColumn("k", F.ceil(F.col("most") / half).cast("long"))
        block = F.when(F.col("comp") == F.col("main"), F.array(F.pmod(F.xxhash64("sid", "path"), "k"))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("k") - 1))
        found.append(compare(few.withColumn("b", F.explode(block)).withColumn("path", F.xxhash64("path", "b"))))
        level = large.join(sizes.where(F.col("rest") > half).select("path"), "path")
        if level.isEmpty():
            break
        if at == depth - 1:
            blocks = F.ceil(F.col("n") * 2 / BUCKET).cast("long")
            own = level.withColumns({"k": blocks, "b": F.pmod(F.xxhash64("sid", "path"), blocks)})
            other = own.withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)))
            found.append(compare(other.withColumn("path", F.xxhash64("path", F.least("b", "o"), F.greatest("b", "o")))))
            break
        level = _split(level, threshold)
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def _distinct(values: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    return [np.unique(values[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def _common(sets: list[np.ndarray]) -> np.ndarray:
    """Numbers of common elements for all pairs of sets."""
    n = len(sets)
    if n == 2:
        both = np.intersect1d(*sets, assume_unique=True).size
        return np.array([[len(sets[0]), both], [both, len(sets[1])]])
    flat, row = np.concatenate(sets), np.repeat(np.arange(n), [len(s) for s in sets])
    order = np.argsort(flat)
    flat, row = flat[order], row[order]
    new = np.append(True, flat[1:] != flat[:-1])
    col = np.cumsum(new) - 1
    wide = np.bincount(col)[col] > 1
    row, col = row[wide], np.unique(col[wide], return_inverse=True)[1]
    out = np.zeros((n, n), np.float32)
    width = 4096
    for c in range(0, int(col.max(initial=-1)) + 1, width):
        lo, hi = np.searchsorted(col, [c, c + width])
        has = np.zeros((n, width), np.float32)
        has[row[lo:hi], col[lo:hi] - c] = 1
        out += has @ has.T
    return out


_LINKS = {"sid": pa.binary(), "links": pa.int64(), "root": pa.binary(), "whole": pa.bool_()}
_BLOCK = {"comp": pa.binary(), "k": pa.int64(), "b": pa.int64(), "sets": pa.large_binary()}


def _linked(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which pairs of sets are at least so similar."""
    both = _common(sets)
    size = np.array([len(s) for s in sets])
    # exact in integers: common / union >= threshold
    linked = both >= threshold * (size[:, None] + size[None] - both) - 1e-9
    np.fill_diagonal(linked, False)
    return linked


def _told(sid: list[bytes], copies: np.ndarray, linked: np.ndarray, whole: bool) -> dict[str, list]:
    """For each class its links, copies counted, and the first class of its component."""
    root = _roots(linked | np.eye(len(sid), dtype=bool))
    return {"sid": sid, "links": (linked * copies).sum(1).tolist(), "root": [sid[r] for r in root], "whole": [whole] * len(sid)}


def _packed(sid: list[bytes], copies: np.ndarray, sets: list[np.ndarray]) -> bytes:
    out = io.BytesIO()
    np.savez(out, sid=np.frombuffer(b"".join(sid), np.uint8), copies=copies, size=[len(s) for s in sets], values=np.concatenate(sets))
    return out.getvalue()


def _unpacked(raw: bytes) -> tuple[list[bytes], np.ndarray, list[np.ndarray]]:
    with np.load(io.BytesIO(raw)) as z:
        flat, size = z["sid"].tobytes(), z["size"]
        return [flat[i : i + 16] for i in range(0, len(flat), 16)], z["copies"], np.split(z["values"], np.cumsum(size)[:-1])


def _in_block(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Rows (comp, b, sid, copies, k, text) that stand by block: links inside each block,
    and the block itself as one row where its component has several."""
    schema = pa.schema([*_LINKS.items(), *_BLOCK.items()])
    for table in _groups(batches, ["comp", "b"]):
        cut = _cuts(table, ["comp", "b"])
        for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            rows = table.slice(lo, hi - lo).combine_chunks().to_batches()[0]
            own = {k: rows.column(rows.schema.get_field_index(k)).to_pylist() for k in ("sid", "copies")}
            comp, k, b = (rows.column(rows.schema.get_field_index(c))[0].as_py() for c in ("comp", "k", "b"))
            sets: dict[bytes, np.ndarray] = {}
            copies = []
            buf, offs = column(rows, "text")
            for a, z in passes(offs):
                values, bounds, _, _ = shingles(buf[offs[a] : offs[z]], offs[a : z + 1] - offs[a])
                for at, found in enumerate(_distinct(values, bounds)):
                    # tasks of the stage before may each have sent a text of the class
                    if own["sid"][a + at] not in sets:
                        sets[own["sid"][a + at]] = found
                        copies.append(own["copies"][a + at])
            if len(sets) < 2 and k == 1:
                continue
            sid, found = list(sets), list(sets.values())
            linked = _linked(found, threshold) if len(found) > 1 else np.zeros((1, 1), bool)
            told = _told(sid, np.array(copies), linked, k == 1)
            none = [None] * len(sid)
            yield pa.RecordBatch.from_pydict(told | {c: none for c in _BLOCK}, schema)
            if k > 1:
                yield pa.RecordBatch.from_pydict({c: [None] for c in _LINKS} | {"comp": [comp], "k": [k], "b": [b], "sets": [_packed(sid, np.array(copies), found)]}, schema)


def _across(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Rows (comp, i, j, b, sets) that stand by pair of blocks: links between the two."""
    keys = ["comp", "i", "j"]
    for table in _groups(batches, keys):
        cut = _cuts(table, keys)
        for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            sides = [_unpacked(raw) for raw in table.column("sets").slice(lo, hi - lo).to_pylist()]
            if len(sides) < 2:
                continue
            sid, copies, sets = ([*sides[0][0], *sides[1][0]], np.concatenate([sides[0][1], sides[1][1]]), [*sides[0][2], *sides[1][2]])
            left = np.arange(len(sid)) < len(sides[0][0])
            linked = _linked(sets, threshold) & (left[:, None] != left[None])
            yield pa.RecordBatch.from_pydict(_told(sid, copies, linked, False), pa.schema(list(_LINKS.items())))


def _texts_of(texts: DataFrame, placed: DataFrame) -> DataFrame:
    """(sid, text) of those of (doc_id, text) that the classes ``placed`` may need, a class
    once a task. While these are few, a broadcast of their ids keeps all other texts from
    being hashed."""
    some = texts.where(F.octet_length("text") > 0)
    if placed.count() <= BROADCAST_IDS:
        need = F.broadcast(placed.select(F.col("rep").alias("_rep")))
        some = some.join(need, F.col("doc_id").eqNullSafe(F.col("_rep")), "left_semi")

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            buf, offs = column(batch, "text")
            for lo, hi in passes(offs):
                _, _, n, found = shingles(buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
                new = []
                for at, k in enumerate(found):
                    if n[at] and (own := k.tobytes()) not in seen:
                        seen.add(own)
                        new.append(at)
                yield pa.RecordBatch.from_arrays([_fixed(found[new]), batch.column(1).slice(lo, hi - lo).take(pa.array(new, pa.int64()))], names=["sid", "text"])

    return small_batches(some).mapInArrow(key, "sid binary, text string")


def _keyed(docs: DataFrame, text_col: str, name: str) -> DataFrame:
    """``docs`` with the class key of each row (null without words) as column ``name``."""
    own = list(docs.columns)

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offs = column(batch, "text")
            for lo, hi in passes(offs):
                _, _, n, found = shingles(buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
                sid = _fixed(found).take(pa.array(np.arange(hi - lo), mask=n == 0))
                yield pa.RecordBatch.from_arrays([*batch.slice(lo, hi - lo).columns[: len(own)], sid], names=[*own, name])

    rows = numbered(small_batches(docs), own, text=F.col(text_col).cast("string"))
    return rows.mapInArrow(key, StructType([*docs.schema.fields, StructField(name, BinaryType())]))


def _grouped(docs: DataFrame, threshold: float = 0.8, recall: float = 0.9999, depth: int = 4, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """A row per document (doc_id, sid), and a row per class: sid, class_id, n_links,
    copies, rep (its least id), and whether it is the first class of its group, by least
    id, then by key, null ids last."""
    own = materialize(sketches(docs, id_col, text_col), "sketches")
    with Scratch(docs.sparkSession) as scratch:
        classes = scratch.table(own.where("sid is not null").groupBy("sid").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("words").alias("words"), F.first("sig").alias("sig")), "classes")
        starts = starts_for(recall, threshold, depth)
        edges = scratch.table(pivot_edges(classes, threshold, starts), "found")
        first = connected_components(edges, scratch).select(F.col("node").alias("sid"), F.col("root").alias("comp"))
        known = scratch.table(classes.select("sid", "sig").join(first, "sid", "left").withColumn("comp", F.coalesce("comp", "sid")), "known")
        apart = candidate_edges(known, threshold, starts, depth, scratch)
        comps = connected_components(edges.union(apart), scratch).select(F.col("node").alias("sid"), F.col("root").alias("comp"))
        members = comps.join(classes.select("sid", "rep", "copies", "words"), "sid")
        sizes = members.groupBy("comp").agg(F.count("*").alias("n"), F.sum("words").alias("w"))
        blocks = sizes.select("comp", F.greatest(F.ceil(F.col("n") / EXACT), F.ceil(F.col("w") / EXACT_WORDS)).cast("long").alias("k"))
        placed = scratch.table(members.join(blocks, "comp").withColumn("b", F.pmod(F.xxhash64("sid"), "k")), "placed")
        texts = _texts_of(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), placed)
        sent = texts.join(placed.select("comp", "sid", "copies", "k", "b"), "sid").select("comp", "b", "sid", "copies", "k", "text")
        inside = sent.repartition("comp", "b").sortWithinPartitions("comp", "b").mapInArrow(lambda it: _in_block(it, threshold), "sid binary, links long, root binary, whole boolean, comp binary, k long, b long, sets binary")
        inside = scratch.table(inside, "blocks")
        # a row per block and partner; a component of one block has none
        other = inside.where("comp is not null").withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1))).where("o != b")
        pairs = other.select("comp", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"), "sets")
        keys = ["comp", "i", "j"]
        across = small_batches(pairs).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(lambda it: _across(it, threshold), "sid binary, links long, root binary, whole boolean")
        found = scratch.table(inside.where("comp is null").select(*_LINKS).union(across), "links")
        whole = found.where("whole").select("sid", "root")
        parts = found.where("not whole and sid != root").select(F.col("sid").alias("u"), F.col("root").alias("v"))
        roots = whole if parts.isEmpty() else whole.union(connected_components(parts, scratch))
        links = found.groupBy("sid").agg(F.sum("links").alias("links"))
        rooted = classes.select("sid", "rep", "copies").join(roots, "sid", "left").withColumn("root", F.coalesce("root", "sid"))
        least = F.min(F.struct(F.col("rep").isNull().alias("n"), "rep", "sid")).alias("_first")
        named = rooted.join(rooted.groupBy("root").agg(F.min("rep").alias("class_id"), least), "root").join(links, "sid", "left")
        facts = named.select("sid", "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "copies", "rep", (F.col("sid") == F.col("_first.sid")).alias("first"))
        return own, materialize(facts, "facts")


def join(docs: DataFrame, threshold: float = 0.8, recall: float = 0.9999, depth: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: doc_id, class_id (least id among documents that links of at
    least ``threshold`` connect, directly or not), n_links (other documents at least
    that similar, copies counted) and n_copies (documents with the same words).

    A null, empty or wordless text has no shingles: no links, its own id as class_id.
    Texts of fewer than five words are one shingle. Null ids are kept and count last
    in the choice of class_id. Repeated rows are copies of each other. Other columns
    are not read. An empty table gives no rows.
    """
    own, facts = _grouped(docs, threshold, recall, depth, id_col, text_col)
    met = own.where("sid is not null").select("doc_id", "sid").join(facts, "sid").select("doc_id", "class_id", "n_links", F.col("copies").alias("n_copies"))
    alone = own.where("sid is null").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(1).cast("long").alias("n_copies"))
    return met.union(alone)


def deduplicate(docs: DataFrame, **options) -> DataFrame:
    """The documents of which one row of each group stays, with all columns: of the rows
    with the least id (null ids last), one, and of an id with several texts in the group
    one text. Rows in no group of several stay, whatever their ids.

    Where all rows of an id go, or none does, the id alone decides. Only rows of other ids,
    and without an id, are decided by their words."""
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    own, facts = _grouped(docs, **options)
    facts = facts.where("n_links > 0").select("sid", "rep", "first")
    stays = F.col("first") & F.col("doc_id").eqNullSafe(F.col("rep"))
    met = own.where("sid is not null").select("doc_id", "sid").join(facts, "sid").select("doc_id", (~stays).alias("gone"), stays.alias("stays"))
    # a row that is in no group of several has nothing to say but that it is there
    free = own.join(facts.select("sid"), "sid", "left_anti").select("doc_id", F.lit(None).cast("boolean").alias("gone"), F.lit(None).cast("boolean").alias("stays"))
    ids = met.union(free).groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if("gone").alias("gone"), F.count_if("stays").alias("stays")).where("gone > 0 or stays > 1")
    ids = materialize(ids.select("doc_id", (F.col("doc_id").isNotNull() & (F.col("gone") == F.col("n"))).alias("whole")), "ids")
    own_id, key, sid = (fresh(n, docs.columns) for n in ("_id", "_key", "_sid"))
    some = ids.where("not whole").select(F.col("doc_id").alias(own_id))
    touched = checked(ids.select(F.col("doc_id").alias(own_id)), ids.count())
    same = F.col(own_id).eqNullSafe(F.col(id_col).cast("long"))
    kept = docs.join(touched, same, "left_anti")
    if some.isEmpty():
        return kept
    mixed = docs.join(checked(some, some.count()), same, "left_semi")
    rep, first = (fresh(n, docs.columns) for n in ("_rep", "_first"))
    known = facts.select(F.col("sid").alias(key), F.col("rep").alias(rep), F.col("first").alias(first))
    placed = materialize(_keyed(mixed, text_col, sid).join(known, F.col(sid) == F.col(key), "left"), "mixed")
    alone = placed.where(F.col(key).isNull()).select(*quoted(docs.columns))
    # aggregated in each task before the exchange: copies without an id may be many
    one = placed.where(F.col(first) & F.col(id_col).cast("long").eqNullSafe(F.col(rep))).dropDuplicates([sid]).select(*quoted(docs.columns))
    return kept.unionByName(alone).unionByName(one)
