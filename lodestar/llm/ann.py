"""Approximate nearest neighbours by stable projections and kd-trees.

Vectors are projected to ``dims`` coordinates with Gaussian (2-stable) weights: the
squared projected distance of a pair, over its squared distance, follows a chi-square
law with ``dims`` degrees of freedom. A query takes candidates in the order of their
projected distance and verifies each on the original vectors. It stops when even a
vector as near as the k-th best so far would have shown up before the next projected
distance with probability ``confidence`` (the chi-square test), so each true neighbour
is missed with probability ``1 - confidence`` at most.

The upper levels of the kd-tree are fit on a sample of about ``SAMPLE`` rows and
deal all rows to leaves; a task builds the lower levels for the blocks of its leaves.
Every query searches its own leaf first; the radius that its k-th best allows then
names the other leaves that it has to visit. Neither vectors nor queries are ever
gathered in one place: rows meet by leaf, in blocks.

Rows without id, and vectors that are null, zero, of another length than most, or hold
null or non-finite components take no part, as query or candidate. Equal rows are one
candidate; an id with several vectors is a candidate (and a query) for each. A query's
own id is never its neighbour. Ties go to the smaller id. Fewer candidates than k give
fewer rows; empty tables give none. Other columns are not read.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialize

DIMS, CONFIDENCE = 8, 0.97
#: Rows that fit the upper levels (about), sampled rows to a leaf, and bounds on what the
#: levels deal out: a leaf is larger where the sample has no more leaves.
SAMPLE, LEAF_SAMPLE, LEAF_ROWS, MAX_LEAVES = 200_000, 32, 8192, 1 << 16
#: Index rows of a leaf that are searched at once, rows in a bucket of their tree, and
#: queries that meet a leaf in one task.
BLOCK, BUCKET, QUERIES = 8192, 64, 4096


def chi_square(x: float, dims: int) -> float:
    """The chi-square distribution function for an even number of dimensions."""
    term = total = 1.0
    for i in range(1, dims // 2):
        term *= x / 2 / i
        total += term
    return 1 - math.exp(-x / 2) * total


@functools.lru_cache
def quantile(p: float, dims: int) -> float:
    lo, hi = 0.0, 1e4
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi_square(mid, dims) < p else (lo, mid)
    return hi


@functools.lru_cache(maxsize=4)
def _weights(length: int, dims: int) -> np.ndarray:
    return np.random.default_rng([length, dims, 41]).standard_normal((length, dims))


def _vectors(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Row numbers whose vectors may take part, their lengths, and the column."""
    rows = batch.column(1)
    rows = rows.cast(pa.large_list(rows.type.value_type))
    offs = np.asarray(rows.offsets)
    size = np.diff(offs)
    ok = np.asarray(rows.is_valid()) & np.asarray(batch.column(0).is_valid()) & (size > 0)
    flat = rows.values.cast(pa.float64()).to_numpy(zero_copy_only=False)
    sums = np.append(0, np.cumsum(~np.isfinite(flat)))
    some = np.append(0, np.cumsum(np.nan_to_num(flat, nan=1.0) != 0))
    ok &= (sums[offs[1:]] == sums[offs[:-1]]) & (some[offs[1:]] > some[offs[:-1]])
    return np.flatnonzero(ok), size, rows


def _dense(rows: pa.Array, take: np.ndarray, length: int) -> np.ndarray:
    return rows.take(pa.array(take)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, length)


def _packed(x: np.ndarray) -> pa.Array:
    """Rows of doubles, or of floats where these hold the same values."""
    narrow = x.astype("<f4")
    x = narrow if (narrow == x).all() else x.astype("<f8")
    width = x.shape[1] * x.itemsize
    at = (np.arange(len(x) + 1, dtype=np.int64) * width).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(x))])


def _unpacked(column: pa.Array, length: int) -> np.ndarray:
    out = np.empty((len(column), length))
    for i, raw in enumerate(column.to_pylist()):
        out[i] = np.frombuffer(raw, "<f4" if len(raw) == 4 * length else "<f8")
    return out


class Tree:
    """A kd-tree that is full to ``depth``: splits in the order of a heap, cells last."""

    def __init__(self, points: np.ndarray, depth: int):
        self.depth, dims = depth, points.shape[1]
        self.axis, self.value = np.zeros((1 << depth) - 1, np.int64), np.zeros((1 << depth) - 1)
        self.low, self.high = np.full(((2 << depth) - 1, dims), -np.inf), np.full(((2 << depth) - 1, dims), np.inf)
        groups = {0: points}
        for node in range((1 << depth) - 1):
            own = groups.pop(node)
            axis = int(np.argmax(own.max(0) - own.min(0))) if len(own) else 0
            at = float(np.median(own[:, axis])) if len(own) else 0.0
            self.axis[node], self.value[node] = axis, at
            right = own[:, axis] >= at
            for child, part in ((2 * node + 1, own[~right]), (2 * node + 2, own[right])):
                groups[child] = part
                self.low[child], self.high[child] = self.low[node], self.high[node]
            self.high[2 * node + 1, axis] = self.low[2 * node + 2, axis] = at

    def leaf(self, points: np.ndarray) -> np.ndarray:
        node = np.zeros(len(points), np.int64)
        for _ in range(self.depth):
            right = points[np.arange(len(points)), self.axis[node]] >= self.value[node]
            node = 2 * node + 1 + right
        return node - len(self.axis)

    def within(self, points: np.ndarray, radius2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a point and a leaf whose cell is not farther than the point's radius."""
        low, high = self.low[len(self.axis) :], self.high[len(self.axis) :]
        step, found = max(1, (1 << 21) // low.size), []
        for i in range(0, len(points), step):
            p = points[i : i + step, None]
            gap = (np.maximum(np.maximum(low - p, p - high), 0) ** 2).sum(2)
            a, b = np.nonzero(gap <= radius2[i : i + step, None])
            found.append((a + i, b))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2


def _buckets(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of the points in which buckets stand together, and the buckets' bounds."""
    done, open_ = [], [np.arange(len(points))]
    while open_:
        own = open_.pop()
        if len(own) <= BUCKET:
            done.append(own)
            continue
        p = points[own]
        axis = int(np.argmax(p.max(0) - p.min(0)))
        half = np.argpartition(p[:, axis], len(own) // 2)
        open_ += [own[half[: len(own) // 2]], own[half[len(own) // 2 :]]]
    return np.concatenate(done), np.append(0, np.cumsum([len(x) for x in done]))


class Queries:
    """Queries of a task with their best candidates so far."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, bound: np.ndarray, k: int, dims: int, confidence: float):
        self.ids, self.vectors, self.k = ids, vectors, k
        self.points = vectors @ _weights(vectors.shape[1], dims)
        self.bound, self.limit = bound, quantile(confidence, dims) * (1 + 1e-9)
        self.dist, self.near = np.full((len(ids), k), np.inf), np.full((len(ids), k), np.iinfo(np.int64).max)

    def radius2(self) -> np.ndarray:
        """The squared projected distance at which the stopping test holds."""
        return self.limit * np.minimum(self.bound, self.dist[:, -1]) ** 2

    def visit(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        """Searches a block: projected neighbours bucket by bucket, nearest bucket first."""
        points = vectors @ _weights(vectors.shape[1], self.points.shape[1])
        order, at = _buckets(points)
        ids, vectors, points = ids[order], vectors[order], points[order]
        low, high = (f.reduceat(points, at[:-1]) for f in (np.minimum, np.maximum))
        for a in range(0, len(self.ids), 256):
            mine = np.arange(a, min(len(self.ids), a + 256))
            p = self.points[mine, None]
            box = (np.maximum(np.maximum(low - p, p - high), 0) ** 2).sum(2)
            ranked = np.argsort(box, axis=1, kind="stable")
            for step in range(len(at) - 1):
                radius = self.radius2()[mine]
                here = ranked[np.arange(len(mine)), step]
                live = box[np.arange(len(mine)), here] <= radius
                mine, ranked, box, here, radius = (x[live] for x in (mine, ranked, box, here, radius))
                if not len(mine):
                    break
                self._verify(mine, at[here], at[here + 1], radius, ids, vectors, points)

    def _verify(self, mine, lo, hi, radius, ids, vectors, points) -> None:
        pos = lo[:, None] + np.arange(int((hi - lo).max()))
        real = pos < hi[:, None]
        pos = np.where(real, pos, 0)
        near = real & (((points[pos] - self.points[mine, None]) ** 2).sum(2) <= radius[:, None]) & (ids[pos] != self.ids[mine, None])
        row, col = np.nonzero(near)
        q, c = mine[row], pos[row, col]
        true = np.sqrt(((vectors[c] - self.vectors[q]) ** 2).sum(1))
        good = true <= np.minimum(self.dist[q, -1], self.bound[q])
        q, c, true = q[good], c[good], true[good]
        if not len(q):
            return
        hit, row = np.unique(q, return_inverse=True)
        who = np.concatenate([np.repeat(np.arange(len(hit)), self.k), row])
        dist = np.concatenate([self.dist[hit].ravel(), true])
        cand = np.concatenate([self.near[hit].ravel(), ids[c]])
        by = np.lexsort([cand, dist, who])
        who, dist, cand = who[by], dist[by], cand[by]
        new = np.append(True, (who[1:] != who[:-1]) | (cand[1:] != cand[:-1]) | (dist[1:] != dist[:-1]) | np.isinf(dist[1:]))
        who, dist, cand = who[new], dist[new], cand[new]
        rank = np.arange(len(who)) - np.searchsorted(who, who)
        top = rank < self.k
        self.dist[hit[who[top]], rank[top]], self.near[hit[who[top]], rank[top]] = dist[top], cand[top]


_FOUND = "query_id long, query binary, vec_id long, score double"


def _meet(batches: Iterator[pa.RecordBatch], k: int, length: int, dims: int, confidence: float) -> Iterator[pa.RecordBatch]:
    """Rows (leaf, slice, is_row, id, vec, bound) that stand in this order: the queries
    of a leaf, then its index rows, which pass by in blocks."""
    key, asked, rows, queries = None, [], [], None

    def flush() -> None:
        nonlocal queries, rows
        if queries is None and asked:
            queries = Queries(*(np.concatenate(x) for x in zip(*asked, strict=True)), k, dims, confidence)
        if rows and queries is not None:
            queries.visit(*(np.concatenate(x) for x in zip(*rows, strict=True)))
        rows = []

    def close() -> Iterator[pa.RecordBatch]:
        nonlocal asked, queries
        flush()
        if queries is not None:
            # a query without a neighbour here stays as a row, for the other leaves
            hit = np.isfinite(queries.dist)
            hit[:, 0] = True
            q, r = np.nonzero(hit)
            none = np.isinf(queries.dist[q, r])
            yield pa.RecordBatch.from_arrays([pa.array(queries.ids[q]), _packed(queries.vectors).take(pa.array(q)), pa.array(queries.near[q, r], mask=none), pa.array(queries.dist[q, r], mask=none)], names=["query_id", "query", "vec_id", "score"])
        asked, queries = [], None

    for batch in batches:
        leaf, part, is_row = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3))
        mark = np.stack([leaf, part, is_row], 1)
        cuts = np.append(np.flatnonzero(np.append(True, (mark[1:] != mark[:-1]).any(1))), len(mark)) if len(mark) else [0]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if key != (leaf[lo], part[lo]):
                yield from close()
                key = (leaf[lo], part[lo])
            ids = batch.column(3).to_numpy()[lo:hi]
            if not is_row[lo]:
                asked.append((ids, _unpacked(batch.column(4).slice(lo, hi - lo), length), batch.column(5).to_numpy(zero_copy_only=False)[lo:hi]))
            elif asked or queries is not None:
                for a in range(lo, hi, BLOCK):
                    z = min(hi, a + BLOCK)
                    rows.append((batch.column(3).to_numpy()[a:z], _unpacked(batch.column(4).slice(a, z - a), length)))
                    if sum(len(x[0]) for x in rows) >= BLOCK:
                        flush()
    yield from close()


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, dims: int = DIMS, confidence: float = CONFIDENCE, id_col: str = "vec_id", vector_col: str = "embedding", leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """The ``k`` nearest rows of ``vectors`` found for each row of ``queries`` (both with
    an id and an array of numbers): query_id, rank from 1, vec_id, score (Euclidean
    distance of the original vectors in double precision). ``dims`` must be even."""
    if dims % 2 or dims < 2:
        raise ValueError("dims must be an even number")
    own = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vec"))
    asked = queries.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vec"))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok, size, rows = _vectors(batch)
            for length in np.unique(size[ok]).tolist():
                take = ok[size[ok] == length]
                p = _dense(rows, take, length) @ _weights(length, dims)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(p), length)), pa.array(list(p), pa.list_(pa.float64()))], names=["length", "point"])

    total = own.count()
    share = min(1.0, SAMPLE / max(1, total))
    # equal rows are one, so the sample is bounded by the share up to chance
    chosen = own.where(F.pmod(F.xxhash64("id", "vec", F.lit(3)), F.lit(1 << 30)) < F.lit(share * (1 << 30))).distinct()
    sample = chosen.mapInArrow(project, "length long, point array<double>").toArrow()
    lengths, counts = np.unique(sample["length"].to_numpy(), return_counts=True)
    length = int(lengths[counts.argmax()]) if len(lengths) else 1
    points = sample.filter(pc.equal(sample["length"], length))["point"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
    # leaves of even size, and enough sampled points to place each split
    leaves = min(MAX_LEAVES, max(1, total // leaf_rows), max(1, len(points) // LEAF_SAMPLE))
    tree = Tree(points, max(0, leaves - 1).bit_length())

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok, size, rows = _vectors(batch)
            take = ok[size[ok] == length]
            if not len(take):
                continue
            x, ids = _dense(rows, take, length), batch.column(0).to_numpy(zero_copy_only=False)[take].astype(np.int64)
            # of equal vectors here, no more than k + 1 ids can be anyone's neighbours;
            # repeated rows go first, so that they take no other id's place
            by = np.lexsort([ids, *x.T[::-1]])
            by = by[np.append(True, (ids[by][1:] != ids[by][:-1]) | (x[by][1:] != x[by][:-1]).any(1))]
            new = np.append(True, (x[by][1:] != x[by][:-1]).any(1))
            group = np.cumsum(new) - 1
            kept = np.sort(by[np.arange(len(by)) - np.flatnonzero(new)[group] <= k])
            x, ids = x[kept], ids[kept]
            yield pa.RecordBatch.from_arrays([pa.array(tree.leaf(x @ _weights(length, dims))), pa.array(ids), _packed(x)], names=["leaf", "id", "vec"])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok, size, rows = _vectors(batch)
            take = ok[size[ok] == length]
            if len(take):
                x = _dense(rows, take, length)
                yield pa.RecordBatch.from_arrays([pa.array(tree.leaf(x @ _weights(length, dims))), pa.array(batch.column(0).to_numpy(zero_copy_only=False)[take].astype(np.int64)), _packed(x)], names=["leaf", "id", "vec"])

    def onward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limit = quantile(confidence, dims) * (1 + 1e-9)
        for batch in batches:
            if not batch.num_rows:
                continue
            bound = batch.column(2).to_numpy(zero_copy_only=False)
            p = _unpacked(batch.column(1), length) @ _weights(length, dims)
            q, leaf = tree.within(p, limit * bound**2)
            other = leaf != tree.leaf(p)[q]
            q, leaf = q[other], leaf[other]
            yield pa.RecordBatch.from_arrays([pa.array(leaf), batch.column(0).take(pa.array(q)), batch.column(1).take(pa.array(q)), pa.array(bound[q])], names=["leaf", "id", "vec", "bound"])

    def meet(index: DataFrame, asked: DataFrame) -> DataFrame:
        """Queries (leaf, id, vec, bound) and the rows of their leaves. Where many queries
        ask for one leaf, they are dealt to slices and its rows go to each."""
        slices = asked.groupBy("leaf").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("slices"))
        # a row per leaf: MAX_LEAVES at most
        slices = F.broadcast(slices)
        left = asked.join(slices, "leaf").select("leaf", F.pmod(F.xxhash64("id", "vec"), "slices").cast("int").alias("slice"), F.lit(0).alias("is_row"), "id", "vec", "bound")
        right = index.join(slices, "leaf").select("leaf", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), F.lit(1).alias("is_row"), "id", "vec", F.lit(None).cast("double").alias("bound"))
        both = left.union(right).repartition("leaf", "slice").sortWithinPartitions("leaf", "slice", "is_row")
        return both.mapInArrow(lambda it: _meet(it, k, length, dims, confidence), _FOUND)

    rows = "leaf long, id long, vec binary"
    index = materialize(own.mapInArrow(place, rows), "index")
    asked = asked.mapInArrow(ask, rows).distinct()
    first = materialize(meet(index, asked.withColumn("bound", F.lit(float("inf")).cast("double"))), "nearest")
    # the k-th best so far, infinite where there are fewer
    reach = first.groupBy("query_id", "query").agg(F.when(F.count("score") >= k, F.max("score")).otherwise(F.lit(float("inf"))).alias("bound"))
    again = reach.select("query_id", "query", "bound").mapInArrow(onward, rows + ", bound double")
    found = first.union(meet(index, materialize(again, "onward"))) if tree.depth else first
    best = Window.partitionBy("query_id", "query").orderBy("score", "vec_id")
    ranked = found.where("vec_id is not null").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
