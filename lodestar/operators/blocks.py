"""Top-k for many queries: blocks of queries meet blocks of rows as matrices.

Rows are packed into blocks where they lie; so are the queries, which are few or else are
dealt. A pair of blocks is one product; of it only rows that may be among a query's best go
on. Products only choose: what is told is computed again for each chosen pair, in one order
of its components, so equal vectors have equal distances. Blocks' best rows are merged by a
window that keeps k rows a query in each task before the exchange.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, IntegerType, StructField, StructType

from ..sources import formats
from ..sources.folders import written

#: Rows and queries of a block, at most; queries of 64 components that are broadcast.
ROWS, QUERIES, BROADCAST = 2048, 1024, 65_536
#: What products may differ by from sums in order; in single precision, for each component
#: (half of it by the bound of rounding).
MARGIN, SHORT = 1e-9, 2.0**-23
#: Parts that blocks of rows are dealt to where the queries are too many to be broadcast;
#: pairs whose vectors are laid out at once.
PARTS, AT_ONCE = 64, 32_768
#: Scores of whole rankings that a task holds, at 4 bytes each, and its queries at most.
SCORES, RANKED = 24 << 20, 128


def _packed(rows: DataFrame, id_col: str, vector_col: str, size: int, prefix: str, by: str | None = None, more: Sequence[str] = ()) -> DataFrame:
    """Blocks of rows with equally long vectors, and of one value of ``by`` (an int) if
    that is told: ids, the matrix's bytes, its width, that value, and arrays of ``more``.
    Null vectors, and those with a null component, take no part."""
    lists = [StructField(f"{prefix}{c}", ArrayType(rows.schema[c].dataType)) for c in more]
    schema = StructType([StructField(f"{prefix}ids", ArrayType(rows.schema[id_col].dataType)), StructField(f"{prefix}m", BinaryType()), StructField(f"{prefix}w", IntegerType()), StructField(f"{prefix}by", IntegerType()), *lists])

    def listed(column: pa.Array) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array([0, len(column)], pa.int32()), column)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column(1)
            flat, width = v.flatten(), v.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
            whole = width > 0
            if flat.null_count:
                owner = np.repeat(np.arange(len(v)), np.maximum(width, 0))
                whole[owner[np.asarray(flat.is_null())]] = False
            kind = np.zeros(len(v), int) if by is None else batch.column(2).fill_null(-1).to_numpy(zero_copy_only=False)
            for w, b in np.unique(np.stack([width, kind])[:, whole], axis=1).T.tolist():
                at = np.flatnonzero(whole & (width == w) & (kind == b))
                for lo in range(0, len(at), size):
                    some = pa.array(at[lo : lo + size])
                    m = v.take(some).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
                    told = [listed(batch.column(c).take(some)) for c in range(2 + (by is not None), batch.num_columns)]
                    yield pa.RecordBatch.from_arrays([listed(batch.column(0).take(some)), pa.array([m.astype("<f8").tobytes()], pa.binary()), pa.array([w], pa.int32()), pa.array([b], pa.int32()), *told], names=schema.names)

    return rows.select(id_col, vector_col, *([by] if by else []), *more).mapInArrow(pack, schema)


def _met(vectors: DataFrame, queries: DataFrame, id_col: str, vector_col: str, by: str | None = None, more: Sequence[str] = (), told: Sequence[str] = ()) -> DataFrame:
    """Pairs of a block of rows (rids, rm, rw, rby, ``more``) and one of queries (qids, qm, qw,
    ``told``, a number qn). The queries are broadcast up to a bound; beyond it, blocks of both
    sides meet part by part, as many tasks as there are parts."""
    count, width = queries.agg(F.count("*"), F.coalesce(F.max(F.size("query")), F.lit(0))).first()
    asked = _packed(queries.repartition(max(1, -(-count // 8192))), "query_id", "query", QUERIES, "q", more=told).drop("qby").withColumn("qn", F.monotonically_increasing_id())
    rows = _packed(vectors, id_col, vector_col, ROWS, "r", by, more)
    slices = -(-count * max(width, 64) // (64 * BROADCAST))
    if slices <= 1:
        return rows.join(F.broadcast(asked), F.col("rw") == F.col("qw"))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    rows = rows.withColumn("_part_r", F.pmod(F.xxhash64("rids"), F.lit(PARTS))).withColumn("_slice_r", every(slices))
    asked = asked.withColumn("_slice_q", F.pmod("qn", F.lit(slices))).withColumn("_part_q", every(PARTS))
    return rows.join(asked.hint("shuffle_hash"), (F.col("rw") == F.col("qw")) & (F.col("_part_r") == F.col("_part_q")) & (F.col("_slice_r") == F.col("_slice_q")))


def _unit(m: np.ndarray) -> np.ndarray:
    size = np.sqrt((m * m).sum(1, keepdims=True))
    return np.divide(m, size, out=np.zeros_like(m), where=size > 0)


def cosine_of(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each pair of rows, 0 where one is zero: sums in one order, whatever else is
    computed with them."""
    length = np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1))
    return np.divide((a * b).sum(1), length, out=np.zeros(len(a)), where=length > 0)


def nearest(vectors: DataFrame, queries: DataFrame, k: int, dims: int | None = None, more: Sequence[int] = (), id_col: str = "vec_id", vector_col: str = "embedding", by: str | None = None) -> DataFrame:
    """For each of (query_id, query) the k nearest rows by cosine distance in the first
    ``dims`` components (all by default): query_id, id, dist, rank, and for each number d in
    ``more`` the distance in the first d components as ``dist_d``. Ties go to the smaller
    id. Vectors of another length than a query's don't meet it; zero vectors have distance
    1; an empty side gives no rows. ``by`` names an int column of the rows; a query then
    meets only rows whose value its array of ints ``near`` holds."""
    met = _met(vectors, queries, id_col, vector_col, by, told=["near"] if by else [])

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # what each query's k-th best row was, of the rows that this task has seen
        floors: dict[int, np.ndarray] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                w = batch.column(2)[i].as_py()
                x, q = (np.frombuffer(batch.column(c)[i].as_buffer(), "<f8").reshape(-1, w) for c in (1, 4))
                floor = floors.setdefault(batch.column(5)[i].as_py(), np.full(len(q), -np.inf))
                asks = np.arange(len(q))
                if by:
                    lists = batch.column(7)[i].values
                    owner = np.repeat(asks, lists.value_lengths().to_numpy(zero_copy_only=False))
                    asks = np.unique(owner[lists.flatten().to_numpy(zero_copy_only=False) == batch.column(6)[i].as_py()])
                d = min(dims or w, w)
                a, b = _unit(q[asks, :d]), _unit(x[:, :d])
                # single precision will do unless many rows are about as near
                for kind, slack in ((np.float32, (d + 8) * SHORT), (np.float64, MARGIN)):
                    near = a.astype(kind) @ b.astype(kind).T
                    maybe = near >= (floor[asks] - slack).astype(kind)[:, None]
                    many = np.flatnonzero(maybe.sum(1) > k)
                    if len(many):
                        some = near[many]
                        least = np.partition(some, some.shape[1] - k, axis=1)[:, some.shape[1] - k]
                        floor[asks[many]] = np.maximum(floor[asks[many]], least - slack)
                        maybe[many] = some >= (floor[asks[many]] - slack).astype(kind)[:, None]
                    if np.count_nonzero(maybe) <= 2 * k * len(asks):
                        break
                own, other = np.divmod(np.flatnonzero(maybe), len(x))
                own = asks[own]
                qids, rids = batch.column(3)[i].values, batch.column(0)[i].values
                for lo in range(0, len(own), AT_ONCE):
                    a, b = other[lo : lo + AT_ONCE], own[lo : lo + AT_ONCE]
                    told = [1.0 - cosine_of(x[a, :n], q[b, :n]) for n in (d, *(min(n, w) for n in more))]
                    yield pa.RecordBatch.from_arrays([qids.take(pa.array(b)), rids.take(pa.array(a)), *map(pa.array, told)], names=names)

    names = ["query_id", id_col, "dist", *(f"dist_{n}" for n in more)]
    out = StructType([queries.schema["query_id"], vectors.schema[id_col], *(StructField(n, DoubleType()) for n in names[2:])])
    found = met.select("rids", "rm", "rw", "qids", "qm", "qn", *(["rby", "qnear"] if by else [])).mapInArrow(best, out)
    order = Window.partitionBy("query_id").orderBy("dist", id_col)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def pairs(vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, id and dist of every pair: for what needs all of them. Ranks of items that
    may be anywhere don't: see ``ranks``."""
    met = _met(vectors, queries, id_col, vector_col)

    def every(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                w = batch.column(2)[i].as_py()
                x, q = (np.frombuffer(batch.column(c)[i].as_buffer(), "<f8").reshape(-1, w) for c in (1, 4))
                size = np.sqrt((x * x).sum(1))
                qids, rids = batch.column(3)[i].values, batch.column(0)[i].values
                for at, one in enumerate(q):
                    length = size * np.sqrt((one * one).sum())
                    near = np.divide((x * one).sum(1), length, out=np.zeros(len(x)), where=length > 0)
                    yield pa.RecordBatch.from_arrays([qids.take(pa.array(np.full(len(x), at))), rids, pa.array(1.0 - near)], names=["query_id", id_col, "dist"])

    out = StructType([queries.schema["query_id"], vectors.schema[id_col], StructField("dist", DoubleType())])
    return met.select("rids", "rm", "rw", "qids", "qm").mapInArrow(every, out)


def two_stage(vectors: DataFrame, queries: DataFrame, k: int, stages: Sequence[tuple[int, int]], candidates: Sequence[int], **columns) -> DataFrame:
    """For each query, (first, second) of ``stages`` and number of ``candidates``: the k
    rows nearest in the first ``second`` components among the candidates nearest in the
    first ``first`` ones: query_id, first, second, candidates, id, dist, rank, n_candidates.
    Each first stage is one product; what the second one needs is computed with it, so no
    vectors are fetched again and nothing is sorted but a query's candidates."""
    id_col = columns.get("id_col", "vec_id")
    made = None
    for first in dict.fromkeys(a for a, _ in stages):
        seconds = [b for a, b in stages if a == first]
        found = nearest(vectors, queries, max(candidates), first, seconds, **columns)
        grid = F.array(*(F.struct(F.lit(b).alias("second"), F.lit(c).alias("candidates"), F.col(f"dist_{b}").alias("dist")) for b in seconds for c in candidates))
        each = found.select("query_id", id_col, F.col("rank").alias("_at"), F.explode(grid).alias("e")).select("query_id", F.lit(first).alias("first"), "e.second", "e.candidates", id_col, "e.dist", "_at").where("_at <= candidates")
        own = Window.partitionBy("query_id", "second", "candidates")
        # a query has as many rows here as it has candidates
        ranked = each.withColumns({"rank": F.row_number().over(own.orderBy("dist", id_col)), "n_candidates": F.count("*").over(own)}).where(F.col("rank") <= k).drop("_at")
        made = ranked if made is None else made.unionByName(ranked)
    return made


def relevant_ranks(vectors: DataFrame, queries: DataFrame, group: str, digits: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, relevant: for each of (query_id, query, own) the rank of the nearest
    row whose ``group`` is the query's ``own``, among all rows but that of the query's id;
    ties go to the smaller id. Without such a row the rank is one beyond all rows, and
    ``relevant`` is false. ``digits`` rounds cosines before they are compared. Ids are whole
    numbers. Of the pairs only each block's best and its count of rows ahead leave a task."""
    slack = MARGIN + (0.0 if digits is None else 10.0**-digits)

    def score(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        dist = 1.0 - cosine_of(a, b)
        return -dist if digits is None else np.round(1.0 - dist, digits)

    def laid(batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, ...]:
        w = batch.column(1)[i].as_py()
        x, q = (np.frombuffer(batch.column(c)[i].as_buffer(), "<f8").reshape(-1, w) for c in (0, 2))
        rids, qids = (batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in (3, 4))
        return x, q, rids, qids, _unit(q) @ _unit(x).T, qids[:, None] != rids

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        floors: dict[int, np.ndarray] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                x, q, rids, qids, near, other = laid(batch, i)
                floor = floors.setdefault(batch.column(5)[i].as_py(), np.full(len(q), -np.inf))
                kinds, own = (batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in (6, 7))
                near[~(other & (own[:, None] == kinds))] = -np.inf
                np.maximum(floor, near.max(1), out=floor)
                a, b = np.nonzero((near > -np.inf) & (near >= floor[:, None] - slack))
                for lo in range(0, len(a), AT_ONCE):
                    at, to = a[lo : lo + AT_ONCE], b[lo : lo + AT_ONCE]
                    yield pa.RecordBatch.from_arrays([pa.array(qids[at]), pa.array(score(x[to], q[at])), pa.array(rids[to])], names=["query_id", "s", "i"])

    def ahead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                x, q, rids, qids, near, other = laid(batch, i)
                s, first = (batch.column(c)[i].values.to_numpy(zero_copy_only=False).astype(t) for c, t in ((6, float), (7, np.int64)))
                least = (s + 1.0 if digits is None else s)[:, None]
                n = ((near > least + slack) & other).sum(1)
                # what is about as near is compared exactly
                a, b = np.nonzero((np.abs(near - least) <= slack) & other)
                for lo in range(0, len(a), AT_ONCE):
                    at, to = a[lo : lo + AT_ONCE], b[lo : lo + AT_ONCE]
                    own = score(x[to], q[at])
                    np.add.at(n, at, (own > s[at]) | ((own == s[at]) & (rids[to] < first[at])))
                yield pa.RecordBatch.from_arrays([pa.array(qids), pa.array(n), pa.array(other.sum(1))], names=["query_id", "n", "m"])

    shared = ["rm", "rw", "qm", "rids", "qids", "qn"]
    met = _met(vectors, queries, id_col, vector_col, more=[group], told=["own"])
    tops = met.select(*shared, f"r{group}", "qown").mapInArrow(best, "query_id long, s double, i long").groupBy("query_id").agg(F.max(F.struct("s", (-F.col("i")).alias("i"))).alias("b"))
    known = queries.select("query_id", "query").join(tops, "query_id", "left").select("query_id", "query", F.coalesce("b.s", F.lit(float("inf"))).alias("s"), F.coalesce(-F.col("b.i"), F.lit(0)).alias("first"), F.col("b").isNotNull().alias("relevant"))
    counts = _met(vectors, known, id_col, vector_col, told=["s", "first"]).select(*shared, "qs", "qfirst").mapInArrow(ahead, "query_id long, n long, m long").groupBy("query_id").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))
    found = counts.where("m > 0").join(known.select("query_id", "relevant"), "query_id")
    return found.select("query_id", (F.when(F.col("relevant"), F.col("n")).otherwise(F.col("m")) + 1).alias("rank"), "relevant")


def _places(near: np.ndarray, x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Cosines rounded to nine digits as whole numbers that grow as scores fall, NaN first:
    0 to 2e9 + 1. What lies next to where rounding turns is computed again in one order."""
    scaled = near * 1e9
    whole = np.rint(scaled)
    a, b = np.nonzero(np.abs(np.abs(scaled - whole) - 0.5) < 1e-5)
    for lo in range(0, len(a), AT_ONCE):
        at, to = a[lo : lo + AT_ONCE], b[lo : lo + AT_ONCE]
        whole[at, to] = np.rint((1.0 - (1.0 - cosine_of(x[to], q[at]))) * 1e9)
    return np.where(np.isnan(whole), 0.0, 1e9 + 1 - whole).astype(np.uint32)


def rankings(vectors: DataFrame, queries: DataFrame, group: str, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """What metrics need of whole rankings: for each of (query_id, query, own) all rows but
    that of the query's id, by cosine rounded to nine digits, ties by id; those whose
    ``group`` is ``own`` are relevant. query_id, n_gt (relevant rows), rank (of the first),
    dcg (of the first ``k`` rows) and ap (sum of hits by rank over all relevant rows).
    Queries without a relevant row are left out. Ids and groups are whole numbers, a
    query's id is unique.

    No pair leaves a task: the rows lie in shared files, which a task reads once for as
    many queries as their scores (4 bytes a row) fit into it, at least one."""
    some = F.col(vector_col).isNotNull() & F.col(id_col).isNotNull() & F.forall(vector_col, lambda c: c.isNotNull())
    rows = written(vectors.where(some).select(F.col(id_col).cast("long").alias("i"), F.col(vector_col).alias("v"), F.col(group).cast("long").alias("g")), "ranked")
    files = rows.inputFiles()
    n, asked = rows.count(), queries.count()
    most = max(1, min(RANKED, SCORES // max(1, n)))
    parts = max(1, -(-asked // most), min(32, -(-asked // 16)))

    def read() -> Iterator[tuple[np.ndarray, pa.ListArray, pa.Array]]:
        for file in files:
            store, inner = formats.located(file)
            with store.open_input_file(inner) as src:
                for batch in pq.ParquetFile(src).iter_batches(8192):
                    yield batch.column(0).to_numpy(), batch.column(1), batch.column(2)

    def told(qids: np.ndarray, q: np.ndarray, own: np.ndarray) -> pa.RecordBatch:
        width, at = q.shape[1], 0
        scores, ids, kinds, known = np.empty((len(q), n), np.uint32), np.empty(n, np.int64), np.empty(n, np.int64), np.empty(n, bool)
        unit = _unit(q)
        for i, v, g in read():
            fits = v.value_lengths().to_numpy() == width
            x = v.filter(pa.array(fits)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, width)
            to = slice(at, at + len(x))
            scores[:, to] = _places(unit @ _unit(x).T, x, q)
            g = g.filter(pa.array(fits))
            ids[to], kinds[to], known[to] = i[fits], g.fill_null(0).to_numpy(), np.asarray(g.is_valid())
            at += len(x)
        scores, ids, kinds, known = scores[:, :at], ids[:at], kinds[:at], known[:at]
        place = np.empty(at, np.uint64)
        place[np.argsort(ids, kind="stable")] = np.arange(at, dtype=np.uint64) << np.uint64(1)
        out = []
        for qid, kind, score in zip(qids.tolist(), own.tolist(), scores, strict=True):
            other = ids != qid
            hit = known & (kinds == kind) & other
            # in order of score, then id; the last bit tells what is relevant
            key = (score.astype(np.uint64) << np.uint64(32)) | place | hit
            key[~other] = np.uint64(0xFFFFFFFFFFFFFFFE)
            key.sort()
            rank = np.flatnonzero(key & np.uint64(1)) + 1
            if len(rank):
                out.append((qid, len(rank), int(rank[0]), float((1 / np.log2(rank[rank <= k] + 1)).sum()), float((np.arange(1, len(rank) + 1) / rank).sum())))
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 5, kinds_out, strict=True)], names=["query_id", "n_gt", "rank", "dcg", "ap"])

    kinds_out = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            qids, v, own = batch.column(0).to_numpy(), batch.column(1), batch.column(2).to_numpy()
            width = v.value_lengths().to_numpy()
            for w in np.unique(width[width > 0]).tolist():
                at = np.flatnonzero(width == w)
                for lo in range(0, len(at), most):
                    on = at[lo : lo + most]
                    yield told(qids[on], v.take(pa.array(on)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, w), own[on])

    # a null group of a query has no relevant rows
    whole = F.col("query").isNotNull() & F.forall("query", lambda c: c.isNotNull()) & F.col("own").isNotNull()
    dealt = queries.where(whole).select(F.col("query_id").cast("long").alias("query_id"), "query", F.col("own").cast("long").alias("own")).repartition(parts)
    return dealt.mapInArrow(rank, "query_id long, n_gt long, rank long, dcg double, ap double")
