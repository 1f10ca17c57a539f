"""Relational operators on metadata: pointers, facets, contrasts, hashes, reconciliation."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType


def through_pointer(left: DataFrame, pointer: DataFrame, right: DataFrame, left_key: str, pointer_key: str, pointer_col: str, right_key: str, where: Column | None = None) -> DataFrame:
    """Rows of ``left`` with the row of ``right`` that a pointer table names for them."""
    right = right if where is None else right.where(where)
    named = pointer.select(F.col(pointer_key).alias("_from"), F.col(pointer_col))
    right = right.drop(pointer_key) if pointer_key in right.columns else right
    return left.join(named, F.col(left_key) == F.col("_from")).join(right, F.col(pointer_col) == F.col(right_key)).drop("_from")


def with_fallback(rows: DataFrame, known: DataFrame, match: Column, origin: str = "origin") -> DataFrame:
    """Rows that ``known`` has (ordered) and, beside them, the others (fallback)."""
    own = rows.join(known, match, "left_semi").withColumn(origin, F.lit("ordered"))
    return own.unionByName(rows.join(known, match, "left_anti").withColumn(origin, F.lit("fallback")))


def facet_values(rows: DataFrame, fields: list[str]) -> DataFrame:
    """Each field's distinct non-null values and their counts, from one pass."""
    long = rows.select(F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields))).alias("e"))
    return long.select("e.*").where("value is not null").groupBy("field", "value").agg(F.count("*").alias("n"))


def facet_bounds(rows: DataFrame, fields: list[str]) -> DataFrame:
    """Least and greatest value of numeric fields, from one pass; null without values."""
    one = rows.agg(F.array(*(F.struct(F.lit(f).alias("field"), F.min(f).cast("double").alias("low"), F.max(f).cast("double").alias("high")) for f in fields)).alias("a"))
    return one.select(F.explode("a").alias("e")).select("e.*")


def duplicates(rows: DataFrame, key: list[str]) -> DataFrame:
    """How many keys occur more than once."""
    return rows.groupBy(*key).count().where("count > 1").agg(F.count("*").alias("duplicates"))


def latest(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by ``order``: an upsert's outcome."""
    last = Window.partitionBy(*key).orderBy(*(F.desc(c) for c in order))
    return rows.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")


def upsert(table: DataFrame, changes: DataFrame, key: list[str]) -> DataFrame:
    """``table`` with the rows of ``changes`` in place of those of equal key."""
    return table.join(changes.select(*key).distinct(), key, "left_anti").unionByName(changes, allowMissingColumns=True)


def enriched(rows: DataFrame, found: DataFrame, key: list[str], fields: list[str]) -> DataFrame:
    """Fields replaced where ``found`` has the key, even by null."""
    new = found.select(*key, *(F.col(f).alias(f"_{f}") for f in fields), F.lit(True).alias("_there"))
    joined = rows.join(new, key, "left")
    return joined.withColumns({f: F.when(F.col("_there"), F.col(f"_{f}")).otherwise(F.col(f)) for f in fields}).drop("_there", *(f"_{f}" for f in fields))


#: Different counts that are broadcast; more meet the segments part by part.
MOST_COUNTS = 1000


def count_contrasts(rows: DataFrame, segment: str, count: str) -> DataFrame:
    """For each positive count, the segments with it (positive) and those with none
    (negative); nothing, if no segment has none. One row a segment and count value."""
    positive = rows.where(F.col(count) > 0)
    zero = rows.where(F.col(count) == 0)
    # distinct counts are few, a row each; there are as many negative lists as counts
    values = positive.select(F.col(count).alias("count_value")).distinct()
    told = F.broadcast(values) if values.count() <= MOST_COUNTS else values
    # every segment without any is negative for every count: that many rows are the answer
    negative = zero.crossJoin(told).select("count_value", F.col(segment).alias("segment"), F.lit("negative").alias("side"))
    some = positive.join(F.broadcast(zero.limit(1).select(F.lit(1).alias("_any"))))
    return some.select(F.col(count).alias("count_value"), F.col(segment).alias("segment"), F.lit("positive").alias("side")).unionByName(negative)


def class_contrasts(rows: DataFrame, segment: str, primary: str, secondary: str) -> DataFrame:
    """Segments with both classes (positive) and with the secondary one alone (negative)."""
    side = F.when(F.col(primary) > 0, "positive").when(F.col(primary) == 0, "negative")
    return rows.where(F.col(secondary) > 0).select(F.col(segment).alias("segment"), side.alias("side")).where("side is not null")


def content_hash(rows: DataFrame, by: list[str], order: str, text: Column) -> DataFrame:
    """n and the SHA-256 of the texts in order, per chunk; equal places stand by text, null
    texts add nothing. Chunks are sorted side by side and each is folded as its rows come,
    so a chunk of any length takes the memory of a batch."""
    keys = [f"k{i}" for i in range(len(by))]
    named = rows.select(*(F.col(c).alias(k) for c, k in zip(by, keys, strict=True)), F.col(order).alias("_o"), text.cast("string").alias("_t"))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, n, state = None, 0, hashlib.sha256()
        schema = None

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*(pa.array([v], schema.field(k).type) for k, v in zip(keys, now, strict=True)), pa.array([n]), pa.array([state.hexdigest()])], names=[*keys, "n", "hash"])

        for batch in batches:
            schema = batch.schema
            if not batch.num_rows:
                continue
            new = np.zeros(batch.num_rows, bool)
            for k in keys:
                c = batch.column(schema.get_field_index(k))
                a, b = c.slice(1), c.slice(0, len(c) - 1)
                same = pc.fill_null(pc.equal(a, b), False)
                new[1:] |= ~np.asarray(pc.or_(same, pc.and_(pc.is_null(a), pc.is_null(b))))
            texts = batch.column(schema.get_field_index("_t"))
            cuts = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                own = tuple(batch.column(schema.get_field_index(k))[lo].as_py() for k in keys)
                if now is None or own != now:
                    if now is not None:
                        yield told()
                    now, n, state = own, 0, hashlib.sha256()
                state.update("".join(t for t in texts.slice(lo, hi - lo).to_pylist() if t is not None).encode())
                n += hi - lo
        if now is not None:
            yield told()

    types = StructType([*(StructField(k, named.schema[k].dataType) for k in keys), StructField("n", LongType()), StructField("hash", StringType())])
    placed = named.repartition(*keys).sortWithinPartitions(*keys, "_o", "_t") if keys else named.coalesce(1).sortWithinPartitions("_o", "_t")
    made = placed.select(*keys, "_t").mapInArrow(fold, types)
    return made.withColumnsRenamed(dict(zip(keys, by, strict=True)))


def agreed(rows: DataFrame, by: list[str], field: str) -> DataFrame:
    """The one value that all rows of a group share, else ``unknown``."""
    same = (F.count_distinct(field) == 1) & (F.count(field) == F.count("*"))
    return rows.groupBy(*by).agg(F.when(same, F.min(F.col(field).cast("string"))).otherwise("unknown").alias(field))


def reconciled(counts: list[DataFrame]) -> DataFrame:
    """From tables (store, n): whether all stores hold as many rows."""
    both = reduce(DataFrame.unionByName, counts)
    return both.agg(F.min("n").alias("least"), F.max("n").alias("most"), (F.min("n") == F.max("n")).alias("consistent"))


def status(rows: DataFrame, col: str = "status", by: tuple[str, ...] = ()) -> DataFrame:
    """fail if any failed, else not_run if any did not run, else pass; per group."""
    found = F.when(F.bool_or(F.col(col) == "fail"), "fail").when(F.bool_or(F.col(col) == "not_run"), "not_run").otherwise("pass")
    return rows.groupBy(*by).agg(found.alias("status"), F.count("*").alias("n"))


def contract(vectors: DataFrame, dims: int, id_col: str = "vec_id", vector_col: str = "embedding", tolerance: float = 1e-3) -> DataFrame:
    """Counts of rows that break a vector table's rules: length, finite, unit, unique id."""
    v = F.col(vector_col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    size = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    ok = lambda c: F.coalesce(c, F.lit(False))
    broken = vectors.agg(F.count("*").alias("n"), F.count_if(~ok(F.size(v) == dims)).alias("length"), F.count_if(~ok(finite)).alias("not_finite"), F.count_if(~ok(F.abs(size - 1) <= tolerance)).alias("not_unit"))
    return broken.withColumn("_one", F.lit(1)).join(duplicates(vectors, [id_col]).withColumn("_one", F.lit(1)), "_one").drop("_one")
