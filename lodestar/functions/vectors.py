"""Vector expressions on array columns: products, cosine, shortened unit vectors.

All arithmetic is in double precision, whatever the arrays hold. The expressions are
built from array functions; for many rows of long vectors, ``arrow_cosine`` does the
same work with NumPy on Arrow batches.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

_ZERO = F.lit


def _column(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def literal(vector: list[float]) -> Column:
    """A query vector as a constant."""
    return F.array(*(F.lit(float(x)) for x in vector))


def dot(a: Column | str, b: Column | str) -> Column:
    """Inner product; null if either side is null or their lengths differ."""
    products = F.zip_with(_column(a), _column(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine similarity; 0 if either vector is zero."""
    length = norm(a) * norm(b)
    return F.when(length == 0, F.lit(0.0)).otherwise(dot(a, b) / length)


def cosine_distance(a: Column | str, b: Column | str) -> Column:
    return F.lit(1.0) - cosine(a, b)


def arrow_cosine(query: list[float]):
    """A function column -> cosine with a fixed query, on Arrow batches: 0 with a zero
    vector, null for null vectors and for those of another length. Sums have one order, so
    equal vectors have equal cosines."""
    q = np.asarray(query, float)
    length = np.sqrt((q * q).sum())

    @F.arrow_udf("double")
    def cosine_with(column: pa.Array) -> pa.Array:
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        sizes = column.value_lengths()
        fits = np.asarray(pc.fill_null(pc.equal(sizes, len(q)), False))
        some = column if fits.all() else column.filter(pa.array(fits))
        x = np.asarray(some.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)).reshape(-1, len(q))
        size = np.sqrt((x * x).sum(1)) * length
        found = np.divide((x * q).sum(1), size, out=np.zeros(len(x)), where=size != 0)
        # a null component comes as NaN, as does one that is none
        out = np.full(len(column), np.nan)
        out[fits] = found
        return pa.array(out, mask=~fits)

    return cosine_with


def shorten(vector: Column | str, dims: int) -> Column:
    """The first ``dims`` components as a unit vector; null if these are all zero or
    there are fewer."""
    head = F.slice(_column(vector), 1, dims)
    size = norm(head)
    unit = F.transform(head, lambda x: x.cast("double") / size)
    return F.when((F.size(_column(vector)) >= dims) & (size > 0), unit)


def shorten_strict(vector: Column | str, dims: int) -> Column:
    """As ``shorten``, but an error where the vector can't be shortened."""
    column = _column(vector)
    finite = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    short = shorten(column, dims)
    return F.when(finite & short.isNotNull(), short).otherwise(F.raise_error(F.lit(f"no unit vector of {dims} components")).cast("array<double>"))


def shortening_faults(vector: Column | str, short: Column | str, dims: int, tolerance: float = 1e-5) -> Column:
    """Names of the rules that a shortened vector breaks: length, finite, unit, direction."""
    short = _column(short)
    head = F.slice(_column(vector), 1, dims)
    finite = F.forall(short, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rules = F.array(
        F.when(F.size(short) != dims, F.lit("length")),
        F.when(~finite, F.lit("finite")),
        F.when(F.abs(norm(short) - 1) > tolerance, F.lit("unit")),
        F.when(cosine(head, short) < 1 - 1e-4, F.lit("direction")),
    )
    return F.filter(rules, lambda r: r.isNotNull())


def half_precision(vector: Column | str) -> Column:
    """The vector after a round trip through 16-bit floats."""

    @F.pandas_udf("array<double>")
    def trip(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for column in batches:
            yield column.map(lambda v: None if v is None else np.asarray(v, np.float16).astype(float))

    return trip(_column(vector))


def _drawn(keys: list, dims: int) -> np.ndarray:
    """A unit vector for each key, seeded by its SHA-256; NaN for null."""
    made = np.full((len(keys), dims), np.nan)
    for row, key in zip(made, keys, strict=True):
        if key is not None:
            seed = int.from_bytes(hashlib.sha256(key.encode()).digest()[:8], "big")
            v = np.random.default_rng(seed).standard_normal(dims)
            row[:] = v / np.sqrt((v * v).sum())
    return made


def _listed(rows: np.ndarray, known: np.ndarray) -> pa.Array:
    """Rows as an Arrow list, null where they aren't known."""
    ends = np.append(0, np.cumsum(np.where(known, rows.shape[1], 0))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(rows[known].ravel()), mask=pa.array(~known))


def synthetic_unit(key: Column | str, dims: int) -> Column:
    """A unit vector that depends on the key only (seeded by its SHA-256)."""

    @F.arrow_udf("array<double>")
    def draw(column: pa.Array) -> pa.Array:
        return _listed(_drawn(column.to_pylist(), dims), np.asarray(column.is_valid()))

    return draw(_column(key).cast("string"))


def around(vector: Column | str, key: Column | str, dims: int, share: float) -> Column:
    """``shorten`` of the vector plus ``share`` of ``synthetic_unit`` of the key, on Arrow
    batches, with the same sums in the same order."""

    @F.arrow_udf("array<double>")
    def move(column: pa.Array, keys: pa.Array) -> pa.Array:
        long = np.asarray(pc.fill_null(pc.greater_equal(column.value_lengths(), dims), False))
        head = pc.list_slice(column.filter(pa.array(long)), 0, dims).flatten()
        unknown = np.zeros(len(column), bool)
        unknown[long] = np.asarray(head.is_null()).reshape(-1, dims).any(1)
        x = np.full((len(column), dims), np.nan)
        x[long] = head.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dims)
        x += _drawn(keys.to_pylist(), dims) * share
        size = np.sqrt(np.cumsum(x * x, axis=1)[:, -1:])
        known = long & ~unknown & np.asarray(keys.is_valid()) & ((size[:, 0] > 0) | np.isnan(size[:, 0]))
        with np.errstate(invalid="ignore", divide="ignore"):
            return _listed(x / size, known)

    return move(_column(vector), _column(key).cast("string"))
