"""Approximate top-k over cells of unit vectors: centroids are fitted on a sample, every
row belongs to its nearest one, and a query reads the cells nearest to it only. Written
partitioned by ``cell``, a search prunes to the files of these cells."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from . import blocks, search

#: Rows that the centroids are fitted on, about.
SAMPLE = 100_000


def centroids(vectors: DataFrame, cells: int, vector_col: str = "embedding", seed: int = 7) -> np.ndarray:
    """Unit centroids (rows) by cosine k-means on a sample of about ``SAMPLE`` rows whose
    vectors have a direction."""
    rows = usable(vectors, vector_col).select(F.col(vector_col).cast("array<double>").alias("v"))
    n = rows.count()
    if not n:
        raise ValueError("no row has a vector with a direction")
    share = min(1.0, SAMPLE / n)
    chosen = rows.where(F.pmod(F.xxhash64("v"), F.lit(1 << 20)) < F.lit(share * (1 << 20))).select(array_to_vector("v").alias("features"))
    model = KMeans(k=min(cells, n), seed=seed, distanceMeasure="cosine", maxIter=15).fit(chosen)
    made = np.array(model.clusterCenters())
    return made / np.maximum(np.linalg.norm(made, axis=1, keepdims=True), 1e-12)


def usable(vectors: DataFrame, vector_col: str = "embedding") -> DataFrame:
    """Rows whose vectors have a direction: finite components, not all of them zero."""
    v = F.col(vector_col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(v.isNotNull() & finite & F.exists(v, lambda x: x != 0))


def placed(vectors: DataFrame, centres: np.ndarray, vector_col: str = "embedding") -> DataFrame:
    """Rows with their ``cell``. Vectors that are null or of another length, or whose
    components are null, not finite or all zero, have no direction: these rows go."""
    columns = vectors.columns

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(columns.index(vector_col))
            flat = rows.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(rows), -1)
            cell = pa.array((flat @ centres.T).argmax(1).astype(np.int32)) if len(rows) else pa.array([], pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, cell], names=[*columns, "cell"])

    rows = usable(vectors, vector_col).where(F.size(vector_col) == centres.shape[1])
    return rows.mapInArrow(place, StructType([*vectors.schema.fields, StructField("cell", IntegerType())]))


def nearest_cells(query: list[float], centres: np.ndarray, probes: int) -> list[int]:
    return np.argsort(-(centres @ np.array(query)), kind="stable")[:probes].tolist()


def approximate(index: DataFrame, centres: np.ndarray, query: list[float], k: int, probes: int, **columns) -> DataFrame:
    """The k nearest rows of the ``probes`` cells nearest to the query; all cells give the
    exact answer."""
    return search.exact(index.where(F.col("cell").isin(nearest_cells(query, centres, probes))), query, k, **columns)


def near_cells(queries: DataFrame, centres: np.ndarray, probes: int) -> DataFrame:
    """(query_id, query) with ``near``, the ``probes`` cells nearest to the query."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column(1).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            near = np.argsort(-(flat @ centres.T), axis=1, kind="stable")[:, :probes].astype(np.int32)
            bounds = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * near.shape[1])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(bounds, pa.array(near.ravel()))], names=["query_id", "query", "near"])

    schema = StructType([queries.schema["query_id"], queries.schema["query"], StructField("near", ArrayType(IntegerType()))])
    return queries.select("query_id", "query").mapInArrow(ask, schema)


def nearest(queries: DataFrame, centres: np.ndarray, probes: int) -> DataFrame:
    """(query_id, query) with each of the ``probes`` cells nearest to the query."""
    return near_cells(queries, centres, probes).select("query_id", "query", F.explode("near").alias("cell"))


def approximate_many(index: DataFrame, queries: DataFrame, centres: np.ndarray, k: int, probes: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The same for each of (query_id, query): query_id, id, dist, rank. Blocks of a cell's
    rows meet the queries that ask for it as matrices; only what may be among a query's best
    leaves the task."""
    asked = near_cells(usable(queries, "query"), centres, probes)
    return blocks.nearest(index, asked, k, id_col=id_col, vector_col=vector_col, by="cell")
