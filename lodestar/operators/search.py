"""Top-k search over a vector table: strategies, two stages, rerank, agreement.

A query vector is a constant in the plan. The nearest rows come from ``orderBy`` and
``limit``, which each task answers for its own rows before k rows each meet; metadata is
joined after the limit. Ties always go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import arrow_cosine, cosine_distance, literal, shorten
from . import blocks

STRATEGIES = ("exact", "prefilter", "postfilter", "candidates", "adaptive")
#: How many times k a filter after the search fetches.
FETCH = 5


def probe(vectors: DataFrame, key: object, id_col: str = "vec_id", vector_col: str = "embedding") -> list[float]:
    """The vector of one row (the first in the order of ids, if the key is None)."""
    rows = vectors.orderBy(id_col) if key is None else vectors.where(F.col(id_col) == key)
    row = rows.select(vector_col).limit(1).collect()
    if not row:
        raise ValueError(f"no vector for {key}")
    return [float(x) for x in row[0][0]]


#: Components from which one query's distances are computed on Arrow batches.
WIDE = 32


def scored(vectors: DataFrame, query: list[float], vector_col: str = "embedding", out: str = "dist") -> DataFrame:
    """Rows with their cosine distance; null where there is none."""
    if len(query) < WIDE:
        return vectors.withColumn(out, cosine_distance(vector_col, literal(query)))
    return vectors.withColumn(out, F.lit(1.0) - arrow_cosine(query)(F.col(vector_col)))


def exact(vectors: DataFrame, query: list[float], k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k nearest rows by cosine distance, with ``dist``."""
    return scored(vectors, query, vector_col).orderBy("dist", id_col).limit(k)


def prefilter(vectors: DataFrame, query: list[float], k: int, where: Column, **columns) -> DataFrame:
    """Filter first: min(k, matching rows) rows always come back."""
    return exact(vectors.where(where), query, k, **columns)


def postfilter(vectors: DataFrame, query: list[float], k: int, where: Column, fetch: int = FETCH, **columns) -> DataFrame:
    """Search first, over ``fetch`` times k rows, then filter: may come back short."""
    id_col = columns.get("id_col", "vec_id")
    return exact(vectors, query, k * fetch, **columns).where(where).orderBy("dist", id_col).limit(k)


def restricted(vectors: DataFrame, query: list[float], k: int, ids: DataFrame, id_col: str = "vec_id", **columns) -> DataFrame:
    """Exact search among the rows whose ids ``ids`` lists; no ids end the search at once."""
    if ids.isEmpty():
        return scored(vectors.limit(0), query, columns.get("vector_col", "embedding"))
    return exact(vectors.join(ids.select(id_col).distinct(), id_col, "left_semi"), query, k, id_col, **columns)


def adaptive(vectors: DataFrame, query: list[float], k: int, dims: int, candidates: int, id_col: str = "vec_id", vector_col: str = "embedding", where: Column | None = None) -> DataFrame:
    """Two stages: ``candidates`` rows nearest in the first ``dims`` components, then the
    k nearest of these by whole vectors."""
    if candidates < k:
        raise ValueError("the first stage must fetch k rows at least")
    rows = vectors if where is None else vectors.where(where)
    small = literal([x for x in query[:dims]])
    first = rows.withColumn("_short", cosine_distance(F.slice(vector_col, 1, dims), small)).orderBy("_short", id_col).limit(candidates)
    return exact(first.drop("_short"), query, k, id_col, vector_col)


def search(vectors: DataFrame, query: list[float], k: int, strategy: str = "prefilter", where: Column | None = None, **options) -> DataFrame:
    """One entry for all strategies; all of them apply ``where``: before the search, but
    ``postfilter`` after it."""
    if strategy not in STRATEGIES:
        raise ValueError(f"{strategy} is no strategy")
    where = F.lit(True) if where is None else where
    run: dict[str, Callable[..., DataFrame]] = {
        "exact": lambda **o: prefilter(vectors, query, k, where, **o),
        "prefilter": lambda **o: prefilter(vectors, query, k, where, **o),
        "postfilter": lambda **o: postfilter(vectors, query, k, where, **o),
        "candidates": lambda **o: restricted(vectors.where(where), query, k, **o),
        "adaptive": lambda **o: adaptive(vectors, query, k, where=where, **o),
    }
    return run[strategy](**options)


def pairs(vectors: DataFrame, queries: DataFrame, vector_col: str = "embedding") -> DataFrame:
    """All rows (without their vectors) for each query (query_id and other columns), with
    ``dist``: as many rows as there are pairs. Columns of a query that a row has as well are
    called ``_name``."""
    own = [c for c in vectors.columns if c != vector_col]
    told = [c for c in queries.columns if c != "query"]
    items = vectors.select(F.struct(*own).alias("_item"), vector_col)
    asked = queries.select(F.struct(*told).alias("query_id"), "query")
    found = blocks.pairs(items, asked, "_item", vector_col)
    return found.select(*(F.col(f"_item.{c}").alias(c) for c in own), *(F.col(f"query_id.{c}").alias(f"_{c}" if c in own else c) for c in told), "dist")


def many(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k nearest rows for each query (query_id, query): query_id, id, dist, rank. Any
    number of queries, block by block."""
    return blocks.nearest(vectors, queries.select("query_id", "query"), k, id_col=id_col, vector_col=vector_col)


def ranked(hits: DataFrame, id_col: str = "vec_id", score_col: str = "dist") -> DataFrame:
    """Hits of one query with their rank; k rows, so one task is enough."""
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(score_col, id_col)))


def hydrate(hits: DataFrame, metadata: DataFrame, key: str, meta_key: str) -> DataFrame:
    """Hits in their order, each with its row of metadata, if there is one."""
    return hits.join(metadata, hits[key] == metadata[meta_key], "left")


def shortened(vectors: DataFrame, dims: list[int], vector_col: str = "embedding") -> DataFrame:
    """A row for each vector and each number of dimensions, with the unit vector."""
    made = F.array(*(F.struct(F.lit(d).alias("dim"), shorten(vector_col, d).alias("vector")) for d in dims))
    return vectors.withColumn("_short", F.explode(made)).select(*[c for c in vectors.columns if c != vector_col], "_short.dim", "_short.vector")


def agreement(found: DataFrame, truth: DataFrame, k: int, id_col: str = "vec_id", by: str | None = None) -> DataFrame:
    """Share of the true hits that were found, and the Jaccard index of both lists; an
    empty truth agrees in 0, two empty lists have index 1."""
    keys = [by] if by else []
    a = found.groupBy(*keys).agg(F.collect_set(id_col).alias("found"))
    b = truth.groupBy(*keys).agg(F.collect_set(id_col).alias("truth"))
    both = a.join(b, keys, "full") if keys else a.withColumn("_one", F.lit(1)).join(b.withColumn("_one", F.lit(1)), "_one", "full").drop("_one")
    none = F.array().cast(found.select(F.collect_set(id_col).alias("x")).schema["x"].dataType)
    both = both.select(*keys, F.coalesce("found", none).alias("found"), F.coalesce("truth", none).alias("truth"))
    common, union = F.size(F.array_intersect("found", "truth")), F.size(F.array_union("found", "truth"))
    return both.select(
        *keys,
        common.cast("long").alias("n_common"),
        F.when(F.size("truth") == 0, F.lit(0.0)).otherwise(common / F.least(F.lit(k), F.size("truth"))).alias("agreement"),
        F.when(union == 0, F.lit(1.0)).otherwise(common / union).alias("jaccard"),
    )


def underfill(returned: Column, matching: Column, k: int) -> Column:
    """Why fewer than k rows came back."""
    return F.when(returned >= k, "full").when(matching <= returned, "corpus_exhausted").when(returned == 0, "empty_despite_matches").otherwise("strategy_underfill")


def mean_vector(vectors: DataFrame, by: list[str], vector_col: str = "embedding") -> DataFrame:
    """Mean of unit vectors per group, as a unit vector: components are averaged apart
    (aggregated before the exchange) and put together again."""
    unit = vectors.select(*by, shorten_all(vector_col).alias("_v")).where("_v is not null")
    parts = unit.select(*by, F.posexplode("_v")).groupBy(*by, "pos").agg(F.avg("col").alias("mean"))
    whole = parts.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "mean"))), lambda x: x["mean"]).alias("_m"))
    size = F.sqrt(F.aggregate("_m", F.lit(0.0), lambda s, x: s + x * x))
    return whole.select(*by, F.when(size > 0, F.transform("_m", lambda x: x / size)).alias("vector"))


def shorten_all(vector_col: str) -> Column:
    size = F.sqrt(F.aggregate(vector_col, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(size > 0, F.transform(vector_col, lambda x: x.cast("double") / size))
