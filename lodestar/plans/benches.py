"""Benches of search: strategies against the exact answer, sweeps, repeatability. Each is a
table of a row per setting, made by one plan."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import blocks, metrics, search
from ..sources.shards import export_csv

UNSUPPORTED = "unsupported_strategy"


def _agreed(found: DataFrame, truth: DataFrame, setting: Mapping[str, object], id_col: str) -> DataFrame:
    """One row: the setting, hits found, true hits, and the share of these that was found
    (1 if there are none)."""
    both = found.select(id_col, F.lit(1).alias("f")).join(truth.select(id_col, F.lit(1).alias("t")), id_col, "full")
    counts = both.agg(F.count("f").alias("found"), F.count("t").alias("truth"), F.count_if(F.col("f").isNotNull() & F.col("t").isNotNull()).alias("_both"))
    recall = F.when(F.col("truth") == 0, F.lit(1.0)).otherwise(F.col("_both") / F.col("truth"))
    return counts.select(*(F.lit(v).alias(k) for k, v in setting.items()), "found", "truth", recall.alias("recall"))


def matrix(vectors: DataFrame, query: list[float], k: int, strategies: Iterable[str], filters: Mapping[str, Column], supported: Sequence[str] = search.STRATEGIES, id_col: str = "vec_id", options: Mapping[str, Mapping] | None = None) -> DataFrame:
    """Strategy by filter: recall against the exact answer under the filter. A strategy
    that isn't supported has a row that says so, without figures."""
    rows = []
    for name, where in filters.items():
        truth = search.prefilter(vectors, query, k, where)
        for strategy in strategies:
            setting = {"strategy": strategy, "filter": name}
            if strategy not in supported:
                none = vectors.sparkSession.range(1)
                rows.append(none.select(F.lit(strategy).alias("strategy"), F.lit(name).alias("filter"), *(F.lit(None).cast(t).alias(c) for c, t in (("found", "long"), ("truth", "long"), ("recall", "double"))), F.lit(UNSUPPORTED).alias("status")))
                continue
            found = search.search(vectors, query, k, strategy, where, **(options or {}).get(strategy, {}))
            rows.append(_agreed(found, truth, setting, id_col).withColumn("status", F.lit("ok")))
    return reduce(DataFrame.unionByName, rows)


def sweep(run: Callable[[object], DataFrame], values: Iterable, truth: DataFrame, name: str, id_col: str = "vec_id") -> DataFrame:
    """Recall of ``run(value)`` for each value of a setting."""
    return reduce(DataFrame.unionByName, [_agreed(run(v), truth, {name: v}, id_col) for v in values])


def repeatable(run: Callable[[], DataFrame]) -> DataFrame:
    """One row: rows that only one of two runs has, and whether there are none."""
    a, b = run(), run()
    counts = [x.exceptAll(y).agg(F.count("*").alias(n)) for n, x, y in (("only_first", a, b), ("only_second", b, a))]
    return counts[0].crossJoin(counts[1]).withColumn("repeatable", F.expr("only_first = 0 and only_second = 0"))


def filter_comparison(scores: Mapping[str, tuple[DataFrame, DataFrame]], value: str) -> DataFrame:
    """Per model the mean of a metric without and with a filter, and the gain."""
    rows = [a.agg(F.avg(value).alias("without")).crossJoin(b.agg(F.avg(value).alias("with"))).select(F.lit(m).alias("model"), "without", "with", (F.col("with") - F.col("without")).alias("gain")) for m, (a, b) in scores.items()]
    return reduce(DataFrame.unionByName, rows)


#: Candidates of the first stage that the adaptive bench tries.
CANDIDATES = (20, 50, 100, 200)


def adaptive(vectors: DataFrame, queries: DataFrame, k: int, dims: tuple[int, int, int], approximate: Callable[[int], DataFrame], candidates: Sequence[int] = CANDIDATES, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """For each of (query_id, query) six references, exact and approximate in each of three
    numbers of components (the whole first), and two stages from both shorter ones to the
    whole, for each number of candidates: strategy, stage1_dim, rerank_dim, candidate_k,
    candidate_count, returned_count, underfilled, and for two stages the agreement with the
    exact answer. ``approximate(d)`` gives (query_id, id) of an index of d components. A
    query that finds nothing has its rows as well."""
    columns = {"id_col": id_col, "vector_col": vector_col}
    whole, *short = dims
    own = "query_id", F.col(id_col).alias("id")
    none = lambda n: F.lit(None).cast("int").alias(n)
    parts = []
    for d in dims:
        for kind, found in (("exact", blocks.nearest(vectors, queries, k, d, **columns)), ("approximate", approximate(d))):
            parts.append(found.select(*own, F.lit(f"{d}_{kind}").alias("strategy"), none("stage1_dim"), F.lit(d).alias("rerank_dim"), none("candidate_k"), F.lit(None).cast("long").alias("n_candidates")))
    two = blocks.two_stage(vectors, queries, k, [(d, whole) for d in short], candidates, **columns)
    parts.append(two.select(*own, F.format_string("adaptive_%d_to_%d", "first", "second").alias("strategy"), F.col("first").alias("stage1_dim"), F.col("second").alias("rerank_dim"), F.col("candidates").alias("candidate_k"), "n_candidates"))
    found = reduce(DataFrame.unionByName, parts)
    truth = blocks.nearest(vectors, queries, k, whole, **columns).select(*own, F.lit(1).alias("_true"))
    setting = ["query_id", "strategy", "stage1_dim", "rerank_dim", "candidate_k"]
    counts = found.join(truth, ["query_id", "id"], "left").groupBy(*setting).agg(F.count("*").alias("returned_count"), F.max("n_candidates").alias("n_candidates"), F.count("_true").alias("_both"))
    sizes = truth.groupBy("query_id").agg(F.count("*").alias("_n"))
    grid = [(f"{d}_{kind}", None, d, None) for d in dims for kind in ("exact", "approximate")] + [(f"adaptive_{d}_to_{whole}", d, whole, c) for d in short for c in candidates]
    # a row per setting: fourteen
    every = queries.select("query_id").distinct().crossJoin(F.broadcast(vectors.sparkSession.createDataFrame(grid, "strategy string, stage1_dim int, rerank_dim int, candidate_k int")))
    same = [F.col(f"e.{c}").eqNullSafe(F.col(f"c.{c}")) for c in setting]
    met = every.alias("e").join(counts.alias("c"), reduce(Column.__and__, same), "left").select("e.*", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("returned_count", "_both")), "n_candidates")
    share = F.when(F.col("stage1_dim").isNotNull(), F.coalesce(F.col("_both") / F.least(F.lit(k), F.col("_n")), F.lit(0.0)))
    return met.join(sizes, "query_id", "left").select(*setting, F.when(F.col("stage1_dim").isNull(), F.col("returned_count")).otherwise(F.coalesce("n_candidates", F.lit(0))).alias("candidate_count"), "returned_count", (F.col("returned_count") < k).alias("underfilled"), share.alias("agreement"))


def quality(scores: Mapping[str, DataFrame], base: str, value: str = "value", by: str = "query_id", resamples: int = 2000, seed: int = 0) -> DataFrame:
    """For named tables (query, value): n and mean of each, and against ``base``, over the
    queries that both have, the mean difference with its bootstrap interval and effect
    size: name, n, mean, mean_diff, ci_lo, ci_hi, cohens_d, better (the interval lies above
    0), worse. The base has no difference to itself."""
    truth = scores[base].select(by, F.col(value).alias("_b"))
    rows = []
    for name, own in scores.items():
        facts = own.agg(F.lit(name).alias("name"), F.count(value).alias("n"), F.avg(value).alias("mean"))
        if name == base:
            rows.append(facts.select("*", *(F.lit(None).cast("double").alias(c) for c in ("mean_diff", "ci_lo", "ci_hi", "cohens_d"))))
            continue
        pairs = own.select(by, F.col(value).alias("_a")).join(truth, by)
        told = metrics.paired_bootstrap(pairs, "_a", "_b", resamples=resamples, seed=seed).drop("n")
        rows.append(facts.withColumn("_one", F.lit(1)).join(told.withColumn("_one", F.lit(1)), "_one", "left").select("name", "n", "mean", "mean_diff", "ci_lo", "ci_hi", "cohens_d"))
    out = reduce(DataFrame.unionByName, rows)
    return out.withColumns({"better": F.col("ci_lo") > 0, "worse": F.col("ci_hi") < 0})


def recalls(found: DataFrame, truth: DataFrame, queries: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """(query_id, value): the share of each query's true hits that were found; queries
    without true hits have none."""
    met = truth.select("query_id", id_col).join(found.select("query_id", id_col, F.lit(1).alias("_f")), ["query_id", id_col], "left")
    return queries.select("query_id").join(met.groupBy("query_id").agg((F.count("_f") / F.count("*")).alias("value")), "query_id")


def selectivity_matrix(vectors: DataFrame, queries: DataFrame, k: int, dims: Sequence[int], filters: Mapping[str, Column], fetch: int = search.FETCH, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Many queries over strategy, number of components and filter: mean recall of the exact
    answer under the filter and how many queries found fewer than k rows."""
    rows = []
    columns = {"id_col": id_col, "vector_col": vector_col}
    for name, where in filters.items():
        kept = vectors.where(where)
        ids = kept.select(id_col)
        truth = blocks.nearest(kept, queries, k, **columns)
        for d in dims:
            wide = blocks.nearest(vectors, queries, k * fetch, d, **columns).join(ids, id_col, "left_semi")
            again = F.row_number().over(Window.partitionBy("query_id").orderBy("dist", id_col))
            for strategy, found in (("prefilter", blocks.nearest(kept, queries, k, d, **columns)), ("postfilter", wide.withColumn("rank", again).where(F.col("rank") <= k))):
                hit = truth.select("query_id", id_col, F.lit(1).alias("t")).join(found.select("query_id", id_col, F.lit(1).alias("f")), ["query_id", id_col], "full")
                each = queries.select("query_id").join(hit.groupBy("query_id").agg(F.count("t").alias("t"), F.count("f").alias("f"), F.count_if(F.col("t").isNotNull() & F.col("f").isNotNull()).alias("b")), "query_id", "left").na.fill(0)
                recall = F.when(F.col("t") == 0, F.lit(1.0)).otherwise(F.col("b") / F.col("t"))
                rows.append(each.agg(F.lit(strategy).alias("strategy"), F.lit(d).alias("dim"), F.lit(name).alias("filter"), F.count("*").alias("n_queries"), F.avg(recall).alias("recall"), F.count_if(F.col("f") < k).alias("underfilled")))
    return reduce(DataFrame.unionByName, rows)


def by_strategy(rows: DataFrame, means: Sequence[str]) -> DataFrame:
    """Per strategy the number of queries, how many of them found too little, and the mean
    of each metric over the queries that have it."""
    return rows.groupBy("strategy").agg(F.count("*").alias("n_queries"), F.count_if("underfilled").alias("underfilled_count"), *(F.avg(f"`{m}`").alias(f"mean_{m}") for m in means))


def write_run(rows: DataFrame, folder: str, manifest: Mapping[str, object], means: Sequence[str], sql_col: str = "sql") -> None:
    """A bench's artifacts below ``folder``: ``manifest``, ``query_results`` (a line per
    query; of its SQL only whether it has some), ``metrics``, ``strategy_matrix`` (CSV) and
    ``sql``, one statement for each strategy that has any. Each replaces what was there."""
    spark = rows.sparkSession
    spark.createDataFrame([(json.dumps(dict(manifest), ensure_ascii=False, sort_keys=True, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/manifest")
    rows.withColumn("has_sql", F.coalesce(F.length(sql_col) > 0, F.lit(False))).drop(sql_col).write.mode("overwrite").option("ignoreNullFields", "false").json(f"{folder}/query_results")
    shares = by_strategy(rows, means).orderBy("strategy")
    shares.coalesce(1).write.mode("overwrite").option("ignoreNullFields", "false").json(f"{folder}/metrics")
    export_csv(shares, f"{folder}/strategy_matrix")
    rows.where(F.length(sql_col) > 0).groupBy("strategy").agg(F.min(sql_col).alias(sql_col)).write.mode("overwrite").json(f"{folder}/sql")
