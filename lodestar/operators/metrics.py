"""Retrieval quality: hits at rank, corpus metrics, bootstrap intervals, confusion."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from .features import positions


class _Spans:
    """True spans of a group in their order, taken one by one."""

    def __init__(self, begin: list[float], end: list[float], least: float):
        self.begin, self.end, self.least = begin, end, least
        self.free = [True] * len(begin)
        self.large = None
        if len(begin) > 16:
            b, e = np.array(begin), np.array(end)
            self.large = b, e, np.ones(len(b), bool), np.maximum.accumulate(np.where(np.isnan(e), -np.inf, e))

    def take(self, s: float, e: float) -> bool:
        """Whether a span was left for a row, which then has it."""
        if self.large is None:
            for i, free in enumerate(self.free):
                if free:
                    begin, end = self.begin[i], self.end[i]
                    both = max(0.0, min(end, e) - max(begin, s))
                    union = (e - s) + (end - begin) - both
                    if union > 0 and both >= self.least * union - 1e-12 * union:
                        self.free[i] = False
                        return True
            return False
        begin, end, free, reach = self.large
        lo, hi = 0, len(begin)
        if self.least > 1e-12:
            # only spans that overlap can fit
            lo, hi = int(np.searchsorted(reach, s, side="right")), int(np.searchsorted(begin, e))
        begin, end = begin[lo:hi], end[lo:hi]
        both = np.maximum(0.0, np.minimum(end, e) - np.maximum(begin, s))
        union = (e - s) + (end - begin) - both
        fits = np.flatnonzero(free[lo:hi] & (union > 0) & (both >= self.least * union - 1e-12 * union))
        if len(fits):
            free[lo + fits[0]] = False
        return bool(len(fits))


def greedy_hits(found: DataFrame, truth: DataFrame, least: float = 0.5) -> DataFrame:
    """``found`` (query_id, rank, video, t_start, t_end) with ``hit`` and the query's
    number of true spans (n_gt): in the order of rank, a row takes the first true span of
    its video, by (t_start, t_end), that has an IoU of ``least`` and isn't taken.

    Spans of other videos don't matter, so a video of a query is a group; its rows pass
    through a task in order, which holds the true spans of one group. Queries without rows in
    ``found`` don't appear here.
    """
    keys, columns = ["query_id", "video"], found.columns
    names = [f"c{i}" for i in range(len(columns))]
    edges = [F.col("t_start").cast("double").alias("_s"), F.col("t_end").cast("double").alias("_e")]
    key = F.to_json(F.struct(*(F.col(k).cast(found.schema[k].dataType).alias(k) for k in keys))).alias("_k")
    rows = found.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(columns, names, strict=True)), key, F.lit(1).alias("_side"), *edges)
    spans = truth.select(*(F.lit(None).cast(found.schema[c].dataType).alias(n) for c, n in zip(columns, names, strict=True)), key, F.lit(0).alias("_side"), *edges)
    rank = F.col(names[columns.index("rank")])
    order = ["_h", "_k", "_side", *(c.asc_nulls_last() for c in (rank, F.col("_s"), F.col("_e")))]
    dealt = rows.unionByName(spans).withColumn("_h", F.xxhash64("_k")).repartition("_h").sortWithinPartitions(*order)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # true spans of the group that a batch may cut
        group, held = None, _Spans([], [], least)
        for batch in batches:
            if not batch.num_rows:
                continue
            _k = batch.column(len(names))
            side, s, e = (batch.column(len(names) + i).to_numpy(zero_copy_only=False) for i in (1, 2, 3))
            first = np.append(0, np.flatnonzero(np.asarray(pc.not_equal(_k[1:], _k[:-1]))) + 1) if len(_k) > 1 else np.zeros(1, int)
            last = np.append(first[1:], len(_k))
            n_rows = np.add.reduceat(side, first)
            hits = np.zeros(len(_k), bool)
            some = (n_rows > 0) & (n_rows < last - first)
            some[0] = some[-1] = True
            for i in np.flatnonzero(some).tolist():
                lo, hi, name = first[i], last[i], _k[int(first[i])].as_py()
                cut = hi - n_rows[i]
                if name != group:
                    group, held = name, _Spans(s[lo:cut].tolist(), e[lo:cut].tolist(), least)
                elif cut > lo:
                    held = _Spans(held.begin + s[lo:cut].tolist(), held.end + e[lo:cut].tolist(), least)
                for at in range(cut, hi):
                    hits[at] = held.take(float(s[at]), float(e[at]))
            own = batch.select(names).filter(pa.array(side == 1))
            yield pa.RecordBatch.from_arrays([*own.columns, pa.array(hits[side == 1])], names=[*names, "hit"])

    out = StructType([*(StructField(n, found.schema[c].dataType) for c, n in zip(columns, names, strict=True)), StructField("hit", BooleanType())])
    judged = dealt.mapInArrow(judge, out).toDF(*columns, "hit")
    known = truth.groupBy("query_id").agg(F.count("*").alias("n_gt"))
    return judged.join(known, "query_id", "left").withColumn("n_gt", F.coalesce("n_gt", F.lit(0)))


def ranked_metrics(hits: DataFrame, ks: tuple[int, ...] = (1, 5, 10), by: str = "query_id") -> DataFrame:
    """Per query from (rank, hit, n_gt): mrr, ndcg@10, map, and precision and recall at
    each k. No true spans give 0 everywhere; precision divides by the rows returned, if
    fewer than k."""
    order = Window.partitionBy(by).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    seen = hits.withColumn("_hits", F.sum(F.col("hit").cast("int")).over(order))
    gain = F.when(F.col("hit") & (F.col("rank") <= 10), 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)
    made = seen.groupBy(by).agg(
        F.max("n_gt").alias("n_gt"),
        F.coalesce(1 / F.min(F.when(F.col("hit"), F.col("rank"))), F.lit(0.0)).alias("mrr"),
        F.sum(gain).alias("_dcg"),
        F.sum(F.when(F.col("hit"), F.col("_hits") / F.col("rank")).otherwise(0.0)).alias("_ap"),
        F.count("*").alias("_n"),
        *(F.count_if(F.col("hit") & (F.col("rank") <= k)).alias(f"_h{k}") for k in ks),
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.lit(10), F.col("n_gt")).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + F.lit(1)))
    some = F.col("n_gt") > 0
    return made.select(
        by,
        "n_gt",
        F.when(some, F.col("mrr")).otherwise(0.0).alias("mrr"),
        F.when(some, F.col("_dcg") / ideal).otherwise(0.0).alias("ndcg_10"),
        F.when(some, F.col("_ap") / F.col("n_gt")).otherwise(0.0).alias("map"),
        *(F.when(some, F.col(f"_h{k}") / F.least(F.lit(k), F.col("_n"))).otherwise(0.0).alias(f"precision_{k}") for k in ks),
        *(F.when(some, F.col(f"_h{k}") / F.col("n_gt")).otherwise(0.0).alias(f"recall_{k}") for k in ks),
    )


def rank_of(scores: DataFrame, by: str = "query_id", id_col: str = "item_id", score_col: str = "score", relevant_col: str = "relevant") -> DataFrame:
    """Rank of each query's best relevant item: 1 + items with a better score + items with
    the same score and a smaller id. Queries without a relevant item get n + 1."""
    best = scores.groupBy(by).agg(F.max(F.when(F.col(relevant_col), F.struct(F.col(score_col).alias("s"), (-F.col(id_col)).alias("i")))).alias("_b"), F.count("*").alias("_n"))
    ahead = (F.col(score_col) > F.col("_b.s")) | ((F.col(score_col) == F.col("_b.s")) & (F.col(id_col) < -F.col("_b.i")))
    counted = scores.join(best, by).groupBy(by).agg(F.count_if(ahead).alias("_ahead"), F.first("_b").alias("_b"), F.first("_n").alias("_n"))
    return counted.select(by, F.when(F.col("_b").isNull(), F.col("_n") + 1).otherwise(F.col("_ahead") + 1).alias("rank"))


def from_ranks(ranks: DataFrame, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """Corpus metrics of one rank per query: n, R@k in percent, mrr, mean and median rank."""
    return ranks.agg(*_of_ranks(ks))


def _of_ranks(ks: tuple[int, ...]) -> list[Column]:
    return [
        F.count("rank").alias("n"),
        *(F.round(F.avg((F.col("rank") <= k).cast("double")) * 100, 6).alias(f"r_{k}") for k in ks),
        F.round(F.avg(1 / F.col("rank")), 6).alias("mrr"),
        F.round(F.avg("rank"), 6).alias("mean_rank"),
        F.round(F.median("rank"), 6).alias("median_rank"),
    ]


def corpus_metrics(scores: DataFrame, ks: tuple[int, ...] = (1, 5, 10), by: str = "query_id", id_col: str = "item_id") -> DataFrame:
    """Metrics over whole rankings of (query, item, score, relevant): R@k in percent, mrr,
    mean and median rank, ndcg@10 and map; queries without a relevant item don't count."""
    order = Window.partitionBy(by).orderBy(F.desc("score"), id_col)
    hits = scores.withColumns({"rank": F.row_number().over(order), "hit": F.col("relevant"), "n_gt": F.sum(F.col("relevant").cast("long")).over(Window.partitionBy(by))})
    each = ranked_metrics(hits.where("n_gt > 0"), ks, by).join(hits.where("hit").groupBy(by).agg(F.min("rank").alias("rank")), by)
    return each.agg(
        F.count("*").alias("n"),
        *(F.round(F.avg((F.col("rank") <= k).cast("double")) * 100, 6).alias(f"r_{k}") for k in ks),
        F.round(F.avg(1 / F.col("rank")), 6).alias("mrr"),
        F.round(F.avg("rank"), 6).alias("mean_rank"),
        F.round(F.median("rank"), 6).alias("median_rank"),
        F.round(F.avg("ndcg_10"), 6).alias("ndcg_10"),
        F.round(F.avg("map"), 6).alias("map"),
    )


def from_rankings(ranked: DataFrame, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """Corpus metrics of what ``blocks.rankings`` tells of each query."""
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.lit(10), F.col("n_gt")).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + F.lit(1)))
    each = ranked.select("rank", (F.col("dcg") / ideal).alias("ndcg_10"), (F.col("ap") / F.col("n_gt")).alias("map"))
    means = [F.round(F.avg(c), 6).alias(c) for c in ("ndcg_10", "map")]
    return each.agg(*_of_ranks(ks), *means)


def paired_bootstrap(pairs: DataFrame, a: str, b: str, by: list[str] | None = None, unit: str | None = None, resamples: int = 2000, level: float = 0.95, seed: int = 0) -> DataFrame:
    """Mean difference a - b with a bootstrap interval and Cohen's d, per group. ``unit``
    resamples means of units (videos) instead of rows. Resampling is Poisson: blocks of
    rows draw their weights for all resamples, tasks add these up, and only sums meet, so that
    a group of any size is never gathered."""
    by = by or []
    rows = pairs.select(*by, *([unit] if unit else []), (F.col(a) - F.col(b)).cast("double").alias("_d")).where("_d is not null")
    if unit:
        rows = rows.groupBy(*by, unit).agg(F.avg("_d").alias("_d"))
    rows = rows.withColumn("_seed", F.xxhash64(F.lit(seed), *[F.col(c) for c in rows.columns], F.monotonically_increasing_id()))
    keys = F.to_json(F.struct(*by)) if by else F.lit("")
    keyed = rows.select(keys.alias("_key"), "_d", "_seed")

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for key, own in batch.groupby("_key"):
                total = sums.setdefault(key, np.zeros((2, resamples)))
                d, seeds = own["_d"].to_numpy(float), own["_seed"].to_numpy(np.int64)
                for lo in range(0, len(d), 1024):
                    rng = np.random.default_rng(np.frombuffer(seeds[lo : lo + 1024].tobytes(), np.uint32))
                    w = rng.poisson(1.0, (len(d[lo : lo + 1024]), resamples))
                    total[0] += w.sum(0)
                    total[1] += d[lo : lo + 1024] @ w
        for key, total in sums.items():
            yield pd.DataFrame({"_key": key, "r": np.arange(resamples), "w": total[0], "x": total[1]})

    drawn = keyed.mapInPandas(weigh, "_key string, r int, w double, x double").groupBy("_key", "r").agg((F.sum("x") / F.sum("w")).alias("m"))
    ends = drawn.groupBy("_key").agg(F.percentile("m", F.lit((1 - level) / 2)).alias("ci_lo"), F.percentile("m", F.lit((1 + level) / 2)).alias("ci_hi"))
    facts = keyed.groupBy("_key").agg(F.count("*").alias("n"), F.avg("_d").alias("mean_diff"), F.coalesce(F.stddev_samp("_d"), F.lit(0.0)).alias("_s"))
    out = facts.join(ends, "_key", "left").withColumn("cohens_d", F.when(F.col("_s") > 0, F.col("mean_diff") / F.col("_s")).otherwise(0.0))
    if by:
        types = ", ".join(f"`{c}` {pairs.schema[c].dataType.simpleString()}" for c in by)
        out = out.withColumn("_k", F.from_json("_key", types)).select("_k.*", "n", "mean_diff", "ci_lo", "ci_hi", "cohens_d")
    return out.drop("_key", "_s")


def confusion(rows: DataFrame, classes: list[str], found: str = "{}_found", truth: str = "{}_true", by: list[str] | None = None) -> DataFrame:
    """Per class, from counts found and true: tp, fp, fn, tn (any against none), the mean
    absolute error, precision and recall (null without a denominator)."""
    long = rows.select(*(by or []), F.explode(F.array(*(F.struct(F.lit(c).alias("class"), F.col(found.format(c)).cast("double").alias("f"), F.col(truth.format(c)).cast("double").alias("t")) for c in classes))).alias("e")).select(*(by or []), "e.*")
    f, t = F.col("f") > 0, F.col("t") > 0
    made = long.groupBy(*(by or []), "class").agg(F.count_if(f & t).alias("tp"), F.count_if(f & ~t).alias("fp"), F.count_if(~f & t).alias("fn"), F.count_if(~f & ~t).alias("tn"), F.avg(F.abs(F.col("f") - F.col("t"))).alias("mae"))
    share = lambda a, b: F.when(F.col(a) + F.col(b) > 0, F.col(a) / (F.col(a) + F.col(b)))
    return made.withColumns({"precision": share("tp", "fp"), "recall": share("tp", "fn")})


def latency(rows: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """n, mean, population deviation and interpolated p50 and p95."""
    return rows.groupBy(*(by or [])).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.percentile(value, F.lit(0.5)).alias("p50"), F.percentile(value, F.lit(0.95)).alias("p95"))


def thresholds(rows: DataFrame, value: str, levels: tuple[float, ...] = (0.5, 0.1, 0.01, 0.001), above: bool = False) -> DataFrame:
    """For each level the value below (above) which about this share of rows lies, and the
    share that really does; null without values."""
    some = rows.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("v"))
    n, spark = some.count(), rows.sparkSession
    every = spark.createDataFrame([(i, p, n) for i, p in enumerate(levels)], "i int, level double, n long")
    if not n:
        none = F.lit(None).cast("double")
        return every.select("level", none.alias("threshold"), none.alias("selectivity"), "n")
    at = [(i, (1 - p if above else p) * (n - 1)) for i, p in enumerate(levels)]
    need = spark.createDataFrame([(i, x, math.floor(x), x - math.floor(x)) for i, x in at] + [(i, x, math.ceil(x), 0.0) for i, x in at], "i int, x double, position long, part double")
    # a value for each of a handful of ranks; ranges of values are numbered apart
    ends = positions(some, "v").join(F.broadcast(need), "position").groupBy("i").agg(F.min_by("v", "position").alias("_a"), F.max_by("v", "position").alias("_b"), F.max("part").alias("_p"))
    cuts = every.join(ends, "i", "left").select("level", "n", (F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_p")).alias("threshold"))
    # one row per level meets every row: a broadcast of a handful
    side = F.col(value) > F.col("threshold") if above else F.col(value) < F.col("threshold")
    met = rows.select(value).join(F.broadcast(cuts)).groupBy("level", "threshold", "n").agg((F.count_if(side) / F.count(value)).alias("selectivity"))
    return met.select("level", "threshold", "selectivity", "n")


def histogram(rows: DataFrame, value: str, bins: int, low: float, high: float) -> DataFrame:
    """Counts in bins of equal width; values outside count in the first or last bin."""
    at = F.floor((F.col(value) - low) / ((high - low) / bins)).cast("int")
    return rows.where(F.col(value).isNotNull()).groupBy(F.greatest(F.lit(0), F.least(F.lit(bins - 1), at)).alias("bin")).agg(F.count("*").alias("n"))


def outcome(n: Column, least: int, metric: Column, baseline: Column) -> Column:
    """What a run's number of queries and its change against a baseline allow to say."""
    return F.when(n < least, "too_few_queries").when(metric >= 0.99, "saturated").when(F.abs(metric - baseline) > 0.1, "check_baseline").otherwise("ok")
