"""Retrieval quality over searches of ``embeddings`` and spans of ``events``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import blocks, metadata, metrics
from .common import collect, r6, samples, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _asked(rows: DataFrame) -> DataFrame:
    """Stored vectors as queries, those whose id is divisible by 20; items of the same
    label are relevant."""
    return rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"), F.col("label").alias("own"))


_SCORES = "s AS (SELECT a.vec_id AS query_id, b.vec_id AS item_id, round(list_cosine_similarity(b.embedding::DOUBLE[], a.embedding::DOUBLE[]), 9) AS score, a.label = b.label AS relevant FROM embeddings a JOIN embeddings b ON a.vec_id % 20 = 0 AND b.vec_id <> a.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM s), h AS (SELECT *, sum(relevant::INT) OVER (PARTITION BY query_id ORDER BY rank) AS hits, sum(relevant::INT) OVER (PARTITION BY query_id) AS n_gt FROM r)"
_EACH = "e AS (SELECT query_id, min(rank) FILTER (WHERE relevant) AS rank, sum(CASE WHEN relevant AND rank <= 10 THEN 1 / log2(rank + 1) ELSE 0 END) / list_sum(list_transform(range(1, least(10, max(n_gt))::BIGINT + 1), lambda i: 1 / log2(i + 1))) AS ndcg, sum(CASE WHEN relevant THEN hits / rank ELSE 0 END) / max(n_gt) AS ap FROM h WHERE n_gt > 0 GROUP BY query_id)"
_OUT = "count(*) AS n, round(avg((rank <= 1)::INT) * 100, 6) AS r_1, round(avg((rank <= 5)::INT) * 100, 6) AS r_5, round(avg((rank <= 10)::INT) * 100, 6) AS r_10, round(avg(1 / rank), 6) AS mrr, round(avg(rank), 6) AS mean_rank, round(median(rank), 6) AS median_rank"


@collect(QUERIES, ORACLES, f"WITH {_SCORES}, {_EACH} SELECT {_OUT}, round(avg(ndcg), 6) AS ndcg_10, round(avg(ap), 6) AS map FROM e")
def eval_corpus_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return metrics.from_rankings(blocks.rankings(rows, _asked(rows), "label"))


@collect(QUERIES, ORACLES, f"WITH {_SCORES}, {_EACH} SELECT {_OUT} FROM e")
def eval_from_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    # queries without a relevant item don't count
    return metrics.from_ranks(blocks.relevant_ranks(rows, _asked(rows), "label", 9).where("relevant"))


@collect(QUERIES, ORACLES)
def eval_greedy_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views of a user, best first, against clicks of the same user as true spans."""
    rows = samples(spark, sf_dir)
    span = [F.col("user_id").alias("query_id"), F.floor(F.col("time_s") / 86400).cast("long").alias("video"), (F.col("time_s") % 86400).alias("t_start"), (F.col("time_s") % 86400 + 7200).alias("t_end")]
    order = Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id")
    found = rows.where("event_type = 'view'").withColumn("rank", F.row_number().over(order)).select(*span, "rank")
    hits = metrics.greedy_hits(found, rows.where("event_type = 'click'").select(*span), 0.3)
    made = metrics.ranked_metrics(hits)
    return made.select("query_id", "n_gt", *(r6(c).alias(c) for c in made.columns[2:]))


@collect(QUERIES, ORACLES)
def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_partkey").alias("unit"), (F.col("l_discount") * 100).alias("a"), (F.col("l_tax") * 100).alias("b"))
    return metrics.paired_bootstrap(rows, "a", "b", ["l_returnflag"], unit="unit", resamples=500)


@collect(QUERIES, ORACLES, "WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), t AS (SELECT count(*) FILTER (WHERE vec_id % 10 = 1) AS short, count(*) FILTER (WHERE vec_id % 10 = 2) AS nan, count(*) FILTER (WHERE vec_id % 10 = 3) AS twice, count(*) AS n, count(*) FILTER (WHERE vec_id % 10 = 0 AND abs(sqrt(list_dot_product(e, e)) - 1) > 0.001) + count(*) FILTER (WHERE vec_id % 10 > 2 AND abs(sqrt(list_dot_product(e, e)) - 1) > 0.001) + count(*) FILTER (WHERE vec_id % 10 = 3 AND abs(sqrt(list_dot_product(e, e)) - 1) > 0.001) + count(*) FILTER (WHERE vec_id % 10 = 1 AND abs(sqrt(list_dot_product(e[1:10], e[1:10])) - 1) > 0.001) AS unit FROM v) SELECT n + twice AS n, short AS length, nan AS not_finite, unit + nan AS not_unit, twice AS duplicates FROM t")
def vector_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of which some are cut, some hold NaN, and some stand twice."""
    rows, kind = table(spark, sf_dir, "embeddings"), F.col("vec_id") % 10
    bent = F.when(kind == 1, F.slice("embedding", 1, 10)).when(kind == 2, F.concat(F.slice("embedding", 1, 63), F.array(F.lit(float("nan")).cast("float")))).otherwise(F.col("embedding"))
    made = rows.withColumn("embedding", bent)
    return metadata.contract(made.union(made.where(kind == 3)), 64)


@collect(QUERIES, ORACLES, "WITH c AS (SELECT (SELECT count(*) FROM orders) AS a, (SELECT count(DISTINCT l_orderkey) FROM lineitem) AS b) SELECT least(a, b) AS least, greatest(a, b) AS most, a = b AS consistent FROM c")
def uneven_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders against the orders that have items."""
    stores = [table(spark, sf_dir, "orders").agg(F.count("*").alias("n")).withColumn("store", F.lit("orders")), table(spark, sf_dir, "lineitem").agg(F.countDistinct("l_orderkey").alias("n")).withColumn("store", F.lit("items"))]
    return metadata.reconciled(stores)


@collect(QUERIES, ORACLES, "SELECT (SELECT count(*) FROM orders) AS least, (SELECT count(*) FROM orders) AS most, true AS consistent")
def count_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, items = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    alone = orders.join(items, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").agg(F.count("*").alias("a"))
    known = orders.join(items, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").agg(F.count("*").alias("b"))
    stores = [orders.agg(F.count("*").alias("n")).withColumn("store", F.lit("orders")), alone.unionByName(known.withColumnRenamed("b", "a")).agg(F.sum("a").alias("n")).withColumn("store", F.lit("parts"))]
    return metadata.reconciled(stores)


@collect(QUERIES, ORACLES, "SELECT o_custkey, CASE WHEN count(DISTINCT o_orderstatus) = 1 THEN min(o_orderstatus) ELSE 'unknown' END AS o_orderstatus FROM orders GROUP BY o_custkey")
def agreed_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metadata.agreed(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderstatus")
