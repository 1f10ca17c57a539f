"""Filters, joins, facets, counts and identifiers over the relational tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import metadata, metrics, predicates
from .common import collect, r6, samples, table
from .common import SAMPLES as _EV

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
FIELDS = {"p_brand": "keyword", "p_type": "keyword", "p_size": "integer", "p_retailprice": "float", "heading": "circular", "l_quantity": "float", "o_orderstatus": "keyword"}


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").withColumn("heading", F.col("p_partkey") * 37 % 360)


@collect(QUERIES, ORACLES, "SELECT p_partkey, p_brand, p_size FROM part WHERE p_brand = 'Brand#5' AND p_type = 'PROMO'")
def filter_equals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predicates.apply(_parts(spark, sf_dir), FIELDS, {"p_brand": "Brand#5"}, {"p_type": "PROMO", "p_size": None}).select("p_partkey", "p_brand", "p_size")


@collect(QUERIES, ORACLES, "SELECT p_partkey, p_size FROM part WHERE p_size BETWEEN 10 AND 20")
def filter_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predicates.apply(_parts(spark, sf_dir), FIELDS, {"p_size": {"min": 10, "max": 20}}).select("p_partkey", "p_size")


@collect(QUERIES, ORACLES, "SELECT p_partkey, p_partkey * 37 % 360 AS heading FROM part WHERE p_partkey * 37 % 360 >= 300 OR p_partkey * 37 % 360 <= 30")
def filter_circular_wrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predicates.apply(_parts(spark, sf_dir), FIELDS, {"heading": (300, 30)}).select("p_partkey", "heading")


@collect(QUERIES, ORACLES, "SELECT p_partkey, p_retailprice FROM part WHERE p_retailprice >= 950")
def filter_halfopen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predicates.apply(_parts(spark, sf_dir), FIELDS, {"p_retailprice": {"min": 950}}).select("p_partkey", "p_retailprice")


@collect(QUERIES, ORACLES, "SELECT wanted, (SELECT coalesce(bool_and(p_size BETWEEN 10 AND wanted), true) FROM part WHERE p_size BETWEEN 10 AND 20) AS filter_correct FROM (SELECT unnest([15, 20, 25]) AS wanted)")
def filter_validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of one filter, judged by three."""
    rows = predicates.apply(_parts(spark, sf_dir), FIELDS, {"p_size": (10, 20)})
    judged = [predicates.correct(rows, predicates.predicates(FIELDS, {"p_size": (10, most)})).withColumn("wanted", F.lit(most)) for most in (15, 20, 25)]
    return judged[0].unionByName(judged[1]).unionByName(judged[2])


@collect(QUERIES, ORACLES, "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey LEFT JOIN part ON l_partkey = p_partkey WHERE o_orderstatus = 'F' AND l_quantity BETWEEN 10 AND 12 AND p_size >= 40")
def candidates_run_scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"), "left")
    return predicates.apply(rows, FIELDS, {"o_orderstatus": "F", "l_quantity": (10, 12), "p_size": {"min": 40}}).select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


@collect(QUERIES, ORACLES, "SELECT vec_id, label, p_name, p_size FROM embeddings LEFT JOIN part ON vec_id = p_partkey AND p_size >= 20 WHERE label <= 4")
def outer_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without metadata stay, with nulls."""
    part = table(spark, sf_dir, "part").where("p_size >= 20")
    rows = table(spark, sf_dir, "embeddings").join(part, F.col("vec_id") == F.col("p_partkey"), "left")
    return rows.where("label <= 4").select("vec_id", "label", "p_name", "p_size")


_ACTIVE = "a AS (SELECT o_custkey, max(o_orderkey) AS active FROM orders GROUP BY 1)"


@collect(QUERIES, ORACLES, f"WITH {_ACTIVE} SELECT c_custkey, active, o_orderstatus FROM customer JOIN a ON c_custkey = o_custkey JOIN orders ON o_orderkey = active WHERE o_orderstatus = 'F'")
def active_pointer_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    pointer = orders.groupBy("o_custkey").agg(F.max("o_orderkey").alias("active"))
    return metadata.through_pointer(table(spark, sf_dir, "customer"), pointer, orders, "c_custkey", "o_custkey", "active", "o_orderkey", F.col("o_orderstatus") == "F").select("c_custkey", "active", "o_orderstatus")


@collect(QUERIES, ORACLES, f"WITH {_ACTIVE} SELECT o.o_orderkey, o.o_custkey, (a.active = o.o_orderkey) AS is_active FROM orders o LEFT JOIN a ON a.o_custkey = o.o_custkey AND a.active % 2 = 0")
def runs_with_active_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    pointer = orders.groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_orderkey").alias("active")).where("active % 2 = 0")
    return orders.join(pointer, orders.o_custkey == pointer.k, "left").select("o_orderkey", "o_custkey", (F.col("active") == F.col("o_orderkey")).alias("is_active"))


@collect(QUERIES, ORACLES, "SELECT n_nationkey, count(DISTINCT c_custkey) AS customers, count(DISTINCT o_orderkey) AS orders, count(l_orderkey) AS items, round(coalesce(sum(l_quantity), 0), 6) AS quantity FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY n_nationkey")
def dataset_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each level is summed up before it meets the next: no row is counted twice, and no
    distinct count is needed."""
    items = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("q"))
    orders = table(spark, sf_dir, "orders").join(items, F.col("o_orderkey") == F.col("l_orderkey"), "left").groupBy("o_custkey").agg(F.count("*").alias("o"), F.sum("n").alias("n"), F.sum("q").alias("q"))
    own = table(spark, sf_dir, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("c_nationkey").agg(F.count("*").alias("c"), F.sum("o").alias("o"), F.sum("n").alias("n"), F.sum("q").alias("q"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return table(spark, sf_dir, "nation").join(own, F.col("n_nationkey") == F.col("c_nationkey"), "left").select("n_nationkey", zero("c").alias("customers"), zero("o").alias("orders"), zero("n").alias("items"), r6(F.coalesce("q", F.lit(0.0))).alias("quantity"))


@collect(QUERIES, ORACLES, "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def semi_delete_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'")
    return table(spark, sf_dir, "orders").join(gone, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey")


@collect(QUERIES, ORACLES, "SELECT c_custkey AS id, 'ordered' AS origin FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) UNION ALL SELECT c_custkey, 'fallback' FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def anti_fallback_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    return metadata.with_fallback(customers, orders, F.col("c_custkey") == F.col("o_custkey")).select(F.col("c_custkey").alias("id"), "origin")


@collect(QUERIES, ORACLES, "SELECT count(*) AS n, count(DISTINCT o_custkey) AS customers, count(*) FILTER (WHERE o_orderstatus = 'F') AS finished, count(*) FILTER (WHERE o_orderpriority NOT LIKE '1-%') AS not_urgent FROM orders")
def groundtruth_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").agg(F.count("*").alias("n"), F.countDistinct("o_custkey").alias("customers"), F.count_if(F.col("o_orderstatus") == "F").alias("finished"), F.count_if(~F.col("o_orderpriority").like("1-%")).alias("not_urgent"))


@collect(QUERIES, ORACLES, "SELECT 'p_brand' AS field, p_brand AS value, count(*) AS n FROM part WHERE p_brand IS NOT NULL GROUP BY ALL UNION ALL SELECT 'p_type', p_type, count(*) FROM part WHERE p_type IS NOT NULL GROUP BY ALL")
def facets_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metadata.facet_values(table(spark, sf_dir, "part"), ["p_brand", "p_type"])


@collect(QUERIES, ORACLES, "SELECT 'p_size' AS field, CAST(min(p_size) AS DOUBLE) AS low, CAST(max(p_size) AS DOUBLE) AS high FROM part UNION ALL SELECT 'p_retailprice', min(p_retailprice), max(p_retailprice) FROM part")
def facets_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metadata.facet_bounds(table(spark, sf_dir, "part"), ["p_size", "p_retailprice"])


@collect(QUERIES, ORACLES, "SELECT count(*) AS duplicates FROM (SELECT l_orderkey, l_partkey FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1)")
def duplicates_having(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metadata.duplicates(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_partkey"])


@collect(QUERIES, ORACLES, "WITH c AS (SELECT count(*) AS n, quantile_cont(l_extendedprice, [0.5, 0.1, 0.01, 0.001]) AS q FROM lineitem), t AS (SELECT n, unnest([0.5, 0.1, 0.01, 0.001]) AS level, unnest(q) AS threshold FROM c) SELECT CAST(level AS DOUBLE) AS level, round(threshold, 6) AS threshold, round((SELECT count(*) FROM lineitem WHERE l_extendedprice < threshold) / n, 6) + 0.0 AS selectivity, n FROM t")
def quantile_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.thresholds(table(spark, sf_dir, "lineitem"), "l_extendedprice").select("level", r6("threshold").alias("threshold"), r6("selectivity").alias("selectivity"), "n")


@collect(QUERIES, ORACLES, "SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY event_type")
def latency_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.latency(table(spark, sf_dir, "events"), "value", ["event_type"]).select("event_type", "n", *(r6(c).alias(c) for c in ("mean", "std", "p50", "p95")))


@collect(QUERIES, ORACLES, "SELECT o_orderpriority, o_orderstatus, count(*) AS n, round(avg(o_totalprice), 4) AS mean FROM orders GROUP BY ROLLUP (o_orderpriority, o_orderstatus)")
def metrics_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").rollup("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean"))


@collect(QUERIES, ORACLES, "WITH e AS (SELECT 'a' AS class, p_size % 3 AS f, p_partkey % 4 AS t FROM part UNION ALL SELECT 'b', p_size % 2, p_partkey % 2 FROM part) SELECT class, count(*) FILTER (WHERE f > 0 AND t > 0) AS tp, count(*) FILTER (WHERE f > 0 AND t = 0) AS fp, count(*) FILTER (WHERE f = 0 AND t > 0) AS fn, count(*) FILTER (WHERE f = 0 AND t = 0) AS tn, round(avg(abs(f - t)), 6) AS mae, round(count(*) FILTER (WHERE f > 0 AND t > 0) / count(*) FILTER (WHERE f > 0), 6) AS precision, round(count(*) FILTER (WHERE f > 0 AND t > 0) / count(*) FILTER (WHERE t > 0), 6) AS recall FROM e GROUP BY class")
def confusion_mae(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select((F.col("p_size") % 3).alias("a_found"), (F.col("p_partkey") % 4).alias("a_true"), (F.col("p_size") % 2).alias("b_found"), (F.col("p_partkey") % 2).alias("b_true"))
    return metrics.confusion(rows, ["a", "b"]).select("class", "tp", "fp", "fn", "tn", r6("mae").alias("mae"), r6("precision").alias("precision"), r6("recall").alias("recall"))


@collect(QUERIES, ORACLES, "SELECT greatest(0, least(19, CAST(floor((value - 0.0) / (100.0 / 20)) AS INTEGER))) AS bin, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY 1")
def histogram_clamped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.histogram(table(spark, sf_dir, "events"), "value", 20, 0.0, 100.0)


@collect(QUERIES, ORACLES, "WITH c AS (SELECT p_partkey, p_size % 5 AS n FROM part) SELECT n AS count_value, p_partkey AS segment, 'positive' AS side FROM c WHERE n > 0 UNION ALL SELECT v, p_partkey, 'negative' FROM c, (SELECT DISTINCT n AS v FROM c WHERE n > 0) WHERE n = 0")
def hard_negative_count_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metadata.count_contrasts(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("segment"), (F.col("p_size") % 5).alias("n")), "segment", "n")


@collect(QUERIES, ORACLES, "WITH c AS (SELECT p_partkey, p_size % 5 AS a, p_partkey % 3 AS b FROM part) SELECT p_partkey AS segment, CASE WHEN a > 0 THEN 'positive' ELSE 'negative' END AS side FROM c WHERE b > 0")
def hard_negative_class_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("segment"), (F.col("p_size") % 5).alias("a"), (F.col("p_partkey") % 3).alias("b"))
    return metadata.class_contrasts(rows, "segment", "a", "b")


@collect(QUERIES, ORACLES, f"WITH {_EV}, e AS (SELECT CAST(floor(time_s / 86400) AS BIGINT) AS chunk, event_id, CAST(CAST(floor(time_s * 1000) AS BIGINT) AS VARCHAR) AS ms FROM ev) SELECT chunk, count(*) AS n, sha256(string_agg(event_id || ':' || ms || ';', '' ORDER BY event_id)) AS hash FROM e GROUP BY chunk")
def chunk_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = samples(spark, sf_dir).select(F.floor(F.col("time_s") / 86400).cast("long").alias("chunk"), "event_id", F.floor(F.col("time_s") * 1000).cast("long").cast("string").alias("ms"))
    return metadata.content_hash(rows, ["chunk"], "event_id", F.concat(F.col("event_id").cast("string"), F.lit(":"), F.col("ms"), F.lit(";")))


@collect(QUERIES, ORACLES, "SELECT l_orderkey, l_linenumber, concat_ws(':', 'd', l_partkey, CAST(l_linenumber * 1500 AS VARCHAR), CAST(l_linenumber * 1500 + 8000 AS VARCHAR)) AS segment_id FROM lineitem")
def segment_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.col("l_linenumber") * 1.5
    made = scalars.segment_id(F.lit("d"), F.col("l_partkey").cast("string"), start, start + 8)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", made.alias("segment_id"))


@collect(QUERIES, ORACLES, "WITH h AS (SELECT p_partkey, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || CAST('run:' || p_partkey AS BLOB)) AS d FROM part) SELECT p_partkey, d[1:8] || '-' || d[9:12] || '-5' || d[14:16] || '-' || substr('89ab89ab89ab89ab', strpos('0123456789abcdef', d[17:17]), 1) || d[18:20] || '-' || d[21:32] AS point_id FROM h")
def uuid5_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", scalars.uuid5(uuid.NAMESPACE_URL, F.concat_ws(":", F.lit("run"), F.col("p_partkey").cast("string"))).alias("point_id"))


@collect(QUERIES, ORACLES, "SELECT o_orderkey, o_orderstatus, CASE WHEN p > 2 THEN 'late' ELSE 'ok' END AS state FROM (SELECT *, CAST(left(o_orderpriority, 1) AS INTEGER) AS p FROM orders) QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = metadata.latest(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"])
    return rows.select("o_orderkey", "o_orderstatus", F.when(F.substring("o_orderpriority", 1, 1).cast("int") > 2, "late").otherwise("ok").alias("state"))


@collect(QUERIES, ORACLES, "SELECT CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS month, c_mktsegment, round(sum(o_totalprice), 2) AS total, rank() OVER (PARTITION BY CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) ORDER BY sum(o_totalprice) DESC, c_mktsegment) AS place FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2")
def segment_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    month = F.date_trunc("month", "o_orderdate").cast("timestamp_ntz")
    sums = rows.groupBy(month.alias("month"), "c_mktsegment").agg(F.sum("o_totalprice").alias("t"))
    place = F.rank().over(Window.partitionBy("month").orderBy(F.desc("t"), "c_mktsegment"))
    return sums.select("month", "c_mktsegment", F.round("t", 2).alias("total"), place.cast("long").alias("place"))
