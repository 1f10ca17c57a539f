"""Checks, repairs and writes over the relational tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import checks, intervals, metadata, search
from ..operators import timeline as T
from ..sources import tables
from .common import DURATIONS, SAMPLES, SIZE, STRIDE, WINDOWS, collect, durations, r6, samples, table
from .streams import _folder
from .vectors import _PAIRS, _asked

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


@collect(QUERIES, ORACLES, "SELECT l_orderkey, l_linenumber, round(CASE WHEN max(l_extendedprice) OVER (PARTITION BY l_partkey) > 50000 THEN l_extendedprice / 1000 ELSE l_extendedprice END, 6) AS price FROM lineitem")
def unit_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = checks.unit_repair(table(spark, sf_dir, "lineitem"), "l_partkey", "l_extendedprice", 50000.0, 1000.0)
    return rows.select("l_orderkey", "l_linenumber", r6("l_extendedprice").alias("price"))


@collect(QUERIES, ORACLES, "SELECT p_partkey, p_size, label FROM part LEFT JOIN embeddings ON vec_id = p_partkey")
def validated_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    right = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("p_partkey"), "label")
    return checks.one_to_one(table(spark, sf_dir, "part").select("p_partkey", "p_size"), right, ["p_partkey"])


@collect(QUERIES, ORACLES, "WITH a AS (SELECT l_partkey, l_quantity FROM lineitem WHERE l_linenumber <= 3), b AS (SELECT l_partkey, l_quantity FROM lineitem WHERE l_linenumber > 1) SELECT (SELECT count(*) FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)) AS only_left, (SELECT count(*) FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)) AS only_right")
def row_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    return checks.differences(rows.where("l_linenumber <= 3").select("l_partkey", "l_quantity"), rows.where("l_linenumber > 1").select("l_partkey", "l_quantity"))


@collect(QUERIES, ORACLES, f"WITH {_PAIRS}, t AS (SELECT query_id, vec_id, dist, row_number() OVER (PARTITION BY query_id ORDER BY dist, vec_id) AS rank FROM pairs QUALIFY rank <= 10), f AS (SELECT query_id, vec_id, short, row_number() OVER (PARTITION BY query_id ORDER BY short, vec_id) AS rank FROM pairs QUALIFY rank <= 10) SELECT query_id, count(*) AS n, count(*) FILTER (WHERE t.vec_id = f.vec_id) AS same, round(max(abs(dist - short)), 6) + 0.0 AS largest FROM t FULL JOIN f USING (query_id, rank) GROUP BY query_id")
def ranking_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    asked = _asked(rows)
    short = search.many(rows.withColumn("embedding", F.slice("embedding", 1, 16)), asked.withColumn("query", F.slice("query", 1, 16)), 10)
    return checks.compared(search.many(rows, asked, 10), short, "query_id", "vec_id").withColumn("largest", r6("largest"))


@collect(QUERIES, ORACLES, "SELECT l_partkey, round(quantile_cont(l_quantity, 0.5), 6) AS median, max(l_quantity) AS most, round(quantile_cont(l_quantity, 0.9), 6) AS p90, round(avg((l_quantity >= 25)::INT), 6) AS persistence FROM lineitem GROUP BY l_partkey")
def count_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = checks.count_stats(table(spark, sf_dir, "lineitem"), ["l_partkey"], "l_quantity", 25)
    return made.select("l_partkey", r6("median").alias("median"), "most", r6("p90").alias("p90"), r6("persistence").alias("persistence"))


@collect(QUERIES, ORACLES, "WITH f AS (SELECT l_orderkey, l_quantity, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber, l_quantity) - 1 AS frame FROM lineitem) SELECT l_orderkey, frame, round(sum(l_quantity), 4) AS total FROM f GROUP BY 1, 2")
def frame_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A class is a return flag, a frame the place of an item among its order's items."""
    own = F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_quantity"))), lambda x: x["l_quantity"])
    classes = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_returnflag").agg(own.alias("q"))
    maps = classes.groupBy("l_orderkey").agg(F.map_from_entries(F.collect_list(F.struct("l_returnflag", "q"))).alias("m"))
    return maps.select("l_orderkey", F.posexplode(checks.frame_sums(F.col("m"))).alias("frame", "total")).select("l_orderkey", F.col("frame").cast("long").alias("frame"), F.round("total", 4).alias("total"))


_BASE = f"WITH {SAMPLES}, {DURATIONS}"


@collect(QUERIES, ORACLES, f"{_BASE} SELECT user_id, CAST(ceil(duration / {STRIDE}) AS BIGINT) AS padded, CASE WHEN duration >= {SIZE} THEN CAST(floor((duration - {SIZE}) / {STRIDE}) AS BIGINT) + 1 ELSE 0 END AS whole FROM dur")
def segment_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = F.col("duration")
    return durations(spark, sf_dir).select("user_id", T.window_count(own, SIZE, STRIDE, "pad").alias("padded"), T.window_count(own, SIZE, STRIDE).alias("whole"))


@collect(QUERIES, ORACLES, f"{_BASE}, {WINDOWS} SELECT user_id, round(t_start, 4) AS t_start, i AS nth, round(t_start + (t_end - t_start) * i / 4, 4) AS at_s FROM (SELECT *, unnest(range(0, 4)) AS i FROM w)")
def sample_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.sliding(durations(spark, sf_dir), SIZE, STRIDE)
    made = rows.withColumn("times", T.sample_times(F.col("t_start"), F.col("t_end"), 4))
    made = made.select("user_id", "t_start", F.posexplode("times").alias("nth", "at_s"))
    return made.select("user_id", F.round("t_start", 4).alias("t_start"), F.col("nth").cast("long").alias("nth"), F.round("at_s", 4).alias("at_s"))


@collect(QUERIES, ORACLES, "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 15")
def worst_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.worst(table(spark, sf_dir, "orders"), "o_totalprice", "o_orderkey", 15).select("o_orderkey", "o_totalprice")


@collect(QUERIES, ORACLES, f"WITH {SAMPLES}, fr AS (SELECT user_id, CAST(floor(time_s / 21600) AS BIGINT) AS frame FROM ev GROUP BY ALL HAVING count(*) >= 2), g AS (SELECT *, CASE WHEN frame - lag(frame) OVER (PARTITION BY user_id ORDER BY frame) <= 9 THEN 0 ELSE 1 END AS new FROM fr), i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY frame) AS island FROM g) SELECT user_id, min(frame) / 4.0 AS t_start, (max(frame) + 1) / 4.0 AS t_end FROM i GROUP BY user_id, island")
def presence_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans in which two events at least fall into a frame."""
    frames = samples(spark, sf_dir).groupBy("user_id", F.floor(F.col("time_s") / 21600).cast("long").alias("frame")).count().where("count >= 2")
    return intervals.flagged(frames, "user_id", "frame", 4.0, 2.0, 0.0, cell=1e6).select("user_id", "t_start", "t_end")


@collect(QUERIES, ORACLES, "SELECT p_partkey, CASE WHEN p_size >= 40 THEN -p_size ELSE p_size END AS p_size FROM part UNION ALL SELECT -p_partkey, -p_size FROM part WHERE p_size >= 40")
def upsert_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of known keys replace rows, those of new keys add some."""
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    large = rows.where("p_size >= 40").withColumn("p_size", -F.col("p_size"))
    return metadata.upsert(rows, large.unionByName(large.withColumn("p_partkey", -F.col("p_partkey"))), ["p_partkey"])


@collect(QUERIES, ORACLES, "SELECT p_partkey, CASE WHEN p_size < 25 THEN p_size WHEN p_size >= 40 THEN NULL ELSE p_size * 2 END AS p_size FROM part")
def enriched_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    found = rows.where("p_size >= 25").withColumn("p_size", F.when(F.col("p_size") < 40, F.col("p_size") * 2))
    return metadata.enriched(rows, found, ["p_partkey"], ["p_size"])


@collect(QUERIES, ORACLES, "SELECT p_brand, p_partkey, CASE WHEN p_brand = 'Brand#5' THEN 0 ELSE p_size END AS p_size FROM part WHERE p_brand <> 'Brand#5' OR p_size >= 10")
def partition_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written whole, then one partition again: it replaces itself."""
    folder = f"{_folder(spark)}/parts"
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_brand")
    tables.replace(rows.repartition("p_brand"), folder, ["p_brand"])
    tables.replace(rows.where("p_brand = 'Brand#5' AND p_size >= 10").withColumn("p_size", F.lit(0).cast(rows.schema["p_size"].dataType)), folder, ["p_brand"])
    return spark.read.parquet(folder).select("p_brand", "p_partkey", "p_size")


@collect(QUERIES, ORACLES, "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_totalprice >= 1000 GROUP BY 1")
def sql_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.query(spark, "SELECT o_orderstatus, count(*) AS n FROM {rows} WHERE o_totalprice >= :least GROUP BY 1;", {"rows": table(spark, sf_dir, "orders")}, least=1000)
