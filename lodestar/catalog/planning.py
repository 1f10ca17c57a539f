"""Query planning over ``conversations`` (texts), ``part`` and ``orders``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import planning, runs
from .common import collect, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

_WORDS = ("red", "blue", "green", "small", "large", "widget", "gadget", "bolt", "ring", "gear")
_RULES = [(w, "colour" if w in ("red", "blue", "green") else "size" if w in ("small", "large") else "thing", f"{w}_count", 1 + len(w) % 3, w) for w in _WORDS]
_VALUES = ", ".join(f"('{c}', '{f}', '{x}', {s}, '{w}')" for c, f, x, s, w in _RULES)
_HIT = f"rules AS (SELECT * FROM (VALUES {_VALUES}) t(concept, family, field, specificity, word)), words AS (SELECT DISTINCT p_partkey AS query_id, unnest(regexp_extract_all(lower(p_name || ' with at least ' || p_size || ' ' || p_name), '[\\p{{L}}\\p{{N}}_]+')) AS word FROM part), hit AS (SELECT DISTINCT query_id, concept, family, field, specificity FROM words JOIN rules USING (word))"


def _queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("query_id"), F.concat_ws(" ", "p_name", F.lit("with at least"), F.col("p_size").cast("string"), "p_name").alias("text"))


def _rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_RULES, "concept string, family string, field string, specificity int, word string")


@collect(QUERIES, ORACLES, f"WITH {_HIT}, first AS (SELECT p_partkey AS query_id, p_size AS least, split_part(lower(p_name), ' ', 1) AS tail FROM part) SELECT h.query_id, h.concept, h.field, coalesce(f.least, 1) AS least FROM hit h LEFT JOIN first f ON f.query_id = h.query_id AND contains(f.tail, h.concept)")
def rules_parse_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.matched(_queries(spark, sf_dir), _rules(spark)).select("query_id", "concept", "field", "least")


@collect(QUERIES, ORACLES, f"WITH {_HIT} SELECT query_id, family, concept FROM hit QUALIFY rank() OVER (PARTITION BY query_id, family ORDER BY specificity DESC) = 1")
def ontology_specificity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.most_specific(planning.matched(_queries(spark, sf_dir), _rules(spark))).select("query_id", "family", "concept")


@collect(QUERIES, ORACLES, f"WITH {_HIT} SELECT query_id, field, field IN ('red_count', 'ring_count', 'gear_count') AS covered FROM hit")
def coverage_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    registry = spark.createDataFrame([("red_count",), ("ring_count",), ("gear_count",)], "field string")
    return planning.covered(planning.matched(_queries(spark, sf_dir), _rules(spark)), registry).select("query_id", "field", "covered")


@collect(QUERIES, ORACLES, "SELECT l_orderkey AS query_id, l_returnflag AS field, max(l_quantity) AS low, min(l_quantity + 10) AS high FROM lineitem GROUP BY 1, 2")
def tightest_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.col("l_returnflag").alias("field"), F.col("l_quantity").alias("low"), (F.col("l_quantity") + 10).alias("high"))
    return planning.tightest(rows)


def _constraints() -> list[planning.Constraint]:
    return [
        planning.Constraint("brand", F.col("p_brand") == "Brand#5", "explicit_request", hard=True),
        planning.Constraint("price", F.col("p_retailprice") >= 950, "trusted_telemetry", hard=True),
        planning.Constraint("size", F.col("p_size") >= 48, "detector_derived", 0.5),
        planning.Constraint("type", F.col("p_type") == "PROMO", "rules_parser", 0.9),
    ]


@collect(QUERIES, ORACLES, "WITH c AS (SELECT count(*) FILTER (WHERE b AND p AND s AND t) AS n1, count(*) FILTER (WHERE b AND p AND t) AS n2, count(*) FILTER (WHERE b AND p) AS n4, count(*) FILTER (WHERE b) AS n5 FROM (SELECT p_brand = 'Brand#5' AS b, p_retailprice >= 950 AS p, p_size >= 48 AS s, p_type = 'PROMO' AS t FROM part)), l AS (SELECT unnest([1, 2, 3, 4, 5]) AS pass, unnest([4, 3, 3, 2, 1]) AS kept, unnest([n1, n2, n2, n4, n5]) AS matching FROM c), e AS (SELECT *, matching >= 20 AS enough FROM l) SELECT CAST(pass AS INTEGER) AS pass, CAST(kept AS INTEGER) AS kept, matching, enough, pass = coalesce((SELECT min(pass) FROM e WHERE enough), 5) AS selected FROM e")
def relaxation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.relaxation_counts(table(spark, sf_dir, "part"), _constraints(), planning.Relaxation(20, semantic_only=True))


@collect(QUERIES, ORACLES, "WITH r AS (SELECT o_custkey % 50 AS dataset, o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'failed' ELSE 'ingesting' END AS status, o_orderdate AS started FROM orders), a AS (SELECT *, o_orderkey = max(o_orderkey) OVER (PARTITION BY dataset) AS is_active FROM r), k AS (SELECT *, row_number() OVER (PARTITION BY dataset, status = 'completed', is_active ORDER BY started DESC, CAST(o_orderkey AS VARCHAR)) AS n FROM a) SELECT o_orderkey FROM k WHERE NOT is_active AND NOT (status = 'completed' AND n <= 2) AND status <> 'ingesting' AND started <= TIMESTAMP '1998-01-01' - INTERVAL 24 HOUR")
def gc_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    state = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "failed").otherwise("ingesting")
    ledger = orders.select((F.col("o_custkey") % 50).alias("dataset"), F.col("o_orderkey").cast("string").alias("run_id"), state.alias("status"), F.col("o_orderdate").alias("started"), F.lit(None).cast("timestamp_ntz").alias("finished"), "o_orderkey")
    newest = ledger.groupBy("dataset").agg(F.max("o_orderkey").alias("_newest"))
    marked = ledger.join(newest, "dataset").withColumn("is_active", F.col("o_orderkey") == F.col("_newest"))
    return runs.garbage(marked, F.expr("timestamp_ntz'1998-01-01 00:00:00'"), 2, 24.0).select("o_orderkey")


_TEXT = "CASE p_size % 6 WHEN 0 THEN 'en az ' || p_size || ' ARABA' WHEN 1 THEN 'At least ' || p_size || ' people at night' WHEN 2 THEN 'a Crowded BUS' WHEN 3 THEN 'trucks by daytime' WHEN 4 THEN 'business as always' ELSE 'en az ' || p_size || ' kişi, gece' END"
_MEANT = " UNION ALL ".join(f"SELECT query_id, {i} AS spot, '{f}' AS field, '{o}' AS operator, {v} AS value FROM t WHERE regexp_matches(text, '{p}', 'i')" for i, (p, f, o, v) in enumerate(planning.SAID))
_COUNTED = " UNION ALL ".join(f"SELECT query_id, {10 + i}, '{f}', '>=', CAST(regexp_extract(text, '[0-9]+') AS BIGINT) FROM t WHERE regexp_matches(text, '{p}', 'i')" for i, (p, f) in enumerate(planning.COUNTED))


@collect(QUERIES, ORACLES, f"WITH t AS (SELECT p_partkey AS query_id, {_TEXT} AS text FROM part), m AS ({_MEANT} UNION ALL {_COUNTED}) SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY spot) - 1 AS place, field, operator, value FROM m")
def conditions_said(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditions that texts mean, by patterns of words and numbers."""
    texts = table(spark, sf_dir, "part").selectExpr("p_partkey as query_id", f"{_TEXT} as text")
    return planning.said(texts)
