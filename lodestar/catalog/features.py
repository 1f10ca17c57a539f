"""Features, profiles, contracts and small expressions over the relational tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import features
from .common import SAMPLES, collect, r6, samples, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


@collect(QUERIES, ORACLES, "SELECT l_orderkey, CAST(trunc(quantile_cont(l_quantity, 0.5)) AS INTEGER) AS l_quantity, round(avg(l_extendedprice / 500), 6) AS brightness, avg(l_extendedprice / 500) < 60 AS is_night, round(avg(l_discount), 6) AS motion FROM lineitem GROUP BY 1")
def window_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = table(spark, sf_dir, "lineitem").withColumn("light", F.col("l_extendedprice") / 500)
    made = features.window_features(frames, ["l_orderkey"], ["l_quantity"], "light", "l_discount")
    return made.select("l_orderkey", "l_quantity", r6("brightness").alias("brightness"), "is_night", r6("motion").alias("motion"))


@collect(QUERIES, ORACLES, f"WITH {SAMPLES}, d AS (SELECT user_id, sqrt(value * value + angle * angle) AS s, abs(angle - lag(angle) OVER (PARTITION BY user_id ORDER BY time_s)) AS t FROM ev) SELECT user_id, round(quantile_cont(s, 0.5), 6) AS speed, round(quantile_cont(t, 0.95), 6) AS turn_p95 FROM d GROUP BY 1")
def motion_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = features.motion_features(samples(spark, sf_dir), "user_id", "time_s", ["value", "angle"], "angle")
    return made.select("user_id", r6("speed").alias("speed"), r6("turn_p95").alias("turn_p95"))


@collect(QUERIES, ORACLES, "SELECT l_orderkey, CAST(count(*) FILTER (WHERE l_returnflag IN ('A', 'R')) AS INTEGER) AS back, CAST(count(*) FILTER (WHERE l_returnflag = 'N') AS INTEGER) AS kept FROM lineitem GROUP BY 1")
def nested_class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_returnflag").alias("b"))
    counts = features.class_counts(F.col("b"), {"back": ["A", "R"], "kept": ["N"]})
    return boxes.select("l_orderkey", *counts)


@collect(QUERIES, ORACLES, "WITH f AS (SELECT l_suppkey, l_linenumber, count(*) FILTER (WHERE l_returnflag = 'A') AS n, bool_or(l_quantity > 49) AS big FROM lineitem GROUP BY 1, 2) SELECT l_suppkey, round(coalesce(avg(n) FILTER (WHERE n > 0), 0), 6) AS back, bool_or(big) AS big, max(l_linenumber) AS frames FROM f GROUP BY 1")
def subset_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = features.frame_stats(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_linenumber", {"back": F.col("l_returnflag") == "A"}, {"big": F.col("l_quantity") > 49})
    return made.withColumn("back", r6("back"))


@collect(QUERIES, ORACLES, "SELECT l_suppkey, round(max(l_extendedprice) - min(l_extendedprice), 6) AS spread, max(l_extendedprice) - min(l_extendedprice) > 40000 AS wide FROM lineitem GROUP BY 1")
def spread_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.spread(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_extendedprice", 40000.0).withColumn("spread", r6("spread"))


@collect(QUERIES, ORACLES, "WITH f AS (SELECT p_brand, count(*) AS found FROM part GROUP BY 1), e AS (SELECT p_brand, count(*) + CASE WHEN p_brand < 'Brand#2' THEN 0 ELSE 1 END AS n FROM part WHERE p_brand <> 'Brand#3' GROUP BY 1 UNION ALL SELECT 'Brand#0', 5) SELECT p_brand, found, n FROM f FULL JOIN e USING (p_brand) WHERE found IS DISTINCT FROM n")
def count_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    wrong = F.when(F.col("p_brand") < "Brand#2", F.lit(0)).otherwise(F.lit(1))
    expected = part.where("p_brand != 'Brand#3'").groupBy("p_brand").agg(F.count("*").alias("n")).select("p_brand", (F.col("n") + wrong).alias("n"))
    return features.count_contract(part, "p_brand", expected.union(spark.createDataFrame([("Brand#0", 5)], "p_brand string, n long")))


@collect(QUERIES, ORACLES, "SELECT p_brand, p_type, n FROM (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, p_type) = 1")
def fullest_member(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.fullest(table(spark, sf_dir, "part"), "p_type", ["p_brand"])


@collect(QUERIES, ORACLES, "SELECT user_id, event_type, n, round(n / sum(n) OVER (PARTITION BY user_id), 6) AS share, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) = 1 AS most_common FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2)")
def label_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.distribution(table(spark, sf_dir, "events"), "user_id", "event_type").withColumn("share", r6("share"))


@collect(QUERIES, ORACLES, "SELECT o_orderkey, concat_ws(',', CASE WHEN o_totalprice < 5000 THEN 'cheap' END, CASE WHEN o_orderstatus = 'P' THEN 'pending' END, CASE WHEN o_orderpriority LIKE '1%' AND o_orderstatus <> 'F' THEN 'urgent' END) AS flags FROM orders")
def quality_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = {"cheap": F.col("o_totalprice") < 5000, "pending": F.col("o_orderstatus") == "P", "urgent": F.col("o_orderpriority").startswith("1") & (F.col("o_orderstatus") != "F")}
    return table(spark, sf_dir, "orders").select("o_orderkey", F.concat_ws(",", features.flags(rules)).alias("flags"))


@collect(QUERIES, ORACLES, "WITH n AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) SELECT l_orderkey, array_to_string(list_sort(list_distinct(list_transform(range(0, 4), lambda i: CAST(round_even(i * (n - 1) / 3, 0) AS BIGINT)))), ',') AS frames FROM n")
def spaced_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    return counts.select("l_orderkey", F.concat_ws(",", scalars.spaced_indices(F.col("n"), 4).cast("array<string>")).alias("frames"))


@collect(QUERIES, ORACLES, f"WITH {SAMPLES}, a AS (SELECT user_id, min(time_s) AS a0, max(time_s) AS a1 FROM ev WHERE event_type = 'purchase' GROUP BY 1), b AS (SELECT user_id, min(time_s) AS b0, max(time_s) AS b1 FROM ev WHERE event_type = 'error' GROUP BY 1) SELECT user_id, round(greatest(0, least(a1, b1) - greatest(a0, b0)), 6) AS common, a1 >= b0 AND b1 >= a0 AS overlaps FROM a JOIN b USING (user_id)")
def overlap_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = samples(spark, sf_dir)
    return features.overlap_check(rows.where("event_type = 'purchase'"), rows.where("event_type = 'error'"), "user_id", "time_s", "time_s").withColumn("common", r6("common"))


@collect(QUERIES, ORACLES, "WITH o AS (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS g, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS spot, ts FROM events), u AS (SELECT user_id, event_type, count(*) AS n, min(spot) AS begin_at, min(ts) AS t0, max(ts) AS t1 FROM o GROUP BY user_id, event_type, g) SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY begin_at) AS run, n, epoch_us(t0) AS first, epoch_us(t1) AS last FROM u")
def work_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("us", F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)"))
    return features.units(rows, "user_id", ["us", "event_id"], "event_type")


@collect(QUERIES, ORACLES, "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS position FROM orders")
def positional_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.positions(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey")


@collect(QUERIES, ORACLES, "SELECT p_partkey, p_retailprice FROM (SELECT p_partkey, CASE WHEN p_size % 7 <> 0 THEN p_retailprice END AS p_retailprice FROM part) ORDER BY p_retailprice DESC NULLS LAST, p_partkey LIMIT 25")
def best_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") % 7 != 0, F.col("p_retailprice")).alias("p_retailprice"))
    return features.best_first(rows, "p_retailprice", 25, ["p_partkey"])


@collect(QUERIES, ORACLES, "SELECT DISTINCT size || '/' || least(stride, size) AS setting FROM (SELECT DISTINCT p_size AS size FROM part), (SELECT DISTINCT p_size * 2 % 9 AS stride FROM part)")
def settings_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes and strides of the parts, each with each; a stride is at most the size."""
    rows = table(spark, sf_dir, "part").select(F.col("p_size").alias("size"), (F.col("p_size") * 2 % 9).alias("stride"))
    return features.grid(rows, ["size", "stride"], F.concat_ws("/", "size", F.least("stride", "size"))).select("setting")


@collect(QUERIES, ORACLES, "SELECT l_orderkey, string_agg(l_returnflag, ',' ORDER BY first, l_returnflag) AS flags FROM (SELECT l_orderkey, l_returnflag, min(l_linenumber) AS first FROM lineitem GROUP BY 1, 2) GROUP BY 1")
def ordered_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_returnflag"))), lambda x: x["l_returnflag"])
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.concat_ws(",", F.array_distinct(own)).alias("flags"))


@collect(QUERIES, ORACLES, "SELECT user_id, sum(coalesce(TRY_CAST(props ->> 'k' AS BIGINT), 0)) AS k, sum(coalesce(TRY_CAST(props ->> 'missing' AS BIGINT), -1)) AS missing FROM events GROUP BY 1")
def json_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    return rows.groupBy("user_id").agg(F.sum(scalars.json_field("props", "k", "long", 0)).alias("k"), F.sum(scalars.json_field("props", "missing", "long", -1)).alias("missing"))


@collect(QUERIES, ORACLES, "SELECT user_id, count(value) AS n, round(avg(value), 6) AS value FROM (SELECT user_id, CASE WHEN event_type <> 'error' THEN value END AS value FROM events) GROUP BY 1")
def nan_to_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    holed = F.when(F.col("event_type") == "error", F.lit(float("nan"))).otherwise(F.col("value"))
    rows = table(spark, sf_dir, "events").select("user_id", scalars.not_nan(holed).alias("value"))
    return rows.groupBy("user_id").agg(F.count("value").alias("n"), r6(F.avg("value")).alias("value"))


@collect(QUERIES, ORACLES, "SELECT vec_id, label, CAST(len(embedding) AS INTEGER) AS length FROM embeddings JOIN part ON p_partkey = vec_id WHERE p_size BETWEEN 5 AND 30 ORDER BY label, vec_id LIMIT 10")
def structured_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").join(table(spark, sf_dir, "part"), F.col("vec_id") == F.col("p_partkey"))
    return rows.where("p_size BETWEEN 5 AND 30").select("vec_id", "label", F.size("embedding").alias("length")).orderBy("label", "vec_id").limit(10)


@collect(QUERIES, ORACLES, r"SELECT p_partkey, p_name FROM part WHERE p_name LIKE 'small%' AND p_name NOT LIKE '%b_lt'")
def like_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where(F.col("p_name").startswith("small") & ~F.col("p_name").like("%b_lt")).select("p_partkey", "p_name")


@collect(QUERIES, ORACLES, "SELECT p_partkey, CASE WHEN contains(lower(p_name), 'bolt') THEN 'metal' WHEN contains(lower(p_name), 'r') THEN 'round' ELSE 'other' END AS category FROM part")
def substring_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", scalars.category_of(F.col("p_name"), [("bolt", "metal"), ("r", "round")]).alias("category"))


@collect(QUERIES, ORACLES, "SELECT event_id, round(epoch_us(date_trunc('minute', ts)) / 1e6 + floor(value) / 1000, 6) AS at_s FROM events")
def minute_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", r6(scalars.from_minute(F.col("ts"), F.floor("value"))).alias("at_s"))


@collect(QUERIES, ORACLES, "SELECT p_name FROM (SELECT DISTINCT p_name FROM part) ORDER BY CASE p_name WHEN 'small bolt' THEN 1 WHEN 'red ring' THEN 2 ELSE 3 END, p_name LIMIT 8")
def preferred_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.preferred_first(table(spark, sf_dir, "part"), "p_name", ["small bolt", "red ring"], 8)


@collect(QUERIES, ORACLES, "SELECT p_partkey, coalesce(label, 0) AS label, coalesce(CAST(label > 3 AS INTEGER), 0) AS high FROM part LEFT JOIN embeddings ON vec_id = p_partkey")
def vector_row_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").join(table(spark, sf_dir, "embeddings"), F.col("vec_id") == F.col("p_partkey"), "left")
    return features.vector_rows(rows.select("p_partkey", "label", (F.col("label") > 3).alias("high")), ["label"], ["high"])


@collect(QUERIES, ORACLES, "WITH p AS (SELECT vec_id, list_slice(embedding, 1, 32)::DOUBLE[] AS a, list_slice(embedding, 33, 64)::DOUBLE[] AS b FROM embeddings WHERE vec_id % 20 = 0), m AS (SELECT x.vec_id, y.vec_id AS other, list_cosine_similarity(x.a, y.b) AS c FROM p x CROSS JOIN p y) SELECT vec_id, arg_max(other, struct_pack(c := c, o := -other)) AS nearest, round(max(c) FILTER (WHERE vec_id = other), 6) + 0.0 AS own, arg_max(other, struct_pack(c := c, o := -other)) = vec_id AS aligned FROM m GROUP BY vec_id")
def alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both halves of the stated query vectors as the two sides of a pair."""
    pairs = table(spark, sf_dir, "embeddings").where("vec_id % 20 = 0").select("vec_id", F.slice("embedding", 1, 32).alias("a"), F.slice("embedding", 33, 32).alias("b"))
    return features.aligned(pairs, "vec_id", "a", "b").withColumn("own", r6("own"))


@collect(QUERIES, ORACLES, "SELECT o_orderkey, epoch(CAST(strftime(o_orderdate, '%Y-%m-%d') AS TIMESTAMP)) AS start_s FROM orders")
def name_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("cam_"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit("_"), F.col("o_orderkey").cast("string"), F.lit(".mp4"))
    return table(spark, sf_dir, "orders").select("o_orderkey", scalars.anchor(name, r"_(\d{8})_", "yyyyMMdd").cast("double").alias("start_s"))


@collect(QUERIES, ORACLES, "SELECT n_name, CAST(strlen(n_name) AS INTEGER) AS bytes, printf('%d:%02d:%02d', n_nationkey * 1000 // 3600, n_nationkey * 1000 % 3600 // 60, n_nationkey * 1000 % 60) AS clock FROM nation")
def clock_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    seconds = F.col("n_nationkey") * 1000
    return table(spark, sf_dir, "nation").select("n_name", F.octet_length("n_name").alias("bytes"), scalars.clock_text(seconds).alias("clock"))


@collect(QUERIES, ORACLES, f"WITH {SAMPLES} SELECT event_type, count(*) AS n FROM ev WHERE value >= 20 AND value < 150 AND event_type <> 'error' GROUP BY 1")
def rule_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import predicates

    rows = predicates.records_match(samples(spark, sf_dir), [("value", ">=", 20.0), ("value", "<", 150.0)])
    return rows.where("event_type != 'error'").groupBy("event_type").agg(F.count("*").alias("n"))


@collect(QUERIES, ORACLES, "SELECT dataset, max_by(o_orderkey, struct_pack(d := started, i := CAST(o_orderkey AS VARCHAR))) AS o_orderkey FROM (SELECT o_custkey % 50 AS dataset, o_orderkey, o_orderdate AS started FROM orders WHERE o_orderstatus <> 'F') GROUP BY 1")
def latest_resumable(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..plans import runs

    state = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "failed").otherwise("ingesting")
    ledger = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("dataset"), F.col("o_orderkey").cast("string").alias("run_id"), state.alias("status"), F.col("o_orderdate").alias("started"))
    return runs.resumable(ledger).select("dataset", F.col("run_id").cast("long").alias("o_orderkey"))


@collect(QUERIES, ORACLES, "SELECT n_nationkey, lower(n_name) AS folded FROM nation")
def folded_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full-width capitals fold to the plain small letters."""
    wide = F.translate("n_name", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "".join(chr(0xFF21 + i) for i in range(26)))
    return table(spark, sf_dir, "nation").select("n_nationkey", scalars.folded(wide).alias("folded"))


@collect(QUERIES, ORACLES, "SELECT status, count(*) AS n, CASE WHEN count(*) FILTER (WHERE bad) > 0 THEN 'fail' WHEN count(*) FILTER (WHERE unknown) > 0 THEN 'not_run' ELSE 'pass' END AS rolled FROM (SELECT o_orderpriority AS status, o_totalprice > 390000 AS bad, o_orderstatus = 'P' AS unknown FROM orders) GROUP BY 1")
def status_roll_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import metadata

    made = F.when(F.col("o_totalprice") > 390000, "fail").when(F.col("o_orderstatus") == "P", "not_run").otherwise("pass")
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("status"), made.alias("_s"))
    return metadata.status(rows.withColumnRenamed("status", "priority"), "_s", ("priority",)).select(F.col("priority").alias("status"), "n", F.col("status").alias("rolled"))
