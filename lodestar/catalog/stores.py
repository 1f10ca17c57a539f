"""Sources and sinks: the given tables written in a format, read back, compared with SQL;
ingest, runs and snapshots over them."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import features
from ..plans import benches, ledger, legacy, runs, snapshots
from ..sources import files, formats, inventory, joined, manifests, profiles, shards, tables
from ..sources.folders import new_folder
from .common import SAMPLES, collect, r6, samples, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


@collect(QUERIES, ORACLES, "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, CAST(o_orderdate AS VARCHAR) AS o_orderdate, o_orderpriority, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS position FROM orders")
def positions_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of all columns with their place in the order of two of them."""
    placed = features.positions(table(spark, sf_dir, "orders"), ["o_totalprice", "o_orderkey"])
    return placed.withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))


@collect(QUERIES, ORACLES, "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_returnflag, row_number() OVER (ORDER BY l_extendedprice, l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1 AS position FROM lineitem")
def positions_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag"]
    return features.positions(table(spark, sf_dir, "lineitem").select(*wanted), ["l_extendedprice", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"])


@collect(QUERIES, ORACLES, f"WITH {SAMPLES} SELECT CAST(user_id AS VARCHAR) AS user, count(*) AS n, round(sum(value), 4) AS total, round(max(time_s), 4) AS last FROM ev WHERE value IS NOT NULL GROUP BY user_id")
def telemetry_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples as CSV files, read by the data source: two of their columns, renamed."""
    folder = new_folder(spark, "telemetry")
    samples(spark, sf_dir).select("event_id", "event_type", "user_id", "time_s", "value").write.option("header", "true").csv(folder)
    formats.register(spark)
    rows = spark.read.format("telemetry").options(path=folder, timestamp="time_s", fields=json.dumps({"user": "user_id", "speed": "value"}), rangeBytes=1 << 16).load()
    speed = F.col("speed").cast("double")
    return rows.where(speed.isNotNull()).groupBy("user").agg(F.count("*").alias("n"), F.round(F.sum(speed), 4).alias("total"), F.round(F.max(F.col("stamp").cast("double")), 4).alias("last"))


@collect(QUERIES, ORACLES, "SELECT l_linenumber AS category, count(*) AS n, round(sum(l_quantity + l_tax * 50), 4) AS x, max(l_orderkey) AS last FROM lineitem WHERE l_linenumber >= 2 AND l_discount <> 0 GROUP BY 1")
def tracks_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as boxes of tracks: frame, track, x, y, width, height, score, category. Boxes
    of score 0 are none."""
    folder = new_folder(spark, "tracks")
    lines = table(spark, sf_dir, "lineitem").select(F.concat_ws(",", "l_orderkey", "l_partkey", "l_quantity", F.lit(1), F.col("l_tax") * 100, F.lit(2), "l_discount", "l_linenumber").alias("value"))
    lines.write.text(folder)
    formats.register(spark)
    rows = spark.read.format("tracks").option("path", folder).load().where("category >= 2")
    return rows.groupBy("category").agg(F.count("*").alias("n"), F.round(F.sum("cx"), 4).alias("x"), F.max("frame").alias("last"))


@collect(QUERIES, ORACLES, "SELECT count(*) AS n, count(DISTINCT vec_id) AS ids, round(sum(embedding[1]::DOUBLE), 4) AS first, round(sum(embedding[64]::DOUBLE * vec_id), 2) AS last, 4 AS shards, 0 AS again FROM embeddings")
def sharded_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors in four shards, each a Parquet file and a matrix in the same order; a second
    run finds all of them. The rows of the matrices meet their ids by their places."""
    folder = new_folder(spark, "shards")
    rows = table(spark, sf_dir, "embeddings")
    done = shards.write_shards(rows, folder, "vec_id", 4, "embedding")
    again = shards.write_shards(rows, folder, "vec_id", 4, "embedding")
    ids = features.positions(shards.read_shards(rows, folder).select("shard", "vec_id"), ["shard", "vec_id"])
    first = ids.groupBy("shard").agg(F.min("position").alias("_from"))
    placed = ids.join(first, "shard").select("shard", "vec_id", (F.col("position") - F.col("_from")).alias("position"))
    vectors = manifests.matrix_rows(spark, folder).withColumn("shard", F.regexp_extract("file", r"shard-(\d+)", 1).cast("int"))
    met = placed.join(vectors, ["shard", "position"])
    return met.agg(F.count("*").alias("n"), F.countDistinct("vec_id").alias("ids"), F.round(F.sum(F.col("vector")[0]), 4).alias("first"), F.round(F.sum(F.col("vector")[63] * F.col("vec_id")), 2).alias("last"), F.lit(done).alias("shards"), F.lit(again).alias("again"))


@collect(QUERIES, ORACLES, "SELECT user_id, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events WHERE event_id % 3 <> 0 AND value IS NOT NULL GROUP BY 1 UNION ALL SELECT user_id, max(event_id), arg_max(value, event_id) FROM events WHERE event_id % 3 = 0 AND value IS NOT NULL AND user_id NOT IN (SELECT user_id FROM events WHERE event_id % 3 <> 0 AND value IS NOT NULL) GROUP BY 1")
def row_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cache of rows that is appended to twice: the last write of a user counts."""
    folder = new_folder(spark, "cache")
    rows = table(spark, sf_dir, "events").where("value is not null").select("user_id", "event_id", "value")
    for part in (rows.where("event_id % 3 = 0"), rows.where("event_id % 3 <> 0")):
        files.append_rows(part.repartition("user_id").sortWithinPartitions("user_id", "event_id"), folder)
    return files.cached_rows(spark, folder, "user_id long, event_id long, value double", ["user_id"])


@collect(QUERIES, ORACLES, "SELECT CASE WHEN l_quantity > 40 AND l_discount < 0.02 THEN 'quantity,discount' WHEN l_quantity > 40 THEN 'quantity' WHEN l_discount < 0.02 THEN 'discount' ELSE '' END AS faults, count(*) AS n, sum(l_orderkey) AS keys FROM lineitem GROUP BY 1")
def quarantined_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that break rules are written apart with the reasons, and read back."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", "l_discount")
    good, bad = files.quarantine(rows, {"quantity": F.col("l_quantity") <= 40, "discount": F.col("l_discount") >= 0.02})
    folder = new_folder(spark, "errors")
    files.append_rows(bad, folder)
    told = spark.read.schema("row string, errors array<string>").json(folder)
    failed = told.select(F.concat_ws(",", "errors").alias("faults"), F.from_json("row", "l_orderkey long")["l_orderkey"].alias("l_orderkey"))
    return good.select(F.lit("").alias("faults"), "l_orderkey").union(failed).groupBy("faults").agg(F.count("*").alias("n"), F.sum("l_orderkey").alias("keys"))


@collect(QUERIES, ORACLES, "WITH s AS (SELECT p_partkey, p_size, CASE WHEN p_size % 4 = 0 THEN NULL ELSE p_name END AS p_name, p_retailprice FROM part ORDER BY p_partkey LIMIT 1000) SELECT unnest(['p_partkey', 'p_size', 'p_name', 'p_retailprice']) AS name, unnest(['long', 'long', 'string', 'double']) AS type, unnest([0.0, 0.0, (SELECT round(avg((p_name IS NULL)::INT), 6) FROM s), 0.0]) AS null_share, ';' AS delimiter, 'utf-8' AS encoding")
def csv_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file of unknown make: its encoding, delimiter, columns and shares of nulls."""
    folder = new_folder(spark, "profile")
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_size", F.when(F.col("p_size") % 4 != 0, F.col("p_name")).alias("p_name"), "p_retailprice")
    rows.orderBy("p_partkey").coalesce(1).write.option("header", "true").option("sep", ";").csv(folder)
    found = profiles.csv_profiles(spark, folder).select("delimiter", "encoding", F.explode("columns").alias("c"))
    return found.select(F.col("c.column").alias("name"), "c.type", r6("c.null_share").alias("null_share"), "delimiter", "encoding")


@collect(QUERIES, ORACLES, "SELECT o_orderstatus AS status, CAST(sum(strlen(line) + 1) AS BIGINT) AS bytes, sha256(string_agg(line, chr(10) ORDER BY o_orderkey) || chr(10)) AS sha256 FROM (SELECT o_orderstatus, o_orderkey, o_orderkey || ' ' || o_orderpriority AS line FROM orders) GROUP BY 1")
def file_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file per status, with its size and hash, read piece by piece."""
    folder = new_folder(spark, "inventory")
    lines = table(spark, sf_dir, "orders").select("o_orderstatus", "o_orderkey", F.concat_ws(" ", "o_orderkey", "o_orderpriority").alias("value"))
    joined.write_text(lines, folder, "o_orderstatus", "value", "o_orderkey")
    found = inventory.inventory(spark, folder)
    return found.where("name like '%.txt'").select(F.regexp_extract("name", "o_orderstatus=([^/]+)/", 1).alias("status"), "bytes", "sha256")


@collect(QUERIES, ORACLES, "SELECT 'o_orderstatus' AS part, o_orderstatus AS id, 'txt' AS extension, 1 AS files FROM orders GROUP BY o_orderstatus")
def files_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files below a root by a pattern that doesn't mind case, their identifiers and the
    counts of extensions."""
    folder = new_folder(spark, "found")
    joined.write_text(table(spark, sf_dir, "orders").select("o_orderstatus", F.col("o_orderkey").cast("string").alias("value")), folder, "o_orderstatus", "value")
    found = files.listing(spark, folder, "**/PART-*.TXT")
    own = found.select(files.identifier(F.col("name"), r"regex:o_orderstatus=(?P<video_id>\w+)/").alias("id"), "name", "bytes")
    return own.groupBy("id").agg(F.count("*").cast("int").alias("files"), F.min(F.regexp_extract("name", r"\.([^./]+)$", 1)).alias("extension")).withColumn("part", F.lit("o_orderstatus"))


def _bundle(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    orders, items = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    return {
        "videos": table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("value")),
        "segments": orders.select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("value")),
        "metadata": items.groupBy(F.col("l_orderkey").alias("id")).agg(F.sum("l_quantity").alias("value")),
        "telemetry": items.groupBy(F.col("l_partkey").alias("id")).agg(F.max("l_extendedprice").alias("value")),
    }


_BUNDLE = {"videos": "SELECT c_custkey AS id, c_acctbal AS value FROM customer", "segments": "SELECT o_orderkey, o_totalprice FROM orders", "metadata": "SELECT l_orderkey, sum(l_quantity) FROM lineitem GROUP BY 1", "telemetry": "SELECT l_partkey, max(l_extendedprice) FROM lineitem GROUP BY 1"}


@collect(QUERIES, ORACLES, " UNION ALL ".join(f"SELECT {v} AS version, '{n}' AS store, count(*) AS n, round(sum(CASE WHEN {v} = 2 AND id % 5 = 0 THEN -1 ELSE value END), 4) AS total FROM ({sql}) t(id, value)" for n, sql in _BUNDLE.items() for v in (1, 2)))
def snapshot_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four tables replaced and then upserted together, each version read by itself; rows
    of a writer that went away before its commit are never seen."""
    log = snapshots.Snapshots(spark, new_folder(spark, "bundle"))
    tables_ = _bundle(spark, sf_dir)
    log.replace(tables_)
    for name, rows in tables_.items():
        log.stage(rows, name)
    log.upsert({n: (rows.where("id % 5 = 0").withColumn("value", F.lit(-1.0)), ["id"]) for n, rows in tables_.items()})
    made = None
    for version in (1, 2):
        for name in tables_:
            one = log.read(name, version).agg(F.lit(version).alias("version"), F.lit(name).alias("store"), F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
            made = one if made is None else made.union(one)
    return made


def _ingested(spark: SparkSession, sf_dir: str, first: str) -> tuple[ledger.Ledger, DataFrame]:
    """Orders as segments of a run, a nation of customers a chunk; a first writer writes the
    chunks ``first``, too few rows of some of them, and goes away."""
    nation = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("chunk_index"))
    rows = table(spark, sf_dir, "orders").join(nation, "o_custkey").select(F.lit("v").alias("video_id"), "chunk_index", F.col("o_orderkey").alias("segment_id"), F.col("o_totalprice").alias("value"))
    made = ledger.Ledger(spark, new_folder(spark, "ledger"))
    made.create("run", "orders", rows.groupBy("video_id", "chunk_index").agg(F.count("*").alias("expected")))
    for state in ("preflight_passed", "ingesting"):
        made.advance("run", state)
    token, held = made.begin("run", rows.where(first).select("video_id", "chunk_index"))
    own = rows.join(held.select("video_id", "chunk_index"), ["video_id", "chunk_index"])
    made.commit("run", token, {"segments": own.where("chunk_index % 4 <> 0 or segment_id % 2 = 0")})
    lost, _ = made.begin("run", rows.where(f"not ({first}) and chunk_index % 3 = 0").select("video_id", "chunk_index"))
    made.log.stage(rows, "segments")
    return made, rows


@collect(QUERIES, ORACLES, "SELECT c_nationkey AS chunk_index, count(*) AS expected, CASE WHEN c_nationkey < 12 AND c_nationkey % 4 <> 0 OR c_nationkey < 12 AND count(*) = count(*) FILTER (WHERE o_orderkey % 2 = 0) THEN 'committed' WHEN c_nationkey < 12 THEN 'failed' WHEN c_nationkey % 3 = 0 THEN 'writing' ELSE 'pending' END AS status FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_nationkey")
def chunk_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the ledger tells after a writer that failed some chunks and one that went away."""
    made, _ = _ingested(spark, sf_dir, "chunk_index < 12")
    return made.chunks("run").select("chunk_index", "expected", "status")


@collect(QUERIES, ORACLES, "SELECT c_nationkey AS chunk_index, count(*) AS n, count(DISTINCT o_orderkey) AS ids, round(sum(o_totalprice), 4) AS total, 'completed' AS status FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def ledger_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second writer takes over what is not committed; the run, checked as a whole,
    becomes the active one. No row is lost or there twice."""
    made, rows = _ingested(spark, sf_dir, "chunk_index < 12")
    token, held = made.begin("run", take_over=True)
    made.commit("run", token, {"segments": rows.join(held.select("video_id", "chunk_index"), ["video_id", "chunk_index"])})
    told = made.finalize("run", ["segments"], {"segments": "segment_id"})
    return made.rows("segments", "orders").groupBy("chunk_index").agg(F.count("*").alias("n"), F.countDistinct("segment_id").alias("ids"), F.round(F.sum("value"), 4).alias("total"), F.lit(told["status"]).alias("status"))


@collect(QUERIES, ORACLES, "SELECT 'before' AS reader, count(*) AS n, round(sum(o_totalprice), 4) AS total FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 'after', count(*), round(sum(o_totalprice), 4) FROM orders WHERE o_orderstatus <> 'F' UNION ALL SELECT 'failed', count(*), round(sum(o_totalprice), 4) FROM orders WHERE o_orderstatus <> 'F'")
def run_activation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three runs of a dataset: a reader of the version before goes on with its run, and a
    run that isn't whole does not become the active one."""
    made = ledger.Ledger(spark, new_folder(spark, "active"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("video_id"), F.lit(0).alias("chunk_index"), F.col("o_orderkey").alias("segment_id"), F.col("o_totalprice").alias("value"))
    seen = {}
    for run, where, kept in (("before", "video_id = 'F'", "true"), ("after", "video_id <> 'F'", "true"), ("failed", "video_id = 'F'", "segment_id % 2 = 0")):
        own = orders.where(where)
        made.create(run, "orders", own.groupBy("video_id", "chunk_index").agg(F.count("*").alias("expected")))
        for state in ("preflight_passed", "ingesting"):
            made.advance(run, state)
        token, _ = made.begin(run)
        made.commit(run, token, {"segments": own.where(kept)})
        made.finalize(run, ["segments"])
        seen[run] = made.log.version()
    told = None
    for run, version in seen.items():
        one = made.rows("segments", "orders", version=version).agg(F.lit(run).alias("reader"), F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
        told = one if told is None else told.union(one)
    return told


@collect(QUERIES, ORACLES, "SELECT unnest(['run_videos', 'run_segments', 'run_metadata', 'run_telemetry', 'run_groundtruth', 'run_vectors_64', 'chunks']) AS store, unnest([(SELECT count(*) FROM customer WHERE c_nationkey = 7), (SELECT count(*) FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = 7), (SELECT count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = 7 AND l_linenumber = 1), (SELECT count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = 7 AND l_linenumber = 2), (SELECT count(*) FROM customer WHERE c_nationkey = 7 AND c_mktsegment = 'BUILDING'), (SELECT count(*) FROM embeddings WHERE label = 7), (SELECT count(DISTINCT o_custkey) FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = 7)]) AS n")
def legacy_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables from before runs, a nation a dataset, copied into a run by one version; a
    second migration finds it made."""
    customer = table(spark, sf_dir, "customer").withColumn("dataset_id", F.col("c_nationkey").cast("string"))
    known = customer.select("dataset_id", F.col("c_custkey").alias("o_custkey"))
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("segment_id"), "l_linenumber", "l_quantity")
    made = {
        "videos": customer.select("dataset_id", F.col("c_custkey").alias("video_id"), F.col("c_name").alias("source_uri"), F.col("c_acctbal").alias("duration_s")),
        "segments": table(spark, sf_dir, "orders").join(known, "o_custkey").select(F.col("o_orderkey").alias("segment_id"), "dataset_id", F.col("o_custkey").alias("video_id")),
        "metadata": items.where("l_linenumber = 1"),
        "telemetry": items.where("l_linenumber = 2"),
        "groundtruth": customer.where("c_mktsegment = 'BUILDING'").select("dataset_id", F.col("c_name").alias("query_id"), F.col("c_custkey").alias("relevant_video_id")),
    }
    vectors = {64: table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("segment_id"), F.col("label").cast("string").alias("dataset_id"), F.col("embedding").alias("v"))}
    log = snapshots.Snapshots(spark, new_folder(spark, "legacy"))
    for _ in range(2):
        legacy.migrate(log, made, vectors, "7", "content")
    parts = [log.read(n).agg(F.lit(n).alias("store"), F.count("*").alias("n")) for n in ("run_videos", "run_segments", "run_metadata", "run_telemetry", "run_groundtruth", "run_vectors_64", "chunks")]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


@collect(QUERIES, ORACLES, "SELECT count(*) FILTER (WHERE o_orderstatus = 'O') AS deleted, count(*) FILTER (WHERE o_orderstatus = 'F') AS kept, true AS refused FROM orders")
def run_deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run that is not active can be deleted, the active one can't."""
    made = runs.Runs(spark, new_folder(spark, "runs"), "segments")
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("video_id"), F.lit(0).alias("chunk_index"), F.col("o_orderkey").alias("segment_id"))
    for run in ("F", "O"):
        made.write_chunk(rows.where(F.col("video_id") == run), "orders", run)
    made.activate("orders", "F", rows.where("video_id = 'F'").groupBy("video_id", "chunk_index").agg(F.count("*").alias("n")))
    deleted = made.delete("orders", "O")
    try:
        made.delete("orders", "F")
        refused = False
    except ValueError:
        refused = True
    return made.rows("orders").agg(F.lit(deleted).cast("long").alias("deleted"), F.count("*").alias("kept"), F.lit(refused).alias("refused"))


@collect(QUERIES, ORACLES, "SELECT DISTINCT p_type AS field, 'keyword' AS kind FROM part WHERE p_size > 25")
def field_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fields of a run, replaced as a whole."""
    made = runs.Runs(spark, new_folder(spark, "registry"), "segments")
    parts = table(spark, sf_dir, "part")
    for where in ("p_size <= 25", "p_size > 25"):
        made.replace_registry("parts", "r", parts.where(where).select(F.col("p_type").alias("field"), F.lit("keyword").alias("kind"), F.lit(None).cast("string").alias("unit")).distinct())
    return spark.createDataFrame(sorted(made.registry("parts", "r").items()), "field string, kind string")


@collect(QUERIES, ORACLES, "SELECT l_shipdate_day AS strategy, count(*) AS n_queries, count(*) FILTER (WHERE l_quantity < 10) AS underfilled_count, round(avg(l_discount), 6) AS mean_mrr FROM (SELECT l_returnflag AS l_shipdate_day, * FROM lineitem) GROUP BY 1")
def bench_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bench's artifacts, written and read back: the means by strategy."""
    folder = new_folder(spark, "bench")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("strategy"), F.col("l_discount").alias("mrr"), (F.col("l_quantity") < 10).alias("underfilled"), F.lit("SELECT 1").alias("sql"))
    benches.write_run(rows, folder, {"run_id": "r"}, ["mrr"])
    found = spark.read.json(f"{folder}/metrics")
    return found.select("strategy", "n_queries", "underfilled_count", r6("mean_mrr").alias("mean_mrr"))


@collect(QUERIES, ORACLES, "SELECT p_partkey, p_name, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 20")
def exported_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rows of a result as CSV, read back."""
    folder = new_folder(spark, "export")
    shards.export_csv(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_retailprice").orderBy(F.desc("p_retailprice"), "p_partkey").limit(20), folder)
    return spark.read.option("header", "true").schema("p_partkey long, p_name string, p_retailprice double").csv(folder)


@collect(QUERIES, ORACLES, "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey % 7 IN (3, 4)")
def resumed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a resumed run still has to do: items that no committed partition holds."""
    folder = new_folder(spark, "resume")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").withColumn("part", F.col("o_orderkey") % 7)
    tables.replace(orders.where("part not in (3, 4)"), folder, ["part"])
    return runs.pending(orders, spark.read.parquet(folder), ["o_orderkey"]).select("o_orderkey", "o_custkey")


_MANIFEST = """
schema_version: 1
dataset_id: events
source: {videos_glob: "**/*.mp4"}
time_alignment: {telemetry_clock: relative_s, max_gap_s: 5}
window: {size_s: 8, stride_s: 4, frames_per_item: 8}
telemetry:
  timestamp_column: time_s
  fields:
    altitude_m: {source: value, type: continuous, reference: AGL, scale: 2, offset: 1}
    person_count: {source: value, type: integer, scale: -1}
    yaw: {source: angle, type: circular_deg}
    is_night: {source: flag, type: boolean}
  extra:
    mode: {source: event_type, type: categorical}
"""


@collect(QUERIES, ORACLES, f"WITH {SAMPLES} SELECT round(time_s, 3) AS stamp, round(value * 2 + 1, 6) AS altitude_m, CAST(trunc(-value) AS BIGINT) AS person_count, round(angle, 6) AS yaw, flag AS is_night, event_type AS mode FROM ev")
def manifest_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Telemetry through a manifest: scaled numbers, integers cut toward zero, angles,
    flags and categories, from text."""
    folder = new_folder(spark, "manifest")
    samples(spark, sf_dir).select("time_s", "value", "angle", "flag", "event_type").write.option("header", "true").csv(f"{folder}/telemetry")
    spark.createDataFrame([(_MANIFEST,)], "value string").coalesce(1).write.text(f"{folder}/manifest")
    manifest = manifests.load(spark, f"{folder}/manifest")
    formats.register(spark)
    rows = spark.read.option("header", "true").csv(f"{folder}/telemetry")
    made = manifest.project(rows)
    return made.select(F.round(F.col("stamp").cast("double"), 3).alias("stamp"), r6("altitude_m").alias("altitude_m"), "person_count", r6("yaw").alias("yaw"), "is_night", "mode")
