"""Streaming queries: ``events`` is read as a stream of files and drained."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.folders import new_folder
from ..streaming import carry, ingest
from .common import SAMPLES, collect, r6, samples, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _folder(spark: SparkSession) -> str:
    return new_folder(spark, "stream")


def _stream(spark: SparkSession, sf_dir: str, files: int = 16, chunk: bool = False) -> DataFrame:
    """The table as a stream of its files: those in its folder, or the one file of its
    name in ``sf_dir``."""
    schema = table(spark, sf_dir, "events").schema
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/events.parquet")
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files)
    if path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).getFileStatus(path).isDirectory():
        stream = reader.parquet(f"{sf_dir}/events.parquet")
    else:
        stream = reader.option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    stream = stream.withColumn("chunk", ingest.chunk_of_file()) if chunk else stream
    return stream.withColumn("time", F.col("ts").cast("timestamp"))


@collect(QUERIES, ORACLES, "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY event_type")
def stream_ingest_idempotent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drained twice from new checkpoints, in other batches: the second time replaces the
    first, file by file."""
    folder = _folder(spark)
    for attempt, files in (("first", 2), ("second", 16)):
        ingest.ingest(_stream(spark, sf_dir, files, True), f"{folder}/rows", f"{folder}/{attempt}", "event_id")
    return spark.read.parquet(f"{folder}/rows").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@collect(QUERIES, ORACLES, "WITH w AS (SELECT unnest([time_bucket(INTERVAL 6 HOUR, ts) - INTERVAL 6 HOUR, time_bucket(INTERVAL 6 HOUR, ts)]) AS t_start, event_type, value FROM events), a AS (SELECT t_start, t_start + INTERVAL 12 HOUR AS t_end, event_type, count(*) AS n, sum(value) AS total FROM w GROUP BY ALL), m AS (SELECT max(ts) AS last FROM events) SELECT CAST(t_start AS TIMESTAMP) AS t_start, event_type, n, round(total, 4) AS total FROM a, m WHERE t_end <= last - INTERVAL 10 MINUTE")
def stream_sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows that the watermark has closed."""
    folder = _folder(spark)
    made = ingest.sliding(_stream(spark, sf_dir), "time", "12 hours", "6 hours", "10 minutes", ["event_type"], "value")
    rows = ingest.drain(made, f"{folder}/rows", f"{folder}/checkpoint")
    return rows.select(F.col("t_start").cast("timestamp_ntz").alias("t_start"), "event_type", "n", F.round("total", 4).alias("total"))


@collect(QUERIES, ORACLES, "SELECT count(*) AS n, round(sum(value), 4) AS total FROM events")
def stream_dedup_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark)
    twice = _stream(spark, sf_dir).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    rows = ingest.drain(ingest.deduplicated(twice, "time", "1 hour", ["event_id"]), f"{folder}/rows", f"{folder}/checkpoint")
    return rows.agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@collect(QUERIES, ORACLES, "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events), i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, new) AS island FROM g), s AS (SELECT user_id, min(ts) AS t_start, max(ts) + INTERVAL 6 HOUR AS t_end, count(*) AS n FROM i GROUP BY user_id, island), m AS (SELECT max(ts) AS last FROM events) SELECT user_id, epoch_us(t_start) AS start_us, epoch_us(t_end) AS end_us, n FROM s, m WHERE date_trunc('millisecond', t_end) <= date_trunc('millisecond', last) - INTERVAL 10 MINUTE")
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions that the watermark has closed."""
    folder = _folder(spark)
    made = ingest.sessions(_stream(spark, sf_dir), "time", "6 hours", "10 minutes", ["user_id"])
    rows = ingest.drain(made, f"{folder}/rows", f"{folder}/checkpoint")
    return rows.select("user_id", F.unix_micros("t_start").alias("start_us"), F.unix_micros("t_end").alias("end_us"), "n")


@collect(QUERIES, ORACLES, f"WITH {SAMPLES} SELECT event_id, lag(value) OVER (PARTITION BY user_id ORDER BY time_s, value) AS previous FROM ev")
def stream_previous_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All samples in two halves of time, one after the other, as a source would send
    them; the second half finds the last samples of the first."""
    folder = _folder(spark)
    rows = samples(spark, sf_dir).select("event_id", "user_id", "time_s", "value")
    middle = rows.agg(F.percentile_approx("time_s", 0.5)).first()[0]
    later = F.coalesce(F.col("time_s") > F.lit(middle).cast("double"), F.lit(False))
    for half in (rows.where(~later), rows.where(later)):
        half.write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(rows.schema).parquet(f"{folder}/in")
        found = carry.with_previous(stream, f"{folder}/out", f"{folder}/checkpoint", "user_id", "time_s", "value")
    return found.select("event_id", "previous")


_EDGES = f"""
WITH {SAMPLES}, t AS (SELECT user_id, time_s, max(value) AS hi, min(value) AS lo, count(*) AS n FROM ev GROUP BY ALL),
w AS (SELECT user_id, floor(time_s / 86400) * 86400 AS t_start, sum(n) AS n FROM t GROUP BY ALL),
e AS (SELECT user_id, t_start, n, unnest([t_start, t_start + 86400]) AS edge FROM w),
p AS (SELECT e.*, t.time_s AS t0, t.hi AS v0 FROM e ASOF LEFT JOIN t ON t.user_id = e.user_id AND t.time_s < e.edge),
b AS (SELECT p.*, t.time_s AS t1, t.lo AS v1 FROM p ASOF LEFT JOIN t ON t.user_id = p.user_id AND t.time_s >= p.edge),
v AS (SELECT user_id, t_start, n, edge, t1, CASE WHEN t1 = edge THEN v1 WHEN edge - t0 <= 43200 AND t1 - edge <= 43200 THEN v0 + (v1 - v0) * (edge - t0) / (t1 - t0) END AS x FROM b),
m AS (SELECT max(time_s) AS last FROM ev)
SELECT h.user_id, h.t_start, round(h.x, 6) AS head, round(l.x, 6) AS tail, CAST(h.n AS BIGINT) AS n
FROM v h JOIN v l ON l.user_id = h.user_id AND l.t_start = h.t_start AND l.edge > l.t_start, m
WHERE h.edge = h.t_start AND (l.t1 IS NOT NULL OR l.edge + 43200 <= last)
"""


@collect(QUERIES, ORACLES, _EDGES)
def stream_window_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days of a user with the values at their ends, of samples that come in two halves of
    time: neighbours are carried from one batch to the next, timers end the last days."""
    folder = _folder(spark)
    rows = samples(spark, sf_dir).select("event_id", "user_id", "time_s", "value")
    middle = rows.agg(F.percentile_approx("time_s", 0.5)).first()[0]
    for half in (rows.where(F.col("time_s") <= middle), rows.where(F.col("time_s") > middle)):
        half.write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(rows.schema).parquet(f"{folder}/in")
        found = carry.window_edges(stream, f"{folder}/out", f"{folder}/checkpoint", "user_id", "time_s", "value", 86400.0, 43200.0)
    return found.select("user_id", "t_start", r6("head").alias("head"), r6("tail").alias("tail"), "n")
