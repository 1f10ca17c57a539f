"""Windows, samples on a timeline and intervals, over ``events`` per user."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import intervals
from ..operators import timeline as T
from .common import DURATIONS, GAP, SAMPLES, SIZE, STRIDE, WINDOWS, collect, durations, r6, samples, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
#: Seconds of a series that one task orders.
CELL = 7 * 86400.0
_BASE = f"WITH {SAMPLES}, {DURATIONS}"


def _windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.sliding(durations(spark, sf_dir), SIZE, STRIDE).select("user_id", "t_start", "t_end")


@collect(QUERIES, ORACLES, f"{_BASE}, {WINDOWS} SELECT user_id, round(t_start, 6) AS t_start, round(t_end, 6) AS t_end FROM w WHERE t_end - t_start >= 7200")
def windows_partial_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.sliding(durations(spark, sf_dir), SIZE, STRIDE, least=7200.0).select("user_id", r6("t_start").alias("t_start"), r6("t_end").alias("t_end"))


@collect(QUERIES, ORACLES, f"{_BASE} SELECT user_id, i * {STRIDE} AS t_start, i * {STRIDE} + {SIZE} AS t_end FROM (SELECT user_id, duration, unnest(range(0, CAST(ceil(duration / {STRIDE}) AS BIGINT))) AS i FROM dur) WHERE i * {STRIDE} + {SIZE} <= duration + 1e-9")
def windows_drop_partial(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.sliding(durations(spark, sf_dir), SIZE, STRIDE, "drop").select("user_id", "t_start", "t_end")


@collect(QUERIES, ORACLES, f"{_BASE} SELECT user_id, i * {STRIDE} AS t_start, i * {STRIDE} + {SIZE} AS t_end FROM (SELECT user_id, duration, unnest(range(0, CAST(ceil(duration / {STRIDE}) AS BIGINT))) AS i FROM dur)")
def windows_pad_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.sliding(durations(spark, sf_dir), SIZE, STRIDE, "pad").select("user_id", "t_start", "t_end")


@collect(QUERIES, ORACLES, f"{_BASE}, {WINDOWS} SELECT user_id, CAST(floor(t_start / 100000.0) AS BIGINT) AS chunk_index, count(*) AS n FROM w GROUP BY 1, 2")
def window_chunk_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _windows(spark, sf_dir).groupBy("user_id", T.chunk_of(F.col("t_start"), 100000.0).alias("chunk_index")).agg(F.count("*").alias("n"))


_ENDS = f"""{_BASE}, {WINDOWS},
b AS (SELECT user_id, t_start, t_end, 1 AS part, t_start AS pt FROM w UNION ALL SELECT user_id, t_start, t_end, 2, t_end FROM w),
p AS (SELECT b.*, e.time_s AS lt, e.value AS lv, e.event_type AS lc, e.flag AS lf, e.angle AS la FROM b ASOF LEFT JOIN ev e ON b.user_id = e.user_id AND b.pt > e.time_s),
n AS (SELECT p.*, e.time_s AS rt, e.value AS rv, e.event_type AS rc, e.flag AS rf, e.angle AS ra FROM p ASOF LEFT JOIN ev e ON p.user_id = e.user_id AND p.pt <= e.time_s),
f AS (SELECT *, abs(rt - pt) <= greatest(1e-9, 1e-9 * greatest(abs(rt), abs(pt))) AS exact, lt IS NOT NULL AND rt IS NOT NULL AND greatest(pt - lt, rt - pt) <= {GAP} AS near, (pt - lt) / (rt - lt) AS fr FROM n)"""


def _values(inside: str, between: str) -> str:
    return f"{_ENDS}, v AS (SELECT w.user_id, t_start, t_end, {inside} AS value, 0 AS part, time_s AS place FROM w JOIN ev ON ev.user_id = w.user_id AND time_s BETWEEN t_start AND t_end UNION ALL SELECT user_id, t_start, t_end, {between}, part, pt FROM f), g AS (SELECT * FROM v WHERE value IS NOT NULL)"


_LINEAR = "CASE WHEN exact THEN rv WHEN near THEN lv + (rv - lv) * fr END"
_KEYS = "user_id, t_start, t_end"


def _summary(spark: SparkSession, sf_dir: str, name: str, kind: str) -> DataFrame:
    return T.summarized(_windows(spark, sf_dir), samples(spark, sf_dir), T.Measure(name, kind), "user_id", GAP, SIZE)


def _rounded(df: DataFrame, name: str) -> DataFrame:
    return df.select("user_id", r6("t_start").alias("t_start"), r6("t_end").alias("t_end"), name)


_OUT = "SELECT user_id, round(w.t_start, 6) AS t_start, round(w.t_end, 6) AS t_end"


@collect(QUERIES, ORACLES, f"{_values('value', _LINEAR)}, m AS (SELECT {_KEYS}, quantile_cont(value, 0.5) AS x FROM g GROUP BY ALL) {_OUT}, round(x, 5) AS value FROM w LEFT JOIN m USING ({_KEYS})")
def window_telemetry_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_summary(spark, sf_dir, "value", "continuous").withColumn("value", F.round("value", 5)), "value")


@collect(QUERIES, ORACLES, f"{_values('event_type', f'CASE WHEN exact THEN rc WHEN pt - lt <= {GAP} THEN lc END')}, c AS (SELECT {_KEYS}, value, count(*) AS n, min(struct_pack(a := part, b := place)) AS first FROM g GROUP BY {_KEYS}, value), m AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY {_KEYS} ORDER BY n DESC, first) = 1) {_OUT}, value AS event_type FROM w LEFT JOIN m USING ({_KEYS})")
def window_telemetry_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_summary(spark, sf_dir, "event_type", "categorical"), "event_type")


@collect(QUERIES, ORACLES, f"{_values('flag', 'CASE WHEN exact THEN rf WHEN near THEN CASE WHEN fr < 0.5 THEN lf ELSE rf END END')}, m AS (SELECT {_KEYS}, count(*) FILTER (WHERE value) * 2 >= count(*) AS x FROM g GROUP BY ALL) {_OUT}, x AS flag FROM w LEFT JOIN m USING ({_KEYS})")
def window_telemetry_bool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_summary(spark, sf_dir, "flag", "boolean"), "flag")


# 360 is added where the remainder is negative only: added to all, it rounds a turn just
# below 180 degrees to the other side
_TURN = "(ra - la + 180) % 360 + CASE WHEN (ra - la + 180) % 360 < 0 THEN 360 ELSE 0 END - 180"


@collect(QUERIES, ORACLES, f"{_values('angle', f'CASE WHEN exact THEN ra WHEN near THEN (la + fr * ({_TURN}) + 360) % 360 END')}, s AS (SELECT {_KEYS}, sum(sin(radians(value))) AS y, sum(cos(radians(value))) AS x FROM g GROUP BY ALL), m AS (SELECT {_KEYS}, CASE WHEN abs(x) <= 1e-12 AND abs(y) <= 1e-12 THEN NULL ELSE (degrees(atan2(y, x)) + 360) % 360 END AS a FROM s) {_OUT}, round(a, 5) AS angle FROM w LEFT JOIN m USING ({_KEYS})")
def window_telemetry_circular(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_summary(spark, sf_dir, "angle", "circular").withColumn("angle", F.round("angle", 5)), "angle")


_GRID = f"""{_BASE}, b AS (SELECT user_id, i * 21600.0 AS pt FROM (SELECT user_id, unnest(range(0, CAST(ceil(duration / 21600.0) AS BIGINT))) AS i FROM dur)),
p AS (SELECT b.*, e.time_s AS lt, e.value AS lv, e.angle AS la, e.event_type AS lc FROM b ASOF LEFT JOIN ev e ON b.user_id = e.user_id AND b.pt > e.time_s),
f AS (SELECT p.*, e.time_s AS rt, e.value AS rv, e.angle AS ra, e.event_type AS rc, greatest(pt - lt, e.time_s - pt) <= {GAP} AS near, (pt - lt) / (e.time_s - lt) AS fr, abs(e.time_s - pt) <= greatest(1e-9, 1e-9 * greatest(abs(e.time_s), abs(pt))) AS exact FROM p ASOF LEFT JOIN ev e ON p.user_id = e.user_id AND p.pt <= e.time_s)"""


def _grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = T.sliding(durations(spark, sf_dir), 21600.0, 21600.0, "pad").select("user_id", F.col("t_start").alias("at"))
    return T.neighbours(points, samples(spark, sf_dir), ["value", "angle", "event_type"], "user_id", cell=CELL)


@collect(QUERIES, ORACLES, f"{_GRID} SELECT user_id, pt AS at_s, round(lt, 6) AS before_s, round(rt, 6) AS after_s, lv AS before_value, rv AS after_value FROM f")
def asof_prev_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grid(spark, sf_dir).select("user_id", F.col("at").alias("at_s"), r6("left.time").alias("before_s"), r6("right.time").alias("after_s"), F.col("left.value").alias("before_value"), F.col("right.value").alias("after_value"))


@collect(QUERIES, ORACLES, f"{_GRID} SELECT user_id, pt AS at_s, round(CASE WHEN exact THEN rv WHEN near THEN lv + (rv - lv) * fr END, 5) AS value FROM f")
def interp_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grid(spark, sf_dir).select("user_id", F.col("at").alias("at_s"), F.round(T.interpolated(T.Measure("value"), F.col("at"), GAP), 5).alias("value"))


@collect(QUERIES, ORACLES, f"{_GRID} SELECT user_id, pt AS at_s, round(CASE WHEN exact THEN ra WHEN near THEN (la + fr * ({_TURN}) + 360) % 360 END, 5) AS angle FROM f")
def interp_circular(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grid(spark, sf_dir).select("user_id", F.col("at").alias("at_s"), F.round(T.interpolated(T.Measure("angle", "circular"), F.col("at"), GAP), 5).alias("angle"))


@collect(QUERIES, ORACLES, f"{_GRID} SELECT user_id, pt AS at_s, CASE WHEN exact THEN rc WHEN pt - lt <= {GAP} THEN lc END AS event_type FROM f")
def locf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grid(spark, sf_dir).select("user_id", F.col("at").alias("at_s"), T.interpolated(T.Measure("event_type", "categorical"), F.col("at"), GAP).alias("event_type"))


@collect(QUERIES, ORACLES, f"WITH {SAMPLES}, l AS (SELECT user_id, time_s < lag(time_s) OVER (PARTITION BY user_id ORDER BY value, event_id) AS late FROM ev) SELECT user_id, count(*) FILTER (WHERE late) AS n_late, count(*) FILTER (WHERE late) = 0 AS monotonic FROM l GROUP BY 1")
def monotonic_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.disorder(samples(spark, sf_dir), "user_id", ["value", "event_id"], cell=10.0)


@collect(QUERIES, ORACLES, f"WITH {SAMPLES}, g AS (SELECT *, time_s - lag(time_s) OVER (PARTITION BY user_id ORDER BY time_s) AS gap FROM ev), m AS (SELECT user_id, quantile_cont(gap, 0.5) AS mid FROM g GROUP BY 1), s AS (SELECT g.user_id, event_id, CAST(sum(CASE WHEN gap > mid * 4 THEN 1 ELSE 0 END) OVER (PARTITION BY g.user_id ORDER BY time_s) AS BIGINT) AS session FROM g JOIN m ON g.user_id = m.user_id) SELECT user_id, session, count(*) AS n FROM s GROUP BY 1, 2")
def session_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.sessions(samples(spark, sf_dir), "user_id", "time_s", 4.0, CELL).groupBy("user_id", "session").agg(F.count("*").alias("n"))


@collect(QUERIES, ORACLES, f"WITH {SAMPLES}, d AS (SELECT user_id, abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY time_s)) AS s FROM ev) SELECT user_id, round(quantile_cont(s, 0.95), 6) AS step FROM d GROUP BY 1")
def first_diff_p95(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.step_percentile(samples(spark, sf_dir), "user_id", "time_s", "value", cell=CELL).select("user_id", r6("step").alias("step"))


_SPANS = "sp AS (SELECT event_id, user_id, event_type, time_s AS t_start, time_s + 600 + value * 60 AS t_end, value AS score FROM ev)"


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples(spark, sf_dir).select("event_id", "user_id", "event_type", F.col("time_s").alias("t_start"), (F.col("time_s") + 600 + F.col("value") * 60).alias("t_end"), F.col("value").alias("score"))


_MERGED = f"WITH {SAMPLES}, {_SPANS}, r AS (SELECT *, max(t_end) OVER (PARTITION BY user_id ORDER BY t_start, t_end, score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM sp), i AS (SELECT *, sum(CASE WHEN t_start - reach <= 3600 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY t_start, t_end, score) AS island FROM r), mg AS (SELECT user_id, min(t_start) AS t_start, max(t_end) AS t_end, max(score) AS score, count(*) AS n FROM i GROUP BY user_id, island)"


@collect(QUERIES, ORACLES, f"{_MERGED} SELECT user_id, round(t_start, 6) AS t_start, round(t_end, 6) AS t_end, score, n FROM mg")
def merge_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _spans(spark, sf_dir)
    return intervals.merged(rows, "user_id", 3600.0, F.col("score"), cell=CELL).select("user_id", r6("t_start").alias("t_start"), r6("t_end").alias("t_end"), "score", "n")


@collect(QUERIES, ORACLES, f"WITH {SAMPLES}, fr AS (SELECT DISTINCT user_id, CAST(floor(time_s / 3600) AS BIGINT) AS frame FROM ev), g AS (SELECT *, CASE WHEN frame - lag(frame) OVER (PARTITION BY user_id ORDER BY frame) <= 13 THEN 0 ELSE 1 END AS new FROM fr), i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY frame) AS island FROM g) SELECT user_id, min(frame) / 6.0 AS t_start, (max(frame) + 1) / 6.0 AS t_end FROM i GROUP BY user_id, island HAVING (max(frame) + 1) / 6.0 - min(frame) / 6.0 >= 1")
def frames_to_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = samples(spark, sf_dir).select("user_id", F.floor(F.col("time_s") / 3600).cast("long").alias("frame"))
    return intervals.flagged(frames, "user_id", "frame", 6.0, 2.0, 1.0, CELL / 3600).select("user_id", "t_start", "t_end")


_TWO = "a AS (SELECT * FROM sp WHERE event_type = 'view'), b AS (SELECT * FROM sp WHERE event_type = 'click')"


@collect(QUERIES, ORACLES, f"WITH {SAMPLES}, {_SPANS}, {_TWO} SELECT a.user_id, round(greatest(a.t_start, b.t_start), 6) AS t_start, round(least(a.t_end, b.t_end), 6) AS t_end FROM a JOIN b ON a.user_id = b.user_id AND least(a.t_end, b.t_end) - greatest(a.t_start, b.t_start) >= 1")
def interval_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _spans(spark, sf_dir)
    found = intervals.intersections(rows.where("event_type = 'view'"), rows.where("event_type = 'click'"), "user_id", 7200.0)
    return found.select("user_id", r6("t_start").alias("t_start"), r6("t_end").alias("t_end"))


@collect(QUERIES, ORACLES, f"WITH {SAMPLES}, {_SPANS}, {_TWO}, m AS (SELECT a.user_id, a.event_id AS found_id, b.event_id AS truth_id, greatest(0, least(a.t_end, b.t_end) - greatest(a.t_start, b.t_start)) AS common, (a.t_end - a.t_start) + (b.t_end - b.t_start) AS total FROM a JOIN b USING (user_id)) SELECT user_id, found_id, truth_id, round(common / (total - common), 6) AS iou FROM m WHERE common / (total - common) >= 0.2")
def temporal_iou_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _spans(spark, sf_dir)
    found, truth = rows.where("event_type = 'view'").withColumnRenamed("event_id", "found_id"), rows.where("event_type = 'click'").withColumnRenamed("event_id", "truth_id")
    return intervals.iou_pairs(found, truth, "user_id", 7200.0, 0.2).select("user_id", "found_id", "truth_id", r6("iou").alias("iou"))


@collect(QUERIES, ORACLES, f"{_MERGED} SELECT user_id, round(g.t_start, 6) AS t_start, round(g.t_end, 6) AS t_end, arg_min(event_id, struct_pack(s := -sp.score, i := event_id)) AS event_id FROM mg g JOIN sp USING (user_id) WHERE sp.t_start < g.t_end AND sp.t_end > g.t_start GROUP BY user_id, g.t_start, g.t_end")
def best_window_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _spans(spark, sf_dir)
    best = intervals.best_windows(intervals.merged(rows, "user_id", 3600.0, F.col("score"), cell=CELL), rows, "user_id", "event_id", 7200.0)
    return best.select("user_id", r6("t_start").alias("t_start"), r6("t_end").alias("t_end"), "event_id")


@collect(QUERIES, ORACLES, "WITH t AS (SELECT l_partkey AS track, l_orderkey AS frame, l_quantity AS cx, l_discount * 100 AS cy FROM lineitem), d AS (SELECT track, frame, min(cx) AS cx, min(cy) AS cy FROM t GROUP BY 1, 2) SELECT n.track, n.frame, round(sqrt((n.cx - o.cx) ** 2 + (n.cy - o.cy) ** 2), 6) AS moved FROM d n JOIN d o ON n.track = o.track AND n.frame = o.frame + 10 WHERE sqrt((n.cx - o.cx) ** 2 + (n.cy - o.cy) ** 2) BETWEEN 5 AND 40")
def walking_self_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    tracks = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("track"), F.col("l_orderkey").alias("frame")).agg(F.min("l_quantity").alias("cx"), F.min(F.col("l_discount") * 100).alias("cy"))
    return intervals.displacement(tracks, ["track"], "frame", 10, 5.0, 40.0).select("track", "frame", r6("moved").alias("moved"))
