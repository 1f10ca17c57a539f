import math
import random
import uuid

import pytest
from pyspark.sql import functions as F

from lodestar.functions import scalars, vectors
from lodestar.operators import intervals, metadata, metrics, predicates, search, timeline
from lodestar.plans import planning, runs


def test_merge_keeps_the_running_end(spark):
    df = spark.createDataFrame([("a", 0.0, 100.0), ("a", 10.0, 20.0), ("a", 105.0, 110.0), ("a", 121.0, 130.0)], "v string, t_start double, t_end double")
    assert sorted(tuple(r) for r in intervals.merged(df, "v", 10.0).select("t_start", "t_end", "n").collect()) == [(0.0, 110.0, 3), (121.0, 130.0, 1)]


def test_flags_match_a_plain_model(spark):
    rng = random.Random(3)
    series = {k: [rng.random() < 0.3 for _ in range(80)] for k in range(10)}
    fps, gap, least = 5.0, 1.0, 0.4
    df = spark.createDataFrame([(k, f) for k, s in series.items() for f, on in enumerate(s) if on], "k int, f int")
    got = sorted((r.k, round(r.t_start, 6), round(r.t_end, 6)) for r in intervals.flagged(df, "k", "f", fps, gap, least).collect())
    want = []
    for k, s in series.items():
        on = [f for f, x in enumerate(s) if x]
        start = last = None
        for f in [*on, None]:
            if start is not None and (f is None or f - last > int(gap * fps) + 1):
                if (last + 1 - start) / fps >= least:
                    want.append((k, round(start / fps, 6), round((last + 1) / fps, 6)))
                start = f
            elif start is None:
                start = f
            last = f
    assert got == sorted(want)


def test_window_median_counts_ends_twice(spark):
    samples = spark.createDataFrame([("a", 0.0, 1.0), ("a", 10.0, 5.0)], "v string, time_s double, x double")
    windows = spark.createDataFrame([("a", 0.0, 10.0)], "v string, t_start double, t_end double")
    field = timeline.Measure("x")
    assert timeline.window_values(windows, samples, field, "v", 20.0, 10.0).count() == 4
    assert timeline.summarized(windows, samples, field, "v", 20.0, 10.0).first().x == 3.0


def test_no_sample_is_no_value(spark):
    samples = spark.createDataFrame([], "v string, time_s double, x double")
    windows = spark.createDataFrame([("a", 0.0, 10.0)], "v string, t_start double, t_end double")
    assert timeline.summarized(windows, samples, timeline.Measure("x"), "v", 20.0, 10.0).first().x is None


def test_filters():
    fields = {"a": "integer", "b": "boolean", "d": "circular"}
    assert [p.field for p in predicates.predicates(fields, {"a": 0, "b": False, "d": None})] == ["a", "b"]
    assert predicates.predicates(fields, {"d": (300, 20)})[0].wrap
    with pytest.raises(ValueError):
        predicates.predicates(fields, {"x": 1})


def test_uuid5(spark):
    got = spark.range(5).select(scalars.uuid5(uuid.NAMESPACE_DNS, F.col("id").cast("string")).alias("u")).collect()
    assert [r.u for r in got] == [str(uuid.uuid5(uuid.NAMESPACE_DNS, str(i))) for i in range(5)]


def test_circles(spark):
    df = spark.createDataFrame([(350.0,), (10.0,)], "a double")
    assert math.isclose(df.agg(scalars.circular_mean("a").alias("m")).first().m % 360, 0, abs_tol=1e-6)
    row = spark.range(1).select(scalars.circular_interpolate(F.lit(350.0), F.lit(20.0), F.lit(0.5)).alias("x")).first()
    assert math.isclose(row.x, 5.0)


def test_zero_vectors(spark):
    df = spark.createDataFrame([([0.0, 0.0],), ([3.0, 4.0],), (None,)], "v array<double>")
    assert [r.c for r in df.select(vectors.cosine("v", vectors.literal([1.0, 0.0])).alias("c")).collect()] == [0.0, 0.6, None]
    assert [r.s for r in df.select(vectors.shorten("v", 2).alias("s")).collect()] == [None, [0.6, 0.8], None]


def test_prefilter_is_never_short(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0], i % 7) for i in range(50)], "vec_id long, embedding array<double>, g int")
    assert search.prefilter(df, [0.0, 1.0], 5, F.col("g") == 6).count() == 5
    assert search.postfilter(df, [0.0, 1.0], 5, F.col("g") == 6, fetch=1).count() == 0


def test_many_takes_any_number_of_queries(spark):
    """Beyond a broadcast, without and with Spark's own choice of one."""
    rows = [(i, [math.cos(i), math.sin(i)]) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = [(i, [math.cos(i / 7), math.sin(i / 7)]) for i in range(1203)]
    queries = spark.createDataFrame(asked, "query_id long, query array<double>")
    want = {q: [i for _, i in sorted((1 - sum(a * b for a, b in zip(v, e, strict=True)), i) for i, e in rows)[:3]] for q, v in asked}
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        for threshold in (before, "-1"):
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
            got = {}
            for r in search.many(df, queries, 3).orderBy("query_id", "rank").collect():
                got.setdefault(r.query_id, []).append(r.vec_id)
            assert got == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_greedy_takes_the_first_free_span(spark):
    found = spark.createDataFrame([("q", 1, "v", 0.0, 10.0), ("q", 2, "v", 0.0, 10.0), ("q", 3, "w", 0.0, 10.0)], "query_id string, rank int, video string, t_start double, t_end double")
    truth = spark.createDataFrame([("q", "v", 0.0, 9.0)], "query_id string, video string, t_start double, t_end double")
    hits = metrics.greedy_hits(found, truth)
    assert [r.hit for r in hits.orderBy("rank").collect()] == [True, False, False]
    row = metrics.ranked_metrics(hits).first()
    assert (row.mrr, row.map, row.recall_1) == (1.0, 1.0, 1.0)


def test_bootstrap_covers_the_mean(spark):
    rng = random.Random(1)
    df = spark.createDataFrame([(rng.gauss(1, 1), 0.0) for _ in range(400)], "a double, b double")
    row = metrics.paired_bootstrap(df, "a", "b", resamples=200).first()
    assert row.ci_lo < row.mean_diff < row.ci_hi and row.ci_hi - row.ci_lo < 0.4


def test_enrichment_can_write_null(spark):
    rows = spark.createDataFrame([(1, 5), (2, 6)], "id int, n int")
    found = spark.createDataFrame([(1, None)], "id int, n int")
    assert sorted((r.id, r.n) for r in metadata.enriched(rows, found, ["id"], ["n"]).collect()) == [(1, None), (2, 6)]


def test_plan_of_a_query(spark):
    asked = spark.createDataFrame([(1, "at least 3 buses and people at night"), (2, "otobüsü"), (3, None)], "query_id int, text string")
    found = planning.most_specific(planning.matched(asked, planning.concepts(spark))).collect()
    assert sorted((r.query_id, r.concept, r.least) for r in found) == [(1, "bus", 3), (1, "night", 1), (1, "person", 1)]


def test_runs(spark, tmp_path):
    store = runs.Runs(spark, str(tmp_path), "segments")
    rows = spark.createDataFrame([("v", 0, 1), ("v", 1, 2)], "video_id string, chunk_index int, x int")
    expected = rows.groupBy("video_id", "chunk_index").count().withColumnRenamed("count", "n")
    for _ in range(2):
        store.write_chunk(rows, "d", "r1")
    store.activate("d", "r1", expected)
    assert store.active("d") == "r1" and store.rows("d").count() == 2
    with pytest.raises(ValueError):
        store.write_chunk(rows, "d", "r1")
    store.write_chunk(rows.limit(1), "d", "r2")
    with pytest.raises(ValueError):
        store.activate("d", "r2", expected)


def test_frame_on_an_edge(spark):
    """The length is not taken from the two ends, which would round it once more."""
    spans = [(4.0, 31020.0), (23.0, 50040.0), (10.0, 45480.83)]
    rows = spark.createDataFrame(spans, "s double, p double")
    got = rows.select(timeline.frame_indices(F.col("s"), F.col("p") / 1000, 25.0, 4).alias("f")).collect()
    assert [r.f for r in got] == [[int((s + p / 1000 / 3 * i) * 25) for i in range(4)] for s, p in spans]


def test_half_turn_just_below(spark):
    """A remainder just below 0 is half a turn to the right, as 360 is added to it."""
    row = spark.range(1).select(scalars.circular_interpolate(F.lit(252.10000000000002), F.lit(72.1), F.lit(0.25)).alias("x")).first()
    assert abs(row.x - 297.1) < 1e-6


def test_direction_just_below_north(spark):
    """A mean direction a little below 360 degrees stays there, as in SQL."""
    samples = spark.createDataFrame([(1, 0.0, 360 - 5e-10), (1, 50.0, 360 - 5e-10)], "k int, time_s double, a double")
    windows = spark.createDataFrame([(1, 0.0, 50.0)], "k int, t_start double, t_end double")
    got = timeline.summarized(windows, samples, timeline.Measure("a", "circular"), "k", 100.0, 50.0).first()
    assert 0 < 360 - got.a < 1e-9
