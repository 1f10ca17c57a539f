"""Exactly-once ingest: snapshot log, chunk ledger, carried samples, migrations."""

import random
import threading

import pytest
from pyspark.sql import functions as F

from lodestar.plans import ledger, legacy, snapshots
from lodestar.streaming import carry

CHUNKS = "video_id string, chunk_index int, expected long"
ROWS = "video_id string, chunk_index int, segment_id string"


def segments(spark, *counts):
    return spark.createDataFrame([(v, c, f"{v}{c}-{i}") for v, c, n in counts for i in range(n)], ROWS)


def states(log, run):
    return {(r.video_id, r.chunk_index): r.status for r in log.chunks(run).collect()}


@pytest.fixture
def log(spark, tmp_path):
    made = ledger.Ledger(spark, str(tmp_path / "runs"))
    made.create("r1", "d", spark.createDataFrame([("a", 0, 2), ("a", 1, 3), ("b", 0, 1)], CHUNKS))
    return made


def ready(log, run):
    for state in ("preflight_passed", "ingesting"):
        log.advance(run, state)


def test_tables_change_together(spark, tmp_path):
    log = snapshots.Snapshots(spark, str(tmp_path))
    names = ("videos", "segments", "metadata", "telemetry")
    assert log.replace({n: spark.range(3) for n in names}) == 1
    # an attempt that broke off before its commit: folders that no version names
    left = [log.stage(spark.range(9), n) for n in names]
    assert [log.read(n).count() for n in names] == [3] * 4
    assert log.upsert({n: (spark.range(2, 5).withColumn("v", F.lit(1)), ["id"]) for n in names}) == 2
    for n in names:
        assert {r.id: r.v for r in log.read(n).collect()} == {0: None, 1: None, 2: 1, 3: 1, 4: 1}
        # a reader of the version before goes on seeing it
        assert log.read(n, 1).count() == 3
    gone = log.vacuum(keep=1)
    assert set(left) <= set(gone) and all(log.read(n).count() == 5 for n in names)


def test_one_of_two_writers_commits(spark, tmp_path):
    log = snapshots.Snapshots(spark, str(tmp_path))
    log.replace({"t": spark.range(1)})
    base = log.version()
    log.commit(base, snapshots.Change(facts={"x": 1}))
    with pytest.raises(snapshots.Conflict):
        log.commit(base, snapshots.Change(facts={"x": 2}))
    assert log.fact("x") == 1
    # concurrent writers each add one; none is lost
    errors = []

    def add(i):
        try:
            snapshots.Snapshots(spark, str(tmp_path)).update(lambda at: snapshots.Change(facts={f"w{i}": at}), attempts=200)
        except Exception as error:
            errors.append(error)

    threads = [threading.Thread(target=add, args=(i,)) for i in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    facts = log.state()["facts"]
    assert not errors and sorted(facts[f"w{i}"] for i in range(8)) == list(range(base + 1, base + 9))


def test_resume_skips_committed_chunks(spark, log):
    token, held = log.begin("r1", spark.createDataFrame([("a", 0), ("b", 0)], "video_id string, chunk_index int"))
    assert sorted((r.video_id, r.chunk_index) for r in held.collect()) == [("a", 0), ("b", 0)]
    assert log.commit("r1", token, {"segments": segments(spark, ("a", 0, 2), ("b", 0, 1))}) == {"committed": 2, "failed": 0}
    # a writer that goes away in the middle: its rows are never seen
    lost, _ = log.begin("r1")
    log.log.stage(segments(spark, ("a", 1, 1)), "segments")
    assert states(log, "r1") == {("a", 0): "committed", ("b", 0): "committed", ("a", 1): "writing"}
    assert log.begin("r1")[1].count() == 0
    token, held = log.begin("r1", take_over=True)
    assert [(r.video_id, r.chunk_index, r.expected) for r in held.collect()] == [("a", 1, 3)]
    # the lost one comes back: its chunks are another's now
    assert log.commit("r1", lost, {"segments": segments(spark, ("a", 1, 3))}) == {"committed": 0, "failed": 0}
    assert log.commit("r1", token, {"segments": segments(spark, ("a", 1, 3))}) == {"committed": 1, "failed": 0}
    assert log.commit("r1", token, {"segments": segments(spark, ("a", 1, 3))}) == {"committed": 0, "failed": 0}
    assert log.rows("segments", run="r1").count() == 6


def test_wrong_counts_fail_a_chunk(spark, log):
    token, _ = log.begin("r1")
    rows = segments(spark, ("a", 0, 2), ("a", 1, 2), ("b", 0, 1), ("z", 7, 4))
    assert log.commit("r1", token, {"segments": rows, "vectors_64": rows}) == {"committed": 2, "failed": 1}
    assert states(log, "r1")[("a", 1)] == "failed"
    assert sorted({(r.video_id, r.chunk_index) for r in log.rows("vectors_64", run="r1").collect()}) == [("a", 0), ("b", 0)]
    ready(log, "r1")
    told = log.finalize("r1", ["segments"])
    assert told["status"] == "failed" and not told["active_changed"] and told["errors"] == {"incomplete_chunks": 1, "segments": {"expected": 6, "actual": 3}}
    assert log.active("d") is None
    # a failed run goes on with what it lacks
    log.advance("r1", "ingesting")
    token, held = log.begin("r1")
    assert held.count() == 1
    log.commit("r1", token, {"segments": segments(spark, ("a", 1, 3)), "vectors_64": segments(spark, ("a", 1, 3))})
    assert log.finalize("r1", ["segments", "vectors_64"], {"segments": "segment_id"})["status"] == "completed"
    assert log.active("d") == "r1" and log.run("r1")["status"] == "completed"
    with pytest.raises(ValueError, match="active"):
        log.begin("r1")
    with pytest.raises(ValueError, match="no way"):
        log.advance("r1", "ingesting")


def test_old_run_stays_until_the_new_one_is_whole(spark, log):
    token, _ = log.begin("r1")
    log.commit("r1", token, {"segments": segments(spark, ("a", 0, 2), ("a", 1, 3), ("b", 0, 1))})
    ready(log, "r1")
    log.finalize("r1", ["segments"])
    before = log.log.version()
    log.create("r2", "d", spark.createDataFrame([("a", 0, 1)], CHUNKS))
    ready(log, "r2")
    token, _ = log.begin("r2")
    twice = spark.createDataFrame([("a", 0, "same")] , ROWS)
    log.commit("r2", token, {"segments": twice})
    assert log.rows("segments", "d").count() == 6
    assert log.finalize("r2", ["segments"], {"segments": "segment_id"})["active_changed"]
    assert log.rows("segments", "d").count() == 1 and log.rows("segments", "d", version=before).count() == 6


def test_states_are_rewritten_as_one(spark, log, monkeypatch):
    monkeypatch.setattr(ledger, "FOLDERS", 3)
    for _ in range(4):
        log.begin("r1", take_over=True)
    assert len(log.log.state()["tables"]["_chunks"]) <= 3 and set(states(log, "r1").values()) == {"writing"}


SAMPLES = "id int, k string, t double, v double"
PARTS = [[(1, "a", 1.0, 5.0), (2, "a", 3.0, 6.0), (3, None, 2.0, 7.0), (4, "b", None, 8.0)], [(5, "a", 3.0, 1.0), (6, None, 9.0, 2.0), (7, "c", 0.0, 3.0), (8, "b", 1.0, 4.0)], [(9, "a", 4.0, 0.0), (10, "c", 0.5, 1.0)]]


def previous(spark, folder, out, seen, files=1):
    stream = spark.readStream.schema(SAMPLES).option("maxFilesPerTrigger", files).parquet(folder)
    return carry.with_previous(stream, out, seen, "k", "t", "v")


def test_samples_across_batches(spark, tmp_path):
    """Batches of any size, a restart and a new checkpoint give the same rows; an older
    sample is an error."""
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    for rows in PARTS:
        spark.createDataFrame(rows, SAMPLES).coalesce(1).write.mode("append").parquet(folder)
        got = previous(spark, folder, out, str(tmp_path / "seen"))
    first = {1: None, 2: 5.0, 3: None, 4: None, 5: 6.0, 6: 7.0, 7: None, 8: 8.0, 9: 1.0, 10: 3.0}
    assert sorted((r.id, r.previous) for r in got.collect()) == sorted(first.items())
    # all files at once, under a new checkpoint: samples of one time stand by value
    again = previous(spark, folder, out, str(tmp_path / "other"), 100)
    assert sorted((r.id, r.previous) for r in again.collect()) == sorted((first | {2: 1.0, 5: 5.0, 9: 6.0}).items())
    spark.createDataFrame([(11, "c", 0.1, 1.0)], SAMPLES).write.mode("append").parquet(folder)
    with pytest.raises(Exception, match="older"):
        previous(spark, folder, out, str(tmp_path / "other"))


def test_kill_between_write_and_commit(spark, tmp_path, monkeypatch):
    folder, out, seen = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "seen")
    for rows in PARTS:
        spark.createDataFrame(rows, SAMPLES).coalesce(1).write.mode("append").parquet(folder)
    whole, calls = snapshots.Snapshots.update, []

    def dies(self, change, attempts=50):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("killed")
        return whole(self, change, attempts)

    monkeypatch.setattr(snapshots.Snapshots, "update", dies)
    with pytest.raises(Exception, match="killed"):
        previous(spark, folder, out, seen)
    monkeypatch.setattr(snapshots.Snapshots, "update", whole)
    assert len(snapshots.Snapshots(spark, out).store.names("data")) == 2
    got = previous(spark, folder, out, seen)
    assert sorted(r.id for r in got.collect()) == list(range(1, 11))


def brute_windows(rows, size, gap, until):
    out = []
    for k in {r[0] for r in rows}:
        own = sorted(r[1:] for r in rows if r[0] == k)
        for w in sorted({int(t // size) for t, _ in own}):
            ends = []
            for edge in (w * size, (w + 1) * size):
                before = [(t, v) for t, v in own if t < edge]
                after = [(t, v) for t, v in own if t >= edge]
                value = None
                if after and after[0][0] == edge:
                    value = after[0][1]
                elif before and after and edge - before[-1][0] <= gap and after[0][0] - edge <= gap:
                    (a, x), (b, y) = before[-1], after[0]
                    value = x + (y - x) * (edge - a) / (b - a)
                ends.append((value, bool(after)))
            if ends[1][1] or (w + 1) * size + gap <= until:
                out.append((k, w * size, ends[0][0], ends[1][0], sum(int(t // size) == w for t, _ in own)))
    return sorted(out, key=str)


@pytest.mark.parametrize("cuts", [(100.0,), (10.0, 21.0, 30.5, 100.0)])
def test_window_edges(spark, tmp_path, cuts):
    rows = [("a", 0.0, 1.0), ("a", 9.5, 3.0), ("a", 10.5, 5.0), ("a", 20.0, 7.0), ("a", 33.0, 9.0), ("a", 34.0, 9.0), ("b", 1.0, 2.0), ("b", 52.0, 4.0), ("c", 60.0, 0.0)]
    folder, low, got = str(tmp_path / "in"), -1.0, None
    for cut in cuts:
        spark.createDataFrame([r for r in rows if low < r[1] <= cut], "k string, t double, v double").coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema("k string, t double, v double").parquet(folder)
        got = carry.window_edges(stream, str(tmp_path / "out"), str(tmp_path / "seen"), "k", "t", "v", 10.0, 5.0)
        low = cut
    assert sorted((tuple(r) for r in got.select("k", "t_start", "head", "tail", "n").collect()), key=str) == brute_windows(rows, 10.0, 5.0, 60.0)


BIG = 2**53


def long_series(seed):
    """Samples of series whose keys are one number as floats, and of the null series."""
    found, rng = [], random.Random(seed)
    for k in (None, *range(BIG, BIG + 40)):
        for t in sorted(rng.sample(range(100), rng.randint(1, 12))):
            found.append((BIG + len(found), k, t / 1.0, float(rng.randint(0, 9))))
    return found


def in_two(spark, folder, rows, schema):
    for part in ([r for r in rows if r[-2] <= 50], [r for r in rows if r[-2] > 50]):
        spark.createDataFrame(part, schema).repartition(2).write.mode("append").parquet(folder)
        yield spark.readStream.schema(schema).parquet(folder)


def test_series_are_served_in_groups(spark, tmp_path):
    """However many series, Python is called for a bounded number of groups a batch."""
    many = spark.range(20000).selectExpr("nullif(id, 7) AS k", "double(id) AS t", "double(id) AS v")
    groups = {r[0]: r[1] for r in carry._dealt(many, "k").groupBy(carry._GROUP).count().collect()}
    assert len(groups) <= carry._GROUPS + 1 and groups[-1] == 1


def test_previous_of_series_in_one_group(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(carry, "_GROUPS", 3)
    rows = [*long_series(1), (None, 5, 1.0, 1.0)]
    for stream in in_two(spark, str(tmp_path / "in"), rows, "id long, k long, t double, v double"):
        got = carry.with_previous(stream, str(tmp_path / "out"), str(tmp_path / "seen"), "k", "t", "v")
    expected = [(*r, max(((o[2], o[3]) for o in rows if o[1] == r[1] and o[2] < r[2]), default=(0, None))[1]) for r in rows]
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(expected, key=str)


def test_window_edges_of_series_in_one_group(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(carry, "_GROUPS", 3)
    rows = [r[1:] for r in long_series(2)]
    for stream in in_two(spark, str(tmp_path / "in"), rows, "k long, t double, v double"):
        got = carry.window_edges(stream, str(tmp_path / "out"), str(tmp_path / "seen"), "k", "t", "v", 10.0, 5.0)
    assert got.schema["k"].dataType.simpleString() == "bigint"
    expected = brute_windows(rows, 10.0, 5.0, max(t for _, t, _ in rows))
    assert sorted((tuple(r) for r in got.select("k", "t_start", "head", "tail", "n").collect()), key=str) == expected


def test_migration(spark, tmp_path):
    tables = {
        "videos": spark.createDataFrame([("d", "v1", "uri", 9.0), ("d", "v2", None, None), ("e", "v9", "x", 1.0)], "dataset_id string, video_id string, source_uri string, duration_s double"),
        "segments": spark.createDataFrame([("s1", "d", "v1"), ("s2", "d", "v1"), ("s3", "e", "v9")], "segment_id string, dataset_id string, video_id string"),
        "metadata": spark.createDataFrame([("s1", 3), ("s3", 4)], "segment_id string, cars int"),
        "telemetry": spark.createDataFrame([("s2", 1.5)], "segment_id string, altitude_m double"),
        "groundtruth": spark.createDataFrame([("d", "q", "s1")], "dataset_id string, query_id string, segment_id string"),
    }
    vectors = {2: spark.createDataFrame([("s1", "d", float("nan"), [1.0, 0.0]), ("s3", "e", 1.0, [0.0, 1.0])], "segment_id string, dataset_id string, altitude_m double, v array<double>")}
    log = snapshots.Snapshots(spark, str(tmp_path))
    run, counts = legacy.migrate(log, tables, vectors, "d", "h", ("altitude_m",))
    assert counts == {"run_videos": 2, "run_segments": 2, "run_metadata": 1, "run_telemetry": 1, "run_groundtruth": 1, "run_vectors_2": 1, "chunks": 1}
    assert legacy.migrate(log, tables, vectors, "d", "h") == (run, counts) and log.version() == 1
    assert legacy.legacy_run_id("d", "h") == run != legacy.legacy_run_id("d", "other")
    assert log.read("run_vectors_2").first().altitude_m is None and log.read("run_telemetry").first().extra == "{}"
    chunk = log.read("chunks").first()
    assert (chunk.video_id, chunk.expected, chunk.chunk_end_s, chunk.status) == ("v1", 2, 9.0, "committed")
