"""Requests, cells, features, manifests, shards and runs on small cases."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.operators import cells, features, intervals, metadata, metrics, search, series, timeline
from lodestar.operators import timeline as T
from lodestar.functions import scalars
from lodestar.plans import benches, planning, request, runs
from lodestar.sources import inventory, manifests, shards
from lodestar.streaming import ingest


@pytest.fixture(scope="module")
def store(spark):
    rows = [(i, [float(np.cos(i / 10)), float(np.sin(i / 10))], i % 5, i % 2 == 0, float(i * 20), float(i * 20 + 15)) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, cars int, night boolean, t_start double, t_end double")
    return request.Store(df, {"cars": "integer", "night": "boolean", "buses": "integer"}, planning.concepts(spark).withColumn("field", F.expr("case field when 'vehicle_count' then 'cars' when 'is_night' then 'night' when 'bus_count' then 'buses' else field end")))


def ask(spark, store, **options):
    hits, told = request.run(spark, request.Request([1.0, 0.0], **options), store, key_col="night")
    return hits.collect(), told


def test_request_plans_and_filters(spark, store):
    hits, told = ask(spark, store, text="At least 3 ARABALAR at night, otob\u00fcs", parser="rules", top_k=4)
    assert [h.vec_id for h in hits] == [0, 2, 4, 6] and [h.rank for h in hits] == [1, 2, 3, 4]
    # a bus is more specific than a vehicle, but no row has its field
    assert told["plan"]["dropped"] == ["buses"] and told["filters"] == {"night": True}
    assert told["filter_correct"] and told["returned_count"] == 4


def test_request_plans_and_filters_without_bus(spark, store):
    hits, told = ask(spark, store, text="at least 3 cars", parser="rules", top_k=3)
    assert [h.vec_id for h in hits] == [3, 4, 8] and told["filters"] == {"cars": {"min": 3}} and told["candidate_count"] == 16


def test_explicit_filters_win_and_stay(spark, store):
    hits, told = ask(spark, store, text="at least 9 cars", parser="rules", filters={"night": True}, relaxation="auto_soft", top_k=3)
    assert [h.vec_id for h in hits] == [0, 2, 4] and told["applied_pass"] == 4
    assert [p["matching"] for p in told["passes"]] == [0, 0, 0, 20]
    _, told = ask(spark, store, text="at least 9 cars", parser="rules", filters={"cars": (1, 2)}, top_k=3)
    assert told["filters"] == {"cars": (1, 2)} and told["candidate_count"] == 16 and told["passes"] == []
    _, told = ask(spark, store, filters={"cars": 77}, top_k=3)
    assert told["underfilled"] and told["underfilled_reason"] == "candidate_shortage" and told["returned_count"] == 0 and told["filter_correct"]


def test_more_than_top_k_is_never_enough(spark, store):
    told = ask(spark, store, least=5, top_k=3, relaxation="diagnose_only")[1]
    assert not any(p["enough"] for p in told["passes"]) and told["applied_pass"] == 1


def test_answers_are_checked(spark, store):
    good = {"constraints": [{"field": "cars", "operator": "gte", "value": 4}, {"field": "buses", "operator": "gte", "value": 1}]}
    assert ask(spark, store, parser="response", answer=json.dumps(good), top_k=2)[1]["filters"] == {"cars": {"min": 4.0}}
    odd = {"field": "cars", "operator": "gte", "value": 4}
    for bad in ([], 3, "null", {"constraints": [1]}, {"constraints": None}, {"constraints": {}}, {"constraints": [odd | {"confidence": None}]}, {"constraints": [odd | {"confidence": "high"}]}, {"constraints": [odd | {"operator": "range", "value": [9, 3]}]}, {"constraints": [odd | {"operator": "range", "value": [1, None]}]}, {"constraints": [odd | {"value": None}]}, {"constraints": [odd | {"value": True}]}, {"constraints": [{}]}, {"constraints": [odd, {"field": None}]}, {"constraints": [{"field": "night", "operator": "eq", "value": "yes"}]}, "no json", {"constraints": [{"field": "wheels", "operator": "eq", "value": 1}]}, {"constraints": [{"field": "night", "operator": "gte", "value": 1}]}, {"constraints": [{"field": "cars", "operator": "like", "value": 1}]}, {"constraints": [{"field": "cars", "operator": "range", "value": [1]}]}, {"constraints": [{"field": "cars", "operator": "gte", "value": "x"}]}):
        told = ask(spark, store, parser="response", answer=bad if isinstance(bad, str) else json.dumps(bad), top_k=2)[1]
        assert told["plan"]["failure"] and told["plan"]["parser"] == "none" and told["candidate_count"] == 40


def test_exact_filters(spark, store):
    hits, told = ask(spark, store, filters={"cars": (2, 3)}, strategy="exact", top_k=4)
    assert [h.vec_id for h in hits] == [2, 3, 7, 8] and told["candidate_count"] == 16 and told["filter_correct"]
    rows = store.rows.where("vec_id < 10").select("vec_id")
    got = search.search(store.rows, [1.0, 0.0], 5, "candidates", F.col("cars") == 4, ids=rows).collect()
    assert [r.vec_id for r in got] == [4, 9]
    assert search.search(store.rows, [1.0, 0.0], 5, "candidates", ids=rows.limit(0)).count() == 0


def test_filters_of_merged_hits_are_checked(spark, store, monkeypatch):
    """A search that loses the filter is told of, merged or not."""
    monkeypatch.setattr(request, "PATIENCE_S", 0.2)
    monkeypatch.setattr(search, "prefilter", lambda rows, query, k, where, **c: search.exact(store.rows, query, k, **c))
    for gap in (None, 25.0):
        assert not ask(spark, store, filters={"cars": 1}, merge_gap=gap, top_k=4)[1]["filter_correct"]


def test_merged_hits(spark, store):
    hits, told = ask(spark, store, merge_gap=25.0, top_k=5)
    assert [(h.night, h.t_start, h.n) for h in hits] == [(True, 0.0, 20), (False, 20.0, 20)] and told["underfilled_reason"] == "merged"


def test_cells(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((600, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [1.0])], "vec_id long, embedding array<double>")
    centres = cells.centroids(df.where("size(embedding) = 8"), 6)
    index = cells.placed(df, centres).cache()
    assert index.count() == 600
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = np.lexsort([np.arange(600), 1 - unit @ unit[5]])[:10].tolist()
    assert [r.vec_id for r in cells.approximate(index, centres, x[5].tolist(), 10, 6).collect()] == want
    asked = df.where("vec_id < 20").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    recall = []
    for probes in (1, 3, 6):
        got = {}
        for r in cells.approximate_many(index, asked, centres, 10, probes).collect():
            got.setdefault(r.query_id, set()).add(r.vec_id)
        recall.append(np.mean([len(got[q] & set(np.lexsort([np.arange(600), 1 - unit @ unit[q]])[:10].tolist())) / 10 for q in range(20)]))
    assert recall[0] < recall[1] < recall[2] == 1.0 and recall[1] > 0.7


def test_positions_and_units(spark):
    rows = spark.range(1000).selectExpr("id * 7 % 1000 as k").repartition(5)
    got = features.positions(rows, "k").collect()
    assert all(r.k == r.position for r in got) and len(got) == 1000
    # all columns stay, whatever is read of them; a value that half of the rows share
    wide = rows.select((F.col("k") / 2).cast("int").alias("half"), F.when(F.col("k") < 500, 0).otherwise(F.col("k")).alias("hot"), "k", F.lit("x").alias("a"), F.lit(2.5).alias("b"), F.col("k").cast("string").alias("c"))
    placed = features.positions(wide, ["hot", "k"])
    got = placed.collect()
    assert placed.columns == [*wide.columns, "position"] and sorted(r.position for r in got) == list(range(1000))
    assert all(r.position == r.k and r.c == str(r.k) and r.half == r.k // 2 for r in got)
    assert placed.select("position").distinct().count() == 1000 and features.positions(rows.limit(0), "k").count() == 0
    df = spark.createDataFrame([(1, i, c) for i, c in enumerate("aabbbax")] + [(2, 0, None), (2, 1, None), (2, 2, "a")], "g int, t int, c string")
    got = sorted(((r.g, r.run, r.c, r.n, r.first, r["last"]) for r in features.units(df, "g", ["t"], "c").collect()), key=str)
    assert got == sorted([(1, 1, "a", 2, 0, 1), (1, 2, "b", 3, 2, 4), (1, 3, "a", 1, 5, 5), (1, 4, "x", 1, 6, 6), (2, 1, None, 2, 0, 1), (2, 2, "a", 1, 2, 2)], key=str)


def test_contracts_and_inventory(spark, tmp_path):
    rows = spark.createDataFrame([("a",), ("a",), ("b",), ("c",)], "k string")
    expected = spark.createDataFrame([("a", 2), ("b", 2), ("d", 1)], "k string, n long")
    assert {(r.k, r.found, r.n) for r in features.count_contract(rows, "k", expected).collect()} == {("b", 1, 2), ("c", 1, None), ("d", None, 1)}
    (tmp_path / "sub").mkdir()
    (tmp_path / "x.txt").write_text("one")
    (tmp_path / "sub" / "y.txt").write_text("two")
    found = inventory.inventory(spark, str(tmp_path))
    assert {(r.name, r.bytes) for r in found.collect()} == {("x.txt", 3), ("sub/y.txt", 3)}
    assert features.differing(found, found).count() == 0
    assert {(r.name, r.side) for r in features.differing(found, found.where("name = 'x.txt'")).collect()} == {("sub/y.txt", "found")}


def test_long_chunk_hash(spark):
    """A chunk is folded as its rows come, whatever batches they come in."""
    import hashlib

    rows = spark.range(30000).select((F.col("id") % 7 == 0).alias("k"), (30000 - F.col("id")).alias("o"), F.when(F.col("id") % 11 != 0, F.concat(F.lit("é"), "id")).alias("t"))
    got = {r.k: (r.n, r.hash) for r in metadata.content_hash(rows.repartition(5), ["k"], "o", F.col("t")).collect()}
    for k in (True, False):
        own = [i for i in range(29999, -1, -1) if (i % 7 == 0) == k]
        text = "".join(f"é{i}" for i in own if i % 11)
        assert got[k] == (len(own), hashlib.sha256(text.encode()).hexdigest())
    nulls = spark.createDataFrame([(None, 1, "a"), (None, 0, "b"), ("x", 0, None)], "k string, o int, t string")
    assert {r.k: (r.n, r.hash) for r in metadata.content_hash(nulls, ["k"], "o", F.col("t")).collect()} == {None: (2, hashlib.sha256(b"ba").hexdigest()), "x": (1, hashlib.sha256(b"").hexdigest())}
    assert metadata.content_hash(nulls.limit(0), ["k"], "o", F.col("t")).count() == 0


def test_cells_of_zero_vectors(spark):
    rows = [(0, [0.0, 0.0]), (1, None), (2, [1.0, float("nan")]), (3, [1.0, None]), *((i, [float(i), 1.0]) for i in range(4, 40))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    centres = cells.centroids(df, 4)
    index = cells.placed(df, centres)
    assert sorted(r.vec_id for r in index.collect()) == list(range(4, 40))
    asked = df.where("vec_id in (0, 1, 5)").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    got = cells.approximate_many(index, asked, centres, 3, 4).collect()
    assert {r.query_id for r in got} == {5} and [r.vec_id for r in sorted(got, key=lambda r: r["rank"])][0] == 5
    with pytest.raises(ValueError, match="direction"):
        cells.centroids(df.where("vec_id < 4"), 2)


def test_many_contrasts(spark, monkeypatch):
    monkeypatch.setattr(metadata, "MOST_COUNTS", 3)
    rows = spark.createDataFrame([(f"s{i}", max(0, i - 4)) for i in range(12)], "s string, n int")
    got = metadata.count_contrasts(rows, "s", "n").collect()
    assert sum(r.side == "negative" for r in got) == 5 * 7 and sum(r.side == "positive" for r in got) == 7


def test_neighbours_across_cells(spark, monkeypatch):
    monkeypatch.setattr(series, "LONG", 0)
    rng = np.random.default_rng(1)
    times = sorted(rng.uniform(0, 1000, 60).tolist()) + [500.0]
    samples = spark.createDataFrame([("a", t, i) for i, t in enumerate(times)] + [("b", 3.0, 0)], "k string, time_s double, v int")
    points = spark.createDataFrame([("a", float(p)) for p in (-5, 0, 130, 500, 777, 2000)] + [("b", 900.0), ("c", 1.0)], "k string, at double")
    want = sorted(map(str, T.neighbours(points, samples, ["v"], "k").collect()))
    for cell in (1.0, 37.0, 5000.0):
        assert sorted(map(str, T.neighbours(points, samples, ["v"], "k", cell=cell).collect())) == want


def test_turn_just_below_half(spark):
    row = spark.range(1).select(scalars.circular_interpolate(F.lit(128.2), F.lit(308.19999999999993), F.lit(0.5)).alias("x")).first()
    assert abs(row.x - 218.2) < 1e-6


def test_greedy_and_thresholds(spark):
    found = spark.createDataFrame([(1, 1, "a", 0.0, 10.0), (1, 2, "a", 1.0, 11.0), (1, 3, "b", 0.0, 5.0), (2, 1, "a", 0.0, 1.0)], "query_id int, rank int, video string, t_start double, t_end double")
    truth = spark.createDataFrame([(1, "a", 0.0, 10.0), (1, "b", 50.0, 60.0), (1, "a", 40.0, 50.0)], "query_id int, video string, t_start double, t_end double")
    got = {(r.query_id, r["rank"]): (r.hit, r.n_gt) for r in metrics.greedy_hits(found, truth).collect()}
    assert got == {(1, 1): (True, 3), (1, 2): (False, 3), (1, 3): (False, 3), (2, 1): (False, 0)}
    values = spark.createDataFrame([(float(v),) for v in [5, 1, 4, 2, 3, 3]] + [(None,)], "v double")
    assert [round(r.threshold, 6) for r in metrics.thresholds(values, "v", (0.5, 0.1)).orderBy("level", ascending=False).collect()] == [3.0, 1.5]
    assert metrics.thresholds(values.where("v > 99"), "v", (0.5,)).first().threshold is None


def test_repeatable(spark):
    assert benches.repeatable(lambda: spark.range(5)).first().repeatable
    flip = iter([spark.range(5), spark.range(1, 7)])
    row = benches.repeatable(lambda: next(flip)).first()
    assert (row.only_first, row.only_second, row.repeatable) == (1, 2, False)


MANIFEST = {
    "schema_version": 1,
    "dataset_id": "flights",
    "source": {"videos_glob": "videos/**/*.mp4"},
    "time_alignment": {"telemetry_clock": "relative_s", "max_gap_s": 1.5},
    "window": {"size_s": 6, "stride_s": 3, "frames_per_item": 6, "partial_window_policy": "pad_last"},
    "telemetry": {
        "timestamp_column": "time",
        "fields": {
            "altitude_m": {"source": "ALT", "scale": 0.001, "reference": "MSL"},
            "yaw": {"source": "hd.g", "type": "circular_deg", "offset": 10},
            "is_night": {"source": "night", "type": "boolean"},
            "person_count": {"source": "sat", "type": "integer"},
        },
        "extra": {"mode": {"source": "mode", "type": "categorical"}, "raw_alt": {"source": "ALT"}},
    },
}


def changed(path, value):
    """The manifest with one value changed."""
    made = json.loads(json.dumps(MANIFEST))
    *way, last = path.split(".")
    at = made
    for part in way:
        at = at.setdefault(part, {})
    at[last] = value
    return made


def test_manifest(spark, tmp_path):
    (tmp_path / "m.yaml").write_text(json.dumps(MANIFEST, indent=1))
    m = manifests.load(spark, str(tmp_path / "m.yaml"))
    assert (m.dataset, m.size_s, m.partial, m.max_gap_s, m.absolute) == ("flights", 6.0, "pad_last", 1.5, False)
    assert m.registry()["yaw"] == "circular" and len(m.hash) == 64 and m.columns()["raw_alt"] == "ALT"
    rows = spark.createDataFrame([("1", "1500", "355", "yes", "x", "2.9"), ("2", "nan", " ", "", "", "oops"), ("3", "-1", "-20", "0", "y", "-2.9")], ["time", "ALT", "hd.g", "night", "mode", "sat"])
    a, b, c = m.project(rows).collect()
    assert (a.altitude_m, a.yaw, a.is_night, a.mode, a.person_count, a.raw_alt) == (1.5, 5.0, True, "x", 2, 1500.0)
    assert (b.altitude_m, b.yaw, b.is_night, b.mode, b.person_count) == (None,) * 5
    # integers are cut toward zero
    assert (c.person_count, c.yaw, c.is_night) == (-2, 350.0, False)
    assert manifests.parsed(changed("window.partial_window_policy", None)).partial == "drop_partial"


@pytest.mark.parametrize(
    "path,value",
    [
        ("schema_version", 2),
        ("dataset_id", "a b"),
        ("source.videos_glob", "../x"),
        ("source.videos_glob", "C:/x"),
        ("source.videos_glob", None),
        ("time_alignment.telemetry_clock", "unix_ms"),
        ("time_alignment.telemetry_clock", "sundial"),
        ("time_alignment.max_gap_s", 0),
        ("window.size_s", "wide"),
        ("window.frames_per_item", 0),
        ("window.partial_window_policy", "keep"),
        ("pairing.strategy", "manifest_csv"),
        ("telemetry.fields.altitude_m.reference", "moon"),
        ("telemetry.fields.wheels", {"source": "x"}),
        ("telemetry.fields.yaw.type", "continuous"),
        ("telemetry.fields.yaw.aggregation", "median"),
        ("telemetry.extra.mode.interpolation", "linear"),
        ("telemetry.extra.mode.source", ""),
        ("telemetry.extra.mode.type", "odd"),
    ],
)
def test_manifest_faults(path, value):
    with pytest.raises(manifests.ManifestError) as error:
        manifests.parsed(changed(path, value))
    assert path.split(".")[-1] in str(error.value) or path.split(".")[-2] in str(error.value)


def test_manifest_of_no_kind():
    for values in (None, [], 3, {"telemetry": 5, "window": []}):
        with pytest.raises(manifests.ManifestError) as error:
            manifests.parsed(values)
        assert len(error.value.faults) > 3


def test_matrix_and_captions(spark, tmp_path):
    x = np.arange(30, dtype=np.float32).reshape(10, 3)
    np.save(tmp_path / "x.npy", x)
    ids = spark.createDataFrame([(f"s{i}", i) for i in range(10)], "segment string, position long")
    got = {r.segment: r.vector for r in manifests.matrix_with_ids(spark, str(tmp_path / "x.npy"), ids).collect()}
    assert got == {f"s{i}": x[i].tolist() for i in range(10)}
    with pytest.raises(ValueError):
        manifests.matrix_with_ids(spark, str(tmp_path / "x.npy"), ids.limit(4))
    (tmp_path / "c.json").write_text(json.dumps([{"video_id": "v1", "caption": "a"}, {"video": "v2", "caption": None}, {"caption": "lost"}]))
    assert {(r.video_id, r.caption) for r in manifests.caption_pairs(spark, str(tmp_path / "c.json")).collect()} == {("v1", "a"), ("v2", None)}


def test_shards_resume(spark, tmp_path):
    rows, folder = spark.range(100).withColumn("v", F.array(F.col("id").cast("float"), F.lit(1.0).cast("float"))), str(tmp_path / "out")
    assert shards.write_shards(rows, folder, "id", 8, "v") == 8
    (tmp_path / "out" / "shard-00003.parquet").unlink()
    (tmp_path / "out" / ".left.parquet.tmp").write_text("half")
    assert shards.completed(rows, folder) == [0, 1, 2, 4, 5, 6, 7]
    assert shards.write_shards(rows, folder, "id", 8, "v") == 1 and not (tmp_path / "out" / ".left.parquet.tmp").exists()
    found = shards.read_shards(rows, folder)
    assert found.count() == 100 and shards.overlapping(found, "id").count() == 0
    assert shards.write_shards(rows, folder, "id", 8, "v") == 0
    for i in range(8):
        own = [r.id for r in found.where(F.col("shard") == i).collect()]
        assert np.load(tmp_path / "out" / f"shard-{i:05d}.npy")[:, 0].astype(int).tolist() == own == sorted(own)
    shards.export_csv(rows.select("id").limit(3), str(tmp_path / "csv"))
    assert spark.read.option("header", "true").csv(str(tmp_path / "csv")).count() == 3


def test_killed_shards_keep_what_is_finished(spark, tmp_path):
    """Of two shards, one breaks off: the other one stays, and the next run writes the rest."""
    folder = str(tmp_path / "out")
    rows = spark.range(40).withColumn("v", F.when(F.col("id") != 7, F.array(F.lit(1.0), F.lit(2.0))))
    with pytest.raises(Exception, match="vectors"):
        shards.write_shards(rows.coalesce(1), folder, "id", 4, "v")
    left = shards.completed(rows, folder)
    assert 0 < len(left) < 4 and not [f for f in (tmp_path / "out").iterdir() if f.name.startswith(".")]
    whole = rows.withColumn("v", F.array(F.lit(1.0), F.lit(2.0)))
    assert shards.write_shards(whole, folder, "id", 4, "v") == 4 - len(left)
    assert shards.read_shards(whole, folder).count() == 40


def test_runs_are_guarded(spark, tmp_path):
    table = runs.Runs(spark, str(tmp_path), "segments")
    rows = spark.createDataFrame([("v", 0, "s1"), ("v", 1, "s2")], "video_id string, chunk_index int, segment_id string")
    expected = spark.createDataFrame([("v", 0, 1), ("v", 1, 1)], "video_id string, chunk_index int, n long")
    for run in ("r1", "r2"):
        table.write_chunk(rows, "d", run)
    table.activate("d", "r1", expected)
    with pytest.raises(ValueError):
        table.delete("d", "r1")
    assert table.delete("d", "r2") == 2 and table.rows("d", "r1").count() == 2
    assert request.Store.active(table, "d", {}).run_id == "r1"
    table.replace_registry("d", "r1", spark.createDataFrame([("cars", "integer", None)], "field string, kind string, unit string"))
    table.replace_registry("d", "r1", spark.createDataFrame([("night", "boolean", None)], "field string, kind string, unit string"))
    assert table.registry("d", "r1") == {"night": "boolean"}
    ledger = spark.createDataFrame([("d", "r1", "created"), ("d", "r3", "failed"), ("e", "r4", "completed")], "dataset string, run_id string, status string")
    ok = spark.createDataFrame([("d", "r1", "preflight_passed"), ("d", "r3", "ingesting")], "dataset string, run_id string, to string")
    assert {r.run_id: r.status for r in runs.advanced(ledger, ok).collect()} == {"r1": "preflight_passed", "r3": "ingesting", "r4": "completed"}
    with pytest.raises(Exception, match="no way from completed"):
        runs.advanced(ledger, spark.createDataFrame([("e", "r4", "ingesting")], "dataset string, run_id string, to string")).collect()
    old = spark.createDataFrame([("s1", float("nan")), ("s2", 1.0)], "segment_id string, pitch double")
    assert [r.pitch for r in runs.from_legacy(old, "r9", ["pitch"]).orderBy("segment_id").collect()] == [None, 1.0]
    segments = spark.createDataFrame([("s1", "v", 0.0, 4.0, 2, 7.0), ("s2", "v", 2.0, 6.0, 0, None)], "segment_id string, video_id string, t_start double, t_end double, n_cars int, tel_speed double")
    made = runs.metadata_chunk(segments, "r9", "d")
    assert made["videos"].first().duration == 6.0 and made["counts"].columns == ["run_id", "segment_id", "n_cars"] and made["telemetry"].count() == 2


def test_ingest_survives_other_batches(spark, tmp_path):
    """A first attempt that got half of the files, then another cut into batches."""
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.range(90).repartition(6).write.parquet(folder)
    schema = spark.read.parquet(folder).schema

    def stream(files):
        return ingest.source(spark, folder, schema, files).withColumn("chunk", ingest.chunk_of_file())

    # what an attempt that broke off has left: some files' rows
    left = spark.read.parquet(folder).withColumn("chunk", ingest.chunk_of_file())
    first = [r[0] for r in left.select("chunk").distinct().limit(3).collect()]
    left.where(F.col("chunk").isin(first)).write.partitionBy("chunk").parquet(out)
    ingest.ingest(stream(4), out, str(tmp_path / "c1"), "id")
    spark.range(90, 120).coalesce(1).write.mode("append").parquet(folder)
    ingest.ingest(stream(1), out, str(tmp_path / "c2"), "id")
    got = spark.read.parquet(out)
    assert got.count() == 120 and got.select("id").distinct().count() == 120


def test_long_series_in_cells(spark, monkeypatch):
    """Cells of any length give what one cell gives."""
    monkeypatch.setattr(series, "LONG", 0)
    rng = random.Random(5)
    rows = [(rng.choice(["a", "b", None]), None if rng.random() < 0.02 else float(rng.randrange(400)), rng.randrange(12), rng.randrange(3)) for _ in range(300)]
    spans = spark.createDataFrame(rows, "k string, t_start double, size int, s int").withColumn("t_end", F.col("t_start") + F.col("size"))

    def all_of(df):
        return sorted(map(repr, df.collect()))

    for cell in (7.0, 1000.0):
        assert all_of(intervals.merged(spans, "k", 1.0, F.col("s").cast("double"), cell=cell)) == all_of(intervals.merged(spans, "k", 1.0, F.col("s").cast("double")))
        frames = spans.select("k", F.col("t_start").cast("int").alias("f"))
        assert all_of(intervals.flagged(frames, "k", "f", 1.0, 2.0, 0.0, cell)) == all_of(intervals.flagged(frames, "k", "f", 1.0, 2.0, 0.0))
        assert all_of(features.units(spans, "k", ["t_start"], "s", cell)) == all_of(features.units(spans, "k", ["t_start"], "s"))
        assert all_of(features.motion_features(spans, "k", "t_start", ["size"], "s", cell)) == all_of(features.motion_features(spans, "k", "t_start", ["size"], "s"))
        for made in (lambda c: timeline.sessions(spans, "k", "t_start", 2.0, c).groupBy("k", "session").count(), lambda c: timeline.disorder(spans, "k", ["size", "s", "t_start"], "t_start", c), lambda c: timeline.step_percentile(spans, "k", "t_start", "size", cell=c)):
            assert all_of(made(cell)) == all_of(made(None))


def test_artifacts_of_a_bench(spark, tmp_path):
    rows = spark.createDataFrame([("exact", 1.0, None, False, "SELECT 1"), ("exact", 0.5, 0.25, True, None), ("cells", 0.0, None, False, "")], "strategy string, mrr double, `ndcg@10` double, underfilled boolean, sql string")
    out = str(tmp_path / "run")
    for _ in range(2):
        benches.write_run(rows, out, {"run_id": "r1", "k": 10}, ["mrr", "ndcg@10"])
    assert json.loads(spark.read.text(f"{out}/manifest").first().value) == {"run_id": "r1", "k": 10}
    results = spark.read.json(f"{out}/query_results")
    assert "sql" not in results.columns and sorted(r.has_sql for r in results.collect()) == [False, False, True]
    got = {r["strategy"]: (r["n_queries"], r["underfilled_count"], r["mean_mrr"], r["mean_ndcg@10"]) for r in spark.read.json(f"{out}/metrics").collect()}
    assert got == {"exact": (2, 1, 0.75, 0.25), "cells": (1, 0, 0.0, None)}
    assert spark.read.option("header", "true").csv(f"{out}/strategy_matrix").count() == 2
    assert [tuple(r) for r in spark.read.json(f"{out}/sql").select("strategy", "sql").collect()] == [("exact", "SELECT 1")]
