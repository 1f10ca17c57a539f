"""Scans of small files written for each test."""

import json

import pytest
from pyspark.sql import functions as F

from lodestar.operators import checks
from lodestar.sources import files, tables


def test_listing_and_pairs(spark, tmp_path):
    for name in ("a/V1.MP4", "b.v2.mp4", "V1.csv", "notes"):
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_text("x")
    root = str(tmp_path)
    videos, found = files.listing(spark, root, "**/*.mp4"), files.listing(spark, root)
    assert sorted((r.name, r.stem) for r in videos.collect()) == [("a/V1.MP4", "V1"), ("b.v2.mp4", "b.v2")]
    assert {r.extension: r.files for r in files.extensions(found).collect()} == {"mp4": 2, "csv": 1, "": 1}
    got = files.pairs(videos, files.listing(spark, root, "*.csv")).collect()
    assert {r.video_id: r.telemetry is not None for r in got} == {"V1": True, "b.v2": False}
    named = videos.select(files.identifier(F.col("stem"), r"regex:V(?P<video_id>\d)").alias("i")).collect()
    assert sorted(str(r.i) for r in named) == ["1", "None"]
    with pytest.raises(ValueError):
        files.listing(spark, root, "../*.mp4")
    with pytest.raises(ValueError):
        files.pairs(videos, files.listing(spark, root, "**/v1.*"))


def test_telemetry_csv(spark, tmp_path):
    (tmp_path / "t.csv").write_bytes(b"\xef\xbb\xbftime,alt.m,extra\n1,2.5,x\n2,,y\n")
    rows = files.telemetry_csv(spark, str(tmp_path), "time", {"altitude": "alt.m"}).orderBy("stamp").collect()
    assert [(r.stamp, r.altitude) for r in rows] == [("1", "2.5"), ("2", None)]
    with pytest.raises(ValueError):
        files.telemetry_csv(spark, str(tmp_path), "time", {"a": "missing"})


def test_annotations(spark, tmp_path):
    images = [{"video_id": "a", "frame_index": 3, "meta": {"altitude": 7.5}}, {"source": {"video": "b", "frame_no": 4}}, {"frame_index": 5}, {"video_id": "c"}]
    (tmp_path / "a.json").write_text(json.dumps({"images": images}, indent=1))
    good, bad = files.image_annotations(spark, str(tmp_path / "a.json"))
    assert sorted((r.video_id, r.frame_index, r.altitude) for r in good.collect()) == [("a", 3, 7.5), ("b", 4, None)]
    assert sorted(r.errors for r in bad.collect()) == [["frame_index"], ["video_id"]]
    (tmp_path / "c.json").write_text(json.dumps({"ERA_caption": [{"video_id": "Fire_001.mp4", "annotation": {"English_caption": ["x", "y"]}}]}))
    row = files.captions(spark, str(tmp_path / "c.json"), "train").first()
    assert (row.key, row.category, row.captions) == ("train__Fire_001.mp4", "Fire", ["x", "y"])
    (tmp_path / "m.txt").write_text("1,2,10,20,4,6,1,3,0,0\n1,2,3\n1,9,0,0,1,1,0,3,0,0\n")
    assert [tuple(r)[1:] for r in files.tracks(spark, str(tmp_path / "m.txt")).collect()] == [(1, 2, 3, 12.0, 23.0)]


def test_cached_rows(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"k": "a", "v": [1.0]}\n\n{"k": "b", "v": [2.0]}\n{"k": "a", "v": [3.0]}\n{"k": "b"}\n{"k": "c", "v": [')
    got = files.cached_rows(spark, str(tmp_path / "c.json"), "k string, v array<double>", ["k"])
    assert {r.k: r.v for r in got.collect()} == {"a": [3.0], "b": [2.0]}
    files.append_rows(got, str(tmp_path / "out"))
    assert files.cached_rows(spark, str(tmp_path / "out"), "k string, v array<double>", ["k"]).count() == 2


def test_profile_and_synthetic(spark):
    rows = spark.createDataFrame([(1, None), (2, "x")], "a int, `b.c` string")
    assert {r.column: r.null_share for r in files.nulls(rows).collect()} == {"a": 0.0, "b.c": 0.5}
    assert all(r.null_share is None for r in files.nulls(rows.limit(0)).collect())
    with_vector, without = files.joined(rows.withColumnRenamed("a", "k"), spark.createDataFrame([(1, 0.5)], "k int, v double"), ["k"])
    assert with_vector.count() == without.count() == 1
    centres = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "k int, embedding array<double>")
    made = files.synthetic(spark, centres, 200).collect()
    assert len(made) == 200 and all(abs(sum(x * x for x in r.embedding) - 1) < 1e-9 and max(r.embedding) > 0.8 for r in made)


def test_read_only(spark):
    rows = spark.range(5)
    assert tables.query(spark, "SELECT id, 'drop; it' AS t FROM {r} WHERE id >= :least -- delete", {"r": rows}, least=3).count() == 2
    for text in ("", "DROP TABLE x", "SELECT 1; SELECT 2", "WITH a AS (SELECT 1) INSERT INTO b SELECT * FROM a"):
        with pytest.raises(ValueError):
            tables.read_only(text)


def test_checks(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", 2000.0), (None, 5.0)], "k string, v double")
    assert sorted((str(r.k), r.v) for r in checks.unit_repair(rows, "k", "v", 1000.0, 1000.0).collect()) == [("None", 5.0), ("a", 0.001), ("a", 2.0)]
    with pytest.raises(ValueError):
        checks.one_to_one(rows, rows.limit(0), ["k"])
    assert tuple(checks.differences(rows, rows.where("v > 1").union(rows.where("k is null"))).first()) == (1, 1)
    assert tuple(checks.differences(rows.limit(0), rows.limit(0)).first()) == (0, 0)
    maps = spark.createDataFrame([({"a": [1, 2], "b": [3]},), ({},), ({"a": None},)], "m map<string, array<int>>")
    assert [r.s for r in maps.select(checks.frame_sums(F.col("m")).alias("s")).collect()] == [[4.0, 2.0], [], []]
