"""Blocks of queries, graphs, benches; formats, profiles and inventories of files."""

import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.catalog import load
from lodestar.functions.vectors import around, cosine, shorten, synthetic_unit
from lodestar.operators import blocks, cells, features, graph, metrics, search
from lodestar.plans import benches, request
from lodestar.sources import formats, inventory, joined, manifests, profiles


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((700, 24)).astype(np.float32)
    x[100:140] = x[7]
    x[3] = 0
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [1.0]), (902, [None] + [1.0] * 23)]
    return x.astype(float), spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)


def distances(x, q):
    size = np.sqrt((x * x).sum(1)) * np.sqrt((q * q).sum())
    return 1 - np.divide((x * q).sum(1), size, out=np.zeros(len(x)), where=size > 0)


def asked(df, every=20):
    return df.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))


@pytest.mark.parametrize("small", [False, True])
def test_blocks(spark, vectors, monkeypatch, small):
    x, df = vectors
    if small:
        monkeypatch.setattr(blocks, "ROWS", 50)
        monkeypatch.setattr(blocks, "QUERIES", 7)
        monkeypatch.setattr(blocks, "BROADCAST", 5)
    got = {}
    for r in blocks.nearest(df, asked(df), 12, 8, (24,)).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.dist, r.dist_24))
    assert set(got) == set(range(0, 700, 20))
    for q, found in got.items():
        d = distances(x[:, :8], x[q, :8])
        want = np.lexsort([np.arange(700), d])[:12]
        assert [f[1] for f in sorted(found)] == want.tolist()
        assert np.allclose([f[2] for f in sorted(found)], d[want]) and np.allclose([f[3] for f in sorted(found)], distances(x, x[q])[want])
    assert blocks.nearest(df, asked(df).limit(0), 3).count() == 0 and blocks.nearest(df.limit(0), asked(df), 3).count() == 0


def test_blocks_of_close_rows(spark):
    """Rows that single precision can't tell apart: the best are exact, and what leaves the
    tasks is bounded by k a query and block all the same."""
    rng = np.random.default_rng(9)
    x = 1 + 1e-5 * rng.standard_normal((3000, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(2)
    found = blocks.nearest(df, asked(df, 100), 10)
    got = {}
    for r in found.collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    for q in range(0, 3000, 100):
        size = np.sqrt((x * x).sum(1)) * np.sqrt((x[q] * x[q]).sum())
        d = 1.0 - (x * x[q]).sum(1) / size
        assert [i for _, i in sorted(got[q])] == np.lexsort([np.arange(3000), d])[:10].tolist()


def test_two_stages(vectors):
    x, df = vectors
    got = {}
    for r in blocks.two_stage(df, asked(df, 50), 5, [(4, 24), (8, 24)], (10, 30)).collect():
        got.setdefault((r.query_id, r["first"], r.candidates), []).append((r["rank"], r.vec_id))
        assert r.n_candidates == r.candidates
    for (q, first, candidates), found in got.items():
        short = np.lexsort([np.arange(700), distances(x[:, :first], x[q, :first])])[:candidates]
        best = short[np.lexsort([short, distances(x[short], x[q])])][:5]
        assert [i for _, i in sorted(found)] == best.tolist()
    assert len(got) == 14 * 4


def test_graph(spark, vectors):
    """Wider beams find more, one as wide as a part finds all; vectors without a direction
    take no part."""
    x, df = vectors
    whole = df.where("size(embedding) = 24")
    centres = cells.centroids(whole, 4)
    index = graph.build(df, centres, part_rows=150)
    assert index.count() == 699 and index.select("cell", "part").distinct().count() > 4
    # links go both ways, and all rows of a part can be reached
    for part in {(r.cell, r.part) for r in index.select("cell", "part").collect()}:
        links = {r.at: set(r.links) for r in index.where((F.col("cell") == part[0]) & (F.col("part") == part[1])).collect()}
        assert all(i in links[j] for i, js in links.items() for j in js)
        seen, wave = {0}, {0}
        while wave:
            wave = {j for i in wave for j in links[i]} - seen
            seen |= wave
        assert seen == set(links)
    queries = asked(df).union(spark.createDataFrame([(5000, [0.0] * 24)], "query_id long, query array<float>"))
    truth = {q: set(np.lexsort([np.arange(700), distances(x, x[q])])[:10].tolist()) for q in range(0, 700, 20)}
    recall = []
    for ef in (10, 40, 1000):
        got = {}
        for r in graph.search_many(index, queries, centres, 10, ef, 4).collect():
            got.setdefault(r.query_id, set()).add(r.vec_id)
        assert 5000 not in got
        recall.append(np.mean([len(got[q] & truth[q]) / 10 for q in truth]))
    assert recall[0] <= recall[1] <= recall[2] and recall[1] >= 0.9 and recall[2] == 1.0
    swept = graph.sweep(index, asked(df), blocks.nearest(df, asked(df), 10), centres, 10, (40, 512), 4).collect()
    assert [r.ef for r in sorted(swept)] == [40, 512] and min(r.recall for r in swept) >= 0.9
    with pytest.raises(ValueError, match="beam"):
        graph.search_many(index, queries, centres, 10, 5, 4)


def test_adaptive_bench(vectors):
    _, df = vectors
    queries = asked(df, 100).where("query is not null")
    made = benches.adaptive(df, queries, 10, (24, 8, 4), lambda d: blocks.nearest(df, queries, 10, d)).collect()
    assert len(made) == 7 * 14
    for r in made:
        assert r.returned_count == 10 and not r.underfilled and (r.agreement is None) == (r.stage1_dim is None)
    by = {}
    for r in made:
        if r.stage1_dim == 8:
            by.setdefault(r.candidate_k, []).append(r.agreement)
    assert np.mean(by[20]) <= np.mean(by[200]) and np.mean(by[200]) > 0.9


def test_formats(spark, tmp_path):
    formats.register(spark)
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.csv").write_bytes(b"\xef\xbb\xbftime,ALT,note\r\n" + b"".join(b'%d,%d,"x, %d"\r\n' % (i, i * 2, i) for i in range(500)))
    (tmp_path / "t" / "b.csv").write_text("note,time,ALT\n,7,\n")
    for step in (64, 1 << 20):
        rows = spark.read.format("telemetry").options(path=str(tmp_path / "t"), timestamp="time", fields='{"alt": "ALT", "note": "note"}', rangeBytes=step).load()
        got = sorted((int(r.stamp), r.alt, r.note) for r in rows.where(F.col("file").endswith("a.csv")).collect())
        assert got == [(i, str(i * 2), f"x, {i}") for i in range(500)]
        assert [tuple(r)[1:] for r in rows.where(F.col("file") == str(tmp_path / "t" / "b.csv")).collect()] == [("7", None, None)]
    with pytest.raises(Exception, match="columns not in"):
        spark.read.format("telemetry").options(path=str(tmp_path / "t"), timestamp="time", fields='{"a": "WHAT"}').load().collect()
    lines = [f"{i},{i % 5},10,20,4,6,{i % 3},{i % 4},0" for i in range(300)] + ["1,2,3", "", "a,b,c,d,e,f,g,h"]
    (tmp_path / "m.txt").write_text("\n".join(lines))
    for step in (50, 1 << 20):
        rows = spark.read.format("tracks").options(path=str(tmp_path / "m.txt"), rangeBytes=step).load()
        assert sorted(r.frame for r in rows.collect()) == [i for i in range(300) if i % 3]
        some = rows.where("category = 2 and frame < 100 and cx > 0")
        assert sorted(r.frame for r in some.collect()) == [i for i in range(100) if i % 3 and i % 4 == 2]
        assert some.first().cx == 12.0 and some.first().cy == 23.0


def test_matrix_format(spark, tmp_path):
    formats.register(spark)
    x = np.arange(3000, dtype=np.float32).reshape(1000, 3)
    np.save(tmp_path / "x.npy", x)
    np.save(tmp_path / "y.npy", x[:10].astype(np.int64))
    rows = spark.read.format("matrix").options(path=str(tmp_path), rangeBytes=100).load()
    assert rows.count() == 1010
    part = spark.read.format("matrix").options(path=str(tmp_path / "x.npy"), rangeBytes=100, first=400, last=600).load()
    assert [r.vector for r in part.orderBy("position").collect()] == x[400:600].tolist()
    # a filter on one use of a relation leaves its other uses alone
    assert [rows.where("position < 3").count(), rows.count()] == [6, 1010]
    assert manifests.matrix_rows(spark, str(tmp_path / "y.npy")).count() == 10
    np.save(tmp_path / "z.npy", x.T.copy(order="F"))
    with pytest.raises(Exception, match="rows"):
        spark.read.format("matrix").option("path", str(tmp_path / "z.npy")).load().collect()


def test_csv_profiles(spark, tmp_path):
    (tmp_path / "a.csv").write_text("k;v;w\n" + "".join(f"{i};{i / 2};{'x,y' if i % 4 else ''}\n" for i in range(40)))
    (tmp_path / "b.csv").write_bytes("k\tü\n1\tä\n".encode("latin-1"))
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "c.CSV").write_bytes(b"\xef\xbb\xbf" + '"a|b"|c\n"1|2"|true\n'.encode())
    (tmp_path / "d.csv").write_text("")
    got = {r.name: r for r in profiles.csv_profiles(spark, str(tmp_path)).collect()}
    assert {n: (r.encoding, r.delimiter, r.rows) for n, r in got.items()} == {"a.csv": ("utf-8", ";", 40), "b.csv": ("latin-1", "\t", 1), "sub/c.CSV": ("utf-8-sig", "|", 1), "d.csv": ("utf-8", ",", 0)}
    assert [(c.column, c.type, c.null_share) for c in got["a.csv"].columns] == [("k", "long", 0.0), ("v", "double", 0.0), ("w", "string", 0.25)]
    assert [(c.column, c.type) for c in got["sub/c.CSV"].columns] == [("a|b", "string"), ("c", "boolean")] and got["b.csv"].columns[1].column == "ü"


def test_layouts(spark, tmp_path):
    files = {
        "coco.json": json.dumps({"images": [{"x": 1}], "annotations": [], "categories": [], "info": {"fps": 3}}),
        "cap.json": json.dumps([{"video": "v", "caption": "a \"b\" {"}]),
        "ids.json": json.dumps({"v1": ["text", "more"], "v2": []}),
        "list.json": json.dumps([{"a": {"caption": 1}}]),
        "obj.json": json.dumps({"a": {"b": ["x"]}}),
        "bad.json": "nothing",
        "voc.xml": "<?xml version='1.0'?><!-- c --><annotation><object/></annotation>",
        "other.xml": "<root/>",
        "mot.txt": "1,2,3,4,5,6,7,8,9,10\n",
        "yolo.txt": "0 0.5 0.5 0.1 0.1\n",
        "some.csv": "a,b\n",
        "empty.txt": "",
        "skip.png": "x",
    }
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    got = {r.name: (r.layout, r.has_fps) for r in profiles.layouts(spark, str(tmp_path)).collect()}
    assert {n: v[0] for n, v in got.items()} == {"coco.json": "COCO-json", "cap.json": "caption-json (list)", "ids.json": "caption-json (id to list)", "list.json": "json (list)", "obj.json": "json (object)", "bad.json": "json", "voc.xml": "PascalVOC-xml", "other.xml": "xml", "mot.txt": "MOT-csv", "yolo.txt": "YOLO-txt", "some.csv": "csv", "empty.txt": "unknown"}
    assert [n for n, v in got.items() if v[1]] == ["coco.json"]
    assert profiles.layouts(spark, str(tmp_path), sample=1).count() <= 8


def test_inventory_reads_pieces(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(inventory, "PIECE", 1000)
    data = np.random.default_rng(0).bytes(123_457)
    (tmp_path / "big.bin").write_bytes(data)
    (tmp_path / "empty").write_bytes(b"")
    got = {r.name: (r.bytes, r.sha256) for r in inventory.inventory(spark, str(tmp_path)).collect()}
    assert got == {"big.bin": (len(data), hashlib.sha256(data).hexdigest()), "empty": (0, hashlib.sha256(b"").hexdigest())}


def test_pairs_stay_in_tasks(vectors, monkeypatch):
    """What leaves a task is bounded by k for each query and bundle, or falls with the rows
    that the task has seen; queries that aren't broadcast meet the rows in many tasks."""
    _, df = vectors
    whole = df.where("size(embedding) = 24")
    centres = cells.centroids(whole, 4)
    index, queries = graph.build(df, centres, part_rows=50), asked(df)
    n = queries.where("query is not null").count()
    beams = graph._beams(index, queries, centres, 10, (1000,), 4, "vec_id", "embedding")
    assert beams.count() <= n * 4 * 10
    monkeypatch.setattr(blocks, "BROADCAST", 5)
    monkeypatch.setattr(blocks, "ROWS", 50)
    # they are dealt by more keys than the width
    assert blocks._met(whole, queries, "vec_id", "embedding").select("_part_r", "_slice_r").distinct().count() > 1
    found = cells.approximate_many(cells.placed(df, centres), queries, centres, 10, 4)
    assert {tuple(r) for r in found.select("query_id", "vec_id", "rank").collect()} == {tuple(r) for r in graph.search_many(index, queries, centres, 10, 1000, 4).select("query_id", "vec_id", "rank").collect()}


def test_sweep_walks_for_hits(spark, vectors):
    """The sweep tells what searches of each width find, copies included, though queries
    walk only in parts that hold their hits, until these are settled."""
    _, df = vectors
    centres = cells.centroids(df.where("size(embedding) = 24"), 4)
    index = graph.build(df, centres, part_rows=60)
    queries = asked(df).union(spark.createDataFrame([(5000, [0.0] * 24)], "query_id long, query array<float>"))
    truth = blocks.nearest(df, queries, 10).select("query_id", "vec_id").localCheckpoint()
    hits, efs = {tuple(r) for r in truth.collect()}, (45, 10, 14, 20, 1000)
    for probes in (1, 4):
        want = {ef: len(hits & {(r.query_id, r.vec_id) for r in graph.search_many(index, queries, centres, 10, ef, probes).collect()}) / len(hits) for ef in efs}
        assert {r.ef: r.recall for r in graph.sweep(index, queries, truth, centres, 10, efs, probes).collect()} == want
    assert want[10] < want[1000] < 1
    assert graph.sweep(index, queries, truth.limit(0), centres, 10, efs, 4).collect() == []

    class Counted(list):
        read = 0

        def __getitem__(self, i):
            self.read += 1
            return super().__getitem__(i)

    rng = np.random.default_rng(3)
    x = rng.standard_normal((900, 8))
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    x[200:230] = x[30]
    x[300:400] = x[40]
    links, read = [m.tolist() for m in graph._chosen(x, 8)], [0, 0]
    for q in range(0, 900, 20):
        near = x @ x[q]
        goals = frozenset(np.lexsort([np.arange(900), -near])[:4].tolist())
        each, once = Counted(links), Counted(links)
        want = [len(goals.intersection(graph._walk(near.tolist(), each, ef))) for ef in (10, 20, 200, 900)]
        assert graph._reached(near, once, (10, 20, 200, 900), goals) == want
        read = [read[0] + each.read, read[1] + once.read]
    assert read[1] * 10 < read[0]


def test_links_in_blocks(monkeypatch):
    """Rows choose in blocks what they chose one by one; copies choose each other, however
    their sums round."""
    rng = np.random.default_rng(6)
    x = rng.standard_normal((300, 16))
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    x[290:] = x[5]
    monkeypatch.setattr(graph, "STEP", 70)
    want = [set() for _ in x]
    for i in range(300):
        near, kept = x @ x[i], []
        near[i] = -np.inf
        for c in np.lexsort([np.arange(300), -np.round(near, 12)])[:18].tolist():
            if len(kept) < 6 and all(x[o] @ x[c] <= near[c] + 1e-9 for o in kept):
                kept.append(c)
        for c in [*kept, *([i + 1] if i < 299 else [])]:
            want[i].add(c)
            want[c].add(i)
    assert [m.tolist() for m in graph._chosen(x, 6)] == [sorted(s) for s in want]
    assert [m.tolist() for m in graph._chosen(x[:1], 6)] == [[]] and [m.tolist() for m in graph._chosen(x[:2], 6)] == [[1], [0]]


def test_ranks_of_relevant(spark, monkeypatch):
    """Ranks by blocks are those of all pairs; ties go to the smaller id."""
    rng = np.random.default_rng(4)
    x = rng.standard_normal((300, 8))
    x[50:90] = x[20]
    df = spark.createDataFrame([(i, v.tolist(), i % 7 if i else 99) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    queries = df.where("vec_id % 20 = 0").selectExpr("vec_id as query_id", "embedding as query", "label as own")
    for bound in (65_536, 5):
        monkeypatch.setattr(blocks, "BROADCAST", bound)
        monkeypatch.setattr(blocks, "ROWS", 64)
        got = {r.query_id: (r["rank"], r.relevant) for r in blocks.relevant_ranks(df, queries, "label").collect()}
        for q in range(0, 300, 20):
            order = [i for i in np.lexsort([np.arange(300), np.round(distances(x, x[q]), 12)]).tolist() if i != q]
            want = next((at for at, i in enumerate(order, 1) if i and q and i % 7 == q % 7), None)
            assert got[q] == ((want, True) if want else (300, False))


def test_rankings_hold_no_pairs(spark, monkeypatch):
    """Ties across labels go by id, odd rows take no part, few queries fit at once; the
    metrics are those of all pairs."""
    rng = np.random.default_rng(5)
    base = rng.standard_normal((40, 4)).round(1)
    rows = [(i, [float(x) for x in base[i % 40]], int(i * 7 % 5)) for i in range(300)]
    rows += [(1000, None, 1), (1001, [1.0, None, 0.0, 0.0], 1), (1002, [1.0, 2.0], 1), (1003, [0.0] * 4, 2), (1004, [float("nan"), 1.0, 0.0, 0.0], 2), (1005, [0.5, 0.1, 0.0, 1.0], None)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    asked = table.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"), F.col("label").alias("own"))
    pairs = search.pairs(table, asked).where("vec_id != query_id").select("query_id", F.col("vec_id").alias("item_id"), F.round(1 - F.col("dist"), 9).alias("score"), (F.col("label") == F.col("own")).alias("relevant"))
    monkeypatch.setattr(blocks, "SCORES", 900)
    made = blocks.rankings(table, asked, "label")
    assert "Join" not in made._jdf.queryExecution().executedPlan().toString()
    assert metrics.from_rankings(made).collect() == metrics.corpus_metrics(pairs).collect()


@pytest.mark.parametrize("rows", [7, 10_000])
def test_greedy_match_of_many_and_long_groups(spark, rows):
    """Groups pass through few tasks, whatever their number, cut by batches or not."""
    rng = np.random.default_rng(3)
    span = lambda: (lambda a, b: (float(a), float(a + b)))(rng.integers(0, 60), rng.integers(-1, 12))
    groups = [(q, v, n) for q in range(60) for v, n in (("a", 3), ("b", 40 if q % 20 == 0 else 1), (None, 2))]
    found = [(q, i, v, *span()) for q, v, n in groups for i in range(n + 1)]
    truth = [(q, v, *span()) for q, v, n in groups for _ in range(n) if q % 7]
    want = set()
    for q, v, _ in groups:
        spans = sorted((s, e) for a, b, s, e in truth if (a, b) == (q, v))
        for _, i, _, s, e in sorted(r for r in found if (r[0], r[2]) == (q, v)):
            for x in spans:
                both = max(0.0, min(x[1], e) - max(x[0], s))
                union = (e - s) + (x[1] - x[0]) - both
                if union > 0 and both >= (0.3 - 1e-12) * union:
                    spans.remove(x)
                    want.add((q, i, v))
                    break
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    try:
        hits = metrics.greedy_hits(spark.createDataFrame(found, "query_id int, rank int, video string, t_start double, t_end double"), spark.createDataFrame(truth, "query_id int, video string, t_start double, t_end double"), 0.3)
        assert "CoGroup" not in hits._jdf.queryExecution().executedPlan().toString()
        got = hits.collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(got) == len(found) and {(r.query_id, r["rank"], r.video) for r in got if r.hit} == want


def test_aligned_meets_in_blocks(spark):
    """As all pairs would: ties, zero, null, short, empty and unbounded vectors."""
    rng = np.random.default_rng(4)
    v = [[[float(x) for x in rng.integers(-2, 3, 3)] for _ in range(50)] for _ in range(2)]
    rows = [(i, v[0][i], v[1][i]) for i in range(50)] + [(50, None, [1.0, 0.0, 1.0]), (51, [1.0, None, 0.0], None), (52, [1.0, 2.0], [2.0, 1.0]), (53, [], [1.0]), (54, [7.0], [0.0, 0.0, 0.0])]
    for more in ([], [(60, [float("nan"), 1.0, 0.0], [1.0, 1.0, 1.0]), (61, [1.0, 2.0, 0.5], [float("inf"), 0.0, 1.0])]):
        pairs = spark.createDataFrame(rows + more, "i long, a array<double>, b array<double>")
        a, b = pairs.select(F.col("i").alias("x"), "a"), pairs.select(F.col("i").alias("y"), "b")
        met = a.crossJoin(b).select("x", "y", cosine("a", "b").alias("c")).groupBy("x").agg(F.max(F.struct(F.round("c", 12), -F.col("y"))).alias("m"), F.max(F.when(F.col("x") == F.col("y"), F.col("c"))).alias("own"))
        want = met.select("x", (-F.col("m.col2")).alias("n"), F.round("own", 9)).orderBy("x").collect()
        got = features.aligned(pairs, "i", "a", "b")
        assert list(map(str, map(tuple, got.select("i", "nearest", F.round("own", 9)).orderBy("i").collect()))) == list(map(str, map(tuple, want)))


def test_tracks_lay_out_few_lines_at_once(spark, tmp_path, monkeypatch):
    """A range's lines come piece by piece, none twice and none lost."""
    lines = [f"{i},{i % 7},1,2,4,6,{i % 3},{i % 5}" for i in range(5000)] + ["short", "1,2,x,4,5,6,7,8", "", "9,9,1,1,2,2,1,3"]
    (tmp_path / "a.txt").write_text("\n".join(lines))
    monkeypatch.setattr(formats, "PIECE_BYTES", 1000)
    reader = formats._Tracks({"path": str(tmp_path), "rangeBytes": "30000"})
    got = [list(reader.read(p)) for p in reader.partitions()]
    assert max(b.num_rows for batches in got for b in batches) < 100
    frames = [f for batches in got for b in batches for f in b.column("frame").to_pylist()]
    assert sorted(frames) == sorted([i for i in range(5000) if i % 3] + [9])


def test_files_joined_from_parts(spark, tmp_path, monkeypatch):
    """One file a value, in order across parts; no task sorts a whole file."""
    monkeypatch.setattr(joined, "PART_ROWS", 50)
    kinds = ["a", "b/c", None, "d=1"]
    rows = spark.createDataFrame([(kinds[i % 4], (i * 37) % 1000, f"{(i * 37) % 1000} x" if i % 9 else None) for i in range(1000)], "kind string, n int, value string").repartition(5)
    joined.write_text(rows, str(tmp_path / "own"), "kind", order="n")
    rows.repartition(1).sortWithinPartitions("kind", "n").select("kind", "value").write.partitionBy("kind").text(str(tmp_path / "spark"))
    read = lambda root: {p.parent.name: p.read_text() for p in (tmp_path / root).rglob("*.txt")}
    assert read("own") == read("spark") and len(read("own")) == 4
    joined.write_text(rows, str(tmp_path / "any"), "kind")
    assert {k: sorted(v.split("\n")) for k, v in read("any").items()} == {k: sorted(v.split("\n")) for k, v in read("spark").items()}


def test_around_is_what_expressions_give(spark):
    """To the last bit, for null, short, long, zero and unbounded vectors too."""
    rows = [("a", [0.1, 0.2, 0.3]), ("b", None), ("c", [1.0, 2.0]), (None, [1.0, 2.0, 3.0]), ("d", [1.0, None, 3.0]), ("e", [1.0, 2.0, 3.0, None]), ("f", [0.0] * 3), ("g", [float("nan"), 1.0, 1.0]), ("h", [float("inf"), 1.0, 1.0]), ("i", [])]
    rows += [(f"k{i}", [float(x) for x in np.random.default_rng(i).standard_normal(3)]) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, v array<float>")
    noisy = df.withColumn("n", synthetic_unit("k", 3))
    plain = F.zip_with("v", "n", lambda a, b: a.cast("double") + b * 0.4)
    made = noisy.withColumn("p", plain).select(around("v", "k", 3, 0.4).alias("x"), shorten("p", 3).alias("y"))
    assert all(str(r.x) == str(r.y) for r in made.collect())


def test_synthetic_rows_are_dealt_to_tasks(spark, tmp_path):
    rows = spark.range(5000).select(F.col("id").alias("vec_id"), F.array(*(F.lit(float(i)) for i in range(64))).cast("array<float>").alias("embedding"), F.lit(1).alias("label"))
    rows.coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    made = load()[0]["synthetic_scale"](spark, str(tmp_path))
    assert made.rdd.getNumPartitions() == 3 and made.count() == 50_000


def test_answers_join_their_rows_once(spark, monkeypatch):
    plans = []
    real = request.run

    def seen(spark, asked, store, *args, **options):
        plans.append(store.rows._jdf.queryExecution().optimizedPlan().toString())
        return real(spark, asked, store, *args, **options)

    monkeypatch.setattr(request, "run", seen)
    assert load()[0]["answers_checked"](spark, "/root/testdata/sf0.001").count() == 8
    assert len(plans) == 8 and not any("Join" in p for p in plans)
