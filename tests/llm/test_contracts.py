"""The operators against brute force, their SQL, and clashing columns."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest
import zstandard
from pyspark.sql import functions as F

import corpus_pipeline
from lodestar.llm import ann, decontamination, language, packing, queries, sharding, similarity_join, token_files, tokens, toxicity, warc

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
tables = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def shingled(text):
    w = words(text)
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def crc_of(doc_id):
    return zlib.crc32(str(doc_id).encode())


def grouped(rows, threshold=0.8):
    """For rows (id, text): each row's links and the first id of its component."""
    sets = [shingled(t) for _, t in rows]
    by = {}
    for i, s in enumerate(sets):
        for x in s:
            by.setdefault(x, []).append(i)
    common = Counter()
    for members in by.values():
        for a in range(len(members)):
            for b in range(a):
                common[members[b], members[a]] += 1
    links, root = Counter(), list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for (a, b), n in common.items():
        if n >= threshold * (len(sets[a]) + len(sets[b]) - n) - 1e-9:
            links[a] += 1
            links[b] += 1
            root[find(a)] = find(b)
    first = {}
    key = lambda i: (rows[i][0] is None, rows[i][0] or 0)
    for i in range(len(rows)):
        r = find(i)
        if r not in first or key(i) < key(first[r]):
            first[r] = i
    return links, [rows[first[find(i)]][0] for i in range(len(rows))]


@tables
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    want, got = con.execute(queries.ORACLES[name]).df(), queries.QUERIES[name](spark, SMALL).toPandas()
    assert set(want.columns) == set(got.columns)
    plain = lambda df: sorted(tuple("" if pd.isna(v) else str(int(v)) if isinstance(v, (float, np.floating)) else str(v) for v in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False, name=None))
    assert plain(got) == plain(want)


@tables
@pytest.mark.parametrize("folder", [SMALL, MIDDLE])
def test_nearest_recall(spark, folder):
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").toPandas().dropna()
    x, ids = np.stack(rows.embedding).astype(float), rows.vec_id.to_numpy()
    got = {}
    for r in queries.op1_nearest(spark, folder).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hit = 0
    asked = np.flatnonzero(ids % 100 == 0)
    for q in asked:
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        mine = sorted(got[ids[q]])
        assert [m[0] for m in mine] == list(range(1, 11)) and [(m[2], m[1]) for m in mine] == sorted((m[2], m[1]) for m in mine)
        hit += len({m[1] for m in mine} & set(ids[np.lexsort([ids, d])[:10]].tolist()))
    assert hit >= 0.9 * 10 * len(asked)


def test_nearest_ties_and_columns(spark):
    rows = [(i, [float(i % 3), 1.0], "x", 1.5) for i in range(30)]
    df = spark.createDataFrame(rows, ["vec_id", "embedding", "a.b", "score"])
    got = ann.search(df, df.where("vec_id = 0"), k=12).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(i, 0.0) for i in range(3, 30, 3)] + [(i, 1.0) for i in (1, 4, 7)]


def test_hash_clash_gives_right_ids(monkeypatch):
    """Every piece has one of two hashes: ids still are the library's."""
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(tokens.default_path())
    texts = ["the cat sat", "a dog, a cat.", "", "x <|endoftext|> the"]
    monkeypatch.setattr(tokens, "segment_hashes", lambda buf, a, b: (b - a).astype(np.uint64) % np.uint64(2))
    raw = [t.encode() for t in texts]
    made = tokens.TokenEncoder(tokens.default_path())
    for _ in range(2):
        ids, at = made.encode(np.frombuffer(b"".join(raw), np.uint8), np.append(0, np.cumsum([len(r) for r in raw])))
        assert [ids[at[i] : at[i + 1]].tolist() for i in range(4)] == [[*lib.encode(t, add_special_tokens=False).ids, 0] for t in texts]
    # alone in their batches: the clash is with what the worker keeps
    for t in ("cat", "dog"):
        ids, _ = made.encode(np.frombuffer(t.encode(), np.uint8), np.array([0, 3]))
        assert ids.tolist() == [*lib.encode(t, add_special_tokens=False).ids, 0]


@tables
def test_token_ids_of_tables(spark):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(tokens.default_path())
    start = 0
    got = {r.doc_id: r for r in queries.op9_token_files(spark, SMALL).collect()}
    for r in spark.read.parquet(f"{SMALL}/documents.parquet").orderBy("doc_id").collect():
        ids = [*lib.encode(r.text or "", add_special_tokens=False).ids, 0]
        assert (got[r.doc_id].start, got[r.doc_id].n_tokens, got[r.doc_id].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_differencing_by_the_book():
    """Against a literal version: tuples of loads, the two largest spreads merged."""
    rng = np.random.default_rng(0)
    for k in (2, 3, 5):
        sizes = rng.integers(1, 257, 40)
        parts = [(int(s), i, [(int(s), [i])] + [(0, [])] * (k - 1)) for i, s in enumerate(sizes)]
        n = len(parts)
        while len(parts) > 1:
            parts.sort(key=lambda p: (-p[0], p[1]))
            (_, _, a), (_, _, b) = parts[:2]
            both = [(x + y, p + q) for (x, p), (y, q) in zip(a, reversed(b), strict=True)]
            both.sort(key=lambda w: -w[0])
            least = both[-1][0]
            parts = [*parts[2:], (both[0][0] - least, n, [(x - least, p) for x, p in both])]
            n += 1
        to = packing.difference(sizes, k)
        mine = sorted(sizes[to == w].sum() for w in range(k))
        assert mine == sorted(sum(int(sizes[i]) for i in p) for _, p in parts[0][2])
        assert mine[-1] - mine[0] <= 256


@tables
def test_little_padding(spark):
    rows = packing.pack(spark.read.parquet(f"{MIDDLE}/documents.parquet"), tokens.default_path()).toPandas()
    assert rows.groupby("sequence_id").length.sum().max() <= 1024
    assert rows.length.sum() / (1024 * rows.sequence_id.nunique()) > 0.97


def test_sharding_rows_and_columns(spark):
    rows = [(i, None if i % 7 == 0 else "" if i % 7 == 1 else "same" if i % 7 == 2 else "t" * i) for i in range(300)] + [(5, "same")] * 40 + [(None, "x" * 50_000)] * 3
    df = spark.createDataFrame([(*r, "s", 1, 2) for r in rows], ["doc_id", "text", "SHARD", "a.b", "_base"]).repartition(5, "doc_id")
    df = df.cache()
    got = sharding.shuffle(df, shards=4, block_rows=20).collect()
    assert got[0].asDict().keys() == {"doc_id", "text", "a.b", "_base", "shard", "slot"}
    assert Counter((r.doc_id, r.text) for r in got) == Counter(rows)
    for s in range(4):
        own = sorted(r.slot for r in got if r.shard == s)
        assert own == list(range(len(own))) and abs(len(own) - len(rows) / 4) < 1
    # a shuffle: neighbours of the input don't stay together
    assert sharding.shuffle(df, shards=4, block_rows=20, seed=1).select("doc_id", "shard", "slot").exceptAll(sharding.shuffle(df, shards=4, block_rows=20, seed=2).select("doc_id", "shard", "slot")).count() > 100


def test_draws_are_exact():
    """Probabilities of small draws, and moments of draws from more than a billion."""
    rng = np.random.default_rng(3)
    good, bad, n, draws = 12, 9, 8, 40_000
    seen = Counter(sharding.hypergeometric(rng, good, bad, n) for _ in range(draws))
    for k in range(9):
        p = math.comb(good, k) * math.comb(bad, n - k) / math.comb(good + bad, n)
        assert abs(seen[k] / draws - p) < 5 * math.sqrt(p * (1 - p) / draws) + 1e-9
    good, bad, n = 3 * 10**12, 7 * 10**12, 10**10
    x = np.array([sharding.hypergeometric(rng, good, bad, n) for _ in range(20_000)], float)
    sd = math.sqrt(n * 0.3 * 0.7 * (1 - n / (good + bad)))
    z = (x - 0.3 * n) / sd
    assert abs(z.mean()) < 0.03 and abs(z.var() - 1) < 0.05 and abs((np.abs(z) < 1).mean() - 0.6827) < 0.015
    # few good ones among very many
    x = np.bincount([sharding.hypergeometric(rng, 4, 4 * 10**9, 10**9) for _ in range(20_000)], minlength=5) / 20_000
    assert np.abs(x - [math.comb(4, k) * 0.25**k * 0.75 ** (4 - k) for k in range(5)]).max() < 0.015


def test_matrix_over_a_billion():
    """Rows and columns of the matrix add up beyond 32 bits."""
    counts, room = [2 * 10**9, 5 * 10**8, 0, 1_500_000_000], [10**9] * 4
    rows = np.array([sharding.Deal(counts, room, 9).row(p) for p in range(4)])
    assert rows.sum(1).tolist() == counts and rows.sum(0).tolist() == room and (rows >= 0).all()
    expect = np.outer(counts, room) / 4e9
    assert (np.abs(rows - expect) <= 6 * np.sqrt(expect + 1)).all()


def test_network_by_literal_convolution():
    rng = np.random.default_rng(1)
    net = language.fit(["the thing and " * 9, "der die das und " * 9, "le la les et " * 9], ["en", "de", "fr"], steps=40)
    x = rng.integers(0, 256, (7, language.WINDOW)).astype(np.uint8)
    got = net.windows(x, net.prepare())
    for row, probabilities in zip(x, got, strict=True):
        best = []
        for t, b in zip(net.tables, net.bias, strict=True):
            for f in range(language.FILTERS):
                best.append(max(0.0, max(sum(t[j, row[i + j], f] for j in range(len(t))) for i in range(language.WINDOW - len(t) + 1)) + b[f]))
        z = np.array(best) @ net.weights + net.offset
        z = np.exp(z - z.max())
        assert np.allclose(z / z.sum(), probabilities, atol=1e-4)


def _same(a, b):
    return a.languages == b.languages and all(np.array_equal(x, y) for x, y in zip(a.tables, b.tables, strict=True))


def test_held_out_rows_teach_nothing(spark):
    text = lambda i: f"some words of number {i} " * 5
    rows = [(i, text(i), "ab"[i % 2]) for i in range(120)]
    changed = [(i, "quite different " * 9 if crc_of(i) % 4 == 2 else t, "zz" if crc_of(i) % 4 == 2 else g) for i, t, g in rows]
    schema = "doc_id long, text string, lang string"
    assert _same(language.fit_documents(spark.createDataFrame(rows, schema)), language.fit_documents(spark.createDataFrame(changed, schema)))
    marks = [(i, int(i % 3 == 0)) for i in range(120)]
    other = [(i, 1 - m if crc_of(i) % 5 == 0 else m) for i, m in marks]
    bad = spark.createDataFrame([(i, t + " idiotic scum" * (i % 3 == 0)) for i, t, _ in rows], "doc_id long, text string")
    a, b = (toxicity.fit_labels(bad, spark.createDataFrame(m, "doc_id long, toxic int")) for m in (marks, other))
    assert (a.toxic, a.ordinary, a.thresholds) == (b.toxic, b.ordinary, b.thresholds) and np.array_equal(a.weights, b.weights)


def test_toxicity_window_by_window():
    """Gains, counts and scores computed a window at a time."""
    rng = random.Random(4)
    plain = [" ".join(rng.choice(["ander", "thing", "ation", "other"]) for _ in range(60)) for _ in range(120)]
    model = toxicity.fit([p.replace("other", "idiotic scum", 4) for p in plain[:60]], plain[60:])
    by = [toxicity._compressor(c) for c in (model.ordinary, model.toxic)]

    def literal(text):
        raw, blanks = text.lower().encode(), b" \t\n\r"
        begins = []
        for i in range(0, len(raw), toxicity.WINDOW):
            spot = next((j for j in range(i, min(len(raw), i + toxicity.WINDOW)) if i and raw[j] in blanks), i)
            begins.append(spot)
        ends = [min(b + 1, len(raw)) for b in begins[1:]] + [len(raw)] * bool(raw)
        return [len(by[0].compress(raw[a:b])) - len(by[1].compress(raw[a:b])) for a, b in zip(begins, ends, strict=True) if b > a]

    for text in ("", "Short", plain[3], plain[5].replace("other", "idiotic scum"), "x" * 500, "tab\tand\nline " * 40):
        gains, bounds = model.gains(*toxicity._buffer([text.encode()]))
        assert gains.tolist() == literal(text) and bounds.tolist() == [0, len(gains)]
        n = max(1, len(gains))
        counts = [sum(g >= t for g in gains) for t in model.thresholds]
        z = float(np.dot([1.0, *np.log1p(counts), *np.log1p([200.0 * c / n for c in counts]), math.log(n)], model.weights))
        assert abs(model.score(*toxicity._buffer([text.encode()]))[0] - 1 / (1 + math.exp(-max(-30, min(30, z))))) < 1e-9
    assert isinstance(by[0], zstandard.ZstdCompressor) and set(model.thresholds) <= set(toxicity.GAINS)


@pytest.fixture(scope="module")
def odd(spark):
    """Columns whose names clash with anything an operator might add."""
    base = " ".join(f"w{i * 37 % 91}" for i in range(80))
    rows = [(1, base), (2, base + " end"), (3, "the quick brown fox " * 5), (4, None), (5, "ein ganz anderer text " * 4), (None, "no id")]
    names = ["doc_id", "text", "lang", "a.b", "_text", "_gone", "_again", "_sid", "_key", "_id", "SCORE", "Lang_Pred", "N_Words", "contaminated", "comp", "sid"]
    return spark.createDataFrame([(*r, "en", *range(len(names) - 3)) for r in rows], ", ".join(f"`{n}` {'long' if n == 'doc_id' else 'string' if n in ('text', 'lang') else 'int'}" for n in names))


def test_clashing_columns(spark, odd):
    bench = spark.createDataFrame([(1, "the quick brown fox")], "item_id long, text string")
    kept = similarity_join.deduplicate(odd)
    assert kept.columns == odd.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "3", "4", "5", "None"]
    clean = decontamination.remove(odd, bench)
    assert clean.columns == odd.columns and {r.doc_id for r in clean.collect()} == {1, 2, 4, 5, None}
    marked = decontamination.annotate(odd, bench)
    assert marked.where("contaminated").count() == 1 and "N_Words" not in marked.columns and marked.count() == 6
    net = language.fit(["the quick brown fox " * 9, "ein ganz anderer text " * 9], ["en", "de"], steps=40)
    assert language.predict(odd, net, least=0.0).columns == odd.columns
    found = language.predict(odd, net)
    assert "Lang_Pred" not in found.columns and "SCORE" not in found.columns and found.where("doc_id = 5").first().lang_pred == "de"
    model = toxicity.fit(["bad words here " * 9] * 4, ["good words here " * 9] * 4)
    assert toxicity.score(odd, model, below=2.0).columns == odd.columns and toxicity.score(odd, model).count() == 6
    assert sharding.shuffle(odd, shards=2).drop("shard", "slot").columns == odd.columns
    assert similarity_join.join(odd).count() == packing.pack(odd, tokens.default_path()).select("doc_id").distinct().count() == 6


def test_archives_name_their_origin(spark):
    big = "y" * 1200
    rows = [(1, "u", big, 1), (9, "v", big, 1), (3, "w", big, 1), (4, "z", "small", 1), (5, None, "small", 1)]
    df = spark.createDataFrame(rows, ["page_id", "url", "html", "record_id"]).repartition(3)
    found = warc.records(spark, warc.write(df)).collect()
    named = {r.record_id for r in found if r.type == "response" and r.payload_bytes == 1200}
    assert len(named) == 1 and [r.refers_to for r in found if r.type == "revisit"] == [*named] * 2
    assert len({r.record_id for r in found}) == len(found) == 15
    flat = {r.page_id: (r.record_type, r.refers_to) for r in warc.resolve(warc.captures(warc.records(spark, warc.write(df)))).collect()}
    assert flat == {1: ("revisit", 9), 3: ("revisit", 9), 9: ("response", None), 4: ("response", None), 5: ("response", None)}


def test_archives_beyond_the_broadcast(spark, monkeypatch):
    from lodestar.llm import shared

    monkeypatch.setattr(shared, "BROADCAST_IDS", -1)
    test_archives_name_their_origin(spark)


def test_join_of_repeated_and_missing_ids(spark):
    """One id for many texts, and none for many: classes are told apart by their words."""
    rng = random.Random(8)
    text = lambda: " ".join(f"v{rng.randrange(3000)}" for _ in range(40))
    base = [text() for _ in range(25)]
    rows = [(7, t) for t in base] + [(7, t + " more") for t in base[:10]] + [(None, t + " x y") for t in base[5:12]] + [(None, text()) for _ in range(20)] + [(40 + i, t) for i, t in enumerate(base[20:])]
    got = Counter(tuple(r) for r in similarity_join.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).select("doc_id", "class_id", "n_links").collect())
    links, first = grouped(rows)
    assert got == Counter((rows[i][0], first[i], links[i]) for i in range(len(rows)))


def test_join_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(similarity_join, "EXACT", 30)
    rng, rows = random.Random(9), []
    for g in range(3):
        base = [f"g{g}w{i}" for i in range(60)]
        for _ in range(70):
            own = list(base)
            for _ in range(rng.randrange(3)):
                own[rng.randrange(60)] = f"u{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(own)))
    links, first = grouped(rows)
    got = {r.doc_id: (r.class_id, r.n_links) for r in similarity_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: (first[i], links[i]) for i in range(len(rows))}


@tables
def test_join_recall_on_documents(spark):
    """All links of the table, by brute force over its pairs with a common shingle."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{MIDDLE}/documents.parquet").select("doc_id", "text").collect()]
    links, first = grouped(rows)
    got = {r.doc_id: r for r in queries.op7_similarity_join(spark, MIDDLE).collect()}
    assert sum(links.values()) > 0
    assert sum(got[d].n_links for d, _ in rows) >= 0.99 * sum(links.values())
    assert all(got[d].n_links <= links[i] for i, (d, _) in enumerate(rows))
    assert sum(got[d].class_id == first[i] for i, (d, _) in enumerate(rows)) >= 0.99 * len(rows)


def judged(docs, items, window=13):
    """For each text its words, words hit and the items found."""
    spans = {}
    for item, text in items:
        w = words(text)
        size = min(window, len(w))
        for i in range(len(w) - size + 1 if w else 0):
            spans.setdefault(tuple(w[i : i + size]), set()).add(str(item))
    lengths = {len(s) for s in spans}
    out = []
    for text in docs:
        w, hit, found = words(text), set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if own := spans.get(tuple(w[i : i + n])):
                    hit.update(range(i, i + n))
                    found |= own
        out.append((len(w), len(hit), sorted(found)))
    return out


def test_decontamination_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", 400)
    rng = random.Random(12)
    pool = [f"p{i}" for i in range(40)]
    some = lambda n: " ".join(rng.choice(pool) for _ in range(n))
    items = [(i, some(rng.randrange(1, 40))) for i in range(40)] + [(40, "p1"), (41, None), (42, "p3 p4")]
    texts = [some(30) + " " + (rng.choice(items)[1] or "")[: rng.randrange(5, 200)] if i % 3 else some(8) for i in range(60)] + ["", None, some(9000)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for window in (1, 4, 13):
        want = judged(texts, items, window)
        for r in decontamination.annotate(df, bench, window=window).collect():
            assert (r.n_words, r.n_hit, r["items"]) == want[r.doc_id]
            assert r.items_sha256 == hashlib.sha256(",".join(want[r.doc_id][2]).encode()).hexdigest()


@tables
def test_pipeline_stage_by_stage(spark):
    """Each stage of the pipeline against a plain version of it on what it was given."""
    read = lambda name: spark.read.parquet(f"{MIDDLE}/{name}.parquet")
    docs = read("documents")
    stages = dict(corpus_pipeline.STAGES)
    key = lambda rows: sorted((r.doc_id, r.text or "") for r in rows)
    rows = docs.collect()

    model = toxicity.fit_labels(docs, read("labels"))
    kept = stages["toxicity"](spark, docs, MIDDLE)
    assert kept.columns == docs.columns
    want = [r for r in rows if model.score(*toxicity._buffer([(r.text or "").encode()]))[0] < corpus_pipeline.TOXIC]
    assert key(kept.collect()) == key(want) and 0 < len(rows) - len(want) < 0.2 * len(rows)

    docs, rows = kept, want
    net = language.fit_documents(docs)
    ready = net.prepare()

    def known(text):
        raw = (text or "").encode()
        if not any(c.isalpha() for c in text or ""):
            return False
        x, filled, _ = language._windows(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        return (net.windows(x, ready).astype(float) * filled[:, None]).sum(0).max() / len(raw) >= corpus_pipeline.UNCLEAR

    kept = stages["language"](spark, docs, MIDDLE)
    want = [r for r in rows if known(r.text)]
    assert key(kept.collect()) == key(want)

    docs, rows = kept, want
    _, first = grouped([(r.doc_id, r.text) for r in rows])
    kept = stages["near_duplicates"](spark, docs, MIDDLE)
    want = [r for i, r in enumerate(rows) if first[i] == r.doc_id]
    assert key(kept.collect()) == key(want) and len(want) < len(rows)

    docs, rows = kept, want
    found = judged([r.text for r in rows], [(r.item_id, r.text) for r in read("benchmark").collect()])
    kept = stages["decontamination"](spark, docs, MIDDLE)
    want = [r for r, (n, hit, _) in zip(rows, found, strict=True) if not (hit and 20 * hit >= n)]
    assert key(kept.collect()) == key(want) and len(want) < len(rows)

    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(tokens.default_path())
    pieces = {}
    for r in stages["packing"](spark, kept, MIDDLE).collect():
        pieces.setdefault(r.doc_id, []).append((r.start, r.length, r.ids_crc32))
    for r in want:
        ids, at = np.array([*lib.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4"), 0
        for start, length, crc in sorted(pieces.pop(r.doc_id)):
            assert start == at and crc == zlib.crc32(ids[start : start + length].tobytes())
            at += length
        assert at == len(ids)
    assert not pieces


@tables
def test_pipeline_runs_in_order(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "language", "near_duplicates", "decontamination", "packing"]
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SMALL)
    pick = ["doc_id", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, corpus_pipeline.run(spark, SMALL).select(pick).collect())) == sorted(map(tuple, docs.select(pick).collect()))
