"""Collocations, line dedup and spelling variants against plain versions of them."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lodestar.llm import collocations, line_dedup, queries, spelling

SMALL = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, score string, `a.b` int, rank int, word string, n_lines int"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
tables = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")


def frame(spark, rows):
    return spark.createDataFrame([(i, t, g, "x", 1, 2, "w", 3) for i, t, g in rows], DOC)


def brute_phrases(rows, depth, least, top):
    n, f = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            w = re.findall(r"[^ \t]+", piece)
            n[lang] += len(w)
            for m in range(1, depth + 1):
                for i in range(len(w) - m + 1):
                    f[lang, tuple(w[i : i + m])] += 1
    known = {k: a for k, a in f.items() if a >= least and len(k[1]) > 1}
    out = defaultdict(list)
    for (lang, p), a in known.items():
        if any(g == lang and len(q) > len(p) and b >= a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for (g, q), b in known.items()):
            continue
        score, _, left, right = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        out[lang].append((-score, -a, " ".join(p).encode(), left, right))
    return sorted((lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for lang, found in out.items() for i, (s, a, p, left, right) in enumerate(sorted(found)[:top]))


def told(df):
    return sorted(tuple(r) for r in df.collect())


def prose(seed, n, words=12):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(words)] + ["É\x01b", "über", "x\x00", "The", "THE"]
    return "".join(rng.choice(vocabulary) + rng.choice([" ", " ", " ", "\t ", ". ", ",", "\n", "\r\n", "  "]) for _ in range(n))


def test_collocations(spark, monkeypatch):
    rows = [(i, prose(i, 60), ["en", "de", None, "a'b"][i % 4]) for i in range(40)]
    rows += [(100, None, "en"), (None, "", None), (101, "...", "en"), (102, prose(9, 3000), "en"), (103, "one two three four five six " * 30, "xx"), (103, "one two three four five six " * 30, "xx")]
    for shard, depth, least, top in ((collocations.SHARD_BYTES, 5, 3, 2000), (50, 4, 3, 7), (2000, 2, 1, None)):
        monkeypatch.setattr(collocations, "SHARD_BYTES", shard)
        got = collocations.mine(frame(spark, rows).repartition(3), depth, least, top)
        assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
        assert told(got) == brute_phrases(rows, depth, least, top)


def test_collocations_shards_are_cut_between_pieces(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(collocations, "SHARD_BYTES", 40)
    texts = ["a b c, " * 20, "d e", "f g h i " * 30, "", "j. k. l."]
    batch = pa.RecordBatch.from_pydict({"lang": ["x"] * 5, "text": texts})
    shards = list(collocations._shards(iter([batch])))
    assert sum(len(s.rank) for s in shards) == sum(len(re.findall(r"[^ .,]+", t)) for t in texts)
    # the piece without a separator is whole
    assert max(len(s.rank) for s in shards) == 120 and len(shards) > 4


def counting(monkeypatch, batches, size, rest):
    """The batches that a task of ``_counts`` gives, run here."""

    class Frame:
        mapInArrow = staticmethod(lambda count, schema: count)  # noqa: N815

    monkeypatch.setattr(collocations, "small_batches", lambda df: Frame)
    return collocations._counts(None, size, None, rest)(iter(batches))


def test_collocations_blocks_of_a_shard(monkeypatch):
    """Blocks cut between first words, and shards bounded by words, count the same phrases."""
    import pyarrow as pa

    rows = [(i, prose(i, 300, 40), "en" if i % 3 else "de") for i in range(12)] + [(20, "same same same same " * 50, "en")]
    batch = pa.RecordBatch.from_pydict({"lang": [g for *_, g in rows], "text": [t for _, t, _ in rows]})
    for block, words in ((64, 1 << 20), (128, 500), (1 << 17, 1 << 20)):
        monkeypatch.setattr(collocations, "BLOCK", block, raising=False)
        monkeypatch.setattr(collocations, "SHARD_WORDS", words, raising=False)
        found, longer = Counter(), Counter()
        for out in counting(monkeypatch, [batch], 3, True):
            assert out.num_rows <= block
            for lang, phrase, n in zip(*(c.to_pylist() for c in out.columns), strict=True):
                w = phrase.split(" ")
                if n:
                    found[lang, phrase] += n
                else:
                    longer.update((lang, " ".join(w[i : i + 4])) for i in range(len(w) - 3))
        want = {3: Counter(), 4: Counter()}
        for _, text, lang in rows:
            for piece in re.split(r"[.,;:!?\n-\r]", text.translate(LOWER)):
                w = re.findall(r"[^ \t]+", piece)
                for m in want:
                    want[m].update((lang, " ".join(w[i : i + m])) for i in range(len(w) - m + 1))
        assert found == want[3] and longer == want[4]


def test_collocations_memory_of_a_shard(monkeypatch):
    """Arrays of a counting task stay below 40 bytes a word, and its batches are small."""
    import tracemalloc

    import pyarrow as pa

    text, words = prose(1, 20_000, 5000), 800_000
    batches = [pa.RecordBatch.from_pydict({"lang": ["en"], "text": [text]})] * (words // 20_000)
    tracemalloc.start()
    try:
        rows = [out.num_rows for out in counting(monkeypatch, batches, 3, True)]
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert sum(rows) and max(rows) <= 1 << 17
    assert peak < 40 * words


def test_collocations_scores_are_exact(spark):
    """Products beyond 64 bits, where doubles would round."""
    a, n, left, right = 3_000_000_007, 900_000_000_000_001, 3_000_000_019, 4_000_000_007
    row = spark.createDataFrame([(a, n, [left], [right])], "a long, n long, ls array<long>, rs array<long>")
    best = row.select(collocations._score().alias("b")).first().b
    assert (best.score, best.k, best.l, best.r) == (1000 * a * n // (left * right), 1, left, right)


def test_collocations_empty(spark):
    assert collocations.mine(frame(spark, [])).count() == 0
    assert collocations.mine(frame(spark, [(1, None, None), (2, "once only", "en")])).count() == 0


def brute_lines(rows, chars, least):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    held = defaultdict(set)
    for i, text, _ in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= chars:
                held[key(line)].add(line_dedup.NO_ID if i is None else i)
    out = []
    for i, text, _ in rows:
        lines = (text or "").split("\n")
        own = line_dedup.NO_ID if i is None else i
        kept = [x for x in lines if not (len(key(x)) >= chars and len(held[key(x)]) >= least and max(held[key(x)]) != own)]
        out.append((str(i), len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


def line_rows():
    rng = random.Random(4)
    common = [f"{x} line that stands in many documents" for x in "abcdefgh"] + ["É" * 20, "é" * 20, "É" * 19, "short"]
    rows = []
    for i in range(60):
        lines = [rng.choice(common) if rng.random() < 0.6 else f"own line {i} {rng.random()}" for _ in range(rng.randrange(8))]
        lines = [rng.choice(["", " ", "\t\x0b"]) + (x.upper() if rng.random() < 0.2 and x.isascii() else x) + rng.choice(["", "\r", "  "]) for x in lines]
        rows.append((i * 7 % 60, "\n".join(lines) + rng.choice(["", "\n", "\n\n"]), "en"))
    rows += [(None, common[0] + "\n" + common[1], "en"), (None, common[0], "en"), (70, None, "en"), (71, "", "en"), (5, common[2], "en"), (5, common[2] + "\nmore", "en"), (72, "\n\n", "en"), (80, "\n".join(f"line number {k % 900} of a long document" for k in range(2000)), "en")]
    return rows


@pytest.mark.parametrize("batches,fanout", [(1, 2), (6, 2), (7, 3)])
def test_lines(spark, batches, fanout):
    rows = line_rows()
    got = line_dedup.deduplicate(frame(spark, rows).repartition(3), batches=batches, fanout=fanout)
    assert got.columns == ["doc_id", "text", "lang", "score", "a.b", "rank", "word", "n_lines", "n_lines_", "n_dropped", "kept"]
    assert sorted((str(r.doc_id), r.n_lines_, r.n_dropped, r.kept) for r in got.collect()) == brute_lines(rows, 20, 3)
    assert line_dedup.deduplicate(frame(spark, []), batches=batches).count() == 0


def test_line_runs(spark, tmp_path):
    """A batch returns the keys that no run holds; runs are compacted; joins with them move
    only the batch."""
    runs = line_dedup.LineRuns(spark, str(tmp_path), fanout=2)
    rows = lambda *keys: spark.createDataFrame([(k, k, 1, 100 - k) for k in keys], "h1 long, h2 long, docs long, keeper long")
    new = [sorted(r.h1 for r in runs.add(rows(*k)).collect()) for k in ([1, 2], [2, 3], [1, 4], [4, 5])]
    assert new == [[1, 2], [3], [4], [5]]
    assert [len(x) for x in runs.levels] == [0, 0, 1]
    assert sorted(tuple(r) for r in runs.merged().collect()) == [(1, 1, 2, 99), (2, 2, 2, 98), (3, 3, 1, 97), (4, 4, 2, 96), (5, 5, 1, 95)]
    runs.add(rows(9, 2))
    assert sorted(tuple(r) for r in runs.merged().collect())[1] == (2, 2, 3, 98)
    plan = runs.merged()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    runs.close()


def brute_words(rows, chars=5, least=3, every=97):
    n = Counter()
    for i, text, _ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    known = {w: c for w, c in n.items() if len(w) >= chars and c >= least}
    shorter = defaultdict(set)
    for w in known:
        for k in range(len(w)):
            shorter[w[:k], w[k + 1 :]].add(w)  # one letter replaced
            shorter[w[:k] + w[k + 1 :]].add(w)
    near = defaultdict(set)
    for key, group in shorter.items():
        for w in group:
            if isinstance(key, tuple):
                near[w] |= group - {w}
            elif key in known:
                near[w].add(key)
                near[key].add(w)
    form = {}
    for w, c in known.items():
        best = min(((-known[o], o) for o in near[w]), default=None)
        form[w] = best[1] if best and -best[0] >= 2 * c else None
    out = []
    for w, c in known.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, c, len(near[w]), known[form[w]] if form[w] else None))
    return sorted(out, key=str)


def variants(seed, n):
    rng = random.Random(seed)
    letters = "abcdeéÿ×÷À"
    base = ["".join(rng.choice(letters) for _ in range(rng.randrange(4, 10))) for _ in range(60)] + ["abababab", "aaaaaa", "x" * 300, "ÿ" * 40]
    text = []
    for _ in range(n):
        w = rng.choice(base)
        k = rng.randrange(len(w))
        w = rng.choice([w, w, w[:k] + w[k + 1 :], w[:k] + rng.choice(letters) + w[k:], w[:k] + rng.choice(letters) + w[k + 1 :], w.upper()])
        text.append(w + rng.choice([" ", "-", "1", "\n", "Ā", "漢"]))
    return "".join(text)


@pytest.mark.parametrize("limit", [2048, 3])
def test_spelling(spark, limit):
    rows = [(i, variants(i, 300), "en") for i in range(12)] + [(None, variants(3, 50), None), (50, None, "en"), (51, "", "en"), (3, variants(3, 300), "en"), (52, "1234 .. Ā", "en"), (53, "z" * 50000, "en")]
    got = spelling.group(frame(spark, rows).repartition(3), every=7, limit=limit)
    assert sorted(((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in got.collect()), key=str) == brute_words(rows, every=7)
    assert spelling.group(frame(spark, [])).count() == 0


@tables
def test_spelling_query(spark):
    rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    got = queries.op13_spelling(spark, SMALL)
    want = brute_words(rows)
    assert sum(w[1] is not None for w in want) > 10
    assert sorted(((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in got.collect()), key=str) == want


@tables
def test_line_query(spark):
    rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    got = sorted((str(r.doc_id), r.n_lines, r.n_dropped, r.kept_sha256) for r in queries.op12_line_dedup(spark, SMALL).collect())
    assert got == [(i, n, d, hashlib.sha256(t.encode()).hexdigest()) for i, n, d, t in brute_lines(rows, 20, 3)]
    assert spark.read.parquet(f"{SMALL}/documents.parquet").where(F.col("text").contains("\n")).count() > 0
