"""Small cases of the training-data operators: nulls, empty and long texts, ties, repeats,
empty tables, clashing columns; and brute force where SQL can't say it."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.llm import ann, chat, decontamination, language, packing, sharding, shared, similarity_join, token_files, tokens, toxicity, warc

DOC = "doc_id long, text string, lang string, score string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(n, seed):
    rng = random.Random(seed)
    return [f"w{rng.randrange(5000)}" for _ in range(n)]


@pytest.fixture(scope="module")
def docs(spark):
    base = words(200, 1)
    near = [*base[:100], "other", *base[101:]]
    rows = [(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(base)), (4, None), (5, ""), (6, "!!! ???"), (7, "short text"), (8, " ".join(words(30000, 2))), (None, "no id here"), (7, "short text"), (9, "é ß 漢字 " * 50), (10, "a <|endoftext|> b<|endoftext|>"), (11, "<|endoftext|>\n x")]
    return spark.createDataFrame([(i, t, "en", "x") for i, t in rows], DOC)


def brute_tokens(text):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(tokens.default_path())
    return [*lib.encode(text or "", add_special_tokens=False).ids, 0]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_nearest(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((400, 12))
    x[300:] = x[7]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(500, None), (501, [0.0] * 12), (502, [float("nan")] * 12), (503, [1.0]), (None, x[0].tolist()), (3, x[3].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.search(df, df.where("vec_id % 50 = 0"), leaf_rows=64).collect()
    hit = 0
    for q in range(0, 400, 50):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        want = sorted((float(d[i]), i) for i in range(400) if i != q)[:10]
        mine = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        assert [m[0] for m in mine] == list(range(1, 11))
        assert all(m[2] == float(d[m[1]]) for m in mine)
        hit += len({m[1] for m in mine} & {w[1] for w in want})
    assert hit >= 0.9 * 80
    assert ann.search(df.limit(0), df.limit(0)).count() == 0


def test_nearest_repeated_rows_beside_copies(spark):
    """A repeated row takes no place of other ids with the same vector."""
    rng = np.random.default_rng(6)
    far = rng.standard_normal((40, 8)) + 20
    x = [1.0] * 8
    rows = [(7, x)] * 20 + [(100 + i, x) for i in range(12)] + [(200 + i, v.tolist()) for i, v in enumerate(far)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1)
    asked = spark.createDataFrame([(1, [1.0] * 7 + [1.5])], "vec_id long, embedding array<double>")
    got = ann.search(df, asked).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(i, 0.5) for i in (7, *range(100, 109))]


def test_packing(spark, docs):
    rows = packing.pack(docs, tokens.default_path()).collect()
    seen = {}
    for r in rows:
        seen.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, r.length))
    for own in docs.collect():
        ids = brute_tokens(own.text)
        mine = [r for r in rows if r.doc_id == own.doc_id and r.doc_tokens == len(ids)]
        assert {(r.start, r.ids_crc32) for r in mine} >= {(r.start, crc(ids[r.start : r.start + r.length])) for r in mine}
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in by.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= 1024
    assert sum(r.length for r in rows) == sum(len(brute_tokens(d.text)) for d in docs.collect())
    assert packing.pack(docs.limit(0), tokens.default_path()).count() == 0


def test_perspectives(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi <|im_end|>"), (1, 2, "bob", None), (1, 2, "bob", None), (1, None, None, "first"), (None, 0, "ann", "alone"), (2, 0, "system", "no one")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for size in (1 << 18, 20):
        made = chat.rotate(df, part_chars=size).orderBy("conv_id", "speaker", "part").collect()
        whole = {}
        for r in made:
            whole[r.conv_id, r.speaker] = whole.get((r.conv_id, r.speaker), "") + r.text
            runs = [tuple(map(int, m.split(":"))) for m in r.mask.split(",")]
            assert sum(n for n, _ in runs) == len(r.text)
        assert set(whole) == {(1, "ann"), (1, "bob"), (1, "unknown"), (None, "ann")}
        assert whole[1, "ann"] == "<|im_start|>user name=unknown\nfirst<|im_end|>\n<|im_start|>system\nbe kind<|im_end|>\n<|im_start|>assistant\nhi < |im_end|><|im_end|>\n" + "<|im_start|>user name=bob\n<|im_end|>\n" * 2
    assert chat.rotate(df.limit(0)).count() == 0


def test_warc_round_trip(spark):
    big = "x" * 1500
    rows = [(1, "http://a/\r\nb", big), (2, None, big), (3, "http://c", None), (4, "http://d", "é" * 300), (5, "http://e", "é" * 300), (2, None, big), (None, "http://n", big)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = warc.captures(warc.records(spark, warc.write(df))).collect()
    assert len(found) == len(rows) and all(r.request and len(r.metadata) == 1 for r in found)
    assert sorted(bytes(r.response.payload or b"").decode() for r in found if r.response.type == "response") == sorted(["é" * 300, "é" * 300, "", big, big])
    flat = warc.resolve(warc.captures(warc.records(spark, warc.write(df)))).collect()
    digest = hashlib.sha1(big.encode()).hexdigest()
    assert sorted((str(r.page_id), r.record_type, r.refers_to) for r in flat if r.payload_digest == digest) == sorted([("1", "revisit", 2), ("2", "response", None), ("2", "response", None), ("None", "revisit", 2)])
    assert warc.records(spark, warc.write(df.limit(0))).count() == 0


def test_sharding(spark):
    df = spark.range(1003).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.lit(9).alias("slot")).repartition(7)
    rows = sharding.shuffle(df, block_rows=40).collect()
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r)
    assert sorted(len(v) for v in by.values()) == [125] * 5 + [126] * 3
    assert all(sorted(r.slot for r in v) == list(range(len(v))) for v in by.values())
    assert {r.doc_id for r in rows} == set(range(1003))
    assert sharding.shuffle(df.limit(0)).count() == 0


def test_communication_matrix_is_hypergeometric():
    counts, room = [30, 50, 20], [40, 60]
    first = [sharding.Deal(counts, room, seed).row(1)[0] for seed in range(2000)]
    assert all(sum(sharding.Deal(counts, room, s).row(p)[0] for p in range(3)) == 40 for s in range(20))
    assert abs(np.mean(first) - 20) < 0.3 and abs(np.var(first) - 50 * 0.4 * 0.6 * 50 / 99) < 0.8


def test_language():
    rng = random.Random(0)
    texts = [" ".join(rng.choice(a) for _ in range(40)) for a in (["the", "thing", "ing"], ["und", "sch", "über"]) for _ in range(60)]
    net = language.fit(texts, ["en"] * 60 + ["de"] * 60, steps=150)
    x, filled, bounds = language._windows(np.frombuffer(b"the thing ingund \xc3\xbcber sch", np.uint8), np.array([0, 13, 13, 26]))
    assert bounds.tolist() == [0, 1, 1, 2] and filled.tolist() == [13, 13]
    assert net.windows(x, net.prepare()).argmax(1).tolist() == [1, 0]


def test_language_rows(spark, docs):
    net = language.fit(["the thing " * 20, "und sch über " * 20], ["en", "de"], steps=50)
    got = {(r.doc_id, r.text): r for r in language.predict(docs, net).collect()}
    assert len(got) == 12 and got[4, None].lang_pred == got[5, ""].lang_pred == got[6, "!!! ???"].lang_pred == "und"
    assert all(0 <= r.score <= 1 for r in got.values())
    assert language.predict(docs.limit(0), net).count() == 0
    assert language.fit_documents(docs.limit(0)).languages == []


def test_similarity_join(spark, docs):
    got = similarity_join.join(docs).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == docs.count()
    assert by[1].class_id == by[2].class_id == by[3].class_id == 1 and by[1].n_links == 2
    assert by[4].class_id == 4 and by[5].n_links == by[6].n_links == 0 and by[7].n_copies == 2
    kept = similarity_join.deduplicate(docs).collect()
    assert sorted(str(r.doc_id) for r in kept) == sorted(["1", "10", "11", "4", "5", "6", "7", "8", "9", "None"])
    assert similarity_join.join(docs.limit(0)).count() == 0


def test_similarity_join_beyond_the_broadcast(spark, docs, monkeypatch):
    want = sorted(map(tuple, similarity_join.join(docs).collect()), key=str)
    kept = sorted(map(str, similarity_join.deduplicate(docs).collect()))
    monkeypatch.setattr(similarity_join, "BROADCAST_IDS", -1)
    monkeypatch.setattr(shared, "BROADCAST_IDS", -1)
    assert sorted(map(tuple, similarity_join.join(docs).collect()), key=str) == want
    assert sorted(map(str, similarity_join.deduplicate(docs).collect())) == kept


def test_deduplicate_by_row(spark):
    """Ids with several texts and rows without an id: one row of each group stays."""
    base, other, third = words(80, 50), words(80, 51), words(80, 52)
    near = [*base[:40], "x", *base[41:]]
    rows = [(1, " ".join(base)), (2, " ".join(near)), (2, "one of a kind"), (3, " ".join(other)), (3, " ".join(words(60, 53)))]
    rows += [(3, " ".join(other))] * 3 + [(None, " ".join(third))] * 4 + [(None, " ".join([*third[:79], "y"])), (None, " ".join(other)), (None, "alone without id")]
    rows += [(5, " ".join(words(70, 54))), (5, " ".join([*words(70, 54)[:69], "z"])), (6, None), (6, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.text) for r in similarity_join.deduplicate(df).collect()), key=str)
    free = [r for r in got if r[0] == 5]
    assert len(free) == 1 and free[0] in rows
    null = [r for r in got if r[0] is None]
    assert len(null) == 2 and (None, "alone without id") in null and all(r in rows for r in null)
    assert [r for r in got if r[0] not in (None, 5)] == sorted([rows[0], rows[2], rows[3], rows[4], (6, None), (6, None)], key=str)


def test_similarity_join_large_group(spark):
    """A group larger than a bucket: brute force over its near copies."""
    base = words(60, 4)
    rows = [(i, " ".join([*base[: i % 50], f"u{i}", *base[i % 50 + 1 :]])) for i in range(700)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {i: {tuple(t.split()[j : j + 5]) for j in range(56)} for i, t in rows}
    want = {i: sum(5 * len(s & o) >= 4 * len(s | o) for j, o in sets.items() if j != i) for i, s in sets.items()}
    assert {r.doc_id: r.n_links for r in similarity_join.join(df).collect()} == want


def test_similarity_join_mixed_buckets(spark, monkeypatch):
    """Buckets of a group and others, blocks and splits: brute force over all pairs."""
    monkeypatch.setattr(similarity_join, "BUCKET", 16)
    monkeypatch.setattr(similarity_join, "EXACT", 20)
    rng, rows, common = random.Random(5), [], words(40, 6)
    for g, n in enumerate((90, 60, 25, 25, 1, 1, 1)):
        base = common + words(40, 10 + g)
        for _ in range(n):
            text = list(base)
            for _ in range(rng.randrange(3)):
                text[rng.randrange(80)] = f"u{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(text)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {i: {tuple(t.split()[j : j + 5]) for j in range(76)} for i, t in rows}
    want = {i: sum(5 * len(s & o) >= 4 * len(s | o) for j, o in sets.items() if j != i) for i, s in sets.items()}
    assert {r.doc_id: r.n_links for r in similarity_join.join(df).collect()} == want


def test_toxicity():
    rng = random.Random(2)
    plain = [" ".join(rng.choice(["ander", "thing", "ation", "other"]) for _ in range(60)) for _ in range(200)]
    bad = [p.replace("other", "idiotic scum", 4) for p in plain[:100]]
    model = toxicity.fit(bad, plain[100:])
    score = model.score(*toxicity._buffer([plain[5].encode(), bad[6].encode(), b""]))
    assert score[0] < 0.5 < score[1] and 0 <= score[2] <= 1


def test_toxicity_rows(spark, docs):
    model = toxicity.fit_labels(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score(docs, model).count() == docs.count()
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_token_files(spark, docs):
    rows = token_files.read(spark, token_files.write(docs, tokens.default_path()), ids=True).orderBy("start").collect()
    start = 0
    for r in rows:
        assert r.start == start and r.n_tokens == len(r.ids) and r.ids_crc32 == crc(r.ids)
        start += r.n_tokens
    assert sorted(map(tuple, (r.ids for r in rows))) == sorted(tuple(brute_tokens(d.text)) for d in docs.collect())
    assert [r.doc_id for r in rows] == [None, 1, 2, 3, 4, 5, 6, 7, 7, 8, 9, 10, 11]
    assert token_files.read(spark, token_files.write(docs.limit(0), tokens.default_path())).count() == 0


def test_decontamination(spark, docs):
    item = " ".join(words(200, 1)[20:50]).upper()
    bench = spark.createDataFrame([(1, item), (2, "short text"), (3, None), (None, "no id here"), (4, "nowhere to be found")], "item_id long, text string")
    by = {r.doc_id: r for r in decontamination.annotate(docs, bench).collect()}
    assert (by[1].n_words, by[1].n_hit, by[1].items, by[1].contaminated) == (200, 30, ["1"], True)
    assert by[7].contaminated and not by[8].contaminated and by[4].n_words == 0 and not by[4].contaminated
    assert decontamination.annotate(docs, bench.limit(0)).where("contaminated").count() == 0
    assert decontamination.remove(docs.limit(0), bench).count() == 0
    best = {(r.item, r.item_word): r for r in decontamination.longest_matches(docs, bench).collect()}
    assert best["1", 0].words == 30 and best["1", 0].doc_word == 20


def test_longest_matches_in_a_tied_run(spark):
    """A passage stands in many documents, a later one goes on: brute force over all."""
    item = words(260, 30)
    texts = [[*words(5, 40 + i), *item[:20], *words(5, 80 + i)] for i in range(12)]
    texts += [[*words(9, 60), *item[:220], "end"], item[:20], [*item[3:40], *item[3:90]], [], words(50, 61), item[100:240]]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    bench = spark.createDataFrame([("a", " ".join(item)), ("b", " ".join(item[3:60])), ("c", "not there")], "item_id string, text string")

    def longest(suffix):
        best = 0
        for t in texts:
            for i in range(len(t)):
                n = 0
                while n < len(suffix) and i + n < len(t) and t[i + n] == suffix[n]:
                    n += 1
                best = max(best, n)
        return best

    got = {(r.item, r.item_word): r for r in decontamination.longest_matches(df, bench).collect()}
    for name, own in (("a", item), ("b", item[3:60])):
        want = {i: n for i in range(len(own)) if (n := longest(own[i:]))}
        assert {k[1]: r.words for k, r in got.items() if k[0] == name} == want
        for i, n in want.items():
            r = got[name, i]
            assert texts[r.doc_id][r.doc_word : r.doc_word + n] == own[i : i + n]
    assert got["a", 0].words == 220


def test_decontamination_wide_windows(spark):
    """Windows wider than the depth of one look-up."""
    item = words(60, 31)
    rng = random.Random(7)
    texts = [[*item[: rng.randrange(17, 60)], *words(4, 90 + i), *item[rng.randrange(30) :]] for i in range(30)]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    bench = spark.createDataFrame([("a", " ".join(item))], "item_id string, text string")
    for size in (24, 40):
        spans = {tuple(item[i : i + size]) for i in range(60 - size + 1)}
        want = {}
        for d, t in enumerate(texts):
            want[d] = len({p for i in range(len(t) - size + 1) if tuple(t[i : i + size]) in spans for p in range(i, i + size)})
        assert {r.doc_id: r.n_hit for r in decontamination.annotate(df, bench, window=size).collect()} == want


def test_item_ids_stay_as_they_are(spark):
    """Ids that end in NUL, hold quotes or commas, or are very long."""
    text = " ".join(f"w{i}" for i in range(14))
    ids = ["x\0", "x", 'a "quoted" one', "a,b", "y" * 5000, "é", ""]
    bench = spark.createDataFrame([(i, text) for i in ids], "item_id string, text string")
    df = spark.createDataFrame([(1, text), (2, "nothing of it")], "doc_id long, text string")
    got = {r.doc_id: r for r in decontamination.annotate(df, bench).collect()}
    assert got[1]["items"] == sorted(ids) and got[1].n_items == len(ids) and got[2].n_items == 0
    assert got[1].items_sha256 == hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
