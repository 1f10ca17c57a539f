"""Whole requests and benches over ``embeddings`` with ``part`` as metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cells, search
from ..plans import benches, request
from .common import collect, r6, table
from .vectors import _SEG, _asked, _segments, _top, _vectors

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

FIELDS = {"p_size": "integer", "p_type": "keyword", "p_retailprice": "float", "label": "integer", "colour": "keyword"}
_RULES = [("large", "size", "p_size", 1, "large"), ("huge", "size", "p_size", 2, "huge"), ("red", "colour", "colour", 1, "red")]


def _store(spark: SparkSession, sf_dir: str) -> request.Store:
    rules = spark.createDataFrame(_RULES, "concept string, family string, field string, specificity int, word string")
    return request.Store(_segments(spark, sf_dir), FIELDS, rules)


def _ask(spark: SparkSession, sf_dir: str, **options) -> tuple[DataFrame, dict]:
    store = _store(spark, sf_dir)
    return request.run(spark, request.Request(search.probe(store.rows, 0), **options), store)


def _shown(hits: DataFrame) -> DataFrame:
    return hits.select("vec_id", F.col("rank").cast("long").alias("rank"), r6("dist").alias("dist"), "p_name", "p_size")


def _hits(where: str) -> str:
    return f"WITH {_SEG}, h AS ({_top(f'(SELECT * FROM seg WHERE {where})')}) SELECT vec_id, rank, dist, p_name, p_size FROM h JOIN part ON vec_id = p_partkey"


@collect(QUERIES, ORACLES, _hits("p_size >= 20 AND p_type = 'PROMO'"))
def search_request(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text asks for a size of 20 at least, the user for a type; no part has the
    colour's field, so that concept goes."""
    return _shown(_ask(spark, sf_dir, text="red ones, at least 20 large", parser="rules", filters={"p_type": "PROMO"})[0])


@collect(QUERIES, ORACLES, _hits("p_size BETWEEN 5 AND 30"))
def search_explicit_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The user's range stands in place of the text's."""
    return _shown(_ask(spark, sf_dir, text="at least 40 large", parser="rules", filters={"p_size": (5, 30)})[0])


@collect(QUERIES, ORACLES, _hits("p_type = 'PROMO'"))
def search_relaxed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No part is so large: only what the user asked for stays."""
    return _shown(_ask(spark, sf_dir, text="at least 400 huge", parser="rules", filters={"p_type": "PROMO"}, relaxation="auto_soft")[0])


@collect(QUERIES, ORACLES, _hits("p_size <= 12 AND label = 3"))
def search_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Constraints from a parser's checked answer."""
    answer = '{"constraints": [{"field": "p_size", "operator": "lte", "value": 12}, {"field": "label", "operator": "range", "value": [3, 3]}]}'
    return _shown(_ask(spark, sf_dir, parser="response", answer=answer)[0])


@collect(QUERIES, ORACLES, "WITH c AS (SELECT count(*) FILTER (WHERE p_type = 'PROMO' AND p_size >= 49) AS candidates, count(*) FILTER (WHERE p_type = 'PROMO') AS hard FROM embeddings JOIN part ON vec_id = p_partkey) SELECT candidates, least(candidates, 10) AS returned, candidates < 10 AS short, CASE WHEN candidates < 10 THEN 'candidate_shortage' ELSE 'none' END AS reason, CASE WHEN least(candidates, 10) >= 10 THEN 1 ELSE 4 END AS selected, true AS correct, concat_ws(',', candidates, candidates, candidates, hard) AS passes FROM c")
def search_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a request tells of itself, relaxation only being looked at."""
    told = _ask(spark, sf_dir, text="at least 49 large", parser="rules", filters={"p_type": "PROMO"}, relaxation="diagnose_only", least=10)[1]
    row = (told["candidate_count"], told["returned_count"], told["underfilled"], told["underfilled_reason"] or "none", told["selected_pass"], told["filter_correct"], ",".join(str(p["matching"]) for p in told["passes"]))
    return spark.createDataFrame([row], "candidates long, returned long, short boolean, reason string, selected int, correct boolean, passes string")


@collect(QUERIES, ORACLES, f"WITH {_SEG}, w AS (SELECT label, dist, vec_id * 10.0 AS t0, vec_id * 10.0 + 15 AS t1 FROM (SELECT * FROM seg ORDER BY dist, vec_id LIMIT 200)), r AS (SELECT *, max(t1) OVER (PARTITION BY label ORDER BY t0, t1, 1 - dist ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM w), i AS (SELECT *, sum(CASE WHEN t0 - reach <= 60 THEN 0 ELSE 1 END) OVER (PARTITION BY label ORDER BY t0, t1, 1 - dist) AS island FROM r), m AS (SELECT label, min(t0) AS t_start, max(t1) AS t_end, max(1 - dist) AS score, count(*) AS n FROM i GROUP BY label, island ORDER BY score DESC, label, t_start LIMIT 10) SELECT label, t_start, t_end, round(score, 6) AS score, n FROM m")
def search_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two hundred hits are merged where their spans are near; ten spans stay."""
    store = _store(spark, sf_dir)
    start = F.col("vec_id") * F.lit(10.0)
    spans = request.Store(store.rows.withColumns({"t_start": start, "t_end": start + 15}), FIELDS)
    hits, _ = request.run(spark, request.Request(search.probe(store.rows, 0), merge_gap=60.0), spans, key_col="label")
    return hits.select("label", "t_start", "t_end", r6("score").alias("score"), "n")


def _bench(strategy: str, fetch: int, where: str, names: str) -> str:
    within = "seg" if strategy == "prefilter" else f"(SELECT * FROM seg ORDER BY dist, vec_id LIMIT {10 * fetch})"
    found = f"(SELECT vec_id FROM {within} WHERE {where} ORDER BY dist, vec_id LIMIT 10)"
    truth = f"(SELECT vec_id FROM seg WHERE {where} ORDER BY dist, vec_id LIMIT 10)"
    return f"SELECT {names}, (SELECT count(*) FROM {found}) AS found, (SELECT count(*) FROM {truth}) AS truth, (SELECT count(*) FROM {found} JOIN {truth} USING (vec_id)) AS common"


_SHARES = {"half": "p_size <= 25", "tenth": "p_size <= 5"}
_MATRIX = " UNION ALL ".join(_bench(s, 5, w, f"'{s}' AS strategy, '{n}' AS filter, 'ok' AS status") for n, w in _SHARES.items() for s in ("prefilter", "postfilter"))
_SWEEP = " UNION ALL ".join(_bench("postfilter", m, "p_size <= 10", f"{m} AS multiple") for m in (1, 2, 5, 10))
_RECALL = "CASE WHEN truth = 0 THEN 1.0 ELSE round(CAST(common AS DOUBLE) / truth, 6) END AS recall"


@collect(QUERIES, ORACLES, f"WITH {_SEG}, b AS ({_MATRIX}) SELECT strategy, filter, status, found, truth, {_RECALL} FROM b UNION ALL SELECT 'graph', unnest(['half', 'tenth']), 'unsupported_strategy', NULL, NULL, NULL")
def strategy_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _segments(spark, sf_dir)
    made = benches.matrix(rows, search.probe(rows, 0), 10, ["prefilter", "postfilter", "graph"], {n: F.expr(w) for n, w in _SHARES.items()})
    return made.withColumn("recall", r6("recall"))


@collect(QUERIES, ORACLES, f"WITH {_SEG}, b AS ({_SWEEP}) SELECT multiple, found, truth, {_RECALL} FROM b")
def fetch_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _segments(spark, sf_dir)
    query, where = search.probe(rows, 0), F.col("p_size") <= 10
    truth = search.prefilter(rows, query, 10, where)
    return benches.sweep(lambda m: search.postfilter(rows, query, 10, where, m), (1, 2, 5, 10), truth, "multiple").withColumn("recall", r6("recall"))


@collect(QUERIES, ORACLES, "SELECT dim, round(avg(n) / 10, 6) AS recall FROM (" + " UNION ALL ".join(f"SELECT {d} AS dim, t.query_id, count(f.vec_id) AS n FROM (SELECT a.vec_id AS query_id, b.vec_id FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0 QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY 1 - list_cosine_similarity(b.embedding::DOUBLE[], a.embedding::DOUBLE[]), b.vec_id) <= 10) t LEFT JOIN (SELECT a.vec_id AS query_id, b.vec_id FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0 QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY 1 - list_cosine_similarity(b.embedding[1:{d}]::DOUBLE[], a.embedding[1:{d}]::DOUBLE[]), b.vec_id) <= 10) f USING (query_id, vec_id) GROUP BY t.query_id" for d in (16, 32, 64)) + ") GROUP BY dim")
def quality_by_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall at ten of shortened vectors, by their length, over the stated queries."""
    rows = _vectors(spark, sf_dir)
    asked = _asked(rows)
    truth = search.many(rows, asked, 10).select("query_id", "vec_id")
    made = None
    for dim in (16, 32, 64):
        short = search.many(rows.withColumn("embedding", F.slice("embedding", 1, dim)), asked.withColumn("query", F.slice("query", 1, dim)), 10)
        found = truth.join(short.select("query_id", "vec_id", F.lit(1).alias("f")), ["query_id", "vec_id"], "left")
        one = found.groupBy("query_id").agg(F.count("f").alias("n")).agg(F.lit(dim).alias("dim"), r6(F.avg("n") / 10).alias("recall"))
        made = one if made is None else made.union(one)
    return made


@collect(QUERIES, ORACLES, f"WITH {_SEG}, h AS ({_top('(SELECT * FROM seg WHERE p_size > 10)')}) SELECT vec_id, rank, dist, CAST(0 AS BIGINT) AS only_first, CAST(0 AS BIGINT) AS only_second FROM h")
def repeated_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hits of a search, and what only one of two runs of it found."""
    rows = _segments(spark, sf_dir)
    query = search.probe(rows, 0)
    run = lambda: search.ranked(search.prefilter(rows, query, 10, F.col("p_size") > 10)).select("vec_id", F.col("rank").cast("long").alias("rank"), "dist")
    told = benches.repeatable(run).select("only_first", "only_second")
    return run().withColumn("dist", r6("dist")).join(F.broadcast(told))


@collect(QUERIES, ORACLES, "SELECT model, round(without, 6) AS without, round(filtered, 6) AS filtered, round(filtered - without, 6) AS gain FROM (SELECT 'price' AS model, avg(o_totalprice) AS without, avg(o_totalprice) FILTER (WHERE o_orderstatus = 'F') AS filtered FROM orders UNION ALL SELECT 'quantity', avg(l_quantity), avg(l_quantity) FILTER (WHERE l_returnflag = 'R') FROM lineitem)")
def filter_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderstatus", F.col("o_totalprice").alias("v"))
    items = table(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_quantity").alias("v"))
    made = benches.filter_comparison({"price": (orders, orders.where("o_orderstatus = 'F'")), "quantity": (items, items.where("l_returnflag = 'R'"))}, "v")
    return made.select("model", r6("without").alias("without"), r6("with").alias("filtered"), r6("gain").alias("gain"))


@collect(QUERIES, ORACLES, f"WITH {_SEG} {_top('seg')}")
def vec_cells_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All cells are probed: the exact answer."""
    rows = _segments(spark, sf_dir)
    centres = cells.centroids(rows, 8)
    hits = cells.approximate(cells.placed(rows, centres), centres, search.probe(rows, 0), 10, 8)
    return search.ranked(hits).select("vec_id", r6("dist").alias("dist"), F.col("rank").cast("long").alias("rank"))


@collect(QUERIES, ORACLES)
def vec_cells_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall at ten against the exact answer by cells probed, over the stated queries."""
    rows = _vectors(spark, sf_dir)
    centres = cells.centroids(rows, 8)
    index, asked = cells.placed(rows, centres), _asked(rows)
    truth = search.many(rows, asked, 10).select("query_id", "vec_id")
    made = None
    for probes in (1, 2, 4, 8):
        found = cells.approximate_many(index, asked, centres, 10, probes).select("query_id", "vec_id", F.lit(1).alias("f"))
        one = truth.join(found, ["query_id", "vec_id"], "left").agg(F.lit(probes).alias("probes"), r6(F.count("f") / F.count("*")).alias("recall"))
        made = one if made is None else made.union(one)
    return made
