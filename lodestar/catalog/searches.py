"""Searches for many queries, graph indexes, benches, filters of every strategy."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..functions import vectors as V
from ..operators import blocks, cells, graph, metrics, predicates, search, timeline
from ..plans import benches, facets, planning, request
from ..sources.folders import written
from .common import SAMPLES, collect, r6, samples, table
from .requests import FIELDS, _hits, _shown, _store
from .vectors import _SEG, _asked, _segments, _top, _vectors

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _ask(spark: SparkSession, sf_dir: str, **options) -> tuple[DataFrame, dict]:
    store = _store(spark, sf_dir)
    return request.run(spark, request.Request(search.probe(store.rows, 0), **options), store)


@collect(QUERIES, ORACLES, _hits("p_size BETWEEN 6 AND 9"))
def search_exact_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strategy ``exact`` applies the filter as well."""
    return _shown(_ask(spark, sf_dir, filters={"p_size": (6, 9)}, strategy="exact")[0])


@collect(QUERIES, ORACLES, "SELECT unnest(['list', 'number', 'null', 'swapped', 'confidence', 'text', 'fine', 'other']) AS answer, unnest([false, false, false, false, false, false, true, true]) AS parsed, unnest([c.every, c.every, c.every, c.every, c.every, c.every, c.small, c.every]) AS candidates FROM (SELECT count(*) AS every, count(*) FILTER (WHERE p_size >= 9) AS small FROM embeddings JOIN part ON vec_id = p_partkey) c")
def answers_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of all kinds: those that break the rules leave the text unparsed."""
    raw = {
        "list": "[]",
        "number": '{"constraints": [1]}',
        "null": '{"constraints": null}',
        "swapped": '{"constraints": [{"field": "p_size", "operator": "range", "value": [9, 3]}]}',
        "confidence": '{"constraints": [{"field": "p_size", "operator": "gte", "value": 9, "confidence": null}]}',
        "text": "sizes from 9",
        "fine": '{"constraints": [{"field": "p_size", "operator": "gte", "value": 9}]}',
        "other": '{"constraints": [{"field": "colour", "operator": "eq", "value": "red"}]}',
    }
    store = _store(spark, sf_dir)
    # joined once for all answers: each join may send a side to the driver to broadcast it
    store = replace(store, rows=written(store.rows, "answers"))
    query, told = search.probe(store.rows, 0), []
    for name, answer in raw.items():
        got = request.run(spark, request.Request(query, parser="response", answer=answer), store)[1]
        told.append((name, got["plan"]["failure"] is None, got["candidate_count"]))
    return spark.createDataFrame(told, "answer string, parsed boolean, candidates long")


@collect(QUERIES, ORACLES, "SELECT unnest(['with', 'without']) AS ids, unnest([least(10, n), 0]) AS found FROM (SELECT count(*) AS n FROM embeddings JOIN part ON vec_id = p_partkey WHERE label = 2 AND p_size > 20)")
def candidates_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates under a filter; an empty list of them ends the search at once."""
    rows = _segments(spark, sf_dir)
    query, made = search.probe(rows, 0), None
    for name, ids in (("with", rows.where("label = 2")), ("without", rows.where("label < 0"))):
        hits = search.search(rows, query, 10, "candidates", F.col("p_size") > 20, ids=ids.select("vec_id"))
        one = hits.agg(F.lit(name).alias("ids"), F.count("*").alias("found"))
        made = one if made is None else made.union(one)
    return made


@collect(QUERIES, ORACLES, "SELECT count(*) AS n, count(*) > 100 AS beyond FROM part WHERE p_size >= 25")
def candidate_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether candidates exceed a cap is told without counting on."""
    rows = table(spark, sf_dir, "part").where("p_size >= 25")
    try:
        predicates.within_cap(rows, 100)
        beyond = False
    except ValueError:
        beyond = True
    return rows.agg(F.count("*").alias("n"), F.lit(beyond).alias("beyond"))


@collect(QUERIES, ORACLES, "SELECT p_partkey FROM part WHERE p_retailprice * 2 BETWEEN 1900 AND 2000 AND lower(p_type) = 'promo'")
def projected_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of a filter that are expressions of columns."""
    columns = {"double_price": F.col("p_retailprice") * 2, "kind": F.lower("p_type")}
    return predicates.apply(table(spark, sf_dir, "part"), {"double_price": "float", "kind": "keyword"}, {"double_price": (1900, 2000), "kind": "promo"}, columns=columns).select("p_partkey")


_HALF = f"WITH {SAMPLES}, w AS (SELECT DISTINCT user_id, floor(time_s / 86400) * 86400 AS t_start FROM ev) SELECT user_id, t_start, count(*) AS n, round(sum(value), 4) AS total FROM w JOIN ev USING (user_id) WHERE time_s >= t_start AND time_s < t_start + 43200 GROUP BY ALL"


@collect(QUERIES, ORACLES, _HALF)
def halfopen_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of the first halves of days, the end excluded."""
    own = samples(spark, sf_dir)
    windows = own.select("user_id", (F.floor(F.col("time_s") / 86400) * F.lit(86400.0)).alias("t_start")).distinct().withColumn("t_end", F.col("t_start") + 43200)
    met = timeline.within(windows, own.select("user_id", "time_s", "value"), "user_id", 43200.0, closed=False)
    return met.groupBy("user_id", "t_start").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@collect(QUERIES, ORACLES, "SELECT l_orderkey, l_linenumber, unnest([0, 1, 2, 3]) AS i, CAST(trunc((l_quantity + (l_extendedprice / 1000) / 3 * unnest([0, 1, 2, 3])) * 25) AS INTEGER) AS frame FROM lineitem WHERE l_linenumber = 1")
def frame_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").where("l_linenumber = 1")
    length = F.col("l_extendedprice") / 1000
    return rows.select("l_orderkey", "l_linenumber", F.posexplode(timeline.frame_indices(F.col("l_quantity"), length, 25.0, 4)).alias("i", "frame"))


@collect(QUERIES, ORACLES, "SELECT event_id, round(epoch_us(ts) / 1e6 - 1704067200 - 2.5, 6) AS unix_ms, round(epoch_us(ts) / 1e6 - 1704067200 - 2.5, 6) AS iso, round(epoch_us(ts) / 1e6 - 1704067200 - 3600 - 2.5, 6) AS zoned FROM events")
def clock_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times by three clocks on a video's timeline that begins with 2024, 2.5 s late: as
    milliseconds, as text in UTC, as text an hour ahead of UTC."""
    rows = table(spark, sf_dir, "events").select("event_id", F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)").alias("us"))
    start, text = F.lit(1704067200.0), F.date_format(F.timestamp_micros("us"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    clocks = {"unix_ms": timeline.aligned(F.col("us") / 1000, "unix_ms", start, 2.5), "iso": timeline.aligned(text, "iso8601", start, 2.5), "zoned": timeline.aligned(F.concat(text, F.lit("+01:00")), "iso8601", start, 2.5)}
    return rows.select("event_id", *(r6(c).alias(n) for n, c in clocks.items()))


@collect(QUERIES, ORACLES, "SELECT a.vec_id, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) + 0.0 AS product, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) + 0.0 AS cosine, 0.0 AS zero FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def vector_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inner products and cosines of neighbours; a zero vector has cosine 0 with all."""
    rows = _vectors(spark, sf_dir)
    other = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    zero = F.transform("next", lambda x: x * 0)
    return rows.join(other, "vec_id").select("vec_id", r6(V.dot("embedding", "next")).alias("product"), r6(V.cosine("embedding", "next")).alias("cosine"), r6(V.cosine("embedding", zero)).alias("zero"))


def _strategy(name: str, source: str) -> str:
    return f"SELECT '{name}' AS strategy, vec_id, rank FROM ({_top(source)})"


@collect(QUERIES, ORACLES, f"WITH {_SEG}, s AS (SELECT seg.*, 1 - list_cosine_similarity(list_slice(embedding, 1, 16)::DOUBLE[], list_slice(q, 1, 16)) AS short FROM seg, q) {_strategy('exact', '(SELECT * FROM seg WHERE p_size > 20)')} UNION ALL {_strategy('prefilter', '(SELECT * FROM seg WHERE p_size > 20)')} UNION ALL {_strategy('postfilter', '(SELECT * FROM (SELECT * FROM seg ORDER BY dist, vec_id LIMIT 50) WHERE p_size > 20)')} UNION ALL {_strategy('candidates', '(SELECT * FROM seg WHERE p_size > 20 AND label = 2)')} UNION ALL {_strategy('adaptive', '(SELECT * FROM s WHERE p_size > 20 ORDER BY short, vec_id LIMIT 40)')}")
def strategies_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every strategy under one filter."""
    rows = _segments(spark, sf_dir)
    query, where, made = search.probe(rows, 0), F.col("p_size") > 20, None
    options = {"candidates": {"ids": rows.where("label = 2").select("vec_id")}, "adaptive": {"dims": 16, "candidates": 40}}
    for name in search.STRATEGIES:
        hits = search.ranked(search.search(rows, query, 10, name, where, **options.get(name, {})))
        one = hits.select(F.lit(name).alias("strategy"), "vec_id", F.col("rank").cast("long").alias("rank"))
        made = one if made is None else made.union(one)
    return made


_EFFECT = scalars.normal_quantile(0.975) + scalars.normal_quantile(0.8)


@collect(QUERIES, ORACLES, f"SELECT o_orderpriority, count(*) AS n, round({_EFFECT!r} * stddev_samp(o_totalprice) / sqrt(count(*)), 4) AS effect FROM orders GROUP BY 1")
def detectable_effect(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.stddev_samp("o_totalprice").alias("_s"))
    return facts.select("o_orderpriority", "n", F.round(scalars.minimum_detectable_effect(F.col("n"), F.col("_s")), 4).alias("effect"))


@collect(QUERIES, ORACLES, "SELECT l_orderkey, l_linenumber, first, greatest(first, least(200, CAST(ceil((l_quantity + 2) * 4) AS INTEGER))) AS last FROM (SELECT *, greatest(1, least(200, CAST(floor(l_quantity * 4) AS INTEGER) + 1)) AS first FROM lineitem)")
def frame_supports(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, last = scalars.frame_support(F.col("l_quantity"), F.col("l_quantity") + 2, F.lit(4), F.lit(200))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", first.alias("first"), last.alias("last"))


@collect(QUERIES, ORACLES, "WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events WHERE value IS NOT NULL) SELECT a.user_id, a.n, a.n >= 2 AND a.value - b.value < 0.05 AS rerank FROM r a JOIN r b ON a.user_id = b.user_id AND a.k = 1 AND b.k = 2")
def rerank_trigger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users whose best value leads by too little to be trusted."""
    rows = table(spark, sf_dir, "events").where("value is not null")
    # two greatest values of each user, from one pass
    top = rows.groupBy("user_id").agg(F.max(F.struct("value", (-F.col("event_id")).alias("e"))).alias("a"), F.count("*").alias("n"))
    second = rows.join(top, "user_id").where(F.col("event_id") != -F.col("a.e")).groupBy("user_id", "n", "a").agg(F.max("value").alias("b"))
    return second.select("user_id", "n", planning.needs_rerank(F.col("a.value") - F.col("b"), F.col("n")).alias("rerank"))


@collect(QUERIES, ORACLES, "SELECT l_returnflag, l_linenumber, CASE WHEN n < 150 THEN 'too_few_queries' WHEN m >= 0.99 THEN 'saturated' WHEN abs(m - 0.3) > 0.1 THEN 'check_baseline' ELSE 'ok' END AS outcome FROM (SELECT l_returnflag, l_linenumber, count(*) AS n, avg((l_quantity > 10 * l_linenumber)::INT) AS m FROM lineitem GROUP BY ALL)")
def bench_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a number of queries and a change against a baseline allow to say."""
    facts = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linenumber").agg(F.count("*").alias("n"), F.avg((F.col("l_quantity") > 10 * F.col("l_linenumber")).cast("int")).alias("m"))
    return facts.select("l_returnflag", "l_linenumber", metrics.outcome(F.col("n"), 150, F.col("m"), F.lit(0.3)).alias("outcome"))


def _indexed(spark: SparkSession, sf_dir: str, dims: int | None = None, part_rows: int = 256):
    rows = _vectors(spark, sf_dir)
    asked = _asked(rows).select("query_id", "query")
    if dims is not None:
        rows, asked = rows.withColumn("embedding", F.slice("embedding", 1, dims)), asked.withColumn("query", F.slice("query", 1, dims))
    centres = cells.centroids(rows, 8)
    return graph.build(rows, centres, part_rows=part_rows), asked, centres


_NEAREST = "SELECT query_id, vec_id, round(dist, 6) + 0.0 AS dist, rank FROM (SELECT a.vec_id AS query_id, b.vec_id, 1 - list_cosine_similarity(b.embedding::DOUBLE[], a.embedding::DOUBLE[]) AS dist, row_number() OVER (PARTITION BY a.vec_id ORDER BY 1 - list_cosine_similarity(b.embedding::DOUBLE[], a.embedding::DOUBLE[]), b.vec_id) AS rank FROM embeddings a JOIN embeddings b ON a.vec_id % 20 = 0) WHERE rank <= 10"


@collect(QUERIES, ORACLES, _NEAREST)
def vec_graph_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A beam as wide as a part, in all cells: the exact answer."""
    index, asked, centres = _indexed(spark, sf_dir)
    found = graph.search_many(index, asked, centres, 10, 4096, 8)
    return found.select("query_id", "vec_id", r6("dist").alias("dist"), F.col("rank").cast("long").alias("rank"))


@collect(QUERIES, ORACLES)
def vec_graph_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall at ten over the width of the beam, in all cells."""
    index, asked, centres = _indexed(spark, sf_dir, part_rows=4096)
    truth = blocks.nearest(_vectors(spark, sf_dir), asked, 10).select("query_id", "vec_id")
    return graph.sweep(index, asked, truth, centres, 10, (40, 100, 128, 200, 512), 8).withColumn("recall", r6("recall"))


@collect(QUERIES, ORACLES, _NEAREST)
def vec_blocks_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of queries and rows as matrices."""
    rows = _vectors(spark, sf_dir)
    found = blocks.nearest(rows, _asked(rows).select("query_id", "query"), 10)
    return found.select("query_id", "vec_id", r6("dist").alias("dist"), F.col("rank").cast("long").alias("rank"))


_DIMS = (64, 32, 16)


def _ranked(d: int) -> str:
    return f"row_number() OVER (PARTITION BY query_id ORDER BY d{d}, vec_id)"


_D = ", ".join(f"1 - list_cosine_similarity(list_slice(b.embedding, 1, {d})::DOUBLE[], list_slice(a.embedding, 1, {d})::DOUBLE[]) AS d{d}" for d in _DIMS)
_TWO = " UNION ALL ".join(f"SELECT query_id, 'adaptive_{d}_to_64' AS strategy, {d} AS stage1_dim, 64 AS rerank_dim, {c} AS candidate_k, least({c}, n) AS candidate_count, vec_id, r64, row_number() OVER (PARTITION BY query_id ORDER BY d64, vec_id) AS k FROM r WHERE r{d} <= {c}" for d in _DIMS[1:] for c in benches.CANDIDATES)
_ONE = " UNION ALL ".join(f"SELECT query_id, '{d}_{kind}', NULL, {d}, NULL, least(10, n), vec_id, NULL, r{d} FROM r" for d in _DIMS for kind in ("exact", "approximate"))


@collect(QUERIES, ORACLES, f"WITH p AS (SELECT a.vec_id AS query_id, b.vec_id, {_D} FROM embeddings a JOIN embeddings b ON a.vec_id % 20 = 0), r AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS n, {', '.join(f'{_ranked(d)} AS r{d}' for d in _DIMS)} FROM p), s AS ({_TWO} UNION ALL {_ONE}) SELECT query_id, strategy, stage1_dim, rerank_dim, candidate_k, CAST(any_value(candidate_count) AS BIGINT) AS candidate_count, count(*) AS returned_count, count(*) < 10 AS underfilled, CASE WHEN stage1_dim IS NOT NULL THEN round(count(*) FILTER (WHERE r64 <= 10) / 10.0, 6) END AS agreement FROM s WHERE k <= 10 GROUP BY query_id, strategy, stage1_dim, rerank_dim, candidate_k")
def adaptive_bench(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six references and eight two-stage settings for each query. The approximate ones
    walk graphs with a beam as wide as their parts, so they are exact here."""
    rows = _vectors(spark, sf_dir)

    def approximate(d: int) -> DataFrame:
        index, asked, centres = _indexed(spark, sf_dir, d)
        return graph.search_many(index, asked, centres, 10, 4096, 8)

    return benches.adaptive(rows, _asked(rows).select("query_id", "query"), 10, _DIMS, approximate).withColumn("agreement", r6("agreement"))


@collect(QUERIES, ORACLES, f"WITH p AS (SELECT a.vec_id AS query_id, b.vec_id, p_size, {_D} FROM embeddings a JOIN embeddings b ON a.vec_id % 20 = 0 JOIN part ON b.vec_id = p_partkey), f AS (SELECT *, unnest([25, 5]) AS most FROM p), t AS (SELECT query_id, most, vec_id FROM f WHERE p_size <= most QUALIFY row_number() OVER (PARTITION BY query_id, most ORDER BY d64, vec_id) <= 10), s AS (" + " UNION ALL ".join(f"SELECT query_id, most, 'prefilter' AS strategy, {d} AS dim, vec_id FROM f WHERE p_size <= most QUALIFY row_number() OVER (PARTITION BY query_id, most ORDER BY d{d}, vec_id) <= 10 UNION ALL SELECT query_id, most, 'postfilter', {d}, vec_id FROM (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY query_id, most ORDER BY d{d}, vec_id) <= 50) WHERE p_size <= most QUALIFY row_number() OVER (PARTITION BY query_id, most ORDER BY d{d}, vec_id) <= 10" for d in (64, 16)) + "), e AS (SELECT query_id, most, strategy, dim FROM (SELECT DISTINCT query_id, most FROM f), (SELECT DISTINCT strategy, dim FROM s)), c AS (SELECT e.*, (SELECT count(*) FROM t WHERE t.query_id = e.query_id AND t.most = e.most) AS t, (SELECT count(*) FROM s WHERE s.query_id = e.query_id AND s.most = e.most AND s.strategy = e.strategy AND s.dim = e.dim) AS f, (SELECT count(*) FROM s JOIN t USING (query_id, most, vec_id) WHERE s.query_id = e.query_id AND s.most = e.most AND s.strategy = e.strategy AND s.dim = e.dim) AS b FROM e) SELECT strategy, dim, CASE most WHEN 25 THEN 'half' ELSE 'tenth' END AS filter, count(*) AS n_queries, round(avg(CASE WHEN t = 0 THEN 1.0 ELSE b / t END), 6) AS recall, count(*) FILTER (WHERE f < 10) AS underfilled FROM c GROUP BY strategy, dim, most")
def selectivity_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strategies by number of components and share of rows that a filter keeps, over all
    stated queries."""
    rows = _segments(spark, sf_dir)
    asked = _asked(_vectors(spark, sf_dir)).select("query_id", "query")
    made = benches.selectivity_matrix(rows, asked, 10, (64, 16), {"half": F.col("p_size") <= 25, "tenth": F.col("p_size") <= 5})
    return made.withColumn("recall", r6("recall"))


def _recalls(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    rows = _vectors(spark, sf_dir)
    asked = _asked(rows).select("query_id", "query")
    truth = blocks.nearest(rows, asked, 10)
    return {str(d): benches.recalls(blocks.nearest(rows, asked, 10, d), truth, asked) for d in _DIMS}


@collect(QUERIES, ORACLES, f"WITH p AS (SELECT a.vec_id AS query_id, b.vec_id, {_D} FROM embeddings a JOIN embeddings b ON a.vec_id % 20 = 0), r AS (SELECT *, {', '.join(f'{_ranked(d)} AS r{d}' for d in _DIMS)} FROM p), v AS (SELECT query_id, " + ", ".join(f"count(*) FILTER (WHERE r64 <= 10 AND r{d} <= 10) / 10.0 AS v{d}" for d in _DIMS) + " FROM r GROUP BY 1) " + " UNION ALL ".join(f"SELECT '{d}' AS name, count(*) AS n, round(avg(v{d}), 6) AS mean, " + ("NULL" if d == 64 else f"round(avg(v{d} - v64), 6)") + " AS mean_diff, " + ("NULL" if d == 64 else f"round(coalesce(avg(v{d} - v64) / nullif(stddev_samp(v{d} - v64), 0), 0), 6)") + " AS cohens_d FROM v" for d in _DIMS))
def quality_compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall of shortened vectors against the whole ones: difference and effect size."""
    made = benches.quality(_recalls(spark, sf_dir), "64", resamples=200)
    return made.select("name", "n", r6("mean").alias("mean"), r6("mean_diff").alias("mean_diff"), r6("cohens_d").alias("cohens_d"))


@collect(QUERIES, ORACLES)
def quality_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with bootstrap intervals, which are random but for their seed."""
    return benches.quality(_recalls(spark, sf_dir), "64", resamples=500)


@collect(QUERIES, ORACLES, f"WITH p AS (SELECT a.vec_id AS query_id, a.label AS own, b.vec_id, b.label, p_size, {_D} FROM embeddings a JOIN embeddings b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id JOIN part ON b.vec_id = p_partkey), h AS (" + " UNION ALL ".join(f"SELECT '{d}' AS model, false AS filtered, query_id, own = label AS hit FROM p QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY d{d}, vec_id) <= 10 UNION ALL SELECT '{d}', true, query_id, own = label FROM p WHERE p_size <= 25 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY d{d}, vec_id) <= 10" for d in (64, 16)) + "), m AS (SELECT model, filtered, query_id, avg(hit::INT) AS x FROM h GROUP BY ALL) SELECT model, round(avg(x) FILTER (WHERE NOT filtered), 6) AS without, round(avg(x) FILTER (WHERE filtered), 6) AS filtered, round(avg(x) FILTER (WHERE filtered) - avg(x) FILTER (WHERE NOT filtered), 6) AS gain FROM m GROUP BY model")
def retrieval_filter_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision at ten by label, of whole and shortened vectors, without and with a filter."""
    rows = _segments(spark, sf_dir)
    asked = _asked(_vectors(spark, sf_dir))
    labels = rows.select("vec_id", "label")

    def precision(own: DataFrame, d: int) -> DataFrame:
        # the query's own row is one of eleven
        found = blocks.nearest(own, asked.select("query_id", "query"), 11, d).where("query_id <> vec_id").join(labels, "vec_id").join(asked.select("query_id", "own"), "query_id")
        best = found.withColumn("rank", F.row_number().over(search.Window.partitionBy("query_id").orderBy("dist", "vec_id"))).where("rank <= 10")
        return best.groupBy("query_id").agg(F.avg((F.col("own") == F.col("label")).cast("int")).alias("v"))

    made = benches.filter_comparison({str(d): (precision(rows, d), precision(rows.where("p_size <= 25"), d)) for d in (64, 16)}, "v")
    return made.select("model", r6("without").alias("without"), r6("with").alias("filtered"), r6("gain").alias("gain"))


@collect(QUERIES, ORACLES, f"WITH {_SEG}, c AS (SELECT count(*) AS n FROM seg WHERE p_size <= 25) SELECT n AS candidates, 10 AS returned, true AS correct FROM c")
def search_one_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates counted by the search itself; merged hits tell whether they satisfy the
    filter."""
    store = _store(spark, sf_dir)
    start = F.col("vec_id") * F.lit(1000.0)
    spans = request.Store(store.rows.withColumns({"t_start": start, "t_end": start + 1}), FIELDS)
    told = request.run(spark, request.Request(search.probe(store.rows, 0), filters={"p_size": {"max": 25}}, merge_gap=1.0), spans, key_col="p_type")[1]
    return spark.createDataFrame([(told["candidate_count"], told["returned_count"], told["filter_correct"])], "candidates long, returned int, correct boolean")


@collect(QUERIES, ORACLES, "SELECT 'p_size' AS field, 'integer' AS kind, CAST(min(p_size) AS DOUBLE) AS low, CAST(max(p_size) AS DOUBLE) AS high, '' AS listed, false AS more, false AS wrap FROM part UNION ALL SELECT 'angle', 'circular', min(p_retailprice % 360), max(p_retailprice % 360), '', false, true FROM part UNION ALL SELECT 'p_type', 'keyword', NULL, NULL, (SELECT string_agg(DISTINCT p_type, ',' ORDER BY p_type) FROM part), false, false UNION ALL SELECT 'p_name', 'keyword', NULL, NULL, (SELECT string_agg(v, ',' ORDER BY v) FROM (SELECT DISTINCT p_name AS v FROM part ORDER BY v LIMIT 6)), true, false UNION ALL SELECT 'large', 'boolean', NULL, NULL, (SELECT string_agg(DISTINCT CAST(p_size > 25 AS VARCHAR), ',' ORDER BY CAST(p_size > 25 AS VARCHAR)) FROM part), false, false UNION ALL SELECT 'split', 'keyword', NULL, NULL, '', false, false")
def filter_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fields of the parts: bounds of numbers, values of keywords (six at most) and
    flags. A field without any value is told only where it always is."""
    rows = table(spark, sf_dir, "part").select("p_size", "p_type", "p_name", (F.col("p_size") > 25).alias("large"), (F.col("p_retailprice") % 360).alias("angle"), F.lit(None).cast("string").alias("split"), F.lit(None).cast("string").alias("empty"))
    registry = {"p_size": "integer", "angle": "circular", "p_type": "keyword", "p_name": "keyword", "large": "boolean", "split": "keyword", "empty": "keyword", "absent": "float"}
    found = facets.filter_schema(rows, registry, ["split"], 6)
    return found.select("field", "kind", "low", "high", F.concat_ws(",", "values").alias("listed"), "more", "wrap")
