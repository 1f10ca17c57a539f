"""Vector search over ``embeddings``, with ``part`` as metadata of the same ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import blocks, search
from .common import collect, r6, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings")


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vectors(spark, sf_dir).join(table(spark, sf_dir, "part"), F.col("vec_id") == F.col("p_partkey"))


def _hits(df: DataFrame) -> DataFrame:
    return search.ranked(df).select("vec_id", r6("dist").alias("dist"), F.col("rank").cast("long").alias("rank"))


_Q = "q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0)"
_SEG = f"{_Q}, seg AS (SELECT e.*, p.*, 1 - list_cosine_similarity(embedding::DOUBLE[], q) AS dist FROM embeddings e JOIN part p ON vec_id = p_partkey CROSS JOIN q)"


def _top(source: str, k: int = 10) -> str:
    return f"SELECT vec_id, round(dist, 6) + 0.0 AS dist, row_number() OVER (ORDER BY dist, vec_id) AS rank FROM (SELECT vec_id, dist FROM {source} ORDER BY dist, vec_id LIMIT {k})"


@collect(QUERIES, ORACLES, f"WITH {_Q}, s AS (SELECT vec_id, 1 - list_cosine_similarity(embedding::DOUBLE[], q) AS dist FROM embeddings, q) {_top('s')}")
def vec_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _vectors(spark, sf_dir)
    return _hits(search.exact(rows, search.probe(rows, 0), 10))


@collect(QUERIES, ORACLES, f"WITH {_SEG} {_top('(SELECT * FROM seg WHERE p_size >= 10)')}")
def vec_prefilter_loose(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _segments(spark, sf_dir)
    return _hits(search.prefilter(rows, search.probe(_vectors(spark, sf_dir), 0), 10, F.col("p_size") >= 10))


@collect(QUERIES, ORACLES, f"WITH {_SEG} {_top('(SELECT * FROM seg WHERE p_size >= 45 AND p_retailprice < 950)')}")
def vec_prefilter_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _segments(spark, sf_dir)
    return _hits(search.prefilter(rows, search.probe(_vectors(spark, sf_dir), 0), 10, (F.col("p_size") >= 45) & (F.col("p_retailprice") < 950)))


@collect(QUERIES, ORACLES, f"WITH {_SEG} {_top('(SELECT * FROM (SELECT * FROM seg ORDER BY dist, vec_id LIMIT 50) WHERE p_size >= 10)')}")
def vec_postfilter_rescore(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _segments(spark, sf_dir)
    return _hits(search.postfilter(rows, search.probe(_vectors(spark, sf_dir), 0), 10, F.col("p_size") >= 10))


_PAIRS = "pairs AS (SELECT a.vec_id AS query_id, b.vec_id, a.label AS own, b.label, 1 - list_cosine_similarity(b.embedding::DOUBLE[], a.embedding::DOUBLE[]) AS dist, 1 - list_cosine_similarity(list_slice(b.embedding, 1, 16)::DOUBLE[], list_slice(a.embedding, 1, 16)::DOUBLE[]) AS short FROM embeddings a JOIN embeddings b ON a.vec_id % 20 = 0)"


def _asked(rows: DataFrame) -> DataFrame:
    """The query set: every stored vector whose id is divisible by 20."""
    return rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"), F.col("label").alias("own"))


@collect(QUERIES, ORACLES, f"WITH {_PAIRS} SELECT query_id, vec_id, round(dist, 6) + 0.0 AS dist, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, vec_id) AS rank FROM pairs) WHERE rank <= 5")
def vec_topk_per_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _vectors(spark, sf_dir)
    return search.many(rows, _asked(rows), 5).select("query_id", "vec_id", r6("dist").alias("dist"), F.col("rank").cast("long").alias("rank"))


@collect(QUERIES, ORACLES, "WITH s AS (SELECT vec_id, list_slice(embedding, 1, 16)::DOUBLE[] AS h FROM embeddings), n AS (SELECT vec_id, h, sqrt(list_dot_product(h, h)) AS size FROM s) SELECT vec_id, unnest(range(0, 16)) AS pos, unnest(list_transform(h, lambda x: round(x / size, 6) + 0.0)) AS x FROM n")
def vec_mrl_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    short = search.shortened(_vectors(spark, sf_dir).select("vec_id", "embedding"), [16])
    return short.select("vec_id", F.posexplode("vector").alias("pos", "x")).select("vec_id", F.col("pos").cast("long").alias("pos"), r6("x").alias("x"))


@collect(QUERIES, ORACLES, "SELECT vec_id, CASE WHEN vec_id % 5 = 1 THEN 'unit' WHEN vec_id % 5 = 2 THEN 'length' WHEN vec_id % 5 = 3 THEN 'direction' WHEN vec_id % 5 = 4 THEN 'finite' ELSE '' END AS faults FROM embeddings")
def vec_mrl_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shortened vectors, of which four fifths break a rule each."""
    short, kind = V.shorten("embedding", 16), F.col("vec_id") % 5
    bent = F.when(kind == 1, F.transform(short, lambda x: x * 2)).when(kind == 2, V.shorten("embedding", 15)).when(kind == 3, F.transform(short, lambda x: -x))
    bent = bent.when(kind == 4, F.concat(F.slice(short, 1, 15), F.array(F.lit(float("nan"))))).otherwise(short)
    rows = _vectors(spark, sf_dir).withColumn("short", bent)
    # what isn't finite or of the right length breaks other rules as well: the first counts
    order = F.when(kind == 2, F.array(F.lit("length"))).when(kind == 4, F.array(F.lit("finite"))).otherwise(V.shortening_faults("embedding", "short", 16))
    found = F.array_intersect(order, V.shortening_faults("embedding", "short", 16))
    return rows.select("vec_id", F.concat_ws(",", found).alias("faults"))


@collect(QUERIES, ORACLES, f"WITH {_Q}, s AS (SELECT vec_id, 1 - list_cosine_similarity(embedding::DOUBLE[], q) AS dist, 1 - list_cosine_similarity(list_slice(embedding, 1, 16)::DOUBLE[], list_slice(q, 1, 16)) AS short FROM embeddings, q), c AS (SELECT * FROM s ORDER BY short, vec_id LIMIT 50) {_top('c')}")
def vec_adaptive_two_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _vectors(spark, sf_dir)
    return _hits(search.adaptive(rows, search.probe(rows, 0), 10, 16, 50))


@collect(QUERIES, ORACLES, f"WITH {_SEG} {_top('(SELECT * FROM seg WHERE vec_id IN (SELECT vec_id FROM embeddings WHERE label = 2))')}")
def vec_candidate_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _vectors(spark, sf_dir)
    return _hits(search.restricted(rows.join(table(spark, sf_dir, "part"), F.col("vec_id") == F.col("p_partkey")), search.probe(rows, 0), 10, rows.where("label = 2")))


_LISTS = f"{_PAIRS}, t AS (SELECT query_id, vec_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, vec_id) AS r FROM pairs) WHERE r <= 10), f AS (SELECT query_id, vec_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY short, vec_id) AS r FROM pairs) WHERE r <= 10), c AS (SELECT query_id, count(*) AS n FROM t JOIN f USING (query_id, vec_id) GROUP BY query_id), nt AS (SELECT query_id, count(*) AS n FROM t GROUP BY 1), nf AS (SELECT query_id, count(*) AS n FROM f GROUP BY 1)"


@collect(QUERIES, ORACLES, f"WITH {_LISTS} SELECT query_id, coalesce(c.n, 0) AS n_common, round(coalesce(c.n, 0) / least(10, nt.n), 6) AS agreement, round(coalesce(c.n, 0) / (nt.n + nf.n - coalesce(c.n, 0)), 6) AS jaccard FROM nt JOIN nf USING (query_id) LEFT JOIN c USING (query_id)")
def vec_agreement_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _vectors(spark, sf_dir)
    asked = _asked(rows)
    truth = search.many(rows, asked, 10)
    short = search.many(rows.withColumn("embedding", F.slice("embedding", 1, 16)), asked.withColumn("query", F.slice("query", 1, 16)), 10)
    return search.agreement(short, truth, 10, by="query_id").withColumns({"agreement": r6("agreement"), "jaccard": r6("jaccard")})


@collect(QUERIES, ORACLES, f"WITH {_PAIRS}, s AS (SELECT * FROM pairs WHERE vec_id <> query_id), b AS (SELECT query_id, own, min(struct_pack(d := dist, i := vec_id)) AS m FROM s WHERE label = own GROUP BY 1, 2), n AS (SELECT query_id, count(*) AS n FROM s GROUP BY 1) SELECT n.query_id, CASE WHEN m IS NULL THEN n.n + 1 ELSE (SELECT count(*) + 1 FROM s WHERE s.query_id = n.query_id AND (dist < m.d OR (dist = m.d AND vec_id < m.i))) END AS rank FROM n LEFT JOIN b USING (query_id)")
def vec_rank_of_relevant(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _vectors(spark, sf_dir)
    return blocks.relevant_ranks(rows, _asked(rows), "label").select("query_id", "rank")


@collect(QUERIES, ORACLES, "WITH u AS (SELECT label, embedding::DOUBLE[] AS e, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings), x AS (SELECT label, unnest(range(0, len(e))) AS pos, unnest(e) / n AS v FROM u), m AS (SELECT label, pos, avg(v) AS m FROM x GROUP BY 1, 2) SELECT label, pos, round(m / sqrt(sum(m * m) OVER (PARTITION BY label)), 5) + 0.0 AS x FROM m")
def vec_frame_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = search.mean_vector(_vectors(spark, sf_dir), ["label"])
    rounded = F.round("x", 5)
    return means.select("label", F.posexplode("vector").alias("pos", "x")).select("label", F.col("pos").cast("long").alias("pos"), F.when(rounded == 0, 0.0).otherwise(rounded).alias("x"))


@collect(QUERIES, ORACLES, f"WITH {_SEG}, h AS (SELECT vec_id, dist, row_number() OVER (ORDER BY dist, vec_id) AS rank FROM (SELECT vec_id, dist FROM seg ORDER BY dist, vec_id LIMIT 10)) SELECT vec_id, rank, p_brand, p_size FROM h LEFT JOIN (SELECT * FROM part WHERE p_size >= 20) ON vec_id = p_partkey")
def hydrate_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _segments(spark, sf_dir).select("vec_id", "embedding")
    hits = search.ranked(search.exact(rows, search.probe(_vectors(spark, sf_dir), 0), 10)).select("vec_id", F.col("rank").cast("long").alias("rank"))
    # late: only k rows meet the metadata
    return search.hydrate(hits, table(spark, sf_dir, "part").where("p_size >= 20"), "vec_id", "p_partkey").select("vec_id", "rank", "p_brand", "p_size")


@collect(QUERIES, ORACLES, f"WITH {_SEG}, n AS (SELECT count(*) FILTER (WHERE p_size >= 45 AND p_retailprice < 950) AS matching FROM seg), r AS (SELECT count(*) AS returned FROM (SELECT * FROM (SELECT * FROM seg ORDER BY dist, vec_id LIMIT 50) WHERE p_size >= 45 AND p_retailprice < 950 LIMIT 10)) SELECT returned, matching, CASE WHEN returned >= 10 THEN 'full' WHEN matching <= returned THEN 'corpus_exhausted' WHEN returned = 0 THEN 'empty_despite_matches' ELSE 'strategy_underfill' END AS reason FROM n, r")
def vec_underfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _segments(spark, sf_dir)
    where = (F.col("p_size") >= 45) & (F.col("p_retailprice") < 950)
    hits = search.postfilter(rows, search.probe(_vectors(spark, sf_dir), 0), 10, where)
    found = hits.agg(F.count("*").alias("returned")).withColumn("_one", F.lit(1))
    total = rows.where(where).agg(F.count("*").alias("matching")).withColumn("_one", F.lit(1))
    return found.join(total, "_one").select("returned", "matching", search.underfill(F.col("returned"), F.col("matching"), 10).alias("reason"))


@collect(QUERIES, ORACLES)
def vec_half_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _vectors(spark, sf_dir).withColumn("half", V.half_precision("embedding"))
    return rows.select("vec_id", r6(V.cosine("embedding", "half")).alias("cosine"))


@collect(QUERIES, ORACLES)
def vec_arrow_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _vectors(spark, sf_dir)
    score = V.arrow_cosine(search.probe(rows, 0))
    return rows.select("vec_id", (F.lit(1.0) - score("embedding")).alias("dist")).orderBy("dist", "vec_id").limit(10).withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("dist", "vec_id"))).select("vec_id", r6("dist").alias("dist"), F.col("rank").cast("long").alias("rank"))


ORACLES["vec_arrow_topk"] = ORACLES["vec_exact_topk"]


@collect(QUERIES, ORACLES)
def synthetic_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten vectors around each stored one, with filter columns, by seeded noise."""
    stored = _vectors(spark, sf_dir).select("vec_id", "embedding")
    # a small file would be one task: noise takes far longer than reading
    rows = stored.repartition(max(1, -(-stored.count() // 2048))).select("vec_id", "embedding", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("copy"))
    made = rows.withColumn("key", F.concat_ws(":", "vec_id", "copy")).withColumn("vector", V.around("embedding", "key", 64, 0.4))
    count = F.pmod(F.xxhash64("key", F.lit(1)), F.lit(7)).cast("int")
    return made.select("vec_id", "copy", "vector", count.alias("person_count"), (F.pmod(F.xxhash64("key", F.lit(2)), F.lit(5)) == 0).alias("is_night"))
