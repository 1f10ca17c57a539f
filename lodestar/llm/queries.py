"""The operators as queries over whole tables, and SQL for those that it can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, chat, collocations, decontamination, language, line_dedup, packing, sharding, shared, similarity_join, spelling, token_files, tokens, toxicity, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of every hundredth one."""
    vectors = _table(spark, sf_dir, "embeddings")
    return ann.search(vectors, vectors.where("vec_id % 100 = 0"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 1024 ids."""
    return packing.pack(_table(spark, sf_dir, "documents"), tokens.default_path())


def op3_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every dialogue from the side of each of its speakers, with masks."""
    return chat.rotate(_table(spark, sf_dir, "conversations"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as archives and assembled again from their records."""
    folder = warc.write(_table(spark, sf_dir, "pages"))
    # parsed once: three joins read the records
    found = shared.materialize(warc.records(spark, folder, payloads=False), "records")
    return warc.resolve(warc.captures(found))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents shuffled into eight shards of equal numbers of rows (law `rows`)."""
    dealt = sharding.shuffle(_table(spark, sf_dir, "documents"))
    text = F.coalesce("text", F.lit(""))
    return dealt.select("doc_id", (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole text."""
    docs = _table(spark, sf_dir, "documents")
    found = language.predict(docs, language.fit_documents(docs), keep=["doc_id"])
    return found.select("doc_id", language.held_out("doc_id").alias("held_out"), "lang_pred", "score")


def op7_similarity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and number of links of every document."""
    return similarity_join.join(_table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every whole text."""
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.fit_labels(docs, _table(spark, sf_dir, "labels"))
    found = toxicity.score(docs, model, keep=["doc_id"])
    return found.select("doc_id", F.coalesce(toxicity.crc_of_id("doc_id") % 5 == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents, read back from the files."""
    folder = token_files.write(_table(spark, sf_dir, "documents"), tokens.default_path())
    return token_files.read(spark, folder)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that stand in windows of benchmark items."""
    docs = _table(spark, sf_dir, "documents")
    return decontamination.annotate(docs, _table(spark, sf_dir, "benchmark"), keep=["doc_id"]).drop("items")


def op10_longest_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length and place of the longest verbatim match of every benchmark suffix."""
    return decontamination.longest_matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best 2000 phrases of every language."""
    return collocations.mine(_table(spark, sf_dir, "documents"))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the lines that others keep."""
    found = line_dedup.deduplicate(_table(spark, sf_dir, "documents"), keep=["doc_id"])
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of all documents with the forms that they are variants of."""
    return spelling.group(_table(spark, sf_dir, "documents"))


_COLLOCATIONS = r"""
WITH piece AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p
  FROM documents),
worded AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM piece),
total AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM worded GROUP BY lang),
spot AS (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM worded, (SELECT unnest(range(1, 6)) AS m) WHERE len(w) >= m),
gram AS (SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase, count(*) AS a FROM spot GROUP BY ALL HAVING count(*) >= 100),
cut AS (SELECT lang, m, phrase, a, string_split(phrase, ' ') AS w, unnest(range(1, m)) AS k FROM gram WHERE m > 1),
part AS (SELECT c.lang, c.m, c.phrase, c.a, c.k, x.a AS l, y.a AS r, t.n, (1000::HUGEINT * c.a * t.n) // (x.a::HUGEINT * y.a) AS score
  FROM cut c JOIN gram x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:c.k], ' ')
  JOIN gram y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.k + 1:c.m], ' ') JOIN total t ON t.lang = c.lang),
best AS (SELECT * FROM part QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
kept AS (SELECT * FROM best b WHERE NOT EXISTS (
  SELECT 1 FROM best o WHERE o.lang = b.lang AND o.m > b.m AND 100 * o.a >= 100 * b.a AND contains(' ' || o.phrase || ' ', ' ' || b.phrase || ' ')))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score
FROM kept QUALIFY rank <= 2000
"""

_LINE_DEDUP = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
line AS (
  SELECT r, doc_id, i, ls[i] AS line,
         translate(trim(ls[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM d)),
often AS (SELECT k, max(doc_id) AS keeper FROM line WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
told AS (SELECT r, doc_id, i, line, coalesce(doc_id <> keeper, false) AS gone FROM line LEFT JOIN often USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM told GROUP BY r, doc_id
"""

_DECONTAMINATION = r"""
WITH doc AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
item AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL),
starts AS (SELECT item_id, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM item WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS k FROM starts),
sizes AS (SELECT DISTINCT n FROM win),
spots AS (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc, sizes WHERE len(w) >= n),
hits AS (SELECT s.r, s.i, s.n, win.item_id FROM spots s JOIN win ON win.n = s.n AND win.k = array_to_string(s.w[s.i:s.i + s.n - 1], ' ')),
covered AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT r, i, n FROM hits)) GROUP BY r),
found AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN covered USING (r) LEFT JOIN found USING (r)
"""

_WARC = """
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
o AS (SELECT payload_digest, max(page_id) AS origin FROM p WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN origin <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN origin <> page_id THEN origin END AS refers_to
FROM p LEFT JOIN o USING (payload_digest)
"""

_PERSPECTIVES = f"""
WITH m AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations),
placed AS (
  SELECT conv_id, turn, role, text,
         CAST(coalesce(sum(length(text) + 16) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // {chat.PART_CHARS} AS BIGINT) AS part
  FROM m),
speakers AS (SELECT DISTINCT conv_id, role AS speaker FROM m WHERE role <> 'system'),
runs AS (
  SELECT p.conv_id, speaker, part, turn, role, text AS raw,
         '{chat.BEGIN}' || CASE WHEN role = 'system' THEN 'system' WHEN role = speaker THEN 'assistant' ELSE 'user name=' || regexp_replace(replace(role, '<|', '< |'), '\\s+', ' ', 'g') END || chr(10) AS head,
         replace(text, '<|', '< |') || '{chat.END}' || chr(10) AS body,
         CASE WHEN role = speaker THEN 1 ELSE 0 END AS learn
  FROM placed p JOIN speakers s ON p.conv_id IS NOT DISTINCT FROM s.conv_id)
SELECT conv_id, speaker, part, count(*) AS n_messages,
       string_agg(head || body, '' ORDER BY turn NULLS FIRST, role, raw) AS text,
       string_agg(length(head) || ':0,' || length(body) || ':' || learn, ',' ORDER BY turn NULLS FIRST, role, raw) AS mask
FROM runs GROUP BY conv_id, speaker, part
"""

QUERIES = {f.__name__: f for f in (op1_nearest, op2_packing, op3_perspectives, op4_warc, op5_sharding, op6_language, op7_similarity_join, op8_toxicity, op9_token_files, op10_decontamination, op10_longest_matches, op11_collocations, op12_line_dedup, op13_spelling)}
ORACLES: dict[str, str] = {"op3_perspectives": _PERSPECTIVES, "op4_warc": _WARC, "op10_decontamination": _DECONTAMINATION, "op11_collocations": _COLLOCATIONS, "op12_line_dedup": _LINE_DEDUP}
