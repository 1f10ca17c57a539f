"""The corpus pipeline: each stage works on what the stage before it kept.

Rows with null or empty texts pass the first stage by their score, go in the second (they
have no letters), so the later stages never see them. Repeated rows are copies of each
other: one stays. Columns beyond those of documents are carried to the last stage. Empty
tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestar.llm import decontamination, language, packing, shared, similarity_join, tokens, toxicity

#: Scores from which a document is toxic, and to which its language is unclear.
TOXIC, UNCLEAR = 0.5, 0.35


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose whole text scores below ``TOXIC``; the model is fit on labels."""
    model = toxicity.fit_labels(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model, below=TOXIC)


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters and a language that scores ``UNCLEAR`` at least; the network
    is fit on the documents that came in."""
    return language.predict(docs, language.fit_documents(docs), least=UNCLEAR)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of a Jaccard similarity of 0.8 connect."""
    return similarity_join.deduplicate(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth stands in windows of the benchmark."""
    return decontamination.remove(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 1024 ids."""
    return packing.pack(docs, tokens.default_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("language", keep_known_languages),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

#: Compression distance, the network and differencing are no SQL: tests/llm holds every
#: stage against a plain version of it on what the stage before kept.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = shared.materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
