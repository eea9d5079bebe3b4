"""Preparation of a training corpus: five stages over the documents table.

Each stage is a function of (spark, docs, sf_dir); ``run`` writes every result as Parquet into the
shared folder and reads it back as the documents of the next stage.

All stages take null ids and texts, empty and very long texts, repeated rows and empty tables as
their operators say: a null text stays null (its n_chars too) and encodes to no ids, rows are
dropped by a stage's own decision only, an empty table stays empty. Columns other than those of
documents end with the first stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.llm import bpe, decontam, passages, quality, queries, simhash
from cellweave.llm.common import discard, scratch, stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _documents(docs: DataFrame) -> DataFrame:
    """The columns of documents, with the length of the text as it is now."""
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of low quality or with toxic wording go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return _documents(quality.classify(docs, labels).where("keep"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays."""
    return _documents(simhash.deduplicated(docs))


def unrepeated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that a document of smaller id also holds are cut out of the text."""
    return _documents(passages.without_repeats(docs))


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents contaminated by the benchmark go."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _documents(decontam.decontaminate(docs, items).where("not contaminated"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and whether they decode to its very bytes."""
    where = public_tokenizers.path(queries.RANK_FILE), public_tokenizers.PATTERN
    coded = bpe.encode_and_decode(docs, *where)
    same = F.col("decoded") == F.encode(F.coalesce("text", F.lit("")), "utf-8")
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", same.alias("round_trip"))


STAGES = [
    ("quality classifier", good),
    ("SimHash near-dedup", distinct),
    ("substring dedup", unrepeated),
    ("benchmark decontamination", uncontaminated),
    ("byte-level BPE encoding and decoding", encoded),
]

#: The classifier and the fingerprints have no counterpart in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; what a stage stored on its way goes when its result is stored."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES:
        with scratch(spark) as written:
            docs = stored(stage(spark, docs, sf_dir), "stage")
            written.pop()
        if before is not None:
            discard(before)
        before = docs
    return docs


QUERIES = {"pipeline": run}
SQL = {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
