"""A training-corpus pipeline: five stages over ``documents``, each written and read again.

Language identification drops what it rejects, common lines are cut, one
document of each group of near copies stays, documents that overlap with
``benchmark`` go, and the rest is encoded and decoded.

Rows with a null id stay in every stage but those that look at the text alone
(language identification and decontamination), which treat them as any other.
Null and empty texts and texts without a letter are rejected by the first stage.
Equal rows are one document to line dedup; near dedup keeps all rows of the id
that stays.  Where no language can be learned, only texts without a letter go.
An empty table gives an empty result; extra columns, also of names that the
operators use, are carried through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symloom.llm.bpe_codec import bpe_encode
from symloom.llm.common import written
from symloom.llm.decontaminate import decontaminate
from symloom.llm.language_id import keep_identified, train
from symloom.llm.line_dedup import drop_common_lines
from symloom.llm.minhash_dedup import drop_near_duplicates
from symloom.llm.queries import word_vocabulary
from symloom.llm.worker import bound_batches
from symloom.session import ship_package


def _prepare(spark: SparkSession) -> None:
    ship_package(spark)
    bound_batches(spark)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _prepare(spark)
    return keep_identified(docs, train(docs))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _prepare(spark)
    kept = drop_common_lines(docs)
    return kept.withColumn("n_chars", F.char_length("text").cast("long")).select(docs.columns)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _prepare(spark)
    return drop_near_duplicates(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _prepare(spark)
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _prepare(spark)
    coded = bpe_encode(docs, word_vocabulary())
    return coded.select("doc_id", "n_tokens", "ids", F.sha2(F.encode("decoded", "utf-8"), 256).alias("decoded_sha256"))


STAGES = [
    ("language identification", identify_language),
    ("line dedup", dedup_lines),
    ("near dedup", dedup_near),
    ("benchmark decontamination", remove_benchmark),
    ("token encoding", encode),
]

#: SQL cannot express language models and merges; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
