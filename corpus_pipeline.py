"""A training-corpus pipeline: each stage works on all that its predecessor kept.

Stages: documents in no learned language go; lines common to many documents go; one document of each near-duplicate class
stays; documents contaminated with benchmark passages go; the rest is encoded. All stages but the last return the columns of
`documents`; `n_chars` is kept in step with the text. Nulls, repeated rows and empty tables are treated as the operators
define it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparrowplan.llm import bpe, decontamination, jaccard_join, language_id, line_dedup
from sparrowplan.llm.common import stored, table


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.keep_known_language(docs, language_id.trained_on_folds(docs))


def uncommon_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = line_dedup.without_common_lines(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.one_of_each(docs)


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(docs, bpe.read_spec()).select(*[c for c in docs.columns if c != "text"], F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("language ID", known_language),
    ("line dedup", uncommon_lines),
    ("n-gram Jaccard join", one_of_each_class),
    ("benchmark decontamination", clean_of_benchmark),
    ("BPE encoding and decoding", encoded),
]

#: Language ID, the class search and the encoding can't be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
