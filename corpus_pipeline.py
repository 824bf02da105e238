"""A corpus pipeline of five stages over ``documents``.

Each stage takes ``(spark, docs, sf_dir)``, works on every row that its
predecessor kept and returns a DataFrame, which :func:`run` writes as Parquet
below the shared checkpoint folder and reads again as the next stage's ``docs``.
All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webtext.llm import lines, packing, quality, rules, simhash
from webtext.llm.common import documents, saved
from webtext.llm.queries import tokenizer_path


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the discriminant rejects go; it learns from the labelled
    rows outside the held-out fold."""
    model = quality.fit(docs, documents(spark, sf_dir, "labels"), lambda d: not quality.held_out(d))
    return quality.keep_good(docs, model)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that fail the rules go, and so do documents that would lose too much."""
    return rules.keep_clean(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go; every document stays, with the length of its new text."""
    return lines.without_repeated_lines(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return simhash.keep_one(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 1024 tokens."""
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"), "byte")


STAGES = [("quality classifier", quality_classifier), ("quality rules", quality_rules), ("line dedup", line_dedup),
          ("simhash near-dedup", simhash_near_dedup), ("packing", packed)]

#: Tokens, hashed fingerprints and the discriminant are beyond SQL; the pipeline
#: is tested against a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
