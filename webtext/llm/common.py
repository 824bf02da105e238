"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import on_workers, scratch_path  # noqa: F401

#: ASCII white space of all word and line contracts (space, \t \n \v \f \r).
WS_BYTES = b" \t\n\x0b\x0c\r"
#: The smallest long stands for a null doc_id inside joins; it sorts first.
NULL_ID = -(2 ** 63)

def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def plain(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the whole text, null as empty; nothing else is read."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text"), F.lit("")).alias("text"))


def id_key(col: str = "doc_id") -> Column:
    return F.coalesce(F.col(col), F.lit(NULL_ID))


def saved(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write once to the shared checkpoint folder and read back: a lost
    executor rereads files, and what follows does not compute ``df`` again."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
