"""Readers and writers: CSV (explicit schema), line lists, per-country inputs,
append-only result stores, and materialisation into the shared folder."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable
from functools import reduce
from urllib.parse import unquote, urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from ..functions.text import strip_ws
from ..session import ensure_checkpoint_dir, scratch_path

CSV_OPTIONS = {"header": "true", "quote": '"', "escape": '"', "multiLine": "true",
               # keep surrounding whitespace of values (the writer trims by default)
               "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
#: What an unquoted empty field reads as, and so null; a quoted one is empty text.
_MISSING = "\u0000"


def read_csv(spark: SparkSession, path: str, schema: StructType | str, sep: str = ",",
             null_value: str | None = None, empty_is_missing: bool = False) -> DataFrame:
    """CSV with an explicit schema (no inference); quoted fields may span lines.
    A schema column that is a partition folder is read from the folder's name, so
    a filter on it prunes folders.  A quoted empty field is empty text, an unquoted
    one null; ``empty_is_missing`` makes both null."""
    r = (spark.read.schema(schema).options(**CSV_OPTIONS).option("sep", sep)
         .option("nullValue", _MISSING if null_value is None else null_value))
    df = r.csv(path)
    if empty_is_missing:
        text = [f.name for f in df.schema if isinstance(f.dataType, StringType)]
        df = df.withColumns({c: F.nullif(F.col(c), F.lit("")) for c in text})
    return df


def refuse_own_input(df: DataFrame, path: str) -> None:
    """Raise if ``path`` holds files that ``df`` still has to read: to overwrite
    it would delete them first.  Write to a new path instead."""
    target = urlsplit(path).path.rstrip("/") + "/"
    if any((unquote(urlsplit(f).path) + "/").startswith(target) for f in df.inputFiles()):
        raise ValueError(f"{path} is an input of the table that is to be written there")


def write_csv(df: DataFrame, path: str, sep: str = ",", mode: str = "overwrite",
              sort_by: list[str] | None = None, partition_by: list[str] | None = None) -> None:
    """CSV output.  ``sort_by`` orders the whole output by a range partitioning
    (the part files in name order are sorted); ``partition_by`` writes one folder
    per value and should lead ``sort_by``."""
    refuse_own_input(df, path)
    w = (df.sort(*sort_by) if sort_by else df).write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.options(**CSV_OPTIONS).option("sep", sep).csv(path)


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite",
                  partition_by: list[str] | None = None) -> None:
    refuse_own_input(df, path)
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def read_line_list(spark: SparkSession, path: str) -> DataFrame:
    """One entry per line, stripped of surrounding whitespace, blanks dropped."""
    lines = spark.read.text(path)
    return lines.select(strip_ws(F.col("value")).alias("value")).filter(F.col("value") != "")


def read_keywords(spark: SparkSession, path: str) -> list[str]:
    """A line list as a parameter of a job: its distinct entries in the order of
    its lines, files by name.  It is collected, so it must fit the driver, as the
    pattern made of it does."""
    lines = spark.read.text(path).select(
        strip_ws(F.col("value")).alias("value"), F.col("_metadata.file_name").alias("file"),
        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    rows = lines.filter(F.col("value") != "").orderBy("file", "block", "line").collect()
    return list(dict.fromkeys(r.value for r in rows))


def union_countries(parts: dict[str, DataFrame], col: str = "country") -> DataFrame:
    """Tag each input with its country and stack them by column name."""
    tagged = [df.withColumn(col, F.lit(c)) for c, df in parts.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def relabel(df: DataFrame, mapping: dict[str, str], col: str) -> DataFrame:
    return df.replace(mapping, subset=[col])


def _files_of(df: DataFrame) -> list[tuple[str, int, int]]:
    """Name, length and time of the files that ``df`` reads, listed folder by folder."""
    spark, paths = df.sparkSession, df.inputFiles()
    path_of, conf = spark._jvm.org.apache.hadoop.fs.Path, spark._jsc.hadoopConfiguration()
    wanted, found = {path_of(f).toUri().getPath() for f in paths}, []
    for folder in sorted({f.rpartition("/")[0] for f in paths}):
        where = path_of(folder)
        found += [(path, int(st.getLen()), int(st.getModificationTime())) for st in where.getFileSystem(conf).listStatus(where)
                  if (path := st.getPath().toUri().getPath()) in wanted]
    return sorted(found)


def stored_model(spark: SparkSession, train: Callable[[DataFrame], DataFrame], source: DataFrame, name: str) -> DataFrame:
    """``train(source)``, trained once and read again by every later job that trains
    the same way on the same rows.

    It lies below the shared checkpoint folder, or the folder that
    ``spark.webtext.models`` names, under a key of the source's plan and the names,
    lengths and times of its files, so other or rewritten files train anew.  Each
    training has a folder of its own and counts once its success marker is there: one
    that broke off is passed over, and two at a time do not disturb each other.  A
    source that reads no file is trained each time."""
    files = _files_of(source)
    if not files:
        return materialise(spark, train(source), name)
    key = hashlib.md5(repr((name, train.__module__, train.__qualname__, source.semanticHash(), files)).encode()).hexdigest()
    base = spark.conf.get("spark.webtext.models", None) or ensure_checkpoint_dir(spark).rstrip("/") + "/models"
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/{name}-{key}")
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    done = fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(folder, "*/_SUCCESS"))
    if done:
        return spark.read.parquet(min(st.getPath().getParent().toString() for st in done))
    path = f"{base}/{name}-{key}/{uuid.uuid4().hex}"
    train(source).write.parquet(path)
    return spark.read.parquet(path)


def materialise(spark: SparkSession, df: DataFrame, name: str, rows_per_file: int = 0) -> DataFrame:
    """Write ``df`` once into the shared checkpoint folder and read it back.

    Cuts the lineage (a lost executor re-reads files instead of recomputing
    the whole plan) and lets a result be reused by several jobs.  Files of at most
    ``rows_per_file`` rows (0: any number) are dealt to the readers' tasks in even shares."""
    path = scratch_path(spark, name)
    df.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).parquet(path)
    return spark.read.parquet(path)
