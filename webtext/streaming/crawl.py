"""Incremental, resumable routing of stored responses (Structured Streaming).

Response files land in a folder; each run processes only files not seen
before (the checkpoint records them) and, as the study's crawler did, skips
URLs that already have a stored result.  Elements of good responses and error
rows go to two Parquet stores; a third, of 16 bytes a URL, says which URLs are
done, so that no batch reads stored elements again.  ``availableNow`` drains what
is there and stops, so a run is a batch job that can be resumed at any time.

Each micro-batch has a folder of its own in every store, named by the stream's id
and the batch's number, and overwrites it: a batch that was interrupted between
its writes is written again as a whole, by the URLs done before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..operators import crawl, extract
from ..operators.clean import first_row_per_key

ELEMENT_COLS = ["url", "url_redirect", "pos", "tag", "text", "text_length"]


def url_key(url) -> F.Column:
    return F.unhex(F.md5(url))


def done_before(spark: SparkSession, done_path: str, batch: str) -> DataFrame | None:
    """(key) of the URLs that batches other than ``batch`` have processed."""
    try:
        done = spark.read.schema("key binary, batch string").parquet(done_path)
    except AnalysisException:      # store not created yet
        return None
    return done.filter(F.col("batch") != batch).select("key")


def route_batch(batch: DataFrame, name: str, good_path: str, bad_path: str, done_path: str) -> None:
    """Route one batch of responses and store its new results in its folders."""
    spark = batch.sparkSession
    # one response per fragment-free URL; the smallest original URL wins, so a
    # batch is processed the same way however it is partitioned
    stripped = batch.withColumn("_orig", F.col("url")).withColumn("url", F.regexp_replace("url", "#.*$", ""))
    todo = first_row_per_key(stripped, ["url"], ["_orig"]).drop("_orig").withColumn("key", url_key(F.col("url")))
    done = done_before(spark, done_path, name)
    if done is not None:
        todo = todo.join(done, "key", "left_anti")
    routed = crawl.route_responses(todo).persist()      # read by three writes
    try:
        good = crawl.good_responses(routed).select("url", "url_redirect", "html")
        for rows, path in ((extract.extract_elements(good).select(*ELEMENT_COLS), good_path),
                           (crawl.error_rows(routed), bad_path), (routed.select("key"), done_path)):
            rows.write.mode("overwrite").parquet(f"{path}/batch={name}")
    finally:
        routed.unpersist()


def run_once(spark: SparkSession, landing: str, schema, good_path: str, bad_path: str,
             done_path: str, checkpoint: str) -> None:
    """Process every response file in ``landing`` not processed before."""
    def route(batch: DataFrame, number: int) -> None:
        # the checkpoint keeps the stream's id, so a new checkpoint has new folders
        stream_id = batch.sparkSession.read.json(f"{checkpoint}/metadata").first()["id"]
        route_batch(batch, f"{stream_id}-{number}", good_path, bad_path, done_path)

    stream = spark.readStream.schema(schema).parquet(landing)
    q = (stream.writeStream.foreachBatch(route)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()


def stored_results(spark: SparkSession, good_path: str, bad_path: str) -> DataFrame:
    """One row per processed URL: error (null if good) and stored texts."""
    good = (spark.read.parquet(good_path).groupBy("url")
            .agg(F.count("text").alias("texts")).withColumn("error", F.lit(None).cast("string")))
    bad = spark.read.parquet(bad_path).select("url", "error", F.lit(0).cast("bigint").alias("texts"))
    return good.unionByName(bad)
