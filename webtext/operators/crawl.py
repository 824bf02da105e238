"""Crawl bookkeeping over stored responses: routing, URL worklists, resume."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import md5_order, strip_fragment

PDF_TYPE = "application/pdf"          # fixed value: content type routed to errors
PDF_ERROR = "Redirected to PDF"       # fixed value: its error message
NO_RESPONSE = "No response"           # error of a fetch that left no status or no body


def route_responses(responses: DataFrame) -> DataFrame:
    """Add ``error`` (HTTP status >= 400 -> the code as text; PDF -> message; a
    failed fetch, without status or body -> its ``message`` column, if there is
    one, else a fixed text; otherwise null) and ``url_redirect`` (final URL when
    it differs).  Every response ends in one of the two stores."""
    status, ctype = F.col("status"), F.col("content_type")
    message = [F.col("message")] if "message" in responses.columns else []
    error = (F.when(status >= 400, status.cast("string"))
             .when(ctype == PDF_TYPE, F.lit(PDF_ERROR))
             .when(status.isNull() | F.col("html").isNull(), F.coalesce(*message, F.lit(NO_RESPONSE))))
    redirect = F.when(F.col("final_url") != F.col("url"), F.col("final_url"))
    return responses.withColumn("error", error).withColumn("url_redirect", redirect)


def good_responses(routed: DataFrame) -> DataFrame:
    return routed.filter(F.col("error").isNull())


def error_rows(routed: DataFrame) -> DataFrame:
    return routed.filter(F.col("error").isNotNull()).select("url", "error")


def url_worklist(urls: DataFrame, url_col: str = "url") -> DataFrame:
    """Strip ``#fragments`` and keep distinct URLs (partial aggregation
    collapses repeats before the shuffle)."""
    return urls.select(strip_fragment(F.col(url_col)).alias(url_col)).distinct()


def resume_pending(worklist: DataFrame, *done: DataFrame, url_col: str = "url") -> DataFrame:
    """URLs of the worklist not yet present in any of the ``done`` tables, whose
    URLs lose their fragments as the worklist's did."""
    seen = None
    for d in done:
        part = d.select(strip_fragment(F.col(url_col)).alias(url_col))
        seen = part if seen is None else seen.unionByName(part)
    if seen is None:
        return worklist
    return worklist.join(seen.distinct(), url_col, "left_anti")


def sample_urls(urls: DataFrame, n: int, seed: int, url_col: str = "url") -> DataFrame:
    """Reproducible subset of ``n`` URLs (all when n <= 0): the n smallest by a
    keyed hash.  A top-n (per-partition top-n, then merge), never a full sort."""
    if n <= 0:
        return urls
    key = md5_order(F.col(url_col), seed)
    return (urls.withColumn("_k", key).orderBy("_k", url_col).limit(n).drop("_k"))
