"""URL and domain coverage: scraped/filtered text counts, errors, classes, facts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip_fragment
from . import domains

# --- fixed values ---------------------------------------------------------
COUNTRY_CODES = {"germany": "ger", "india": "ind"}     # relabelled country names
# --- end of fixed values --------------------------------------------------


def url_coverage(urls: DataFrame, elements: DataFrame, errors: DataFrame,
                 filtered: DataFrame, rules: DataFrame, clean_urls: bool = False) -> DataFrame:
    """One row per listed URL: domain, texts scraped, error flag, texts kept.

    Plain left joins as in the study: a URL listed twice or with two error
    rows fans out (``clean_urls=True`` strips fragments and dedupes first).
    The per-URL counts are aggregated before they are joined."""
    if clean_urls:
        urls = urls.withColumn("url", strip_fragment(F.col("url"))).distinct()
    u = domains.registered_domain(urls, rules, "url", "domain")
    scraped = elements.groupBy("url").agg(F.count("text").alias("texts_all"))
    errs = errors.select("url", F.lit(True).alias("_err"))
    kept = (filtered.filter(F.col("country").isNotNull() & F.col("domain").isNotNull()
                            & F.col("url").isNotNull())
            .groupBy("country", "domain", "url").agg(F.count("text").alias("texts_filtered")))
    return (u.join(scraped, "url", "left")
            .join(errs, "url", "left")
            .withColumn("error", F.col("_err").isNotNull()).drop("_err")
            .replace(COUNTRY_CODES, subset=["country"])
            .join(kept, ["country", "domain", "url"], "left"))


def domain_coverage(url_cov: DataFrame) -> DataFrame:
    """Six measures per (country, domain); a sum over nothing is 0, a mean
    over nothing is null."""
    return url_cov.groupBy("country", "domain").agg(
        F.countDistinct("url").alias("urls_all_count"),
        F.count("texts_filtered").alias("urls_filtered_count"),
        F.coalesce(F.sum("texts_all"), F.lit(0)).cast("bigint").alias("texts_all_total"),
        F.avg("texts_all").alias("texts_all_mean_per_url"),
        F.coalesce(F.sum("texts_filtered"), F.lit(0)).cast("bigint").alias("texts_filtered_total"),
        F.avg("texts_filtered").alias("texts_filtered_mean_per_url"))


def coverage_classes(dom_cov: DataFrame, classes: DataFrame) -> DataFrame:
    return dom_cov.join(classes, ["country", "domain"], "left")


def analysis_table(cov_classes: DataFrame, facts: DataFrame) -> DataFrame:
    """Attach organisation facts; rows without a matching organisation go
    (a left join followed by dropping null names is an inner join)."""
    return cov_classes.join(facts, ["country", "domain"], "inner").filter(F.col("name").isNotNull())
