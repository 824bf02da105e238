"""Page -> text elements (extraction, per-page dedupe, heading runs).

All per-page work happens inside the page row with higher-order array
functions, so extraction never shuffles: every element of a page is produced
by the task that read the page.  Only :func:`explode_elements` turns the page
rows into one row per element.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import html as H


def extract_page_elements(pages: DataFrame, html_col: str = "html",
                          out_col: str = "elements") -> DataFrame:
    """Add ``elements``: title + every kept p/h1/h2/h3 (keep rule applied)."""
    return (pages
            .withColumn("_tokens", H.tokens(F.col(html_col)))
            .withColumn("_spans", H.spans("_tokens"))
            .withColumn(out_col, F.filter(H.raw_elements(F.col("_tokens"), F.col("_spans")), H.keep_rule))
            .drop("_tokens", "_spans"))


def dedupe_page_elements(pages: DataFrame, col: str = "elements") -> DataFrame:
    """Keep the first occurrence of every text within a page (title included)."""
    return (pages
            .withColumn("_by_text", H.sort_by_text(F.col(col)))
            .withColumn(col, H.first_of_each_text(F.col("_by_text")))
            .drop("_by_text"))


def collapse_page_headings(pages: DataFrame, col: str = "elements") -> DataFrame:
    """Drop headings that directly follow a heading (after dedupe)."""
    return pages.withColumn(col, H.drop_heading_runs(F.col(col)))


def explode_elements(pages: DataFrame, col: str = "elements") -> DataFrame:
    """One row per element: page columns + pos, tag, text, text_length."""
    keep = [c for c in pages.columns if c != col]
    # explode_outer + null filter: a plain explode makes the optimizer infer a
    # ``size(elements) > 0`` predicate and push it (with the whole extraction
    # inlined) below the projections, which would run the extraction twice.
    return (pages.select(*keep, F.explode_outer(col).alias("_e"))
            .filter(F.col("_e").isNotNull())
            .select(*keep, F.col("_e.pos").alias("pos"), F.col("_e.tag").alias("tag"),
                    F.col("_e.text").alias("text"),
                    F.length("_e.text").alias("text_length")))


def page_titles(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """Title row of each page (``No title`` fallback)."""
    return (pages.withColumn("_tokens", H.tokens(F.col(html_col)))
            .withColumn("title", H.page_title(F.col("_tokens"))).drop("_tokens"))


def extract_elements(pages: DataFrame, html_col: str = "html", dedupe: bool = True,
                     collapse: bool = True) -> DataFrame:
    """Full extraction: keep rule, per-page dedupe, heading-run collapse, explode."""
    out = extract_page_elements(pages, html_col)
    if dedupe:
        out = dedupe_page_elements(out)
    if collapse:
        out = collapse_page_headings(out)
    return explode_elements(out.drop(html_col))
