"""Corpus cleaning: boilerplate filters, normalisation, element order, dedupe."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import collapse_ws, let, word_count
from . import domains

# --- fixed values ---------------------------------------------------------
BOILERPLATE_TEXT = r"(?i)cookies"       # dropped text (case-insensitive)
NO_TITLE = "No title"                   # dropped text (case-sensitive)
PRIVACY_URL = r"(?i)datenschutz"        # dropped URLs
MAX_TEXT_LENGTH = 4000                  # texts at least this long are dropped
ORDER_START = 2                         # first element of a URL gets order 2
# --- end of fixed values --------------------------------------------------

# Code points from which a text that is dropped later shows that it is no kept one.
HEAD = MAX_TEXT_LENGTH * 9 // 8


def filter_boilerplate(df: DataFrame) -> DataFrame:
    """Keep http(s) URLs; drop cookie notices and ``No title`` rows (a null
    text is dropped as well)."""
    return (df.filter(F.col("url").rlike("^http"))
            .filter(~F.col("text").rlike(BOILERPLATE_TEXT))
            .filter(~F.col("text").contains(NO_TITLE)))


def normalise_text(df: DataFrame, col: str = "text", whole: Column | None = None) -> DataFrame:
    """White space trimmed and collapsed.  Of a text that need not be ``whole``, its first
    ``HEAD`` code points do where they hold ``MAX_TEXT_LENGTH`` or more afterwards."""
    text = F.col(col)
    if whole is None:
        return df.withColumn(col, collapse_ws(text))
    head = F.when(~whole & (F.length(text) > HEAD), collapse_ws(F.substring(text, 1, HEAD)))
    return df.withColumn(col, let(head, lambda h: F.when(F.length(h) >= MAX_TEXT_LENGTH, h).otherwise(collapse_ws(text))))


def add_word_count(df: DataFrame, col: str = "text", out: str = "text_words") -> DataFrame:
    return df.withColumn(out, word_count(F.col(col)))


def add_domain(df: DataFrame, rules: DataFrame) -> DataFrame:
    """Registrable domain of the redirect target if any, else of the URL."""
    return domains.registered_domain(df, rules, "url", "domain", redirect_col="url_redirect")


def add_element_order(df: DataFrame) -> DataFrame:
    """``order`` = running count of elements of the URL (in (country, pos)
    order; a URL stored twice is told apart by redirect, tag and text), starting
    at 2.  Numbered before dedupe, so later drops leave gaps."""
    ties = [c for c in ("url_redirect", "tag", "text") if c in df.columns]
    w = Window.partitionBy("url").orderBy("country", "pos", *ties)
    return df.withColumn("order", (F.row_number().over(w) + (ORDER_START - 1)).cast("bigint"))


def first_row_per_key(df: DataFrame, keys: list[str], order: list[str],
                      wide: tuple[str, ...] = ("text",), needed: Column | None = None) -> DataFrame:
    """One row per ``keys``: the one with the smallest ``order`` columns.

    Written as an aggregate of ``min(struct(order..., rest...))`` so that the
    map side already collapses repeats (a hot key ships one row per task),
    instead of a window that would gather a whole group into one task.  ``wide``
    keys are grouped by their 128-bit hash, so rows are sorted and exchanged by
    16 bytes and not by whole texts.  Rows that are not ``needed`` take part
    with null in place of their wide keys; the order must be total without them."""
    plain = [c for c in keys if c not in wide]
    digests = [F.unhex(F.md5(c)).alias(f"_h_{c}") for c in keys if c in wide]
    rest = [c for c in df.columns if c not in plain and c not in order]
    carried = [F.when(needed, F.col(c)).alias(c) if needed is not None and c in wide else c for c in rest]
    packed = F.min(F.struct(*order, *carried)).alias("_first")
    return (df.groupBy(*plain, *digests).agg(packed)
            .select(*plain, *[F.col(f"_first.{c}").alias(c) for c in order + rest])
            .select(*df.columns))


def dedupe_domain_text(df: DataFrame, needed: Column | None = None) -> DataFrame:
    """Unique (domain, text); keeps the smallest (country, url, order)."""
    return first_row_per_key(df, ["domain", "text"], ["country", "url", "order"], needed=needed)


def passes_late_filters() -> Column:
    return ~F.col("url").rlike(PRIVACY_URL) & (F.col("text_length") < MAX_TEXT_LENGTH)


def late_filters(df: DataFrame) -> DataFrame:
    """After ordering and dedupe: drop privacy-page URLs and long texts (the
    length measured at extraction, before repair)."""
    return df.filter(passes_late_filters())


def clean_corpus(elements: DataFrame, rules: DataFrame) -> DataFrame:
    """Scraped elements of all countries -> clean corpus.

    A text too long for the corpus still counts in the order of its page and hides shorter
    texts that equal it.  From ``MAX_TEXT_LENGTH`` code points on it equals none (no text is
    longer than its length at extraction, as repair only shortens), and against others of its
    place it is sorted as its beginning is: where two such beginnings are equal, both are dropped."""
    return (elements
            .transform(filter_boilerplate)
            .transform(lambda d: normalise_text(d, whole=F.col("text_length") < MAX_TEXT_LENGTH))
            .transform(lambda d: add_domain(d, rules))
            .transform(add_element_order)
            # rows that the late filters drop hide their repeats, but need no text for it
            .transform(lambda d: dedupe_domain_text(d, passes_late_filters()))
            .transform(late_filters)
            # the words of dropped rows are not counted
            .transform(add_word_count))


def corpus_summary(df: DataFrame) -> DataFrame:
    """Rows, distinct URLs, distinct domains (a null counts as one value) and
    rows per URL rounded to 2 places."""
    def n_unique(c):
        return (F.countDistinct(c) + F.max(F.col(c).isNull().cast("int"))).cast("bigint")
    return (df.agg(F.count(F.lit(1)).alias("num_rows"),
                   n_unique("url").alias("num_unique_urls"),
                   n_unique("domain").alias("num_unique_domains"))
            .withColumn("mean_rows_per_url",
                        F.round(F.try_divide(F.col("num_rows"), F.col("num_unique_urls")), 2)))
