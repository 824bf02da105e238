"""Class counts per (country, domain) and the Individual/Collective proportion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scores import CONCEPT_LABELS

# --- fixed values ---------------------------------------------------------
MIN_CONFIDENCE = 50.0          # top label kept only above this percent
INDIVIDUAL, COLLECTIVE, NEUTRAL = CONCEPT_LABELS[1], CONCEPT_LABELS[2], CONCEPT_LABELS[3]
# --- end of fixed values --------------------------------------------------


def attach_scores(rows: DataFrame, wide: DataFrame, key: str = "doc_id") -> DataFrame:
    """Join rows to their wide scores by key (not by position) and suppress a
    low-confidence top label (``linprob_1 <= 50``; a null probability keeps
    the label)."""
    j = rows.join(wide, key, "left")
    return j.withColumn("token_1", F.when(F.col("linprob_1") <= MIN_CONFIDENCE, F.lit(None))
                        .otherwise(F.col("token_1")))


def domain_class_counts(scored: DataFrame) -> DataFrame:
    """Rows per (country, domain, label); rows without a label are dropped."""
    return (scored.filter(F.col("token_1").isNotNull())
            .groupBy("country", "domain", "token_1").agg(F.count(F.lit(1)).alias("len")))


def domain_class_pivot(scored: DataFrame) -> DataFrame:
    """One column per label with its row count (0 when absent).  Domains
    whose rows all lack a label do not appear."""
    lab = F.col("token_1")
    return (scored.filter(lab.isNotNull()).groupBy("country", "domain")
            .agg(*[F.count_if(lab == v).alias(v) for v in (INDIVIDUAL, COLLECTIVE, NEUTRAL)]))


def domain_proportions(pivot: DataFrame, zero_is_one: bool = True) -> DataFrame:
    """Totals and the share of Individual among Individual + Collective.

    As in the study: a zero on exactly one side gives 1 (``zero_is_one``;
    False gives the plain ratio), and the share is null when the two classes
    hold one text or none."""
    i, c, n = F.col(INDIVIDUAL), F.col(COLLECTIVE), F.col(NEUTRAL)
    ratio = i / (i + c)
    if zero_is_one:
        prop = (F.when((i == 0) & (c == 0), F.lit(0.0))
                .when((i == 0) | (c == 0), F.lit(1.0)).otherwise(ratio))
    else:
        prop = F.when((i + c) > 0, ratio)
    return (pivot.withColumn("total", (n + c + i).cast("bigint"))
            .withColumn("total_ind_coll", (c + i).cast("bigint"))
            .withColumn("ind_coll_prop", F.when(F.col("total_ind_coll") <= 1, F.lit(None))
                        .otherwise(prop).cast("double")))
