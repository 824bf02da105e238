"""Inter-rater agreement: label mapping, pairwise match flags, match %, pair counts.

All pairs are handled in one pass: rows are unpivoted into one row per
(pair, row) with ``stack`` and aggregated by pair.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scores import CONCEPT_LABELS, label_of

MERGE_CODES = {4: 3}      # fixed value: code 4 is counted as 3


def ratings_table(df: DataFrame, coders: list[str], raters: list[str]) -> DataFrame:
    """Coders' code 4 -> 3, then every rater's code -> concept label; any
    other code is an error."""
    out = df
    for c in coders:
        code = F.col(c)
        for a, b in MERGE_CODES.items():
            code = F.when(code == a, F.lit(b)).otherwise(code)
        out = out.withColumn(c, code)
    for r in raters:
        out = out.withColumn(r, label_of(F.col(r), strict=True))
    return out


def pairs(raters: list[str]) -> list[tuple[str, str]]:
    return list(combinations(raters, 2))


def match_flags(df: DataFrame, raters: list[str]) -> DataFrame:
    """``match_<a>_<b>`` for each pair (null when either side is null)."""
    return df.select("*", *[(F.col(a) == F.col(b)).alias(f"match_{a}_{b}") for a, b in pairs(raters)])


def _stack_pairs(df: DataFrame, raters: list[str]) -> DataFrame:
    ps = pairs(raters)
    args = ", ".join(f"'{a}', '{b}', `{a}`, `{b}`" for a, b in ps)
    return df.selectExpr(f"stack({len(ps)}, {args}) AS (rater_1, rater_2, value_1, value_2)")


def agreement(df: DataFrame, raters: list[str]) -> DataFrame:
    """Per pair: rows where both rated, matches, and match % (0.0 if none)."""
    s = _stack_pairs(df.select(*[F.col(r).cast("string") for r in raters]), raters)
    both = F.col("value_1").isNotNull() & F.col("value_2").isNotNull()
    return (s.groupBy("rater_1", "rater_2").agg(
        F.count_if(both).alias("n_both"),
        F.count_if(both & (F.col("value_1") == F.col("value_2"))).alias("n_match"))
        .withColumn("match_pct", F.when(F.col("n_both") == 0, F.lit(0.0))
                    .otherwise(F.col("n_match") * 100.0 / F.col("n_both"))))


def pair_counts(df: DataFrame, raters: list[str]) -> DataFrame:
    """Confusion counts per pair over rows where every rater is present."""
    complete = df.dropna(subset=raters)
    s = _stack_pairs(complete.select(*[F.col(r).cast("string") for r in raters]), raters)
    return s.groupBy("rater_1", "rater_2", "value_1", "value_2").agg(F.count(F.lit(1)).alias("count"))


def sorted_pair_counts(df: DataFrame, raters: list[str]) -> DataFrame:
    """Pair by pair, the most frequent values first."""
    return pair_counts(df, raters).sort("rater_1", "rater_2", F.desc("count"), "value_1", "value_2")


__all__ = ["CONCEPT_LABELS", "ratings_table", "match_flags", "agreement", "pair_counts", "sorted_pair_counts"]
