"""Reproducible samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import md5_order

SEED = 161161          # fixed value: seed of the gold-standard sample
PER_STRATUM = 200      # fixed value: rows per country


def stratified_sample(df: DataFrame, stratum: str, key: str, n: int = PER_STRATUM,
                      seed: int = SEED, strict: bool = False) -> DataFrame:
    """Exactly ``n`` rows per stratum (all rows of smaller strata), chosen by
    a keyed hash order so the sample is stable under repartitioning.

    ``row_number() <= n`` is planned as a partial per-task group limit before
    the shuffle and a final one after it, so a huge stratum never ships more
    than ``n`` rows per task.  ``strict=True`` raises when a stratum is short
    (as sampling without replacement would)."""
    w = Window.partitionBy(stratum).orderBy(md5_order(F.col(key), seed), F.col(key))
    out = df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")
    if strict:
        sizes = out.groupBy(stratum).agg(F.count(F.lit(1)).alias("_n"))
        short = F.concat(F.lit("stratum smaller than sample size: "), F.col(stratum).cast("string"))
        # a filter (not a dropped column) so the check cannot be pruned away
        out = (out.join(sizes, stratum)
               .filter(F.when(F.col("_n") < n, F.raise_error(short)).otherwise(F.lit(True)))
               .drop("_n"))
    return out
