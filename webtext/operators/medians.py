"""Exact medians without a buffer of all values of a group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Rank error of the sketch is n / ACCURACY; the band below is wider on each side.
ACCURACY = 10_000
BAND = 3 / ACCURACY


def exact_median(df: DataFrame, by: list[str], value: str, out: str = "median") -> DataFrame:
    """(by..., out): the exact median of the non-null values per group (a null
    in ``by`` is a group; a group without values has no row).

    A mergeable quantile sketch of bounded size gives each group two bounds that
    enclose its middle ranks.  A second pass counts the values below the band
    and, per distinct value, those inside it (a few of 10,000 rows, repeats
    combined map-side).  Only these counts meet in one task per group."""
    x = F.col(value).cast("double")
    rows = df.select(*by, x.alias("_x")).filter(F.col("_x").isNotNull())
    bounds = rows.groupBy(*by).agg(
        F.percentile_approx("_x", [0.5 - BAND, 0.5 + BAND], ACCURACY).alias("_b"),
        F.count(F.lit(1)).alias("_n"))
    b = bounds.select(*[F.col(c).alias(f"_by_{c}") for c in by], "_b", "_n")
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    # values below the band collapse into one count, values above it go
    banded = (rows.join(b, same).filter(F.col("_x") <= F.col("_b")[1])
              .withColumn("_v", F.when(F.col("_x") >= F.col("_b")[0], F.col("_x")))
              .groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("_c"), F.first("_n").alias("_n")))
    w = (Window.partitionBy(*by).orderBy(F.col("_v").asc_nulls_first())
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    last = F.sum("_c").over(w)
    ranked = banded.withColumn("_last", last).withColumn("_first", F.col("_last") - F.col("_c") + 1)
    low, high = F.floor((F.col("_n") + 1) / 2), F.floor(F.col("_n") / 2) + 1
    holds = lambda r: (F.col("_first") <= r) & (F.col("_last") >= r)
    return (ranked.groupBy(*by)
            .agg(F.max(F.when(holds(low), F.col("_v"))).alias("_lo"),
                 F.max(F.when(holds(high), F.col("_v"))).alias("_hi"))
            .select(*by, ((F.col("_lo") + F.col("_hi")) / 2).alias(out)))
