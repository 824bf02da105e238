"""Descriptive table by country and in total (long form)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .medians import exact_median

# --- fixed values ---------------------------------------------------------
COUNTRY_NAMES = {"uk": "UK", "usa": "USA", "india": "India", "germany": "Germany",
                 "ind": "India", "ger": "Germany"}
TOTAL = "Total"
# --- end of fixed values --------------------------------------------------


def relabel_country(col: F.Column) -> F.Column:
    expr = None
    for k, v in COUNTRY_NAMES.items():
        expr = F.when(col == k, F.lit(v)) if expr is None else expr.when(col == k, F.lit(v))
    return expr.otherwise(col)


def as_numeric(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("string").try_cast("double") for c in cols})


def null_if(df: DataFrame, cols: list[str], value) -> DataFrame:
    return df.withColumns({c: F.nullif(F.col(c), F.lit(value)) for c in cols})


def _long(df: DataFrame, by: str, names: list[str], value_type: str) -> DataFrame:
    """(total, by, variable, x): every value under its group and under all rows."""
    values = F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).cast(value_type).alias("x"))
                       for c in names])
    return (df.select(by, F.explode(values).alias("_v"))
            .select(by, "_v.variable", "_v.x")
            .select(F.explode(F.array(F.lit(False), F.lit(True))).alias("total"), by, "variable", "x")
            .withColumn(by, F.when(F.col("total"), F.lit(TOTAL)).otherwise(F.col(by))))


def country_report(df: DataFrame, numeric: list[str], flags: list[str],
                   by: str = "country_name", digits: int = 6) -> DataFrame:
    """Per group and for all rows: for numbers the missing count, mean, sd,
    median, min, max; for flags the count and percent of TRUE over non-missing
    rows.  Long form: (group, variable, statistic, value)."""
    x = F.col("x")
    key = ["total", by, "variable"]

    def stacked(wide: DataFrame, names: list[str]) -> DataFrame:
        pairs = ", ".join(f"'{n}', `{n}`" for n in names)
        return (wide.selectExpr(*key, f"stack({len(names)}, {pairs}) AS (statistic, value)"))

    numbers = _long(df, by, numeric, "double")
    num = numbers.groupBy(*key).agg(
        F.count_if(x.isNull()).cast("double").alias("Nmiss"), F.avg(x).alias("mean"),
        F.stddev_samp(x).alias("sd"), F.min(x).alias("min"), F.max(x).alias("max"))
    out = stacked(num, ["Nmiss", "mean", "sd", "min", "max"])
    med = exact_median(numbers, key, "x")
    med = med.select(*[F.col(c).alias(f"_{c}") for c in key], "median")
    same = F.lit(True)
    for c in key:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    out = out.unionByName(stacked(num.select(*key).join(med, same, "left").select(*key, "median"),
                                  ["median"]))
    if flags:
        yes = _long(df, by, flags, "boolean").groupBy(*key).agg(
            F.count_if(x).cast("double").alias("count_true"),
            F.try_divide(F.count_if(x) * 100.0, F.count(x)).alias("pct_true"),
            F.count_if(x.isNull()).cast("double").alias("Nmiss"))
        out = out.unionByName(stacked(yes, ["count_true", "pct_true", "Nmiss"]))
    return out.drop("total").withColumn("value", F.round("value", digits))
