"""Class scores: top-k candidates, token decoding, wide layout, row index."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import materialise

# --- fixed values ---------------------------------------------------------
CONCEPT_LABELS = {1: "Individual", 2: "Collective", 3: "Neutral/Irrelevant"}
TOP_K = 3
# --- end of fixed values --------------------------------------------------


def label_of(code, strict: bool = False) -> F.Column:
    """Integer code -> concept label.  A code that has none is null, or with
    ``strict`` an error (a null code stays null)."""
    expr = F
    for k, v in CONCEPT_LABELS.items():
        expr = expr.when(code == k, F.lit(v))
    if strict:
        unknown = F.concat(F.lit("code without a label: "), code.cast("string"))
        expr = expr.when(code.isNotNull(), F.raise_error(unknown))
    return expr


def topk_scores(scores: DataFrame, key: str = "doc_id", k: int = TOP_K) -> DataFrame:
    """The ``k`` most probable tokens per key with their ``rank`` (1 = best).

    ``row_number() <= k`` is planned with a partial group limit before the
    shuffle, so at most k rows per key and task are exchanged."""
    w = Window.partitionBy(key).orderBy(F.col("logprob").desc(), F.col("token"))
    return (scores.withColumn("rank", F.row_number().over(w))
            .filter(F.col("rank") <= k))


def decode_tokens(df: DataFrame) -> DataFrame:
    """token -> label (only the exact strings '1', '2', '3' decode; anything
    else is null); logprob -> probability in percent, rounded to 2 places."""
    tok = F.col("token")
    code = F.when(tok.isin("1", "2", "3"), tok.cast("int"))
    return (df.withColumn("label", label_of(code))
            .withColumn("linprob", F.round(F.exp("logprob") * 100, 2)))


def scores_wide(decoded: DataFrame, key: str = "doc_id", k: int = TOP_K) -> DataFrame:
    """One row per key with ``token_1..k`` and ``linprob_1..k`` (missing
    ranks stay null).  A grouped aggregate with conditional values, so it
    combines map-side."""
    aggs = []
    for r in range(1, k + 1):
        aggs.append(F.max(F.when(F.col("rank") == r, F.col("label"))).alias(f"token_{r}"))
        aggs.append(F.max(F.when(F.col("rank") == r, F.col("linprob"))).alias(f"linprob_{r}"))
    return decoded.groupBy(key).agg(*aggs)


def row_index_by(df: DataFrame, part: str, order: list[str], out: str = "index") -> DataFrame:
    """Dense running index (1, 2, ...) per ``part`` in the order of the columns
    ``order``, whatever their type; name as many as make the order total.

    The rows are cut into ranges of about equal size at sampled values of part and
    order, and written once with the number of their range; the counts of each part
    in each range, a table as small as the number of ranges, give the offsets."""
    spark = df.sparkSession
    ranged = df.repartitionByRange(part, *order).withColumn("_range", F.spark_partition_id())
    ranged = materialise(spark, ranged, "ranges")
    counts = ranged.groupBy(part, "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(part).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col(part).alias("_part"), F.col("_range").alias("_r"),
                            F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    same = F.col(part).eqNullSafe(F.col("_part")) & (F.col("_range") == F.col("_r"))
    within = Window.partitionBy(part, "_range").orderBy(*order)
    return (ranged.join(offsets, same).withColumn(out, (F.col("_offset") + F.row_number().over(within)).cast("bigint"))
            .drop("_part", "_r", "_range", "_offset"))


def row_index(df: DataFrame, part: str, key: str, bucket_width: int = 1 << 16,
              out: str = "index") -> DataFrame:
    """Dense running index (1, 2, ...) per ``part`` in ``key`` order, without
    gathering a partition value into one task.

    Rows are cut into key ranges (``key div bucket_width``); the size of each
    range is counted (an aggregate), a running sum over the small table of
    range counts gives every range its offset, and the index is the offset plus
    the row number within the range.  ``key`` must be an integral column."""
    bucket = F.floor(F.col(key) / bucket_width)
    with_b = df.withColumn("_bucket", bucket)
    counts = with_b.groupBy(part, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    wb = Window.partitionBy(part).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_offset", F.coalesce(F.sum("_n").over(wb), F.lit(0))).drop("_n")
    wr = Window.partitionBy(part, "_bucket").orderBy(key)
    # null-safe: rows without a part are a part of their own
    offsets = offsets.withColumnsRenamed({part: "_part", "_bucket": "_range"})
    same = F.col(part).eqNullSafe(F.col("_part")) & F.col("_bucket").eqNullSafe(F.col("_range"))
    return (with_b.join(offsets, same).drop("_part", "_range")
            .withColumn(out, (F.col("_offset") + F.row_number().over(wr)).cast("bigint"))
            .drop("_bucket", "_offset"))
