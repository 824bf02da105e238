"""Connected components of a graph held as a DataFrame of links.

Alternating large-star and small-star steps (each node links its larger
neighbours, then itself and its smaller ones, to the smallest it knows) until
nothing changes.  A step is a grouped minimum, summed before the shuffle, and a
join back; no node's neighbours are ever gathered.  Every round's links are
written to the shared folder, so lineage stays short and survives lost
executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved


def _star(links: DataFrame, large: bool) -> DataFrame:
    """``u`` is the larger end of every link."""
    if large:     # every node's larger neighbours go to the least of its neighbours and itself
        # its smaller neighbours decide the minimum: one row per link is enough for it
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        out = (links.select(F.col("v").alias("u"), F.col("u").alias("w")).join(least, "u")
               .select(F.col("w").alias("u"), F.col("m").alias("v")))
    else:         # a node and its smaller neighbours go to the least of these
        least = links.groupBy("u").agg(F.min("v").alias("m"))
        out = (links.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
               .unionByName(least.select("u", F.col("m").alias("v"))))
    return out.filter("u != v").distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """``links``: ``a, b`` (longs) -> ``node, root``, the least node of each
    component; nodes without a link to another do not appear."""
    now = saved(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                .filter("u != v").distinct(), "links")
    mark = None
    while True:
        new = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if new.n == 0 or tuple(new) == mark:
            break
        mark = tuple(new)
        now = saved(_star(_star(now, True), False), "links")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
