import random
import statistics

import pytest
from pyspark.sql import functions as F

from webtext.operators import agreement as A, medians as M, scores as SC


@pytest.mark.parametrize("n", [1, 2, 3, 10, 999, 40_000])
def test_exact_median(spark, n):
    rnd = random.Random(n)
    data = [(rnd.choice("ab"), float(rnd.choice([rnd.randint(0, 50), rnd.random() * 1e6]))) for _ in range(n)]
    df = spark.createDataFrame(data, "g string, x double").repartition(5)
    got = {r.g: r.median for r in M.exact_median(df, ["g"], "x").collect()}
    want = {g: statistics.median(x for k, x in data if k == g) for g in {k for k, _ in data}}
    assert got == want


def test_median_of_nulls_and_ties(spark):
    data = [("hot", 7.0)] * 20_000 + [("hot", 1.0)] * 5 + [(None, 2.0), (None, 4.0), ("none", None)]
    df = spark.createDataFrame(data, "g string, x double")
    got = {r.g: r.median for r in M.exact_median(df, ["g"], "x").collect()}
    assert got == {"hot": 7.0, None: 3.0}


def test_median_holds_no_group_in_a_buffer(spark):
    df = spark.range(1000).select((F.col("id") % 2).alias("g"), F.col("id").cast("double").alias("x"))
    plan = M.exact_median(df, ["g"], "x")._jdf.queryExecution().executedPlan().toString()
    assert "median(" not in plan and "percentile(" not in plan


def test_strict_codes(spark):
    df = spark.createDataFrame([(1, 4), (None, 2)], "llm long, coder long")
    got = [tuple(r) for r in A.ratings_table(df, ["coder"], ["llm", "coder"]).collect()]
    assert got == [("Individual", "Neutral/Irrelevant"), (None, "Collective")]
    bad = spark.createDataFrame([(5,)], "llm long")
    with pytest.raises(Exception, match="code without a label: 5"):
        A.ratings_table(bad, [], ["llm"]).collect()
    assert bad.select(SC.label_of(F.col("llm"))).first()[0] is None
