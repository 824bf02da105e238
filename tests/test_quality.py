import pytest
from pyspark.sql import functions as F

from webtext.operators import agreement as A, language as L, report as RP, sampling as SM

from conftest import rows


def test_agreement_none_both(spark):
    df = spark.createDataFrame([(1, None), (None, 2)], "r1 long, r2 long")
    out = A.agreement(df, ["r1", "r2"]).first()
    assert (out.n_both, out.match_pct) == (0, 0.0)


def test_agreement_and_pairs(spark):
    df = spark.createDataFrame([(1, 1, 4), (1, 2, 2), (2, 2, None)], "llm long, a long, b long")
    t = A.ratings_table(df, ["a", "b"], ["llm", "a", "b"])
    assert rows(t, "b") == sorted([(None,), ("Collective",), ("Neutral/Irrelevant",)], key=repr)
    ag = {(r.rater_1, r.rater_2): r.match_pct for r in A.agreement(t, ["llm", "a", "b"]).collect()}
    assert ag[("llm", "a")] == pytest.approx(200 / 3)
    pc = A.pair_counts(t, ["llm", "a", "b"])
    assert pc.filter("rater_1 = 'llm' AND rater_2 = 'a'").count() == 2
    flags = A.match_flags(t, ["llm", "a", "b"])
    assert rows(flags, "match_llm_b") == sorted([(None,), (False,), (False,)], key=repr)


def test_stratified_exact_n_and_stable(spark):
    df = spark.range(350).select(F.col("id").alias("key"),
                                 F.when(F.col("id") < 250, "big").otherwise("small").alias("country"))
    s1 = SM.stratified_sample(df, "country", "key", n=200)
    counts = {r.country: r["count"] for r in s1.groupBy("country").count().collect()}
    assert counts == {"big": 200, "small": 100}
    s2 = SM.stratified_sample(df.repartition(7), "country", "key", n=200)
    assert rows(s1, "key") == rows(s2, "key")
    with pytest.raises(Exception):
        SM.stratified_sample(df, "country", "key", n=200, strict=True).collect()


def test_stratified_plan_limits_before_shuffle(spark):
    df = spark.range(1000).select(F.col("id").alias("key"), (F.col("id") % 2).alias("country"))
    plan = SM.stratified_sample(df, "country", "key", n=5)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_language_detection(spark):
    train = spark.createDataFrame(
        [("en", "the cat and the dog are in the house with the other things"),
         ("de", "der hund und die katze sind in dem haus mit den anderen sachen")],
        "lang string, text string")
    prof = L.language_profiles(train)
    test = spark.createDataFrame([(1, "the dog and the house"), (2, "die katze und der hund"),
                                  (3, "   "), (4, "qqq zzz")], "doc_id long, text string")
    out = {r.doc_id: r.language for r in L.detect_language(test, prof, ["de", "en"]).collect()}
    assert out == {1: "eng", 2: "ger", 3: "Other", 4: "Error"}


def test_report_rollup(spark):
    df = spark.createDataFrame([("uk", 1.0, True), ("uk", 3.0, False), ("germany", None, None)],
                               "country string, number double, flag boolean")
    df = df.withColumn("country_name", RP.relabel_country(F.col("country")))
    out = {(r.country_name, r.variable, r.statistic): r.value
           for r in RP.country_report(df, ["number"], ["flag"]).collect()}
    assert out[("UK", "number", "mean")] == 2.0
    assert out[("Total", "number", "Nmiss")] == 1.0
    assert out[("Germany", "flag", "pct_true")] is None
    assert out[("Total", "flag", "pct_true")] == 50.0
