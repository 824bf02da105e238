from webtext.operators import coverage as CV, facts as FA
from webtext.plans import fixtures as FX

from conftest import rows


def test_flags(spark):
    df = spark.createDataFrame([("n1", "http://a.example.org/", "1", None, 1900),
                                ("n2", "http://a.example.org/", "1.0", " Kirchlich ", 1970),
                                ("n3", "http://a.example.org/", None, "public", None)],
                               "name string, url string, elite string, type string, founding_year long")
    df = df.withColumn("student_size_n", df.founding_year.cast("double"))
    out = FA.normalise_flags(df, FX.suffix_rules(spark))
    assert rows(out, "name", "elite", "private", "old") == [
        ("n1", True, None, True), ("n2", False, True, False), ("n3", False, False, None)]


def test_medians(spark):
    df = spark.createDataFrame([("a", float(v) if v is not None else None, 1) for v in [1, 2, 4, 10, None]]
                               + [("b", None, 1)], "country string, international_per double, student_size_n long")
    out = FA.median_flags(df)
    got = rows(out, "country", "international_per", "international_per_above_50")
    assert got == sorted([("a", 1.0, False), ("a", 2.0, False), ("a", 4.0, True), ("a", 10.0, True),
                          ("a", None, None), ("b", None, None)], key=repr)


def test_union_by_name_missing(spark):
    a = spark.createDataFrame([("x", 1.5)], "c1 string, c2 double")
    b = spark.createDataFrame([("y",)], "c1 string")
    out = FA.union_sheets({"ger": a, "ind": b}, {"ger": ["name", "international_per"], "ind": ["name"]})
    assert rows(out, "country", "name", "international_per") == [("ger", "x", 1.5), ("ind", "y", None)]


def test_coverage_semantics(spark):
    urls = spark.createDataFrame([("http://a.example.org/1", "germany"), ("http://a.example.org/1", "germany"),
                                  ("http://b.example.org/1", "germany")], "url string, country string")
    els = spark.createDataFrame([("http://a.example.org/1", "t1"), ("http://a.example.org/1", "t2")],
                                "url string, text string")
    errs = spark.createDataFrame([("http://b.example.org/1", "404"), ("http://b.example.org/1", "500")],
                                 "url string, error string")
    filt = spark.createDataFrame([], "country string, domain string, url string, text string")
    u = CV.url_coverage(urls, els, errs, filt, FX.suffix_rules(spark))
    d = {r.domain: r for r in CV.domain_coverage(u).collect()}
    a, b = d["a.example.org"], d["b.example.org"]
    assert a.country == "ger"
    # listed twice: distinct count 1, sums inflated
    assert (a.urls_all_count, a.texts_all_total, a.texts_all_mean_per_url) == (1, 4, 2.0)
    # no scraped text: sum 0, mean null; two error rows fan out
    assert (b.urls_all_count, b.texts_all_total, b.texts_all_mean_per_url) == (1, 0, None)
    assert u.filter("domain = 'b.example.org'").count() == 2
    assert (a.texts_filtered_total, a.texts_filtered_mean_per_url) == (0, None)
