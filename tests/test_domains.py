import pytest

from webtext.functions.punycode import decoded_labels
from webtext.operators import domains
from webtext.plans import fixtures as FX


def resolve(spark, urls, rules=None):
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    rules = rules if rules is not None else FX.suffix_rules(spark)
    out = domains.registered_domain(df, rules, "url", "domain")
    return dict((r.url, r.domain) for r in out.collect())


CASES = {
    "http://a.b.co.uk/x": "b.co.uk",
    "http://localhost/": "localhost.",
    "not a url": None,
    "http://x.www.ck": "www.ck",
    "http://a.b.foo.ck": "b.foo.ck",
    "https://Sub.Example.ORG/path?q=1": "sub.example.org",
    "http://co.uk/": ".co.uk",
}


def test_rules(spark):
    assert resolve(spark, list(CASES)) == CASES


def test_fallback_for_large_rule_tables_agrees(spark, monkeypatch):
    monkeypatch.setattr(domains, "MAX_BROADCAST_RULES", 0)
    assert resolve(spark, list(CASES)) == CASES


def test_redirect_preferred(spark):
    df = spark.createDataFrame([("http://a.example.com/", "http://b.co.uk/"), ("http://a.example.com/", None)],
                               "url string, url_redirect string")
    out = domains.registered_domain(df, FX.suffix_rules(spark), "url", "domain", redirect_col="url_redirect")
    assert sorted(r.domain for r in out.collect()) == ["a.example.com", "b.co.uk"]


ODD = {
    "http://user:p@ss@uni.co.uk/": "uni.co.uk",
    "http://a b.co.uk/": "a b.co.uk",
    "http://x.uni\u3002co\uff0euk\uff61/": "uni.co.uk",
    "https://www.xn--e1aybc.xn--p1ai/x": "xn--e1aybc.xn--p1ai",
    "https://www.тест.рф": "тест.рф",
    "http://a.xn--bcher-kva.ck": "a.xn--bcher-kva.ck",
    "http://xn--zz--zz.example": "xn--zz--zz.example",
    "//b.co.uk": "b.co.uk",
    "http://[::1]:80/": "[::1].",
    "http://@/": None,
}


@pytest.mark.parametrize("limit", [200_000, 0])
def test_punycode_dots_and_user_parts(spark, monkeypatch, limit):
    monkeypatch.setattr(domains, "MAX_BROADCAST_RULES", limit)
    rules = spark.createDataFrame([(r,) for r in ["uk", "co.uk", "рф", "*.ck", "example"]], "rule string")
    got = resolve(spark, list(ODD), rules)
    assert got == ODD
    coded = spark.createDataFrame([("xn--p1ai",), ("co.uk",)], "rule string")
    assert resolve(spark, ["https://www.тест.рф"], coded) == {"https://www.тест.рф": "тест.рф"}


def test_decoded_labels(spark):
    words = ["bücher", "рф", "例え", "ésta", "españa", "ليهمابتكلموشعربي", "3年b組金八先生", "mañana", "a-b-ü", "ü", "😀", "xx"]
    coded = ["xn--" + w.encode("punycode").decode() for w in words]
    bad = ["xn--", "xn--ü", "xn--a_b", "xn--99999999", "xn--z", "xn---", "plain", "xn--zzzzzzzzzzzzzzzzzzzzzzzzz"]
    df = spark.createDataFrame([(coded + bad,)], "labels array<string>")
    assert df.select(decoded_labels("labels")).first()[0] == words + bad


def test_one_join_and_no_job(spark):
    rules = FX.suffix_rules(spark)
    df = spark.createDataFrame([("http://a.co.uk",)], "url string")
    done = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
    out = domains.registered_domain(df, rules)
    assert spark.sparkContext.statusTracker().getJobIdsForGroup(None) == done
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") == 1 and "SortMergeJoin" not in plan and "NestedLoop" not in plan
