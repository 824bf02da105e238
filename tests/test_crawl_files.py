import pytest
from pyspark.sql import functions as F

from webtext.functions import html as H
from webtext.operators import clean, crawl, domains as D, scores
from webtext.sources import files

from conftest import rows


def test_failed_fetches_are_errors(spark):
    df = spark.createDataFrame([("a", 200, "text/html", "a", "<p>"), ("b", None, None, None, None), ("c", 404, "x", "c", "y"),
                                ("d", 200, "application/pdf", "d", "z"), ("e", 200, "text/html", "f", None)],
                               "url string, status int, content_type string, final_url string, html string")
    routed = crawl.route_responses(df)
    assert rows(crawl.error_rows(routed)) == [("b", "No response"), ("c", "404"), ("d", "Redirected to PDF"), ("e", "No response")]
    assert crawl.good_responses(routed).count() + crawl.error_rows(routed).count() == 5
    named = crawl.route_responses(df.withColumn("message", F.lit("timed out")))
    assert rows(crawl.error_rows(named))[0] == ("b", "timed out")


def test_resume_strips_both_sides(spark):
    urls = spark.createDataFrame([("http://a/1#x",), ("http://a/1",), ("http://a/2",), ("http://a/3#y",)], "url string")
    done = spark.createDataFrame([("http://a/1#z",), ("http://a/3",)], "url string")
    assert rows(crawl.resume_pending(crawl.url_worklist(urls), done)) == [("http://a/2",)]


HOSTS = [("www.uni-bonn.de/x", "bonn.de", None), ("http://a_b.co.uk/", "a_b.co.uk", None), ("http://müller.co.uk", "müller.co.uk", None),
         ("http://x.co.uk/a b|{c", "x.co.uk", None), ("http://192.168.0.1/", "192.168.0.1.", None), ("http://uni.co.uk./", "uni.co.uk", None),
         ("https://me:pw@a.b.co.uk:8080/x", "b.co.uk", None), ("ck", ".ck", None), ("http://a.b.ck", "a.b.ck", None),
         ("http://www.ck", "www.ck", None), ("foo.bar", "foo.bar.", None), ("", None, None), (None, None, None), ("http://b.dup", "b.dup", None)]
RULES = ["uk", "co.uk", "ck", "*.ck", "!www.ck", "*.foo.bar", "dup", "!b.dup", "b.dup"]


@pytest.mark.parametrize("limit", [200_000, 0])
def test_domains_of_everyday_urls(spark, monkeypatch, limit):
    monkeypatch.setattr(D, "MAX_BROADCAST_RULES", limit)
    df = spark.createDataFrame([(u,) for u, _, _ in HOSTS], "url string")
    got = {r.url: r.domain for r in D.registered_domain(df, spark.createDataFrame([(r,) for r in RULES], "rule string")).collect()}
    assert len(got) == len(HOSTS)
    want = {u: d for u, d, _ in HOSTS}
    want.update({"www.uni-bonn.de/x": "de.", "foo.bar": "bar."})
    assert got == want


def test_references(spark):
    t = ["Diversit&auml;t", "l&#xE4;nger &#8211; &#228;", "&amp;lt; &lt;&gt;", "a & b &bogus; &#0; &#x110000;", "plain", "&", "&szlig;x&Uuml;"]
    want = ["Diversität", "länger – ä", "&lt; <>", "a & b &bogus; � �", "plain", "&", "ßxÜ"]
    df = spark.createDataFrame(list(enumerate(t)), "i int, t string")
    assert [r[0] for r in df.orderBy("i").select(H.decode_entities(F.col("t"))).collect()] == want


def test_row_index_keeps_rows_without_part(spark):
    df = spark.createDataFrame([("a", 1), ("a", 70000), (None, 5), (None, 9)], "part string, k long")
    assert rows(scores.row_index(df, "part", "k")) == sorted([("a", 1, 1), ("a", 70000, 2), (None, 5, 1), (None, 9, 2)], key=repr)


def test_order_of_a_url_stored_twice(spark):
    data = [("u", "x", 0, None, "p", t) for t in "dbca"] + [("u", "x", 1, "r", "p", "e")]
    schema = "url string, country string, pos int, url_redirect string, tag string, text string"
    for n in (1, 4):
        out = clean.add_element_order(spark.createDataFrame(data, schema).repartition(n))
        assert {r.text: r.order for r in out.collect()} == {"a": 2, "b": 3, "c": 4, "d": 5, "e": 6}


def test_semicolon_csv_with_empty_as_missing(spark, tmp_path):
    df = spark.createDataFrame([(1, "a;b"), (2, None), (3, "x\n\"y\"")], "i int, t string")
    files.write_csv(df, str(tmp_path / "c"), sep=";")
    assert rows(files.read_csv(spark, str(tmp_path / "c"), df.schema, sep=";", null_value="")) == rows(df)


def test_partitioned_write_and_pruned_read(spark, tmp_path):
    df = spark.createDataFrame([(1, "uk"), (2, "ger")], "i int, country string")
    files.write_parquet(df, str(tmp_path / "p"), partition_by=["country"])
    back = spark.read.parquet(str(tmp_path / "p")).filter("country = 'uk'")
    assert rows(back) == [(1, "uk")]
    assert "PartitionFilters: [isnotnull(country" in back._jdf.queryExecution().executedPlan().toString()


def test_sorted_partitioned_csv(spark, tmp_path):
    from webtext.sources import files
    path = str(tmp_path / "out")
    rows = [("uk", "b", 2, "x;y"), ("ger", "a", 1, ""), ("uk", "a", 9, None), ("uk", "a", 3, 'q"\n')]
    df = spark.createDataFrame(rows, "country string, url string, n int, text string").repartition(3)
    files.write_csv(df, path, sep=";", sort_by=["country", "url", "n"], partition_by=["country"])
    schema = "country string, url string, n int, text string"
    back = files.read_csv(spark, path, schema, sep=";", empty_is_missing=True)
    assert sorted((tuple(r[c] for c in ("country", "url", "n", "text")) for r in back.collect()), key=repr) == sorted(
        [("uk", "b", 2, "x;y"), ("ger", "a", 1, None), ("uk", "a", 9, None), ("uk", "a", 3, 'q"\n')], key=repr)
    one = back.filter("country = 'uk'")
    filters = one._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [")[1]
    assert "country" in filters.split("PushedFilters")[0]
    written = []
    for f in sorted((tmp_path / "out" / "country=uk").glob("part-*")):
        written += spark.read.options(**files.CSV_OPTIONS).option("sep", ";").schema(
            "url string, n int, text string").csv(str(f)).select("url", "n").collect()
    assert [tuple(r) for r in written] == [("a", 3), ("a", 9), ("b", 2)]


def test_overwriting_an_input_is_refused(spark, tmp_path):
    import pytest
    from webtext.sources import files
    path = str(tmp_path / "my data")
    files.write_csv(spark.range(3).selectExpr("id"), path)
    back = files.read_csv(spark, path, "id bigint")
    with pytest.raises(ValueError, match="is an input"):
        files.write_csv(back.filter("id > 0"), path)
    assert back.count() == 3
    files.write_csv(back, str(tmp_path / "my data 2"))
