from pyspark.sql import functions as F

from webtext.streaming import crawl as S

from conftest import rows

SCHEMA = "url string, status int, content_type string, final_url string, html string"
PAGE = "<title>t</title><p>" + "a paragraph of some length, long enough to be kept by the rule " * 3 + "</p>"


def responses(spark, *urls):
    return spark.createDataFrame([(u, 404 if "bad" in u else 200, "text/html", u, PAGE) for u in urls], SCHEMA)


def test_runs_resume_and_store_each_url_once(spark, tmp_path):
    landing, good, bad, done, ckpt = (str(tmp_path / n) for n in ("landing", "good", "bad", "done", "ckpt"))
    for urls in (["http://a/1#y", "http://a/1#x", "http://a/bad"], ["http://a/1", "http://a/2", "http://a/bad#z"], []):
        if urls:
            responses(spark, *urls).write.mode("append").parquet(landing)
        S.run_once(spark, landing, SCHEMA, good, bad, done, ckpt)
    got = rows(S.stored_results(spark, good, bad), "url", "error")
    assert got == sorted([("http://a/1", None), ("http://a/2", None), ("http://a/bad", "404")], key=repr)
    texts = spark.read.parquet(good)
    assert texts.count() == texts.select("url", "pos").distinct().count()
    # a new checkpoint reads all files again, adds nothing and takes nothing away
    before = rows(texts.drop("batch"))
    S.run_once(spark, landing, SCHEMA, good, bad, done, str(tmp_path / "ckpt2"))
    assert rows(spark.read.parquet(good).drop("batch")) == before


def test_interrupted_batch_is_written_again(spark, tmp_path):
    good, bad, done = (str(tmp_path / n) for n in ("good", "bad", "done"))
    S.route_batch(responses(spark, "http://a/1"), "s-0", good, bad, done)
    batch = responses(spark, "http://a/1", "http://a/2")
    S.route_batch(batch, "s-1", good, bad, done)
    once = rows(spark.read.parquet(good))
    S.route_batch(batch, "s-1", good, bad, done)
    assert rows(spark.read.parquet(good)) == once
    assert spark.read.parquet(done).count() == 2


def test_a_batch_reads_no_stored_element(spark, tmp_path):
    good, bad, done = (str(tmp_path / n) for n in ("good", "bad", "done"))
    S.route_batch(responses(spark, "http://a/1"), "s-0", good, bad, done)
    seen = S.done_before(spark, done, "s-1")
    assert seen.columns == ["key"]
    assert all("/done/" in f for f in seen.inputFiles())
    (tmp_path / "good" / "batch=s-0").rename(tmp_path / "elsewhere")
    S.route_batch(responses(spark, "http://a/1", "http://a/2"), "s-1", good, bad, done)
    assert {r.url for r in spark.read.parquet(good).select(F.col("url")).collect()} == {"http://a/2"}
