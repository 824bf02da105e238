from pyspark.sql import functions as F

from webtext.operators import clean
from webtext.plans import fixtures as FX

from conftest import rows

SCHEMA = "country string, url string, url_redirect string, pos int, tag string, text string, text_length int"


def el(spark, data):
    return spark.createDataFrame(data, SCHEMA)


def test_length_cap(spark):
    df = el(spark, [("ger", "http://a.example.org/1", None, 1, "p", "a", 3999),
                    ("ger", "http://a.example.org/1", None, 2, "p", "b", 4000)])
    out = clean.clean_corpus(df, FX.suffix_rules(spark))
    assert rows(out, "text") == [("a",)]


def test_order_numbering_and_gaps(spark):
    u = "http://a.example.org/1"
    df = el(spark, [("ger", u, None, 0, "title", "T", 1),
                    ("ger", u, None, 1, "p", "Accept cookies", 14),
                    ("ger", u, None, 2, "p", "dup", 3),
                    ("ger", u, None, 3, "p", "dup", 3),
                    ("ger", u, None, 4, "p", "long", 5000),
                    ("ger", u, None, 5, "p", "last", 4)])
    out = clean.clean_corpus(df, FX.suffix_rules(spark))
    # numbering starts at 2; the cookie row leaves no gap (filtered before),
    # the duplicate and the long row leave gaps (dropped after numbering)
    assert rows(out, "text", "order") == [("T", 2), ("dup", 3), ("last", 6)]


def test_boilerplate_and_null_text(spark):
    df = el(spark, [("ger", "http://a.example.org/1", None, 0, "title", "No title", 8),
                    ("ger", "ftp://a.example.org/1", None, 1, "p", "ok", 2),
                    ("ger", "http://a.example.org/1", None, 2, "p", None, None),
                    ("ger", "http://a.example.org/1", None, 3, "p", "COOKIES!", 8),
                    ("ger", "http://a.example.org/1", None, 4, "p", "fine", 4)])
    assert rows(clean.filter_boilerplate(df), "text") == [("fine",)]


def test_normalise_and_word_count(spark):
    df = el(spark, [("ger", "http://a", None, 0, "p", "  a \t b ", 1),
                    ("ger", "http://a", None, 1, "p", "", 0)])
    out = clean.add_word_count(clean.normalise_text(df))
    assert rows(out, "pos", "text", "text_words") == [(0, "a b", 2), (1, "", 1)]


def test_privacy_urls_dropped_after_dedupe(spark):
    df = el(spark, [("ger", "http://a.example.org/datenschutz", None, 0, "p", "same", 4),
                    ("ger", "http://b.example.org/x", None, 0, "p", "other", 5)])
    out = clean.clean_corpus(df, FX.suffix_rules(spark))
    assert rows(out, "text") == [("other",)]


def test_corpus_summary_counts_null_domain(spark):
    df = spark.createDataFrame([("u1", "d1"), ("u1", None), ("u2", None)], "url string, domain string")
    r = clean.corpus_summary(df).first()
    assert (r.num_rows, r.num_unique_urls, r.num_unique_domains, r.mean_rows_per_url) == (3, 2, 2, 1.5)


def test_rows_that_late_filters_drop_carry_no_text(spark):
    """They still hide their repeats, as before."""
    cols = "country string, domain string, url string, order bigint, text string, text_length int"
    df = spark.createDataFrame([("ger", "d", "http://a", 2, "long", 4000), ("ger", "d", "http://b", 2, "long", 4),
                                ("ger", "d", "http://a/datenschutz", 3, "p", 1), ("ger", "d", "http://c", 2, "kept", 4),
                                ("usa", "d", "http://c", 3, "kept", 4), ("usa", "d", "http://c", 4, "unknown", None)], cols)
    firsts = clean.dedupe_domain_text(df, clean.passes_late_filters())
    got = sorted(tuple(r) for r in firsts.select("url", "order", "text").collect())
    assert got == [("http://a", 2, None), ("http://a/datenschutz", 3, None), ("http://c", 2, "kept"), ("http://c", 4, None)]
    assert [r.text for r in clean.late_filters(firsts).collect()] == ["kept"]
    assert [r.text for r in clean.late_filters(clean.dedupe_domain_text(df)).collect()] == ["kept"]


def test_dropped_long_texts_are_cut_and_change_nothing(spark):
    """They are sorted, counted and hide repeats as whole ones do."""
    long, n = "word " * 3000, clean.MAX_TEXT_LENGTH
    spaced = ("ab" + " " * 40) * 150                      # long as it is stored, short afterwards
    short = ("ab " * 150).strip()
    url = "http://a.example.org/1"
    data = [(1, "a", "z last"), (1, "b", long + "b"), (1, "c", long + "a"), (1, "d", "word"), (1, "e", long[:n + 99].strip()),
            (2, "f", spaced), (3, "g", short), (4, "h", "x" * n), (5, "i", "x" * (n - 1)), (6, "j", "\t" * n + "x" * (n - 1)),
            (7, "k", None), (8, "l", long + "Cookies"), (9, "m", "end")]
    df = spark.createDataFrame([("ger", url, pos, "p", text, text and len(text), row) for pos, row, text in data],
                               "country string, url string, pos int, tag string, text string, text_length int, row string")
    df = df.withColumn("url_redirect", F.lit(None).cast("string"))
    rules = FX.suffix_rules(spark)
    whole = (df.transform(clean.filter_boilerplate).transform(clean.normalise_text).transform(lambda d: clean.add_domain(d, rules))
             .transform(clean.add_element_order).transform(clean.dedupe_domain_text).transform(clean.late_filters)
             .transform(clean.add_word_count))
    cols = ["row", "order", "domain", "text", "text_length", "text_words"]
    got = sorted(map(tuple, clean.clean_corpus(df, rules).select(cols).collect()))
    assert got == sorted(map(tuple, whole.select(cols).collect()))
    assert [(r[0], r[1]) for r in got] == [("a", 6), ("d", 2), ("i", 10), ("m", 12)]
    cut = {r.row: len(r.text) for r in clean.normalise_text(df.filter("text IS NOT NULL"), whole=F.col("text_length") < n).collect()}
    assert cut["b"] == cut["c"] == cut["l"] == clean.HEAD - 1 and cut["f"] == len(short) and cut["j"] == n - 1
