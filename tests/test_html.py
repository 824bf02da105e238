from pyspark.sql import functions as F

from webtext.functions import html as H
from webtext.operators import extract

LONG = "x" * 150


def page(spark, html, url="http://a.example.org/p"):
    return spark.createDataFrame([(url, html)], "url string, html string")


def elements(spark, html, **kw):
    return [(r.pos, r.tag, r.text) for r in
            extract.extract_elements(page(spark, html), **kw).orderBy("pos").collect()]


def test_heading_run_keeps_first_heading(spark):
    html = f"<title>T</title><h1>A</h1><h2>B</h2><h3>C</h3><p>{LONG}</p>"
    got = elements(spark, html)
    assert [t for _, t, _ in got] == ["title", "h1", "p"]


def test_title_is_not_a_heading(spark):
    got = elements(spark, "<title>T</title><h1>A</h1>")
    assert [t for _, t, _ in got] == ["title", "h1"]


def test_repeated_text_keeps_first(spark):
    html = f"<title>A</title><h1>A</h1><p>{LONG}</p><p>{LONG}</p>"
    got = elements(spark, html)
    assert [(p, t) for p, t, _ in got] == [(0, "title"), (2, "p")]


def test_paragraph_and_heading_bounds(spark):
    html = ("<title>T</title><p>" + "y" * 149 + "</p><p>" + "z" * 150 + "</p>"
            "<h1></h1><h2>q</h2>")
    got = elements(spark, html, dedupe=False, collapse=False)
    assert [(t, len(x)) for _, t, x in got] == [("title", 1), ("p", 150), ("h2", 1)]


def test_title_fallback(spark):
    assert elements(spark, "<p>no title here</p>")[0] == (0, "title", "No title")
    assert elements(spark, "<title>  </title>")[0] == (0, "title", "No title")
    assert elements(spark, "<title>A <b>B</b></title>")[0] == (0, "title", "No title")


def test_unclosed_paragraph_ends_at_next_block(spark):
    html = f"<title>T</title><p><b>{LONG}<br><p>second {LONG}</p><div>{LONG}</div>"
    got = elements(spark, html, dedupe=False, collapse=False)
    assert [x for _, t, x in got if t == "p"] == [LONG, "second " + LONG]


def test_scripts_comments_entities_whitespace(spark):
    html = ('<title>A &amp; B</title><script>var t="</p>";</script><!-- <p>hidden</p> -->'
            f'<p>  {LONG} &copy;  two\n words </p>')
    got = elements(spark, html)
    assert got[0][2] == "A & B"
    assert got[1][2] == LONG + " © two words"


def test_no_python_and_no_shuffle_in_extraction(spark):
    df = extract.extract_elements(page(spark, "<title>T</title>"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_page_titles(spark):
    t = extract.page_titles(page(spark, "<title> Hello  World </title>"))
    assert t.select("title").first()[0] == "Hello World"
    assert t.select(F.col("url")).count() == 1


def texts(spark, pages):
    """``(html, tag)``: the texts of the elements, before the rules that drop some."""
    df = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(pages)], "i int, html string").coalesce(1)
    df = df.withColumn("t", H.tokens(F.col("html"))).withColumn("s", H.spans("t"))
    els = df.select("i", H.raw_elements(F.col("t"), F.col("s")).alias("els")).collect()
    return [[e.text for e in r.els if e.tag == pages[r.i][1]] for r in sorted(els)]


CASES = [
    # a tag needs a letter behind the "<"; quoted values may hold ">"
    ("<h1>1 < 2 and 3 > 2</h1>", "h1", ["1 < 2 and 3 > 2"]),
    ('<p data-x="a > b">text</p>', "p", ["text"]),
    ("<p title='a > \"b' id=c>text</p>", "p", ["text"]),
    ("<p it's>text</p>", "p", ["text"]),
    ('<p title="never closed>text</p>', "p", ["text"]),
    ("<p>a<a title=\"</p><!--\">b</a>c --></p>", "p", ["a b c -->"]),
    # headings and paragraphs with content of their own
    ("<h2>x<div>y</div>z</h2>", "h2", ["x y z"]),
    ("<h1><p>text</p></h1>", "h1", ["text"]),
    ("<h1><p>text</p></h1>", "p", ["text"]),
    ("<h3><div><span>deep</span></div></h3>", "h3", ["deep"]),
    ("<p>one<p>two<div>three</div>four", "p", ["one", "two"]),
    ("<p>one</div>two</p>three", "p", ["one two"]),
    ("<div><p>one</div>two", "p", ["one"]),
    ("<h1>one<h2>two</h2></h1>", "h1", ["one"]),
    ("<h1>one</h3>two", "h1", ["one"]),
    ("<div><h1>one</div>two</h1>", "h1", ["one"]),
    ("<ul><li><p>one<li><p>two</ul>", "p", ["one", "two"]),
    ("<ul><li><h2>one<li>two</ul>", "h2", ["one two"]),      # the rule does not look behind an open heading
    ("<ul><li>a<ul><li><h2>one</h2></ul><h2>two</ul>", "h2", ["one", "two"]),
    ("<dl><dt><div><h3>one</h3><dd><h3>two</dl>three", "h3", ["one", "two"]),
    ("<table><tr><td><p>one<td><p>two</table>three", "p", ["one", "two"]),
    ("<table><tr><td><h2>one<tr><td>two</table>", "h2", ["one"]),
    ("<p>a<table><tr><td><p>b</p></td></tr></table>c", "p", ["a", "b"]),
    ("<div><table><tr><td></div><h1>one</h1></table></div>", "h1", ["one"]),
    ("<h1>a<hr>b</h1>", "h1", ["a b"]),
    # what is no content
    ("<script>var a = '<p>x</p>';", "p", []),
    ("<p>a<script>b</script x>c<style><p></style>d</p>", "p", ["a c d"]),
    ("<!-- <p>x</p> --><p>y</p><!--><p>z</p>", "p", ["y", "z"]),
    ("<p>a<!-- no end <p>b", "p", ["a"]),
    ("<p>a<?php > ?></ x><! y>b</p><p class=", "p", ["a ?> b"]),
    ("<title>a <p>b</title><p>c</p>", "p", ["c"]),
    ("\u0001\u0002<p>a\u0003b</p>", "p", ["a b"]),
    ("<P>A</P><H2\n id=x>B</h2\t>", "h2", ["B"]),
    ("", "p", []),
]


def test_structure(spark):
    got = texts(spark, [c[:2] for c in CASES])
    assert [(*c[:2], t) for c, t in zip(CASES, got)] == CASES


def test_titles(spark):
    cases = [("<title>A &amp; B < C</title>", "A & B < C"), ("<title>a<b>c</b></title>", "No title"),
                       ("<!--<title>x</title>--><TITLE lang='a>b'> y\n</TITLE><title>z</title>", "y"), ("<title>x", "No title"),
                       ("<script>'<title>x</title>'</script>", "No title"), (None, "No title")]
    df = extract.page_titles(spark.createDataFrame([(i, h) for i, (h, _) in enumerate(cases)], "i int, html string"))
    assert [r.title for r in df.orderBy("i").collect()] == [want for _, want in cases]


def test_deep_and_long_pages(spark):
    deep = "<div>" * 300 + "<h1>x" + "</div>" * 300
    long = "".join(f"<p>{i}" for i in range(3000)) + "<a " + "b='c' " * 20_000 + ">end</a>"
    first, got = texts(spark, [(deep, "h1"), (long, "p")])
    assert first == ["x"]
    assert got[:2999] == [str(i) for i in range(2999)] and got[2999] == "2999 end"


def test_references_as_the_standard_library_reads_them(spark):
    import html as std
    words = [n for n in std.entities.html5][::7] + [n.rstrip(";") for n in std.entities.html5][::11]
    cases = [f"a&{w}b" for w in words] + [f"&{w}" for w in words[:40]] + [
        "&comma;", "&nbsp", "&auml", "&aumlx", "&notit;", "&notin;", "&#150;", "&#x92", "&#0000000228;", "&#228", "&#x000e4;z",
        "&#;", "&#x;", "&#", "&", "&&amp;&", "&amp;amp;", "&ampamp;", "&#1114112;", "&#xD800;", "&#99999999999999999999;",
        "&#0;", "&bsol;&quot;&apos;&bne;", "&unknown;", "AT&T", "&lt;p&gt;", "&#x1F600;", "&copy&copy;"]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, t string").repartition(4)
    got = [r[0] for r in df.orderBy("i").select(H.decode_entities(F.col("t"))).collect()]
    assert got == [std.unescape(c) for c in cases]
