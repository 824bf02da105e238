"""Derived test views over the driver tables (FIXTURES.md section B).

The reference reads scraped CSVs, URL pickles and sheets that are not shipped.
These views derive equivalent inputs from the given tables with plain
DataFrame expressions, so that every query's work grows with the tables.
The DuckDB twins of these views live in ``oracle/views.py``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path, table

COUNTRIES = ["ger", "usa", "uk", "ind"]           # index = key % 4
ELITE_VALUES = ["Elite", " yes ", "1", "1.0", "no", None]
TYPE_VALUES = ["Private ", "kirchlich", "public", None]
STRICT_KEYWORDS = ["this", "sich", "para", "dans"]
COMPOUND_KEYWORDS = ["tion", "keit", "ment", "lich"]
SUFFIX_RULES = ["com", "net", "org", "uk", "co.uk", "ac.uk", "example.com",
                "example.net", "example.org", "*.ck", "!www.ck", "рф"]
SAMPLE_SEED = 161161

# Layouts of the fact sheets.  Each country has its own order and own further
# columns, and one lacks a column, so that renames and the union have work to do.
FACT_COLUMNS = {
    "ger": ["name", "url", "founding_year", "student_size_n", "international_per", "elite", "type",
            "nation"],
    "usa": ["nation", "url", "name", "elite", "type", "phone", "founding_year", "international_per",
            "student_size_n"],
    "uk": ["type", "elite", "name", "url", "student_size_n", "international_per", "founding_year"],
    "ind": ["name", "url", "elite", "type", "phone", "student_size_n", "founding_year"],
}


def _pick(values, idx):
    """Element of a small Python list chosen by an integer column."""
    expr = None
    for i, v in enumerate(values):
        lit = F.lit(v).cast("string")
        expr = F.when(idx == i, lit) if expr is None else expr.when(idx == i, lit)
    return expr


def responses(spark: SparkSession, sf: str) -> DataFrame:
    """pages + HTTP status, content type, final URL and country code.  Five of six
    pages end in nested or unclosed elements and odd character references."""
    p = table(spark, sf, "pages")
    pid, url = F.col("page_id"), F.col("url")

    def again(text: str):
        return F.lit(text * 20)

    ends = (F.when(pid % 6 == 1, F.concat(F.lit('<h2>Rooms &comma; halls<div>and &#150; more</div>1 < 2</h2><p title="a > b">'),
                                          F.col("html"), F.lit("</p>")))
            .when(pid % 6 == 2, F.concat(F.lit("<ul><li><h3>Fees&nbsp; &auml;nd &#0000000228;<li><h3>x</h3><p>"), url,
                                         again(" word&notit;"), F.lit("</ul>after")))
            .when(pid % 6 == 3, F.concat(F.lit("<table><tr><td><p>"), again("cell &auml "), F.lit("<td><h1>"), url,
                                         F.lit("<tr><td></div>"), again("&#x92 more "), F.lit("</table>")))
            .when(pid % 6 == 4, F.concat(F.lit("<h1><p>"), again("both kept "), F.lit('</p></h1><script>var p = "<p>'), url))
            .otherwise(""))
    return p.select(
        "page_id", "url", F.concat("html", ends).alias("html"),
        F.when(pid % 17 == 0, 404).when(pid % 23 == 0, 500).otherwise(200).alias("status"),
        F.when(pid % 19 == 0, "application/pdf").otherwise("text/html").alias("content_type"),
        F.when(pid % 10 == 0,
               F.concat(F.lit("https://www.campus"), (pid % 3).cast("string"),
                        F.lit(".co.uk/"), pid.cast("string")))
        .when(pid % 10 == 5,
              F.concat(F.lit("http://me:p@ss@www.uni"), (pid % 3).cast("string"), F.lit("\u3002xn--p1ai/"), pid.cast("string")))
        .otherwise(F.col("url")).alias("final_url"),
        F.regexp_extract("url", "/(en|de|fr|es)/", 1).alias("country"))


def urls(spark: SparkSession, sf: str) -> DataFrame:
    """The URL list: every page URL, plus every fifth page's URL again."""
    p = table(spark, sf, "pages").select(
        "page_id", "url", F.regexp_extract("url", "/(en|de|fr|es)/", 1).alias("country"))
    return (p.select("url", "country")
            .unionByName(p.filter(F.col("page_id") % 5 == 0).select("url", "country")))


def done_urls(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").filter(F.col("page_id") % 4 == 0).select("url")


def docs(spark: SparkSession, sf: str) -> DataFrame:
    """documents as scraped text elements of four countries (whole texts)."""
    d = table(spark, sf, "documents")
    did = F.col("doc_id")
    pos = ((did / 20).cast("bigint") % 10).cast("int")
    tag = F.when(pos == 0, "title").when(pos % 3 == 1, "h2").otherwise("p")
    host = F.concat(F.col("source"), F.lit(".example.org"))
    text = F.concat(
        F.when(did % 7 == 0, F.lit("\u00a0\u00a0 \u00a0")).otherwise(F.lit("")),
        F.when(did % 29 == 0, F.lit("Cookies ")).otherwise(F.lit("")),
        F.when((did % 31 == 0) & (pos == 0), F.lit("No title ")).otherwise(F.lit("")),
        F.col("text"))
    return (d.select(
        "doc_id",
        _pick(COUNTRIES, did % 4).alias("country"),
        F.concat(F.lit("http://"), host, F.lit("/"), (did / 200).cast("bigint").cast("string")).alias("url"),
        F.lit(None).cast("string").alias("url_redirect"),
        pos.alias("pos"), tag.alias("tag"), text.alias("text"), "lang")
        .withColumn("text_length", F.length("text")))


#: Readings of two UTF-8 bytes in the code pages of the repair; the last one twice.
def code_page_readings(letter: str) -> list[str]:
    data = letter.encode()
    return [data.decode("cp1252"), *[data.decode(p) for p in ("mac_roman", "cp1250", "cp1251", "cp437")],
            data.decode("cp1252").encode().decode("cp1252")]


MISREAD_LETTERS = "äöüßéèçñ"


def misread_by_code_page(spark: SparkSession, sf: str) -> DataFrame:
    """Documents whose umlauts and accents behind small letters were read in one of
    six ways."""
    d = table(spark, sf, "documents").select("doc_id", "text")
    text = F.col("text")
    for letter in MISREAD_LETTERS:
        by_doc = _pick(code_page_readings(letter), F.col("doc_id") % 6)
        text = F.regexp_replace(text, F.lit(f"([a-z]){letter}"), F.concat(F.lit("$1"), by_doc))
    return d.withColumn("text", text)


def misread(t, style: str = "dictionary"):
    """Umlauts as UTF-8 bytes read as one-byte characters; ``ß`` in the cp1252
    (dictionary) or Latin-1 reading."""
    sz = "ÃŸ" if style == "dictionary" else "Ã\u009f"
    for good, bad in [("ä", "Ã¤"), ("ö", "Ã¶"), ("ü", "Ã¼"), ("ß", sz)]:
        t = F.replace(t, F.lit(good), F.lit(bad))
    return t


def mojibake(spark: SparkSession, sf: str, style: str = "dictionary") -> DataFrame:
    """Every document as it would be stored misread."""
    d = table(spark, sf, "documents")
    return d.select("doc_id", misread(F.col("text"), style).alias("text"))


def scores(spark: SparkSession, sf: str) -> DataFrame:
    """Four (token, logprob) candidates per document, as a model would return."""
    d = table(spark, sf, "documents").select("doc_id")
    k = F.col("k")
    tok = ((F.col("doc_id") + k) % 5)
    return (d.select("doc_id", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("k"))
            .select("doc_id",
                    F.when(tok == 0, F.lit("x")).otherwise(tok.cast("string")).alias("token"),
                    (-((F.col("doc_id") * 7 + k * 13) % 97) / 50.0 - k / 1000.0).alias("logprob")))


def hand_coded(spark: SparkSession, sf: str) -> DataFrame:
    """The labelled documents as hand-coded texts: a concept code per text."""
    lab, d = table(spark, sf, "labels"), table(spark, sf, "documents")
    code = F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 1, 1).otherwise(3)
    return (d.join(lab.select("doc_id", code.alias("code")), "doc_id")
            .select("doc_id", study_language(F.col("lang")).alias("language"), "text", "code"))


def study_language(lang):
    return F.when(lang == "en", "eng").when(lang == "de", "ger").otherwise(lang)


def keyword_files(spark: SparkSession, sf: str) -> tuple[str, str]:
    """Two line lists of hundreds of keywords: the words of the benchmark texts with
    6 to 8 letters (strict) and with 9 or more (compound)."""
    words = (table(spark, sf, "benchmark")
             .select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("value")).distinct())
    paths = scratch_path(spark, "strict"), scratch_path(spark, "compound")
    for path, lengths in zip(paths, ((6, 8), (9, 99))):
        words.filter(F.length("value").between(*lengths)).coalesce(1).sort("value").write.text(path)
    return paths


def facts_sheet(spark: SparkSession, sf: str, country: str) -> DataFrame:
    """Supplier rows of one country as a sheet with positional, unnamed columns."""
    i = COUNTRIES.index(country)
    s = table(spark, sf, "supplier").filter(F.col("s_suppkey") % 4 == i)
    k = F.col("s_suppkey")
    sel = (k / 4).cast("bigint")
    cols = {
        "name": F.col("s_name"),
        "url": F.concat(F.lit("http://src"), (k % 20).cast("string"), F.lit(".example.org/")),
        "elite": _pick(ELITE_VALUES, sel % 6),
        "type": _pick(TYPE_VALUES, sel % 4),
        "founding_year": (k + 1900).cast("bigint"),
        "student_size_n": F.floor("s_acctbal").cast("double"),
        "international_per": F.when(k % 9 == 0, F.lit(None)).otherwise(F.col("s_acctbal") / 100),
        "nation": F.concat(F.lit("r"), F.col("s_nationkey").cast("string")),
        "phone": F.concat(F.lit("0"), k.cast("string")),
    }
    return s.select(*[cols[c].alias(f"column_{j + 1}") for j, c in enumerate(FACT_COLUMNS[country])])


def ratings(spark: SparkSession, sf: str) -> DataFrame:
    """Three raters' codes (1..4) per labelled document."""
    lab = table(spark, sf, "labels")
    doc = table(spark, sf, "documents").select("doc_id", "n_chars", "source", "lang")
    j = lab.join(doc, "doc_id")
    did = F.col("doc_id")
    return j.select(
        "doc_id",
        (F.col("quality") + 1).cast("bigint").alias("llm"),
        (F.col("toxic") + 1).cast("bigint").alias("coder_a"),
        F.when(did % 13 == 0, F.lit(None))
        .when(F.col("n_chars") > 2000, F.lit(4))
        .otherwise(did % 3 + 1).cast("bigint").alias("coder_b"),
        F.concat(F.lit("http://"), F.col("source"), F.lit(".example.org/"),
                 (did / 200).cast("bigint").cast("string")).alias("url"),
        F.col("lang").alias("country"))


def report_input(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    k = F.col("c_custkey")
    return c.select(
        F.col("c_mktsegment").alias("country"),
        F.when(k % 11 == 0, F.lit(None)).when(k % 13 == 0, F.lit(0.0))
        .otherwise(F.col("c_acctbal")).alias("number"),
        (F.col("c_nationkey") % 2 == 0).alias("flag"))


def suffix_rules(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(F.explode(F.array(*[F.lit(r) for r in SUFFIX_RULES])).alias("rule"))


def keyword_lists():
    return list(STRICT_KEYWORDS), list(COMPOUND_KEYWORDS)
