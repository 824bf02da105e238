"""Named queries over the driver tables (bound by ``__spark_entry__``).

Each query takes ``(spark, sf_dir)`` and returns a DataFrame; it reads the
given tables (through the derived views of :mod:`fixtures`) and composes the
library's operators with ``DataFrame.transform``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import crawl, extract
from . import fixtures as FX

QUERIES: dict = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


# ---- shared derived inputs -------------------------------------------------

def routed(spark: SparkSession, sf: str) -> DataFrame:
    return FX.responses(spark, sf).transform(crawl.route_responses)


def elements(spark: SparkSession, sf: str) -> DataFrame:
    """Text elements of every good response (v_elements)."""
    good = crawl.good_responses(routed(spark, sf)).select(
        "page_id", "url", "url_redirect", "country", "html")
    return good.transform(extract.extract_elements).drop("page_id")


# ---- extraction --------------------------------------------------------------

def _page_elements(spark, sf, dedupe, collapse):
    good = crawl.good_responses(routed(spark, sf)).select("page_id", "url", "html")
    return (extract.extract_elements(good, dedupe=dedupe, collapse=collapse)
            .select("page_id", "url", "pos", "tag", "text", "text_length"))


@query
def extract_elements(spark, sf):
    return _page_elements(spark, sf, False, False)


@query
def dedupe_elements(spark, sf):
    return _page_elements(spark, sf, True, False)


@query
def collapse_headings(spark, sf):
    return _page_elements(spark, sf, True, True)


@query
def page_titles(spark, sf):
    return (extract.page_titles(FX.responses(spark, sf))
            .select("page_id", "url", F.col("title").alias("text")))


@query
def route_responses(spark, sf):
    return routed(spark, sf).select("page_id", "url", "country", "url_redirect", "error")


# ---- corpus cleaning (E1) --------------------------------------------------------

from ..operators import clean, domains, keywords  # noqa: E402


def rules(spark, sf):
    return FX.suffix_rules(spark)


def corpus(spark: SparkSession, sf: str, source=None) -> DataFrame:
    src = FX.docs(spark, sf) if source is None else source
    return clean.clean_corpus(src, rules(spark, sf))


@query
def filter_boilerplate(spark, sf):
    return clean.filter_boilerplate(FX.docs(spark, sf)).select("doc_id", "url", "pos", "text")


@query
def normalise_text(spark, sf):
    return clean.normalise_text(FX.docs(spark, sf)).select("doc_id", "text")


@query
def word_count(spark, sf):
    return (FX.docs(spark, sf).transform(clean.normalise_text).transform(clean.add_word_count)
            .select("doc_id", "text_words"))


@query
def registered_domain(spark, sf):
    r = FX.responses(spark, sf).select("page_id", "url", "final_url")
    r = domains.registered_domain(r, rules(spark, sf), "url", "domain_url")
    r = domains.registered_domain(r, rules(spark, sf), "final_url", "domain_final")
    r = domains.registered_domain(r, rules(spark, sf), "url", "domain",
                                  redirect_col="final_url")
    return r.select("page_id", "domain_url", "domain_final", "domain")


@query
def element_order(spark, sf):
    return (FX.docs(spark, sf).transform(clean.filter_boilerplate)
            .transform(clean.add_element_order).select("doc_id", "url", "order"))


@query
def dedupe_domain_text(spark, sf):
    return (FX.docs(spark, sf).transform(clean.filter_boilerplate).transform(clean.normalise_text)
            .transform(lambda d: clean.add_domain(d, rules(spark, sf)))
            .transform(clean.add_element_order).transform(clean.dedupe_domain_text)
            .select("doc_id", "country", "domain", "url", "order", "text"))


CORPUS_COLS = ["doc_id", "country", "domain", "url", "url_redirect", "order", "pos", "tag",
               "text", "text_length", "text_words"]


@query
def clean_corpus(spark, sf):
    return corpus(spark, sf).select(*CORPUS_COLS)


@query
def corpus_summary(spark, sf):
    return clean.corpus_summary(corpus(spark, sf))


# ---- keyword filter (E2) -------------------------------------------------------------

def hits(spark, sf, source=None, corp=None):
    strict, compound = FX.keyword_lists()
    c = corpus(spark, sf, source) if corp is None else corp
    return keywords.keyword_hits(c, strict, compound)


def merged(spark, sf, source=None, corp=None):
    return keywords.heading_merge(hits(spark, sf, source, corp))


ROWS_PER_FILE = 4096             # of a written table whose readers work long on each row


def filtered(spark, sf, source=None, corp=None, carry=()):
    return keywords.keyword_filter(merged(spark, sf, source, corp), carry)


@query
def keyword_hits(spark, sf):
    return hits(spark, sf).select("url", "order", "text",
                                  F.array_join("keywords", ", ").alias("keywords"))


@query
def heading_merge(spark, sf):
    return merged(spark, sf).select(
        "url", "order", "text", F.array_join("keywords", ", ").alias("keywords"),
        "is_heading", "merge_following", "remove_following")


@query
def keyword_filter(spark, sf):
    return filtered(spark, sf)


@query
def keyword_file_hits(spark, sf):
    """Keyword lists of hundreds of entries, read from line lists, found in the corpus."""
    strict, compound = (files.read_keywords(spark, p) for p in FX.keyword_files(spark, sf))
    return (keywords.keyword_hits(corpus(spark, sf), strict, compound)
            .select("url", "order", F.array_join("keywords", ", ").alias("keywords")))


@query
def keyword_review_buckets(spark, sf):
    m = merged(spark, sf).select(F.array_join("keywords", ", ").alias("keywords"),
                                 "text", "country", "domain", "url")
    return keywords.review_buckets(m.filter(F.col("keywords") != ""))


@query
def keyword_review_files(spark, sf):
    """One output folder per review condition, written and read again."""
    path = scratch_path(spark, "review")
    files.write_csv(keyword_review_buckets(spark, sf), path, partition_by=["bucket"])
    return files.read_csv(spark, path, "keywords STRING, text STRING, country STRING, domain STRING, url STRING, bucket STRING")


@query
def keyword_hits_by_domain(spark, sf):
    """Flagship: stored pages -> elements -> clean corpus -> keyword filter ->
    rows and URLs per (country, domain)."""
    f = filtered(spark, sf, elements(spark, sf))
    return (f.groupBy("country", "domain")
            .agg(F.count(F.lit(1)).alias("texts"), F.countDistinct("url").alias("urls")))


# ---- crawl bookkeeping ---------------------------------------------------------------------

from ..functions import repair  # noqa: E402
from ..operators import (agreement, classes, classify, coverage, facts, language, report,  # noqa: E402
                         sampling, scores)
from ..session import scratch_path  # noqa: E402
from ..sources import files  # noqa: E402
from ..streaming import crawl as crawl_stream  # noqa: E402

SAMPLE_URLS = 50          # size of the URL sample (the feature is a limit)
SAMPLE_PER_COUNTRY = 20   # gold-standard rows per country in the tests


@query
def url_worklist(spark, sf):
    return crawl.url_worklist(FX.urls(spark, sf))


@query
def resume_pending(spark, sf):
    return crawl.resume_pending(crawl.url_worklist(FX.urls(spark, sf)), FX.done_urls(spark, sf))


@query
def sample_urls(spark, sf):
    return crawl.sample_urls(crawl.url_worklist(FX.urls(spark, sf)), SAMPLE_URLS, FX.SAMPLE_SEED)


@query
def resume_append(spark, sf):
    """Two resumable runs over landing response files: first the URLs that
    were already done, then all; every URL is stored exactly once."""
    resp = FX.responses(spark, sf).select("url", "status", "content_type", "final_url", "html")
    landing, good, bad, seen, ckpt = (scratch_path(spark, n) for n in ("landing", "good", "bad", "seen", "ckpt"))
    done = FX.done_urls(spark, sf)
    resp.join(done, "url", "left_semi").write.mode("append").parquet(landing)
    crawl_stream.run_once(spark, landing, resp.schema, good, bad, seen, ckpt)
    resp.write.mode("append").parquet(landing)
    crawl_stream.run_once(spark, landing, resp.schema, good, bad, seen, ckpt)
    return crawl_stream.stored_results(spark, good, bad)


# ---- sources -------------------------------------------------------------------------------

DOC_SCHEMA = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT"


@query
def csv_roundtrip(spark, sf):
    """Null, empty and other texts."""
    path = scratch_path(spark, "csv")
    text = F.when(F.col("doc_id") % 50 == 0, None).when(F.col("doc_id") % 50 == 1, "").otherwise(F.col("text"))
    files.write_csv(FX.table(spark, sf, "documents").withColumn("text", text), path)
    return files.read_csv(spark, path, DOC_SCHEMA)


CORPUS_ORDER = ["country", "domain", "url", "order"]
CORPUS_SCHEMA = ("doc_id BIGINT, country STRING, domain STRING, url STRING, url_redirect STRING, "
                 "`order` BIGINT, pos INT, tag STRING, text STRING, text_length INT, text_words BIGINT")


@query
def corpus_sink(spark, sf):
    """The clean corpus in its output order as ``;`` CSV, a folder per country,
    read back with empty text as missing."""
    path = scratch_path(spark, "corpus_csv")
    files.write_csv(corpus(spark, sf).select(*CORPUS_COLS), path, sep=";",
                    sort_by=CORPUS_ORDER, partition_by=["country"])
    return files.read_csv(spark, path, CORPUS_SCHEMA, sep=";", empty_is_missing=True).select(*CORPUS_COLS)


@query
def keyword_list(spark, sf):
    """Line lists: every document written as text lines and read back as a
    list (stripped, blanks dropped)."""
    path = scratch_path(spark, "lines")
    FX.table(spark, sf, "documents").select("text").write.text(path)
    return files.read_line_list(spark, path)


@query
def union_countries(spark, sf):
    d = FX.docs(spark, sf).drop("country")
    long_names = {"ger": "germany", "usa": "usa", "uk": "uk", "ind": "india"}
    parts = {long_names[c]: d.filter(F.col("doc_id") % 4 == i) for i, c in enumerate(FX.COUNTRIES)}
    out = files.union_countries(parts)
    return files.relabel(out, coverage.COUNTRY_CODES, "country").select("doc_id", "country")


@query
def repair_dictionary(spark, sf):
    m = FX.mojibake(spark, sf, "dictionary")
    return m.select("doc_id", repair.dictionary_repair(F.col("text")).alias("text"))


@query
def repair_latin1(spark, sf):
    m = FX.mojibake(spark, sf, "latin1")
    return m.select("doc_id", repair.fix_encoding(F.col("text")).alias("text"))


@query
def repair_code_pages(spark, sf):
    """Texts misread in six ways, two layers among them, read again."""
    m = FX.misread_by_code_page(spark, sf)
    return m.select("doc_id", repair.fix_encoding(F.col("text")).alias("text"))


def repaired(df: DataFrame) -> DataFrame:
    """The repair stage: only the German sources were stored misread."""
    text = F.when(F.col("country") == "ger", repair.repair_text(F.col("text"))).otherwise(F.col("text"))
    # a generator, so that no filter on the text is moved below with a repair of its own
    return df.withColumn("text", F.explode_outer(F.array(text)))


@query
def repair_text(spark, sf):
    """All scraped elements, misread in the German sources, repaired."""
    d = FX.docs(spark, sf)
    misread = F.when(F.col("country") == "ger", FX.misread(F.col("text"), "dictionary"))
    return (d.withColumn("text", misread.otherwise(F.col("text"))).transform(repaired)
            .select("doc_id", "country", "text"))


# ---- language + scores ----------------------------------------------------------------------

def profile_table(spark, sf):
    """Trigram counts per language over every labelled document, trained once and
    stored, and its languages (the values of a code column: a handful of rows)."""
    d = FX.table(spark, sf, "documents").select("text", "lang")
    prof = files.stored_model(spark, language.language_profiles, d, "profiles")
    langs = sorted(r[0] for r in prof.select("lang").distinct().collect())
    return prof, langs


@query
def language_profiles(spark, sf):
    return language.language_profiles(FX.table(spark, sf, "documents"))


def detected(spark, sf):
    d = FX.table(spark, sf, "documents").select("doc_id", "text", "lang")
    return language.detect_language(d, *profile_table(spark, sf))


@query
def detect_language(spark, sf):
    return detected(spark, sf).select("doc_id", "lang", "detected", "language")


@query
def language_accuracy(spark, sf):
    """Detection of a third of the documents with profiles of the other two."""
    d = FX.table(spark, sf, "documents").select("doc_id", "text", "lang")
    out = classify.held_out(F.col("doc_id"))
    prof = files.stored_model(spark, language.language_profiles, d.filter(~out), "profiles")
    langs = sorted(r[0] for r in prof.select("lang").distinct().collect())
    found = language.detect_language(d.filter(out), prof, langs)
    return (found.groupBy("lang").agg(F.count(F.lit(1)).alias("texts"),
                                      F.count_if(F.col("detected") == F.col("lang")).alias("right"),
                                      F.count_if(F.col("detected").isNull()).alias("undecided")))


@query
def filter_language(spark, sf):
    return language.filter_language(detected(spark, sf)).select("doc_id", "language")


def _top(spark, sf):
    return scores.topk_scores(FX.scores(spark, sf))


@query
def topk_scores(spark, sf):
    return _top(spark, sf).select("doc_id", "rank", "token", "logprob")


@query
def decode_tokens(spark, sf):
    return scores.decode_tokens(_top(spark, sf)).select("doc_id", "rank", "label", "linprob")


@query
def row_index_by(spark, sf):
    """Hashed keys, many of them tied."""
    d = FX.table(spark, sf, "documents").select("doc_id", "lang", F.substring(F.md5("source"), 1, 2).alias("key"))
    return scores.row_index_by(d, "lang", ["key", "doc_id"])


@query
def row_index(spark, sf):
    d = FX.table(spark, sf, "documents").select("doc_id", "lang")
    return scores.row_index(d, "lang", "doc_id", bucket_width=64)


def wide(spark, sf):
    return scores.scores_wide(scores.decode_tokens(_top(spark, sf)))


@query
def scores_wide(spark, sf):
    return wide(spark, sf)


# ---- the chain: each step reads what the one before kept ---------------------------------------

def chain_corpus(spark, sf):
    """Repaired, then cleaned elements, written once: the keyword filter and
    everything behind it read them back."""
    return files.materialise(spark, corpus(spark, sf, FX.docs(spark, sf).transform(repaired)), "corpus")


def study_rows(spark, sf, source=None, corp=None, carry=()):
    """Rows that pass the keyword filter and are in a study language."""
    rows = filtered(spark, sf, source, corp, (*carry, "order"))
    # written once, each row with a number of its own, in files that give even tasks
    rows = files.materialise(spark, rows.withColumn("_row", F.monotonically_increasing_id()), "filtered", ROWS_PER_FILE)
    found = language.detect_in_blocks(rows, *profile_table(spark, sf), key="_row")
    return language.filter_language(found).drop("detected", "_row")


def study_table(spark, sf):
    return files.materialise(spark, study_rows(spark, sf, corp=chain_corpus(spark, sf), carry=("doc_id",)),
                             "study")


@query
def study_texts(spark, sf):
    """Repair, cleaning, keyword filter and language filter, composed."""
    return (study_rows(spark, sf, corp=chain_corpus(spark, sf), carry=("doc_id",))
            .select("doc_id", "country", "domain", "url", "order", "keywords", "language", "text"))


# ---- classification: a model per language from the hand-coded rows ------------------------------

def word_models(spark, sf, coded=None):
    coded = FX.hand_coded(spark, sf) if coded is None else coded
    return tuple(files.stored_model(spark, train, coded, "class-model") for train in (classify.word_model, classify.priors))


@query
def class_scores(spark, sf):
    """Probabilities of the classes for every document."""
    d = FX.table(spark, sf, "documents").select("doc_id", FX.study_language(F.col("lang")).alias("language"), "text")
    s = classify.class_scores(d, *word_models(spark, sf), ["doc_id"])
    return s.select("doc_id", "token", (F.round("logprob", 4) + 0.0).alias("logprob"))


@query
def class_accuracy(spark, sf):
    """Classes of a third of the hand-coded texts by models of the other two."""
    coded, out = FX.hand_coded(spark, sf), classify.held_out(F.col("doc_id"))
    test = coded.filter(out)
    s = classify.class_scores(test, *word_models(spark, sf, coded.filter(~out)), ["doc_id"])
    best = scores.topk_scores(s, k=1).select("doc_id", F.col("token").cast("int").alias("found"))
    return (test.join(best, "doc_id").groupBy("language")
            .agg(F.count(F.lit(1)).alias("texts"), F.count_if(F.col("found") == F.col("code")).alias("right")))


# ---- classes --------------------------------------------------------------------------------

def scored(spark, sf, study=None):
    """Study rows with the classes that the models of their languages give them."""
    rows = (study_table(spark, sf) if study is None else study)
    s = classify.class_scores(rows, *word_models(spark, sf), ["doc_id"])
    wide = scores.scores_wide(scores.decode_tokens(scores.topk_scores(s)))
    return classes.attach_scores(rows.select("doc_id", "language", "country", "domain", "url", "text"), wide)


@query
def attach_scores(spark, sf):
    return scored(spark, sf).select("doc_id", "language", "country", "domain", "token_1", "linprob_1")


@query
def domain_class_counts(spark, sf):
    return classes.domain_class_counts(scored(spark, sf))


def class_table(spark, sf, study=None):
    props = classes.domain_proportions(classes.domain_class_pivot(scored(spark, sf, study)))
    return props.withColumn("ind_coll_prop", F.round("ind_coll_prop", 6))


@query
def domain_class_pivot(spark, sf):
    return classes.domain_class_pivot(scored(spark, sf))


@query
def domain_proportions(spark, sf):
    return class_table(spark, sf)


# ---- facts ----------------------------------------------------------------------------------

def sheets(spark, sf):
    return {c: FX.facts_sheet(spark, sf, c) for c in FX.COUNTRIES}


@query
def union_by_name_missing(spark, sf):
    return facts.union_sheets(sheets(spark, sf), FX.FACT_COLUMNS)


@query
def normalise_flags(spark, sf):
    u = facts.union_sheets(sheets(spark, sf), FX.FACT_COLUMNS)
    return (facts.normalise_flags(u, rules(spark, sf))
            .select("country", "name", "url", "domain", "elite", "private", "old", "student_size_n"))


def fact_table(spark, sf):
    return facts.prepare_facts(sheets(spark, sf), FX.FACT_COLUMNS, rules(spark, sf))


@query
def median_flags(spark, sf):
    return fact_table(spark, sf)


@query
def rank_tiers(spark, sf):
    """Optional tiers; the rank text is derived from the number in the domain."""
    f = fact_table(spark, sf)
    n = F.col("_n")
    bands = F.array(*[F.lit(b) for b in facts.RANK_BANDS])
    ranks = (f.select("country", "domain").distinct()
             .withColumn("_n", F.regexp_extract("domain", "[0-9]+", 0).try_cast("int"))
             .withColumn("global_rank", F.when(n % 3 == 0, (n * 10 + 5).cast("string"))
                         .when(n % 3 == 1, F.element_at(bands, n % 6 + 1))
                         .otherwise(F.lit("n/a"))).drop("_n"))
    return facts.rank_tiers(f, ranks, facts.RANK_BANDS).select("country", "name", "domain", "global_rank", "rank")


# ---- coverage (E3) ----------------------------------------------------------------------------

def rounded(df: DataFrame, cols: list[str], digits: int = 6) -> DataFrame:
    """Round floating results for comparison with the SQL oracle."""
    return df.withColumns({c: F.round(c, digits) for c in cols})


MEANS = ["texts_all_mean_per_url", "texts_filtered_mean_per_url"]

@query
def url_coverage(spark, sf):
    errs = crawl.error_rows(routed(spark, sf))
    els = files.materialise(spark, elements(spark, sf), "elements")
    return coverage.url_coverage(FX.urls(spark, sf), els, errs, study_rows(spark, sf, els),
                                 rules(spark, sf))


@query
def domain_coverage(spark, sf):
    return rounded(coverage.domain_coverage(url_coverage(spark, sf)), MEANS)


def doc_coverage(spark, sf, study):
    d = FX.docs(spark, sf)
    urls = d.select("url", "country").distinct()
    errs = crawl.error_rows(routed(spark, sf))
    cov = coverage.url_coverage(urls, d, errs, study, rules(spark, sf))
    return rounded(coverage.domain_coverage(cov), MEANS)


def classified(spark, sf):
    study = study_table(spark, sf)
    return coverage.coverage_classes(doc_coverage(spark, sf, study), class_table(spark, sf, study))


@query
def coverage_classes(spark, sf):
    return classified(spark, sf)


def analysis(spark, sf):
    return coverage.analysis_table(classified(spark, sf), fact_table(spark, sf))


@query
def analysis_table(spark, sf):
    return analysis(spark, sf)


# ---- quality + report -----------------------------------------------------------------------------

@query
def stratified_sample(spark, sf):
    """Rows for hand coding, drawn from what the keyword filter keeps."""
    c = filtered(spark, sf, carry=("doc_id",)).select("doc_id", "country", "text", "keywords", "domain", "url")
    return (sampling.stratified_sample(c, "country", "doc_id", SAMPLE_PER_COUNTRY, FX.SAMPLE_SEED)
            .withColumn("concept", F.lit("")))


RATERS, CODERS = ["llm", "coder_a", "coder_b"], ["coder_a", "coder_b"]


def ratings(spark, sf):
    return agreement.ratings_table(FX.ratings(spark, sf), CODERS, RATERS)


@query
def ratings_table(spark, sf):
    return ratings(spark, sf).select("doc_id", *RATERS, "url", "country")


@query
def rater_match_flags(spark, sf):
    return agreement.match_flags(ratings(spark, sf), RATERS).drop("url", "country")


@query
def rater_agreement(spark, sf):
    out = agreement.agreement(ratings(spark, sf), RATERS)
    return out.withColumn("match_pct", F.round("match_pct", 6))


@query
def pair_counts(spark, sf):
    return agreement.pair_counts(ratings(spark, sf), RATERS)


@query
def pair_counts_sink(spark, sf):
    """The sorted pair counts as written and read again, with the number of each row."""
    path = scratch_path(spark, "pair-counts")
    files.write_csv(agreement.sorted_pair_counts(ratings(spark, sf), RATERS).withColumn(
        "row", F.row_number().over(Window.partitionBy("rater_1", "rater_2").orderBy(F.desc("count"), "value_1", "value_2"))),
        path, sort_by=["rater_1", "rater_2", "row"])
    return files.read_csv(spark, path, "rater_1 STRING, rater_2 STRING, value_1 STRING, value_2 STRING, `count` BIGINT, `row` INT")


@query
def country_report(spark, sf):
    r = FX.report_input(spark, sf).withColumn("country_name", report.relabel_country(F.col("country")))
    r = report.as_numeric(r, ["number"])
    r = report.null_if(r, ["number"], 0.0)
    return report.country_report(r, ["number"], ["flag"])


# variables of the descriptive table, as they are listed in it
REPORT_NUMBERS = ["urls_all_count", "texts_all_total", "urls_filtered_count", "texts_filtered_total",
                  "student_size_n", "international_per", classes.COLLECTIVE, classes.INDIVIDUAL,
                  "ind_coll_prop"]
REPORT_FLAGS = ["elite", "private", "old"]


@query
def analysis_report(spark, sf):
    """The descriptive table of the whole chain's result, by country and in total."""
    r = analysis(spark, sf).withColumn("country_name", report.relabel_country(F.col("country")))
    r = report.as_numeric(r, REPORT_NUMBERS)
    r = report.null_if(r, ["urls_filtered_count", "texts_filtered_total"], 0.0)
    return report.country_report(r, REPORT_NUMBERS, REPORT_FLAGS)
