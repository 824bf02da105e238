"""DuckDB oracle SQL, one statement per registered query."""

from __future__ import annotations

from .views import with_views, elements_sql

SQL: dict[str, str] = {}


def oracle(name: str, views: list[str], body: str) -> None:
    SQL[name] = with_views(views, body)


def _page_elements(dedupe, collapse):
    src = "(SELECT page_id, url, html FROM v_routed WHERE error IS NULL)"
    return (f"SELECT page_id, url, pos, tag, text, CAST(length(text) AS INTEGER) AS text_length "
            f"FROM {elements_sql(src, dedupe, collapse)}")


oracle("extract_elements", ["v_routed"], _page_elements(False, False))
oracle("dedupe_elements", ["v_routed"], _page_elements(True, False))
oracle("collapse_headings", ["v_routed"], _page_elements(True, True))
oracle("page_titles", ["v_responses"], f"""
    SELECT page_id, url, text FROM {elements_sql('(SELECT page_id, url, html FROM v_responses)', False, False)}
    WHERE pos = 0""")
oracle("route_responses", ["v_routed"], "SELECT page_id, url, country, url_redirect, error FROM v_routed")


# ---- domains --------------------------------------------------------------------------

from webtext.plans import fixtures as FX  # noqa: E402
from .views import q, collapse_ws  # noqa: E402

SLASHED = r"^\s*(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#]*@)?(\[[^\]]*\]|[^/?#:]*)"
BARE = r"^\s*(?:[^/?#@\s]*@)?(\[[^\]]*\]|[^/?#:\s]*)(?:[/?#:]|\s*$)"


def host_sql(u: str) -> str:
    found = f"CASE WHEN regexp_matches({u}, {q(SLASHED)}) THEN regexp_extract({u}, {q(SLASHED)}, 1) ELSE regexp_extract({u}, {q(BARE)}, 1) END"
    return f"nullif(lower(regexp_replace(regexp_replace(trim({found}), '[.。．｡]', '.', 'g'), '[.]+$', '')), '')"


def unicode_sql(x: str) -> str:
    """The Punycode labels of the test pages."""
    return f"replace({x}, 'xn--p1ai', 'рф')"


def rules_sql() -> str:
    vals = ", ".join(f"({q(r)})" for r in FX.SUFFIX_RULES)
    return f"""(SELECT DISTINCT
        CASE WHEN starts_with(r, '*.') THEN substr(r, 3) WHEN starts_with(r, '!') THEN substr(r, 2) ELSE r END AS key,
        CASE WHEN starts_with(r, '*.') THEN 1 WHEN starts_with(r, '!') THEN 2 ELSE 0 END AS kind
        FROM (SELECT lower(trim(r)) AS r FROM (VALUES {vals}) t(r)))"""


def host_domains_sql(hosts: str) -> str:
    """hosts(host) -> (host, domain); 1-based label positions."""
    return f"""(WITH h AS (SELECT DISTINCT host FROM {hosts} WHERE host IS NOT NULL),
      c AS (SELECT host, labels, i, {unicode_sql("array_to_string(labels[i:], '.')")} AS cand,
                   CASE WHEN i < len(labels) THEN {unicode_sql("array_to_string(labels[i + 1:], '.')")} END AS parent
            FROM (SELECT host, string_split(host, '.') AS labels,
                         unnest(range(1, len(string_split(host, '.')) + 1)) AS i FROM h)),
      r AS {rules_sql()},
      m AS (SELECT host, labels, kind, CASE WHEN kind = 2 THEN i + 1 ELSE i END AS start
            FROM c JOIN r ON c.cand = r.key AND r.kind IN (0, 2)
            UNION ALL
            SELECT host, labels, kind, i AS start FROM c JOIN r ON c.parent = r.key AND r.kind = 1),
      b AS (SELECT host, arg_min(start, (kind <> 2, start)) AS start, any_value(labels) AS labels
            FROM m GROUP BY host)
      SELECT h.host,
             CASE WHEN b.host IS NULL THEN string_split(h.host, '.')[-1] || '.'
                  WHEN b.start = 1 THEN '.' || h.host
                  ELSE b.labels[b.start - 1] || '.' || array_to_string(b.labels[b.start:], '.') END AS domain
      FROM h LEFT JOIN b ON h.host = b.host)"""


def with_domain_sql(src: str, url_expr: str, out: str) -> str:
    """Add column ``out`` = registrable domain of ``url_expr`` to ``src``."""
    return f"""(WITH s AS (SELECT *, {host_sql(url_expr)} AS _host FROM {src})
      SELECT s.* EXCLUDE (_host), d.domain AS {out}
      FROM s LEFT JOIN {host_domains_sql('(SELECT _host AS host FROM s)')} d ON s._host = d.host)"""


oracle("registered_domain", ["v_responses"], f"""
    SELECT page_id, domain_url, domain_final, domain FROM
    {with_domain_sql(with_domain_sql(with_domain_sql('(SELECT page_id, url, final_url FROM v_responses)', 'url', 'domain_url'), 'final_url', 'domain_final'), 'coalesce(final_url, url)', 'domain')}""")


# ---- corpus cleaning (E1) ----------------------------------------------------------------

def boilerplate_sql(src: str) -> str:
    return f"""(SELECT * FROM {src} WHERE regexp_matches(url, '^http')
        AND NOT regexp_matches(text, '(?i)cookies') AND NOT contains(text, 'No title'))"""


def normalised_sql(src: str) -> str:
    return f"(SELECT * REPLACE ({collapse_ws('text')} AS text) FROM {src})"


def words_sql(src: str) -> str:
    return f"(SELECT *, CAST(len(string_split(text, ' ')) AS BIGINT) AS text_words FROM {src})"


def order_sql(src: str) -> str:
    return f"""(SELECT *, CAST(row_number() OVER (PARTITION BY url ORDER BY country, pos,
            url_redirect NULLS FIRST, tag NULLS FIRST, text NULLS FIRST) + 1 AS BIGINT) AS "order"
        FROM {src})"""


def first_per_key_sql(src: str, keys: str, order: str) -> str:
    return f"""(SELECT * EXCLUDE (_rn) FROM (SELECT *, row_number() OVER (
        PARTITION BY {keys} ORDER BY {order}) AS _rn FROM {src}) WHERE _rn = 1)"""


def corpus_sql(src: str, stop: str = "end") -> str:
    s = normalised_sql(boilerplate_sql(src))
    s = words_sql(s)
    s = with_domain_sql(s, "coalesce(url_redirect, url)", "domain")
    s = order_sql(s)
    if stop == "order":
        return s
    s = first_per_key_sql(s, "domain, text", 'country NULLS FIRST, url NULLS FIRST, "order"')
    if stop == "dedupe":
        return s
    return f"""(SELECT * FROM {s} WHERE NOT regexp_matches(url, '(?i)datenschutz')
        AND text_length < 4000)"""


oracle("filter_boilerplate", ["v_docs"], f"SELECT doc_id, url, pos, text FROM {boilerplate_sql('v_docs')}")
oracle("normalise_text", ["v_docs"], f"SELECT doc_id, {collapse_ws('text')} AS text FROM v_docs")
oracle("word_count", ["v_docs"], f"SELECT doc_id, text_words FROM {words_sql(normalised_sql('v_docs'))}")
oracle("element_order", ["v_docs"], f'SELECT doc_id, url, "order" FROM {order_sql(boilerplate_sql("v_docs"))}')
oracle("dedupe_domain_text", ["v_docs"],
       f'SELECT doc_id, country, domain, url, "order", text FROM {corpus_sql("v_docs", "dedupe")}')
CORPUS_COLS = 'doc_id, country, domain, url, url_redirect, "order", pos, tag, text, text_length, text_words'
oracle("clean_corpus", ["v_docs"], f"SELECT {CORPUS_COLS} FROM {corpus_sql('v_docs')}")


def summary_sql(src: str) -> str:
    return f"""SELECT CAST(count(*) AS BIGINT) AS num_rows,
        CAST(count(DISTINCT url) + max(CAST(url IS NULL AS INTEGER)) AS BIGINT) AS num_unique_urls,
        CAST(count(DISTINCT domain) + max(CAST(domain IS NULL AS INTEGER)) AS BIGINT) AS num_unique_domains,
        round(count(*) / (count(DISTINCT url) + max(CAST(url IS NULL AS INTEGER))), 2) AS mean_rows_per_url
        FROM {src}"""


oracle("corpus_summary", ["v_docs"], summary_sql(corpus_sql("v_docs")))


# ---- keyword filter (E2) -------------------------------------------------------------------

WORD_SPLIT = r"[^\p{L}\p{Nl}\p{Nd}\p{Mn}\p{Mc}\p{Me}\p{Pc}\x{200C}\x{200D}]+"


def hits_sql(src: str) -> str:
    strict, compound = FX.keyword_lists()
    cond = " OR ".join([f"t IN ({', '.join(q(k) for k in strict)})"] +
                       [f"contains(t, {q(k)})" for k in compound])
    s = first_per_key_sql(f"(SELECT * FROM {src} WHERE NOT contains(tag, 'title'))",
                          "url, text", 'country NULLS FIRST, domain NULLS FIRST, "order"')
    return f"""(SELECT *, list_filter(string_split_regex(lower(text), {q(WORD_SPLIT)}),
                lambda t: t <> '' AND ({cond})) AS keywords FROM {s})"""


def distinct_list(x: str) -> str:
    return f"list_filter({x}, lambda v, i: list_position({x}, v) = i)"


def merge_sql(src: str) -> str:
    w = 'OVER (PARTITION BY country, domain, url ORDER BY "order")'
    head = "regexp_matches(tag, 'h[1-6]')"
    return f"""(SELECT * EXCLUDE (is_heading0, nkw, ntext),
        CASE WHEN merge_following THEN false ELSE is_heading0 END AS is_heading
      FROM (SELECT * EXCLUDE (text, keywords),
        CASE WHEN merge_following THEN text || ' ' || ntext ELSE text END AS text,
        {distinct_list("CASE WHEN merge_following THEN list_concat(keywords, nkw) ELSE keywords END")} AS keywords
      FROM (SELECT *,
        coalesce(len(keywords) > 0 AND "order" - lead("order") {w} = -1 AND {head}, false) AS merge_following,
        coalesce(len(lag(keywords) {w}) > 0 AND lag("order") {w} - "order" = -1
                 AND regexp_matches(lag(tag) {w}, 'h[1-6]'), false) AS remove_following,
        {head} AS is_heading0,
        lead(keywords) {w} AS nkw, lead(text) {w} AS ntext
      FROM {src})))"""


def filtered_sql(src: str, carry: str = "") -> str:
    return f"""(SELECT array_to_string(keywords, ', ') AS keywords, text, country, domain, url{carry}
        FROM {merge_sql(hits_sql(corpus_sql(src)))}
        WHERE len(keywords) >= 2 AND NOT is_heading AND NOT remove_following)"""


oracle("keyword_hits", ["v_docs"], f"""SELECT url, "order", text, array_to_string(keywords, ', ') AS keywords
    FROM {hits_sql(corpus_sql('v_docs'))}""")
oracle("heading_merge", ["v_docs"], f"""SELECT url, "order", text, array_to_string(keywords, ', ') AS keywords,
    is_heading, merge_following, remove_following FROM {merge_sql(hits_sql(corpus_sql('v_docs')))}""")
oracle("keyword_filter", ["v_docs"], f"SELECT * FROM {filtered_sql('v_docs')}")
KW = "(SELECT DISTINCT unnest(string_split_regex(lower(text), '[^a-z]+')) AS w FROM benchmark)"
_UNIQUE = first_per_key_sql(f"(SELECT * FROM {corpus_sql('v_docs')} WHERE NOT contains(tag, 'title'))",
                            "url, text", 'country NULLS FIRST, domain NULLS FIRST, "order"')
# a word is kept if it is strict or holds a compound keyword: decided once per distinct word
oracle("keyword_file_hits", ["v_docs"], f"""
    WITH u AS (SELECT url, "order", string_split_regex(lower(text), {q(WORD_SPLIT)}) AS ws FROM {_UNIQUE}),
    k AS MATERIALIZED {KW},
    vocab AS MATERIALIZED (SELECT DISTINCT unnest(ws) AS t FROM u),
    good AS (SELECT t FROM vocab WHERE t <> '' AND (t IN (SELECT w FROM k WHERE length(w) BETWEEN 6 AND 8)
             OR EXISTS (SELECT 1 FROM k WHERE length(w) >= 9 AND contains(t, w)))),
    hit AS (SELECT url, "order", i, ws[i] AS t FROM (SELECT *, unnest(range(1, len(ws) + 1)) AS i FROM u)
            SEMI JOIN good ON good.t = ws[i]),
    l AS (SELECT url, "order", string_agg(t, ', ' ORDER BY i) AS keywords FROM hit GROUP BY url, "order")
    SELECT u.url, u."order", coalesce(l.keywords, '') AS keywords
    FROM u LEFT JOIN l ON u."order" = l."order" AND u.url = l.url""")
_BUCKET_SRC = f"""(SELECT array_to_string(keywords, ', ') AS keywords, text, country, domain, url
    FROM {merge_sql(hits_sql(corpus_sql('v_docs')))} WHERE len(keywords) > 0)"""
oracle("keyword_review_buckets", ["v_docs"], f"""
    SELECT 'keyword_1' AS bucket, * FROM {_BUCKET_SRC} m WHERE len(string_split(keywords, ', ')) = 1
    UNION ALL
    SELECT 'keyword_2+' AS bucket, * FROM {_BUCKET_SRC} m
    WHERE len(list_distinct(string_split(keywords, ', '))) >= 2""")
SQL["keyword_review_files"] = SQL["keyword_review_buckets"]
oracle("keyword_hits_by_domain", ["v_elements"], f"""
    SELECT country, domain, count(*) AS texts, count(DISTINCT url) AS urls
    FROM {filtered_sql('v_elements')} GROUP BY country, domain""")


# ---- crawl bookkeeping ------------------------------------------------------------------------------

from webtext.functions import repair as R  # noqa: E402
from webtext.operators import facts as FA, language as LG, report as RP, scores as SC  # noqa: E402
from .views import WS  # noqa: E402

WORKLIST = "(SELECT DISTINCT regexp_replace(url, '#.*$', '', 'g') AS url FROM v_urls)"
oracle("url_worklist", ["v_urls"], f"SELECT url FROM {WORKLIST}")
oracle("resume_pending", ["v_urls", "v_done"], f"SELECT url FROM {WORKLIST} w ANTI JOIN (SELECT regexp_replace(url, '#.*$', '', 'g') AS url FROM v_done) USING (url)")
oracle("sample_urls", ["v_urls"], f"""SELECT url FROM {WORKLIST}
    ORDER BY md5('{FX.SAMPLE_SEED}|' || url), url LIMIT 50""")
# run 1 holds the done pages, run 2 all pages; per fragment-free URL the first
# run that sees it stores the page with the smallest original URL
oracle("resume_append", ["v_elements", "v_routed", "v_done"], """
    WITH r AS (SELECT *, regexp_replace(url, '#.*$', '', 'g') AS surl,
                      url IN (SELECT url FROM v_done) AS run1 FROM v_routed),
    pick AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY surl ORDER BY run1 DESC, url) AS rn
                            FROM r) WHERE rn = 1)
    SELECT p.surl AS url, CAST(NULL AS VARCHAR) AS error, count(e.text) AS texts
    FROM pick p JOIN v_elements e ON e.page_id = p.page_id WHERE p.error IS NULL GROUP BY p.surl
    UNION ALL
    SELECT surl AS url, error, CAST(0 AS BIGINT) AS texts FROM pick WHERE error IS NOT NULL""")

# ---- sources --------------------------------------------------------------------------------------------

oracle("csv_roundtrip", [], """SELECT doc_id, CASE WHEN doc_id % 50 = 0 THEN NULL WHEN doc_id % 50 = 1 THEN '' ELSE text END AS text,
    lang, source, n_chars FROM documents""")
oracle("corpus_sink", ["v_docs"], f"""SELECT {CORPUS_COLS.replace(' text,', " nullif(text, '') AS text,")}
    FROM {corpus_sql('v_docs')}""")
STRIP = f"'^{WS}+|{WS}+$'"
oracle("keyword_list", [], f"""SELECT value FROM (
    SELECT regexp_replace(unnest(string_split(text, chr(10))), {STRIP}, '', 'g') AS value FROM documents)
    WHERE value <> ''""")
oracle("union_countries", ["v_docs"], "SELECT doc_id, country FROM v_docs")


def replace_chain(x: str, pairs) -> str:
    for k, v in pairs:
        x = f"replace({x}, {q(k)}, {q(v)})"
    return x


oracle("repair_dictionary", ["v_mojibake_dict"],
       f"SELECT doc_id, {replace_chain('text', R.REPAIR_PAIRS)} AS text FROM v_mojibake_dict")
oracle("repair_latin1", ["v_mojibake_latin1"], "SELECT doc_id, original AS text FROM v_mojibake_latin1")
oracle("repair_code_pages", [], "SELECT doc_id, text FROM documents")
# the general fix gives the unharmed text back; the dictionary works on that
oracle("repair_text", ["v_docs"], f"""SELECT doc_id, country,
    CASE WHEN country = 'ger' THEN {replace_chain('text', R.REPAIR_PAIRS)} ELSE text END AS text FROM v_docs""")

# ---- language + scores ------------------------------------------------------------------------------------


def padded_sql(x: str) -> str:
    return f"(' ' || lower({collapse_ws(x)}) || ' ')"


def grams_sql(src: str, key: str) -> str:
    return f"""(SELECT {key}, substring(t, i, 3) AS gram, count(*) AS n
        FROM (SELECT {key}, t, unnest(range(1, length(t) - 1)) AS i
              FROM (SELECT {key}, {padded_sql('text')} AS t FROM {src}))
        GROUP BY {key}, gram)"""


PROFILE = grams_sql("(SELECT lang, text FROM documents WHERE lang IS NOT NULL)", "lang")
HELD_OUT = "substr(md5(CAST(doc_id AS VARCHAR)), 1, 1) BETWEEN '0' AND '4'"
oracle("language_profiles", [], f"SELECT lang, gram, n FROM {PROFILE}")


def detect_sql(src: str, profile: str = PROFILE) -> str:
    """Rows of ``src`` (with text) with detected and language; rows are numbered."""
    return f"""(WITH prof AS {profile},
    V AS (SELECT count(DISTINCT gram) AS v FROM prof),
    T AS (SELECT lang, sum(n) AS t FROM prof GROUP BY lang),
    test AS (SELECT *, row_number() OVER () AS rid FROM {src}),
    dg AS {grams_sql('test', 'rid')},
    known AS (SELECT dg.* FROM dg SEMI JOIN (SELECT DISTINCT gram FROM prof) USING (gram)),
    sc AS (SELECT k.rid, T.lang,
                  sum(k.n * ln((coalesce(p.n, 0) + 1) / (T.t + V.v))) AS s
           FROM known k CROSS JOIN T CROSS JOIN V
           LEFT JOIN prof p ON p.gram = k.gram AND p.lang = T.lang
           GROUP BY k.rid, T.lang),
    best AS (SELECT rid, arg_max(lang, s) AS detected
             FROM (SELECT *, max(s) OVER (PARTITION BY rid) AS m FROM sc)
             GROUP BY rid HAVING sum(exp(s - m)) <= 1 / {LG.MIN_POSTERIOR})
    SELECT test.* EXCLUDE (rid), best.detected,
           CASE WHEN test.text IS NULL OR {collapse_ws('test.text')} = '' THEN 'Other'
                WHEN best.detected IS NULL THEN 'Error'
                WHEN best.detected = 'en' THEN 'eng' WHEN best.detected = 'de' THEN 'ger'
                ELSE 'Other' END AS language
    FROM test LEFT JOIN best USING (rid))"""


def study_sql(src: str) -> str:
    return f"(SELECT * FROM {detect_sql(src)} WHERE language IN ('eng', 'ger'))"


oracle("detect_language", [], f"SELECT doc_id, lang, detected, language FROM {detect_sql('documents')}")
oracle("language_accuracy", [], f"""SELECT lang, count(*) AS texts,
    CAST(count_if(detected = lang) AS BIGINT) AS "right", CAST(count_if(detected IS NULL) AS BIGINT) AS undecided
    FROM {detect_sql(f"(SELECT doc_id, text, lang FROM documents WHERE {HELD_OUT})",
                     grams_sql(f"(SELECT lang, text FROM documents WHERE lang IS NOT NULL AND NOT {HELD_OUT})", "lang"))}
    GROUP BY lang""")
oracle("filter_language", [], f"SELECT doc_id, language FROM {study_sql('documents')}")
TOP = """(SELECT doc_id, token, logprob, CAST(rank AS INTEGER) AS rank FROM (
    SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY logprob DESC, token) AS rank FROM v_scores)
    WHERE rank <= 3)"""
LABEL = "CASE " + " ".join(f"WHEN token = '{k}' THEN {q(v)}" for k, v in SC.CONCEPT_LABELS.items()) + " END"
DECODED = f"(SELECT doc_id, rank, {LABEL} AS label, round(exp(logprob) * 100, 2) AS linprob FROM {TOP})"
oracle("topk_scores", ["v_scores"], f"SELECT doc_id, rank, token, logprob FROM {TOP}")
oracle("decode_tokens", ["v_scores"], f"SELECT * FROM {DECODED}")
oracle("row_index_by", [], """SELECT doc_id, lang, substr(md5(source), 1, 2) AS key,
    row_number() OVER (PARTITION BY lang ORDER BY substr(md5(source), 1, 2), doc_id) AS "index" FROM documents""")
oracle("row_index", [], """SELECT doc_id, lang,
    CAST(row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS BIGINT) AS "index" FROM documents""")
def wide_sql(decoded: str) -> str:
    return "(SELECT doc_id, " + ", ".join(
        f"max(CASE WHEN rank = {r} THEN label END) AS token_{r}, max(CASE WHEN rank = {r} THEN linprob END) AS linprob_{r}"
        for r in (1, 2, 3)) + f" FROM {decoded} GROUP BY doc_id)"


oracle("scores_wide", ["v_scores"], f"SELECT * FROM {wide_sql(DECODED)}")


def class_scores_sql(src: str, coded: str) -> str:
    """(doc_id, token, logprob) of the rows (doc_id, language, text) of ``src``."""
    def words(x, cols):
        return f"(SELECT {cols}, unnest(regexp_extract_all(lower(text), '\\p{{L}}+')) AS w FROM {x})"
    return f"""(WITH coded AS MATERIALIZED (SELECT * FROM {coded} WHERE language IS NOT NULL),
    n AS MATERIALIZED (SELECT language, code, w, count(*) AS n FROM {words('coded', 'language, code')} GROUP BY ALL),
    code AS (SELECT unnest([1, 2, 3]) AS code),
    vocab AS (SELECT DISTINCT language, w FROM n),
    v AS MATERIALIZED (SELECT language, count(*) AS v FROM vocab GROUP BY language),
    t AS MATERIALIZED (SELECT language, code, sum(n) AS t FROM n GROUP BY ALL),
    d AS (SELECT language, code, count(*) AS d FROM coded GROUP BY ALL),
    a AS (SELECT language, count(*) AS a FROM coded GROUP BY ALL),
    prior AS MATERIALIZED (SELECT a.language, c.code, ln((coalesce(d.d, 0) + 1) / (a.a + 3)) AS p, coalesce(t.t, 0) AS t
              FROM a CROSS JOIN code c LEFT JOIN d ON d.language = a.language AND d.code = c.code
              LEFT JOIN t ON t.language = a.language AND t.code = c.code),
    rows_ AS MATERIALIZED (SELECT doc_id, language, text FROM {src}),
    model AS MATERIALIZED (SELECT vocab.language, vocab.w, p.code, ln((coalesce(n.n, 0) + 1) / (p.t + v.v)) AS lp
          FROM vocab JOIN v ON v.language = vocab.language JOIN prior p ON p.language = vocab.language
          LEFT JOIN n ON n.language = vocab.language AND n.w = vocab.w AND n.code = p.code),
    known AS MATERIALIZED (SELECT doc_id, language, w, count(*) AS m FROM {words('rows_', 'doc_id, language')} GROUP BY ALL),
    s AS (SELECT k.doc_id, m.code, sum(k.m * m.lp) AS s
          FROM known k JOIN model m ON m.language = k.language AND m.w = k.w GROUP BY ALL),
    total AS (SELECT r.doc_id, p.code, p.p + coalesce(s.s, 0) AS s FROM (SELECT DISTINCT doc_id, language FROM rows_) r
              JOIN prior p USING (language) LEFT JOIN s ON s.doc_id = r.doc_id AND s.code = p.code),
    top AS (SELECT *, max(s) OVER (PARTITION BY doc_id) AS m FROM total)
    SELECT doc_id, CAST(code AS VARCHAR) AS token, s - m - ln(sum(exp(s - m)) OVER (PARTITION BY doc_id)) AS logprob
    FROM top)"""


def decoded_sql(scores: str) -> str:
    return f"""(SELECT doc_id, rank, {LABEL} AS label, round(exp(logprob) * 100, 2) AS linprob FROM (
        SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY logprob DESC, token) AS rank FROM {scores})
        WHERE rank <= 3)"""


DOC_LANG = "(SELECT doc_id, CASE lang WHEN 'en' THEN 'eng' WHEN 'de' THEN 'ger' ELSE lang END AS language, text FROM documents)"
oracle("class_scores", ["v_coded"], f"SELECT doc_id, token, round(logprob, 4) + 0.0 AS logprob FROM {class_scores_sql(DOC_LANG, 'v_coded')}")
oracle("class_accuracy", ["v_coded"], f"""WITH s AS {class_scores_sql(f'(SELECT * FROM v_coded WHERE {HELD_OUT})',
                                                                       f'(SELECT * FROM v_coded WHERE NOT {HELD_OUT})')}
    SELECT language, count(*) AS texts, CAST(count_if(CAST(token AS INTEGER) = code) AS BIGINT) AS "right"
    FROM v_coded JOIN (SELECT doc_id, token FROM s QUALIFY
        row_number() OVER (PARTITION BY doc_id ORDER BY logprob DESC, token) = 1) USING (doc_id) GROUP BY language""")

# ---- classes ----------------------------------------------------------------------------------------------------

REPAIRED = f"""(SELECT * REPLACE (CASE WHEN country = 'ger' THEN {replace_chain('text', R.REPAIR_PAIRS)}
    ELSE text END AS text) FROM v_docs)"""
STUDY = study_sql(filtered_sql(REPAIRED, ', doc_id, "order"'))
oracle("study_texts", ["v_docs"], f"""SELECT doc_id, country, domain, url, "order", keywords, language, text
    FROM {STUDY}""")
SCORED = f"""(SELECT c.doc_id, c.language, c.country, c.domain, c.url, c.text,
    CASE WHEN w.linprob_1 <= 50 THEN NULL ELSE w.token_1 END AS token_1, w.linprob_1,
    w.token_2, w.linprob_2, w.token_3, w.linprob_3
    FROM {STUDY} c LEFT JOIN {wide_sql(decoded_sql(class_scores_sql(STUDY, 'v_coded')))} w USING (doc_id))"""
oracle("attach_scores", ["v_docs", "v_coded"],
       f"SELECT doc_id, language, country, domain, token_1, linprob_1 FROM {SCORED}")
oracle("domain_class_counts", ["v_docs", "v_coded"], f"""SELECT country, domain, token_1, count(*) AS len
    FROM {SCORED} WHERE token_1 IS NOT NULL GROUP BY ALL""")
LABS = list(SC.CONCEPT_LABELS.values())
PIVOT = ("(SELECT country, domain, " + ", ".join(
    f'CAST(count_if(token_1 = {q(v)}) AS BIGINT) AS "{v}"' for v in LABS)
    + f" FROM {SCORED} WHERE token_1 IS NOT NULL GROUP BY country, domain)")
I_, C_, N_ = (f'"{v}"' for v in LABS)
PROPS = f"""(SELECT *, CAST({N_} + {C_} + {I_} AS BIGINT) AS total, CAST({C_} + {I_} AS BIGINT) AS total_ind_coll,
    CASE WHEN {C_} + {I_} <= 1 THEN NULL
         WHEN {I_} = 0 AND {C_} = 0 THEN 0.0 WHEN {I_} = 0 OR {C_} = 0 THEN 1.0
         ELSE round({I_} / ({I_} + {C_}), 6) END AS ind_coll_prop FROM {PIVOT})"""
oracle("domain_class_pivot", ["v_docs", "v_coded"], f"SELECT * FROM {PIVOT}")
oracle("domain_proportions", ["v_docs", "v_coded"], f"SELECT * FROM {PROPS}")

# ---- facts ------------------------------------------------------------------------------------------------------------

UNION_FACTS = "(" + " UNION ALL BY NAME ".join(
    f"(SELECT *, '{c}' AS country FROM v_facts_{c})" for c in FX.COUNTRIES) + ")"
FACT_VIEWS = [f"v_facts_{c}" for c in FX.COUNTRIES]
oracle("union_by_name_missing", FACT_VIEWS, f"SELECT * FROM {UNION_FACTS}")


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, {STRIP}, '', 'g')"


def inlist(vals) -> str:
    return "(" + ", ".join(q(v) for v in vals) + ")"


FLAGS = with_domain_sql(f"""(SELECT country, name, url, international_per,
    lower({strip_sql("coalesce(CAST(elite AS VARCHAR), 'None')")}) IN {inlist(FA.ELITE_TRUE)} AS elite,
    lower({strip_sql('CAST(type AS VARCHAR)')}) IN {inlist(FA.PRIVATE_TRUE)} AS private,
    founding_year < {FA.OLD_BEFORE} AS old,
    CAST(student_size_n AS BIGINT) AS student_size_n FROM {UNION_FACTS})""", "url", "domain")
oracle("normalise_flags", FACT_VIEWS,
       f"SELECT country, name, url, domain, elite, private, old, student_size_n FROM {FLAGS}")
FACTS = f"""(SELECT f.country, name, url, domain, elite, private, old, student_size_n, international_per,
    student_size_n > m_size AS student_size_above_50, international_per > m_int AS international_per_above_50
    FROM {FLAGS} f LEFT JOIN (SELECT country, median(international_per) AS m_int,
                                     median(student_size_n) AS m_size FROM {FLAGS} GROUP BY country) m
    ON f.country = m.country)"""
oracle("median_flags", FACT_VIEWS, f"SELECT * FROM {FACTS}")
BANDS = "[" + ", ".join(q(b) for b in FA.RANK_BANDS) + "]"
oracle("rank_tiers", FACT_VIEWS, f"""
    WITH f AS {FACTS},
    r AS (SELECT country, domain, CASE WHEN n % 3 = 0 THEN CAST(n * 10 + 5 AS VARCHAR)
                                       WHEN n % 3 = 1 THEN {BANDS}[n % 6 + 1] ELSE 'n/a' END AS global_rank
          FROM (SELECT DISTINCT country, domain,
                       TRY_CAST(regexp_extract(domain, '[0-9]+', 0) AS INTEGER) AS n FROM f))
    SELECT f.country, name, f.domain, global_rank,
           CASE WHEN TRY_CAST(global_rank AS INTEGER) <= 100 THEN 'competitors'
                WHEN TRY_CAST(global_rank AS INTEGER) BETWEEN 101 AND 200 THEN 'competitors'
                WHEN global_rank IN {inlist(FA.RANK_BANDS)} THEN 'aspirants'
                ELSE 'non competitors' END AS rank
    FROM f LEFT JOIN r ON f.country = r.country AND f.domain = r.domain""")

# ---- coverage (E3) -------------------------------------------------------------------------------------------------------


def url_cov_sql(urls: str, elements: str, filtered: str) -> str:
    return f"""(WITH u AS {with_domain_sql(urls, 'url', 'domain')},
      s AS (SELECT url, count(text) AS texts_all FROM {elements} GROUP BY url),
      e AS (SELECT url FROM v_routed WHERE error IS NOT NULL),
      k AS (SELECT country, domain, url, count(text) AS texts_filtered FROM {filtered}
            WHERE country IS NOT NULL AND domain IS NOT NULL AND url IS NOT NULL GROUP BY ALL)
      SELECT u.url, CASE u.country WHEN 'germany' THEN 'ger' WHEN 'india' THEN 'ind' ELSE u.country END AS country,
             u.domain, s.texts_all, e.url IS NOT NULL AS error, k.texts_filtered
      FROM u LEFT JOIN s ON u.url = s.url LEFT JOIN e ON u.url = e.url
      LEFT JOIN k ON k.country = (CASE u.country WHEN 'germany' THEN 'ger' WHEN 'india' THEN 'ind' ELSE u.country END)
                 AND k.domain = u.domain AND k.url = u.url)"""


def dom_cov_sql(url_cov: str) -> str:
    return f"""(SELECT country, domain, count(DISTINCT url) AS urls_all_count,
        count(texts_filtered) AS urls_filtered_count,
        CAST(coalesce(sum(texts_all), 0) AS BIGINT) AS texts_all_total,
        round(avg(texts_all), 6) AS texts_all_mean_per_url,
        CAST(coalesce(sum(texts_filtered), 0) AS BIGINT) AS texts_filtered_total,
        round(avg(texts_filtered), 6) AS texts_filtered_mean_per_url
        FROM {url_cov} GROUP BY country, domain)"""


URL_COV = url_cov_sql("(SELECT url, country FROM v_urls)", "v_elements",
                      study_sql(filtered_sql("v_elements")))
oracle("url_coverage", ["v_urls", "v_elements", "v_routed"], f"SELECT * FROM {URL_COV}")
oracle("domain_coverage", ["v_urls", "v_elements", "v_routed"], f"SELECT * FROM {dom_cov_sql(URL_COV)}")
DOC_COV = dom_cov_sql(url_cov_sql("(SELECT DISTINCT url, country FROM v_docs)", "v_docs", STUDY))
COV_CLASSES = f"(SELECT * FROM {DOC_COV} d LEFT JOIN {PROPS} p USING (country, domain))"
oracle("coverage_classes", ["v_docs", "v_coded", "v_routed"], f"SELECT * FROM {COV_CLASSES}")
ANALYSIS = f"(SELECT * FROM {COV_CLASSES} c JOIN {FACTS} f USING (country, domain) WHERE name IS NOT NULL)"
oracle("analysis_table", ["v_docs", "v_coded", "v_routed"] + FACT_VIEWS, f"SELECT * FROM {ANALYSIS}")

# ---- quality + report ------------------------------------------------------------------------------------------------------

oracle("stratified_sample", ["v_docs"], f"""SELECT doc_id, country, text, keywords, domain, url, '' AS concept FROM (
    SELECT *, row_number() OVER (PARTITION BY country
        ORDER BY md5('{FX.SAMPLE_SEED}|' || CAST(doc_id AS VARCHAR)), doc_id) AS rn
    FROM {filtered_sql('v_docs', ', doc_id')}) WHERE rn <= 20""")


def code_label(x: str) -> str:
    return "CASE " + " ".join(f"WHEN {x} = {k} THEN {q(v)}" for k, v in SC.CONCEPT_LABELS.items()) + " END"


RATINGS = f"""(SELECT doc_id, {code_label('llm')} AS llm,
    {code_label('CASE WHEN coder_a = 4 THEN 3 ELSE coder_a END')} AS coder_a,
    {code_label('CASE WHEN coder_b = 4 THEN 3 ELSE coder_b END')} AS coder_b, url, country FROM v_ratings)"""
PAIRS = [("llm", "coder_a"), ("llm", "coder_b"), ("coder_a", "coder_b")]
oracle("ratings_table", ["v_ratings"], f"SELECT * FROM {RATINGS}")
oracle("rater_match_flags", ["v_ratings"], "SELECT doc_id, llm, coder_a, coder_b, " + ", ".join(
    f"{a} = {b} AS match_{a}_{b}" for a, b in PAIRS) + f" FROM {RATINGS}")
oracle("rater_agreement", ["v_ratings"], " UNION ALL ".join(f"""
    SELECT '{a}' AS rater_1, '{b}' AS rater_2, n_both, n_match,
           CASE WHEN n_both = 0 THEN 0.0 ELSE round(CAST(n_match AS DOUBLE) * 100 / n_both, 6) END AS match_pct
    FROM (SELECT CAST(count_if({a} IS NOT NULL AND {b} IS NOT NULL) AS BIGINT) AS n_both,
                 CAST(count_if({a} IS NOT NULL AND {b} IS NOT NULL AND {a} = {b}) AS BIGINT) AS n_match
          FROM {RATINGS})""" for a, b in PAIRS))
oracle("pair_counts", ["v_ratings"], " UNION ALL ".join(f"""
    SELECT '{a}' AS rater_1, '{b}' AS rater_2, {a} AS value_1, {b} AS value_2, count(*) AS "count"
    FROM {RATINGS} WHERE llm IS NOT NULL AND coder_a IS NOT NULL AND coder_b IS NOT NULL
    GROUP BY {a}, {b}""" for a, b in PAIRS))

SQL["pair_counts_sink"] = f"""SELECT *, row_number() OVER (
    PARTITION BY rater_1, rater_2 ORDER BY "count" DESC, value_1, value_2)::INTEGER AS "row" FROM ({SQL["pair_counts"]})"""

_CN = "CASE " + " ".join(f"WHEN country = {q(k)} THEN {q(v)}" for k, v in RP.COUNTRY_NAMES.items()) + " ELSE country END"
oracle("country_report", ["v_report"], f"""
    WITH r AS (SELECT {_CN} AS country_name, nullif(CAST(number AS DOUBLE), 0.0) AS number, flag FROM v_report),
    g AS (SELECT CASE WHEN grouping(country_name) = 1 THEN 'Total' ELSE country_name END AS country_name,
            CAST(count_if(number IS NULL) AS DOUBLE) AS "number|Nmiss", avg(number) AS "number|mean",
            stddev_samp(number) AS "number|sd", median(number) AS "number|median",
            min(number) AS "number|min", max(number) AS "number|max",
            CAST(count_if(flag) AS DOUBLE) AS "flag|count_true",
            CAST(count_if(flag) AS DOUBLE) * 100 / count(flag) AS "flag|pct_true",
            CAST(count_if(flag IS NULL) AS DOUBLE) AS "flag|Nmiss"
          FROM r GROUP BY ROLLUP (country_name))
    SELECT country_name, split_part(k, '|', 1) AS variable, split_part(k, '|', 2) AS statistic,
           round(value, 6) AS value
    FROM g UNPIVOT INCLUDE NULLS (value FOR k IN ("number|Nmiss", "number|mean", "number|sd",
        "number|median", "number|min", "number|max", "flag|count_true", "flag|pct_true", "flag|Nmiss"))""")


REPORT_NUMBERS = ["urls_all_count", "texts_all_total", "urls_filtered_count", "texts_filtered_total",
                  "student_size_n", "international_per", "Collective", "Individual", "ind_coll_prop"]


def _report_parts(row: str, group: str) -> list[str]:
    parts = []
    for c in REPORT_NUMBERS:
        x = f"nullif(CAST({c} AS DOUBLE), 0.0)" if c in ("urls_filtered_count", "texts_filtered_total") \
            else f"CAST({c} AS DOUBLE)"
        for stat, agg in [("Nmiss", f"CAST(count_if({x} IS NULL) AS DOUBLE)"), ("mean", f"avg({x})"),
                          ("sd", f"stddev_samp({x})"), ("median", f"median({x})"),
                          ("min", f"min({x})"), ("max", f"max({x})")]:
            parts.append(f"SELECT {row} AS country_name, '{c}' AS variable, '{stat}' AS statistic, "
                         f"round({agg}, 6) AS value FROM a {group}")
    for c in ["elite", "private", "old"]:
        for stat, agg in [("count_true", f"CAST(count_if({c}) AS DOUBLE)"),
                          ("pct_true", f"CASE WHEN count({c}) > 0 THEN count_if({c}) * 100.0 / count({c}) END"),
                          ("Nmiss", f"CAST(count_if({c} IS NULL) AS DOUBLE)")]:
            parts.append(f"SELECT {row} AS country_name, '{c}' AS variable, '{stat}' AS statistic, "
                         f"round({agg}, 6) AS value FROM a {group}")
    return parts


oracle("analysis_report", ["v_docs", "v_coded", "v_routed"] + FACT_VIEWS,
       f"WITH a AS MATERIALIZED (SELECT *, {_CN} AS country_name FROM {ANALYSIS}) "
       + " UNION ALL ".join(_report_parts("'Total'", "") + _report_parts("country_name", "GROUP BY country_name")))
