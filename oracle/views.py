"""DuckDB twins of the derived test views (FIXTURES.md section B).

Each view is a SQL fragment over the driver's pre-registered tables.  Queries
are written as ``WITH <views> <body>``; :func:`with_views` adds the views a
body needs, in dependency order.
"""

from __future__ import annotations

from webtext.plans import fixtures as FX

# Unicode White_Space, spelled out for RE2 (whose \s is ASCII only).
WS = r"[\t\n\x{0B}\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def collapse_ws(x: str) -> str:
    return f"trim(regexp_replace({x}, {q(WS + '+')}, ' ', 'g'))"


# The references that occur in the test pages; ``&amp;`` goes last so that an
# escaped entity is not decoded twice.
ENTITIES = [
    ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'),
    ("&#39;", "'"), ("&apos;", "'"), ("&copy;", "©"), ("&reg;", "®"),
    ("&middot;", "·"), ("&ndash;", "–"), ("&mdash;", "—"),
    ("&hellip;", "…"), ("&laquo;", "«"), ("&raquo;", "»"),
    ("&euro;", "€"), ("&comma;", ","), ("&#0000000228;", "ä"), ("&#150;", "–"), ("&#x92", "’"),
    ("&auml;", "ä"), ("&auml", "ä"), ("&nbsp", " "), ("&notit;", "¬it;"), ("&amp;", "&"),
]


def decode_entities(x: str) -> str:
    for k, v in ENTITIES:
        x = f"replace({x}, {q(k)}, {q(v)})"
    return x


def pick(values, idx: str) -> str:
    parts = " ".join(f"WHEN {idx} = {i} THEN {q(v) if v is not None else 'NULL'}"
                     for i, v in enumerate(values))
    return f"(CASE {parts} END)"


# Tags and what is dropped, written for RE2.  A quoted value may hold a ">".
_MARKUP = (r"(?is)<!--(?:-?>|.*?(?:--!?>|\z))"
           r"|<script(?:[\s/][^>]*)?>(?:.*?</script(?:[\s/][^>]*)?>|.*)|<style(?:[\s/][^>]*)?>(?:.*?</style(?:[\s/][^>]*)?>|.*)"
           r"|<title(?:[\s/][^>]*)?>.*?</title(?:[\s/][^>]*)?>"
           r"""|</?[a-z](?:[^>=]|=\s*(?:"[^"]*"|'[^']*')?)*(?:>|\z)|<[!?][^>]*(?:>|\z)|</[^a-z>][^>]*(?:>|\z)|</>""")
_CONTAINERS = ("address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form "
               "h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary ul table caption tbody thead tfoot "
               "tr td th").split()
_LEAST_PARAGRAPH = 150


def _elements_sql(src: str) -> str:
    """Extraction of p/h1/h2/h3 + title from ``src(page_id, url, html, ...)``
    into one row per element.  The stack of open elements is a path of
    ``/name:position`` that one recursive step per tag rewrites."""
    before = lambda path, pattern: f"regexp_extract({path}, {q('^(.*)' + pattern)}, 1)"
    matches = lambda path, pattern: f"regexp_matches({path}, {q(pattern)})"
    no_barrier = lambda path, kept: f"NOT {matches(f'substr({path}, length({kept}) + 1)', '/(?:table|caption|td|th):')}"
    item = r":\d+(?:/(?:address|div|p):\d+)*$"
    back_to = lambda names: f"regexp_extract(path, {q(f'^.*/(?:{names}):' + chr(92) + 'd+')})"
    rows, sections = "tr|tbody|thead|tfoot|table", "tbody|thead|tfoot|table"
    same = "regexp_extract(path, '^(.*)/' || name || ':\\d+', 1)"
    return f"""
    (WITH RECURSIVE c AS (
        SELECT * EXCLUDE (html), coalesce(html, '') AS h FROM {src}),
     m AS (
        SELECT *, regexp_extract_all(h, {q(_MARKUP)}) AS tags, string_split_regex(h, {q(_MARKUP)}) AS parts FROM c),
     g AS (
        SELECT page_id, unnest(range(1, len(tags) + 1)) AS k, unnest(tags) AS tag, unnest(parts[2:]) AS part,
        FROM m),
     named AS (
        SELECT page_id, k, part, lower(regexp_extract(CASE WHEN ends_with(tag, '>') THEN tag END, {q(r'^<(/?[a-zA-Z][^' + chr(92) + 's/>]*)')}, 1)) AS name FROM g),
     tok AS (
        SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY k) AS i FROM named
        WHERE ltrim(name, '/') IN ({', '.join(map(q, _CONTAINERS))})),
     fold AS (
        SELECT page_id, 0::BIGINT AS i, 0::BIGINT AS k, '' AS open, '' AS closed FROM c
        UNION ALL
        SELECT page_id, i, k, stays || CASE WHEN starts_with(name, '/') OR name = 'hr' THEN '' ELSE '/' || name || ':' || k END,
               substr(path, length(stays) + 1)
        FROM (SELECT page_id, i, k, name, path, CASE
                WHEN NOT opens THEN keeps
                WHEN {matches('name', '^h[1-6]$')} THEN regexp_replace(keeps, {q('/h[1-6]:' + chr(92) + 'd+$')}, '')
                ELSE keeps END AS stays
              FROM (SELECT *, CASE
                      WHEN opens AND {matches('less', '/p:')} AND {no_barrier('less', before('less', '/p:'))}
                      THEN {before('less', '/p:')} ELSE less END AS keeps
                    FROM (SELECT page_id, i, k, path, opens, CASE WHEN opens THEN name ELSE '/' || name END AS name, CASE
                            WHEN opens AND name = 'li' AND {matches('path', '/li' + item)} THEN {before('path', '/li' + item)}
                            WHEN opens AND name IN ('dd', 'dt') AND {matches('path', '/d[dt]' + item)} THEN {before('path', '/d[dt]' + item)}
                            WHEN opens AND name IN ('td', 'th') AND {matches('path', f'/(?:{rows}):')} THEN {back_to(rows)}
                            WHEN opens AND name = 'tr' AND {matches('path', f'/(?:{sections}):')} THEN {back_to(sections)}
                            WHEN opens AND name IN ('caption', 'tbody', 'thead', 'tfoot') AND {matches('path', '/table:')} THEN {back_to('table')}
                            WHEN opens THEN path
                            WHEN {matches('name', '^h[1-6]$')} THEN CASE WHEN {matches('path', '/h[1-6]:')}
                                AND {no_barrier('path', before('path', '/h[1-6]:'))} THEN {before('path', '/h[1-6]:')} ELSE path END
                            WHEN NOT contains(path, '/' || name || ':') THEN path
                            WHEN name = 'table' THEN {same}
                            WHEN name IN ('caption', 'tr', 'tbody', 'thead', 'tfoot', 'td', 'th') THEN
                                CASE WHEN contains(substr(path, length({same}) + 1), '/table:') THEN path ELSE {same} END
                            WHEN {no_barrier('path', same)} THEN {same} ELSE path END AS less
                          FROM (SELECT f.page_id, t.i, t.k, f.open AS path, ltrim(t.name, '/') AS name,
                                       NOT starts_with(t.name, '/') AS opens
                                FROM fold AS f JOIN tok AS t ON t.page_id = f.page_id AND t.i = f.i + 1))))),
     last AS (SELECT page_id, max_by(open, i) AS open FROM fold GROUP BY page_id),
     done AS (
        SELECT page_id, unnest(regexp_extract_all(closed, {q('/(?:p|h[123]):' + chr(92) + 'd+')})) AS e, k AS stop FROM fold
        UNION ALL
        SELECT page_id, unnest(regexp_extract_all(open, {q('/(?:p|h[123]):' + chr(92) + 'd+')})), NULL FROM last),
     el AS (
        SELECT page_id, regexp_extract(e, '/([a-z0-9]+):', 1) AS tag, regexp_extract(e, {q(':(' + chr(92) + 'd+)')}, 1)::BIGINT AS k, stop,
               row_number() OVER (PARTITION BY page_id ORDER BY k)::INTEGER AS pos FROM done),
     body AS (
        SELECT page_id, pos, el.tag, {collapse_ws("string_agg(" + decode_entities('part') + ", ' ' ORDER BY g.k)")} AS text
        FROM el JOIN g USING (page_id) WHERE g.k >= el.k AND (stop IS NULL OR g.k < stop) GROUP BY page_id, pos, el.tag),
     raw AS (
        SELECT page_id, regexp_extract(min_by(tag, k), {q(r'(?is)^<title(?:[' + chr(92) + r's/][^>]*)?>(.*)</title')}, 1) AS t
        FROM g WHERE regexp_matches(tag, {q('(?is)^<title.*</title')}) GROUP BY page_id),
     t AS (
        SELECT page_id, 0 AS pos, 'title' AS tag,
               CASE WHEN t IS NULL OR regexp_matches(t, '<[A-Za-z/!?]') OR {collapse_ws(decode_entities('t'))} = ''
                    THEN 'No title' ELSE {collapse_ws(decode_entities('t'))} END AS text
        FROM c LEFT JOIN raw USING (page_id))
     SELECT c.* EXCLUDE (h), pos, tag, text FROM c JOIN (
        SELECT * FROM t UNION ALL SELECT * FROM body
        WHERE (tag = 'p' AND length(text) >= {_LEAST_PARAGRAPH}) OR (tag <> 'p' AND length(text) > 0)) USING (page_id))"""


def elements_sql(src: str, dedupe: bool = True, collapse: bool = True) -> str:
    """Per-page dedupe (first pos of each text) and heading-run collapse."""
    body = _elements_sql(src)
    if dedupe:
        body = f"""(SELECT * EXCLUDE (rn) FROM (
            SELECT *, row_number() OVER (PARTITION BY page_id, text ORDER BY pos) AS rn
            FROM {body}) WHERE rn = 1)"""
    if collapse:
        heads = "('h1','h2','h3')"
        body = f"""(SELECT * EXCLUDE (prev_tag) FROM (
            SELECT *, lag(tag) OVER (PARTITION BY page_id ORDER BY pos) AS prev_tag
            FROM {body}) WHERE NOT (tag IN {heads} AND coalesce(prev_tag IN {heads}, false)))"""
    return body


VIEWS: dict[str, tuple[list[str], str]] = {}


def view(name: str, deps: list[str], sql: str) -> None:
    VIEWS[name] = (deps, sql)


view("v_responses", [], """
    SELECT page_id, url, html || CASE page_id % 6
               WHEN 1 THEN '<h2>Rooms &comma; halls<div>and &#150; more</div>1 < 2</h2><p title="a > b">' || html || '</p>'
               WHEN 2 THEN '<ul><li><h3>Fees&nbsp; &auml;nd &#0000000228;<li><h3>x</h3><p>' || url || repeat(' word&notit;', 20) || '</ul>after'
               WHEN 3 THEN '<table><tr><td><p>' || repeat('cell &auml ', 20) || '<td><h1>' || url || '<tr><td></div>' || repeat('&#x92 more ', 20) || '</table>'
               WHEN 4 THEN '<h1><p>' || repeat('both kept ', 20) || '</p></h1><script>var p = "<p>' || url ELSE '' END AS html,
           CASE WHEN page_id % 17 = 0 THEN 404 WHEN page_id % 23 = 0 THEN 500 ELSE 200 END AS status,
           CASE WHEN page_id % 19 = 0 THEN 'application/pdf' ELSE 'text/html' END AS content_type,
           CASE WHEN page_id % 10 = 0
                THEN 'https://www.campus' || CAST(page_id % 3 AS VARCHAR) || '.co.uk/' || CAST(page_id AS VARCHAR)
                WHEN page_id % 10 = 5
                THEN 'http://me:p@ss@www.uni' || CAST(page_id % 3 AS VARCHAR) || '。xn--p1ai/' || CAST(page_id AS VARCHAR)
                ELSE url END AS final_url,
           regexp_extract(url, '/(en|de|fr|es)/', 1) AS country
    FROM pages""")

view("v_urls", [], """
    SELECT url, regexp_extract(url, '/(en|de|fr|es)/', 1) AS country FROM pages
    UNION ALL
    SELECT url, regexp_extract(url, '/(en|de|fr|es)/', 1) AS country FROM pages WHERE page_id % 5 = 0""")

view("v_done", [], "SELECT url FROM pages WHERE page_id % 4 = 0")

view("v_routed", ["v_responses"], """
    SELECT page_id, url, html, country,
           CASE WHEN final_url <> url THEN final_url END AS url_redirect,
           CASE WHEN status >= 400 THEN CAST(status AS VARCHAR)
                WHEN content_type = 'application/pdf' THEN 'Redirected to PDF' END AS error
    FROM v_responses""")

view("v_elements", ["v_routed"],
     "SELECT page_id, url, url_redirect, country, pos, tag, text, CAST(length(text) AS INTEGER) AS text_length FROM "
     + elements_sql("(SELECT page_id, url, url_redirect, country, html FROM v_routed WHERE error IS NULL)"))

view("v_docs", [], f"""
    SELECT doc_id, country, url, url_redirect, pos, tag, text, lang,
           CAST(length(text) AS INTEGER) AS text_length
    FROM (
      SELECT doc_id, {pick(FX.COUNTRIES, 'doc_id % 4')} AS country,
             'http://' || source || '.example.org/' || CAST(doc_id // 200 AS VARCHAR) AS url,
             CAST(NULL AS VARCHAR) AS url_redirect,
             CAST((doc_id // 20) % 10 AS INTEGER) AS pos,
             CASE WHEN (doc_id // 20) % 10 = 0 THEN 'title'
                  WHEN ((doc_id // 20) % 10) % 3 = 1 THEN 'h2' ELSE 'p' END AS tag,
             (CASE WHEN doc_id % 7 = 0 THEN {q(chr(0xa0) * 2 + ' ' + chr(0xa0))} ELSE '' END)
             || (CASE WHEN doc_id % 29 = 0 THEN 'Cookies ' ELSE '' END)
             || (CASE WHEN doc_id % 31 = 0 AND (doc_id // 20) % 10 = 0 THEN 'No title ' ELSE '' END)
             || text AS text,
             lang
      FROM documents)""")


def _mojibake(sz: str) -> str:
    t = "text"
    for good, bad in [("ä", "Ã¤"), ("ö", "Ã¶"), ("ü", "Ã¼"), ("ß", sz)]:
        t = f"replace({t}, {q(good)}, {q(bad)})"
    return f"SELECT doc_id, {t} AS text, text AS original FROM documents"


view("v_mojibake_dict", [], _mojibake("ÃŸ"))
view("v_mojibake_latin1", [], _mojibake("Ã\u009f"))

view("v_scores", [], """
    SELECT doc_id,
           CASE WHEN (doc_id + k) % 5 = 0 THEN 'x' ELSE CAST((doc_id + k) % 5 AS VARCHAR) END AS token,
           -((doc_id * 7 + k * 13) % 97) / 50.0 - k / 1000.0 AS logprob
    FROM (SELECT doc_id, unnest(range(1, 5)) AS k FROM documents)""")


view("v_coded", [], """
    SELECT doc_id, CASE lang WHEN 'en' THEN 'eng' WHEN 'de' THEN 'ger' ELSE lang END AS language, text,
           CASE WHEN toxic = 1 THEN 2 WHEN quality = 1 THEN 1 ELSE 3 END AS code
    FROM documents JOIN labels USING (doc_id)""")


def _facts_sheet(country: str) -> str:
    i = FX.COUNTRIES.index(country)
    sel = "(s_suppkey // 4)"
    cols = {
        "name": "s_name",
        "url": "'http://src' || CAST(s_suppkey % 20 AS VARCHAR) || '.example.org/'",
        "elite": pick(FX.ELITE_VALUES, f"{sel} % 6"),
        "type": pick(FX.TYPE_VALUES, f"{sel} % 4"),
        "founding_year": "CAST(s_suppkey + 1900 AS BIGINT)",
        "student_size_n": "CAST(floor(s_acctbal) AS DOUBLE)",
        "international_per": "CASE WHEN s_suppkey % 9 = 0 THEN NULL ELSE s_acctbal / 100 END",
        "nation": "'r' || CAST(s_nationkey AS VARCHAR)",
        "phone": "'0' || CAST(s_suppkey AS VARCHAR)",
    }
    sel_list = ", ".join(f"{cols[c]} AS {c}" for c in FX.FACT_COLUMNS[country])
    return f"SELECT {sel_list} FROM supplier WHERE s_suppkey % 4 = {i}"


for _c in FX.COUNTRIES:
    view(f"v_facts_{_c}", [], _facts_sheet(_c))

view("v_ratings", [], """
    SELECT l.doc_id,
           CAST(quality + 1 AS BIGINT) AS llm,
           CAST(toxic + 1 AS BIGINT) AS coder_a,
           CAST(CASE WHEN l.doc_id % 13 = 0 THEN NULL WHEN n_chars > 2000 THEN 4
                     ELSE l.doc_id % 3 + 1 END AS BIGINT) AS coder_b,
           'http://' || source || '.example.org/' || CAST(l.doc_id // 200 AS VARCHAR) AS url,
           lang AS country
    FROM labels l JOIN documents d ON l.doc_id = d.doc_id""")

view("v_report", [], """
    SELECT c_mktsegment AS country,
           CASE WHEN c_custkey % 11 = 0 THEN NULL WHEN c_custkey % 13 = 0 THEN 0.0
                ELSE c_acctbal END AS number,
           c_nationkey % 2 = 0 AS flag
    FROM customer""")


def with_views(names: list[str], body: str) -> str:
    order: list[str] = []

    def add(n: str) -> None:
        if n in order:
            return
        for d in VIEWS[n][0]:
            add(d)
        order.append(n)

    for n in names:
        add(n)
    if not order:
        return body
    ctes = ",\n".join(f"{n} AS ({VIEWS[n][1]})" for n in order)
    stripped = body.lstrip()
    if stripped[:4].upper() == "WITH":      # merge the body's own CTEs
        return f"WITH {ctes},\n{stripped[4:]}"
    return f"WITH {ctes}\n{body}"
