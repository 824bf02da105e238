"""HTML -> text elements, as native column expressions.

A page is turned into an array of ``struct<pos:int, tag:string, text:string>``
in document order, without a Python UDF and without a shuffle:

1. one regular expression finds comments, scripts, styles, the title and all
   tags, quoted attribute values included, and marks the structural ones
   (:func:`tokens`);
2. a fold over the structural tags keeps the stack of open elements and notes
   where each kept element (p, h1, h2, h3) begins and ends (:func:`spans`).  Tags
   close what the HTML 5 rules for them close: a block ends an open paragraph, a
   heading ends at a heading's end tag, list items and table cells end at the
   next one, an end tag without its element is nothing;
3. an element's text is that of its whole span, so nested elements count for
   every kept element around them.

Every step is linear in the length of the page, but for the depth of its nesting.
"""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import collapse_ws, let

# --- fixed values ---------------------------------------------------------
KEEP_TAGS = ["p", "h1", "h2", "h3"]          # elements extracted from a page
MIN_PARAGRAPH_LENGTH = 150                    # shorter paragraphs are dropped
NO_TITLE = "No title"                         # title when a page has none
HEADING_TAGS = ["h1", "h2", "h3"]
# --- end of fixed values --------------------------------------------------

_HEADINGS = ["h1", "h2", "h3", "h4", "h5", "h6"]
_CELLS, _SECTIONS = ["td", "th"], ["tbody", "thead", "tfoot"]
#: Elements whose tags open or close others (HTML 5 parsing rules).
STRUCTURE = [
    "address", "article", "aside", "blockquote", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt",
    "fieldset", "figcaption", "figure", "footer", "form", *_HEADINGS, "header", "hgroup", "hr", "li", "main", "menu",
    "nav", "ol", "p", "pre", "section", "summary", "ul", "table", "caption", *_SECTIONS, "tr", *_CELLS,
]
#: An end tag or an open paragraph does not reach beyond these.
_SCOPE = ["table", "caption", *_CELLS]

_BEGIN, _NAMED, _READY = "\u0001", "\u0002", "\u0003"
# What follows a tag's name: a ``>`` within a quoted value does not end it.
_REST = r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+"""
_NAME_ENDS = r"(?=[\s/>]|\z)"
_MARKUP = (
    r"(?is)<(?:!--(?:-?>|.*?(?:--!?>|\z))"
    rf"|(script|style){_NAME_ENDS}{_REST}>(?:.*?</\1{_NAME_ENDS}[^>]*+(?:>|\z)|.*+)"
    rf"|(title){_NAME_ENDS}{_REST}>(.*?)</title{_NAME_ENDS}[^>]*+(?:>|\z)"
    rf"|(/?)(?:({'|'.join(STRUCTURE)}){_NAME_ENDS}|[a-z]){_REST}>"
    rf"|/?[a-z]{_REST}\z"
    r"|[!?][^>]*+(?:>|\z)|/[^a-z>][^>]*+(?:>|\z)|/>)"
    r"|[\x{1}-\x{3}]")
#: What is no structural tag and no title leaves an empty mark behind.
_EMPTY = f"{_BEGIN}/?{_NAMED}{_READY}"


def tokens(html: Column) -> Column:
    """``array<struct<name, inner, text>>``: the text before the first structural
    tag, then each tag (``p``, ``/p``) with the text behind it.  A title is one
    token, with its raw content as ``inner``."""
    marked = F.regexp_replace(html, _MARKUP, f"{_BEGIN}$4$2$5{_NAMED}$3{_READY}")
    pieces = F.split(F.regexp_replace(marked, _EMPTY, " "), _BEGIN)

    def token(piece: Column, i: Column) -> Column:
        return F.struct(
            F.when(i > 0, F.lower(F.substring_index(piece, _NAMED, 1))).otherwise("").alias("name"),
            F.substring_index(F.substring_index(piece, _READY, 1), _NAMED, -1).alias("inner"),
            decode_entities(F.substring_index(piece, _READY, -1)).alias("text"))

    return F.transform(pieces, token)


#: For every open element: the place in the stack of the nearest element of a
#: kind at or below it, 0 if there is none.  kind -> (elements of the kind,
#: elements that hide those below them; None: all but the named).
_NEAREST = {
    "scope": (_SCOPE, []),
    "p": (["p"], _SCOPE),
    "heading": (_HEADINGS, _SCOPE),
    "li": (["li"], None),
    "dd": (["dd", "dt"], None),
    "row": (["tr", *_SECTIONS, "table"], []),
    "section": ([*_SECTIONS, "table"], []),
    "table": (["table"], []),
}
_SEEN_THROUGH = ["address", "div", "p"]       # by a list item that looks for the one before it
_OPEN = "struct<name:string,at:int," + ",".join(f"{k}:int" for k in _NEAREST) + ">"
_STATE = f"struct<open:array<{_OPEN}>,done:array<struct<at:int,tag:string,end:int>>>"


def _let(name: str, value: str, use: str) -> str:
    """``use`` with ``name`` standing for ``value``, which is worked out once."""
    return f"transform(array({value}), {name} -> {use})[0]"


def _in(values: list[str], name: str = "n") -> str:
    return f"{name} IN ({', '.join(map(repr, values))})"


def _nearest(kind: str, size: str) -> str:
    """Of the topmost of the first ``size`` elements."""
    return f"coalesce(get(s.open, {size} - 1).{kind}, 0)"


def _through(index: str, size: str) -> str:
    """Elements that stay when those from ``index`` on close."""
    return f"if({index} > 0, {index} - 1, {size})"


def _after_start() -> str:
    """How many elements stay open before ``<n>`` opens."""
    size = "size(s.open)"
    back_to = {kind: f"coalesce(nullif({_nearest(kind, size)}, 0), {size})" for kind in ("row", "section", "table")}
    first = f"""CASE WHEN n = 'li' THEN {_through(_nearest("li", size), size)}
                     WHEN {_in(["dd", "dt"])} THEN {_through(_nearest("dd", size), size)}
                     WHEN {_in(_CELLS)} THEN {back_to["row"]}
                     WHEN n = 'tr' THEN {back_to["section"]}
                     WHEN {_in(["caption", *_SECTIONS])} THEN {back_to["table"]} ELSE {size} END"""
    heading_on_top = f"{_in(_HEADINGS)} AND coalesce({_in(_HEADINGS, 'get(s.open, b - 1).name')}, false)"
    return _let("a", first, _let("b", _through(_nearest("p", "a"), "a"), f"if({heading_on_top}, b - 1, b)"))


def _after_end() -> str:
    """How many elements stay open after ``</n>``."""
    size = "size(s.open)"
    from_top = "CAST(array_position(reverse(transform(s.open, o -> o.name)), n) AS INT)"
    same = _let("f", from_top, f"if(f > 0, {size} - f + 1, 0)")
    reach = (f"if({_in(['table', 'caption', 'tr', *_SECTIONS, *_CELLS])}, {_nearest('table', size)}, "
             f"{_nearest('scope', size)} + 1)")
    return f"""CASE WHEN n = 'p' THEN {_through(_nearest("p", size), size)}
                    WHEN {_in(_HEADINGS)} THEN {_through(_nearest("heading", size), size)}
                    ELSE {_let("k", same, _through(f"if(k >= {reach}, k, 0)", size))} END"""


def _opened() -> str:
    """The entry of ``<n>`` on top of the first ``c`` elements."""
    places = []
    for kind, (own, hidden_by) in _NEAREST.items():
        below = _nearest(kind, "c")
        if hidden_by is None:
            below = f"if({_in(_SEEN_THROUGH)}, {below}, 0)"
        elif hidden_by:
            below = f"if({_in(hidden_by)}, 0, {below})"
        places.append(f"'{kind}', if({_in(own)}, c + 1, {below})")
    return f"named_struct('name', n, 'at', x.i, {', '.join(places)})"


def _closing(stays: str, end: str, pushed: str) -> str:
    """The state when elements beyond the first ``stays`` close before token ``end``."""
    gone = f"filter(slice(s.open, {stays} + 1, size(s.open)), o -> {_in(KEEP_TAGS, 'o.name')})"
    kept = f"transform({gone}, o -> named_struct('at', o.at, 'tag', o.name, 'end', {end}))"
    return (f"named_struct('open', concat(slice(s.open, 1, {stays}), {pushed}), "
            f"'done', {_let('g', kept, 'if(size(g) > 0, concat(s.done, g), s.done)')})")


def spans(toks: str) -> Column:
    """``array<struct<at, tag, end>>`` of the kept elements in document order: the
    tokens ``at`` to ``end - 1`` (from 0) belong to it.  ``toks`` names a
    materialised column of :func:`tokens`."""
    nothing = f"CAST(array() AS ARRAY<{_OPEN}>)"
    started = _let("n", "x.name", _let("c", _after_start(), _closing("c", "x.i", f"if(n = 'hr', {nothing}, array({_opened()}))")))
    ended = _let("n", "substring(x.name, 2)", _let("c", _after_end(), f"if(c = size(s.open), s, {_closing('c', 'x.i', nothing)})"))
    step = f"CASE WHEN x.name IN ('', 'title') THEN s WHEN startswith(x.name, '/') THEN {ended} ELSE {started} END"
    return F.expr(f"""array_sort(aggregate(
        transform({toks}, (t, i) -> named_struct('name', t.name, 'i', i)),
        CAST(named_struct('open', array(), 'done', array()) AS {_STATE}),
        (s, x) -> CAST({step} AS {_STATE}),
        s -> {_closing("0", f"size({toks})", nothing)}.done))""")


def page_title(toks: Column) -> Column:
    """Text of the first title, white space collapsed; ``No title`` when the page
    has no title, an empty one, or one that is not a single string (holds a tag)."""
    raw = F.get(F.filter(toks, lambda t: t["name"] == "title"), F.lit(0))["inner"]
    text = collapse_ws(decode_entities(raw))
    return F.when(raw.isNull() | (text == "") | raw.rlike("<[A-Za-z/!?]"), F.lit(NO_TITLE)).otherwise(text)


def raw_elements(toks: Column, places: Column) -> Column:
    """All candidate elements of a page, title first (pos 0), in document order:
    ``array<struct<pos:int, tag:string, text:string>>`` before the keep rule.
    ``toks`` and ``places``: materialised columns of :func:`tokens` and :func:`spans`."""
    def element(span: Column, i: Column) -> Column:
        own = F.slice(toks, span["at"] + 1, span["end"] - span["at"])
        return F.struct((i + 1).cast("int").alias("pos"), span["tag"].alias("tag"),
                        collapse_ws(F.array_join(F.transform(own, lambda t: t["text"]), " ")).alias("text"))

    title = F.struct(F.lit(0).alias("pos"), F.lit("title").alias("tag"), page_title(toks).alias("text"))
    return F.concat(F.array(title), F.transform(places, element))


# Character references.  The names are those of the standard library's HTML 5
# table: most end in a semicolon, some old ones also stand without it.
_WITHOUT_SEMICOLON = sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n))
# What the numbers 128 to 159 show, as in Windows pages; five of them stay controls.
_WINDOWS = {n: bytes([n]).decode("cp1252") for n in range(0x80, 0xA0) if n not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}


def _names() -> str:
    """SQL of first letter -> name -> characters: strings that the optimizer turns
    into a constant map."""
    by_letter: dict[str, list[str]] = {}
    for name in sorted(html5):
        by_letter.setdefault(name[0], []).append(f"{name}{_NAMED}{html5[name]}")

    def quoted(text: str) -> str:
        return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"

    return "map(" + ", ".join(f"'{letter}', str_to_map({quoted(_BEGIN.join(names))}, '{_BEGIN}', '{_NAMED}')"
                              for letter, names in by_letter.items()) + ")"


_NAMES = _names()


def _character(code_point: Column) -> Column:
    """The character of a code point; what is none becomes U+FFFD."""
    windows = F.expr("map(" + ", ".join(f"{n}, '{c}'" for n, c in _WINDOWS.items()) + ")")
    valid = code_point.between(1, 0xD7FF) | code_point.between(0xE000, 0x10FFFF)
    known = F.when(valid, code_point).otherwise(F.lit(0xFFFD))
    plain = F.decode(F.unhex(F.lpad(F.hex(known), 8, "0")), "UTF-32")
    return F.when(code_point.between(0x80, 0x9F), F.coalesce(F.try_element_at(windows, code_point.cast("int")), plain)).otherwise(plain)


def decode_entities(col: Column) -> Column:
    """Character references as characters, each once.  A name is looked up as
    written, with its semicolon; if there is none such, the longest old name that
    begins it counts.  Numbers may have any number of digits and no semicolon.
    What is no reference stays as it is."""
    names = F.expr(_NAMES)
    legacy = "^(" + "|".join(_WITHOUT_SEMICOLON) + ")"
    rest = lambda piece, ref: F.substring(piece, F.length(ref) + F.lit(1), F.length(piece))

    def numbered(piece: Column) -> Column:
        ref = F.regexp_extract(piece, r"^#(?:[xX][0-9A-Fa-f]+|[0-9]+);?", 0)
        hexadecimal = ref.rlike("^#[xX]")
        digits = F.regexp_replace(ref, "^#[xX]?0*|;$", "")
        code = (F.when(F.length(digits) > 7, F.lit(0))
                .when(hexadecimal, F.conv(digits, 16, 10).cast("bigint")).otherwise(F.concat(F.lit("0"), digits).cast("bigint")))
        return F.when(ref == "", F.concat(F.lit("&"), piece)).otherwise(
            F.concat(_character(F.coalesce(code, F.lit(0))), rest(piece, ref)))

    def named(piece: Column) -> Column:
        whole, begun = F.regexp_extract(piece, "^[A-Za-z][A-Za-z0-9]*;", 0), F.regexp_extract(piece, legacy, 1)
        bucket = F.try_element_at(names, F.substring(piece, 1, 1))

        def replaced(b: Column) -> Column:
            ref = F.when(F.try_element_at(b, whole).isNotNull(), whole).otherwise(begun)
            return let(ref, lambda r: F.coalesce(F.concat(F.try_element_at(b, r), rest(piece, r)), F.concat(F.lit("&"), piece)))

        return let(bucket, replaced)

    def decoded(piece: Column) -> Column:
        return (F.when(piece.startswith("amp;"), F.concat(F.lit("&"), F.substring(piece, F.lit(5), F.length(piece))))
                .when(piece.startswith("#"), numbered(piece)).otherwise(named(piece)))

    pieces = F.split(col, "&")
    all_of = F.array_join(F.transform(pieces, lambda p, i: F.when(i == 0, p).otherwise(decoded(p))), "")
    return F.when(col.contains("&"), all_of).otherwise(col)


def keep_rule(el: Column) -> Column:
    """Title always; paragraphs of >= 150 characters; non-empty headings."""
    n = F.length(el["text"])
    return ((el["tag"] == "title")
            | ((el["tag"] == "p") & (n >= MIN_PARAGRAPH_LENGTH))
            | (el["tag"].startswith("h") & (n > 0)))


def sort_by_text(elements: Column) -> Column:
    """Elements re-ordered by (text, pos) -- first step of per-page dedupe."""
    return F.array_sort(F.transform(
        elements, lambda e: F.struct(e["text"].alias("text"), e["pos"].alias("pos"),
                                     e["tag"].alias("tag"))))


def first_of_each_text(by_text: Column) -> Column:
    """From elements sorted by (text, pos), keep the first of every text and
    sort back by pos.  O(n log n) within the row, no shuffle.  ``by_text`` must
    be a materialised column (it is referenced inside the lambda)."""
    firsts = F.filter(by_text, lambda e, i: (i == 0) | (by_text[i - 1]["text"] != e["text"]))
    return F.array_sort(F.transform(
        firsts, lambda e: F.struct(e["pos"].alias("pos"), e["tag"].alias("tag"),
                                   e["text"].alias("text"))))


def drop_heading_runs(elements: Column) -> Column:
    """Drop a heading whose predecessor is a heading (one pass; the first
    heading of a run survives; the title is not a heading).  ``elements`` must
    be a materialised column (it is referenced inside the lambda)."""
    heads = F.array(*[F.lit(t) for t in HEADING_TAGS])
    return F.filter(elements, lambda e, i: ~(
        F.array_contains(heads, e["tag"]) & (i > 0)
        & F.array_contains(heads, elements[i - 1]["tag"])))
