"""Line-first cleaning rules (operator 6), DataFrame functions only.

Each line is judged first, by punctuation, navigation and boilerplate rules;
lines that fail are taken out, and a document that loses too much of its text
is rejected.  Before that come the base counts that any rule set needs.

Everything stays within a row: no join, no shuffle, no Python.  Repeated word
windows are found by sorting window hashes inside the row, so a very long
document costs n log n; most documents hold no repeated window and skip that.

Defined results: a null, empty or all-white text has no words, which fails the
base rule (fewer than ``MIN_WORDS`` words), so it is not kept; a text without
line breaks is one line.  The rules know the menus and notices of four languages
(``NAVIGATION``, ``NOTICES``); the other rules need no words.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_WORDS = 50
#: Base rule: at most so many in a hundred words lie in repeated 3-word windows.
MAX_REPEAT_PERCENT = 50
#: A document is rejected when its failing lines hold more than this share of its word characters.
MAX_LOST_PERCENT = 50
#: A line with more than this share of symbols among its word characters fails.
MAX_SYMBOL_PERCENT = 10
#: A line of at least ``BARE_WORDS`` words needs a mark, and one for each ``MAX_BARE_WORDS`` words.
BARE_WORDS, MAX_BARE_WORDS = 8, 100
#: Navigation entries without a mark stand on lines of at most so many words,
#: boilerplate notices on lines of at most so many.
NAVIGATION_WORDS, NOTICE_WORDS = 16, 40

_WS = r"[\x20\x09-\x0D]+"
_SYMBOL = r"[#*$%&|<>]"
#: Marks of clauses and sentences in Latin, Greek, Arabic, Indic and East Asian writing.
_SENTENCE_MARK = (r"[.!?;:,\x{2026}\x{037E}\x{0387}\x{060C}\x{061B}\x{061F}\x{06D4}\x{0964}\x{0965}"
                  r"\x{3001}\x{3002}\x{FF0C}\x{FF1A}\x{FF1B}\x{FF01}\x{FF1F}]")
#: Bars, arrows, bullets and chevrons between short entries.
_NAVIGATION_MARK = r"[|\x{00B7}\x{00BB}\x{00AB}\x{203A}\x{2039}\x{2192}\x{2022}]"

# --- fixed values: entries of menus and words of notices, by language ------
NAVIGATION = {
    "en": ["home", "menu", "search", "log ?in", "log ?out", "sign (in|up|out)", "register", "next( page)?",
           "previous( page)?", "back to top", "skip to (main )?content", "read more", "share( this)?", "contact( us)?",
           "about( us)?", "jobs", "careers", "imprint", "privacy", "terms", "sitemap", "help", "news", "faq", "blog", "shop"],
    "de": ["startseite", "menü", "suche", "suchen", "anmelden", "abmelden", "registrieren", "weiter", "zurück",
           "nach oben", "zum inhalt( springen)?", "mehr (lesen|erfahren)", "weiterlesen", "teilen", "kontakt",
           "über uns", "karriere", "impressum", "datenschutz", "datenschutzerklärung", "agb", "hilfe", "aktuelles"],
    "fr": ["accueil", "rechercher?", "connexion", "(se )?déconnecter", "s'inscrire", "suivant", "précédent",
           "haut de page", "aller au contenu", "lire la suite", "en savoir plus", "partager", "contactez-nous",
           "à propos", "qui sommes-nous", "emplois?", "mentions légales", "confidentialité", "plan du site", "aide",
           "actualités"],
    "es": ["inicio", "menú", "buscar", "iniciar sesión", "cerrar sesión", "registrarse", "siguiente", "anterior",
           "volver arriba", "ir al contenido", "leer más", "compartir", "contacto", "contáctenos", "sobre nosotros",
           "quiénes somos", "empleo", "aviso legal", "privacidad", "mapa del sitio", "ayuda", "noticias"],
}
NOTICES = {
    "en": ["all rights reserved", "cookie (policy|settings|notice)", "we use cookies", "uses cookies", "accept (all )?cookies",
           "privacy policy", "terms (of use|of service|and conditions)", "enable javascript", "subscribe to our", "lorem ipsum"],
    "de": ["alle rechte vorbehalten", "verwende(n|t) cookies", "nutz(en|t) cookies", "cookies? (akzeptieren|zulassen)",
           "cookie-(richtlinie|einstellungen|hinweis)", "datenschutzerklärung", "allgemeine geschäftsbedingungen",
           "nutzungsbedingungen", "javascript aktivieren", "newsletter abonnieren"],
    "fr": ["tous droits réservés", "utilis(e|ons) des cookies", "(accepter|gérer) les cookies", "mentions légales",
           "politique de (confidentialité|cookies)", "conditions générales", "conditions d'utilisation", "activer javascript",
           "abonnez-vous à notre"],
    "es": ["todos los derechos reservados", "utiliza(mos)? cookies", "usa(mos)? cookies", "aceptar (las )?cookies",
           "política de (privacidad|cookies)", "aviso legal", "términos y condiciones", "condiciones de uso",
           "habilit(e|ar) javascript", "suscríbe(te|se) a nuestr"],
}
# --- end of fixed values ----------------------------------------------------


def _any(lists: dict[str, list[str]]) -> str:
    return "(?:" + "|".join(x for words in lists.values() for x in words) + ")"


#: Nothing but menu entries, however they are set apart.
_BETWEEN = r"[\s|/\x{00B7}\x{00BB}\x{00AB}\x{203A}\x{2039}\x{2192}\x{2022}\x{2013}-]"
_NAVIGATION_LINE = f"(?iu)^{_BETWEEN}*{_any(NAVIGATION)}(?:{_BETWEEN}+{_any(NAVIGATION)})*{_BETWEEN}*$"
_BOILERPLATE = rf"(?iu)(?<!\pL){_any(NOTICES)}"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once per row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, _WS), lambda w: w != "")


def _covered(repeated: Column) -> Column:
    """Words under 3-word windows that start at the ascending places ``repeated``."""
    n = F.size(repeated)
    gaps = F.aggregate(F.sequence(F.lit(1), n - 1), F.lit(0).cast("long"),
                       lambda acc, i: acc + F.least(F.lit(3), F.get(repeated, i) - F.get(repeated, i - 1)))
    return F.when(n == 0, F.lit(0).cast("long")).when(n == 1, F.lit(3).cast("long")).otherwise(gaps + 3)


def repeat_words(words: Column) -> Column:
    """Words in 3-word windows that stand twice or more in the list, first included."""
    def of(w: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), F.size(w) - 3),
                              lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
        return let(windows, repeated)

    def repeated(h: Column) -> Column:
        placed = F.sort_array(F.arrays_zip(h.alias("h"), F.sequence(F.lit(0), F.size(h) - 1).alias("i")))
        places = let(placed, lambda s: F.array_sort(F.filter(
            F.transform(s, lambda x, k: F.when(
                (x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"]), x["i"])),
            lambda x: x.isNotNull())))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(let(places, _covered))

    return F.when(F.size(words) < 4, F.lit(0).cast("long")).otherwise(let(words, of))


def line_fails(x: Column) -> Column:
    """Punctuation, navigation and boilerplate rules for one parsed line; the
    cheap conditions stand before the patterns that they spare."""
    line, n = x["line"], x["n"]
    bars = F.regexp_count(line, F.lit(_NAVIGATION_MARK))
    marks = F.regexp_count(line, F.lit(_SENTENCE_MARK))
    shouts = F.regexp_count(line, F.lit("!!"))
    return ((100 * x["symbols"] > MAX_SYMBOL_PERCENT * x["chars"])
            | ((n >= BARE_WORDS) & (marks * MAX_BARE_WORDS < n))
            | ((n >= 4) & line.contains("!!") & (4 * shouts > n))
            | ((bars >= 2) & (5 * bars > n))
            | ((n > 0) & (n <= NAVIGATION_WORDS) & line.rlike(_NAVIGATION_LINE))
            | ((n <= NOTICE_WORDS) & line.rlike(_BOILERPLATE)))


def _parsed(text: Column) -> Column:
    """The lines with their words; a text's words are its lines' words."""
    return F.transform(F.split(text, "\n"), lambda line: let(words_of(line), lambda w: F.struct(
        line.alias("line"), w.alias("words"), F.size(w).alias("n"),
        F.length(F.array_join(w, "")).alias("chars"),
        F.regexp_count(line, F.lit(_SYMBOL)).alias("symbols"))))


def _sum(lines: Column, field: str) -> Column:
    return F.aggregate(lines, F.lit(0).cast("long"), lambda acc, x: acc + x[field])


def measures(text: Column) -> Column:
    """All counts and the verdict on a text as one struct, worked out once."""
    text = F.coalesce(text, F.lit(""))

    def counts(lines: Column) -> Column:
        worded = F.transform(F.filter(lines, lambda x: x["n"] > 0), lambda x: x["line"])
        failing = F.filter(lines, line_fails)
        return F.struct(
            _sum(lines, "n").alias("n_words"), _sum(lines, "chars").alias("word_chars"),
            _sum(lines, "symbols").alias("n_symbols"),
            let(worded, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            repeat_words(F.flatten(F.transform(lines, lambda x: x["words"]))).alias("n_repeat_words"),
            _sum(failing, "chars").alias("lost_chars"))

    def verdict(c: Column) -> Column:
        failed = ((c["n_words"] < MIN_WORDS)
                  | (100 * c["n_repeat_words"] > MAX_REPEAT_PERCENT * c["n_words"]))
        kept = ~failed & (100 * c["lost_chars"] <= MAX_LOST_PERCENT * c["word_chars"])
        names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lost_chars"]
        return F.struct(*[c[n].alias(n) for n in names], failed.alias("base_failed"), kept.alias("kept"))

    return let(let(_parsed(text), counts), verdict)


def cleaned_text(text: Column) -> Column:
    """The lines that pass, joined by newlines."""
    return let(_parsed(F.coalesce(text, F.lit(""))), lambda lines: F.array_join(F.transform(
        F.filter(lines, lambda x: ~line_fails(x)), lambda x: x["line"]), "\n"))


def judge(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    lost_chars, base_failed, kept`` of every row; ``lost_chars`` are the word
    characters in failing lines (``cleaned_text`` gives the text without them)."""
    return docs.select("doc_id", measures(F.col("text")).alias("m")).select("doc_id", "m.*")


def keep_clean(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, without their failing lines; ``n_chars``,
    where there is such a column, is the length of what is left.  All other columns
    stay as they are; a document without a failing line stays as it is."""
    kept = docs.filter(let(measures(F.col("text")), lambda m: m["kept"])).withColumn("text", cleaned_text(F.col("text")))
    if "n_chars" not in docs.columns:
        return kept
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
