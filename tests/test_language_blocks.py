"""Trigrams as numbers, counted in blocks of texts."""

import tracemalloc
from collections import Counter

from pyspark.sql import functions as F

from webtext.operators import language as L

TEXTS = [("en", "the cat 😀 sat"), ("en", "ab\0"), ("en", ""), ("en", None), (None, "xyz"), ("de", " İ \x1f x  y"), ("de", "日本語 und 日本語")]


def counted(texts):
    """The same counts by code points."""
    out = Counter()
    for lang, text in texts:
        t = f" {' '.join((text or '').lower().split(' '))} "
        t = " ".join(x for x in t.split(" ") if x)
        if lang and text:
            out.update((lang, f" {t} "[i:i + 3]) for i in range(len(t)))
    return out


def test_profiles_by_code_point(spark, monkeypatch):
    df = spark.createDataFrame(TEXTS, "lang string, text string")
    got = {(r.lang, r.gram): r.n for r in L.language_profiles(df).collect()}
    assert got == counted(TEXTS)


def test_blocks_hold_every_trigram(monkeypatch):
    texts = ["", None, "ab", "abc", "x" * 5 + "yz" * 40, "abcd", "é😀日本"]
    want = [(i, t[j:j + 3]) for i, t in enumerate(texts) for j in range(len(t or "") - 2)]
    for size in (3, 7, 50, 1 << 19):
        monkeypatch.setattr(L, "BLOCK", size)
        assert [(r, g) for rows, grams in L._blocks(texts) for r, g in zip(rows.tolist(), L._gram_texts(grams))] == want



def test_rows_scored_in_blocks_as_by_the_join(spark, monkeypatch):
    train = spark.createDataFrame([("en", "the cat sat on the mat"), ("de", "die Katze saß auf der Matte 😀"), ("fr", "le chat")],
                                  "lang string, text string")
    texts = ["the cat", "die  Katze", "le chat", "", None, "  ", "日本", "a", "the Katze", "die 😀 Matte", "the cat " * 300,
             "die Katze " * 9 + "the cat", "x", "the cat"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    prof, langs = L.language_profiles(train).localCheckpoint(), ["de", "en", "fr"]
    joined = L.detect_language(df, prof, langs, "id", unique=True)
    want = {r.id: (r.detected, r.language) for r in joined.collect()}
    assert want[0] == ("en", "eng") and want[1] == ("de", "ger") and want[4] == (None, "Other") and want[6] == (None, "Error")

    def blocks():
        out = L.detect_in_blocks(df, prof, langs, "id")
        return out.columns, {r.id: (r.detected, r.language) for r in out.collect()}

    assert blocks() == (joined.columns, want)
    monkeypatch.setattr(L, "MAX_BROADCAST_BYTES", 0)
    assert blocks() == (joined.columns, want)


def test_a_chain_row_is_detected_once(spark):
    """No row per trigram, no exchange and no join behind the rows of the keyword filter."""
    from webtext.plans.registry import QUERIES
    plan = QUERIES["study_texts"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Join" not in plan and "Exchange" not in plan


def test_white_space_is_collapsed_in_blocks(spark, monkeypatch):
    texts = [" a  \t b\r\n\u0085c ", " 　 ", "  ", " x\x1f\x1c y​᠎ z ", "      \x0b\x0cq ",
             " é 😀  \t 日 " * 9, " \t ", " end\n "]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    plain = {r.id: r.t for r in df.select("id", L.padded(F.col("text")).alias("t")).collect()}
    want = [(i, plain[i][j:j + 3]) for i in range(len(texts)) for j in range(len(plain[i]) - 2)]
    for size in (3, 7, 50, 1 << 19):
        monkeypatch.setattr(L, "BLOCK", size)
        assert [(r, g) for rows, grams in L._blocks(texts) for r, g in zip(rows.tolist(), L._gram_texts(grams))] == want
        counts = Counter()
        for grams, n in L._blocks(texts, L._gram_counts):
            counts.update(dict(zip(L._gram_texts(grams), n.tolist())))
        assert +counts == Counter(g for _, g in want)


def test_training_and_scoring_search_no_white_space(spark):
    """A text goes to the arrays as it is; whether it is blank is told by its first other character."""
    df = spark.createDataFrame([(1, "en", "the cat sat on the mat"), (2, "de", "   "), (3, "en", None),
                                (4, "de", " die  Katze saß auf der Matte ")], "id int, lang string, text string")
    prof = L.language_profiles(df)
    found = L.detect_in_blocks(df, prof.localCheckpoint(), ["de", "en"], "id")
    for plan in (prof, found):
        assert "regexp_replace" not in plan._jdf.queryExecution().executedPlan().toString()
    assert {r.id: r.language for r in found.collect()} == {1: "eng", 2: "Other", 3: "Other", 4: "ger"}


def test_profile_is_turned_into_numbers_in_parts(spark):
    """The driver holds the arrays that it broadcasts, 32 bytes a trigram here, and twice that at most in all."""
    n = 1 << 17
    gram = F.concat(*[F.char(33 + F.shiftright("id", shift) % 64) for shift in (0, 6, 12)])
    prof = spark.range(n).select(gram.alias("gram"), F.lit(-5.0).alias("lp_de"), (-10 * F.col("id") / n).alias("lp_en"))
    prof = prof.localCheckpoint()
    best = L._detector(spark, prof, ["de", "en"], 0.9)
    tracemalloc.start()
    try:
        L._detector(spark, prof, ["de", "en"], 0.9)
        assert tracemalloc.get_traced_memory()[1] < 90 * n
    finally:
        tracemalloc.stop()
    df = spark.createDataFrame([("!!!",), ("``@",), ("~~~",)], "text string")
    assert [r[0] for r in df.select(best("text")).collect()] == ["en", "de", None]
