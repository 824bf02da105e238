import math
import re

import pytest
from pyspark.sql import functions as F

from webtext.operators import classify as C, language as L

from conftest import rows

CODED = [("eng", "We each choose. We grow", 1), ("eng", "together we grow", 2), ("eng", "prices", 3),
         ("ger", "wir gemeinsam", 2), ("ger", "ich wachse", 1), (None, "we", 1), ("eng", "we", None), ("eng", None, 3)]
TEXTS = [(1, "eng", "We grow together, together"), (2, "eng", "unknown"), (3, "eng", None), (4, "ger", "ICH wachse"),
         (5, "fr", "nous"), (6, None, "we"), (7, "eng", "")]


def brute_force(language, text):
    """Log-probabilities of the three classes from the definition."""
    own = [(t or "", c) for lang, t, c in CODED if lang == language and c]
    if not own or language is None:
        return None
    words = lambda t: "".join(x if x.isalpha() else " " for x in t.lower()).split()
    vocab = {w for t, _ in own for w in words(t)}
    out = []
    for c in (1, 2, 3):
        seen = [w for t, k in own if k == c for w in words(t)]
        s = math.log((sum(k == c for _, k in own) + 1) / (len(own) + 3))
        s += sum(math.log((seen.count(w) + 1) / (len(seen) + len(vocab))) for w in words(text or "") if w in vocab)
        out.append(s)
    whole = math.log(sum(map(math.exp, out)))
    return [s - whole for s in out]


@pytest.mark.parametrize("limit", [64 << 20, -1])
def test_class_scores_by_definition(spark, monkeypatch, limit):
    monkeypatch.setattr(C, "MAX_BROADCAST_BYTES", limit)
    coded = spark.createDataFrame(CODED, "language string, text string, code int")
    df = spark.createDataFrame(TEXTS, "doc_id long, language string, text string")
    got = {}
    for r in C.class_scores(df, C.word_model(coded), C.priors(coded), ["doc_id"]).collect():
        got.setdefault(r.doc_id, {})[r.token] = r.logprob
    for key, lang, text in TEXTS:
        want = brute_force(lang, text)
        if want is None:
            assert key not in got
        else:
            assert [got[key][t] for t in "123"] == pytest.approx(want)


@pytest.mark.parametrize("words", [1, 3, 6])
def test_scores_by_frequent_and_other_words(spark, monkeypatch, words):
    """As many words are broadcast as fit in memory; those as frequent as the next one are joined."""
    coded = spark.createDataFrame([*CODED, ("eng", "we we grow we", 1)], "language string, text string, code int")
    df = spark.createDataFrame([*TEXTS, (8, "eng", "we choose prices unknown we " * 50)], "doc_id long, language string, text string")
    model, prior = C.word_model(coded).localCheckpoint(), C.priors(coded)

    def scores():
        return {(r.doc_id, r.token): r.logprob for r in C.class_scores(df, model, prior, ["doc_id"]).collect()}

    want = scores()
    assert C.split_model(model)[1] is None
    n, letters = model.count(), sum(len(r.word) for r in model.collect())
    monkeypatch.setattr(C, "MAX_BROADCAST_BYTES", (n * C.WORD_BYTES + 2 * letters) * words // n)
    frequent, rare = C.split_model(model)
    assert frequent.count() < words + 1 and frequent.count() + rare.count() == n
    assert rows(frequent.unionAll(rare)) == rows(model)
    got = scores()
    assert got.keys() == want.keys() and [got[k] for k in want] == pytest.approx([want[k] for k in want])


def test_model_small_in_files_only_is_not_broadcast_whole(spark, monkeypatch, tmp_path):
    """20,000 words take some 200 kB of files and 4 MB of the driver's memory."""
    word = F.concat(F.lit("w"), F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij"))
    path = str(tmp_path / "model")
    spark.range(20_000).select(F.lit("eng").alias("language"), word.alias("word"), *[
        F.when(F.col("id") < 500, -5.0).otherwise(-9.0).alias(f"lp_{c}") for c in C.CODES]).coalesce(1).write.parquet(path)
    model = spark.read.parquet(path)
    prior = spark.createDataFrame([("eng", -1.0, -1.0, -1.0)], "language string, p_1 double, p_2 double, p_3 double")
    df = spark.createDataFrame([(1, "eng", "wb wjjj wbaaaa")], "doc_id long, language string, text string")
    monkeypatch.setattr(C, "MAX_BROADCAST_BYTES", 1 << 20)
    assert sum(f.stat().st_size for f in (tmp_path / "model").iterdir()) < C.MAX_BROADCAST_BYTES
    got = C.class_scores(df, model, prior, ["doc_id"])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"SortMergeJoin \[language#\d+, word#", plan)
    assert C.split_model(model)[0].count() == 500
    assert [r.logprob for r in got.collect()] == pytest.approx([math.log(1 / 3)] * 3)


def test_no_rows_teach_nothing(spark):
    coded = spark.createDataFrame([], "language string, text string, code int")
    df = spark.createDataFrame(TEXTS, "doc_id long, language string, text string")
    assert C.class_scores(df, C.word_model(coded), C.priors(coded), ["doc_id"]).count() == 0


def test_fold_is_about_a_third(spark):
    n = spark.range(3000).filter(C.held_out(F.col("id"))).count()
    assert 800 < n < 1100


def test_undecided_language(spark):
    train = spark.createDataFrame([("en", "aaa bbb ccc"), ("de", "aaa bbb ddd")], "lang string, text string")
    df = spark.createDataFrame([(1, "aaa bbb"), (2, "ccc ccc ccc"), (3, "ddd ddd ddd")], "doc_id long, text string")
    prof = L.language_profiles(train)
    assert rows(L.detect_language(df, prof, ["de", "en"]), "doc_id", "language") == [(1, "Error"), (2, "eng"), (3, "ger")]
    # without a margin the tie is given to one of them
    assert rows(L.detect_language(df, prof, ["de", "en"], min_posterior=0.0), "doc_id", "language")[0][1] != "Error"
