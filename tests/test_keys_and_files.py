from pyspark.sql import functions as F

from webtext.operators import agreement, language, scores
from webtext.session import scratch_path
from webtext.sources import files


def test_empty_text_is_not_null_in_csv(spark):
    rows = [(1, "", 5), (2, None, None), (3, '"', 0), (4, " a\n,b ", 1), (5, "null", 2)]
    df = spark.createDataFrame(rows, "i int, t string, n int")
    for sep in (",", ";"):
        path = scratch_path(spark, "csv")
        files.write_csv(df, path, sep=sep)
        got = files.read_csv(spark, path, "i int, t string, n int", sep=sep)
        assert sorted(map(tuple, got.collect())) == rows
        both = files.read_csv(spark, path, "i int, t string, n int", sep=sep, empty_is_missing=True)
        assert {r.i for r in both.filter("t IS NULL").collect()} == {1, 2}


def test_row_index_of_hashed_and_tied_keys(spark):
    rows = [(None if i % 5 == 0 else f"p{i % 3}", ["x", "y", None][i % 3] if i % 2 else f"{i * 7919 % 1000:03}", i) for i in range(600)]
    df = spark.createDataFrame(rows, "part string, key string, tie int")
    want = {}
    for part in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == part), key=lambda r: (r[1] is not None, r[1] or "", r[2]))
        want.update({r[2]: i for i, r in enumerate(own, 1)})
    for n in (1, 8):
        got = scores.row_index_by(df.repartition(n), "part", ["key", "tie"])
        assert got.columns == ["part", "key", "tie", "index"]
        assert {r.tie: r["index"] for r in got.collect()} == want


def test_language_of_rows_without_a_key_of_their_own(spark):
    texts = {"en": "the house and the garden with the old trees", "de": "das haus und der garten mit den alten baeumen"}
    profiles = language.language_profiles(spark.createDataFrame([(t, k) for k, t in texts.items()], "text string, lang string"))
    df = spark.createDataFrame([(None, texts["en"]), (None, texts["de"]), (1, texts["de"]), (1, texts["en"]), (1, texts["en"]), (2, None)],
                               "doc_id long, text string")
    got = [(r.doc_id, r.text, r.language) for r in language.detect_language(df, profiles, ["de", "en"]).collect()]
    label = {texts["en"]: "eng", texts["de"]: "ger", None: "Other"}
    assert len(got) == 6 and all(found == label[text] for _, text, found in got)


def test_pair_counts_are_sorted(spark):
    df = spark.createDataFrame([(1, 2, 1), (1, 2, 1), (3, 1, 1), (2, 2, 2), (2, 2, None)], "a int, b int, c int")
    got = [tuple(r) for r in agreement.sorted_pair_counts(df, ["a", "b", "c"]).collect()]
    assert got[:3] == [("a", "b", "1", "2", 2), ("a", "b", "2", "2", 1), ("a", "b", "3", "1", 1)] and len(got) == 9
