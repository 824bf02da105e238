"""Models trained once and read again."""

import os

from pyspark.sql import functions as F

from webtext.operators import classify, language
from webtext.sources import files


def folders(base):
    return sorted(os.path.join(r, f) for r, _, fs in os.walk(base) for f in fs if f == "_SUCCESS")


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_trained_once_and_anew_for_other_rows(spark, tmp_path):
    src, base = str(tmp_path / "docs"), str(tmp_path / "models")
    spark.conf.set("spark.webtext.models", base)
    try:
        spark.createDataFrame([("en", "the cat"), ("de", "die Katze")], "lang string, text string").write.parquet(src)
        get = lambda d: files.stored_model(spark, language.language_profiles, d, "profiles")
        read = lambda: spark.read.parquet(src)
        first = get(read())
        assert rows(first) == rows(language.language_profiles(read())) and len(folders(base)) == 1
        assert first.inputFiles() == get(read()).inputFiles() and len(folders(base)) == 1
        # other rows of the same files, and another training on the same rows
        part = read().filter("lang = 'en'")
        assert rows(get(part)) == rows(language.language_profiles(part)) and len(folders(base)) == 2
        # a training that broke off is passed over
        os.remove(folders(base)[0])
        assert len(rows(get(read()))) and len(rows(get(part))) and len(folders(base)) == 2
        # more files
        spark.createDataFrame([("fr", "le chat")], "lang string, text string").write.mode("append").parquet(src)
        assert rows(get(read())) == rows(language.language_profiles(read())) and len(folders(base)) == 3
        assert get(read()).filter("lang = 'fr'").count() > 0
        coded = read().select(F.col("lang").alias("language"), "text", F.lit(classify.CODES[0]).alias("code"))
        model, prior = (files.stored_model(spark, t, coded, "m") for t in (classify.word_model, classify.priors))
        assert "word" in model.columns and "word" not in prior.columns and len(folders(base)) == 5
    finally:
        spark.conf.unset("spark.webtext.models")


def test_rows_without_files_are_trained_each_time(spark):
    d = spark.createDataFrame([("en", "the cat")], "lang string, text string")
    a, b = (files.stored_model(spark, language.language_profiles, d, "profiles") for _ in range(2))
    assert rows(a) == rows(b) == rows(language.language_profiles(d)) and a.inputFiles() != b.inputFiles()
