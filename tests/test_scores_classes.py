from webtext.operators import classes as C, scores as S

from conftest import rows


def test_token_decoding(spark):
    df = spark.createDataFrame([(1, t, -0.1) for t in ["1", " 1", "1.0", "x", "4", None]],
                               "doc_id long, token string, logprob double")
    got = [r.label for r in S.decode_tokens(df).collect()]
    assert got == ["Individual", None, None, None, None, None]


def test_short_response_and_wide(spark):
    df = spark.createDataFrame([(1, "1", -0.1), (1, "2", -2.0), (2, "3", -0.5), (2, "1", -1.0),
                                (2, "2", -3.0), (2, "x", -4.0)],
                               "doc_id long, token string, logprob double")
    w = S.scores_wide(S.decode_tokens(S.topk_scores(df)))
    r = {x.doc_id: x for x in w.collect()}
    assert (r[1].token_1, r[1].token_2, r[1].token_3, r[1].linprob_3) == ("Individual", "Collective", None, None)
    assert (r[2].token_1, r[2].token_3, r[2].linprob_1) == ("Neutral/Irrelevant", "Collective", 60.65)


def test_confidence(spark):
    rows_ = spark.createDataFrame([(1,), (2,), (3,)], "doc_id long")
    wide = spark.createDataFrame([(1, "Individual", 50.0), (2, "Individual", 50.01), (3, "Collective", None)],
                                 "doc_id long, token_1 string, linprob_1 double")
    out = C.attach_scores(rows_, wide)
    assert rows(out, "doc_id", "token_1") == [(1, None), (2, "Individual"), (3, "Collective")]


def test_proportions(spark):
    piv = spark.createDataFrame([("a", 0, 0, 1), ("b", 0, 2, 0), ("c", 2, 0, 0), ("d", 1, 0, 0), ("e", 1, 3, 0)],
                                "domain string, Individual long, Collective long, `Neutral/Irrelevant` long")
    out = {r.domain: r.ind_coll_prop for r in C.domain_proportions(piv).collect()}
    assert out == {"a": None, "b": 1.0, "c": 1.0, "d": None, "e": 0.25}
    plain = {r.domain: r.ind_coll_prop for r in C.domain_proportions(piv, zero_is_one=False).collect()}
    assert plain["b"] == 0.0


def test_row_index_dense_per_part(spark):
    df = spark.createDataFrame([(k, "en" if k % 3 else "de") for k in range(1, 301)], "doc_id long, lang string")
    out = S.row_index(df, "lang", "doc_id", bucket_width=7)
    for lang in ("en", "de"):
        idx = [r["index"] for r in out.filter(f"lang = '{lang}'").orderBy("doc_id").collect()]
        assert idx == list(range(1, len(idx) + 1))
