import importlib

import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """Every stage's input and output as rows."""
    import corpus_pipeline as c
    docs, out = c.documents(spark, SF), []
    for name, stage in c.STAGES:
        done = c.saved(stage(spark, docs, SF), "test")
        out.append((name, docs, done))
        docs = done
    return out


def test_shape(spark, stages):
    import corpus_pipeline as c
    assert [n for n, _ in c.STAGES] == ["quality classifier", "quality rules", "line dedup", "simhash near-dedup", "packing"]
    columns = c.documents(spark, SF).columns
    assert all(done.columns == columns for _, _, done in stages[:-1])
    assert c.ORACLE_SQL is None


def test_against_brute_force(stages):
    from llm.test_lines import brute as lines
    from llm.test_quality_rules import brute as base
    from llm.test_simhash import brute as groups
    docs = {n: [(r.doc_id, r.text) for r in d.collect()] for n, d, _ in stages}
    done = {n: [(r.doc_id, r.text) for r in d.collect()] for n, _, d in stages[:-1]}
    # the classifier drops few, the rules never keep what fails the base rule
    assert 0 < len(docs["quality classifier"]) - len(done["quality classifier"]) < 0.4 * len(docs["quality classifier"])
    assert not any(base(t)[5] for _, t in done["quality rules"])
    assert sorted(done["line dedup"]) == sorted((d, t) for d, _, _, t in lines(docs["line dedup"]))
    assert sorted(d for d, _ in done["simhash near-dedup"]) == sorted({c for _, _, c in groups(docs["simhash near-dedup"])})
    assert sorted(docs["packing"]) == sorted(done["simhash near-dedup"])


def test_packing_holds_every_document(stages):
    _, docs, done = stages[-1]
    assert {r.doc_id for r in docs.collect()} == {r.doc_id for r in done.collect()}


def test_clean_documents_stay(spark, stages):
    good = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").filter("quality = 1").collect()}
    for name, before, after in stages[:2]:
        there = good & {r.doc_id for r in before.filter("length(text) > 600").collect()}
        assert len(there & {r.doc_id for r in after.collect()}) >= 0.95 * len(there), name


def test_registered(spark):
    q = importlib.import_module("__spark_entry__").queries()
    assert [n.split("_")[0] for n in q if n.startswith("op")] == [f"op{i}" for i in range(1, 14)]
    assert "pipeline" in q


CLASHING = "__key string, __id long, __drop string, __n int, `a.b` string, row string, key long, id string, drop int, n_chars long"


def clashing(spark, rows):
    """Rows of ``doc_id, text`` with columns named as operators name theirs."""
    return spark.createDataFrame([(i, t, "k", 5, "d", 7, "dot", "r", 8, "i", 9, -1) for i, t in rows],
                                 "doc_id long, text string, " + CLASHING)


def test_stages_leave_other_columns_alone(spark):
    import corpus_pipeline as c
    from llm.conftest import EDGE
    docs = clashing(spark, [x[:2] for x in EDGE] + [(None, "one two three"), (None, "four five six seven")])
    for name, stage in c.STAGES[:-1]:
        done = stage(spark, docs, SF)
        assert done.columns == docs.columns, name
        for r in done.collect():
            assert tuple(r)[2:-1] == ("k", 5, "d", 7, "dot", "r", 8, "i", 9), name
            assert r.n_chars in (-1, len(r.text or ""))


def test_all_stages_on_nulls_odd_columns_and_no_rows(spark):
    import corpus_pipeline as c
    many = [(None if i % 3 else i, f"Document {i} says that the " + " ".join(f"w{i}x{k}" for k in range(70)) + ".") for i in range(30)]
    for rows in ([*many, (None, None), (4, ""), (4, None)], []):
        docs = clashing(spark, rows)
        for name, stage in c.STAGES:
            docs = c.saved(stage(spark, docs, SF), "test")
        ids = {r.doc_id for r in docs.collect()}
        assert ids == ({None, *range(0, 30, 3)} if rows else set())
