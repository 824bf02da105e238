import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from webtext.llm import negatives as m
from webtext.llm.queries import op11_shared_list_negatives


def brute(rows):
    """``rows``: (vec_id, label, vector) -> the rows of the contract."""
    data = []
    for i, label, v in rows:
        if label is None or v is None or any(c is None or not math.isfinite(c) for c in v):
            continue
        if i is not None and i % 7 == 0:
            label = (label + 1) % 10
        data.append((i, label, [math.floor(256 * c) for c in v]))

    def dot(a, b):
        return sum(x * y for x, y in zip(a, b))

    least = -math.inf
    out = []
    for k, (i, label, v) in enumerate(data):
        if i is None or i % 100:
            continue
        scored = sorted((-dot(v, w), least if j is None else j, j, lab) for n, (j, lab, w) in enumerate(data) if n != k)
        for s, _, p, _ in [x for x in scored if x[3] == label][:5]:
            fits = [x for x in scored if x[3] != label and 80 * -s <= 100 * -x[0] <= 100 * -s]
            out += [(i, p, r + 1, x[2], -s, -x[0]) for r, x in enumerate(fits[:5])]
    return sorted(out, key=repr)


def got(spark, rows, **how):
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").repartition(3)
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    found = m.mine(m.quantised(df.withColumns({"label": moved, "block": F.lit(1), "grp": F.lit("x"), "aid": F.lit(2)})),
                   F.col("vec_id") % 100 == 0, **how)
    return sorted((tuple(r) for r in found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score",
                                                  "negative_score").collect()), key=repr)


def test_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(i, int(rng.integers(3)), [float(np.float32(x)) for x in rng.standard_normal(6) / 3]) for i in range(700)]
    assert got(spark, rows) == brute(rows) != []


def test_the_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()
    found = sorted((tuple(r) for r in op11_shared_list_negatives(spark, "/root/testdata/sf0.001").collect()), key=repr)
    assert found == brute([(r.vec_id, r.label, r.embedding) for r in table])


def test_copies_ties_nulls_and_odd_vectors(spark):
    same, twin = [0.5, 0.25, 0.0], [0.5, 0.25]
    rows = [(i, 1, same) for i in range(0, 40)] + [(i, 2, same) for i in range(40, 90)] + [(100, 1, twin), (100, 1, same),
            (100, 1, same), (200, 2, [0.0, 0.0, 0.0]), (300, None, same), (400, 1, None), (500, 1, [0.5, None, 0.1]),
            (600, 1, [0.5, float("nan"), 0.1]), (700, 1, [float("inf"), 0.0, 0.0]), (800, 1, []), (None, 1, same),
            (None, 2, [0.45, 0.25, 0.1]), (900, 1, [-0.5, -0.25, 0.0]), (1000, 3, [0.3, 0.3, 0.3]), (1001, 4, [200.0, 0.1, 0.0]),
            (1100, 4, [900.0, -0.2, 7.5]), (1102, 4, [1e6, 0.0, 1.0]), (1103, 5, [9e5, 0.0, 1.0]), (-100, 1, [0.4, 0.2, 0.0])]
    assert got(spark, rows) == brute(rows) != []


def test_many_groups_and_blocks(spark, monkeypatch):
    for name, value in (("GROUP", 3), ("BLOCK", 40), ("LEAST_BLOCK", 10), ("MEMBERS", 2), ("STRETCH", 8)):
        monkeypatch.setattr(m, name, value)
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((5, 8))
    rows = [(100 * i if i % 5 == 0 else i, int(rng.integers(4)),
             [float(np.float32(x)) for x in (centres[rng.integers(5)] + rng.standard_normal(8) / 8) / 4]) for i in range(300)]
    assert got(spark, rows) == brute(rows) != []


def test_walks_end_early_and_lose_nothing():
    """Members of a narrow cluster look at a part of their list only."""
    rng = np.random.default_rng(4)
    rows = rng.integers(-200, 200, (20_000, 8))
    anchors = np.array([300, 20, -10, 0, 50, 0, -90, 10]) + rng.integers(-9, 9, (50, 8))
    looked = set()

    def allowed(i, js):
        looked.update(js.tolist())
        return np.ones(len(js), bool)

    found = m.walk(anchors, rows, np.arange(len(rows)), 5, [[(-10 ** 9, 10 ** 9)]] * 50, allowed)
    for a, lists in zip(anchors, found):
        assert lists[0] == sorted(zip((-(rows @ a)).tolist(), range(len(rows))))[:5]
    assert len(looked) < len(rows) / 4


def test_empty_table(spark):
    assert got(spark, []) == []
    assert got(spark, [(100, 1, [0.5])]) == []


@pytest.mark.parametrize("big", [1.0, 1e8, 1e17])
def test_scores_are_exact(big):
    a, b = np.array([[int(3 * big), 1]]), np.array([[int(5 * big), 7], [int(5 * big), 8]])
    if big > 1e16:
        a, b = a.astype(object), b.astype(object)
    x, y = m._exact(a, b)
    assert [int(v) for v in (x @ y.T)[0]] == [int(a[0, 0]) * int(b[0, 0]) + 7, int(a[0, 0]) * int(b[0, 0]) + 8]
