import re
import zlib
from collections import Counter

import numpy as np
import pytest

from webtext.llm import spelling as s


def one_apart(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[i + (len(a) == len(b)):] == b[i + 1:]


def brute(docs):
    n = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if h % 97 == 0:
                word = word[:h % len(word)] + word[h % len(word) + 1:]
            n[word] += 1
    n = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}
    near = {w: [v for v in n if one_apart(w, v)] for w in n}
    form = {}
    for w, vs in near.items():
        v = min(vs, key=lambda v: (-n[v], v), default=None)
        form[w] = v if v and n[v] >= 2 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return out


def got(df, **how):
    rows = [tuple(r) for r in s.variants(df, **how).select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("hot", [s.HOT, 1])
def test_equals_brute_force(sample, hot):
    few = sample.filter("doc_id < 60")
    want = brute([(r.doc_id, r.text) for r in few.collect()])
    assert len(want) > 300 and any(f for _, f, *_ in want)
    assert got(few, hot=hot) == want


def test_edge_cases(spark, edge, none):
    assert got(none) == set()
    assert got(edge) == brute([(r.doc_id, r.text) for r in edge.collect()])


def test_chains_ties_and_letters(spark):
    words = (["straße"] * 100 + ["strasse"] * 3 + ["strase"] * 5 + ["straßen"] * 40 + ["STRAßE"] * 4 + ["ÜberÀ"] * 3
             + ["Überà"] * 6 + ["hallo"] * 20 + ["hallu"] * 20 + ["halla"] * 10 + ["aaaaa"] * 9 + ["aaaaaa"] * 4 + ["b×÷cd"] * 3)
    docs = [(i, " ".join(words)) for i in (1, None, 7)] + [(None, None), (3, ""), (4, "x" * 50_000)]
    assert got(spark.createDataFrame(docs, "doc_id long, text string")) == brute(docs)


@pytest.mark.parametrize("hot", [0, 3, 10 ** 9])
def test_pairs_of_a_dense_vocabulary(spark, hot):
    """Words of few letters: most grams are shared by many, at every level."""
    rng = np.random.default_rng(3)
    words = sorted({"".join(rng.choice(list("abé"), k)) for k in rng.integers(1, 9, 500)})
    pairs = s.near_pairs(spark.createDataFrame([(w, 1) for w in words], "word string, n long"), hot).select("a", "b").collect()
    want = {frozenset((v, w)) for v in words for w in words if one_apart(v, w)}
    assert len(pairs) == len(want) and {frozenset(p) for p in pairs} == want
