import hashlib

import numpy as np

from webtext.llm import lines as l
from webtext.llm.phash import PerfectHash


def test_perfect_hash():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 63, 1000, 20000):
        keys = np.unique(rng.integers(0, 2 ** 64, n, dtype=np.uint64))
        h = PerfectHash.from_bytes(PerfectHash.build(keys).to_bytes())
        assert sorted(h.numbers(keys)) == list(range(len(keys)))
        other = h.numbers(rng.integers(0, 2 ** 64, 500, dtype=np.uint64))
        assert ((other >= -1) & (other < max(1, len(keys)))).all()


def test_index_answers_and_rejects():
    rng = np.random.default_rng(1)
    hashes = np.unique(rng.integers(-2 ** 63, 2 ** 63, 5000))
    counts, last = rng.integers(1, 99, len(hashes)), rng.integers(-9, 9, len(hashes))
    index = l.LineIndex.from_row(*l.LineIndex.build(hashes, counts, last).to_row())
    c, m = index.probe(hashes)
    assert (c == counts).all() and (m == last).all()
    c, _ = index.probe(rng.integers(-2 ** 63, 2 ** 63, 5000))
    assert (c == 0).all()
    assert (l.LineIndex.build(*[np.empty(0, np.int64)] * 3).probe(hashes)[0] == 0).all()


def key(line):
    s = line.strip(" \t\n\x0b\x0c\r")
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def brute(rows):
    holders = {}
    low = -(2 ** 63)
    for i, (d, t) in enumerate(rows):
        for k in {key(x) for x in (t or "").split("\n")}:
            if len(k) >= 20:
                holders.setdefault(k, []).append(low if d is None else d)
    out = []
    for d, t in rows:
        ls = (t or "").split("\n")
        kept = [x for x in ls if not (len(holders.get(key(x), [])) >= 3 and max(holders[key(x)]) > (low if d is None else d))]
        out.append((d, len(ls), len(ls) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def test_against_brute_force(edge, sample, none, monkeypatch):
    for df in (edge, sample):
        rows = [(r.doc_id, r.text) for r in df.collect()]
        assert sorted((tuple(r) for r in l.dedup_lines(df).collect()), key=repr) == brute(rows)
    assert l.dedup_lines(none).count() == 0
    monkeypatch.setattr(l, "HOT", 10)       # many lines are hot now: the same answers from the other index
    rows = [(r.doc_id, r.text) for r in sample.collect()]
    assert sorted((tuple(r) for r in l.dedup_lines(sample).collect()), key=repr) == brute(rows)


def test_text_lengths_count_code_points(spark):
    line = "é" * 19
    df = spark.createDataFrame([(i, line + ("é" if i < 3 else "")) for i in range(6)], "doc_id long, text string")
    assert {r.doc_id: r.n_dropped for r in l.dedup_lines(df).collect()} == {0: 1, 1: 1, 2: 0, 3: 0, 4: 0, 5: 0}


def test_stage_keeps_columns(edge, sample):
    out = l.without_repeated_lines(edge)
    assert out.schema == edge.schema and out.count() == edge.count()
    assert out.filter("doc_id = 2 and text is null").count() == 1
    kept = {r.doc_id: hashlib.sha256(r.kept_text.encode()).hexdigest() for r in l.dedup_lines(sample).collect()}
    rows = l.without_repeated_lines(sample).collect()
    assert all(hashlib.sha256(r.text.encode()).hexdigest() == kept[r.doc_id] and r.n_chars == len(r.text) for r in rows)
