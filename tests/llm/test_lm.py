import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from webtext.llm import lm
from webtext.llm.eliasfano import EliasFano, MappedTrie, decades, quantise, restore


def test_elias_fano():
    rng = np.random.default_rng(0)
    for n, u in [(0, 5), (1, 1), (1000, 2 ** 62), (5000, 4000), (300, 2 ** 40), (2000, 2 ** 64 - 1)]:
        v = np.sort(rng.integers(0, u, n, dtype=np.uint64))
        e = EliasFano(np.frombuffer(EliasFano.encode(v), np.uint8))
        assert (e.at(np.arange(n)) == v).all()
        asked = np.concatenate([v, rng.integers(0, u, 500, dtype=np.uint64), np.array([0, 2 ** 64 - 1], np.uint64)])
        place, there = e.successor(asked)
        assert (place == np.searchsorted(v, asked)).all() and (there == np.isin(asked, v)).all()


def test_an_opened_sequence_stays_mapped(tmp_path):
    """Opening and asking keep no copy: a million values, under 6 MB on disk, ask for
    less than 0.1 MB on opening."""
    import tracemalloc
    v = np.sort(np.random.default_rng(1).integers(0, 2 ** 45, 1_000_000, dtype=np.uint64))
    raw = EliasFano.encode(v)
    assert len(raw) < 1_000_000 * (2 + 26 + 1) / 8
    (tmp_path / "level").write_bytes(raw)
    mapped = np.memmap(tmp_path / "level", np.uint8, "r")
    tracemalloc.start()
    e = EliasFano(mapped)
    opened = tracemalloc.get_traced_memory()[0]
    place, there = e.successor(v[::50_000])
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert opened < 100_000 and held < 200_000 and there.all() and (v[place] == v[::50_000]).all()
    for part in (e.ones, e.zeros, e.bits, e.lows):
        assert np.shares_memory(part, mapped)


def test_shards_by_tokens(sample):
    rows = lambda **k: sorted((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6))
                              for r in lm.score(sample, size=20000, **k).collect())
    assert rows(shard_tokens=3000) == rows()


def test_codes_round_down():
    p = 10.0 ** np.linspace(-7.9, 0, 500)
    r = restore(quantise(p))
    assert (r <= p * (1 + 1e-9)).all() and (r > p * 0.92).all() and restore(np.zeros(1, np.uint8))[0] == 0


def test_trie():
    words = np.array([5, 9, 2 ** 63], np.uint64)
    key = np.array([(0 << 40) | 7, (0 << 40) | 9, (2 << 40) | 7], np.uint64)
    with MappedTrie(words, np.array([3, 4, 5]), np.array([0, 2, 2, 3]), key, np.array([10, 20, 30])) as t:
        assert t.find(np.array([9, 6, 2 ** 63], np.uint64)).tolist() == [1, -1, 2]
        assert t.n_children(np.array([0, 1, 2, -1])).tolist() == [2, 0, 1, 0]
        assert t.child_codes(np.array([0, 0, 1, 2, -1]), np.array([9, 8, 7, 7, 7], np.uint64)).tolist() == [20, 0, 0, 30, 0]


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def words(t):
    return lower(t or "").encode().split() + [None]


def brute(rows):
    c, pairs, followers = Counter(), Counter(), defaultdict(set)
    for d, t in rows:
        if not lm.held_out(d):
            w = words(t)
            c.update(w)
            pairs.update(zip([None, *w], w))
    for a, b in pairs:
        followers[a].add(b)
    n, v = sum(c.values()), len(c)
    out = []
    for d, t in rows:
        w = words(t)
        base = sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w)
        total = 0.0
        for a, b in zip([None, *w], w):
            back = lm.DISCOUNT * len(followers[a]) / c[a] if c[a] else 1.0
            total += math.log10((max(pairs[a, b] - lm.DISCOUNT, 0) / c[a] if c[a] else 0) + back * (c[b] + 1) / (n + v + 1))
        out.append((d, lm.held_out(d), len(w), sum(c[x] > 0 for x in w), n, base, total))
    return sorted(out, key=lambda r: repr(r[:5]) + f"{r[5]:.3f}")


@pytest.mark.parametrize("hot", [1000, 20])
def test_against_brute_force(edge, sample, hot):
    for df, size in ((edge, lm.CHUNK), (sample, 20000)):
        got = sorted((tuple(r) for r in lm.score(df, size=size, hot_share=hot).collect()), key=lambda r: repr(r[:5]) + f"{r[5]:.3f}")
        want = brute([(r.doc_id, r.text) for r in df.collect()])
        assert [g[:5] for g in got] == [w[:5] for w in want]
        for g, w in zip(got, want):
            assert g[5] == pytest.approx(w[5], abs=1e-6)
            # codes round down by at most 0.0315 (log10) a token
            assert w[6] - 0.033 * w[2] <= g[6] <= w[6] + 1e-6


def test_empty_and_untrained(spark, none):
    assert lm.score(none).count() == 0
    held = [i for i in range(60) if lm.held_out(i)][:3]
    df = spark.createDataFrame([(i, "some words") for i in held], "doc_id long, text string")
    assert {(r.n_known, r.train_tokens, r.base_score, r.score) for r in lm.score(df).collect()} == {(0, 0, 0.0, 0.0)}


def test_beats_words_alone_on_held_out_text(sample):
    rows = [r for r in lm.score(sample).collect() if r.held_out]
    assert len(rows) > 15 and sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_codes_of_rare_pairs_round_down():
    p = 10.0 ** np.linspace(-11, 0, 700)
    reach = decades(p)
    r = restore(quantise(p, reach), reach)
    assert (r <= p * (1 + 1e-9)).all() and (r > p * 0.9).all()
    assert (restore(quantise(p)) <= p * (1 + 1e-9)).all()
    assert decades(np.array([0.5])) == 8.0 and decades(np.array([])) == 8.0


def test_a_pair_seen_once_after_a_very_frequent_word():
    """c(h) of 3e8 tokens, as at 30 GB, comes with the hot words."""
    import pyarrow as pa
    numbers = {w: i for i, w in enumerate([b"hot", b"rare", None])}
    batch = lm._chunk([1], [False], [3], numbers, [np.array([0, 1, 2], "<u4")])
    word = lm.xxhash.xxh64_intdigest(b"hot", 0)
    layout = lm.Layout(batch.to_pylist()[0], np.array([word], np.uint64), 1)
    t = pa.table({"chunk": ["c"], **{n: pa.array([x], pa.binary()) for n, x in zip(lm._MESSAGE, layout.message(0))}})
    hot = {int(np.array([word], np.uint64).view(np.int64)[0]): 3 * 10 ** 8}
    (_, _, _, codes, reach, *_), = lm.answer(t, hot, 0)
    got = restore(np.frombuffer(codes, np.uint8), reach)[layout.of_shard(0)[1].argsort()]
    first = layout.vocabulary[layout.first] == word
    assert 0.9 * 0.25 / 3e8 < got[first][0] <= 0.25 / 3e8
