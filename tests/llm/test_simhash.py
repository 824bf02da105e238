import numpy as np
import pytest
import xxhash

from webtext.llm import simhash as s
from webtext.llm.components import connected_components


def by_hand(text, k=4):
    w = (text or "").encode()
    w = bytes(c + 32 if 65 <= c <= 90 else c for c in w).split()
    if not w:
        return 0
    shingles = [b" ".join(w[i:i + k]) for i in range(len(w) - k + 1)] or [b" ".join(w)]
    hs = [xxhash.xxh64_intdigest(x, 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def components(fps, max_bits):
    up = list(range(len(fps)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i
    a = np.array(fps, np.uint64)
    for i, j in zip(*np.nonzero(np.bitwise_count(a[:, None] ^ a[None, :]) <= max_bits)):
        x, y = top(i), top(j)
        up[max(x, y)] = min(x, y)
    return [top(i) for i in range(len(fps))]


def test_fingerprint(sample):
    for t in ["", "a", "A b c", "a b c d", "a b c d e"] + [r.text for r in sample.limit(40).collect()]:
        assert s.simhash(t) == by_hand(t)


def test_spark_hash_is_the_same(spark):
    from pyspark.sql import functions as F
    got = spark.createDataFrame([("ünï code here now",)], "t string").select(F.xxhash64("t")).first()[0]
    assert got % 2 ** 64 == xxhash.xxh64_intdigest("ünï code here now".encode(), 42)


def clouds(seed, n, per, most):
    rng = np.random.default_rng(seed)
    out = set(rng.integers(0, 2 ** 64, n, dtype=np.uint64).tolist())
    for x in list(out)[: n // 3]:
        for _ in range(per):
            for b in rng.choice(64, rng.integers(1, most), replace=False):
                x ^= 1 << int(b)
            out.add(x)                     # a walk: chains of links
    return sorted(out)


@pytest.mark.parametrize("max_bits,segments,hot", [(4, 3, 8192), (4, 3, 4), (3, 4, 8192), (5, 2, 8192)])
def test_links_lose_no_component(spark, max_bits, segments, hot):
    fps = clouds(max_bits, 150, 8, max_bits + 3)
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    place = {x: i for i, x in enumerate(signed)}
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    up = list(range(len(fps)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i
    for r in s.links(df, max_bits, segments, hot).collect():
        i, j = place[r.a], place[r.b]
        assert (fps[i] ^ fps[j]).bit_count() <= max_bits
        x, y = top(i), top(j)
        up[max(x, y)] = min(x, y)
    assert [top(i) for i in range(len(fps))] == components(fps, max_bits)


def test_dense_bucket(spark):
    """Thousands of fingerprints in one bucket: a forest, not all pairs."""
    rng = np.random.default_rng(5)
    fps = np.unique(rng.integers(0, 1 << 11, 1500, dtype=np.uint64))      # within 11 bits, one segment
    df = spark.createDataFrame([(int(x),) for x in fps], "fp long")
    rows = s.links(df, hot=256).collect()
    assert len(rows) < 60 * len(fps)
    assert len({r.root for r in connected_components(s.links(df, hot=256)).collect()}) == len(set(components(fps.tolist(), 4)))


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(1000, 1000 + i) for i in range(1, 60)] + [(7, 7)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{1000 + i: 1000 for i in range(60)}}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute(rows):
    fps = sorted({by_hand(t) for _, t in rows})
    root = dict(zip(fps, components(fps, 4)))
    least = {}
    for d, t in rows:
        if d is not None:
            r = root[by_hand(t)]
            least[r] = min(least.get(r, d), d)
    return sorted(((d, by_hand(t), least.get(root[by_hand(t)])) for d, t in rows), key=repr)


def test_against_brute_force(edge, sample, none):
    for df in (edge, sample):
        got = [(r.doc_id, r.fp % 2 ** 64, r.component_id) for r in s.near_duplicates(df).collect()]
        assert sorted(got, key=repr) == brute([(r.doc_id, r.text) for r in df.collect()])
    assert s.near_duplicates(none).count() == 0


def test_keep_one(edge, sample):
    for df in (edge, sample):
        want = brute([(r.doc_id, r.text) for r in df.collect()])
        kept = s.keep_one(df)
        assert kept.schema == df.schema
        assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, _, c in want})


def test_keep_one_without_ids_and_with_repeated_ids(spark):
    """Each component keeps one row, whatever its ids are."""
    words = "ab cd ef gh ij kl mn op qr st uv wx yz".split()
    rng = np.random.default_rng(3)
    texts = [" ".join(f"{words[j]}{i}" for j in rng.integers(0, len(words), 30)) for i in range(14)]
    near = texts[0] + " " + texts[0]       # the same shingles but a few
    while s.simhash(near) != s.simhash(texts[0]) and (s.simhash(near) ^ s.simhash(texts[0])).bit_count() > 4:
        near += " " + texts[0]
    rows = [(None, t) for t in texts[2:10]] + [(None, texts[2])]          # unrelated, without ids; one twice
    rows += [(1, texts[0]), (5, near), (5, texts[1])]                     # 5: a near copy of 1, and a text of its own
    rows += [(7, texts[10]), (7, texts[11]), (7, texts[11]), (None, texts[11])]
    rows += [(-2 ** 63, texts[12]), (None, texts[13]), (None, None), (None, "")]
    df = spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(rows)], "doc_id long, text string, n long")
    got = [(r.doc_id, r.text or "") for r in s.keep_one(df).collect()]
    want = [(None, t) for t in texts[2:10]] + [(1, texts[0]), (5, texts[1]), (7, texts[10]), (7, texts[11]),
                                               (-2 ** 63, texts[12]), (None, texts[13]), (None, "")]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_keep_one_deals_repeats_out_once(spark, sample):
    """Repeats are dropped before the texts are exchanged, and the join needs no other exchange."""
    plan = s.keep_one(sample)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and plan.index("Join") < plan.index("Window")
