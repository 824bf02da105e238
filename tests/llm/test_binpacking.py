import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from webtext.llm import binpacking as b, grouping as g
from webtext.llm.queries import tokenizer_path
from webtext.llm.tokenizing import PieceEncoder

PATH = tokenizer_path("byte_bpe_50k.json")


def check(docs, length=1024, **how):
    """Pieces hold every id once and in order, sequences have no gap; the number of sequences."""
    encode = PieceEncoder(PATH, "byte").tokenizer.encode
    rows = b.pack(docs, PATH, "byte", length, with_ids=True, **how).collect()
    sequences, whole = defaultdict(list), Counter()
    for r in rows:
        assert zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length and r.length > 0
        assert r.piece == 0 or r.length == length
        sequences[r.sequence_id].append(r)
        whole[r.doc_id, r.piece, r.start, bytes(r.ids)] += 1
    for held in sequences.values():
        at = 0
        for r in sorted(held, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= length
    want = Counter()
    for d in docs.collect():
        ids = np.array([*encode(d.text or "", add_special_tokens=False).ids, 2], "<u4")
        at, piece = 0, 0
        while at < len(ids):
            n = (len(ids) - at - 1) % length + 1 if at == 0 else length
            want[d.doc_id, piece, at, ids[at:at + n].tobytes()] += 1
            at, piece = at + n, piece + 1
    assert whole == want
    return len(sequences), sum(r.length for r in rows)


def test_edge_cases_and_small_sequences(edge):
    assert check(edge, 64)[0] >= 1


def test_sample_over_several_shards(sample):
    n, tokens = check(sample, 256, shard=16, generations=10)
    assert n <= 1.02 * -(-tokens // 256) + 1


def test_empty_table(none):
    assert b.pack(none, PATH, "byte").count() == 0


def test_only_full_pieces(spark):
    docs = spark.createDataFrame([(1, " the" * 1023), (2, " the" * 2047)], "doc_id long, text string")
    assert check(docs) == (3, 3072)


def optimum(sizes, capacity):
    """Fewest bins by trying every choice."""
    best = len(sizes)

    def place(i, loads):
        nonlocal best
        if len(loads) >= best:
            return
        if i == len(sizes):
            best = len(loads)
            return
        for k, load in enumerate(loads):
            if load + sizes[i] <= capacity:
                place(i + 1, loads[:k] + (load + sizes[i],) + loads[k + 1:])
        place(i + 1, loads + (sizes[i],))

    place(0, ())
    return best


@pytest.mark.parametrize("seed", range(8))
def test_reaches_the_optimum_of_small_instances(seed):
    rng = np.random.default_rng(seed)
    sizes = np.sort(rng.integers(3, 60, 11))[::-1].astype(np.int64)
    assert len(g.evolve(sizes, 100, [seed], [], 8, 200, 1)[0][1]) == optimum(sizes.tolist(), 100)


def test_mends_a_packing_that_best_fit_gets_wrong():
    """Best fit over descending sizes needs four bins; three are enough."""
    sizes = np.array([44, 24, 24, 22, 21, 17, 8, 8, 6, 6], np.int64)
    assert len(g.packed_in_order(np.arange(10), sizes, 60)[1]) == 4
    assert len(g.evolve(sizes, 60, [1], [], 8, 300, 1)[0][1]) == optimum(sizes.tolist(), 60) == 3


def test_children_hold_every_item_once():
    rng = np.random.default_rng(5)
    sizes = np.sort(rng.integers(1, 300, 200))[::-1].astype(np.int64)
    a = g.packed_in_order(np.arange(200), sizes, 1024)
    c = g.packed_in_order(rng.permutation(200), sizes, 1024)
    for _ in range(20):
        child = g.mutation(g.crossover(a, c, sizes, 1024, rng), sizes, 1024, rng)
        assert (child[0] >= 0).all() and child[1].max() <= 1024
        assert (np.bincount(child[0], weights=sizes, minlength=len(child[1])) == child[1]).all() and (child[1] > 0).all()
        a, c = c, child


def test_immigrants_are_kept_when_they_are_better():
    sizes = np.array([5, 5, 4, 4, 3, 3, 3, 3], np.int64)
    good = (np.array([0, 0, 1, 2, 1, 1, 2, 2], np.int32), np.array([10, 10, 10], np.int64))
    assert len(g.evolve(sizes, 10, [0], [good], 4, 0, 1)[0][1]) == 3
