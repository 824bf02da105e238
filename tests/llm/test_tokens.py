import zlib

import numpy as np
import pytest

from webtext.llm import packing as p, tokenfiles as t
from webtext.llm.queries import tokenizer_path
from webtext.llm.tokenizing import PieceEncoder

from llm.conftest import EDGE

KINDS = [("byte_bpe_50k.json", "byte"), ("word_bpe_49k.json", "word")]
ODD = ["", " ", "a  b\n\n c\t\td \x1c e  f", "a\t\n\nb  ", "a \nb", "日本 語です。\r\n ok\x85 z", "½² é áb Ⅷ x'll y's",
       "THERE!! IS||NO BREAK", "a.b,c;d 3.14 1,000", "İI ıi ΑΣ ΑΣ.", "µ ß ÿ Ÿ", "\n", "x\n", "\nx", " x ", "éa"]


@pytest.mark.parametrize("name,kind", KINDS)
def test_pieces_give_the_librarys_ids(sample, name, kind):
    e = PieceEncoder(tokenizer_path(name), kind, limit=500)
    for text in ODD + [x[1] or "" for x in EDGE] + [r.text for r in sample.limit(120).collect()]:
        want = e.tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(e.encode(text), "<u4").tolist() == want, text[:80]


def whole(path, kind, text, end):
    e = PieceEncoder(path, kind)
    return np.array([*e.tokenizer.encode(text or "", add_special_tokens=False).ids, end], "<u4")


@pytest.mark.parametrize("n,bits", [(3, 2), (2, 5), (4, 2)])
def test_hilbert_curve_visits_neighbours(n, bits):
    grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * n, indexing="ij"), -1).reshape(-1, n)
    key = p.hilbert_index(grid, bits)
    assert sorted(key) == list(range(len(grid)))
    assert (np.abs(np.diff(grid[np.argsort(key)], axis=0)).sum(1) == 1).all()


def test_tail_lengths():
    assert p.tail_lengths(700) == [512, 128, 32, 16, 8, 4] and p.tail_lengths(0) == []


def check_packing(df, length=1024):
    path = tokenizer_path("byte_bpe_50k.json")
    docs = df.collect()
    rows = p.pack(df, path, "byte", length, with_ids=True).collect()
    sequences = {}
    for r in rows:
        assert zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length
        sequences.setdefault(r.sequence_id, []).append(r)
    padding = 0
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= length
        padding += 0 if at & (at - 1) == 0 else length - at
    assert padding == 0
    # every document's ids, each in one piece; repeated ids are told apart by their text
    got, want = {}, {}
    for r in rows:
        got.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, bytes(r.ids)))
    for d in docs:
        ids = whole(path, "byte", d.text, 0)
        want.setdefault((d.doc_id, len(ids)), []).append(ids.tobytes())
    assert {k: len(b"".join(x for _, x in v)) for k, v in got.items()} == {k: sum(map(len, v)) for k, v in want.items()}
    for k, v in got.items():
        if len(want[k]) == 1:
            assert b"".join(x for _, x in sorted(v)) == want[k][0]


def test_packing(edge, sample, none):
    check_packing(edge, 64)
    check_packing(sample)
    assert p.pack(none, tokenizer_path("byte_bpe_50k.json"), "byte").count() == 0


def test_neighbours_on_the_curve_are_alike(spark):
    a, b = "the cat sat on the mat ", "Der Hund lief über die Straße "
    df = spark.createDataFrame([(i, (a if i % 2 else b) * (3 + i % 5)) for i in range(200)], "doc_id long, text string")
    rows = p.tokenized(df, tokenizer_path("byte_bpe_50k.json"), "byte").orderBy("curve").collect()
    kinds = [r.doc_id % 2 for r in rows]
    assert sum(x != y for x, y in zip(kinds, kinds[1:])) <= 3


@pytest.mark.parametrize("bits", [1, 5, 8, 15, 16, 17, 24, 31])
def test_bits_round_trip(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1003).astype("<u4")
    data = t.pack_bits(ids, bits)
    assert len(data) == -(-1003 * bits // 8)
    assert (t.unpack_bits(data, 1003, bits) == ids).all()


def test_bits_needed():
    assert [t.bits_needed(n) for n in (1, 2, 3, 256, 257, 49408, 65536, 65537)] == [1, 1, 2, 8, 9, 16, 16, 17]


def test_file_random_access(tmp_path):
    rng = np.random.default_rng(0)
    docs = [(None if i == 3 else i, rng.integers(0, 5000, n).astype("<u4")) for i, n in enumerate([5, 0, 70000, 1, 200000, 3])]
    w = t.TokenWriter(f"file://{tmp_path}/a.tokens", 13)
    for d, ids in docs:
        w.add(d, ids)
    w.close()
    r = t.TokenReader(f"file://{tmp_path}/a.tokens")
    for i, (d, ids) in enumerate(docs):
        assert (r.document(i) == ids).all() and r.doc_ids[i] == d
    everything = np.concatenate([ids for _, ids in docs])
    for a, b in [(0, 1), (65535, 65537), (70005, 200000), (10, 10), (len(everything) - 1, len(everything))]:
        assert (r.read(a, b) == everything[a:b]).all()
    assert [(d, len(x)) for d, _, x in r.documents(1000)] == [(d, len(x)) for d, x in docs]
    (tmp_path / "b.tokens").write_bytes((tmp_path / "a.tokens").read_bytes()[:-9])
    with pytest.raises(ValueError):
        t.TokenReader(f"file://{tmp_path}/b.tokens")


def test_token_files(spark, edge, sample, none, tmp_path):
    path = tokenizer_path("word_bpe_49k.json")
    for i, df in enumerate((edge, sample)):
        manifest = t.write_token_files(df, f"file://{tmp_path}/{i}", path, "word")
        got = sorted(((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in t.read_token_files(manifest).collect()))
        at, want = 0, []
        for r in sorted(df.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or "")):
            ids = whole(path, "word", r.text, 2)
            want.append((at, r.doc_id, len(ids), zlib.crc32(ids.tobytes())))
            at += len(ids)
        assert got == want
    manifest = t.write_token_files(none, f"file://{tmp_path}/none", path, "word")
    assert t.read_token_files(manifest).count() == 0


def test_ranges_count_the_cuts_below():
    rng = np.random.default_rng(4)
    curve, ids = rng.integers(0, 6, 500), rng.integers(-5, 5, 500)
    cuts = sorted(zip(rng.integers(0, 6, 40).tolist(), rng.integers(-5, 5, 40).tolist()))
    got = p.range_of(curve, ids, np.array([c for c, _ in cuts]), np.array([i for _, i in cuts]))
    assert got.tolist() == [sum(c < k for c in cuts) for k in zip(curve.tolist(), ids.tolist())]


def test_ranges_hold_equal_numbers_of_tokens(spark, monkeypatch):
    """Long texts lie together on the curve, a third of the rows are copies, and
    some have neither id nor text."""
    monkeypatch.setattr(p, "RANGE_TOKENS", 20_000)
    words = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta"]
    data = [(i, " ".join(words[(i * 7 + j * j) % 6] for j in range(2000 if i % 20 == 0 else 40))) for i in range(1200)]
    data += [(2000 + i, "the same text " * 20) for i in range(600)] + [(None, None)] * 50
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    rows = p.saved(p.tokenized(df, tokenizer_path("byte_bpe_50k.json"), "byte"), "spread")
    parts = {r.part: (r.t, r.c) for r in p.by_range(rows).groupBy("part").agg(
        p.F.sum("n").alias("t"), p.F.count("n").alias("c")).collect()}
    tokens = [t for t, _ in parts.values()]
    assert sum(c for _, c in parts.values()) == len(data) and len(tokens) >= 8
    assert max(tokens) <= 1.3 * sum(tokens) / len(tokens)
