import hashlib
import random
import zlib
from itertools import product

import numpy as np
import pytest

from webtext.llm import pieces as p
from webtext.llm.queries import op9_streaming_viterbi, tokenizer_path

from llm.conftest import EDGE

PATH = tokenizer_path("piece_bpe_32k.model")
ODD = ["", " ", "   ", "Hello  world\n x\t y ", "a▁b▁▁c", "日本\x00z", "퟿😀", "<s> <0x41> </s> <unk>", "ﬁ ½ Ǻ é",
       " " * 1000, "a" * 500, "ab" * 400, "日本語" * 300, "x" + " " * 77 + "y", "= = == === " * 30, "\n\n\n\t\t", "ééé",
       "addEventListenercancellationToken" * 5, "�⁇ ok"]


@pytest.fixture(scope="module")
def library():
    from sentencepiece import SentencePieceProcessor
    return SentencePieceProcessor(model_file=PATH)


def test_ids_and_texts_are_the_librarys(library, sample):
    m = p.PieceModel(PATH, "bpe")
    rng = random.Random(3)
    noise = ["".join(rng.choice("abeint  ▁\n.é日😀") for _ in range(rng.randrange(200))) for _ in range(150)]
    for text in ODD + noise + [e[1] or "" for e in EDGE] + [r.text for r in sample.collect()]:
        ids = np.frombuffer(m.encode(text), "<u4").tolist()
        assert ids == library.encode(text), text[:60]
        assert m.decode(m.encode(text)) == library.decode(ids), text[:60]


def test_ids_without_known_boundaries(library):
    m = p.PieceModel(PATH, "bpe")
    m.cuts = False
    for text in ODD + ["several words with spaces, and one more line\nhere " * 5]:
        assert np.frombuffer(m.encode(text), "<u4").tolist() == library.encode(text)


def test_decoding_any_ids(library):
    m, rng = p.PieceModel(PATH, "bpe"), random.Random(5)
    for _ in range(200):
        ids = [rng.choice([rng.randrange(3, 259), rng.randrange(32000)]) for _ in range(rng.randrange(12))]
        assert m.decode(np.array(ids, "<u4").tobytes()) == library.decode(ids), ids


def test_unigram_paths_are_the_best_of_all():
    rng = random.Random(1)
    scores = {"".join(s): rng.uniform(-9, -1) for n in (1, 2, 3) for s in product("ab", repeat=n)}
    del scores["aab"]
    v = p.StreamingViterbi(scores, "unigram")

    def best(text):
        if not text:
            return 0.0
        return max(scores[text[:n]] + best(text[n:]) for n in (1, 2, 3) if text[:n] in scores and n <= len(text))

    for _ in range(40):
        text = "".join(rng.choice("ab") for _ in range(rng.randrange(15)))
        got = [x for part in v.pieces(iter(text)) for x in part]
        assert "".join(got) == text and sum(scores[x] for x in got) == pytest.approx(best(text))


def test_window_stays_small_and_chunks_do_not_matter():
    m = p.PieceModel(PATH, "bpe")
    text = "thequickbrownfoxjumpsoverthelazydog" * 200
    parts = list(m.viterbi.pieces([text]))
    assert max(len("".join(x)) for x in parts) <= 12 * m.viterbi.width   # committed as it goes
    chunks = [text[i:i + 7] for i in range(0, len(text), 7)]
    assert [x for a in m.viterbi.pieces(chunks) for x in a] == [x for a in parts for x in a]


def test_operator_on_edge_cases(edge, none, library):
    want = sorted(((i, library.encode(t or ""), library.decode(library.encode(t or ""))) for i, t, _ in EDGE), key=repr)
    got = p.encode_and_decode(edge, PATH).collect()
    assert sorted(((r.doc_id, np.frombuffer(r.ids, "<u4").tolist(), r.text) for r in got), key=repr) == want
    assert sorted(p.decode(p.encode(edge, PATH), PATH).collect(), key=repr) == sorted(
        [(i, t) for i, _, t in want], key=repr)
    assert p.encode_and_decode(none, PATH).collect() == []


def test_query(spark, library):
    folder = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in op9_streaming_viterbi(spark, folder).collect()}
    docs = spark.read.parquet(folder + "/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = library.encode(d.text or "")
        r = got[d.doc_id]
        assert (r.n_ids, r.ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
