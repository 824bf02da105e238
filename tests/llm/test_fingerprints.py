import hashlib

import pytest

from webtext.llm import fingerprints as f


def phrases(text):
    """LZ78 phrases by the textbook."""
    seen, phrase = set(), ""
    for ch in text:
        phrase += ch
        if phrase not in seen:
            seen.add(phrase)
            phrase = ""
    return seen


def test_fingerprint_is_of_the_phrase_set():
    for text in ("", "a", "aaaaaa", "abracadabra abracadabra", "日本語日本語 ééé"):
        assert len(f.fingerprint(text)) == min(f.SIZE, len(phrases(text)))
    assert f.as_text(f.fingerprint("ab" * 50)) == f.as_text(f.fingerprint("ab" * 50))
    assert (f.from_text(f.as_text(f.fingerprint("abcabc"))) == f.fingerprint("abcabc")).all()


def test_likeness_is_jaccard_of_phrases():
    a, b = "the cat sat on the mat and the dog sat too", "the cat sat on the rug and the dog lay too"
    p, q = phrases(a), phrases(b)
    assert f.likeness(f.fingerprint(a), f.fingerprint(b)) == pytest.approx(len(p & q) / len(p | q))
    assert f.likeness(f.fingerprint(""), f.fingerprint("")) == 1.0
    assert f.likeness(f.fingerprint(""), f.fingerprint("a")) == 0.0


def test_likeness_of_long_texts_is_close(sample):
    texts = [r.text for r in sample.limit(60).collect()]
    errors = []
    for a, b in zip(texts, texts[1:]):
        p, q = phrases(a), phrases(b)
        errors.append(abs(f.likeness(f.fingerprint(a), f.fingerprint(b)) - len(p & q) / len(p | q)))
    assert max(errors) < 0.2 and sum(errors) / len(errors) < 0.05


def test_shared_prefix_gives_the_same(sample):
    for r in sample.limit(20).collect():
        n = len(r.text)
        e = r.text[:n - n // 2] + "something else entirely"
        a, b = f.fingerprints_sharing_prefix(r.text, e, n - n // 2)
        assert (a == f.fingerprint(r.text)).all() and (b == f.fingerprint(e)).all()


def brute(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    out = []
    for i, (d, t, *_) in enumerate(order):
        t, nxt = t or "", order[(i + 1) % len(order)][1] or ""
        n = len(t)
        e = t[:n - n // 2] + nxt[:n // 2]
        x, y, z = map(f.fingerprint, (t, e, nxt))
        out.append((d, n, hashlib.sha256(e.encode()).hexdigest(), f.as_text(x), f.as_text(y),
                    f.likeness(x, y), f.likeness(x, z)))
    return sorted(out, key=repr)


def test_query_against_brute_force(edge, sample, none):
    for df in (edge, sample.limit(150), edge.limit(1)):
        df = df.cache()
        rows = [(r.doc_id, r.text) for r in df.collect()]
        assert sorted((tuple(r) for r in f.compare_with_edited(df).collect()), key=repr) == brute(rows)
    assert f.compare_with_edited(none).count() == 0
    assert f.fingerprint_documents(edge).count() == edge.count()
