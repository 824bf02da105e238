import re

import numpy as np

from webtext.llm import quality as q, rules as r
from webtext.llm.queries import op5_quadratic_discriminant

SF = "/root/testdata/sf0.01"


def test_discriminant_matches_densities():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((400, 3)) * [1, 2, .5]
    y = (rng.random(400) < .3).astype(int)
    x[y == 1] += [2, 0, 1]
    k = [x[y == c] for c in (0, 1)]
    d = q.discriminant(np.array([len(a) for a in k], float), np.array([a.sum(0) for a in k]), np.array([a.T @ a for a in k]))
    logs = []
    for c in (0, 1):
        cov = np.linalg.inv(d.factors[c].T @ d.factors[c])
        assert np.allclose(cov, cov.T)
        z = x - d.means[c]
        logs.append(np.log(d.prior[c]) - .5 * np.linalg.slogdet(cov)[1] - .5 * np.einsum("ij,jk,ik->i", z, np.linalg.inv(cov), z))
    assert np.allclose(d.scores(x), 1 / (1 + np.exp(logs[0] - logs[1])))


def test_held_out_accuracy(spark):
    rows = {x.doc_id: x for x in op5_quadratic_discriminant(spark, SF).collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    test = [(x.quality, rows[x.doc_id].predicted) for x in labels if x.doc_id in rows and rows[x.doc_id].held_out]
    assert len(test) > 80 and sum(a == b for a, b in test) / len(test) > 0.95
    assert all(x.held_out == q.held_out(x.doc_id) and 0 <= x.score <= 1 for x in rows.values())


def test_edge_cases(spark, edge, none):
    labels = spark.createDataFrame([(1, 1), (10, 1), (5, 0), (9, 0), (2, 1), (4, 0), (77, 1), (3, None)], "doc_id long, quality int")
    model = q.fit(edge, labels, lambda d: True)
    out = q.score(edge, model).collect()
    assert len(out) == edge.count() and all(0 <= x.score <= 1 and x.predicted == (x.score >= .5) for x in out)
    assert q.score(none, model).count() == 0
    kept = q.keep_good(edge, model)
    assert kept.schema == edge.schema and kept.count() == sum(x.predicted for x in out)
    for l, want in ((labels.limit(0), .5), (labels.filter("quality = 1"), 1.0)):
        assert {x.score for x in q.score(edge, q.fit(edge, l, lambda d: True)).collect()} == {want}
    assert q.fit(none, labels, lambda d: True).means is None


W = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    t = text or ""
    w, windows = W.findall(t), {}
    for i in range(len(w) - 2):
        windows.setdefault(tuple(w[i:i + 3]), []).append(i)
    covered = {i + k for v in windows.values() if len(v) > 1 for i in v for k in range(3)}
    ls = [x for x in t.split("\n") if W.search(x)]
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(ls) - len(set(ls)), len(covered), failed)


def test_base_counts(edge, sample, none):
    extra = [(100, "a b c a b c a b c"), (101, "x x x x"), (102, "a b c d a b c"), (103, "a b c"), (104, "a\n\n a\na\n \n\na")]
    for df in (edge, sample, edge.sparkSession.createDataFrame(extra, "doc_id long, text string")):
        got = sorted(((x.doc_id, x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words, x.base_failed)
                      for x in r.judge(df).collect()), key=repr)
        assert got == sorted(((x.doc_id, *brute(x.text)) for x in df.collect()), key=repr)
    assert r.judge(none).count() == 0


GOOD = "This is a perfectly ordinary sentence, which says something about the world and stops."


def test_line_rules(spark):
    bad = ["Home | About | Contact | Jobs | Help", "We use cookies to improve your visit.", "Read more", "BUY!! NOW!! CHEAP!! YES!! OK!!",
           "$$$ ### *** &&& %%% |||", " ".join(["word"] * 60)]
    for line in bad:
        df = spark.createDataFrame([(1, line), (2, GOOD)], "doc_id long, text string")
        got = {x.doc_id: (x.lost_chars, x.word_chars) for x in r.judge(df).collect()}
        assert got[1][0] == got[1][1] > 0 and got[2][0] == 0, line
        text = spark.createDataFrame([(GOOD + "\n" + line + "\n" + GOOD,)], "text string")
        assert text.select(r.cleaned_text(text.text)).first()[0] == GOOD + "\n" + GOOD
    many = "\n".join(f"{GOOD} {i}" for i in range(8))
    menu = "\n".join(f"a{i} | b{i} | c{i} | d{i}" for i in range(60))
    df = spark.createDataFrame([(1, many), (2, many + "\n" + menu), (3, many + "\nHome")], "doc_id long, text string")
    verdict = {x.doc_id: x.kept for x in r.judge(df).collect()}
    assert verdict == {1: False, 2: False, 3: False}      # one sentence eight times


MARK = "[.!?;:,\u2026\u037e\u0387\u060c\u061b\u061f\u06d4\u0964\u0965\u3001\u3002\uff0c\uff1a\uff1b\uff01\uff1f]"
BAR = "[|\u00b7\u00bb\u00ab\u203a\u2039\u2192\u2022]"
GAP = "[\\s|/\u00b7\u00bb\u00ab\u203a\u2039\u2192\u2022\u2013-]"
ENTRIES = "(?:" + "|".join(x for v in r.NAVIGATION.values() for x in v) + ")"
NOTICE = re.compile("(?i)(?<![^\\W\\d_])(?:" + "|".join(x for v in r.NOTICES.values() for x in v) + ")")


def brute_fails(line):
    w = W.findall(line)
    n, chars = len(w), sum(map(len, w))
    return (100 * len(re.findall(r"[#*$%&|<>]", line)) > 10 * chars
            or (n >= 8 and 100 * len(re.findall(MARK, line)) < n)
            or (n >= 4 and 4 * line.count("!!") > n)
            or (len(re.findall(BAR, line)) >= 2 and 5 * len(re.findall(BAR, line)) > n)
            or (0 < n <= 16 and re.search(f"(?i)^{GAP}*{ENTRIES}(?:{GAP}+{ENTRIES})*{GAP}*$", line) is not None)
            or (n <= 40 and NOTICE.search(line) is not None))


def brute_kept(text):
    lost = sum(len(w) for x in (text or "").split("\n") if brute_fails(x) for w in W.findall(x))
    n_words, chars, *_, failed = brute(text)
    return lost, not failed and 100 * lost <= 50 * chars


def test_verdict_and_remaining_text_against_brute_force(edge, sample):
    for df in (edge, sample):
        got = sorted(((x.doc_id, x.lost_chars, x.kept) for x in r.judge(df).collect()), key=repr)
        assert got == sorted(((x.doc_id, *brute_kept(x.text)) for x in df.collect()), key=repr)
        left = sorted(((x.doc_id, x.text) for x in r.keep_clean(df).select("doc_id", "text").collect()), key=repr)
        assert left == sorted(((x.doc_id, "\n".join(y for y in x.text.split("\n") if not brute_fails(y)))
                               for x in df.collect() if brute_kept(x.text)[1]), key=repr)


def test_lines_of_four_languages(spark):
    bad = ["Startseite Kontakt Impressum Datenschutz", "Alle Rechte vorbehalten", "Wir verwenden Cookies", "Mentions légales",
           "Home About Contact Jobs", "Inicio · Contacto · Aviso legal", "Accueil / À propos / Plan du site",
           "TODOS LOS DERECHOS RESERVADOS", "Tous droits réservés", "Über uns", " ".join(["wort"] * 20),
           " ".join(["word"] * 200) + ","]
    good = ["The Great Gatsby", "Contact with the enemy was lost.", "Die Startseite wurde neu gestaltet.", "Aide-toi, le ciel t'aidera.",
            "Er verwendet sein Geld.", "一行中文文本。", "1. Introduction", GOOD, "", " ", "Home is where the heart is."]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(bad + good)], "doc_id long, text string")
    lost = {x.doc_id: x.lost_chars for x in r.judge(df).collect()}
    assert [x for i, x in enumerate(bad) if not lost[i]] == []
    assert [x for i, x in enumerate(good, len(bad)) if lost[i]] == []
    bare = "\n".join(" ".join(f"w{i}x{k}" for k in range(20)) for i in range(30))
    assert r.judge(spark.createDataFrame([(1, bare)], "doc_id long, text string")).filter("kept").count() == 0


def test_rejects_by_lost_text_only(spark):
    many = "\n".join(f"{a} sentence number {i} tells of {b} and ends {c}." for i, (a, b, c) in enumerate(
        (f"w{i}a", f"w{i}b", f"w{i}c") for i in range(30)))
    menu = "\n".join(f"a{i} | b{i}xxxxxxxxxxxx | c{i}xxxxxxxxxxxxxxxxx | d{i}xxxxxxxxxx" for i in range(40))
    df = spark.createDataFrame([(1, many), (2, many + "\n" + menu), (3, many + "\nHome")], "doc_id long, text string")
    assert {x.doc_id: (x.base_failed, x.kept) for x in r.judge(df).collect()} == {1: (False, True), 2: (False, False), 3: (False, True)}


def test_native_and_columns(edge, sample):
    for df in (r.judge(edge), r.keep_clean(edge)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
    kept = r.keep_clean(sample)
    assert kept.schema == sample.schema
    if "n_chars" in kept.columns:
        assert kept.filter("n_chars <> length(text)").count() == 0
    assert {x.doc_id for x in kept.collect()} == {x.doc_id for x in r.judge(sample).filter("kept").collect()}
