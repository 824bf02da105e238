import random

import pytest

from webtext.llm import licenses as c
from webtext.llm.queries import op8_license_compression

from llm.conftest import EDGE

SCAN = c.Scanner(c.default_templates())
FILLER = "thines by threreatsh eringing ntou andatesat orenst thin hewh erth erouthst ateded stouing".split()


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(last + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


def brute(text):
    """Licenses of sentences that occur word for word anywhere, longest first; no
    compression, no blocks.  Exact wordings only, as notices have no tolerance."""
    words, starts, ends = c.words_of(text)
    hits = []
    for name, wording in c.default_templates():
        t = c.words_of(wording)[0]
        for i in range(len(words) - len(t) + 1):
            if words[i:i + len(t)] == t:
                hits.append((starts[i], ends[i + len(t) - 1], name))
    out = []
    for h in sorted(hits, key=lambda h: (h[0] - h[1], h[0])):
        if all(h[0] >= e or h[1] <= b for b, e, _ in out):
            out.append(h)
    return sorted(out)


def found(text):
    return [(f.start, f.end, f.license) for f in SCAN.scan(text)]


@pytest.mark.parametrize("name,wording", c.default_templates()[::3] + list(c.WORDINGS.items()))
def test_every_template_is_found_in_context(name, wording):
    rng = random.Random(wording)
    before, after = (" ".join(rng.choices(FILLER, k=rng.randrange(60))) for _ in range(2))
    text = f"{before}\n# {wording.upper()}\n{after}"
    got = SCAN.scan(text)
    assert [f.license for f in got] == [name] and not got[0].missing and not got[0].added
    assert c.words_of(text[got[0].start:got[0].end])[0] == c.words_of(wording)[0]


def test_wording_differences_are_reported_and_bounded():
    words = c.WORDINGS["MIT"].split()
    words[10], words[30] = "whoever", "unlimited"
    del words[50]
    got = SCAN.scan("x y z " + " ".join(words) + " q r s")
    assert [f.license for f in got] == ["MIT"] and got[0].differences == 3
    assert {"whoever", "unlimited"} <= set(got[0].added)
    t = c.Template("MIT", c.WORDINGS["MIT"])
    assert distance(t.words, c.words_of(" ".join(words))[0]) == 3
    for i in range(2, len(words), 4):
        words[i] = "other"
    assert SCAN.scan(" ".join(words)) == []


def test_telling_words_and_numbers_make_other_licenses():
    assert [f.license for f in SCAN.scan("Licensed under CC BY-NC 4.0.")] == ["CC-BY-NC-4.0"]
    assert [f.license for f in SCAN.scan("Licensed under CC BY 4.0.")] == ["CC-BY-4.0"]
    assert SCAN.scan("Licensed under CC BY-NC 3.0.") == []
    assert SCAN.scan("Licensed under the Apache License, Version 1.1.") == []
    gpl = c.WORDINGS["GPL-3.0-or-later"].replace("version 3", "version 4")
    assert SCAN.scan(gpl) == []
    assert SCAN.scan("A license to permission, redistribution and the public domain; licensed drivers only.") == []


def test_several_licenses_repeats_and_a_longer_wording_around_a_notice():
    text = "Licensed under the Apache License, Version 2.0. Released under the MIT License. Licensed under CC BY-NC 4.0."
    assert [f.license for f in SCAN.scan(text)] == ["Apache-2.0", "MIT", "CC-BY-NC-4.0"]
    assert len(SCAN.scan((text + "\n") * 200)) == 600
    header = c.WORDINGS["Apache-2.0"]
    assert [(f.license, f.end) for f in SCAN.scan(header)] == [("Apache-2.0", len(header) - 1)]


def test_windows_tile_a_block():
    for n in (1, 5, 40, 41, 100, 333):
        parts = list(c.blocks(list(range(n)), 5, n))
        owned = [i for _, _, first, stop in parts for i in range(first, stop)]
        assert owned == list(range(n)) and all(high - low <= 20 for low, high, _, _ in parts)


def test_against_brute_force(sample):
    texts = [r.text or "" for r in sample.collect()] + [e[1] or "" for e in EDGE]
    rng = random.Random(4)
    notices = [w for _, w in c.default_templates()[:-len(c.WORDINGS)]]
    for _ in range(120):
        parts = [rng.choice(notices) if rng.random() < 0.2 else " ".join(rng.choices(FILLER, k=rng.randrange(30)))
                 for _ in range(12)]
        texts.append("\n".join(parts))
    hits = 0
    for text in texts:
        want = brute(text)
        assert found(text) == want, text
        hits += len(want)
    assert hits > 200


def test_operator_on_edge_cases(spark, edge, none):
    assert c.find_licenses(none).collect() == [] and c.find_licenses(edge).collect() == []
    long = "word " * 30000 + "Released under the MIT License." + " word" * 30000
    rows = [(1, "Released\tunder the\nMIT LICENSE", 5), (1, "Released\tunder the\nMIT LICENSE", 5), (None, long, 6),
            (3, None, 7), (4, "public-domain", 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, license int")
    got = sorted((r.doc_id or 0, r.license, r.start, r.end) for r in c.find_licenses(df).collect())
    assert got == [(0, "MIT", 150000, 150030), (1, "MIT", 0, 30), (1, "MIT", 0, 30)]


def test_query(spark):
    folder = "/root/testdata/sf0.01"
    got = sorted((r.doc_id, r.start, r.end, r.license) for r in op8_license_compression(spark, folder).collect())
    docs = spark.read.parquet(folder + "/documents.parquet").where("text ilike '%licen%'").collect()
    assert got == sorted((d.doc_id, *h) for d in docs for h in brute(d.text)) and got


BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided
that the following conditions are met:
* Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
* Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution."""
THIRD = """
* Neither the name of Acme Corp. nor the names of its contributors may be used to endorse or promote products derived
from this software without specific prior written permission."""


@pytest.mark.parametrize("text,names", [
    ("This work is licensed under a Creative Commons Attribution 4.0 International License.", ["CC-BY-4.0"]),
    ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", ["CC-BY-SA-4.0"]),
    ("The code is available under the MIT License.", ["MIT"]),
    ("It is made available under an ISC License", ["ISC"]),
    ("// SPDX-License-Identifier: MIT\nint main", ["MIT"]),
    ("# SPDX-License-Identifier: MIT-0\nimport os", ["MIT-0"]),
    ("/* SPDX-License-Identifier: GPL-2.0-or-later */", ["GPL-2.0-or-later"]),
    ("Licensed under the Apache Software License, Version 2.0", ["Apache-2.0"]),
    ("Not under the MIT License. MIT-style license. Licensed under a modified MIT License.", []),
    ("Licensed under the GNU Free Documentation License, version 3", []),
    (BSD, ["BSD-2-Clause"]), (BSD + THIRD, ["BSD-3-Clause"]),
    (BSD.replace("* ", "1. ", 1).replace("* ", "2. "), ["BSD-2-Clause"]),
])
def test_notices_as_people_write_them(text, names):
    assert [f.license for f in SCAN.scan("Erouthst ateded stouing hewh. " + text)] == names
