import re

import pytest

from emberline.llm import licenses as L

DOCS = "doc_id long, text string, license string, line string"


def pairs(text):
    words = re.sub(r"[^a-z0-9]+", " ", "".join(c.lower() if "A" <= c <= "Z" else c for c in text)).split()
    return set(zip(words, words[1:], strict=False))


def brute(text):
    hits = []
    for k, line in enumerate((text or "").split("\n")):
        a = pairs(line)
        for name, template in L.TEMPLATES.items():
            b = pairs(template)
            dice = 2 * len(a & b) / (len(a) + len(b)) if a else 0
            if dice >= L.MIN_DICE:
                hits.append((-dice, k, name))
    best = min(hits, default=None)
    return (best[2], -best[0], best[1], len({k for _, k, _ in hits})) if best else (None, None, None, 0)


TEXTS = [None, "", "one", "All rights reserved.", "prose\nLicensed under the  apache-License, version 2.0\nmore prose", "ALL RIGHTS RESERVED! All rights reserved. " * 50,
         "This work is licensed under the GNU General Public License version 3 or later", "Released under the MIT License.\nAll rights reserved.",
         "Released under the ISC License\nReleased under the MIT License", L.TEMPLATES["MIT-long"], "Licensed under CC BY-NC 4.0.", "a b c d e f g h " * 500,
         "rights reserved", "Licensed under the Apacke License, Version 2.0."]


def test_equals_brute_force(llm):
    got = L.scan_licenses(llm.createDataFrame([(i, t, "x", "y") for i, t in enumerate(TEXTS)] + [(None, TEXTS[3], "x", "y")] * 2, DOCS)).collect()
    by_id = {r["doc_id"]: (r["license"], r["dice"], r["line"], r["n_notices"]) for r in got}
    assert len(got) == len(TEXTS) + 2
    assert by_id == {**{i: brute(t) for i, t in enumerate(TEXTS)}, None: brute(TEXTS[3])}
    assert by_id[4][0] == "Apache-2.0" and by_id[8][0] == "ISC" and by_id[7][3] == 2


def test_own_templates_and_empty_table(llm):
    df = llm.createDataFrame([(1, "alpha beta gamma", "x", "y")], DOCS)
    assert L.scan_licenses(df, {"own": "Alpha, beta; GAMMA!"}).first()["license"] == "own"
    assert L.scan_licenses(df.limit(0)).collect() == []
    with pytest.raises(ValueError):
        L.scan_licenses(df, {"short": "one"})
