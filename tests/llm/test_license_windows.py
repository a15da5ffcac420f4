import textwrap

import numpy as np

from emberline.llm import license_windows as W
from emberline.llm import licenses as L

DOCS = "doc_id long, text string, license string, line string"
ALL = W.all_templates()


def scan(spark, texts):
    rows = [(i, t, "x", "y") for i, t in enumerate(texts)]
    return {r["doc_id"]: r for r in W.scan_license_texts(spark.createDataFrame(rows, DOCS)).collect()}


def test_licence_texts_and_notices_anywhere(llm):
    mit = " ".join(ALL["MIT-text"].split())
    texts = [
        "Title\n\nCopyright 2020 Foo\n\n" + textwrap.fill(mit, 60) + "\n\nAnd more prose.", f"Some prose, then {mit} and prose after it.",
        "Copyright 2020 Foo Inc. Released under the MIT License.", "This file is released under the MIT License.", "prose\nof two\nThis code is licensed under the Apache\nLicense, Version 2.0. Enjoy.",
        "/* " + textwrap.fill(ALL["GPL-3.0-header"], 50).replace("\n", "\n * ") + " */", "Copyright X. All rights reserved.\n" + ALL["BSD-3-Clause-text"],
        None, "", "one", "released under the old bridge, all rights of way are reserved",
    ]
    got = scan(llm, texts)
    names = ["MIT-text", "MIT-text", "MIT", "MIT", "Apache-2.0", "GPL-3.0-header", "BSD-3-Clause-text"] + [None] * 4
    assert [got[i]["license"] for i in range(len(texts))] == names
    assert all(got[i]["dice"] == 1.0 for i in range(6))
    assert got[0]["line"] == 4 and got[0]["last_line"] > 10 and (got[4]["line"], got[4]["last_line"]) == (2, 3)
    assert got[6]["n_notices"] == 2 and got[6]["licenses"] == ["BSD-3-Clause-text", "all-rights-reserved"]
    assert (got[7]["n_notices"], got[7]["licenses"], got[7]["line"]) == (0, [], None)
    lines = L.scan_licenses(llm.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts[:5])], DOCS)).collect()
    assert all(r["license"] is None for r in lines)  # what the scan of single lines cannot find


def test_every_template_is_found_as_itself_in_prose():
    windows = W.Windows(ALL, 0.8)
    for name, text in ALL.items():
        hits = windows.find(f"Some words before it\n{textwrap.fill(text, 72)}\nand some after.".encode())
        assert (hits[0][0], hits[0][1]) == (name, 1.0), name


def test_windows_equal_brute_force():
    rnd = np.random.default_rng(5)
    templates = {"one": "a b c d e", "two": "b c a b d c", "three": "e f"}
    windows = W.Windows(templates, 0.8)
    pairs = {n: set(zip(t.split(), t.split()[1:], strict=False)) for n, t in templates.items()}
    for _ in range(200):
        words = list(rnd.choice(list("abcdefx"), rnd.integers(2, 25)))
        found = []
        for name, b in pairs.items():
            for i in range(len(words) - 1):
                best = (0.0, 0, 0)
                for j in range(i + 1, min(i + 1 + int((len(templates[name].split()) - 1) * 1.5), len(words))):
                    a = set(zip(words[i:j], words[i + 1 : j + 1], strict=False))
                    best = max(best, (2 * len(a & b) / (len(a) + len(b)), -j, len(a & b)))
                if best[0] >= 0.8 and (words[i], words[i + 1]) in b:
                    found.append((-best[0] * best[2], i, -best[1], name, best[0]))
        taken, want = set(), []
        for _, i, j, name, dice in sorted(found):
            if not taken & set(range(i, j + 1)):
                taken |= set(range(i, j + 1))
                want.append((name, dice, i, j))
        assert windows.find(" ".join(words).encode()) == want


def test_own_templates_and_empty_table(llm):
    df = llm.createDataFrame([(1, "so alpha\nbeta gamma it is", "x", "y")] * 2 + [(None, "no", "x", "y")], DOCS)
    assert [r["license"] for r in W.scan_license_texts(df, {"own": "Alpha, beta; GAMMA!"}).collect()].count("own") == 2
    assert W.scan_license_texts(df.limit(0)).collect() == []
