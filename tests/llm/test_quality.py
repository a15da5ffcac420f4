import random
import re

from emberline.llm import quality as Q

DOCS = "doc_id long, text string, n_words string, kept string, _w int"


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    seen = {}
    for w in windows:
        seen[w] = seen.get(w, 0) + 1
    covered = {j for i, w in enumerate(windows) if seen[w] > 1 for j in range(i, i + 8)}
    n = len(words)
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered), n < 20 or 100 * len(covered) > 30 * n)


def texts():
    rnd = random.Random(3)
    word = lambda: rnd.choice(["the", "of", "a", "é", "漢字", "x#", "😀"])
    out = [None, "", " ", "\n\n", "a b c d e f g h " * 2, "one two three four five six seven", "x " * 5000, "\x0b\x0ca\x85b\xa0c\r\nd", "line\nline\n line\n\nline"]
    for _ in range(80):
        t = "".join(word() + rnd.choice([" ", " ", "\n", "\t", "  "]) for _ in range(rnd.randrange(80)))
        out.append(t + (t[:120] if rnd.random() < 0.4 else ""))
    return out


def test_statistics_equal_brute_force(llm):
    rows = texts()
    df = llm.createDataFrame([(i, t, "x", "y", 1) for i, t in enumerate(rows)], DOCS)
    got = Q.quality_rules(df, llm.createDataFrame([], "doc_id long, quality int")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (*(r[c] for c in Q.BASE), r["base_failed"]) == brute(rows[r["doc_id"]]), rows[r["doc_id"]]
        assert r["kept"] == (not r["base_failed"])  # no labels: only the base rule


def labelled(spark, n=600, seed=5):
    rnd = random.Random(seed)
    rows, marks = [], []
    for i in range(n):
        bad = rnd.random() < 0.3
        kind = rnd.random()
        words = [f"w{rnd.randrange(5000)}" for _ in range(rnd.randrange(25, 120))]
        if bad:
            words = [w + "###" for w in words] if kind < 0.5 else [w.upper() + "!!" for w in words]
        rows.append((i, " ".join(words), "x", "y", 1))
        marks.append((i, int(not bad), None))
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(marks, "doc_id long, quality int, text string"), {i: q for i, q, _ in marks}


def test_rules_are_learned_and_hold_on_other_rows(llm):
    df, marks, quality = labelled(llm)
    got = {r["doc_id"]: r["kept"] for r in Q.quality_rules(df, marks.filter("doc_id % 2 = 0")).collect()}
    held_out = [i for i in quality if i % 2]
    assert sum(got[i] == bool(quality[i]) for i in held_out) >= 0.97 * len(held_out)
    good = Q.keep_good(df, marks)
    assert good.columns == df.columns and {r["doc_id"] for r in good.collect()} == {i for i, q in quality.items() if q}


def test_rules_are_ordered_threshold_conditions(llm):
    df, marks, _ = labelled(llm)
    stats = Q.text_stats(df.select("doc_id", "text")).join(marks.select("doc_id", "quality"), "doc_id")
    rules = Q.learn_rules(stats.withColumn("bad", 1 - stats["quality"]))
    assert 1 <= len(rules) <= 6 and all(1 <= len(r) <= Q.MAX_CONDITIONS for r in rules)
    assert "CASE WHEN" in str(Q.verdict(rules))


def test_edge_labels(llm):
    df = llm.createDataFrame([(1, "a " * 30, "x", "y", 1), (1, "a " * 30, "x", "y", 1), (None, "word " * 3, "x", "y", 1)], DOCS)
    marks = llm.createDataFrame([(1, 0), (1, None), (None, 1), (1, 7), (99, 1)], "doc_id long, quality int")
    assert Q.quality_rules(df, marks).count() == 3
    assert Q.quality_rules(df.limit(0), marks).collect() == [] and Q.keep_good(df.limit(0), marks).collect() == []
