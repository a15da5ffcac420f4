import hashlib
import random

from emberline.llm.mixing import mix_sources, take_mix

DOCS = "doc_id long, text string, source string, rank int, size string"


def targets(sizes):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    budget, open_, fixed = 1.5 * sum(sizes.values()), set(names), {}
    while True:
        level = (budget - sum(fixed.values())) / max(1, sum(weight[s] for s in open_))
        over = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
        if not over:
            return fixed | {s: level * weight[s] for s in open_}
        fixed |= {s: 2.0 * sizes[s] for s in over}
        open_ -= over


def brute(rows):
    size = {i: len((t or "").split()) for i, t, _ in rows}
    total = {}
    for i, _, s in rows:
        total[s] = total.get(s, 0) + size[i]
    goal, line = targets(total), []
    names = sorted((s for s in total if s is not None)) + ([None] if None in total else [])
    for rank, s in enumerate(names):
        queue = sorted((hashlib.md5(f"mix:{i}".encode()).hexdigest(), i) for i, _, x in rows if x == s)
        sent = 0
        for epoch in (0, 1):
            for key, i in queue:
                sent += size[i]
                line.append((sent / goal[s] if goal[s] else 0.0, rank, key, i, epoch))
    taken, mixed = dict.fromkeys(size, 0), 0
    for _, _, _, i, _ in sorted(line):
        mixed += size[i]
        if mixed > 1.5 * sum(total.values()):
            break
        taken[i] += size[i]
    return size, total, goal, taken


def corpus():
    rnd = random.Random(2)
    rows = []
    for i in range(400):
        source = rnd.choice(["hot"] * 5 + ["a", "b", "é", "Z", None, "tiny"])
        words = 1 if source == "tiny" else rnd.randrange(60)
        rows.append((i, None if i % 50 == 7 else " ".join(["w"] * words), source))
    return rows


def test_equals_brute_force_and_reruns_agree(llm):
    rows = corpus()
    df = llm.createDataFrame([(*r, 1, "x") for r in rows], DOCS)
    size, total, goal, taken = brute(rows)
    got = mix_sources(df).collect()
    assert {r["doc_id"]: (r["size"], r["source_size"], r["taken"]) for r in got} == {i: (size[i], total[s], taken[i]) for i, _, s in rows}
    for r in got:
        assert abs(r["target"] - goal[r["source"]]) < 1e-6 and r["taken"] <= 2 * r["size"] and r["taken"] == r["copies"] * r["size"]
    assert sorted(map(tuple, mix_sources(df.repartition(13)).collect()), key=repr) == sorted(map(tuple, got), key=repr)


def test_take_mix_repeats_rows(llm):
    rows = corpus()
    df = llm.createDataFrame([(*r, 1, "x") for r in rows] + [(7, None, "a", 1, "y")], DOCS)
    mixed = take_mix(df)
    assert mixed.columns == df.columns
    counts = {}
    for r in mixed.collect():
        counts[r["doc_id"]] = counts.get(r["doc_id"], 0) + 1
    want = {}
    for r in mix_sources(df).collect():
        if r["copies"]:
            want[r["doc_id"]] = want.get(r["doc_id"], 0) + r["copies"]
    assert counts == want


def test_edge_tables(llm):
    empty = llm.createDataFrame([], DOCS)
    assert mix_sources(empty).collect() == [] and take_mix(empty).collect() == []
    blank = llm.createDataFrame([(1, None, "a", 1, "x"), (None, "  ", None, 1, "x")], DOCS)
    assert [r["taken"] for r in mix_sources(blank).collect()] == [0, 0] and take_mix(blank).collect() == []
    repeated = llm.createDataFrame([(1, "a b", "s", 1, "x")] * 4 + [(None, "c d", "s", 1, "x")] * 2, DOCS)
    got = mix_sources(repeated).collect()
    assert len(got) == 6 and sum(r["taken"] for r in got) == 18
    assert take_mix(repeated).count() == 9
