import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberline.llm import context_tree as C

DOCS = "doc_id long, text string, chunk long, gram string, word int"


def words(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())


def held(doc_id):
    return zlib.crc32(str(doc_id).encode() if doc_id is not None else b"") % 5 == 1


def is_held():
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 1


def brute(docs, depth):
    """The definition: trees of nodes with counts, weighted recursively."""
    nodes = defaultdict(lambda: [0, 0])
    children = defaultdict(set)

    def steps(text):
        data = b"\n" * depth + b" ".join(words(text)) + b"\n"
        for i in range(depth, len(data)):
            so_far = 1
            for b in range(7, -1, -1):
                bit = data[i] >> b & 1
                yield [(so_far, data[i - d : i]) for d in range(depth + 1)], bit
                so_far = so_far << 1 | bit

    for doc, text in docs:
        if not held(doc):
            for path, bit in steps(text):
                for d, node in enumerate(path):
                    nodes[node][bit] += 1
                    if d:
                        children[path[d - 1]].add(node)

    def kt(node):
        a, b = nodes[node]
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    weighted, own = {}, {}
    for node in sorted(nodes, key=lambda x: -len(x[1])):
        if len(node[1]) == depth:
            weighted[node], own[node] = kt(node), 1.0
        else:
            k, below = kt(node), sum(weighted[c] for c in children[node])
            weighted[node] = np.logaddexp(k, below) - math.log(2)
            own[node] = math.exp(k - np.logaddexp(k, below))

    def probability(path, d):
        a, b = nodes[path[d]]
        p = (b + 0.5) / (a + b + 1)
        if d == depth or path[d + 1] not in weighted:
            return p
        return own[path[d]] * p + (1 - own[path[d]]) * probability(path, d + 1)

    counts = Counter(t for doc, text in docs if not held(doc) for t in [*words(text), b"\n"])
    total, distinct = sum(counts.values()), len(counts)
    out = []
    for doc, text in docs:
        tokens = [*words(text), b"\n"]
        base = sum(math.log10((counts[t] + 0.5) / (total + 0.5 * (distinct + 1))) for t in tokens)
        score = 0.0
        for path, bit in steps(text):
            p = probability(path, 0) if path[0] in weighted else 0.5
            score += math.log10(p if bit else 1 - p)
        out.append((doc, held(doc), len(tokens), sum(counts[t] > 0 for t in tokens), total, base, score))
    return sorted(out, key=str)


def run(spark, docs, depth=3):
    df = spark.createDataFrame([(d, t, 9, "x", 1) for d, t in docs], DOCS)
    return sorted((tuple(r) for r in C.score_texts(df, is_held(), depth).collect()), key=str)


def same(got, want):
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want, strict=True):
        assert g[5] == pytest.approx(w[5], rel=1e-9) and g[6] == pytest.approx(w[6], rel=1e-4, abs=1e-6)
        assert g[8] == pytest.approx(-g[6] / math.log10(2) / g[7])


def corpus(seed, n):
    rnd = random.Random(seed)
    parts = ["an", "er", "ou", "the", "ión", "THE", "x"]
    vocabulary = ["".join(rnd.choice(parts) for _ in range(rnd.choice([1, 2, 3]))) for _ in range(60)]
    return [(i, rnd.choice([" ", "\n", "\t  "]).join(rnd.choice(vocabulary) for _ in range(rnd.choice([0, 1, 6, 40])))) for i in range(n)]


def test_equals_the_definition(llm):
    docs = corpus(1, 120)
    for depth in (1, 3, 6):
        same(run(llm, docs, depth), brute(docs, depth))


def test_no_order_and_no_chunk_changes_a_score(llm):
    docs = corpus(2, 200)
    one = run(llm, docs)
    random.Random(3).shuffle(docs)
    assert run(llm, docs) == one
    df = llm.createDataFrame([(d, t, 9, "x", 1) for d, t in docs], DOCS).repartition(31)
    assert sorted((tuple(r) for r in C.score_texts(df, is_held(), 3).collect()), key=str) == one


def test_small_blocks_give_the_same_grams(monkeypatch):
    texts = [b"abc def\n", b"\n", b"a b c d e f g h i j\n"]
    sizes = np.array([len(t) for t in texts])
    padded = b"".join(b"\n\n" + t for t in texts)
    want = [int.from_bytes((b"\n\n" + t)[i : i + 3], "big") for t in texts for i in range(len(t))]
    for size in (1, 3, 7, 100):
        monkeypatch.setattr(C, "BLOCK_BYTES", size)
        portions = list(C.grams(padded, sizes, 2))
        assert np.concatenate([k for _, k in portions]).tolist() == want
        assert np.concatenate([p for p, _ in portions]).tolist() == list(range(len(want)))


def test_held_out_texts_are_coded_better_than_by_their_words(llm):
    rnd = random.Random(4)
    tongues = [["an", "er", "ou", "the", "ion", "re", "st", "bl"], ["aux", "eil", "què", "mo", "sse", "tar", "lu", "di"]]
    docs = []
    for i in range(400):
        parts = rnd.choice(tongues)
        docs.append((i, " ".join("".join(rnd.choice(parts) for _ in range(rnd.choice([2, 3, 4]))) for _ in range(60))))
    got = [r for r in run(llm, docs, 5) if r[1]]
    assert len(got) > 40 and sum(r[6] for r in got) > sum(r[5] for r in got)


def test_edges(llm):
    docs = [(0, None), (1, ""), (2, " \n "), (2, "again"), (2, "again"), (None, "again Again"), (7, "é" * 3), (8, "wort " * 60_000)]
    same(run(llm, docs, 2), brute(docs, 2))
    assert run(llm, []) == []
    only = [(d, "a b") for d in range(40) if held(d)]
    for row in run(llm, only):
        assert row[4] == 0 and row[3] == 0 and row[6] == pytest.approx(4 * 8 * math.log10(0.5))
    with pytest.raises(ValueError):
        run(llm, docs, 7)
