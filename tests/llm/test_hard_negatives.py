import math

import numpy as np
from pyspark.sql import functions as F

from emberline.llm import hard_negatives as H

ROWS = "vec_id long, embedding array<double>, label int, row string, v int, score long"


def brute(rows):
    """Over rows (vec_id, vector, label); every row with an even number of hundreds in its id is an anchor."""
    whole = []
    for vec_id, vector, label in rows:
        if label is not None and vector is not None and all(x is not None and math.isfinite(x) and math.isfinite(256.0 * x) for x in vector):
            whole.append((vec_id, [int(math.floor(256.0 * x)) for x in vector], label))

    def score(a, b):
        return min(max(sum(x * y for x, y in zip(a, b, strict=True)), -(1 << 63)), (1 << 63) - 1)

    out = []
    for i, (vec_id, vector, label) in enumerate(whole):
        if vec_id is None or vec_id % 10:
            continue
        others = sorted(((-score(vector, v), n is None, n or 0), n, m) for j, (n, v, m) in enumerate(whole) if j != i and len(v) == len(vector))
        for (p, _, _), positive, _ in [x for x in others if x[2] == label][:5]:
            fit = [x for x in others if x[2] != label and 80 * -p <= 100 * -x[0][0] <= 100 * -p]
            out += [(vec_id, positive, r + 1, n, -p, -s) for r, ((s, _, _), n, _) in enumerate(fit[:5])]
    return sorted(out, key=str)


def run(spark, rows):
    df = spark.createDataFrame([(i, v, m, "x", 1, 2) for i, v, m in rows], ROWS)
    got = H.hard_negatives(df, F.col("vec_id") % 10 == 0)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted((tuple(r) for r in got.collect()), key=str)


def clusters(seed, n, dim=12):
    """Clusters whose members have mixed labels, so that positives and negatives score alike; some vectors stand many times."""
    rnd = np.random.default_rng(seed)
    centers = rnd.standard_normal((6, dim))
    out = []
    for i in range(n):
        v = centers[rnd.integers(6)] * rnd.choice([0.5, 1.0, 2.0]) + rnd.standard_normal(dim) * rnd.choice([0.0, 0.1, 0.6])
        out.append((int(i), v.tolist(), int(rnd.integers(4))))
    return out


def test_equals_brute_force(llm):
    rows = clusters(1, 400)
    want = brute(rows)
    assert len(want) > 300 and run(llm, rows) == want


def test_many_tiles_blocks_and_pages(llm, monkeypatch):
    for name, value in (("TILE", 20), ("ANCHORS", 9), ("PAGE", 7)):
        monkeypatch.setattr(H, name, value)
    rows = clusters(2, 300) + [(1000 + i, [0.5] * 12, 1 + i % 2) for i in range(120)]
    want = brute(rows)
    assert len(want) > 300 and run(llm, rows) == want


def test_bounds_hold_and_cut():
    rnd = np.random.default_rng(3)
    vectors = np.concatenate([rnd.standard_normal((200, 8)), np.ones((20, 8)), -np.ones((20, 8)), rnd.standard_normal((200, 8)) * 0.05 + 3, np.zeros((1, 8))])
    vectors = np.floor(256 * vectors)
    units, norms = H.unit_vectors(vectors)
    angles = np.arccos(np.clip(units @ H.reference_directions(vectors[::7], 8).T, -1, 1))
    upper, lower = H.score_bounds(angles, norms, angles, angles, norms, norms)
    scores = vectors @ vectors.T
    assert (lower <= scores).all() and (scores <= upper).all()
    assert (upper < 0.8 * scores.max()).mean() > 0.3
    low, high = (f(angles.reshape(3, 147, -1), axis=1) for f in (np.min, np.max))
    up, down = H.score_bounds(angles, norms, low, high, *(f(norms.reshape(3, 147), axis=1) for f in (np.min, np.max)))
    blocks = scores.reshape(len(vectors), 3, 147)
    assert (down <= blocks.min(axis=2)).all() and (blocks.max(axis=2) <= up).all()


def test_edges(llm):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.9, 0.0], 2), (3, [0.9, 0.0], 2), (None, [0.9, 0.0], 3), (None, [1.0, 0.0], 1), (10, [1.0, 0.0], 1),
        (10, [1.0, 0.0], 1), (4, None, 1), (5, [1.0, None], 1), (6, [nan, 1.0], 1), (7, [inf, 1.0], 2), (8, [1.0, 0.0], None), (20, [0.0, 0.0], 1), (21, [0.0, 0.0], 2),
        (30, [], 1), (31, [], 1), (32, [], 2), (40, [1.0, 0.0, 0.0], 1), (41, [1.0, 0.0, 0.0], 1), (42, [0.9, 0.0, 0.0], 5), (50, [-1.0, -0.001], 1), (9, [1e306, 1.0], 1),
        (60, [1e200, 3.0], -3), (61, [1e200, 3.0], -3), (62, [1e190, 3.0], 2), (63, [1e200, 0.0], 2), (70, [1e-300, -1e-300], 7), (71, [1e7, 2e7], 7), (72, [2e7, 3e7], 7), (80, [3e7, 1e7], 7), (73, [2e7, 2e7], 8),
    ]
    want = brute(rows)
    assert len(want) > 20 and run(llm, rows) == want
    assert run(llm, []) == [] and run(llm, [(1, [1.0], 1)]) == [] and run(llm, [(10, [1.0], 1)]) == []
