import numpy as np

from emberline.llm import embedding_dedup as E

ROWS = "vec_id long, embedding array<double>, v int, key string"


def brute(rows):
    ok = [(i, np.array(v)) for i, v in rows if i is not None and v and None not in v]
    ok = [(i, v) for i, v in ok if np.isfinite(v).all() and v.any()]
    want = {i: [0, i] for i, _ in rows}
    ok = [(i, v / np.abs(v).max()) for i, v in ok]
    links = {i: {j for j, w in ok if j != i and len(v) == len(w) and v @ w / np.sqrt(v @ v) / np.sqrt(w @ w) >= 0.9} for i, v in ok}
    for i in sorted(links):
        if want[i][1] == i:
            stack = [i]
            seen = {i}
            while stack:
                for j in links[stack.pop()] - seen:
                    seen.add(j)
                    stack.append(j)
            for j in seen:
                want[j][1] = min(want[j][1], min(seen))
    for i, x in links.items():
        want[i][0] = len(x)
    return {i: (n, c, c == i) for i, (n, c) in want.items()}


def run(spark, rows):
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], ROWS)
    return {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in E.embedding_groups(df).collect()}


def vectors(seed, n):
    rnd = np.random.default_rng(seed)
    out = []
    for i in range(n):
        v = rnd.standard_normal(16)
        if i % 3 == 0 and out:
            v = np.array(out[rnd.integers(len(out))][1]) + rnd.standard_normal(16) * rnd.choice([0, 0.05, 0.3])
        out.append((int(1000 - i if i % 2 else i), v.tolist()))
    return out


def test_equals_brute_force_with_deep_trees_and_tiles(llm, monkeypatch):
    rows = vectors(1, 600)
    assert run(llm, rows) == brute(rows)
    monkeypatch.setattr(E, "LEAF", 40)
    monkeypatch.setattr(E, "TILE", 30)
    monkeypatch.setattr(E, "ROWS", 16)
    assert run(llm, rows) == brute(rows)


def test_one_dense_group_is_tiled_not_dropped(llm, monkeypatch):
    monkeypatch.setattr(E, "TILE", 50)
    rnd = np.random.default_rng(2)
    center = rnd.standard_normal(16)
    rows = [(i, (center + rnd.standard_normal(16) * 0.02).tolist()) for i in range(400)] + [(1000 + i, center.tolist()) for i in range(50)]
    got = run(llm, rows)
    assert set(got.values()) == {(449, 0, True), (449, 0, False)}


def test_vectors_that_cannot_link(llm):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, []), (7, [1.0, 0.0]), (8, [0.0, 1.0]),
            (9, [-0.0, 2.0]), (10, [1.0, None]), (11, [float("inf"), 1.0]), (12, [1.0, 0.0, 0.0]), (13, [1e200, 1e200])]
    got = run(llm, rows)
    assert got[1] == (2, 1, True) and got[2] == (2, 1, False) and got[7] == (2, 1, False) and got[9] == (1, 8, False)
    assert all(got[i] == (0, i, True) for i in (3, 4, 5, 6, 10, 11, 12, 13))
    assert run(llm, [(None, [1.0, 0.0]), (4, [1.0, 0.0])]) == {None: (0, None, True), 4: (0, 4, True)}
    assert run(llm, []) == {}


def test_a_loose_dense_group_ends_in_few_leaves():
    n, dense = 100_000, 33_333
    rnd = np.random.default_rng(3)
    noise, center = E._unit(rnd.standard_normal((n, 64))), E._unit(rnd.standard_normal((1, 64)))
    chosen = np.sort(rnd.permutation(n)[: E.SAMPLE])
    one, two = rnd.integers(0, dense, (2, 5000))
    for cosine in (0.93, 0.945, 0.96):
        vectors = noise.astype(np.float32)
        vectors[:dense] = E._unit(np.sqrt(cosine) * center + np.sqrt(1 - cosine) * noise[:dense])
        sample, together = vectors[chosen], np.zeros(len(one), bool)
        for seed in (11, 12):
            tree, leaves = E.grow_tree(sample, E.LEAF * len(sample) / n, seed, E.SPILL * float(np.sqrt(0.2) / 8))
            assert leaves < 2000
            row, leaf = tree.leaves(vectors)
            assert len(row) <= 8 * n
            held = np.unique(row * leaves + leaf)
            reached = np.split(leaf[np.argsort(row, kind="stable")], np.cumsum(np.bincount(row, minlength=n))[:-1])
            assert len(held) == len(row)
            together |= np.array([bool(set(reached[a]) & set(reached[b])) for a, b in zip(one, two, strict=True)])
        links = (vectors[one].astype(np.float64) * vectors[two]).sum(axis=1) >= E.MIN_COSINE
        assert links.sum() > 4000 and together[links].mean() >= 0.9


def test_vectors_of_any_length_and_norm_link(llm, monkeypatch):
    rows = vectors(4, 300) + [(2000 + i, [*v, 0.5]) for i, v in vectors(5, 200)] + [(3000 + i, v[:3]) for i, v in vectors(6, 40)]
    rows = [(i, (np.array(v) * (10.0 ** (-290 + 29 * (i % 21)))).tolist()) for i, v in rows]
    rows += [(5000, [1.0, 0.0, 0.0, 0.0]), (5001, [1e200, 0.0, 0.0, 1e-200]), (5002, [5e-324, 0.0, 0.0, 0.0]), (5003, [1e308] * 2), (5004, [1e-320] * 2), (5005, [3.0])]
    want = brute(rows)
    assert sum(n > 0 for n, *_ in want.values()) > 100 and want[5001][1] == want[5002][1] == 5000 and want[5004][1] == 5003
    assert run(llm, rows) == want
    monkeypatch.setattr(E, "LEAF", 40)
    monkeypatch.setattr(E, "TILE", 30)
    assert run(llm, rows) == want


def test_leaves_shared_by_two_vectors_are_found_in_portions(monkeypatch):
    import pyarrow as pa

    rnd = np.random.default_rng(8)
    sets = [set(rnd.integers(0, 60, rnd.integers(0, 9)).tolist()) for _ in range(50)]
    lists = pa.array([sorted(x) for x in sets], pa.list_(pa.int32()))
    want = [[any(x < 40 for x in a & b) for b in sets] for a in sets]
    for size in (1, 7, 1000):
        monkeypatch.setattr(E, "SHARED", size)
        assert E._share_smaller(40, lists).tolist() == want


def test_leaves_stay_small_where_the_sample_is_a_small_share(llm, monkeypatch):
    rows = vectors(9, 3000) + [(5000 + i, v) for i, v in vectors(10, 300)] + [(9000 + i, [*v, 1.0]) for i, v in vectors(12, 200)]
    center = np.random.default_rng(7).standard_normal(16)
    rows += [(20_000 + i, (center + np.random.default_rng(i).standard_normal(16) * 0.01).tolist()) for i in range(300)]  # refuses to split
    widths, refit = [], E._refit
    def spied(routed, forests, seed):
        def counts(df):
            return {r["leaf"]: r["count"] for r in df.selectExpr("explode(leaves) AS leaf").groupBy("leaf").count().collect()}
        out = refit(routed, forests, seed)
        widths.extend([counts(routed), counts(out)])
        assert out.count() == routed.count() and out.filter("size(leaves) < 6 OR size(array_distinct(leaves)) < size(leaves)").isEmpty()
        return out
    monkeypatch.setattr(E, "_refit", spied)
    monkeypatch.setattr(E, "SAMPLE", 200)
    monkeypatch.setattr(E, "REFITS", 9)  # dense leaves refuse four times, the others part five times at most
    monkeypatch.setattr(E, "LEAF", 60)
    monkeypatch.setattr(E, "TILE", 100)
    got, want = run(llm, rows), brute(rows)
    before, after = widths
    assert sum(before.values()) <= sum(after.values()) <= E.COPIES * 6 * len(rows)
    pairs = [sum(n * n for n in w.values() if n < 300) for w in widths]
    assert max(n for n in after.values() if n < 300) < max(before.values()) / 2 and pairs[1] < sum(n * n for n in before.values()) / 2
    assert all(got[i][0] <= want[i][0] for i in want) and sum(n for n, *_ in got.values()) >= 0.9 * sum(n for n, *_ in want.values())
    assert all(got[20_000 + i][0] >= 299 for i in range(300))  # the dense group whole
