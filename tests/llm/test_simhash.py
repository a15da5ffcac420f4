import random
import re

import numpy as np
import xxhash

from emberline.llm import simhash as S
from emberline.llm.components import components

DOCS = "doc_id long, text string, id int, bits string"


def brute_print(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(prints):
    parent = {i: i for i in prints}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in prints:
        for j in prints:
            if i < j and bin(prints[i] ^ prints[j]).count("1") <= 3:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in prints}


def corpus():
    rnd = random.Random(9)
    out = [None, "", "  ", "A", "a b", "a b c", "A\x85B\xa0c É é"]
    for _ in range(30):
        words = [f"w{rnd.randrange(3000)}" for _ in range(rnd.randrange(30, 400))]
        out += [" ".join(words), "\n".join(words).upper()]
        for _ in range(4):
            words[rnd.randrange(len(words))] = "changed"
            out.append(" ".join(words))
    return out


def test_groups_equal_brute_force(llm):
    rows = corpus()
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in S.simhash_groups(llm.createDataFrame([(i, t, 1, "x") for i, t in enumerate(rows)], DOCS)).collect()}
    prints = {i: brute_print(t) for i, t in enumerate(rows)}
    groups = brute_groups(prints)
    assert got == {i: (f"{prints[i]:016x}", groups[i]) for i in prints}
    assert len(set(groups.values())) < len(set(prints.values()))


def test_every_link_within_the_radius_is_found(llm, monkeypatch):
    rnd = random.Random(4)
    prints = {}
    while len(prints) < 500:
        base = rnd.getrandbits(64)
        for _ in range(rnd.choice([1, 2, 5, 40])):
            bits = base
            for _ in range(rnd.randrange(5)):
                bits ^= 1 << rnd.randrange(64)
            if bits not in prints.values():
                prints[len(prints)] = bits
    want = brute_groups(prints)
    df = llm.createDataFrame([(i, b - (1 << 64) if b >> 63 else b) for i, b in prints.items()], "id long, bits long")
    for tile, batch in ((S.TILE, "10000"), (7, "5")):
        monkeypatch.setattr(S, "TILE", tile)
        llm.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        found = {r["node"]: r["component"] for r in S.link_fingerprints(df).collect()}
        llm.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert {i: found.get(i, i) for i in prints} == want


def test_bit_planes_count_like_popcount():
    rnd = np.random.default_rng(1)
    a = rnd.integers(0, 1 << 63, 5000, dtype=np.uint64)
    flips = np.array([np.bitwise_or.reduce(np.uint64(1) << rnd.integers(0, 64, k, dtype=np.uint64)) if k else 0 for k in rnd.integers(0, 8, 5000)], dtype=np.uint64)
    for n in (1, 63, 64, 65, 5000):
        both = np.concatenate([a[:n], a[:n] ^ flips[:n]])
        assert S.within_radius(S.bit_planes(both), n, np.arange(n)).tolist() == np.flatnonzero(np.bitwise_count(flips[:n]) <= 3).tolist()
        some = np.arange(0, n, 3)
        assert S.within_radius(S.bit_planes(both), n, some).tolist() == [i for i in some if np.bitwise_count(flips[i]) <= 3]
    assert len(S.within_radius(S.bit_planes(np.concatenate([a, ~a])), len(a), np.arange(len(a)))) == 0


def test_long_text_goes_in_chunks(monkeypatch):
    text = " ".join(f"w{i % 977}" for i in range(5000))
    monkeypatch.setattr(S, "CHUNK", 100)
    assert S.fingerprint(text.encode()) == brute_print(text)


def test_null_ids_repeats_and_empty(llm):
    long = " ".join(f"v{i}" for i in range(60))
    rows = [(None, long), (5, long), (5, long), (None, "alone in the world"), (7, None), (8, ""), (9, "other words here now")]
    df = llm.createDataFrame([(*r, 1, "x") for r in rows], DOCS)
    got = sorted(((r["doc_id"] or 0, r["component_id"]) for r in S.simhash_groups(df).collect()), key=repr)
    assert got == [(0, 5), (0, None), (5, 5), (5, 5), (7, 7), (8, 7), (9, 9)]
    kept = S.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(((r["doc_id"] or 0, r["text"]) for r in kept.collect()), key=repr) == [(0, "alone in the world"), (0, long), (5, long), (7, None), (9, "other words here now")]
    assert S.simhash_groups(df.limit(0)).collect() == [] and S.keep_one(df.limit(0)).collect() == []


def test_components_of_chains_stars_and_nothing(llm):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(8, 60)] + [(3, 3), (None, 4), (900, 800), (800, 900)]
    got = {r["node"]: r["component"] for r in components(llm.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, **{i: 7 for i in range(7, 60)}, 800: 800, 900: 800}
    assert components(llm.createDataFrame([], "u long, v long")).collect() == []
