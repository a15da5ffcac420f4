import math
import random
import re
from collections import Counter

import numpy as np

from emberline.llm import lexical as L

DOCS = "doc_id long, text string, item_id long, score string, part int"
ITEMS = "item_id long, text string, rank int, term string"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def cut(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k):
    bags = [(d, Counter(cut(t))) for d, t in docs]
    n_docs = sum(bool(b) for _, b in bags)
    total = sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        found = []
        for doc, bag in bags:
            score = 0
            for t in set(cut(text)) & set(bag):
                m = 50 + 50 * sum(bag.values()) * n_docs // total
                score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1000000000 * bag[t] // (1000 * bag[t] + 20 * m))
            if score > 0:
                found.append((-score, doc is None, doc or 0, doc))
        out += [(item, r + 1, doc, -s) for r, (s, _, _, doc) in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


def run(spark, docs, items, k):
    df = spark.createDataFrame([(d, t, 7, "x", 1) for d, t in docs], DOCS)
    asked = spark.createDataFrame([(i, t, 1, "x") for i, t in items], ITEMS)
    got = L.rank_documents(df, asked, k)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in got.collect()), key=str)


def texts(seed, n):
    rnd = random.Random(seed)
    words = [f"w{int(rnd.paretovariate(0.6)) % 400}" for _ in range(3000)] + ["Éau", "éau", "中文", "x_y", "A1"]
    docs = []
    for i in range(n):
        if docs and rnd.random() < 0.2:
            docs.append((i, rnd.choice(docs)[1]))
        else:
            docs.append((i, rnd.choice(" \n\x00,-").join(rnd.choice(words) for _ in range(rnd.choice([0, 1, 5, 30, 200])))))
    return docs, [(j, " ".join(rnd.choice(words) for _ in range(rnd.choice([1, 3, 12, 40])))) for j in range(25)]


def test_equals_brute_force_over_many_shards_blocks_and_windows(llm, monkeypatch):
    docs, items = texts(1, 700)
    for k in (1, 10):
        assert run(llm, docs, items, k) == brute(docs, items, k)
    index = L.build_index(llm.createDataFrame([(d, t, 7, "x", 1) for d, t in docs], DOCS))
    assert index.filter("term IS NULL").agg({"n_docs": "sum"}).first()[0] == sum(bool(cut(t)) for _, t in docs)
    # the functions that run in the tasks are called here too, with small blocks and windows
    monkeypatch.setattr(L, "ITEMS", 4)
    assert run(llm, docs, items, 50) == brute(docs, items, 50)


def _local(docs, items, k):
    """Search one shard without Spark; also the shares of blocks and of rejected blocks."""
    import pyarrow as pa

    schema = pa.schema([("shard", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lens", pa.list_(pa.int64())), ("n_docs", pa.int64()), ("n_terms", pa.int64()), ("term", pa.binary()), *L._INDEX])
    shard = L._Shard(3)
    for d, t in docs:
        shard.add(d, t.encode())
    rows = pa.Table.from_batches(list(shard.rows(schema)))
    head, posts = rows.slice(0, 1).to_pylist()[0], rows.slice(1)
    df = Counter()
    for t, n in zip(posts.column("term").to_pylist(), posts.column("size").to_pylist(), strict=True):
        df[t] += n
    weight = {t: math.floor(1000 * math.log((2 * head["n_docs"] + 2) / (2 * n + 1))) for t, n in df.items()}
    asks = {t: [j for j, (_, text) in enumerate(items) if t.decode() in cut(text)] for t in df}
    terms = posts.column("term").to_pylist()
    posts = posts.append_column("weight", pa.array([weight[t] for t in terms])).append_column("items", pa.array([asks[t] for t in terms]))
    m = L.length_factor(np.array(head["lens"]), head["n_docs"], head["n_terms"])
    out, held, opened = [], 0, 0
    for item in range(len(items)):
        lists = L._lists(posts, m, head["n_docs"], head["n_terms"]).get(item, [])
        best, points = L.search_shard(lists, len(m), k)
        out += [(items[item][0], r + 1, head["doc_ids"][b], int(p)) for r, (b, p) in enumerate(zip(best, points, strict=True))]
        held += sum(len(x.data) for x in lists)
        opened += sum(len(x.known) for x in lists)
    return sorted(out, key=str), held, opened


def test_small_windows_and_blocks_and_packed_blocks_that_stay_closed(monkeypatch):
    monkeypatch.setattr(L, "BLOCK", 4)
    monkeypatch.setattr(L, "WINDOW", 16)
    docs, items = texts(2, 900)
    for k in (1, 5, 50):
        got, held, opened = _local(docs, items, k)
        assert got == brute(docs, items, k)
        if k == 1:
            assert opened < 0.7 * held


def test_numbers_survive_packing():
    rnd = np.random.default_rng(1)
    numbers = np.concatenate([np.arange(300), rnd.integers(0, 1 << 33, 500), [0, 127, 128, 16383, 16384, (1 << 21) - 1, 1 << 21, 1 << 28]])
    data, starts = L.pack(numbers)
    assert (L.unpack(data.tobytes()) == numbers).all() and starts[-1] == len(data)


def test_edges(llm):
    long = "lang " * 200_000 + "kurz"
    docs = [(5, "same words here"), (3, "same words here"), (3, "same words here"), (None, "same words here"), (4, None), (6, ""), (7, "?! \x7f"), (8, long), (9, "KURZ É")]
    items = [(1, "Same same WORDS"), (1, "kurz"), (None, "é É"), (2, None), (3, ""), (4, "absent"), (5, "lang")]
    assert run(llm, docs, items, 50) == brute(docs, items, 50)
    assert run(llm, docs, items, 2) == brute(docs, items, 2)
    assert run(llm, [], items, 50) == [] and run(llm, docs, [], 50) == [] and run(llm, [(1, None)], items, 50) == []
