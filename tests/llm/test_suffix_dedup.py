import collections
import random

import numpy as np
import pytest

from emberline.llm import suffix_dedup as S
from emberline.llm.anchors import anchors, gram_hashes, window_minima

ROWS = "doc_id long, text string, n_bytes int, key string"


def brute(texts):
    counts = collections.Counter(t[i : i + S.LENGTH] for t in texts for i in range(len(t) - S.LENGTH + 1))
    for t in texts:
        covered = bytearray(len(t))
        for i in range(len(t) - S.LENGTH + 1):
            if counts[t[i : i + S.LENGTH]] > 1:
                covered[i : i + S.LENGTH] = b"\1" * S.LENGTH
        yield len(t), sum(covered), len([x for x in bytes(covered).split(b"\0") if x]), bytes(b for b, c in zip(t, covered, strict=True) if not c)


def check(spark, texts):
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], ROWS)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in S.remove_repeats(df).collect()}
    assert got == dict(enumerate(brute([(t or "").encode() for t in texts])))


def planted(seed):
    rnd = random.Random(seed)
    text = lambda n: "".join(rnd.choice("abcdefgh éö\n") for _ in range(n))
    passages = [text(n) for n in (450, 399, 400, 1000, 300)]
    texts = ["", None, "x" * 3000, "ab" * 700]
    for _ in range(40):
        t = text(rnd.randrange(600))
        for _ in range(rnd.randrange(4)):
            p = rnd.choice(passages)
            t += p[rnd.randrange(0, max(1, len(p) - 390)) :] + text(rnd.randrange(300))
        texts.append(t)
    return [*texts, passages[3], passages[3], "x" * 401, passages[3][:600] + "q" + passages[3][600:], ("pq" * 60 + "z") * 20]


def test_equals_brute_force(llm):
    check(llm, planted(5))


def test_small_buckets_compare_across_their_borders(llm, monkeypatch):
    # one passage in many texts, so that its suffixes spread over several buckets and several portions of one
    monkeypatch.setattr(S, "SUFFIXES", 500)
    monkeypatch.setattr(S, "RANGE_BYTES", 2000)
    rnd = random.Random(1)
    shared = "".join(rnd.choice("abcdef") for _ in range(380))
    texts = [f"{i:05d}" * 9 + shared + f"{i % 7:04d}" * 20 for i in range(60)]
    check(llm, texts + ["short", None])


def test_empty_table_and_lengths_at_the_limit(llm):
    assert S.remove_repeats(llm.createDataFrame([], ROWS)).collect() == []
    a = "".join(chr(97 + i * 7 % 26) for i in range(399)) + "!"
    check(llm, [a, a, a[:399], a[:399], a + "z"])


def test_null_and_repeated_ids(llm):
    text = "".join(chr(33 + i * 31 % 90) for i in range(500))
    rows = [(None, text, 1, "x"), (None, text, 1, "x"), (3, "short", 1, "x"), (3, "short", 1, "x"), (4, None, 1, "x")]
    got = S.remove_repeats(llm.createDataFrame(rows, ROWS)).collect()
    assert sorted((r["doc_id"] or 0, r["n_removed"]) for r in got) == [(0, 500), (0, 500), (3, 0), (3, 0), (4, 0)]


def test_anchors_follow_the_text_wherever_it_stands():
    rnd = np.random.default_rng(3)
    passage = rnd.integers(97, 103, 900).astype(np.uint8)
    seen = []
    for before in (0, 1, 57, 1300):
        data = np.concatenate([rnd.integers(97, 103, before).astype(np.uint8), passage, rnd.integers(97, 103, 40).astype(np.uint8)])
        hashes, places, firsts, lasts = anchors(data, 400, 128)
        which = np.searchsorted(firsts, np.arange(before, before + 501), side="right") - 1
        assert (lasts[which] >= np.arange(before, before + 501)).all()
        seen.append([(int(hashes[w]), int(places[w]) - before) for w in which])
    assert all(s == seen[0] for s in seen)


def test_window_minima_and_hashes():
    rnd = np.random.default_rng(4)
    keys = rnd.integers(0, 50, 1000).astype(np.uint64)
    assert window_minima(keys, 13).tolist() == [keys[i : i + 13].min() for i in range(988)]
    data = rnd.integers(97, 99, 500).astype(np.uint8)
    by_gram = collections.defaultdict(set)
    for i, h in enumerate(gram_hashes(data, 6).tolist()):
        by_gram[bytes(data[i : i + 6])].add(h)
    assert all(len(h) == 1 for h in by_gram.values()) and len(set().union(*by_gram.values())) == len(by_gram)


@pytest.mark.parametrize("runs,want", [([], (0, 0)), ([(0, 0)], (400, 1)), ([(0, 5), (405, 405)], (805, 1)), ([(0, 0), (401, 401)], (800, 2))])
def test_spans(runs, want):
    kept, removed, spans = S.cut_spans(bytes(1000), runs)
    assert (removed, spans) == want and len(kept) == 1000 - removed
