import hashlib
import random
from array import array

import public_tokenizers as P
import pytest
import tiktoken

from emberline.llm import bpe as B

PATH = P.path("byte_bpe_50k.tiktoken")
SPECIAL = ["", " ", "\n\n  \t x", "a" * 3000, "漢字かな交じり文", "é̀", "😀👩‍👩‍👧", "\x00\x7f ", "it's we'll THEY'RE", "1234567890" * 20, "<|endoftext|>", "​﻿", "ab" * 700]


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=B.load_ranks(PATH), special_tokens={})


def samples(seed, n):
    rnd = random.Random(seed)
    parts = ["a", " ", "é", "漢", "😀", "\n", "1", "the", "ing", "!!", " \t", "zz", "Ω", " of", "'s", "​", "tion"]
    return ["".join(rnd.choice(parts) for _ in range(rnd.randrange(60))) for _ in range(n)]


def test_ids_equal_the_definition(reference):
    for text in SPECIAL + samples(1, 1500):
        assert B.token_ids(text, PATH, P.PATTERN) == reference.encode_ordinary(text), text[:50]


def test_random_bytes_of_one_piece(reference):
    rnd = random.Random(4)
    machine = B.encoder(PATH, P.PATTERN).machine
    for _ in range(1500):
        piece = bytes(rnd.randrange(256) for _ in range(rnd.randrange(1, 20)))
        whole = machine.ranks.get(piece)
        assert machine.encode(piece) == ([whole] if whole is not None else [machine.ranks[p] for p in machine.merge(piece)])


def test_small_caches_and_blocks_change_nothing(reference, monkeypatch):
    for name in ("MAX_TRANSITIONS", "MAX_PIECES", "MAX_PAIRS", "BLOCK_CHARS", "BLOCK_PIECES"):
        monkeypatch.setattr(B, name, 7)
    coder = B.Encoder(PATH, P.PATTERN)
    for text in SPECIAL + samples(2, 200):
        assert array("I", b"".join(coder.encode(text))).tolist() == reference.encode_ordinary(text)


def test_own_vocabulary_with_tokens_that_merging_never_builds(tmp_path):
    import base64

    tokens = [bytes([i]) for i in range(256)] + [b"aa", b"ab", b"bc", b"aab", b"abc", b"xyz"]
    path = tmp_path / "ranks"
    path.write_text("".join(f"{base64.b64encode(t).decode()} {i}\n" for i, t in enumerate(tokens)))
    other = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=B.load_ranks(str(path)), special_tokens={})
    rnd = random.Random(6)
    for _ in range(800):
        text = "".join(rnd.choice("abcxyz") for _ in range(rnd.randrange(12)))
        assert B.token_ids(text, str(path), P.PATTERN) == other.encode_ordinary(text), text


def test_streaming_decode_holds_back_open_characters(reference):
    for text in SPECIAL + samples(3, 100):
        pieces = list(B.decode_ids(reference.encode_ordinary(text), PATH, P.PATTERN))
        assert "".join(pieces) == text
    ids = reference.encode_ordinary("漢字")
    assert "�" not in "".join(B.decode_ids(ids, PATH, P.PATTERN)) and "�" in "".join(B.decode_ids(ids[:1], PATH, P.PATTERN))


def test_documents(llm, reference):
    rows = [(i, t, 5) for i, t in enumerate([None, *SPECIAL, *samples(8, 50)])] + [(None, "x", 5), (0, None, 5)]
    df = llm.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = B.encode_documents(df, PATH, P.PATTERN, ("doc_id", "n_tokens")).collect()
    assert len(got) == len(rows)
    want = sorted((i is None, i or 0, len(reference.encode_ordinary(t or "")), hashlib.sha256(array("I", reference.encode_ordinary(t or "")).tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest(), True) for i, t, _ in rows)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"], r["ids_sha256"], r["decoded_sha256"], r["round_trip"]) for r in got) == want
    assert B.encode_documents(df.limit(0), PATH, P.PATTERN).collect() == []
