"""Byte-level BPE as a lazily determinised finite-state transducer, and streaming decoding."""

from __future__ import annotations

import base64
import codecs
import hashlib
from array import array
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import islice

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Transitions and cached pieces that a worker keeps; beyond, it starts anew. Neither changes a result.
MAX_TRANSITIONS = 300_000
MAX_PIECES = 200_000
MAX_PAIRS = 1_000_000
#: Above any rank.
NEVER = 1 << 60
#: Texts longer than this (in characters) are split piece by piece and sent on in blocks.
BLOCK_CHARS = 1_000_000
BLOCK_PIECES = 65_536

RESULT = "n_tokens long, ids_sha256 string, decoded_sha256 string, round_trip boolean"


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(None, map(bytes.strip, lines)))}


class Transducer:
    """Reads the bytes of one piece of text and emits the tokens of its byte-pair encoding.

    The nondeterministic machine guesses token ends: a guess is (last whole token, place in the trie of token bytes,
    tokens not yet emitted). A token may follow another only if merging the bytes of the two leaves just these two; a
    sequence whose neighbours all pass is the encoding, so at the end exactly one guess stands. Guesses are grouped into
    states of a deterministic machine when a text first reaches them, and a token is emitted once all guesses agree on
    it, which takes a bounded number of further bytes.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.edges: dict[int, tuple[list[int], list[int]] | None] = {}
        self.children: dict[int, int] = {}
        self.ends: dict[int, int] = {}
        for token, rank in ranks.items():
            node = 0
            for byte in token:
                node = self.children.setdefault(node << 8 | byte, len(self.children) + 1)
            self.ends[node] = rank
        self._reset()

    def _reset(self) -> None:
        self.states: list[tuple] = [((-1, 0, ()),)]
        self.numbers = {self.states[0]: 0}
        self.moves: dict[int, tuple[int, tuple[int, ...]]] = {}

    def merge(self, piece: bytes, below: int = NEVER) -> list[bytes]:
        """The definition: join the pair of lowest rank, leftmost first, while there is one of a rank under ``below``."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], NEVER), i) for i in range(len(parts) - 1))
            if rank >= below:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _edge(self, token: int) -> tuple[list[int], list[int]] | None:
        """Ranks of the parts at the left and the right edge of a token while it is built, the token last.

        None for a token that merging its bytes does not build.
        """
        if token not in self.edges:
            piece = self.tokens[token]
            if len(piece) == 1:
                self.edges[token] = [token], [token]
            elif len(parts := self.merge(piece, token)) != 2 or self.merge(piece) != [piece]:
                self.edges[token] = None
            else:
                self.edges[token] = [*self._edge(self.ranks[parts[0]])[0], token], [*self._edge(self.ranks[parts[1]])[1], token]
        return self.edges[token]

    def follows(self, last: int, token: int) -> bool:
        """Whether ``last`` and ``token`` stay apart when their bytes are merged together.

        Parts grow in the order of their ranks. At each moment the parts beside the border are known from the two
        edges, and they join if the rank of the joint part comes before the next growth of either.
        """
        if (right := self._edge(token)) is None or (left := self._edge(last) if last >= 0 else ([], [])) is None:
            return False
        if last < 0:
            return True
        before, after = left[1], right[0]
        i = j = 0
        while True:
            grow_before = before[i + 1] if i + 1 < len(before) else NEVER
            grow_after = after[j + 1] if j + 1 < len(after) else NEVER
            joint = self.ranks.get(self.tokens[before[i]] + self.tokens[after[j]], NEVER)
            # of equal ranks the leftmost goes first: growth before the border, then the border, then growth after it
            if joint < NEVER and joint < grow_before and joint <= grow_after:
                return False
            if grow_before == grow_after == NEVER:
                return True
            if grow_before <= grow_after:
                i += 1
            else:
                j += 1

    def _move(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        guesses, children, ends, pairs = [], self.children, self.ends, self.pairs
        done = None
        for last, node, pending in self.states[state]:
            node = children.get(node << 8 | byte)
            if node is None:
                continue
            guesses.append((last, node, pending))
            token = ends.get(node)
            if token is not None and done is None:  # at most one encoding ends here
                known = pairs.get((last, token))
                if known is None:
                    if len(pairs) > MAX_PAIRS:
                        pairs.clear()
                    known = pairs[last, token] = self.follows(last, token)
                if known:
                    done = (token, 0, (*pending, token))
        guesses.append(done)
        agreed = 0
        shortest = min(guesses, key=lambda g: len(g[2]))[2]
        while agreed < len(shortest) and all(g[2][agreed] == shortest[agreed] for g in guesses):
            agreed += 1
        if agreed:
            guesses = [(last, node, pending[agreed:]) for last, node, pending in guesses]
        found = tuple(guesses)
        number = self.numbers.get(found)
        if number is None:
            number = self.numbers[found] = len(self.states)
            self.states.append(found)
        return number, shortest[:agreed]

    def encode(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:  # a piece that is a token stays one, even if merging would not build it
            return [whole]
        if len(self.moves) > MAX_TRANSITIONS:
            self._reset()
        state, out, moves = 0, [], self.moves
        for byte in piece:
            key = state << 8 | byte
            move = moves.get(key)
            if move is None:
                move = moves[key] = self._move(state, byte)
            state, emitted = move
            if emitted:
                out += emitted
        return out + [*self.states[state][-1][2]]  # the last guess of a state is the one that ends here


class Pieces(dict):
    """Ids of the pieces met, in two generations: when the younger is full it becomes the older."""

    def __init__(self, machine: Transducer):
        super().__init__()
        self.machine, self.older = machine, {}

    def __missing__(self, piece: str) -> bytes:
        found = self.older.get(piece)
        if found is None:
            found = array("I", self.machine.encode(piece.encode())).tobytes()
        if len(piece) <= 64:
            if len(self) >= MAX_PIECES:
                self.older = dict(self)
                self.clear()
            self[piece] = found
        return found


class Encoder:
    """Text to token ids."""

    def __init__(self, path: str, pattern: str):
        self.machine = Transducer(load_ranks(path))
        self.pattern = regex.compile(pattern)
        self.vocabulary = [self.machine.tokens.get(i, b"") for i in range(max(self.machine.tokens, default=-1) + 1)]
        self.ids = Pieces(self.machine).__getitem__

    def encode(self, text: str) -> Iterator[bytes]:
        """Blocks of ids as little-endian unsigned 32-bit integers."""
        if len(text) <= BLOCK_CHARS:
            yield b"".join(map(self.ids, self.pattern.findall(text)))
            return
        matches = self.pattern.finditer(text)
        while block := [m.group() for m in islice(matches, BLOCK_PIECES)]:
            yield b"".join(map(self.ids, block))

    def decode(self, blocks: Iterable[bytes]) -> Iterator[tuple[bytes, str]]:
        """Bytes and characters of each block of ids.

        A character whose bytes two blocks share comes with the later one: the incremental decoder keeps the state
        between blocks. Bytes that are no UTF-8 become U+FFFD.
        """
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        for block in blocks:
            found = b"".join(map(self.vocabulary.__getitem__, array("I", block)))
            yield found, machine.decode(found)
        yield b"", machine.decode(b"", True)


@cache
def encoder(path: str, pattern: str) -> Encoder:
    """One per worker process, so that texts of later tasks meet a warm machine."""
    return Encoder(path, pattern)


def digest(text: bytes | None, coder: Encoder) -> tuple[int, str, str, bool]:
    whole = (text or b"").decode("utf-8", "replace")
    n, at, same = 0, 0, True
    ids, decoded = hashlib.sha256(), hashlib.sha256()

    def counted() -> Iterator[bytes]:
        nonlocal n
        for block in coder.encode(whole):
            n += len(block) // 4
            ids.update(block)
            yield block

    for found, characters in coder.decode(counted()):
        decoded.update(found)
        same = same and whole.startswith(characters, at)
        at += len(characters)
    return n, ids.hexdigest(), decoded.hexdigest(), same and at == len(whole)


def encode_documents(docs: DataFrame, path: str, pattern: str, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``columns`` of ``docs`` with ``n_tokens``, ``ids_sha256`` (of the ids as little-endian unsigned 32-bit
    integers), ``decoded_sha256`` (of the bytes they decode to) and ``round_trip`` (decoded text equals the input).

    ``path`` names a rank file (base64 token and rank per line) that every executor can open, ``pattern`` the expression
    that splits a text; special tokens do not exist. One row per row of ``docs``, nothing is shuffled. A null text
    is empty and has no tokens; bytes that are no UTF-8 are read as U+FFFD; long texts go through in blocks; repeated rows
    give repeated results; columns of ``docs`` with the names of results are left out.
    """
    names = [c for c in columns if c not in ("n_tokens", "ids_sha256", "decoded_sha256", "round_trip")]
    rows = docs.select(*names, F.col("text").cast("binary").alias("_text"))
    schema = f"{', '.join(f'`{c}` {rows.schema[c].dataType.simpleString()}' for c in names)}{', ' if names else ''}{RESULT}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path, pattern)
        for batch in batches:
            found = [digest(t.as_py(), coder) for t in batch.column(len(names))]
            results = [pa.array([f[i] for f in found], kind) for i, kind in enumerate((pa.int64(), pa.string(), pa.string(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *results], names=[*names, "n_tokens", "ids_sha256", "decoded_sha256", "round_trip"])

    return rows.mapInArrow(run, schema)


def token_ids(text: str, path: str, pattern: str) -> list[int]:
    """The ids of one text."""
    return [i for block in encoder(path, pattern).encode(text) for i in array("I", block)]


def decode_ids(ids: Iterable[int], path: str, pattern: str) -> Iterator[str]:
    """Characters as they become complete, for a stream of ids."""
    return (s for _, s in encoder(path, pattern).decode(array("I", [i]).tobytes() for i in ids))
