"""Content-defined anchors: places that every copy of a long enough string has in common."""

from __future__ import annotations

import numpy as np

#: Odd multiplier of the rolling hash, modulo 2**64.
BASE = np.uint64(0x9E3779B97F4A7C15)
#: Places handled at a time; must stay below the 2**24 that a place in a chunk may use.
CHUNK = 1 << 22
_PLACE = np.uint64((1 << 24) - 1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A hash of every ``size`` bytes of ``data`` that depends on these bytes alone."""
    n = len(data)
    powers = np.cumprod(np.full(n + 1, BASE))
    sums = np.zeros(n + 1, np.uint64)
    # weight the byte at place i by BASE ** (n - i), so that dividing a difference by a power is a multiplication
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[n - 1 :: -1][:n], out=sums[1:])
    return _mixed((sums[size:] - sums[:-size]) * _inverse_powers(n, size))


def _inverse_powers(n: int, size: int) -> np.ndarray:
    inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
    return np.cumprod(np.full(n + 1, inverse))[n - size :: -1]


def window_minima(keys: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every ``width`` neighbouring keys, from running minima of blocks in both directions."""
    n = len(keys)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = keys
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def _repetitive(data: np.ndarray, gram: int) -> np.ndarray:
    """For each gram, whether its first half stands in it a second time, as in text that repeats a few words.

    Sixteen bits of the hash tell halves apart: about one gram in a thousand counts as repetitive without being so. That is
    still a function of its bytes alone, and only makes it a less likely anchor.
    """
    half = gram // 2
    hashes = gram_hashes(data, half).astype(np.uint16)
    number = len(data) - gram + 1
    out = np.zeros(number, bool)
    for step in range(1, half + 1):
        out |= hashes[:number] == hashes[step : step + number]
    return out


def anchors(data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each string of ``length`` bytes of ``data``, the smallest hash of ``gram`` bytes within; leftmost if several are.

    Repetitive grams count as larger than all others, so that a string which reaches beyond a repetition has its anchor
    there and not in the repetition, which it may share with many texts. Returns the runs of string starts that
    share an anchor: hash, place of the gram, first and last start. Equal strings have equal grams at equal distances from
    their starts, wherever they stand. At most CHUNK starts are handled at a time.
    """
    out = []
    for at in range(0, max(0, len(data) - length + 1), CHUNK):
        part = data[at : at + CHUNK + length - 1]
        hashes = gram_hashes(part, gram)
        keys = (_repetitive(part, gram).astype(np.uint64) << np.uint64(63)) | ((hashes >> np.uint64(1)) & ~_PLACE) | np.arange(len(hashes), dtype=np.uint64)
        place = (window_minima(keys, length - gram + 1) & _PLACE).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        last = np.concatenate([first[1:], [len(place)]]) - 1
        out.append((hashes[place[first]], place[first] + at, first + at, last + at))
    if not out:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, none
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))
