"""Word shingles of whole texts as 64-bit hashes, many texts at a time."""

from __future__ import annotations

import numpy as np

_random = np.random.Generator(np.random.PCG64(20_240_601))
_ODD = _random.integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTE = _random.integers(1, 2**63, 256, dtype=np.uint64)
_BYTE[0x41:0x5B] = _BYTE[0x61:0x7B]  # A-Z count as a-z
_BYTE[_SPACE] = 0
_BASE = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """``(hashes, counts)``: the words of all texts one after another, and how many each text has.

    Words are runs of anything but blank, tab, line feed, vertical tab, form feed
    and carriage return; A-Z are lower-cased.
    """
    coded = [text.encode() for text in texts]
    data = np.frombuffer(b"\n" + b"\n".join(coded) + b"\n", np.uint8)
    space = _SPACE[data]
    start = np.flatnonzero(~space[1:] & space[:-1]) + 1
    text_ends = np.cumsum([len(text) + 1 for text in coded])
    counts = np.diff(np.searchsorted(start, np.r_[0, text_ends], "right"))
    if not len(start):
        return np.zeros(0, np.uint64), counts
    size = np.diff(np.r_[start, len(data)])
    place = np.arange(start[0], len(data)) - np.repeat(start, size)  # in the word, running on over the space behind it
    powers = np.cumprod(np.full(int(size.max()), _BASE, np.uint64))
    values = _BYTE[data[start[0] :]] * powers[place]
    return mixed(np.add.reduceat(values, start - start[0])), counts


def shingle_sets(texts: list[str], words: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's shingles of ``words`` words.

    A text with fewer words is one shingle, one without words has none.
    """
    hashes, counts = word_hashes(texts)
    n = max(0, len(hashes) - words + 1)
    sums = np.zeros(n, np.uint64)
    for k in range(words):
        sums += hashes[k : k + n] * _ODD[k]
    sums = mixed(sums)
    out, at = [], 0
    for count in counts.tolist():
        if count >= words:
            out.append(np.unique(sums[at : at + count - words + 1]))
        elif count:
            short = (hashes[at : at + count] * _ODD[:count]).sum(dtype=np.uint64, keepdims=True)
            out.append(mixed(short + np.full(1, count, np.uint64) * _BASE))
        else:
            out.append(np.zeros(0, np.uint64))
        at += count
    return out
