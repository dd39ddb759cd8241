"""Sets of hashed word n-grams of whole texts, many texts at a time."""

from __future__ import annotations

import numpy as np

_R = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_R, -1, 1 << 64)
_FOLD = bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))
_WORD = np.array([i != 0x20 and not 9 <= i <= 13 for i in range(256)])
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(which: str, n: int) -> np.ndarray:
    """The first n powers of the hash's base, or of its inverse."""
    have = _powers[which]
    while len(have) < n:
        step = np.uint64(pow(_R if which == "up" else _INVERSE, len(have), 1 << 64))
        have = np.concatenate([have, have * step])
    _powers[which] = have
    return have[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word of all texts, A-Z as a-z, and the number of words of each text."""
    data = np.frombuffer(b" ".join(texts).translate(_FOLD), np.uint8)
    edges = np.flatnonzero(np.diff(_WORD[data], prepend=False, append=False))
    starts, ends = edges[::2], edges[1::2]
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power("up", len(data)), dtype=np.uint64)])
    hashes = mixed((sums[ends] - sums[starts]) * _power("down", len(data) + 1)[starts] + (ends - starts).astype(np.uint64))
    offsets = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return hashes, np.diff(np.searchsorted(starts, offsets))


def shingle_sets(texts: list[bytes], n: int) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's n-grams of words; of fewer words, the whole sequence as one."""
    words, counts = word_hashes(texts)
    grams = np.zeros(max(len(words) - n + 1, 0), np.uint64)
    for k in range(n):
        grams = mixed(grams + words[k : k + len(grams)])
    out, at = [], 0
    for c in counts.tolist():
        if c >= n:
            own = np.sort(grams[at : at + c - n + 1])
            out.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
        elif c:
            one = np.full(1, c, np.uint64)
            for k in range(c):
                one = mixed(one + words[at + k])
            out.append(one)
        else:
            out.append(np.zeros(0, np.uint64))
        at += c
    return out
