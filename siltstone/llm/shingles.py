"""Hashes of words and of word shingles, for whole blocks of texts at once."""

from __future__ import annotations

import hashlib

import numpy as np

WORDS = 5
#: Bytes that are hashed at once; only a longer word makes a longer window.
WINDOW = 1 << 20

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_BASE = 0xD6E8FEB86659FD93
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LETTER = np.array([int.from_bytes(hashlib.blake2b(bytes([b + 32 if 65 <= b <= 90 else b]), digest_size=8).digest(), "little") for b in range(256)], np.uint64)


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * _A
    x ^= x >> np.uint64(31)
    x += b
    x *= _B
    x ^= x >> np.uint64(29)
    return x


def powers(base: int, n: int) -> np.ndarray:
    """base to the powers 0 to n - 1, mod 2^64."""
    out, k = np.ones(n, np.uint64), 1
    while k < n:
        m = min(k, n - k)
        out[k : k + m] = out[:m] * np.uint64(pow(base, k, 1 << 64))
        k += m
    return out


class Words:
    """Polynomial hashes (mod 2^64, over random letters) of the words of a byte string; A-Z count as a-z."""

    def __init__(self):
        self._grow(WINDOW + 1)

    def _grow(self, n: int) -> None:
        self.power, self.inverse = powers(_BASE, n), powers(pow(_BASE, -1, 1 << 64), n)

    def of(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Hash and place of each word."""
        data = np.frombuffer(text, np.uint8)
        hashes, places, at = [], [], 0
        while at < len(data):
            end = min(at + WINDOW, len(data))
            while end < len(data):  # a window ends behind white space
                back = np.flatnonzero(_SPACE[data[at:end]])
                if len(back):
                    end = at + int(back[-1]) + 1
                    break
                end = min(end + WINDOW, len(data))
            h, p = self._window(data[at:end])
            hashes.append(h)
            places.append(p + at)
            at = end
        if not hashes:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        return np.concatenate(hashes), np.concatenate(places)

    def _window(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(data) > len(self.power):
            self._grow(len(data))
        space = np.concatenate([[True], _SPACE[data], [True]])
        edge = np.flatnonzero(space[1:] != space[:-1])
        begin, end = edge[::2], edge[1::2] - 1
        if not len(begin):
            return np.empty(0, np.uint64), begin
        value = _LETTER[data]
        value *= self.power[: len(data)]
        total = np.cumsum(value, dtype=np.uint64)
        return (total[end] - total[begin] + value[begin]) * self.inverse[begin], begin


def shingles(words: Words, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of each text, sorted within it, and how many each text has.

    A text of fewer than WORDS words has its whole sequence as its one shingle; without words it has none.
    """
    ends = np.cumsum([len(t) + 1 for t in texts])
    h, place = words.of(b" ".join(texts))
    first = np.searchsorted(place, np.concatenate([[0], ends]))  # of each text's words
    count = np.diff(first)
    n = np.maximum(count - WORDS + 1, np.minimum(count, 1))
    of = np.repeat(np.arange(len(texts)), n)
    begin = np.cumsum(n) - n
    at = np.repeat(first[:-1] - begin, n) + np.arange(len(of))
    size = np.minimum(count, WORDS)[of].astype(np.uint64)
    out = size.copy()
    for i in range(WORDS):
        if i and (size <= i).any():
            more = size > i
            out[more] = mix(out[more], h[at[more] + i])
        else:
            out = mix(out, h[at + i])
    for a, z in zip(begin, begin + n, strict=True):
        out[a:z].sort()
    new = np.ones(len(out), bool)
    new[1:] = (out[1:] != out[:-1]) | (of[1:] != of[:-1])
    return out[new], np.bincount(of[new], minlength=len(texts))
