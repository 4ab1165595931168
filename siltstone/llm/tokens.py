"""Token ids and token counts by the tokenizers library, remembered per chunk of text.

Both vocabularies cut a text at white space before anything else, so the tokens of a text are those of its chunks, one
after the other.  A portion of texts is cut and its chunks are told apart by two 64-bit hashes in arrays; each worker keeps
what the library returned for the chunks it has met (a bounded number, of bounded length) and asks the library only for
the others.  Texts for which cutting isn't safe go to the library whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

import numpy as np

from siltstone.llm.shingles import powers

#: Chunks that a worker remembers, and the bytes of the longest of them.
MEMORY, LONGEST = 600_000, 200
#: Bytes of text that are cut at once.
PORTION = 1 << 20
#: Marks of which any number behind a word is one piece.  A chunk of letters and then such marks has known pieces, so the
#: library's model is asked for each piece, without its normaliser and piece pattern; other chunks go through all of it.
MARKS = ".,;:!?|*#%&$"
#: Words for whose counts the normaliser matters no further than lower case.
_LATIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+")
_BASES = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
_LETTER = [np.array([int.from_bytes(hashlib.blake2b(bytes([b, k]), digest_size=8).digest(), "little") for b in range(256)], np.uint64) for k in range(2)]
#: Added to the hashes of chunks that begin a text.
_FIRST = np.uint64(0x9E3779B97F4A7C15)


class Remembered(dict):
    """word -> value, made by `compute` when it is first asked for; holds at most 2 * size values."""

    def __init__(self, compute: Callable, size: int = MEMORY):
        super().__init__()
        self.compute, self.size, self.old = compute, size, {}

    def __missing__(self, chunk):
        v = self.old.get(chunk)
        if v is None:
            v = self.compute(chunk)
        self[chunk] = v
        return v

    def trim(self) -> None:
        if len(self) > self.size:
            self.old = dict(self)
            self.clear()


class Cutter:
    """Chunks between separators, with two hashes of each."""

    def __init__(self, separators: bytes):
        self.apart = np.zeros(256, bool)
        self.apart[list(separators)] = True
        self._grow(1 << 16)

    def _grow(self, n: int) -> None:
        self.power = [powers(b, n) for b in _BASES]
        self.inverse = [powers(pow(b, -1, 1 << 64), n) for b in _BASES]

    def of(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Begin, end and hashes of the chunks of a byte array."""
        if len(data) > len(self.power[0]):
            self._grow(len(data))
        apart = np.concatenate([[True], self.apart[data], [True]])
        edge = np.flatnonzero(apart[1:] != apart[:-1])
        begin, end = edge[::2], edge[1::2]
        hashes = []
        for letter, power, inverse in zip(_LETTER, self.power, self.inverse, strict=True):
            value = letter[data]
            value *= power[: len(data)]
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value, dtype=np.uint64)])
            hashes.append((total[end] - total[begin]) * inverse[begin])
        return begin, end, hashes


class Collision(Exception):
    """Two chunks with one first hash but different second ones."""


class Memory:
    """What `compute` gives for lists of chunks (lists of unsigned 32-bit numbers, or None), by their hashes.

    Two sorted tables: a large one, and a recent one that is merged into it from time to time.  Beyond `most` chunks those go
    that weren't met again since the last time.
    """

    def __init__(self, compute: Callable, most: int = MEMORY):
        self.compute, self.most = compute, most
        self._clear()

    def _clear(self) -> None:
        none = np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, bool)
        self.old, self.recent = none, none  # key, check, start, count (-1 for None), whether it was met again
        self.flat, self.used = np.empty(1 << 16, np.uint32), 0

    def _merge(self) -> None:
        both = tuple(np.append(x, y) for x, y in zip(self.old, self.recent, strict=True))
        by = np.argsort(both[0], kind="stable")
        self.old = tuple(x[by] for x in both)
        self.recent = tuple(x[:0] for x in self.old)

    def _shrink(self) -> None:
        self._merge()
        again = self.old[4]
        if 2 * again.sum() > self.most:
            return self._clear()
        key, check, start, count, _ = (x[again] for x in self.old)
        n = np.maximum(count, 0).astype(np.int64)
        begin = np.cumsum(n) - n
        flat = self.flat[np.repeat(start - begin, n) + np.arange(n.sum())]
        self.flat, self.used = np.append(flat, np.empty(1 << 16, np.uint32)), len(flat)
        self.old = key, check, begin, count, np.zeros(len(key), bool)

    def _put(self, values: list) -> tuple[np.ndarray, np.ndarray]:
        count = np.array([-1 if v is None else len(v) for v in values], np.int32)
        n = np.maximum(count, 0).astype(np.int64)
        start, total = self.used + np.cumsum(n) - n, int(n.sum())
        if self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty(max(total, len(self.flat)), np.uint32)])
        self.flat[self.used : self.used + total] = [x for v in values if v is not None for x in v]
        self.used += total
        return start, count

    def look(self, key: np.ndarray, check: np.ndarray, chunk: Callable, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Values of different chunks: a flat array, and where in it each one's begins and how long it is (-1 for None)."""
        if len(self.old[0]) + len(self.recent[0]) + len(key) > self.most:
            self._shrink()
        order = np.argsort(key)
        key, check = key[order], check[order]
        start, count, known = np.zeros(len(key), np.int64), np.zeros(len(key), np.int32), np.zeros(len(key), bool)
        for k, c, s, n, again in (self.old, self.recent):
            if len(k):
                at = np.minimum(np.searchsorted(k, key), len(k) - 1)
                here = np.flatnonzero(k[at] == key)
                at = at[here]
                if (c[at] != check[here]).any():
                    self._clear()
                    raise Collision
                start[here], count[here], known[here], again[at] = s[at], n[at], True, True
        new, long, mark = np.flatnonzero(~known), [], 0
        if len(new):
            new = new[np.argsort(size[order[new]] > LONGEST, kind="stable")]
            keep = new[size[order[new]] <= LONGEST]
            start[keep], count[keep] = self._put(self.compute(*chunk(order[keep])))
            mark, long = self.used, new[len(keep) :]
            if len(long):
                start[long], count[long] = self._put(self.compute(*chunk(order[long])))
            fresh = tuple(np.append(x, y) for x, y in zip(self.recent, (key[keep], check[keep], start[keep], count[keep], np.zeros(len(keep), bool)), strict=True))
            by = np.argsort(fresh[0], kind="stable")
            self.recent = tuple(x[by] for x in fresh)
            if len(by) > max(50_000, len(self.old[0]) // 4):
                self._merge()
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        flat = self.flat
        if len(long):  # their values came last and aren't kept
            flat, self.flat, self.used = flat, flat[:mark].copy(), mark
        return flat, start[back], count[back]


def portions(texts: list[bytes], most: int = PORTION):
    """Neighbouring texts of about `most` bytes together; a longer text is a portion by itself."""
    held, size = [], 0
    for t in texts:
        if held and size + len(t) > most:
            yield held
            held, size = [], 0
        held.append(t)
        size += len(t) + 1
    if held:
        yield held


def told_apart(key: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of each chunk's kind, and a chunk of each kind."""
    import pandas as pd

    of, kinds = pd.factorize(key)
    first = np.empty(len(kinds), np.int64)
    first[of[::-1]] = np.arange(len(key) - 1, -1, -1)
    if (check[first][of] != check).any():
        raise Collision
    return of, first


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 stands for itself, the other bytes for the letters from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


_LETTERS = _byte_letters()
_made: dict = {}


def _library(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _lettered(piece: str) -> str:
    """A piece in the byte-level alphabet."""
    return piece.encode().decode("latin-1").translate(_LETTERS)


class Marks(dict):
    """Ids of runs of marks; there are few."""

    def __init__(self, tokenize: Callable):
        self.tokenize = tokenize

    def __missing__(self, run: str) -> list[int]:
        out = [x.id for x in self.tokenize(_lettered(run))]
        if len(self) < 10_000:
            self[run] = out
        return out


def counter(path: str) -> Callable[[list[bytes]], list[int]]:
    """Counts of tokens of UTF-8 texts under a vocabulary that drops white space (word_bpe).

    Such a vocabulary never joins what ASCII white space separates, so the count is the sum over the words.
    """
    if ("count", path) not in _made:
        t = _library(path)
        latin, tokenize = _LATIN.fullmatch, t.model.tokenize
        marks = Marks(tokenize)

        def count(words: list[bytes]) -> list[tuple[int]]:
            out = []
            for word in words:
                s = word.decode()
                core = s.rstrip(MARKS)
                if latin(core):
                    low = core.lower()
                    n = len(tokenize(low if low.isascii() else _lettered(low)))
                    out.append((n + len(marks[s[len(core) :]]),) if len(core) < len(s) else (n,))
                else:
                    out.append((len(t.encode(s, add_special_tokens=False).ids),))
            return out

        _made["count", path] = Memory(count), Cutter(b" \t\n\x0b\x0c\r"), count
    memory, cutter, count = _made["count", path]

    def counts(texts: list[bytes]) -> list[int]:
        out: list[int] = []
        for some in portions(texts):
            joined = b" ".join(some)
            begin, end, (key, check) = cutter.of(np.frombuffer(joined, np.uint8))
            try:
                of, first = told_apart(key, check)
                flat, start, _ = memory.look(key[first], check[first], lambda i: ([joined[a:z] for a, z in zip(begin[first[i]].tolist(), end[first[i]].tolist(), strict=True)],), (end - begin)[first])  # noqa: B023
            except Collision:
                out += [sum(n for (n,) in count(x.split())) for x in some]
                continue
            total = np.concatenate([[0], np.cumsum(flat[start].astype(np.int64)[of])])
            cut = np.searchsorted(begin, np.concatenate([[0], np.cumsum([len(x) + 1 for x in some])]))
            out += (total[cut[1:]] - total[cut[:-1]]).tolist()
        return out

    return counts


def encoder(path: str) -> Callable[[list[bytes]], list[bytes]]:
    """Ids of UTF-8 texts under a byte-level vocabulary, as little-endian unsigned 32-bit numbers.

    A blank between two visible characters always begins a new piece, and belongs to what follows it.  Texts with other
    white space beside a blank, or at an end, are encoded whole.
    """
    if ("ids", path) not in _made:
        t = _library(path)
        tokenize, blank = t.model.tokenize, _LETTERS[32]
        marks = Marks(tokenize)
        newline = marks["\n"]

        def whole(s: str) -> list[int]:
            return t.encode(s, add_special_tokens=False).ids

        def lines(s: str, first: bool) -> list[int]:
            """Of a chunk with line breaks: a single one between two words is a piece."""
            out: list[int] = []
            before = "" if first else blank
            for line in s.split("\n"):
                core = line.rstrip(MARKS)
                if not core.isalpha():
                    return whole(s if first else " " + s)
                if out:
                    out += newline
                out += [x.id for x in tokenize(before + (core if core.isascii() else _lettered(core)))]
                if len(core) < len(line):
                    out += marks[line[len(core) :]]
                before = ""
            return out

        def compute(chunks: list[bytes], firsts: list[bool]) -> list[list[int] | None]:
            """Of chunks behind a blank, or at a text's beginning; None if white space stands at an end of one: there the
            piece pattern looks beyond the chunk."""
            out: list[list[int] | None] = []
            for chunk, first in zip(chunks, firsts, strict=True):
                s = chunk.decode()
                core = s.rstrip(MARKS)
                if core.isalpha():  # the common case
                    letters = core if core.isascii() else _lettered(core)
                    ids = [x.id for x in tokenize(letters if first else blank + letters)]
                    out.append(ids + marks[s[len(core) :]] if len(core) < len(s) else ids)
                elif s[0].isspace() or s[-1].isspace():
                    out.append(None)
                else:
                    out.append(lines(s, first))
            return out

        _made["ids", path] = Memory(compute), Cutter(b" "), whole
    memory, cutter, whole = _made["ids", path]

    def packed(ids: list[int]) -> bytes:
        return np.array(ids, "<u4").tobytes()

    def ids_of(texts: list[bytes]) -> list[bytes]:
        out: list[bytes] = []
        for some in portions(texts):
            joined = b" ".join(some)
            begin, end, (key, check) = cutter.of(np.frombuffer(joined, np.uint8))
            at = np.concatenate([[0], np.cumsum([len(x) + 1 for x in some])])
            cut = np.searchsorted(begin, at)
            # a text of n chunks with n - 1 blanks between them has none at its ends and no two together
            n = np.diff(cut)
            regular = np.diff(at) - 1 - np.add.reduceat(np.append(end - begin, 0), cut[:-1]) * (n > 0) == np.maximum(n - 1, 0)
            leading = np.zeros(len(begin), bool)
            leading[cut[:-1][n > 0]] = True
            key = np.where(leading, key + _FIRST, key)
            try:
                of, first = told_apart(key, check)
                flat, start, count = memory.look(key[first], check[first], lambda i: ([joined[a:z] for a, z in zip(begin[first[i]].tolist(), end[first[i]].tolist(), strict=True)], leading[first[i]].tolist()), (end - begin)[first])  # noqa: B023
            except Collision:
                out += [packed(whole(x.decode())) for x in some]
                continue
            start, count = start[of], count[of]
            bad = np.concatenate([[0], np.cumsum(count < 0)])
            regular &= bad[cut[1:]] == bad[cut[:-1]]
            count = np.maximum(count, 0)
            place = np.concatenate([[0], np.cumsum(count)])
            ids = flat[np.repeat(start - place[:-1], count) + np.arange(place[-1])].astype("<u4").tobytes()
            for x, a, z, ok in zip(some, place[cut[:-1]].tolist(), place[cut[1:]].tolist(), regular.tolist(), strict=True):
                out.append(ids[4 * a : 4 * z] if ok else packed(whole(x.decode())))
        return out

    return ids_of
