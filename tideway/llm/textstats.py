"""Counts over whole texts, shared by the quality operators."""

from __future__ import annotations

import numpy as np
import xxhash

GAP, LOWER, UPPER, DIGIT, SYMBOL, STOP, OTHER, LEAD, REST = range(9)
KINDS = 9


def _kinds() -> np.ndarray:
    kind = np.full(256, OTHER, np.uint8)
    for c in range(256):
        if c in b"\x20\x09\x0a\x0b\x0c\x0d":
            kind[c] = GAP
        elif c >= 128:
            kind[c] = REST if c & 0xC0 == 0x80 else LEAD
        elif chr(c).islower():
            kind[c] = LOWER
        elif chr(c).isupper():
            kind[c] = UPPER
        elif chr(c).isdigit():
            kind[c] = DIGIT
    kind[list(b"#*$%&|<>")] = SYMBOL
    kind[list(b".,;:!?")] = STOP
    return kind


#: Kind of each byte: white space, ASCII letters by case, digits, the eight symbols, sentence marks, the rest of ASCII,
#: first and further bytes of longer code points.
KIND = _kinds()


def kinds(data: bytes) -> np.ndarray:
    return KIND[np.frombuffer(data, np.uint8)]


class WordHasher:
    """64-bit hashes of words; those of up to ``cache`` words are kept."""

    def __init__(self, cache: int = 50_000):
        self.most, self.known = cache, {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        if len(known) > self.most:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh64_intdigest(w)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n words."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    acc = np.full(len(h) - n + 1, 0x9E3779B97F4A7C15, np.uint64)
    for i in range(n):
        acc = acc * np.uint64(0x100000001B3) + h[i : len(h) - n + 1 + i]
        acc = (acc ^ (acc >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return acc


def repeat_words(h: np.ndarray, counts: np.ndarray | None = None, n: int = 3) -> int | np.ndarray:
    """Words that stand in a window of n words found twice or more in their text, the first included; each counts once.

    With ``counts`` the hashes are those of several texts of so many words, and there is a number for each text.
    """
    sizes = np.array([len(h)]) if counts is None else np.asarray(counts, np.int64)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    w = windows(h, n)
    inside = np.zeros(len(h), bool)
    if len(w):
        start = np.flatnonzero(owner[: len(w)] == owner[n - 1 :])  # windows of one text
        keys = w[start] ^ (owner[start].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(keys, kind="stable")
        same = keys[order][1:] == keys[order][:-1]
        twice = np.unique(np.concatenate([order[1:][same], order[:-1][same]]))
        for i in range(n):
            inside[start[twice] + i] = True
    found = np.bincount(owner[inside], minlength=len(sizes))
    return int(found[0]) if counts is None else found


def pieces(items: list, size, most: int = 1 << 20):
    """Runs of a list, each of at most ``most`` in size or of one item."""
    out, held = [], 0
    for x in items:
        n = size(x)
        if out and held + n > most:
            yield out
            out, held = [], 0
        out.append(x)
        held += n
    if out:
        yield out
