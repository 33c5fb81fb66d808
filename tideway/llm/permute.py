"""Keyed pseudorandom permutations of 0 .. n - 1 by a Feistel network with cycle walking.

The network works on pairs (left, right) with left below ``a`` and right below ``b``, where a * b is the least such
product of near equal factors that is at least n.  Values from n on are walked on through the network until they fall
below n, which keeps the map a bijection; at most a * b - n steps can be needed.
"""

from __future__ import annotations

import math

import numpy as np

ROUNDS = 6
_P = 2147483647  # the round function is arithmetic modulo this prime, so that SQL can state it
_A = (1103515245, 1664525001, 69069017, 1812433253, 214013099, 16807001)


def factors(n: int) -> tuple[int, int]:
    a = max(2, math.isqrt(max(0, n - 1)) + 1)
    return a, max(2, -(-n // a))


def _round(x: np.ndarray, i: int, key: np.ndarray) -> np.ndarray:
    y = (x * _A[i] + key + i) % _P
    return (y * ((y >> 7) % 65521 + 1)) % _P


def _network(x: np.ndarray, a, b, key: np.ndarray) -> np.ndarray:
    left, right = x // b, x % b
    for i in range(0, ROUNDS, 2):
        left = (left + _round(right, i, key)) % a
        right = (right + _round(left, i + 1, key)) % b
    return left * b + right


def permute(x: np.ndarray, n, key) -> np.ndarray:
    """Images of ``x``; ``n`` (length of the permuted range) and ``key`` (below 2^31 - 1) are numbers or arrays like x."""
    x = np.asarray(x, np.int64)
    n, key = np.broadcast_to(np.asarray(n, np.int64), x.shape), np.broadcast_to(np.asarray(key, np.int64), x.shape)
    pairs = {int(m): factors(int(m)) for m in np.unique(n)}
    sizes, which = np.unique(n, return_inverse=True)
    a = np.array([pairs[int(m)][0] for m in sizes], np.int64)[which]
    b = np.array([pairs[int(m)][1] for m in sizes], np.int64)[which]
    out = _network(x, a, b, key)
    while (far := out >= n).any():
        out[far] = _network(out[far], a[far], b[far], key[far])
    return out
