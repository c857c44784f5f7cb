"""The hash family of signatures: constants that the JVM's generator gives."""

from __future__ import annotations

import numpy as np

PRIME = 2147483647
INT_MAX = 2147483647


def _int32(x: int) -> int:
    return (x + 0x80000000) % 0x100000000 - 0x80000000


def java_ints(seed: int, n: int) -> list[int]:
    """The first n values of java.util.Random(seed).nextInt()."""
    state, out = (seed ^ 0x5DEECE66D) & ((1 << 48) - 1), []
    for _ in range(n):
        state = (state * 0x5DEECE66D + 0xB) & ((1 << 48) - 1)
        out.append(_int32(state >> 16))
    return out


def string_hash(text: str) -> int:
    """String.hashCode of the JVM."""
    h = 0
    raw = text.encode("utf-16-be")
    for i in range(0, len(raw), 2):
        h = (31 * h + (raw[i] << 8 | raw[i + 1])) & 0xFFFFFFFF
    return _int32(h)


def hash_family(n: int, seed: int = 100) -> list[tuple[int, int]]:
    """Pairs (a, b) of h(x) = (a x + b) rem PRIME; the sign follows the dividend."""
    draws = java_ints(seed, 2 * n)
    return list(zip(draws[::2], draws[1::2]))


def signature_tables(d: int, n: int, seed: int = 100) -> np.ndarray:
    """(d, 2, n): the n hash values of the shingles "i-0" and "i-1" of each dimension i."""
    a, b = (np.array(x, dtype=np.int64) for x in zip(*hash_family(n, seed)))
    x = np.array([[string_hash(f"{i}-{bit}") for bit in (0, 1)] for i in range(d)], dtype=np.int64)
    return np.fmod(x[:, :, None] * a + b, PRIME)
