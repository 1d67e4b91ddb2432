"""Prefix hashes of byte strings: the 64-bit hash of any substring from two lookups."""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_LETTERS = np.random.RandomState(20240229).randint(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
#: Letters of a second hash, independent of the first.
OTHER_LETTERS = np.random.RandomState(20240301).randint(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_powers = {_BASE: np.ones(1, np.uint64), _INVERSE: np.ones(1, np.uint64)}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 to base**(n-1), modulo 2**64; kept for the next call."""
    have = _powers[base]
    if len(have) < n:
        steps = np.full(1 << max(12, (n - 1).bit_length()), np.uint64(base))
        steps[0] = 1
        have = _powers[base] = np.cumprod(steps, dtype=np.uint64)
    return have[:n]


#: A prime, and a base of its powers.
PRIME, _PRIME_BASE = (1 << 31) - 1, 1_220_703_125
_prime_powers = {_PRIME_BASE: np.ones(1, np.uint64), pow(_PRIME_BASE, -1, PRIME): np.ones(1, np.uint64)}


def prime_powers(base: int, n: int) -> np.ndarray:
    """base**0 to base**(n-1), modulo PRIME; kept for the next call."""
    have = _prime_powers[base]
    while len(have) < n:
        have = _prime_powers[base] = np.concatenate([have, have * np.uint64(pow(base, len(have), PRIME)) % np.uint64(PRIME)])
    return have[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of each hash."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class PrefixHash:
    def __init__(self, raw: bytes | np.ndarray, letters: np.ndarray = _LETTERS) -> None:
        codes = np.frombuffer(raw, np.uint8) if isinstance(raw, bytes) else raw
        self.sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(letters[codes] * powers(_BASE, len(codes)), out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the substrings from start to end (arrays of equal length)."""
        return mixed((self.sums[end] - self.sums[start]) * powers(_INVERSE, len(self.sums))[start])

    def windows(self, length: int) -> np.ndarray:
        """Hashes of all substrings of a length."""
        n = len(self.sums) - length
        return mixed((self.sums[length:] - self.sums[:n]) * powers(_INVERSE, n)) if n > 0 else np.zeros(0, np.uint64)


class PrimePrefixHash:
    """The same modulo a prime.  Modulo 2**64 two texts that differ at even steps in the pattern of Thue and Morse agree, whatever the base and letters."""

    def __init__(self, codes: np.ndarray, letters: np.ndarray) -> None:
        self.sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum((letters % np.uint64(PRIME))[codes] * prime_powers(_PRIME_BASE, len(codes)) % np.uint64(PRIME), out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        back = prime_powers(pow(_PRIME_BASE, -1, PRIME), len(self.sums))
        return (self.sums[end] - self.sums[start]) % np.uint64(PRIME) * back[start] % np.uint64(PRIME)
