"""A run-length index of repetitive strings: run-compressed BWT with samples at both ends of its runs."""

from __future__ import annotations

import numpy as np

from .rolling import PrefixHash, PrimePrefixHash


def suffix_array(s: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Suffixes of texts in order; s are their letters, each text followed by one at its place in ends.

    A text's end is below all letters and ends are in the order of the texts.  Suffixes are told apart by their
    first k letters; groups that are not yet are sorted again by the ranks k letters on, so k grows by that each
    time, threefold where three ranks fit one key.
    """
    n = len(s)
    owner = np.zeros(n, np.int64)
    owner[ends[:-1] + 1] = 1
    owner = np.cumsum(owner)
    room = ends[owner] - np.arange(n)  # letters up to the end
    seen = np.zeros(256, bool)
    seen[s] = True
    key = np.cumsum(seen)[s]
    key[ends] = 0
    letters, k = int(key.max()) + 2, 1
    while 2 * k * np.log2(letters) <= 62 and k < n:
        key[: n - k] = key[: n - k] * letters**k + np.where(room[: n - k] >= k, key[k:], 0)
        key[n - k :] *= letters**k
        k *= 2
    sa = np.argsort(key)
    new = np.ones(n, bool)
    new[1:] = key[sa[1:]] != key[sa[:-1]]
    rank = np.empty(n, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    triple = (n + 1) ** 3 < 1 << 63
    while True:
        at = np.flatnonzero(~(new & np.append(new[1:], True)))
        if not at.size:
            return sa
        sub = sa[at]
        left = room[sub]
        # a group whose texts end within k letters ends there all alike: the texts' order decides
        key = rank[sub] * (n + 1) + np.where(left < k, owner[sub], rank[np.minimum(sub + k, n - 1)] + 1)
        if triple:
            key = key * (n + 1) + np.where(left < 2 * k, 0, rank[np.minimum(sub + 2 * k, n - 1)] + 1)
        order = np.argsort(key)
        sub, key = sub[order], key[order]
        sa[at] = sub
        head = np.ones(len(at), bool)
        head[1:] = key[1:] != key[:-1]
        new[at] = head
        rank[sub] = np.maximum.accumulate(np.where(head, at, 0))
        k *= 3 if triple else 2


#: Of one text, modulo 2**64 and modulo a prime.
Hashes = tuple[PrefixHash, PrimePrefixHash]


def _same(h: Hashes, a: np.ndarray, b: np.ndarray, size: np.ndarray | int) -> np.ndarray:
    """Whether the strings of a size from a and from b agree in both hashes."""
    out = h[0].of(a, a + size) == h[0].of(b, b + size)
    at = np.flatnonzero(out)
    n = size if isinstance(size, int) else size[at]
    out[at] = h[1].of(a[at], a[at] + n) == h[1].of(b[at], b[at] + n)
    return out


class RunLengthIndex:
    """Texts, each ended by a letter of its own, as runs of their BWT.

    heads and tails are the text positions sampled at the first and last suffix of each run.
    Matches shorter than ``least`` count as none, which saves measuring them.
    """

    def __init__(self, texts: list[bytes], least: int = 1) -> None:
        m = len(texts)
        sizes = np.fromiter(map(len, texts), np.int64, m)
        self.ends = np.cumsum(sizes + 1) - 1
        self.starts = self.ends - sizes
        raw = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
        sa = suffix_array(raw, self.ends)
        s = raw.astype(np.int64) + m
        s[self.ends] = np.arange(m)
        bwt = s[sa - 1]
        turn = np.flatnonzero(bwt[1:] != bwt[:-1]) + 1
        self.first = np.concatenate([[0], turn])  # rank of each run's first suffix
        self.letters = bwt[self.first]
        last = np.append(turn, len(s)) - 1
        self.heads, self.tails = sa[self.first], sa[last]
        # the neighbours that begin before a run and after it
        before, after = sa[self.first[1:] - 1], sa[last[:-1] + 1]
        letters = np.random.RandomState(7).randint(0, 1 << 63, m + 256, np.uint64)
        h = PrefixHash(s, letters), PrimePrefixHash(s, letters)
        self.size, self.least = len(s), max(1, least)
        self.head_match = np.concatenate([[0], self._common(h, before, self.heads[1:])])
        self.tail_match = np.append(self._common(h, self.tails[:-1], after), 0)

    def _common(self, h: Hashes, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Lengths of the longest common prefixes of suffixes, by halving on their hashes."""
        out, most = np.zeros(len(a), np.int64), self.size - np.maximum(a, b)
        long = np.flatnonzero(most >= self.least)
        long = long[_same(h, a[long], b[long], self.least)]
        out[long] = self._measured(h, a[long], b[long], most[long])
        return out

    def _measured(self, h: Hashes, a: np.ndarray, b: np.ndarray, high: np.ndarray) -> np.ndarray:
        low = np.full(len(a), self.least)
        while (open_ := low < high).any():
            mid = (low + high + 1) // 2
            same = _same(h, a, b, mid)
            low, high = np.where(open_ & same, mid, low), np.where(open_ & ~same, mid - 1, high)
        return low

    def matching_statistics(self) -> np.ndarray:
        """For each position, the longest match with any other position of the texts.

        Inside a run the suffix before (or after) a suffix is followed by the same letter as it, so its match
        is one shorter than that of the position to its left: one pass over the samples gives all.
        """
        match = np.zeros(self.size, np.int64)
        np.maximum.at(match, self.heads, self.head_match)
        np.maximum.at(match, self.tails, self.tail_match)
        at = np.arange(self.size)
        return np.maximum(np.maximum.accumulate(match + at) - at, 0)


def repeated(texts: list[bytes], length: int) -> list[list[tuple[int, int]]]:
    """For each text, the ranges covered by strings of the length that begin anywhere else too."""
    index = RunLengthIndex(texts, length)
    long = np.flatnonzero(index.matching_statistics() >= length)
    if not long.size:
        return [[] for _ in texts]
    owner = np.searchsorted(index.ends, long)
    cut = np.flatnonzero((np.diff(long) > length) | (np.diff(owner) > 0)) + 1
    out: list[list[tuple[int, int]]] = [[] for _ in texts]
    for a, b in zip(np.concatenate([[0], cut]), np.append(cut, len(long)) - 1, strict=True):
        k = int(owner[a])
        base = int(index.starts[k])
        out[k].append((int(long[a]) - base, int(long[b]) - base + length))
    return out
