"""Operator 7: token counts by prefix dynamic programming.

A byte-level BPE splits a text into pieces and merges inside each piece.  For one piece the dynamic
program walks its prefixes: the last token of a prefix is the longest vocabulary token that ends
there and follows the last token of the rest without a merge across the border.  The count of
a prefix is then the count of the rest plus one, so all prefixes of the piece are known at once.
A text's counts are sums over its pieces.  ``stored`` keeps the exact count of every prefix as a column, from which
``counts_at`` and ``truncate`` answer without any encoding.

The vocabulary file is read by each Python worker from a path that is a parameter.
Defined cases: a null or empty text has 0 tokens; the special string counts as one token; a text of any length is
counted whole, and what a worker remembers is bounded in bytes; of prefixes with equal counts a budget takes the
longest; repeated rows and rows with a null id are each counted; an empty table gives no rows; further columns, whatever
their names, are ignored.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_right
from collections.abc import Sequence
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, table, text_or_empty

LIMIT = 512
#: The byte-level split: contractions, letters, numbers, others with a blank before them, white space.
PIECE = r"'(?:[stmd]|re|ve|ll)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces that a worker remembers in each of two generations, at most, and the longest of them in characters:
#: about 150 bytes each as a rule, and never more than REMEMBER * LONGEST * 2 bytes.
REMEMBER, LONGEST = 300_000, 128
#: Pairs of tokens that a worker remembers as apart or not, at most.
BORDERS = 500_000
#: Prefix lengths at which the program's state is kept for other pieces that begin alike.
STEMS = (9, 6)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[str, int]:
    """The vocabulary file's letter for each byte: printable ones stand for themselves, others follow 255."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class PrefixCounter:
    """Token counts of every prefix, for one vocabulary file."""

    def __init__(self, path: str) -> None:
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _byte_letters()
        raw = lambda token: bytes(letters[c] for c in token)
        special = [t["content"] for t in spec["added_tokens"]]
        self.specials = frozenset(special)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        # a token's number is its age: single bytes first, then merges in their order
        self.tokens = {bytes([b]): b for b in range(256)}
        self.left, self.right, self.joined = list(range(256)), list(range(256)), {}
        for a, b in pairs:
            x, y = self.tokens[raw(a)], self.tokens[raw(b)]
            self.joined[x << 20 | y] = self.tokens.setdefault(raw(a) + raw(b), len(self.left))
            self.left.append(x)
            self.right.append(y)
        # lengths of the tokens that end with three bytes or a part of them, longest first
        sizes: dict[bytes, set[int]] = {}
        for t in self.tokens:
            if len(t) > 2:
                sizes.setdefault(t[-3:], {1, 2}).add(len(t))
        self.reach = {end: tuple(sorted(n, reverse=True)) for end, n in sizes.items()}
        # whether two tokens stay apart, as far as asked
        self.borders: dict[int, bool] = {}
        self.split_specials = regex.compile("(" + "|".join(map(regex.escape, special)) + ")").split if special else lambda t: [t]
        self.blank = frozenset(regex.findall(r"\s", "".join(map(chr, range(0x3001)))))
        self.blanks = regex.compile(r"\s+").finditer
        self.any_piece = regex.compile(PIECE).findall
        # the same split for texts of Latin-1 characters, with the classes written out: twice as fast
        latin = "".join(map(chr, range(256)))
        kinds = {k: "".join(f"\\x{ord(c):02x}" for c in regex.findall(k, latin)) for k in (r"\p{L}", r"\p{N}", r"\s")}
        near = PIECE.replace(r"[^\s\p{L}\p{N}]", "[^" + "".join(kinds.values()) + "]").replace(r"\S", f"[^{kinds[r'\s']}]")
        for k, v in kinds.items():
            near = near.replace(k, f"[{v}]")
        self.latin_piece = re.compile(near).findall
        # pieces seen of late, those before them, and how far the program had come at fixed lengths
        self.known: dict[str, Sequence[int]] = {}
        self.older: dict[str, Sequence[int]] = {}
        self.stems: dict[bytes, tuple[tuple[int, ...], tuple[int, ...]]] = {}

    def pieces_of(self, text: str) -> list[str]:
        try:
            text.isascii() or text.encode("latin-1")
        except UnicodeEncodeError:
            return self.any_piece(text)
        return self.latin_piece(text)

    def apart(self, left: int, right: int) -> bool:
        """Whether two tokens stay two when their join is encoded.

        The parts that touch at the border are undone from the youngest down; the border falls if
        two of them merge into a token older than every part that had to be there before.
        """
        joined, lefts, rights = self.joined.get, self.left, self.right
        limit = 1 << 60
        while True:
            if joined(left << 20 | right, limit) < limit:
                return False
            if left > right:
                if left < 256:
                    return True
                limit, left = left, rights[left]
            else:
                if right < 256:
                    if left < 256:
                        return True
                    limit, left = left, rights[left]
                else:
                    limit, right = right + 1, lefts[right]

    def piece(self, piece: str) -> Sequence[int]:
        """Tokens of each prefix of a piece, by bytes."""
        got = self.known.get(piece)
        if got is not None:
            return got
        got = self.older.get(piece)
        if got is None:
            counts = self.program(piece.encode("utf-8", "surrogatepass"))
            got = bytes(counts) if max(counts) < 256 else tuple(counts)
        if len(piece) <= LONGEST:
            if len(self.known) >= REMEMBER:
                self.known, self.older = {}, self.known
            self.known[piece] = got
        return got

    def program(self, raw: bytes) -> list[int]:
        counts, last, token_of, apart, reach = [0], [-1], self.tokens.get, self.apart, self.reach.get
        for cut in STEMS:
            if len(raw) > cut and (stem := self.stems.get(raw[:cut])):
                counts, last = list(stem[0]), list(stem[1])
                break
        borders = self.borders
        for end in range(len(counts), len(raw) + 1):
            # three bytes that end no token of three or more, and the first two, leave two and one
            for size in reach(raw[end - 3 : end], (2, 1)) if end > 2 else (2, 1):
                start = end - size
                if start < 0:
                    continue
                token = token_of(raw[start:end])
                if token is None:
                    continue
                if start:
                    border = last[start] << 20 | token
                    stay = borders.get(border)
                    if stay is None:
                        if len(borders) >= BORDERS:
                            borders.clear()
                        stay = borders[border] = apart(last[start], token)
                    if not stay:
                        continue
                last.append(token)
                counts.append(counts[start] + 1)
                break
            if end in STEMS and len(raw) > end:
                if len(self.stems) >= REMEMBER // 8:
                    self.stems.clear()
                self.stems[raw[:end]] = (tuple(counts), tuple(last))
        return counts

    def pieces(self, text: str) -> list[tuple[str, Sequence[int]]]:
        """The pieces of a text with their prefix counts; a special string is a piece of one token."""
        out: list[tuple[str, Sequence[int]]] = []
        for part in self.split_specials(text):
            if part in self.specials:
                out.append((part, bytes(len(part)) + b"\x01"))
            else:
                out += [(p, self.piece(p)) for p in self.pieces_of(part)]
        return out

    def count(self, text: str) -> int:
        if not self.specials or not any(s in text for s in self.specials):
            known, piece = self.known.get, self.piece
            return sum([(known(p) or piece(p))[-1] for p in self.pieces_of(text)])
        return sum(c[-1] for _, c in self.pieces(text))

    def prefixes(self, text: str) -> np.ndarray:
        """The count of text[:k] as a text of its own, for every k from 0 on."""
        out = np.zeros(len(text) + 1, np.int64)
        if any(s in text for s in self.specials):
            stored = PrefixTable(self, text)
            return np.array([stored.at(k) for k in range(len(text) + 1)])
        at = before = 0
        for p in self.pieces_of(text):
            inner = self.piece(p)
            if p.isascii():
                out[at + 1 : at + len(p) + 1] = np.frombuffer(inner, np.uint8)[1:] if isinstance(inner, bytes) else inner[1:]
            else:
                out[at + 1 : at + len(p) + 1] = [inner[n] for n in accumulate(len(c.encode("utf-8", "surrogatepass")) for c in p)]
            out[at + 1 : at + len(p) + 1] += before
            at += len(p)
            before += inner[-1]
        # white space at the end of a prefix is one piece, wherever the whole text splits it
        for m in self.blanks(text):
            a, b = m.span()
            run = self.piece(m.group())
            out[a + 1 : b + 1] = out[a] + np.array([run[n] for n in accumulate(len(c.encode()) for c in m.group())])
        return out


class PrefixTable:
    """A text's stored counts: where its pieces start and the tokens before each of them."""

    def __init__(self, counter: PrefixCounter, text: str) -> None:
        found = counter.pieces(text)
        self.counter, self.text = counter, text
        self.names = [p for p, _ in found]
        self.inner = [c for _, c in found]
        self.starts = list(accumulate((len(p) for p in self.names), initial=0))
        self.before = list(accumulate((c[-1] for c in self.inner), initial=0))

    def at(self, chars: int) -> int:
        """Exact count of text[:chars] as a text of its own."""
        chars = max(0, min(chars, len(self.text)))
        if not chars:
            return 0
        i = bisect_right(self.starts, chars - 1) - 1
        # white space at the end of a prefix is one piece, wherever the whole text splits it
        cut = chars
        while cut and self.text[cut - 1] in self.counter.blank and not (i and cut <= self.starts[i] and self.names[i - 1] in self.counter.specials):
            cut -= 1
            while i > 0 and self.starts[i] >= cut:
                i -= 1
        if cut == chars:
            return self._inside(i, chars)
        return (self._inside(i, cut) if cut else 0) + self.counter.piece(self.text[cut:chars])[-1]

    def _inside(self, i: int, chars: int) -> int:
        name, rest = self.names[i], chars - self.starts[i]
        if name in self.counter.specials and rest < len(name):
            return self.before[i] + self.counter.count(name[:rest])
        n = rest if name in self.counter.specials else len(name[:rest].encode("utf-8", "surrogatepass"))
        return self.before[i] + self.inner[i][n]


_COUNTERS: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    """One for each worker process and file."""
    if path not in _COUNTERS:
        _COUNTERS[path] = PrefixCounter(path)
    return _COUNTERS[path]


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row."""
    path = path or default_path()
    kind = dict(docs.dtypes)["doc_id"].replace("bigint", "long")

    def one(batch: pa.RecordBatch) -> dict:
        count, texts = counter(path).count, batch.column("text").to_pylist()
        n = [count(t) for t in texts]
        return {"doc_id": batch.column("doc_id"), "n_bytes": [len(t.encode("utf-8", "surrogatepass")) for t in texts], "n_tokens": n, "over_limit": [x > limit for x in n]}

    return map_arrow(docs.select("doc_id", text_or_empty().alias("text")), one, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")


def stored(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_chars, n_tokens, counts: the count of each prefix as 4 bytes, highest first, from the empty one on."""
    path = path or default_path()
    kind = dict(docs.dtypes)["doc_id"].replace("bigint", "long")

    def one(batch: pa.RecordBatch) -> dict:
        found = [counter(path).prefixes(t) for t in batch.column("text").to_pylist()]
        return {"doc_id": batch.column("doc_id"), "n_chars": [len(c) - 1 for c in found], "n_tokens": [int(c[-1]) for c in found], "counts": [c.astype(">u4").tobytes() for c in found]}

    return map_arrow(docs.select("doc_id", text_or_empty().alias("text")), one, f"doc_id {kind}, n_chars long, n_tokens long, counts binary")


def counts_at(table: DataFrame, chars: Column) -> DataFrame:
    """doc_id, chars, n_tokens: the exact count of a prefix of so many characters (within the text), from ``stored``."""
    at = F.greatest(F.lit(0), F.least(chars.cast("long"), F.col("n_chars"))).alias("chars")
    n = F.conv(F.hex(F.expr("substring(counts, cast(4 * chars + 1 as int), 4)")), 16, 10).cast("long")
    return table.select("doc_id", at, "counts").select("doc_id", "chars", n.alias("n_tokens"))


def truncate(table: DataFrame, budgets: list[int]) -> DataFrame:
    """doc_id, and for each budget the characters of the longest prefix within it, from ``stored``."""
    kind = dict(table.dtypes)["doc_id"].replace("bigint", "long")

    def one(batch: pa.RecordBatch) -> dict:
        found = [np.frombuffer(c, ">u4") for c in batch.column("counts").to_pylist()]
        # the empty prefix has none, so there is always one
        longest = [[int(np.flatnonzero(c <= max(0, b))[-1]) for b in budgets] for c in found]
        return {"doc_id": batch.column("doc_id"), "budgets": [budgets] * len(found), "chars": longest}

    return map_arrow(table.select("doc_id", "counts"), one, f"doc_id {kind}, budgets array<long>, chars array<long>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
