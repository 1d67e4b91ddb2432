"""Operator 13: alignment of two tokenizers over a corpus, with an identity map as the fast path.

Both tokenizers cut a blank and the text into tokens of known bytes.  Where a token of A and one of B end at the same
byte, a group ends, and these two tokens are linked.  Groups of one token on each side hold the same bytes; the
map from A's ids to B's ids of the same bytes is made once from the vocabularies, so such links are counted in
one vector as long as A's vocabulary.  Only the links of irregular groups are counted as pairs.

1. One pass encodes the texts and writes, for each row, its counts, digest, the A ids of exact links and the irregular pairs.
   Texts are cut at single blanks between other characters, where neither tokenizer can merge (checked on B's vocabulary;
   A splits there before it merges), and units at line feeds and before a closing mark; a worker encodes a part that it knows
   only once, many new ones in one text, whose tokens are aligned by one sorted search over their ends.
2. Counts: a vector of A's vocabulary by partial sums; irregular pairs, counted within each batch first, in the one shuffle of pairs.
3. A pass over what step 1 wrote adds up counts and best links.  The vectors and the pairs with more than a FREQUENT-th of all
   irregular links, which are fewer than FREQUENT, go to every task; the other pairs of a row are looked up by a join, in
   which no key has more than that share of the rows.

Defined cases: a null or empty text, and one that a tokenizer does not give back byte by byte, has no tokens: zeros and an
empty digest; special strings in a text are plain text; a text of any length is encoded whole, in units; of equally frequent A
tokens all are the best of their B token; repeated rows and rows with a null id each count; an empty table gives no rows;
further columns, whatever their names, are ignored.  Vocabulary files are read by each worker from paths that are parameters.
"""

from __future__ import annotations

import gc
import hashlib
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, dropped, map_arrow, table, text_or_empty, written
from .tokens import _byte_letters

#: Parts that a worker remembers in each of two generations, about, and the longest of them in characters.
REMEMBER, LONGEST = 150_000, 64
#: Parts that are encoded and aligned in one go, those of them in one text, and characters of texts that are taken together.
AT_ONCE, JOINED, TOGETHER = 8192, 512, 1 << 21
#: The part that begins each such text, and marks that are kept apart from the word before them.
FILLER, TAILS = " a", ".,;:!?"
#: What a part has that does not come back byte by byte, and a text that has such a part.
NO_TOKENS: tuple = (0, 0, b"", b"", b"")
NOTHING: tuple = (0, 0, 0, "", b"", b"")
#: Irregular pairs that go to every task are fewer than this.
FREQUENT = 1 << 19


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


class Aligner:
    """Two tokenizers, the bytes of their tokens and the map between tokens of the same bytes."""

    def __init__(self, path_a: str, path_b: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        letters = _byte_letters()
        special = {t.content for t in self.a.get_added_tokens_decoder().values()}
        self.a_bytes = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab().items():
            self.a_bytes[i] = token.encode() if token in special else bytes(letters[c] for c in token)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.sizes = [np.array(list(map(len, v)), np.int64) for v in (self.a_bytes, self.b_bytes)]
        # each id as digits, with zeros before them and room for a sign behind
        said = [b"%d," % i for i in range(max(map(len, self.sizes)))]
        self.widths = np.array(list(map(len, said)), np.int64)
        self.digits = np.frombuffer(b"".join(x.rjust(self.widths.max(), b"\0") for x in said), np.uint8).reshape(len(said), -1)
        # of several B ids of the same bytes the last: byte pieces, which stand first, are for characters without one
        plain = {t: i for i, t in enumerate(self.b_bytes) if not (self.b.is_control(i) or self.b.is_unknown(i))}
        self.same = np.array([plain.get(t, -1) for t in self.a_bytes], np.int64)
        self.apart = not any(" " in p.lstrip("▁").replace("▁", " ") for p in pieces)
        self.lines_apart = self.apart and not any(b"\n" in t and len(t) > 1 for t in self.b_bytes)
        self.tails = self._tails()
        self.known: dict[str | bytes, tuple] = {}
        self.older: dict[str | bytes, tuple] = {}

    def _tails(self) -> dict[str, tuple]:
        """What is known of marks that may end a word, where B has no piece over a letter and the mark."""
        out = {}
        whole = lambda t: (self.a.encode(" " + t, add_special_tokens=False).ids, self.b.encode(t))
        a, b = whole("a")
        pieces = [t.decode("utf-8", "replace") for v in (self.a_bytes, self.b_bytes) for t in v]
        for mark in TAILS if self.apart else "":
            over = any(mark in p[1:] and any(_is_letter(x) and y == mark for x, y in zip(p, p[1:])) for p in pieces)
            x, y = whole("a" + mark)
            if not over and x[: len(a)] == a and y[: len(b)] == b:
                out[mark] = self.aligned(mark.encode(), x[len(a) :], y[len(b) :])
        return out

    def units(self, text: str) -> list[str]:
        """The text in parts that begin with a blank, which is left out; neither tokenizer merges over them."""
        return _CUT(text) if self.apart else [text]

    def parts(self, unit: str) -> list[tuple[str | bytes, str]]:
        """The words of a unit, each with the mark after it; those that follow a line feed are bytes, which are no unit."""
        lines = _LINES(unit) if self.lines_apart and "\n" in unit else [unit]
        marked = [(t[:-1], t[-1]) if len(t) > 1 and t[-1] in self.tails and _is_letter(t[-2]) else (t, "") for t in lines]
        return [(("\n" + w).encode("utf-8", "surrogatepass") if k else w, m) for k, (w, m) in enumerate(marked)]

    def rows(self, texts: list[str]) -> list[tuple]:
        """For each text: A's tokens, B's tokens, groups, digest, A ids of exact links, irregular pairs (as bytes)."""
        collects = gc.isenabled()
        gc.disable()  # what is made here is many and has no cycles
        try:
            cut = [self.units(t) if t else [] for t in texts]
            long = self.learn(set().union(*cut).difference(self.known))
            known = self.known.__getitem__
            out = [self.row(list(map(known, units))) for units in cut]
            for u in long:
                del self.known[u]
            if len(self.known) > REMEMBER:
                self.older, self.known = self.known, {}
        finally:
            if collects:
                gc.enable()
        return out

    def learn(self, units: set[str]) -> list[str | bytes]:
        """Make units known, encoding what is new of their parts in one go; those that are too long to be remembered."""
        known, older, tails, split, new = self.known, self.older.get, self.tails, [], []
        for u in units:
            if (got := older(u)) is not None:
                known[u] = got
            elif "\n" in u or u[-1:] in tails:
                parts = self.parts(u)
                if parts == [(u, "")]:
                    new.append(u)
                else:
                    split.append((u, parts))
            else:
                new.append(u)
        words = {w for _, parts in split for w, _ in parts}.difference(known, new)
        for w in words:
            if (got := older(w)) is not None:
                known[w] = got
            else:
                new.append(w)
        for at in range(0, len(new), AT_ONCE):
            some = new[at : at + AT_ONCE]
            known.update(zip(some, self.encoded([u.decode("utf-8", "surrogatepass") if isinstance(u, bytes) else " " + u for u in some]), strict=True))
        for u, parts in split:
            known[u] = _joined([x for w, m in parts for x in ((known[w], tails[m]) if m else (known[w],))])
        return [u for u in (*new, *(u for u, _ in split)) if len(u) > LONGEST]

    def encoded(self, parts: list[str]) -> list[tuple]:
        """For each part (with the blank or line feed it begins with) what ``aligned`` says of it."""
        plain = [k for k, p in enumerate(parts) if _PLAIN(p) and "▁" not in p] if self.apart else []
        got = self.at_once([parts[k] for k in plain]) if plain else None
        out: list = [None] * len(parts)
        for k, x in zip(plain, got or (), strict=False):
            out[k] = x
        for k, p in enumerate(parts):
            if out[k] is None:
                out[k] = self.alone(p)
        return out

    def alone(self, part: str) -> tuple:
        if not _is_text(part):  # half a surrogate pair is no text
            return NO_TOKENS
        if part[0] == " ":
            return self.aligned(part.encode(), self.a.encode(part, add_special_tokens=False).ids, self.b.encode(part[1:]))
        # a line feed, after the blank that B adds
        return self.aligned(part.encode(), self.a.encode(part, add_special_tokens=False).ids, self.b.encode(part)[1:])

    def at_once(self, parts: list[str]) -> list[tuple] | None:
        """The same for parts that stay apart in one text; None where that does not come back byte by byte, part by part."""
        cut = [q for at in range(0, len(parts), JOINED) for q in (FILLER, *parts[at : at + JOINED])]
        joined = ["".join(cut[at : at + JOINED + 1]) for at in range(0, len(cut), JOINED + 1)]
        try:
            raw = "".join(joined).encode()
        except UnicodeEncodeError:
            return None
        a = list(chain.from_iterable(e.ids for e in self.a.encode_batch_fast(joined, add_special_tokens=False)))
        b = list(chain.from_iterable(self.b.encode([t[1:] for t in joined])))
        if b"".join(map(self.a_bytes.__getitem__, a)) != raw or b"".join(map(self.b_bytes.__getitem__, b)) != raw:
            return None
        a, b = np.array(a, np.int64), np.array(b, np.int64)
        end_a, end_b = np.cumsum(self.sizes[0][a]), np.cumsum(self.sizes[1][b])
        at = np.searchsorted(end_b, end_a)
        last_a = np.flatnonzero(end_b[at] == end_a)
        last_b, ends = at[last_a], end_a[last_a]
        part_end = np.cumsum([len(q.encode()) for q in cut])
        of_part = np.searchsorted(ends, part_end)
        if (ends[of_part] != part_end).any():
            return None
        n_a, n_b = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
        x, y = a[last_a], b[last_b]
        exact = (n_a == 1) & (n_b == 1) & (self.same[x] == y)
        # the groups' text: of each group A's tokens, then B's, as rows of digits with a sign behind them
        ids, sign = np.empty(len(a) + len(b), np.int64), np.full(len(a) + len(b), ord(","), np.uint8)
        at_a = np.arange(len(a)) + np.repeat(last_b - n_b + 1, n_a)
        at_b = np.arange(len(b)) + np.repeat(last_a + 1, n_b)
        ids[at_a], ids[at_b] = a, b
        sign[at_a[last_a]], sign[at_b[last_b]] = ord("|"), ord(";")
        wide = self.digits[ids]
        wide[:, -1] = sign
        said, size = wide[wide > 0].tobytes(), np.cumsum(self.widths[ids])
        same, odd = x[exact].astype("<i4").tobytes(), (x << 32 | y)[~exact].astype("<i8").tobytes()
        till = lambda v: [0, *v.tolist()]
        ea, eb, n = till(last_a[of_part] + 1), till(last_b[of_part] + 1), till(of_part + 1)
        e = till(np.cumsum(exact)[of_part])
        z = till(size[at_b[last_b[of_part]]])
        out = []
        for k in range(len(cut)):
            if k % (JOINED + 1):
                a0, a1, b0, b1, e0, e1 = ea[k], ea[k + 1], eb[k], eb[k + 1], e[k], e[k + 1]
                out.append((a1 - a0, b1 - b0, said[z[k] : z[k + 1]], same[4 * e0 : 4 * e1], odd[8 * (n[k] - e0) : 8 * (n[k + 1] - e1)]))
        return out

    def aligned(self, raw: bytes, a: list[int], b: list[int]) -> tuple:
        """A's tokens, B's tokens, the groups' text, A ids of exact links and irregular pairs (4 and 8 bytes each); nothing if not all bytes came back."""
        of_a, of_b, same = self.a_bytes, self.b_bytes, self.same
        if b"".join([of_a[i] for i in a]) != raw or b"".join([of_b[i] for i in b]) != raw:
            return NO_TOKENS
        groups, exact, odd = [], [], []
        i = j = from_a = from_b = 0
        end_a, end_b = len(of_a[a[0]]), len(of_b[b[0]])
        while True:
            if end_a == end_b:
                x, y = a[i], b[j]
                if i == from_a and j == from_b and same[x] == y:
                    exact.append(x)
                else:
                    odd.append(x << 32 | y)
                groups.append(",".join(map(str, a[from_a : i + 1])) + "|" + ",".join(map(str, b[from_b : j + 1])) + ";")
                from_a, from_b = i + 1, j + 1
                if from_a == len(a):
                    return len(a), len(b), "".join(groups).encode(), np.array(exact, "<i4").tobytes(), np.array(odd, "<i8").tobytes()
            behind = end_b - end_a
            if behind >= 0:
                i += 1
                end_a += len(of_a[a[i]])
            if behind <= 0:
                j += 1
                end_b += len(of_b[b[j]])

    def row(self, parts: list[tuple]) -> tuple:
        """The parts of a text as one, with a digest in place of the groups' text."""
        if not parts:
            return NOTHING
        a, b, said, exact, odd = _joined(parts)
        if not a:
            return NOTHING
        return a, b, len(exact) // 4 + len(odd) // 8, hashlib.sha256(said[:-1]).hexdigest(), exact, odd


def _joined(parts: list[tuple]) -> tuple:
    """Parts one after the other as one; a part without tokens leaves the whole without."""
    a, b, said, exact, odd = zip(*parts, strict=True)
    if 0 in a:
        return NO_TOKENS
    return sum(a), sum(b), b"".join(said), b"".join(exact), b"".join(odd)


def _is_letter(c: str) -> bool:
    """A Latin letter, on which all tables of characters agree."""
    return c < "\u0250" and c.isalpha()


def _is_text(unit: str) -> bool:
    try:
        unit.encode()
    except UnicodeEncodeError:
        return False
    return True


_CUT = re.compile(r"(?<=[^\s᠎]) (?=[^\s᠎])").split
#: Line feeds between other characters, at which a unit is cut further.
_LINES = re.compile(r"(?<=[^\s᠎])\n(?=[^\s᠎])").split
#: Parts that stay as they are between others.
_PLAIN = re.compile(r"[ \n][^\s᠎](?:.*[^\s᠎])?", re.DOTALL).fullmatch
_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(paths: tuple[str, str]) -> Aligner:
    """One for each worker process and pair of files."""
    if paths not in _ALIGNERS:
        _ALIGNERS[paths] = Aligner(*paths)
    return _ALIGNERS[paths]


def links(docs: DataFrame, paths: tuple[str, str]) -> DataFrame:
    """rid, doc_id, n_a, n_b, n_groups, groups_sha256, exact (A ids as 4 bytes), odd (pairs as 8 bytes) for every row."""
    kind = dict(docs.dtypes)["doc_id"].replace("bigint", "long")

    def one(batch: pa.RecordBatch) -> dict:
        texts, found, at, size = batch.column("text").to_pylist(), [], 0, 0
        for k, t in enumerate(texts):
            size += len(t)
            if size >= TOGETHER or k + 1 == len(texts):
                found += aligner(paths).rows(texts[at : k + 1])
                at, size = k + 1, 0
        rows = list(zip(*found, strict=True))
        return {"rid": batch.column("rid"), "doc_id": batch.column("doc_id")} | dict(zip(("n_a", "n_b", "n_groups", "groups_sha256", "exact", "odd"), rows, strict=True))

    rows = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", text_or_empty().alias("text"))
    return map_arrow(rows, one, f"rid long, doc_id {kind}, n_a long, n_b long, n_groups long, groups_sha256 string, exact binary, odd binary")


def exact_counts(found: DataFrame, n: int) -> np.ndarray:
    """How often each A id is linked to the B id of its bytes: one vector a task, summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n, np.int64)
        for batch in batches:
            for x in batch.column("exact").to_pylist():
                total += np.bincount(np.frombuffer(x, "<i4"), minlength=n)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["a", "n"])

    bounded_batches(found.sparkSession)
    out = np.zeros(n, np.int64)
    # at most a row for each id of the vocabulary
    for r in found.select("exact").mapInArrow(run, "a long, n long").groupBy("a").agg(F.sum("n").alias("n")).collect():
        out[r.a] = r.n
    return out


def pair_counts(found: DataFrame) -> DataFrame:
    """pair, n: how often each irregular pair is linked."""

    def one(batch: pa.RecordBatch) -> dict:
        pairs, n = np.unique(np.frombuffer(b"".join(batch.column("odd").to_pylist()), "<i8"), return_counts=True)
        return {"pair": pa.array(pairs, pa.int64()), "n": pa.array(n, pa.int64())}

    return map_arrow(found.select("odd"), one, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def counts(docs: DataFrame, paths: tuple[str, str] | None = None) -> DataFrame:
    """a, b, n: how often each pair of ids is linked over the corpus."""
    paths = paths or default_paths()
    found = written(links(docs, paths), "align-links")
    same = aligner(paths).same
    exact = exact_counts(found, len(same))
    at = np.flatnonzero(exact)
    fast = docs.sparkSession.createDataFrame([(int(i), int(same[i]), int(exact[i])) for i in at], "a long, b long, n long")
    low = F.lit((1 << 32) - 1)
    return fast.unionByName(pair_counts(found).select(F.shiftright("pair", 32).alias("a"), F.col("pair").bitwiseAND(low).alias("b"), "n"))


def report(docs: DataFrame, paths: tuple[str, str] | None = None, frequent: int = FREQUENT) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for every row."""
    paths, spark = paths or default_paths(), docs.sparkSession
    found = written(links(docs, paths), "align-links")
    same, b_size = aligner(paths).same, len(aligner(paths).b_bytes)
    exact = exact_counts(found, len(same))
    pairs = written(pair_counts(found), "align-pairs")
    best = np.zeros(b_size, np.int64)
    np.maximum.at(best, same[same >= 0], exact[same >= 0])
    # at most a row for each id of B's vocabulary
    for r in pairs.groupBy(F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)).alias("b")).agg(F.max("n").alias("n")).collect():
        best[r.b] = max(best[r.b], r.n)
    total = pairs.agg(F.sum("n")).first()[0] or 0
    often = pairs.where(F.col("n") > total // frequent).toPandas().sort_values("pair")
    keys, times = often["pair"].to_numpy(np.int64), often["n"].to_numpy(np.int64)
    top = exact == best[same]  # of ids with a B id
    sent = spark.sparkContext.broadcast((exact, top, best, keys, times))
    kind = dict(docs.dtypes)["doc_id"].replace("bigint", "long")

    def one(batch: pa.RecordBatch) -> dict:
        exact, top, best, keys, times = sent.value
        out: dict[str, list] = {"n_best": [], "count_sum": [], "rest": []}
        for e, o in zip(batch.column("exact").to_pylist(), batch.column("odd").to_pylist(), strict=True):
            e, o = np.frombuffer(e, "<i4"), np.frombuffer(o, "<i8")
            at = np.minimum(np.searchsorted(keys, o), max(len(keys) - 1, 0))
            met = keys[at] == o if len(keys) else np.zeros(len(o), bool)
            n, b = times[at[met]], o[met] & 0xFFFFFFFF
            out["n_best"].append(int(top[e].sum() + (n == best[b]).sum()))
            out["count_sum"].append(int(exact[e].sum() + n.sum()))
            out["rest"].append(o[~met].tolist())
        return {c: batch.column(c) for c in ("rid", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256")} | out

    known = written(map_arrow(found, one, f"rid long, doc_id {kind}, n_a long, n_b long, n_groups long, groups_sha256 string, n_best long, count_sum long, rest array<long>"), "align-known")
    rest = known.select("rid", F.explode("rest").alias("pair")).groupBy("rid", "pair").agg(F.count(F.lit(1)).alias("times"))
    best_of = F.broadcast(spark.createDataFrame([(int(b), int(n)) for b, n in enumerate(best)], "b long, best long"))
    rare = pairs.where(F.col("n") <= total // frequent).withColumn("b", F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))).join(best_of, "b").select("pair", "n", (F.col("n") == F.col("best")).cast("long").alias("top"))
    more = rest.join(rare, "pair").groupBy("rid").agg(F.sum(F.col("times") * F.col("n")).alias("more_sum"), F.sum(F.col("times") * F.col("top")).alias("more_best"))
    more = written(more, "align-more")
    dropped(found, pairs)
    zero = F.lit(0).cast("long")
    out = known.drop("rest").join(more, "rid", "left")
    return out.select("doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), (F.col("n_best") + F.coalesce("more_best", zero)).alias("n_best"), (F.col("count_sum") + F.coalesce("more_sum", zero)).alias("count_sum"), "groups_sha256")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"))
