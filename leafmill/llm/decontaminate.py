"""Operator 1: benchmark decontamination.

The benchmark's word windows go to every task as a broadcast hash set, in blocks of a fixed size.
Each document is turned into word numbers, its windows are hashed and looked up, and each hit is
verified on the words themselves.  There is no shuffle: a document never leaves its partition.

That holds for a benchmark of up to MAX_BLOCKS blocks (its size is checked).  The windows of a larger one stay a table:
a bit map of their hashes, of a fixed size, goes to the tasks; document windows that it lets through are joined with the
windows on the words themselves, frequent ones in parts, and the hits of a row come together.  The result is the same.

Defined cases: a null or empty text has no words and no hits; a text of any length is scanned whole; repeated rows,
null ids too, are each reported; an empty table gives no rows and an empty benchmark hits nothing; a benchmark item
without words or id is no window; item ids are compared and sorted as strings; there are no other ties; further
columns of either table, whatever their names, are ignored by ``scan`` and kept by ``decontaminate``.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD_TABLE, map_arrow, row_key, table, text_or_empty, written

WINDOW = 10
#: Bytes of benchmark text in one broadcast index, and indexes at most: a larger benchmark is joined.
BLOCK_BYTES, MAX_BLOCKS = 16 << 20, 4
#: Bits of the map that lets windows through to the join, and rows of one window in a part.
FILTER_BITS, SPLIT = 1 << 29, 4096
#: Windows with more hits than SPLIT that are broadcast at most.
FREQUENT = 1 << 18

_BASE = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(WORD_TABLE).split()


class WindowIndex:
    """The windows of one block of items: a hash set, and the words and items behind each hash."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW) -> None:
        self.vocab: dict[bytes, int] = {}
        self.windows: dict[tuple[int, ...], set[str]] = defaultdict(set)
        for item, text in items:
            ids = [self.vocab.setdefault(w, len(self.vocab)) for w in words_of(text)]
            for i in range(max(0, len(ids) - window) + 1 if ids else 0):
                self.windows[tuple(ids[i : i + window])].add(item)
        self.windows = dict(self.windows)
        by_length: dict[int, list[tuple[int, ...]]] = defaultdict(list)
        for w in self.windows:
            by_length[len(w)].append(w)
        self.hashes = {n: np.unique(self.hashed(np.array(ws, np.int64))) for n, ws in sorted(by_length.items())}

    @staticmethod
    def hashed(rows: np.ndarray) -> np.ndarray:
        h = np.zeros(len(rows), np.uint64)
        for j in range(rows.shape[1]):
            h = (h + rows[:, j].astype(np.uint64) + np.uint64(1)) * _BASE
            h ^= h >> np.uint64(29)
        return h

    def hits(self, words: list[bytes]) -> tuple[np.ndarray, set[str]]:
        """Which words lie inside an occurrence of a window, and the items with one."""
        n, get = len(words), self.vocab.get
        cover, items = np.zeros(n, bool), set()
        ids = np.array([get(w, -1) for w in words], np.int64)
        # known[i]: how many words from i on the benchmark has at all
        stop = np.minimum.accumulate(np.where(ids < 0, np.arange(n), n)[::-1])[::-1]
        known = stop - np.arange(n)
        for length, hashes in self.hashes.items():
            at = np.flatnonzero(known >= length)
            if not at.size:
                continue
            rows = ids[at[:, None] + np.arange(length)]
            h = self.hashed(rows)
            slot = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            for i in np.flatnonzero(hashes[slot] == h):
                found = self.windows.get(tuple(rows[i].tolist()))  # verify: the words, not their hash
                if found:
                    cover[at[i] : at[i] + length] = True
                    items |= found
        return cover, items


def _items(bench: DataFrame) -> DataFrame:
    return bench.select(F.col("item_id").cast("string").alias("i"), text_or_empty().alias("t")).where("i is not null")


def _fits(bench: DataFrame, block_bytes: int, max_blocks: int) -> bool:
    """Whether the benchmark may be held in a few blocks."""
    return (_items(bench).agg(F.sum(F.length("t") * 4 + 64)).first()[0] or 0) <= block_bytes * max_blocks


def _blocks(bench: DataFrame, block_bytes: int) -> list[list[tuple[str, str]]]:
    """The benchmark in blocks of at most block_bytes (one item at least), each small enough to broadcast."""
    blocks: list[list[tuple[str, str]]] = [[]]
    size = 0
    for r in _items(bench).toLocalIterator():
        n = len(r.t) * 4 + 64
        if blocks[-1] and size + n > block_bytes:
            blocks.append([])
            size = 0
        blocks[-1].append((r.i, r.t))
        size += n
    return blocks


def _slots(windows: list[bytes], bits: int) -> np.ndarray:
    """Two places of each window in the bit map."""
    digests = np.frombuffer(b"".join(hashlib.blake2b(w, digest_size=16).digest() for w in windows), np.uint64).reshape(-1, 2)
    return (digests % np.uint64(bits)).astype(np.int64)


def _windows(words: list[bytes], n: int) -> list[bytes]:
    return [b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)]


def _window_table(bench: DataFrame, window: int) -> DataFrame:
    """item, n, words: the distinct windows of all items."""

    def one(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {"item": [], "n": [], "words": []}
        for item, text in zip(batch.column("i").to_pylist(), batch.column("t").to_pylist(), strict=True):
            words = words_of(text)
            n = min(window, len(words))
            found = set(_windows(words, n)) if n else ()
            out["item"] += [item] * len(found)
            out["n"] += [n] * len(found)
            out["words"] += found
        return out

    return map_arrow(_items(bench), one, "item string, n int, words binary").distinct()


def _bit_map(table: DataFrame, bits: int) -> np.ndarray:
    """The map of a table's windows; each task sends the bytes it sets, and their union is of a fixed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = np.zeros(bits // 8, np.uint8)
        for b in batches:
            if b.num_rows:
                at = _slots(b.column("words").to_pylist(), bits).ravel()
                np.bitwise_or.at(got, at >> 3, (1 << (at & 7)).astype(np.uint8))
        at = np.flatnonzero(got)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(got[at].astype(np.int32))], names=["at", "v"])

    out = np.zeros(bits // 8, np.uint8)
    for r in table.select("words").mapInArrow(run, "at long, v int").groupBy("at").agg(F.bit_or("v").alias("v")).toLocalIterator():
        out[r["at"]] = r.v
    return out


def _joined(docs: DataFrame, bench: DataFrame, window: int, bits: int) -> DataFrame:
    """``scan`` by a join of windows, for a benchmark of any size."""
    spark, kind = docs.sparkSession, dict(docs.dtypes)["doc_id"].replace("bigint", "long")
    listed = written(_window_table(bench, window), "bench-windows")
    lengths = [r.n for r in listed.select("n").distinct().collect()]  # 1 to window
    sent = spark.sparkContext.broadcast(_bit_map(listed, bits))
    rows = docs.select("doc_id", "text", row_key().alias("row"))

    def one(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {"row": [], "i": [], "n": [], "words": []}
        for row, text in zip(batch.column("row").to_pylist(), batch.column("text").to_pylist(), strict=True):
            words = words_of(text)
            for n in lengths:
                windows = _windows(words, n)
                if not windows:
                    continue
                at = _slots(windows, bits)
                for i in np.flatnonzero(((sent.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(1)).tolist():
                    for k, v in zip(out, (row, i, n, windows[i]), strict=True):
                        out[k].append(v)
        return out

    met = written(map_arrow(rows.dropDuplicates(["row"]).select("row", "text"), one, "row binary, i long, n int, words binary"), "bench-met")
    often = met.groupBy("words").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > SPLIT).select("words", F.ceil(F.col("c") / SPLIT).cast("int").alias("parts"))
    often = written(often, "bench-often")
    # a window is some 60 bytes; beyond the bound its rows are dealt by a join like the others
    often = F.broadcast(often) if often.count() <= FREQUENT else often
    parts = F.coalesce("parts", F.lit(1))
    there = listed.select("item", "words").join(often, "words", "left").select("item", "words", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    here = met.join(often, "words", "left").withColumn("part", F.pmod(F.xxhash64("row", "i"), parts).cast("int"))
    hits = here.join(there, ["words", "part"]).groupBy("row").agg(F.collect_set(F.struct("i", "n")).alias("at"), F.array_sort(F.collect_set("item")).alias("items"))

    def cover(batch: pa.RecordBatch) -> dict:
        bits_of, counts = [], []
        for text, at in zip(batch.column("text").to_pylist(), batch.column("at").to_pylist(), strict=True):
            words = words_of(text)
            got = np.zeros(len(words), bool)
            for x in at or ():
                got[x["i"] : x["i"] + x["n"]] = True
            bits_of.append(np.packbits(got).tobytes())
            counts.append(len(words))
        return {"doc_id": batch.column("doc_id"), "text": batch.column("text"), "hit": bits_of, "items": [x or [] for x in batch.column("items").to_pylist()], "n_words": counts}

    return map_arrow(rows.join(hits, "row", "left").select("doc_id", "text", "at", "items"), cover, f"doc_id {kind}, text string, hit binary, items array<string>, n_words long")


def scan(docs: DataFrame, bench: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, max_blocks: int = MAX_BLOCKS, bits: int = FILTER_BITS) -> DataFrame:
    """doc_id, text, hit (one bit a word), items (ids of items with an occurring window), n_words."""
    if not _fits(bench, block_bytes, max_blocks):
        return _joined(docs, bench, window, bits)
    out = docs.select("doc_id", "text", F.lit(None).cast("binary").alias("hit"), F.expr("cast(array() as array<string>)").alias("items"), F.lit(0).cast("long").alias("n_words"))
    for block in _blocks(bench, block_bytes):
        sent = docs.sparkSession.sparkContext.broadcast(WindowIndex(block, window))

        def one(batch: pa.RecordBatch, sent=sent) -> dict:
            index, bits, items, counts = sent.value, [], [], []
            for text, old, had in zip(batch.column("text").to_pylist(), batch.column("hit").to_pylist(), batch.column("items").to_pylist(), strict=True):
                words = words_of(text)
                cover, found = index.hits(words)
                if old:
                    cover |= np.unpackbits(np.frombuffer(old, np.uint8), count=len(words)).astype(bool)
                bits.append(np.packbits(cover).tobytes())
                items.append(sorted(found | set(had or ())))
                counts.append(len(words))
            return {"doc_id": batch.column("doc_id"), "text": batch.column("text"), "hit": bits, "items": items, "n_words": counts}

        kind = dict(docs.dtypes)["doc_id"].replace("bigint", "long")
        out = map_arrow(out, one, f"doc_id {kind}, text string, hit binary, items array<string>, n_words long")
    return out


def report(scanned: DataFrame) -> DataFrame:
    """The digest columns of ``scan``."""
    kind = dict(scanned.dtypes)["doc_id"].replace("bigint", "long")

    def one(batch: pa.RecordBatch) -> dict:
        n_hit = [int(np.unpackbits(np.frombuffer(b or b"", np.uint8)).sum()) for b in batch.column("hit").to_pylist()]
        items = batch.column("items").to_pylist()
        return {"doc_id": batch.column("doc_id"), "n_words": batch.column("n_words"), "n_hit": n_hit, "n_items": [len(x) for x in items], "items_sha256": [hashlib.sha256(",".join(x).encode()).hexdigest() for x in items], "contaminated": [n > 0 for n in n_hit]}

    return map_arrow(scanned.drop("text"), one, f"doc_id {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def decontaminate(docs: DataFrame, bench: DataFrame, remove: str = "documents", window: int = WINDOW, block_bytes: int = BLOCK_BYTES, max_blocks: int = MAX_BLOCKS, bits: int = FILTER_BITS) -> DataFrame:
    """docs without contaminated documents, or (remove="spans") without the hit words of each text."""
    if remove not in ("documents", "spans"):
        raise ValueError("remove is 'documents' or 'spans'")
    if not _fits(bench, block_bytes, max_blocks):
        # the hit bits of a row, joined to it by its key
        scanned = _joined(docs, bench, window, bits).withColumn("row", row_key()).select("row", "hit").where(F.hex("hit").rlike("[1-9A-F]"))
        keyed = docs.select(F.struct("*").alias("doc"), row_key().alias("__row")).join(scanned.dropDuplicates(["row"]), F.col("__row") == F.col("row"), "left")
        out = keyed.select("doc.*", F.col("hit").alias("__hit"))
        return out.where("__hit is null").drop("__hit") if remove == "documents" else _cut_spans(out, docs.columns)
    names, out, seen = docs.columns, docs, F.lit(None).cast("binary")
    for block in _blocks(bench, block_bytes):
        sent = docs.sparkSession.sparkContext.broadcast(WindowIndex(block, window))

        @F.pandas_udf("string")
        def cleaned(texts, sent=sent):
            return texts.map(lambda t: None if t is None or sent.value.hits(words_of(t))[0].any() else t, na_action="ignore").astype(object)

        @F.pandas_udf("binary")
        def covered(texts, old, sent=sent):
            def one(text, had):
                if text is None:
                    return None
                cover, _ = sent.value.hits(words_of(text))
                if had is not None:
                    cover |= np.unpackbits(np.frombuffer(had, np.uint8), count=len(cover)).astype(bool)
                return np.packbits(cover).tobytes()

            return pd.Series([one(t, h) for t, h in zip(texts, old, strict=True)], dtype=object)

        if remove == "documents":
            out = out.withColumn("__clean", cleaned(F.col("text"))).where("text is null or __clean is not null").select(*names)
        else:
            # every block sees the whole text; the words go at the end
            out, seen = out.withColumn("__hit", covered("text", seen)), F.col("__hit")
    return out if remove == "documents" or out is docs else _cut_spans(out, names)


def _cut_spans(rows: DataFrame, names: list[str]) -> DataFrame:
    """rows without the words that their __hit marks."""

    @F.pandas_udf("string")
    def cut(texts, hit):
        def one(text, had):
            if text is None or had is None:
                return text
            cover = np.unpackbits(np.frombuffer(had, np.uint8), count=len(words_of(text))).astype(bool)
            return _without(text, cover) if cover.any() else text

        return pd.Series([one(t, h) for t, h in zip(texts, hit, strict=True)], dtype=object)

    return rows.withColumn("text", cut("text", "__hit")).select(*names)


def _without(text: str, cover: np.ndarray) -> str:
    """The text without the words marked in cover; what stands between words stays."""
    raw = text.encode("utf-8", "surrogatepass")
    plain = np.frombuffer(raw.translate(WORD_TABLE), np.uint8) != 32
    first = plain & ~np.concatenate([[False], plain[:-1]])
    drop = plain & np.append(cover, False)[np.cumsum(first) - 1]
    return np.frombuffer(raw, np.uint8)[~drop].tobytes().decode("utf-8", "surrogatepass")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return report(scan(docs, table(spark, sf_dir, "benchmark")))


SQL = r"""
WITH item AS (
  SELECT cast(item_id AS varchar) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL),
win AS (
  SELECT DISTINCT item, least(len(w), 10) AS n, list_slice(w, i, i + least(len(w), 10) - 1) AS win
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM item WHERE len(w) > 0)),
doc AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+'), []) AS w
  FROM documents),
sizes AS (SELECT DISTINCT n FROM win),
cand AS (
  SELECT rid, n, i, list_slice(w, i, i + n - 1) AS win
  FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc, sizes WHERE len(w) >= n)),
hit AS (SELECT rid, item, i, cand.n FROM cand JOIN win USING (win)),
pos AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM hit) GROUP BY rid),
its AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM hit) GROUP BY rid)
SELECT doc_id, cast(len(w) AS bigint) AS n_words, cast(coalesce(n_hit, 0) AS bigint) AS n_hit, cast(coalesce(n_items, 0) AS bigint) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN pos USING (rid) LEFT JOIN its USING (rid)
"""
