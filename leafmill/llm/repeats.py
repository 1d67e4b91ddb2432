"""Operator 6: removal of long repeated passages with a run-length index.

A string of LENGTH bytes is removed wherever it begins at two places or more.  Finding them takes

1. Sections.  Each window of LENGTH bytes is named by the least hash of its GRAM-byte strings; the
   windows in a row that share a name form a section.  Equal windows have equal names, so a repeat
   can only be between sections of one name, and nearly all names occur once.  Periodic texts have
   long sections, which are cut at the name's string after every SECTION windows, so that pieces are alike.
   The sections are made in one pass over the texts and written.
2. Sections that are the same to the last byte in two places are repeats as a whole.
3. The different sections of a name go, together with many other names, to one task, which builds
   a run-compressed BWT of them with samples at the run ends, streams their matching statistics and marks
   matches of LENGTH or more.  Blocks are bounded; a name with more than HOT different sections or HOT_BYTES of
   them has its windows counted by a hash of 128 bits over all tasks instead, so no group is ever gathered.  The
   result is the same: both count every window of the name.
4. The marks of a row come together and its bytes are cut.

Matches never cross rows.  Defined cases: a null text is empty; a text shorter than LENGTH keeps all; a text of
any length is treated whole; repeated rows (null ids too) are each other's copies, so all lose everything from
LENGTH bytes on; an empty table gives no rows; there are no ties, as every place of a repeated string counts; further
columns, whatever their names, are ignored by ``marks`` and kept by ``deduplicate``; removal may split a character, whose
remaining bytes are kept in the digest and dropped in ``deduplicate``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, dropped, map_arrow, row_key, table, text_or_empty, written
from .rolling import OTHER_LETTERS, PrefixHash
from .runs import repeated

LENGTH, GRAM = 400, 64
#: Bytes of sections in one index, and different sections of one name, in number and bytes, that an index takes.
BLOCK_BYTES, HOT, HOT_BYTES = 1 << 18, 1000, 1 << 21
#: Windows of a section, after which it is cut.
SECTION = 1 << 16


def least_in_windows(h: np.ndarray, width: int) -> np.ndarray:
    """Least value of each window, by doubling."""
    out, have = h, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def sections(raw: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """name, hash of the bytes, start, size, and whether the name's string occurs in it twice."""
    none = np.zeros(0, np.int64)
    if len(raw) < length:
        return none, none, none, none, none
    grams = PrefixHash(raw).windows(gram)
    names = least_in_windows(grams, length - gram + 1)
    first = np.concatenate([[0], np.flatnonzero(names[1:] != names[:-1]) + 1])
    cuts: list[int] = []
    after = np.append(first[1:], len(names))
    for k in np.flatnonzero(after - first > SECTION):
        # at most a window apart
        at = first[k] + np.flatnonzero(grams[first[k] : after[k]] == names[first[k]])
        i = int(np.searchsorted(at, first[k] + SECTION))
        while i < len(at):
            cuts.append(at[i])
            i = int(np.searchsorted(at, at[i] + SECTION))
    first = np.sort(np.concatenate([first, np.array(cuts, np.int64)]))
    end = np.append(first[1:], len(names)) - 1 + length
    name = names[first]
    twice = np.array([np.count_nonzero(grams[a : b - gram + 1] == v) > 1 for a, b, v in zip(first, end, name, strict=True)])
    body = np.frombuffer(b"".join(hashlib.blake2b(raw[a:b], digest_size=8).digest() for a, b in zip(first, end, strict=True)), np.int64)
    return name.view(np.int64), body, first, end - first, twice


def _rows(docs: DataFrame) -> DataFrame:
    """row (a key that repeated rows share), doc_id, text."""
    return docs.select("doc_id", text_or_empty().alias("text")).withColumn("row", row_key())


def all_sections(rows: DataFrame, length: int, gram: int) -> DataFrame:
    """name, body, row, start, size, twice."""

    def one(batch: pa.RecordBatch) -> dict:
        parts = [sections(t.encode("utf-8", "surrogatepass"), length, gram) for t in batch.column("text").to_pylist()]
        name, body, start, size, twice = (np.concatenate(x) for x in zip(*parts, strict=True))
        owner = np.repeat(np.arange(len(parts)), [len(x[0]) for x in parts])
        return {"name": name, "body": body, "row": batch.column("row").take(pa.array(owner)), "start": start, "size": size, "twice": twice.astype(bool)}

    return map_arrow(rows.select("row", "text"), one, "name long, body long, row binary, start long, size long, twice boolean")


def _columns(rows: list[tuple], names: tuple[str, ...]) -> pa.RecordBatch:
    """Rows as a batch: row and bytes are binary, all else is a number."""
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if n in ("row", "bytes") else pa.int64()) for n, c in zip(names, columns, strict=True)], names=list(names))


def _cut(texts: DataFrame) -> DataFrame:
    """name, row, start, n, counted, bytes: the sections of each text that its ``asked`` lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row, text, asked in zip(*(batch.column(c).to_pylist() for c in ("row", "text", "asked")), strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                out += [(x["name"], row, x["start"], x["n"], x["counted"], raw[x["start"] : x["start"] + x["size"]]) for x in asked]
            yield _columns(out, ("name", "row", "start", "n", "counted", "bytes"))

    bounded_batches(texts.sparkSession)
    return texts.mapInArrow(run, "name long, row binary, start long, n long, counted long, bytes binary")


def _indexed(cut: DataFrame, length: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """row, start, end of the repeated ranges in sections (name, row, start, n, bytes) that lie sorted by name."""

    def block(held: list[tuple[int, bytes, int, int, bytes]]) -> pa.RecordBatch:
        found = repeated([x[4] for x in held], length)
        # a section with copies is marked as a whole already
        marks = [(row, at + a, at + b) for (_, row, at, n, _), ranges in zip(held, found, strict=True) if n == 1 for a, b in ranges]
        return _columns(marks, ("row", "start", "end"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for x in zip(*(batch.column(c).to_pylist() for c in ("name", "row", "start", "n", "bytes")), strict=True):
                if size >= block_bytes and x[0] != held[-1][0]:
                    yield block(held)
                    held, size = [], 0
                held.append(x)
                size += len(x[4])
        if held:
            yield block(held)

    bounded_batches(cut.sparkSession)
    return cut.mapInArrow(run, "row binary, start long, end long")


def _counted(cut: DataFrame, length: int) -> DataFrame:
    """The same for sections of hot names: every window is counted by 128 bits."""

    def one(batch: pa.RecordBatch) -> dict:
        raws = batch.column("bytes").to_pylist()
        hashes = [[PrefixHash(b, *letters).windows(length).view(np.int64).tolist() for b in raws] for letters in ((), (OTHER_LETTERS,))]
        return {c: batch.column(c) for c in ("name", "row", "start", "n")} | {"h": hashes[0], "g": hashes[1]}

    wide = map_arrow(cut, one, "name long, row binary, start long, n long, h array<long>, g array<long>")
    windows = wide.select("name", "row", "n", "start", F.posexplode(F.arrays_zip("h", "g")).alias("i", "w")).select("name", "row", "n", (F.col("start") + F.col("i")).alias("start"), "w.h", "w.g")
    again = windows.groupBy("name", "h", "g").agg(F.sum("n").alias("times")).where("times > 1").select("name", "h", "g")
    hit = windows.where("n = 1").join(again, ["name", "h", "g"])
    return hit.select("row", "start", (F.col("start") + length).alias("end"))


def marks(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT, hot_bytes: int = HOT_BYTES) -> DataFrame:
    """row, start, end: ranges of bytes covered by repeated strings; they may overlap."""
    rows = _rows(docs)
    found = written(all_sections(rows, length, gram), "repeat-all-sections")
    bodies = found.groupBy("name", "body").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("row", "start", "size")).alias("at"), F.max("twice").alias("twice"))
    names = bodies.groupBy("name").agg(F.count(F.lit(1)).alias("bodies"), F.max("twice").alias("any_twice"), F.max("n").alias("most"), F.sum("at.size").alias("bytes"))
    counted = ((F.col("bodies") > hot) | (F.col("bytes") > hot_bytes)).cast("long").alias("counted")
    names = names.where("bodies > 1 or any_twice or most > 1").select("name", "bodies", "any_twice", counted)
    kept = written(bodies.join(names, "name").select("name", "body", "n", "at.*", "bodies", "any_twice", "counted"), "repeat-sections")

    copies = kept.where("n > 1").select("name", "body")
    whole = written(found.join(copies, ["name", "body"]).select("row", "start", (F.col("start") + F.col("size")).alias("end")), "repeat-copies")
    dropped(found)

    asked = kept.where("bodies > 1 or any_twice").groupBy("row").agg(F.collect_list(F.struct("name", "start", "size", "n", "counted")).alias("asked"))
    texts = rows.select("row", "text").join(asked, "row").dropDuplicates(["row"])
    cut = written(_cut(texts), "repeat-cut")
    few = cut.where("counted = 0").drop("counted").repartition("name").sortWithinPartitions("name", "row", "start")
    out = whole.unionByName(_indexed(few, length))
    if not kept.where("counted = 1").isEmpty():
        out = out.unionByName(_counted(cut.where("counted = 1").drop("counted"), length))
    return out


def _packed(docs: DataFrame, length: int, gram: int, hot: int) -> DataFrame:
    """row, marks: the marks on each row that has any."""
    return marks(docs, length, gram, hot).groupBy("row").agg(F.collect_set(F.struct("start", "end")).alias("marks"))


def spans(marks: list[dict] | None) -> list[tuple[int, int]]:
    """Maximal ranges, in order, of marks (start, end)."""
    out: list[list[int]] = []
    for a, b in sorted((m["start"], m["end"]) for m in marks or ()):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def kept_bytes(raw: bytes, cut: list[tuple[int, int]]) -> bytes:
    edges = [0, *(x for ab in cut for x in ab), len(raw)]
    return b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def report(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """The digest columns for every row."""
    kind = dict(docs.dtypes)["doc_id"].replace("bigint", "long")

    def one(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {"n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": []}
        for text, m in zip(batch.column("text").to_pylist(), batch.column("marks").to_pylist(), strict=True):
            raw, cut = text.encode("utf-8", "surrogatepass"), spans(m)
            for k, v in zip(out, (len(raw), sum(b - a for a, b in cut), len(cut), hashlib.sha256(kept_bytes(raw, cut)).hexdigest()), strict=True):
                out[k].append(v)
        return {"doc_id": batch.column("doc_id")} | out

    joined = _rows(docs).join(_packed(docs, length, gram, hot), "row", "left")
    return map_arrow(joined.select("doc_id", "text", "marks"), one, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def deduplicate(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """docs with the repeated passages cut out of text (null stays null)."""

    @F.pandas_udf("string")
    def cleaned(texts, found):
        cut = lambda t, m: t if t is None or m is None else kept_bytes(t.encode("utf-8", "surrogatepass"), spans(list(m))).decode("utf-8", "ignore")
        return pd.Series([cut(t, m) for t, m in zip(texts, found, strict=True)], dtype=object)

    names = docs.columns
    keyed = docs.select(F.struct("*").alias("doc"), "doc_id", text_or_empty().alias("text")).select("doc", row_key().alias("row"))
    joined = keyed.join(_packed(docs, length, gram, hot), "row", "left")
    return joined.select(*(cleaned(F.col("doc.text"), "marks").alias(c) if c == "text" else F.col("doc").getField(c).alias(c) for c in names))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"))
