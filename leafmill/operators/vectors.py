"""Embeddings and nearest neighbours by cosine distance.  vectors: ord, v (array<float>)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import EMBED_BATCH

#: Query vectors that go to the tasks at once, and vectors or queries of a block where both are dealt to a grid.
QUERY_BLOCK, SIDE = 4096, 8192
#: Cells of the index at most, vectors they are fitted to, vectors that the share to probe is found with, and its recall there.
MAX_CELLS, SAMPLED, TRIED, RECALL = 1024, 20_000, 200, 0.95
#: Pairs of a query and a vector that a task holds at once.
PAIRS = 1 << 21


def hashed_embedding(texts: pd.Series, dims: int = 256) -> pd.Series:
    """The default embedder: signed hashed words, of length one; the same on every machine."""
    import zlib

    def one(text: str) -> list[float]:
        v = np.zeros(dims)
        for w in (text or "").lower().split():
            h = zlib.crc32(w.encode())
            v[h % dims] += 1 if h >> 31 else -1
        n = np.linalg.norm(v)
        return (v / n if n else v).astype(np.float32).tolist()

    return texts.map(one)


def embed(rows: DataFrame, embedder: Callable[[pd.Series], pd.Series] = hashed_embedding, prefix: str = "", batch: int = EMBED_BATCH) -> DataFrame:
    """rows with a column v; queries may have a prefix of their own.  The embedder gets at most batch texts at once."""

    def run(texts: pd.Series) -> pd.Series:
        parts = []
        for i in range(0, len(texts), batch):
            asked = prefix + texts.iloc[i : i + batch].fillna("")
            parts.append(embedder(asked))
            if len(parts[-1]) != len(asked):
                raise ValueError("the embedder returned another number of vectors")
        return pd.concat(parts) if parts else pd.Series([], dtype=object)

    return rows.withColumn("v", F.pandas_udf(run, "array<float>")("text"))


def nearest(queries: DataFrame, vectors: DataFrame, k: int, few: int = QUERY_BLOCK, side: int = SIDE) -> DataFrame:
    """query_id, ord, distance, rank: exact cosine neighbours.

    Up to ``few`` queries go to all tasks, so that vectors do not move.  More of them meet the vectors on a grid: both
    sides are dealt to blocks, each pair of blocks is one cell, and a cell keeps the k best of each of its queries.
    No pair of a query and a vector becomes a row beyond that.
    """
    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), "v").where("v is not null")
    given = vectors.select(F.col("ord").cast("long").alias("ord"), "v").where("v is not null")
    some = asked.limit(few + 1).coalesce(1).collect() if few else None  # one job, where a plain limit tries a few partitions at a time
    return best(_block([(r.query_id, r.v) for r in some], given, k) if some is not None and len(some) <= few else _grid(asked, given, k, side), k)


def best(found: DataFrame, k: int) -> DataFrame:
    """The k nearest of each query, with their rank."""
    w = Window.partitionBy("query_id").orderBy("distance", "ord")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A column of arrays of equal length, as rows of length one."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return _unit(flat.reshape(len(column), -1)) if len(column) else np.zeros((0, 0))


def _grid(asked: DataFrame, given: DataFrame, k: int, side: int) -> DataFrame:
    blocks = lambda df: max(1, -(-df.count() // side))
    rows, columns = blocks(asked), blocks(given)
    own = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = asked.withColumn("row", own("query_id", rows)).withColumn("column", every(columns))
    v = given.withColumn("column", own("ord", columns)).withColumn("row", every(rows))

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, ords = left.column("query_id").to_numpy(), right.column("ord").to_numpy()
        out = ([np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)])
        if len(ids) and len(ords):
            a, b = matrix(left.column("v")), matrix(right.column("v"))
            for at in range(0, len(a), max(1, PAIRS // len(b))):
                part = slice(at, at + max(1, PAIRS // len(b)))
                d = np.round(np.maximum(0.0, 1 - a[part] @ b.T), 6)
                top = np.lexsort((np.broadcast_to(ords, d.shape), d), axis=1)[:, :k]
                for x, y in zip(out, (np.repeat(ids[part], top.shape[1]), ords[top].ravel(), np.take_along_axis(d, top, 1).ravel()), strict=True):
                    x.append(y)
        return pa.table(dict(zip(("query_id", "ord", "distance"), map(np.concatenate, out), strict=True)))

    return q.groupBy("row", "column").cogroup(v.groupBy("row", "column")).applyInArrow(cell, "query_id long, ord long, distance double")


def _unit(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=-1, keepdims=True)
    return m / np.where(n > 0, n, 1)


def _block(block: list, vectors: DataFrame, k: int) -> DataFrame:
    ids = np.array([i for i, _ in block], np.int64)
    sent = vectors.sparkSession.sparkContext.broadcast((ids, _unit(np.array([v for _, v in block], np.float64)) if block else None))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = sent.value
        if q is None:
            return
        best_d, best_o = np.zeros((len(ids), 0)), np.zeros((len(ids), 0), np.int64)
        for b in batches:
            for part in (b.slice(i, rows) for rows in [max(k, PAIRS // len(q))] for i in range(0, b.num_rows, rows)):
                ords = np.array(part.column("ord"))
                d = np.round(np.maximum(0.0, 1 - q @ matrix(part.column("v")).T), 6)
                d, o = np.hstack([best_d, d]), np.hstack([best_o, np.broadcast_to(ords, d.shape)])
                best = np.lexsort((o, d), axis=1)[:, :k]
                best_d, best_o = np.take_along_axis(d, best, 1), np.take_along_axis(o, best, 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, best_d.shape[1])), pa.array(best_o.ravel()), pa.array(best_d.ravel())], names=["query_id", "ord", "distance"])

    return vectors.select(F.col("ord").cast("long").alias("ord"), "v").where("v is not null").mapInArrow(run, "query_id long, ord long, distance double")


class Cells:
    """Cells around centres fitted to a sample, and the share of all vectors that a query has to probe.

    The share is the least one in steps of a twentieth that finds ``recall`` of the k nearest of up to
    TRIED sampled vectors (themselves not counted) within the sample; 1, which is exact, where none does.
    """

    def __init__(self, sample: np.ndarray, k: int, recall: float, seed: int) -> None:
        u, rng = _unit(sample), np.random.RandomState(seed)
        m = int(np.clip(np.sqrt(len(u)), 1, MAX_CELLS))
        self.centres = u[rng.permutation(len(u))[:m]]
        for _ in range(8):
            cell = self.of(u)
            size = np.bincount(cell, minlength=m)
            total = np.zeros_like(self.centres)
            np.add.at(total, cell, u)
            self.centres = np.where(size[:, None] > 0, _unit(total), self.centres)
        self.share = self._least_share(u, k, recall, rng.permutation(len(u))[:TRIED])

    def of(self, u: np.ndarray) -> np.ndarray:
        return (u @ self.centres.T).argmax(1)

    def probes(self, q: np.ndarray, size: np.ndarray, share: float, least: int) -> np.ndarray:
        """Which cells each query looks into: the nearest that hold ``share`` of all and ``least`` vectors together."""
        order = np.argsort(-(q @ self.centres.T), axis=1, kind="stable")
        before = np.cumsum(size[order], axis=1) - size[order]
        out = np.zeros(order.shape, bool)
        np.put_along_axis(out, order, before < max(least, share * size.sum()), 1)
        out[~q.any(1)] = True  # all are equally far from a vector of zeros
        return out

    def _least_share(self, u: np.ndarray, k: int, recall: float, tried: np.ndarray) -> float:
        d = 1 - u[tried] @ u.T
        d[np.arange(len(tried)), tried] = np.inf
        near = np.argsort(d, axis=1, kind="stable")[:, : min(k, len(u) - 1)]
        cell = self.of(u)
        size = np.bincount(cell, minlength=len(self.centres))
        for share in np.arange(1, 20) / 20 if near.size else ():
            if np.take_along_axis(self.probes(u[tried], size, share, k), cell[near], 1).mean() >= recall:
                return float(share)
        return 1.0


def nearest_in_cells(queries: DataFrame, vectors: DataFrame, k: int, recall: float = RECALL, seed: int = 5) -> DataFrame:
    """query_id, ord, distance, rank: neighbours from the cells nearest to each query, with exact distances.

    The cells a query probes hold k vectors at least, so it gets k rows wherever ``nearest`` does.
    Vectors do not move: each task compares those of a cell with the queries that probe it.
    """
    given = vectors.select(F.col("ord").cast("long").alias("ord"), "v").where("v is not null")
    # bounded: about SAMPLED vectors, by a hash of their place
    rate = min(1.0, SAMPLED / max(1, given.count()))
    draw = F.shiftrightunsigned(F.xxhash64(F.lit("cells"), "ord"), 12).cast("double") / float(1 << 52)
    sample = sorted(map(tuple, given.where(draw < rate).collect()))
    if not sample:
        return nearest(queries, vectors, k)
    cells = Cells(np.array([v for _, v in sample], np.float64), k, recall, seed)
    spark = vectors.sparkSession
    centres = spark.sparkContext.broadcast(cells)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = np.zeros(len(centres.value.centres), np.int64)
        for b in batches:
            if b.num_rows:
                size += np.bincount(centres.value.of(matrix(b.column("v"))), minlength=len(size))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(size))), pa.array(size)], names=["cell", "n"])

    size = np.zeros(len(cells.centres), np.int64)
    # at most MAX_CELLS rows
    for r in given.select("v").mapInArrow(counted, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        size[r.cell] = r.n

    def asked(block: list) -> DataFrame:
        q = _unit(np.array([v for _, v in block], np.float64))
        sent = spark.sparkContext.broadcast((np.array([i for i, _ in block], np.int64), q, cells.probes(q, size, cells.share, k)))
        return given.mapInArrow(lambda batches: _probed(batches, centres.value, *sent.value, k), "query_id long, ord long, distance double")

    some = [(r.query_id, r.v) for r in queries.select("query_id", "v").where("v is not null").limit(QUERY_BLOCK + 1).collect()]
    if not some or len(some) > QUERY_BLOCK:  # many queries: the exact grid, or an index written by cells
        return nearest(queries, vectors, k)
    return best(asked(some), k)


def _probed(batches: Iterator[pa.RecordBatch], cells: Cells, ids: np.ndarray, q: np.ndarray, mask: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    """The k best of each query among a task's vectors in the cells it probes."""
    best_d, best_o = np.full((len(q), k), np.inf), np.full((len(q), k), -1, np.int64)
    rows = max(k, PAIRS // len(q))
    for b in batches:
        for part in (b.slice(i, rows) for i in range(0, b.num_rows, rows)):
            ords, u = np.array(part.column("ord")), matrix(part.column("v"))
            cell = cells.of(u)
            d = np.full((len(q), len(u)), np.inf)
            for c in np.unique(cell):
                who, at = np.flatnonzero(mask[:, c]), np.flatnonzero(cell == c)
                d[np.ix_(who, at)] = np.round(np.maximum(0.0, 1 - q[who] @ u[at].T), 6)
            all_d, all_o = np.hstack([best_d, d]), np.hstack([best_o, np.broadcast_to(ords, d.shape)])
            best = np.lexsort((all_o, all_d), axis=1)[:, :k]
            best_d, best_o = np.take_along_axis(all_d, best, 1), np.take_along_axis(all_o, best, 1)
    got = np.isfinite(best_d)
    yield pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(ids[:, None], got.shape)[got]), pa.array(best_o[got]), pa.array(best_d[got])], names=["query_id", "ord", "distance"])


def indexed(chunks: DataFrame, stored: DataFrame | None, embedder: Callable[[pd.Series], pd.Series] = hashed_embedding, batch: int = EMBED_BATCH, force: bool = False) -> DataFrame:
    """Vectors (id, v) of chunks (id, text): those stored stay unless force is set, the others are embedded."""
    new = chunks if stored is None or force else missing(chunks, stored)
    made = embed(new.select("id", "text"), embedder, batch=batch).select("id", "v")
    return made if stored is None else upserted(stored.select("id", "v"), made)


def missing(chunks: DataFrame, stored: DataFrame) -> DataFrame:
    """Chunks whose id has no vector yet."""
    return chunks.join(stored.select("id"), "id", "left_anti")


def upserted(stored: DataFrame, new: DataFrame) -> DataFrame:
    """new rows, and stored rows under other ids."""
    return stored.join(new.select("id"), "id", "left_anti").unionByName(new)
