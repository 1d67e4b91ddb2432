"""A stored index of vectors: cells as folders of files, codes of eight bytes, exact distances for the best.

Vectors are written by the cell they lie in, once as codes and once whole.  A search reads the codes of the cells near its
queries, and no other folders; a code stands for the nearest of 256 centres in each of PARTS parts of a vector, so a
distance is PARTS additions from a table of the query.  The ``depth`` best by code are then read whole and measured exactly.

Centres are fitted to about SAMPLED vectors; all vectors are written.  The share of cells to probe and the depth are
the least that reach the recall on sampled queries.  Where codes cannot reach it the depth covers all that is probed.

Defined cases: a vector of zeros is as far from all; null vectors are neither stored nor asked; equal distances are ordered by
ord; an index of no vectors finds nothing; a cell of many vectors is dealt to several tasks.
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .vectors import RECALL, SAMPLED, TRIED, Cells, best, matrix

#: Parts of a vector, a byte each, and rounds of fitting.
PARTS, ROUNDS = 8, 8
#: Vectors of a cell that one task compares, and queries that are asked at once.
CELL_ROWS, ASKED = 65_536, 4096


class Codes:
    """Centres of each part of vectors of length one."""

    def __init__(self, u: np.ndarray, seed: int = 3) -> None:
        rng = np.random.RandomState(seed)
        self.cuts = [x for x in np.array_split(np.arange(u.shape[1]), PARTS) if len(x)]
        self.centres = []
        for cut in self.cuts:
            part = u[:, cut]
            c = part[rng.permutation(len(part))[:256]]
            for _ in range(ROUNDS):
                near = self._near(part, c)
                size = np.bincount(near, minlength=len(c))
                total = np.zeros_like(c)
                np.add.at(total, near, part)
                c = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], c)
            self.centres.append(c)

    @staticmethod
    def _near(part: np.ndarray, c: np.ndarray) -> np.ndarray:
        return ((c * c).sum(1) - 2 * part @ c.T).argmin(1)

    def of(self, u: np.ndarray) -> np.ndarray:
        return np.stack([self._near(u[:, cut], c) for cut, c in zip(self.cuts, self.centres, strict=True)], 1).astype(np.uint8)

    def products(self, q: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """About the products of queries and coded vectors."""
        out = np.zeros((len(q), len(codes)))
        for i, (cut, c) in enumerate(zip(self.cuts, self.centres, strict=True)):
            out += (q[:, cut] @ c.T)[:, codes[:, i]]
        return out


def _least_depth(u: np.ndarray, cells: Cells, codes: Codes, k: int, recall: float, seed: int) -> int:
    """Vectors by code, of a probed set, that hold the nearest of sampled queries; 0 where even many do not."""
    tried = np.random.RandomState(seed).permutation(len(u))[:TRIED]
    size = np.bincount(cells.of(u), minlength=len(cells.centres))
    open_ = cells.probes(u[tried], size, cells.share, k)[:, cells.of(u)]
    open_[np.arange(len(tried)), tried] = False
    exact = np.where(open_, u[tried] @ u.T, -np.inf)
    near = np.argsort(-exact, axis=1, kind="stable")[:, : min(k, len(u) - 1)]
    order = np.argsort(-np.where(open_, codes.products(u[tried], codes.of(u)), -np.inf), axis=1, kind="stable")
    place = np.argsort(order, axis=1)
    depth = 2 * k
    while depth < len(u):
        if near.size and (np.take_along_axis(place, near, 1) < depth).mean() >= recall:
            return depth
        depth *= 2
    return 0


def build(vectors: DataFrame, path: str, k: int, recall: float = RECALL, seed: int = 5) -> None:
    """Write the index of vectors (ord, v) for searches of k."""
    spark = vectors.sparkSession
    given = vectors.select(F.col("ord").cast("long").alias("ord"), "v").where("v is not null")
    rate = min(1.0, SAMPLED / max(1, given.count()))
    draw = F.shiftrightunsigned(F.xxhash64(F.lit("cells"), "ord"), 12).cast("double") / float(1 << 52)
    rows = sorted(map(tuple, given.where(draw < rate).collect()))  # bounded by SAMPLED, about
    if not rows:
        given.write.parquet(f"{path}/codes")
        return
    sample = np.array([v for _, v in rows], np.float64)
    sample /= np.maximum(np.linalg.norm(sample, axis=1, keepdims=True), 1e-300)
    # both parts may lose some
    cells = Cells(sample, k, recall + (1 - recall) / 2, seed)
    codes = Codes(sample)
    depth = _least_depth(sample, cells, codes, k, recall + (1 - recall) / 2, seed)
    sent = spark.sparkContext.broadcast((cells, codes))

    def placed(batches):
        for b in batches:
            if b.num_rows:
                u = matrix(b.column("v"))
                code = [x.tobytes() for x in sent.value[1].of(u)]
                yield pa.RecordBatch.from_arrays([b.column("ord"), b.column("v"), pa.array(code, pa.binary()), pa.array(sent.value[0].of(u), pa.int32())], names=["ord", "v", "code", "cell"])

    kind = dict(given.dtypes)["v"]
    every = given.mapInArrow(placed, f"ord long, v {kind}, code binary, cell int")
    spread = F.floor(F.pmod(F.xxhash64("ord"), F.lit(max(1, given.count() // CELL_ROWS)))).cast("int")
    every.repartition("cell", spread).sortWithinPartitions("cell", "ord").write.partitionBy("cell").parquet(f"{path}/vectors")
    stored = spark.read.parquet(f"{path}/vectors")
    stored.select("cell", "ord", "code").repartition("cell", spread).write.partitionBy("cell").parquet(f"{path}/codes")
    out = io.BytesIO()
    np.savez(out, centres=cells.centres, share=cells.share, depth=depth, k=k, **{f"part{i}": c for i, c in enumerate(codes.centres)})
    spark.createDataFrame([(bytearray(out.getvalue()),)], "model binary").coalesce(1).write.parquet(f"{path}/model")


class CellIndex:
    """A written index."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        self.codes = spark.read.parquet(f"{path}/codes")
        self.sizes: dict[int, int] = {}
        if "v" in self.codes.columns:
            return  # an index of nothing
        with np.load(io.BytesIO(bytes(spark.read.parquet(f"{path}/model").first().model))) as m:
            self.cells, self.coder = Cells.__new__(Cells), Codes.__new__(Codes)
            self.cells.centres, self.cells.share = m["centres"], float(m["share"])
            self.coder.centres = [m[f"part{i}"] for i in range(len([x for x in m.files if x.startswith("part")]))]
            self.depth, self.k = int(m["depth"]), int(m["k"])
        at = np.cumsum([0, *(c.shape[1] for c in self.coder.centres)])
        self.coder.cuts = [np.arange(a, b) for a, b in zip(at, at[1:], strict=False)]
        # at most a row for each cell
        self.sizes = {r.cell: r["count"] for r in self.codes.groupBy("cell").count().collect()}

    def probed(self, queries: DataFrame) -> DataFrame:
        """query_id, v, cell: the cells that each query looks into."""
        size = np.zeros(len(self.cells.centres), np.int64)
        for cell, n in self.sizes.items():
            size[cell] = n
        sent = self.spark.sparkContext.broadcast((self.cells, size, self.k))

        def run(batches):
            cells, size, k = sent.value
            for b in batches:
                if b.num_rows:
                    rows, cell = np.nonzero(cells.probes(matrix(b.column("v")), size, cells.share, k) & (size > 0))
                    yield pa.RecordBatch.from_arrays([b.column("query_id").take(pa.array(rows)), b.column("v").take(pa.array(rows)), pa.array(cell, pa.int32())], names=["query_id", "v", "cell"])

        asked = queries.select(F.col("query_id").cast("long").alias("query_id"), "v").where("v is not null")
        return asked.mapInArrow(run, f"query_id long, v {dict(asked.dtypes)['v']}, cell int")

    def folders(self, queries: DataFrame) -> tuple[int, int]:
        """Folders of cells that a search for the queries reads, and all."""
        return self.probed(queries).select("cell").distinct().count() if self.sizes else 0, len(self.sizes)

    def nearest(self, queries: DataFrame, k: int) -> DataFrame:
        """query_id, ord, distance, rank of the k nearest in the probed cells."""
        if not self.sizes:
            return self.spark.createDataFrame([], "query_id long, ord long, distance double, rank int")
        asked = self.probed(queries)
        some = sorted(r.cell for r in asked.select("cell").distinct().collect())  # at most all cells
        depth = max(self.depth, 2 * k) if self.depth else max(self.sizes.values())
        parts = lambda: F.broadcast(self.spark.createDataFrame([(c, max(1, self.sizes[c] // CELL_ROWS)) for c in some], "cell int, parts int"))
        n_blocks = max(1, -(-queries.count() // ASKED))
        left = asked.join(parts(), "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)).cast("int"))
        right = self.codes.where(F.col("cell").isin(some)).join(parts(), "cell").withColumn("part", F.pmod(F.xxhash64("ord"), F.col("parts")).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
        sent = self.spark.sparkContext.broadcast(self.coder)

        def compared(q: pa.Table, c: pa.Table) -> pa.Table:
            ids, ords = q.column("query_id").to_numpy(), c.column("ord").to_numpy()
            out = ([np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)])
            if len(ids) and len(ords):
                u, codes = matrix(q.column("v")), np.frombuffer(b"".join(c.column("code").to_pylist()), np.uint8).reshape(len(ords), -1)
                for at in range(0, len(u), 256):
                    near = sent.value.products(u[at : at + 256], codes)
                    top = np.argsort(-near, axis=1, kind="stable")[:, :depth]
                    for x, y in zip(out, (np.repeat(ids[at : at + 256], top.shape[1]), ords[top].ravel(), -np.take_along_axis(near, top, 1).ravel()), strict=True):
                        x.append(y)
            cell = c.column("cell")[0].as_py() if len(ords) else 0
            columns = list(map(np.concatenate, out))
            return pa.table({"query_id": columns[0], "cell": pa.array(np.full(len(columns[0]), cell), pa.int32()), "ord": columns[1], "distance": columns[2]})

        keys = ("cell", "part", "block")
        found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(compared, "query_id long, cell int, ord long, distance double")
        some_best = best(found, depth).select("query_id", "cell", "ord")
        whole = self.spark.read.parquet(f"{self.path}/vectors").where(F.col("cell").isin(some)).select("cell", "ord", F.col("v").alias("w"))
        met = some_best.join(whole, ["cell", "ord"]).join(queries.select(F.col("query_id").cast("long").alias("query_id"), "v"), "query_id")

        def measured(batches):
            for b in batches:
                if b.num_rows:
                    d = np.round(np.maximum(0.0, 1 - (matrix(b.column("v")) * matrix(b.column("w"))).sum(1)), 6)
                    yield pa.RecordBatch.from_arrays([b.column("query_id"), b.column("ord"), pa.array(d)], names=["query_id", "ord", "distance"])

        return best(met.select("query_id", "ord", "v", "w").mapInArrow(measured, "query_id long, ord long, distance double"), k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """queries, wanted, share: of the neighbours in ``exact``, how many were found."""
    hit = exact.join(found.select("query_id", "ord", F.lit(1).alias("hit")), ["query_id", "ord"], "left")
    return hit.agg(F.countDistinct("query_id").alias("queries"), F.count(F.lit(1)).alias("wanted"), F.avg(F.coalesce("hit", F.lit(0))).alias("share"))
