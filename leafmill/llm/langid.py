"""Operator 8: language by the nearest of several centroids.

A text becomes a vector of hashed byte 2- and 3-grams, log-scaled counts times inverse document
frequency, of length one.  Document frequencies cover all rows that may be learnt from.  Centroids
come from spherical k-means within each language, on a sample of bounded size whose rows are chosen
by a hash of the id.  A text takes the language of its nearest centroid by cosine; a text that is
farther from it than nearly all learnt rows is marked as rejected.

Any number of languages is taken: centroids are a written table, which goes to the tasks in blocks of BLOCK, and a
text's best so far is carried from block to block.

Defined cases: ``und`` with score 0 for a null text or one without a letter, and for every text
where no language could be learnt; a text of any length is treated whole; of equally near centroids the first by
language wins; a row with a null id is learnt from and predicted like others; repeated rows count in the frequencies,
are learnt from once and each predicted; an empty table gives no rows; further columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BROADCAST_KEYS, bounded_batches, fold, looked_up, map_arrow, row_key, table, written

BUCKETS, CENTROIDS, ROUNDS = 4096, 3, 8
#: Labelled rows a language is learnt from at most; and the share of them that counts as too far.
SAMPLE, TOO_FAR = 600, 0.005
#: A sampled text's vector is made of the whole text; the vectors of one language are SAMPLE * BUCKETS * 4 bytes.
UNKNOWN = "und"
#: Rows drawn for each that is learnt from, and centroids in one block (16 KB each).
DRAWN, BLOCK = 1.5, 1536


def grams(text: str) -> np.ndarray:
    """log(1 + count) of hashed byte 2- and 3-grams of the lower-cased text between blanks."""
    raw = np.frombuffer(b" " + " ".join(text.lower().split()).encode("utf-8", "surrogatepass") + b" ", np.uint8).astype(np.uint32)
    two = raw[:-1] << 8 | raw[1:]
    mixed = [two * np.uint32(0x9E3779B1)]
    if len(raw) > 2:
        mixed.append((two[:-1] << 8 | raw[2:]) * np.uint32(0x85EBCA6B))
    return np.log1p(np.bincount(np.concatenate(mixed) >> np.uint32(20), minlength=BUCKETS)).astype(np.float32)


def weighted(text: str, idf: np.ndarray) -> np.ndarray:
    v = grams(text) * idf
    n = float(np.sqrt(v @ v))
    return v / n if n else v


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def learnable(docs: DataFrame, held_out: Column) -> DataFrame:
    return docs.where(~held_out & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")


def frequencies(rows: DataFrame) -> tuple[int, np.ndarray]:
    """Rows, and the rows that have each bucket: one partial sum a task, of fixed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS + 1, np.int64)
        for batch in batches:
            for t in batch.column("text").to_pylist():
                total[:-1] += grams(t) > 0
            total[-1] += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BUCKETS + 1)), pa.array(total)], names=["bucket", "n"])

    bounded_batches(rows.sparkSession)
    sums = rows.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(BUCKETS + 1, np.int64)
    for r in sums:
        out[r.bucket] = r.n
    return int(out[-1]), out[:-1]


def cluster(vectors: np.ndarray, k: int) -> tuple[np.ndarray, float]:
    """Spherical k-means from the farthest points on; and the cosine that nearly all rows reach."""
    centres = [vectors.mean(0)]
    for _ in range(min(k, len(vectors)) - 1):
        centres.append(vectors[int(np.argmin(np.max(vectors @ np.array(centres).T, 1)))])
    c = np.array(centres, np.float32)
    for _ in range(ROUNDS):
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
        near = np.argmax(vectors @ c.T, 1)
        c = np.array([vectors[near == i].mean(0) if (near == i).any() else c[i] for i in range(len(c))], np.float32)
    c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
    return c, float(np.quantile((vectors @ c.T).max(1), TOO_FAR))


class Centroids:
    """A block of the model: one row a centroid, its language and that language's cosine for rejection."""

    def __init__(self, idf: np.ndarray, rows: list[tuple[str, np.ndarray, float]]) -> None:
        self.idf, self.langs = idf, [lang for lang, _, _ in rows]
        self.least = np.array([least for _, _, least in rows])
        self.matrix = np.array([c for _, c, _ in rows], np.float32).reshape(len(rows), len(idf))

    def nearest(self, text: str | None) -> tuple[str, float, float] | None:
        """Language, cosine and its cosine for rejection."""
        if not has_letter(text):
            return None
        near = self.matrix @ weighted(text, self.idf)
        best = int(np.argmax(near))
        return self.langs[best], float(near[best]), float(self.least[best])


class Model:
    """Document frequencies as weights, and the table of centroids: lang, least, centre."""

    def __init__(self, idf: np.ndarray, table: DataFrame) -> None:
        self.idf, self.table = idf, table

    def blocks(self) -> Iterator[Centroids]:
        rows: list[tuple[str, np.ndarray, float]] = []
        for r in self.table.orderBy("lang", "centre").toLocalIterator():
            rows.append((r.lang, np.frombuffer(r.centre, "<f4"), r.least))
            if len(rows) == BLOCK:
                yield Centroids(self.idf, rows)
                rows = []
        if rows:
            yield Centroids(self.idf, rows)


def sampled(rows: DataFrame, sample: int) -> DataFrame:
    """lang, text: the ``sample`` rows of each language with the least hashes, or all it has; repeated rows are one.

    About half as many again are drawn by their hash against the language's count, and the least of them are kept, so
    no language is gathered to find them, none is left out, and none brings more than ``sample`` texts.
    """
    keys = rows.select("lang", "doc_id", "text").select("lang", row_key().alias("key")).distinct()
    keys = written(keys.withColumn("draw", F.pmod(F.xxhash64(F.lit("sample"), "key"), F.lit(1 << 30))), "languages")
    counts = keys.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).withColumn("rows", F.col("n"))
    drawn = looked_up(keys, counts, "lang", "rows", "key", keys.count()).where(F.col("draw") / float(1 << 30) * F.col("rows") < sample * DRAWN)
    least = Window.partitionBy("lang").orderBy("draw", "key")
    kept = written(drawn.withColumn("place", F.row_number().over(least)).where(F.col("place") <= sample).select("lang", "key"), "languages-drawn")
    few = kept.count() <= BROADCAST_KEYS
    texts = rows.select("lang", "text", row_key().alias("key")).join(F.broadcast(kept) if few else kept, ["lang", "key"])
    return texts.dropDuplicates(["lang", "key"]).select("lang", "text")


def learn(rows: DataFrame, k: int = CENTROIDS, sample: int = SAMPLE) -> Model:
    """Centroids from labelled rows (doc_id, text, lang)."""
    n, df = frequencies(rows)
    idf = np.log((1 + n) / (1 + df)).astype(np.float32) + np.float32(0.1)

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        texts = [t for t in pdf["text"] if has_letter(t)]
        if not texts:
            return pd.DataFrame({"lang": pd.Series([], dtype=object), "least": pd.Series([], dtype=float), "centre": pd.Series([], dtype=object)})
        centres, least = cluster(np.array([weighted(t, idf) for t in sorted(texts)]), k)
        return pd.DataFrame({"lang": key[0], "least": least, "centre": [c.astype("<f4").tobytes() for c in centres]})

    return Model(idf, written(sampled(rows, sample).groupBy("lang").applyInPandas(one, "lang string, least double, centre binary"), "centroids"))


def predict(docs: DataFrame, model: Model, reject: bool = True) -> DataFrame:
    """doc_id, lang_pred, score, rejected; with reject, a text that is too far becomes ``und``."""
    kind = dict(docs.dtypes)["doc_id"].replace("bigint", "long")
    out = docs.select("doc_id", "text", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("near"), F.lit(None).cast("double").alias("least"))
    for block in model.blocks():
        sent = docs.sparkSession.sparkContext.broadcast(block)

        def one(batch: pa.RecordBatch, sent=sent) -> dict:
            had = zip(*(batch.column(c).to_pylist() for c in ("lang", "near", "least")), strict=True)
            best = []
            for text, old in zip(batch.column("text").to_pylist(), had, strict=True):
                new = sent.value.nearest(text)
                best.append(new if new and (old[1] is None or new[1] > old[1]) else old)
            return {"doc_id": batch.column("doc_id"), "text": batch.column("text")} | {c: [b[i] for b in best] for i, c in enumerate(("lang", "near", "least"))}

        out = map_arrow(out, one, f"doc_id {kind}, text string, lang string, near double, least double")
    near, none = F.col("near"), F.col("lang").isNull()
    far = F.coalesce(near < F.col("least"), F.lit(True))
    named = F.when(none | far, UNKNOWN).otherwise(F.col("lang")) if reject else F.coalesce("lang", F.lit(UNKNOWN))
    return out.select("doc_id", named.alias("lang_pred"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(near, F.lit(0.0)))).alias("score"), far.alias("rejected"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn(learnable(docs, fold("doc_id", 3) == 1))
    out = predict(docs, model, reject=False)
    return out.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score", "rejected")
