"""BM25 by blocks of postings: a row holds what a term has in a range of WIDTH places of the corpus.

A term that most chunks have is a row for each range and not one for each chunk, and it is read once for CHUNK
questions: rows (questions that ask for the term, block) come together by range, where one array of scores a question
is filled and its k best are kept.  Nothing grows with questions times postings but the additions in these arrays.

Beyond FEW ranges the search has two phases.  The rare terms alone give each question k documents, whose k-th score
no better document falls below; a range whose bounds do not add up to that score is passed over for the question.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import BM25_B, BM25_K1
from ..functions.text import tokens

#: Places of the corpus in a range, questions scored at once, ranges that are searched in one phase, and a rare term's documents.
WIDTH, CHUNK, FEW, RARE = 1024, 256, 16, 256
#: Terms of all questions that are looked for by name in the files, at most.
NAMED = 2000
#: Tokens whose blocks a task makes at once, but for a longer text.
TOGETHER = 1 << 20
#: Below this two scores count as equal: they are rounded to six digits.
NEAR = 1e-5


def impact(tf: Column | np.ndarray, dl: Column | np.ndarray, mean: float) -> Column | np.ndarray:
    """A term's weight in a document before its idf."""
    return tf * (BM25_K1 + 1) / (tf + BM25_K1 * (1 - BM25_B + BM25_B * dl / mean))


def packed(posts: DataFrame, width: int = WIDTH) -> DataFrame:
    """term, range, top_tf, low_dl, ords (places in the range), tfs, dls of postings (term, ord, tf, dl)."""
    at = F.floor(F.col("ord") / width).cast("long").alias("range")
    each = posts.groupBy("term", at).agg(F.sort_array(F.collect_list(F.struct((F.col("ord") - F.floor(F.col("ord") / width) * width).cast("int").alias("o"), F.col("tf").cast("int").alias("tf"), F.col("dl").cast("int").alias("dl")))).alias("p"), F.max("tf").alias("top_tf"), F.min("dl").alias("low_dl"))
    return each.select("term", "range", "top_tf", "low_dl", F.col("p.o").alias("ords"), F.col("p.tf").alias("tfs"), F.col("p.dl").alias("dls"))


def _parts(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Texts (ord, t: tokens) as parts of blocks: term, range, ords, tfs, dls of what a few texts have of a term."""

    def part(ord_: np.ndarray, words: pa.ListArray) -> pa.RecordBatch:
        sizes = np.diff(words.offsets.to_numpy())
        each = pa.table({"term": words.flatten(), "i": np.repeat(np.arange(len(ord_)), sizes)}).group_by(["term", "i"]).aggregate([([], "count_all")]).combine_chunks()
        terms = each.column("term").combine_chunks().dictionary_encode()
        terms = terms.combine_chunks() if isinstance(terms, pa.ChunkedArray) else terms
        code, i = terms.indices.to_numpy(zero_copy_only=False), each.column("i").to_numpy()
        at = ord_[i] // width
        order = np.lexsort((ord_[i], at, code))
        code, i, at, tf = code[order], i[order], at[order], each.column("count_all").to_numpy()[order]
        first = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (at[1:] != at[:-1])][: len(code)])
        edge = pa.array(np.r_[first, len(code)].astype(np.int32))
        lists = [pa.ListArray.from_arrays(edge, pa.array(x.astype(np.int32))) for x in (ord_[i] - at * width, tf, sizes[i])]
        return pa.RecordBatch.from_arrays([terms.dictionary.take(pa.array(code[first])).cast(pa.string()), pa.array(at[first].astype(np.int64)), *lists], names=["term", "range", "ords", "tfs", "dls"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ord_, words = b.column("ord").to_numpy(zero_copy_only=False), b.column("t")
            ends, at = np.cumsum(np.diff(words.offsets.to_numpy())), 0
            while at < len(ord_):
                end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + TOGETHER, "right")))
                yield part(ord_[at:end], words.slice(at, end - at))
                at = end

    return run


def of_texts(corpus: DataFrame, width: int = WIDTH) -> DataFrame:
    """Blocks of a corpus (ord, text), as ``packed`` makes them of its postings, but no posting is a row: tasks send parts of blocks."""
    texts = corpus.select(F.col("ord").cast("long").alias("ord"), tokens(F.col("text")).alias("t"))
    parts = texts.mapInArrow(_parts(width), "term string, range long, ords array<int>, tfs array<int>, dls array<int>")
    # dealt before they are grouped: parts of a task hardly ever meet there, and sorting them for it would spill
    each = parts.repartition("term", "range").groupBy("term", "range").agg(F.sort_array(F.flatten(F.collect_list(F.arrays_zip(F.col("ords").alias("o"), F.col("tfs").alias("tf"), F.col("dls").alias("dl"))))).alias("p"))
    # texts of one place and length count as one, as in ``postings``
    one = "transform(array_distinct(transform(p, x -> struct(x.o, x.dl))), y -> named_struct('o', y.o, 'tf', aggregate(filter(p, x -> x.o = y.o AND x.dl = y.dl), 0, (n, x) -> n + x.tf), 'dl', y.dl))"
    each = each.withColumn("p", F.expr(f"CASE WHEN size(array_distinct(p.o)) = size(p) THEN p ELSE {one} END"))
    return each.select("term", "range", F.array_max("p.tf").cast("long").alias("top_tf"), F.array_min("p.dl").cast("long").alias("low_dl"), F.col("p.o").alias("ords"), F.col("p.tf").alias("tfs"), F.col("p.dl").alias("dls"))


def asked_terms(questions: DataFrame) -> DataFrame:
    """query_id, term, times."""
    return questions.select("query_id", F.explode(tokens(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("times"))


def _scored(k: int, mean: float, width: int, first: list[int]) -> Callable[[pa.Table], pa.Table]:
    def run(t: pa.Table) -> pa.Table:
        at = t.column("range")[0].as_py()
        who, w, floor = (t.column(c).combine_chunks() for c in ("who", "w", "floor"))
        ids, place = np.unique(who.values.to_numpy(), return_inverse=True)
        least = np.full(len(ids), -np.inf)
        least[place] = floor.values.to_numpy()
        edge, weight = who.offsets.to_numpy(), w.values.to_numpy()
        bound = np.zeros(len(ids))
        row = np.repeat(np.arange(t.num_rows), np.diff(edge))
        tops = impact(t.column("top_tf").to_numpy().astype(float), t.column("low_dl").to_numpy().astype(float), mean)
        np.add.at(bound, place, np.maximum(weight * tops[row], 0))
        able = bound >= least - NEAR
        scores, hit = np.zeros((len(ids), width)), np.zeros((len(ids), width), bool)
        ords, tfs, dls = (t.column(c).combine_chunks() for c in ("ords", "tfs", "dls"))
        cut, o, f, d = ords.offsets.to_numpy(), ords.values.to_numpy(), tfs.values.to_numpy(), dls.values.to_numpy()
        values = impact(f.astype(float), d, mean)
        for i in range(t.num_rows):
            q, x = place[edge[i] : edge[i + 1]], weight[edge[i] : edge[i + 1]]
            q, x = q[able[q]], x[able[q]]
            if len(q):
                cells = np.ix_(q, o[cut[i] : cut[i + 1]])
                scores[cells] += x[:, None] * values[None, cut[i] : cut[i + 1]]
                hit[cells] = True
        scores = np.round(scores, 6)
        kept = np.array([x - at * width for x in first if 0 <= x - at * width < width], np.int64)
        out_q, out_o, out_s = [], [], []
        for i in range(len(ids)):
            have = np.flatnonzero(hit[i])
            have = have[np.lexsort((have, -scores[i, have]))]
            good = have[:k][scores[i, have[:k]] >= least[i] - NEAR]
            good = np.union1d(good, kept[hit[i, kept]]) if len(kept) else good
            out_q.append(np.full(len(good), ids[i]))
            out_o.append(good + at * width)
            out_s.append(scores[i, good])
        columns = [np.concatenate(x) if x else np.zeros(0, kind) for x, kind in ((out_q, np.int64), (out_o, np.int64), (out_s, float))]
        return pa.table({"query_id": pa.array(columns[0], pa.int64()), "ord": pa.array(columns[1], pa.int64()), "score": pa.array(columns[2], pa.float64())})

    return run


def _met(asked: DataFrame, blocks: DataFrame, chunks: int, few: bool = False) -> DataFrame:
    """A row for each block of a term and each CHUNK of questions that have it: who asks, with which weight.

    few: the questions are as few as ``named`` takes, so that they go to the blocks and these do not move.
    """
    by = F.pmod(F.xxhash64("query_id"), F.lit(chunks)).cast("int").alias("chunk")
    lists = asked.groupBy("term", by).agg(F.collect_list(F.struct("query_id", "w", "floor")).alias("x"))
    lists = lists.select("term", "chunk", F.col("x.query_id").alias("who"), F.col("x.w").alias("w"), F.col("x.floor").alias("floor"))
    return (F.broadcast(lists) if few else lists).join(blocks, "term").drop("term")


def scores(questions: DataFrame, blocks: DataFrame, vocab: DataFrame, n: int, n_tokens: int, k: int, first: list[int] | None = None, width: int = WIDTH, few: int = FEW, rare: int = RARE, n_questions: int | None = None, weights: DataFrame | None = None) -> DataFrame:
    """query_id, ord, score: the k best of every question and range of places that share a term with it.

    Documents whose places are in first are in the result wherever they share a term.  weights: what ``named`` has found.
    """
    mean = n_tokens / n if n else 1.0
    asked = weights
    if asked is None:
        asked = asked_terms(questions.select(F.col("query_id").cast("long").alias("query_id"), "text")).join(vocab, "term")
        asked = asked.select("query_id", "term", "df", (F.col("times") * F.col("idf")).alias("w"))
    chunks = max(1, -(-(questions.count() if n_questions is None else n_questions) // CHUNK))
    none, together = F.lit(float("-inf")), weights is not None
    schema, kernel = "query_id long, ord long, score double", _scored(k, mean, width, first or [])
    if n > few * width:
        # the k-th score by rare terms alone, where no term counts against a document
        some = _met(asked.where(F.col("df") <= rare).withColumn("floor", none), blocks, chunks, together)
        found = some.groupBy("chunk", "range").applyInArrow(_scored(k, mean, width, []), schema)
        floors = _ranked(found, k).where(F.col("rank") == k).select("query_id", F.col("score").alias("floor"))
        floors = floors.join(asked.where("w < 0").select("query_id"), "query_id", "left_anti")
        asked = asked.join(floors, "query_id", "left").withColumn("floor", F.coalesce("floor", none))
    else:
        asked = asked.withColumn("floor", none)
    return _met(asked, blocks, chunks, together).groupBy("chunk", "range").applyInArrow(kernel, schema)


def _ranked(scored: DataFrame, k: int) -> DataFrame:
    from .lexical import top_k

    return top_k(scored, k)


def named(blocks: DataFrame, questions: DataFrame, vocab: DataFrame) -> tuple[DataFrame, int, DataFrame | None]:
    """blocks of the questions' terms, the number of questions, and query_id, term, df, w if both are few.

    Few terms are a filter that files sorted by term are pruned with, those of the vocabulary too; what decides it is
    one pass over some questions, as term and times of each.
    """
    times = F.transform(F.array_distinct("t"), lambda x: F.struct(x.alias("term"), F.size(F.filter("t", lambda y: y == x)).alias("times")))
    some = questions.select("query_id", tokens(F.col("text")).alias("t")).select("query_id", times.alias("t")).limit(CHUNK + 1).coalesce(1).collect()
    terms = sorted({x.term for r in some for x in r.t})
    if len(some) <= CHUNK and len(terms) <= NAMED:
        have = {r.term: r for r in vocab.where(F.col("term").isin(terms)).select("term", "df", "idf").collect()}
        asked = Counter()
        for r in some:
            for x in r.t:
                asked[r.query_id, x.term] += x.times
        rows = [(q, t, have[t].df, n * have[t].idf) for (q, t), n in asked.items() if t in have]
        columns = [pa.array(c, kind) for c, kind in zip(zip(*rows) if rows else [()] * 4, (pa.int64(), pa.string(), pa.int64(), pa.float64()), strict=True)]
        weights = questions.sparkSession.createDataFrame(pa.table(dict(zip(("query_id", "term", "df", "w"), columns, strict=True))))
        return blocks.where(F.col("term").isin(terms)), len(some), weights
    asked = questions.select(F.explode(F.array_distinct(tokens(F.col("text")))).alias("term")).distinct()
    return blocks.join(asked, "term", "left_semi"), questions.count(), None


def rows_read(questions: DataFrame, blocks: DataFrame) -> DataFrame:
    """query_id, postings, blocks: what a question's terms have as postings, and in how many rows."""
    met = asked_terms(questions).join(blocks, "term")
    return met.groupBy("query_id").agg(F.sum(F.size("ords")).cast("long").alias("postings"), F.count(F.lit(1)).alias("blocks"))
