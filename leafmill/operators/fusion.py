"""Reciprocal rank fusion of ranked lists, labels of methods, and reranking."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from ..config import RERANK_BATCH, RERANK_KEEP, RRF_K, TOP_N
from ..functions.text import tokens

_FAR = 1_000_000


def fuse(lists: list[DataFrame], k: int = RRF_K, n: int | None = TOP_N) -> DataFrame:
    """query_id, ord, rrf_score, methods, rank from lists of query_id, ord, rank; ties in the order first seen."""
    out = None
    for i, ranked in enumerate(lists):
        part = ranked.select("query_id", "ord", F.col("rank").cast("long").alias("r"), F.lit(i).alias("method"))
        out = part if out is None else out.unionByName(part)
    fused = out.groupBy("query_id", "ord").agg(
        F.round(F.sum(1.0 / (F.col("r") + k)), 10).alias("rrf_score"), F.array_sort(F.collect_set("method")).alias("methods"), F.min(F.col("method") * _FAR + F.col("r")).alias("seen"),
        *[F.max(F.when(F.col("method") == i, F.col("r"))).alias(f"rank_{i}") for i in range(len(lists))])
    fused = fused.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("rrf_score"), "seen"))).drop("seen")
    return fused if n is None else fused.where(F.col("rank") <= n)


def method_label(methods: Column) -> Column:
    has = lambda m: F.array_contains(methods, m)
    return F.when(has(0) & has(1), "both").when(has(0), "bm25").when(has(1), "vector").otherwise("?")


def snippet(text: Column, chars: int = 150) -> Column:
    return F.substring(F.translate(text, "\n", " "), 1, chars)


def compare(lexical: DataFrame, vector: DataFrame, n: int = TOP_N) -> DataFrame:
    """query_id, method, rank, ord: each list alone beside the fused one."""
    of = lambda df, name: df.where(F.col("rank") <= n).select("query_id", F.lit(name).alias("method"), F.col("rank").cast("long").alias("rank"), "ord")
    return of(lexical, "bm25").unionByName(of(vector, "vector")).unionByName(of(fuse([lexical, vector], n=n), "fused"))


def overlap(query: Column, text: Column) -> Column:
    """The share of the question's distinct tokens that the text has."""
    asked = F.array_distinct(tokens(query))
    return F.when(F.size(asked) > 0, F.size(F.array_intersect(asked, tokens(text))) / F.size(asked)).otherwise(0.0)


@F.pandas_udf(ArrayType(IntegerType()))
def _windows(asked: pd.Series, found: pd.Series) -> pd.Series:
    """For each pair of distinct terms and a text's tokens: how many of the terms it has, and the tokens of its smallest part with all of them."""

    def one(terms: np.ndarray, words: np.ndarray) -> list[int]:
        wanted = set(terms)
        places = [(i, w) for i, w in enumerate(words) if w in wanted]
        last: dict[str, int] = {}
        have, least, first = len({w for _, w in places}), len(words) + 1, 0
        for at, (i, w) in enumerate(places):
            last[w] = at
            if len(last) == have:
                # the part begins at the first place that is the last one of its term
                while last[places[first][1]] != first:
                    first += 1
                least = min(least, i - places[first][0] + 1)
        return [have, least if have else 0]

    return pd.Series([one(a, b) for a, b in zip(asked, found, strict=True)])


def proximity(query: Column, text: Column) -> Column:
    """The share of the question's distinct tokens that the text has, less up to a half where they lie far apart.

    Far apart is measured by the smallest part of the text that has all of them: share * (1 + found / tokens in it) / 2.
    """
    asked = F.array_distinct(tokens(query))
    met = _windows(asked, tokens(text))
    return F.when(F.size(asked) > 0, F.coalesce(met[0] / F.size(asked) * (1 + F.try_divide(met[0], met[1])) / 2, F.lit(0.0))).otherwise(0.0)


class Model:
    """A scorer of pairs that is loaded once by each worker process and gets at most ``batch`` pairs at once.

    load returns a function of questions and texts; key names the model among those of a worker.
    """

    def __init__(self, load: Callable[[], Callable[[list[str], list[str]], Sequence[float]]], batch: int = RERANK_BATCH, key: str | None = None) -> None:
        if batch < 1:
            raise ValueError("a batch has a pair at least")
        self.load, self.batch, self.key = load, batch, key or uuid.uuid4().hex

    def scores(self, query: Column, text: Column) -> Column:
        load, size, key = self.load, self.batch, self.key

        def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            model = loaded(key, load)
            for asked, texts in parts:
                asked, texts, out = asked.fillna("").tolist(), texts.fillna("").tolist(), []
                for i in range(0, len(asked), size):
                    got = [float(x) for x in model(asked[i : i + size], texts[i : i + size])]
                    if len(got) != len(asked[i : i + size]):
                        raise ValueError(f"the model returned {len(got)} scores for {len(asked[i : i + size])} pairs")
                    out += got
                yield pd.Series(out, dtype=float)

        # the same as a hint, without which pandas_udf takes it for a function of one batch
        run.__annotations__ = {"parts": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.Series]}
        return F.pandas_udf(run, "double")(query, text)


_LOADED: dict[str, Callable] = {}


def loaded(key: str, load: Callable[[], Callable]) -> Callable:
    """The model of this worker process."""
    if key not in _LOADED:
        _LOADED[key] = load()
    return _LOADED[key]


def rerank(hits: DataFrame, model: Model | Callable[[pd.Series, pd.Series], pd.Series] | None = None, keep: int = RERANK_KEEP, by: Callable[[Column, Column], Column] = overlap) -> DataFrame:
    """hits (query_id, query, ord, text, rank) with rerank_score and rerank_rank; blank questions have none.

    Scores come from the model, or from ``by`` where there is none.
    """
    if keep < 1:
        raise ValueError("keep is 1 at least")
    query, text = F.col("query"), F.col("text")
    score = by(query, text) if model is None else model.scores(query, text) if isinstance(model, Model) else F.pandas_udf(model, "double")(query, text)
    scored = hits.where(F.trim("query") != "").withColumn("rerank_score", F.round(score, 6))
    w = Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), "rank")
    return scored.withColumn("rerank_rank", F.row_number().over(w)).where(F.col("rerank_rank") <= keep)
