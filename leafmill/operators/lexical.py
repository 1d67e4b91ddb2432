"""BM25 over chunks for a table of questions.  corpus: ord (long, corpus order), text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import BM25_EPSILON
from ..functions.text import tokens
from ..plans.stages import dealt, materialised, stored
from . import blocks


def postings(corpus: DataFrame) -> DataFrame:
    """term, ord, tf, dl (the document's tokens)."""
    texts = dealt(corpus.select("ord", "text")).select("ord", tokens(F.col("text")).alias("t")).select("ord", F.size("t").alias("dl"), "t")
    # outer: else a filter on the size is put before it, for which each text is taken apart once more
    words = texts.select("ord", "dl", F.explode_outer("t").alias("term")).where("term is not null")
    return words.groupBy("term", "ord", "dl").agg(F.count(F.lit(1)).alias("tf")).select("term", "ord", F.col("tf").cast("long").alias("tf"), F.col("dl").cast("long").alias("dl"))


def corpus_stats(corpus: DataFrame) -> DataFrame:
    return dealt(corpus.select("text")).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size(tokens(F.col("text")))), F.lit(0)).cast("long").alias("tokens"))


def vocabulary(posts: DataFrame, n: int) -> DataFrame:
    """term, df, idf of postings."""
    return weighted(posts.groupBy("term").agg(F.count(F.lit(1)).alias("df")), n)


def weighted(df: DataFrame, n: int) -> DataFrame:
    """term, df, idf of (term, df); a negative idf becomes a share of the mean idf."""
    raw = df.withColumn("raw", F.log(F.lit(float(n)) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.agg(F.avg("raw").alias("mean"))
    return raw.crossJoin(F.broadcast(mean)).select("term", "df", F.when(F.col("raw") < 0, F.col("mean") * BM25_EPSILON).otherwise(F.col("raw")).alias("idf"))


def top_k(scored: DataFrame, k: int) -> DataFrame:
    """query_id, ord, score, rank: best first, ties in corpus order."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "ord")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def padded(scored: DataFrame, questions: DataFrame, first: list[int], k: int) -> DataFrame:
    """query_id, ord, score, rank: the k best of every question, of what is scored and of the places ``first``, which else have score 0.

    Before rows of a question meet, each task cuts them to k and those of ``first``.
    """
    places = f"cast(array({', '.join(map(str, first))}) AS array<bigint>)"
    order = f"PARTITION BY query_id ORDER BY array_contains({places}, ord) DESC, score DESC, ord"
    held = scored.selectExpr("query_id", "ord", "score", f"row_number() OVER ({order}) AS rank").where(F.col("rank") <= k + len(first))
    hits = held.groupBy("query_id").agg(F.expr("collect_list(struct(0.0D - score AS s, ord)) AS hits"))
    rows = questions.select("query_id").distinct().join(hits, "query_id", "left").selectExpr("query_id", "coalesce(hits, cast(array() AS array<struct<s:double,ord:bigint>>)) AS hits")
    every = f"concat(hits, transform(array_except({places}, hits.ord), o -> struct(0.0D AS s, o AS ord)))"
    best = rows.selectExpr("query_id", f"posexplode_outer(slice(array_sort({every}), 1, {int(k)})) AS (at, x)").where("x is not null")
    return best.selectExpr("query_id", "x.ord AS ord", "0.0D - x.s AS score", "at + 1 AS rank")


def search(questions: DataFrame, corpus: DataFrame, k: int, pad: bool = True, index: tuple | None = None, first: list[int] | None = None, **options) -> DataFrame:
    """The k best of every question; with pad, documents of score 0 follow in corpus order.

    index: postings or blocks of them, vocabulary, documents, tokens; first: the first places of the corpus, if known.
    """
    posts, vocab, n, n_tokens = index or indexed(corpus)
    asked = questions.select(F.col("query_id").cast("long").alias("query_id"), "text")
    found, n_questions, weights = blocks.named(posts, asked, vocab)
    found = found if "range" in found.columns else blocks.packed(found, options.get("width", blocks.WIDTH))
    # a question with fewer than k scored documents finds the rest among the first 2k of the corpus
    if not pad:
        first = []
    elif first is None or len(first) < min(2 * k, n):
        first = first_of(corpus, 2 * k)
    first = first[: 2 * k]
    scored = blocks.scores(asked, found, vocab, n, n_tokens, k, first, n_questions=n_questions, weights=weights, **options)
    return padded(scored, asked, first, k) if pad else top_k(scored, k)


def first_of(corpus: DataFrame, n: int) -> list[int]:
    """The n first places of the corpus."""
    return [r.ord for r in corpus.select(F.col("ord").cast("long").alias("ord")).orderBy("ord").limit(n).collect()]


def indexed(corpus: DataFrame) -> tuple[DataFrame, DataFrame, int, int]:
    """Postings, vocabulary, documents and tokens: texts are tokenised once, and what many steps read is written."""
    posts = materialised(postings(corpus))
    n, n_tokens = corpus.count(), posts.agg(F.sum("tf")).first()[0] or 0
    return posts, materialised(vocabulary(posts, n)), n, n_tokens


def blocked(corpus: DataFrame) -> tuple[DataFrame, DataFrame, int, int]:
    """Like ``indexed``, with blocks of postings, which alone are written."""
    found = stored(blocks.of_texts(corpus), "blocks")
    n, n_tokens = corpus.count(), found.agg(F.sum(F.expr("aggregate(tfs, 0L, (n, x) -> n + x)"))).first()[0] or 0
    df = found.groupBy("term").agg(F.sum(F.size("ords")).cast("long").alias("df"))
    return found, stored(weighted(df, n), "vocabulary"), n, n_tokens


def signature(ids: DataFrame, digits: int = 3) -> DataFrame:
    """One row: the number of ids and a digest of all of them, the same in any order.

    Blocks of ids by the first digits of their own digests are digested on their own tasks, so nothing is
    gathered but the digests of the 16**digits blocks.
    """
    key = F.col("id").cast("string")
    each = ids.groupBy(F.substring(F.md5(key.cast("binary")), 1, digits).alias("b")).agg(F.count(F.lit(1)).alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list(key)), "|"), 256).alias("s"))
    every = F.transform(F.array_sort(F.collect_list(F.struct("b", "s"))), lambda x: x["s"])
    return each.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n_ids"), F.sha2(F.array_join(every, "|"), 256).alias("signature"))
