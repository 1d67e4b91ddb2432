"""The digest, the table function and the reranker."""

import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F

from leafmill.functions import text as T
from leafmill.functions import udtf
from leafmill.operators import chunking, digest, fusion


def test_digest(spark):
    rows = [(1, "a"), (2, None), (2, ""), (None, "a"), (1, "a"), (3, "é")]
    df = spark.createDataFrame(rows, "id long, text string")
    of = lambda x: digest.value(digest.digest(x, "id", "text"))
    said = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    want = [len(rows)] + [sum(int(hashlib.sha256((said(i) + said(t)).encode()).hexdigest()[8 * k : 8 * k + 8], 16) for i, t in rows) % 2**32 for k in range(8)]
    assert of(df) == want == of(df.repartition(5).orderBy(F.rand(1)))
    first, rest = df.where("id = 1"), df.where("id is null or id <> 1")
    assert digest.added(of(first), of(rest)) == want and digest.added(want, of(rest), -1) == of(first)
    assert of(df.limit(0)) == digest.NONE and len(digest.text(want)) == 64
    changed = df.withColumn("text", F.when(F.col("id") == 3, "e").otherwise(F.col("text")))
    assert of(changed) != want
    assert of(spark.createDataFrame([(1, "1:a-")], "id long, text string")) != of(spark.createDataFrame([(11, ":a-")], "id long, text string"))


def test_table_function(spark):
    rng = random.Random(3)
    odd = [None, "", " \r\n \n\n a b\t\tc \n \n\n d​e ", "x" * 4000, "Some words. " * 700, "a\n\x0b\n b\r\rc"]
    odd += ["".join(rng.choice("ab .?!\n\t\r\xa0​\x0bé") for _ in range(rng.randint(0, 3000))) for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(odd)), "id long, text string")
    assert [r.c for r in docs.select(T.clean_whitespace(F.col("text")).alias("c")).collect()] == [udtf.cleaned(t) for t in odd]
    udtf.register(spark)
    docs.createOrReplaceTempView("odd_documents")
    got = spark.sql("SELECT id, c.ordinal, c.text, c.begins, c.ends FROM odd_documents d, LATERAL chunk_text(d.text) c").collect()
    want = chunking.chunks(docs).select("document_id", "ordinal", "text").collect()
    assert sorted((r.id, r.ordinal, r.text) for r in got) == sorted(map(tuple, want))
    assert all(udtf.cleaned(odd[r.id])[r.begins : r.ends].strip() == r.text for r in got)
    small = spark.sql("SELECT count(*) AS n FROM odd_documents d, LATERAL chunk_text(d.text, 100, 10) c WHERE d.id = 3").first().n
    assert small == 45  # a step of 90 over 4,000
    with pytest.raises(Exception, match="overlap is less"):
        spark.sql("SELECT * FROM odd_documents d, LATERAL chunk_text(d.text, 10, 10) c").collect()


HITS = [(1, "stone bridge", 1, "a stone far from any such bridge", 1), (1, "stone bridge", 2, "the stone bridge", 2), (1, "stone bridge", 3, "stone stone", 3), (1, "stone bridge", 4, None, 4), (2, " ", 5, "x", 1), (3, "?", 6, "x", 1)]
HIT = "query_id long, query string, ord long, text string, rank int"


def test_proximity(spark):
    rows = fusion.rerank(spark.createDataFrame(HITS, HIT), keep=9, by=fusion.proximity).orderBy("query_id", "rerank_rank").collect()
    assert [(r.query_id, r.ord, r.rerank_score) for r in rows] == [(1, 2, 1.0), (1, 1, round((1 + 2 / 6) / 2, 6)), (1, 3, 0.5), (1, 4, 0.0), (3, 6, 0.0)]


def test_smallest_window_by_brute_force(spark):
    rng = random.Random(8)
    cases = [(["a", "b", "c"][: rng.randint(0, 3)], [rng.choice("abcdx") for _ in range(rng.randint(0, 14))]) for _ in range(150)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(cases)], "i int, a array<string>, b array<string>")
    for r in df.select("i", fusion._windows("a", "b").alias("w")).collect():
        asked, words = cases[r.i]
        met = set(asked) & set(words)
        spans = [j - i for i in range(len(words)) for j in range(i + 1, len(words) + 1) if met and met <= set(words[i:j])]
        assert r.w == [len(met), min(spans, default=0)]


def test_model_is_loaded_once_a_worker(spark, tmp_path):
    log = str(tmp_path)

    def load():
        open(os.path.join(log, f"loaded-{os.getpid()}-{random.random()}"), "w").close()

        def model(asked, texts):
            with open(os.path.join(log, f"sizes-{os.getpid()}"), "a") as f:
                f.write(f"{len(asked)}\n")
            return [len(t) for t in texts]

        return model

    hits = spark.range(400).select((F.col("id") % 40).alias("query_id"), F.lit("q").alias("query"), F.col("id").alias("ord"), F.repeat(F.lit("x"), (F.col("id") % 17).cast("int")).alias("text"), (F.col("id") / 40).cast("int").alias("rank")).repartition(12)
    model = fusion.Model(load, batch=8)
    for _ in range(2):
        rows = fusion.rerank(hits, model, keep=1).collect()
        assert len(rows) == 40 and all(r.rerank_score == len(r.text) for r in rows)
    loads = [f.split("-")[1] for f in os.listdir(log) if f.startswith("loaded")]
    assert len(loads) == len(set(loads)) >= 1
    sizes = [int(x) for f in os.listdir(log) if f.startswith("sizes") for x in open(os.path.join(log, f))]
    assert sum(sizes) == 800 and max(sizes) == 8
    with pytest.raises(Exception, match="returned 1 scores"):
        fusion.rerank(hits, fusion.Model(lambda: lambda a, b: [1.0])).collect()
