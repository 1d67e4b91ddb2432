"""BM25 by blocks of postings against a plain count, with one and two phases."""

import math
import random
from collections import Counter

import pytest

from leafmill.operators import blocks, lexical


def plain(docs, asked, k):
    words = {i: Counter(t.split()) for i, t in docs}
    n, tokens = len(docs), sum(sum(w.values()) for w in words.values())
    df = Counter(x for w in words.values() for x in w)
    raw = {x: math.log(n - c + 0.5) - math.log(c + 0.5) for x, c in df.items()}
    mean = sum(raw.values()) / len(raw)
    idf = {x: v if v >= 0 else 0.25 * mean for x, v in raw.items()}
    out = {}
    for q, t in asked:
        score = {}
        for i, w in words.items():
            dl = sum(w.values())
            score[i] = sum(m * idf[x] * w[x] * 2.5 / (w[x] + 1.5 * (0.25 + 0.75 * dl / (tokens / n))) for x, m in Counter(t.split()).items() if x in w)
        out[q] = [(i, round(s, 6)) for i, s in sorted(score.items(), key=lambda x: (-round(x[1], 6), x[0]))[:k]]
    return out


@pytest.mark.parametrize("options", [{}, {"width": 16}, {"width": 16, "few": 1, "rare": 6}, {"width": 16, "few": 1, "rare": 1000}])
@pytest.mark.parametrize("common", [0.3, 0.95])
def test_blocks(spark, options, common):
    rng = random.Random(4)
    rare = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(150)]
    text = lambda n: " ".join(rng.choice(["the", "of", "and"]) if rng.random() < common else rng.choice(rare) for _ in range(n))
    docs = [(3 * i, text(rng.randint(0, 30))) for i in range(200)]
    asked = [(q, text(6)) for q in range(30)] + [(100, "zzzz"), (101, ""), (102, "the the of")]
    corpus, questions = spark.createDataFrame(docs, "ord long, text string"), spark.createDataFrame(asked, "query_id long, text string")
    want = plain(docs, asked, 7)
    rows = lexical.search(questions, corpus, 7, **options).orderBy("query_id", "rank").collect()
    got = {}
    for r in rows:
        got.setdefault(r.query_id, []).append((r.ord, r.score))
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()}
    assert all(abs(a - b) < 2e-6 for q in got for (_, a), (_, b) in zip(got[q], want[q], strict=True))
    without = lexical.search(questions, corpus, 7, pad=False, **options).where("query_id >= 100").collect()
    assert {r.query_id for r in without} == {102} and all(r.score > 0 for r in without)


def test_blocks_of_nothing(spark):
    none = spark.createDataFrame([], "ord long, text string")
    asked = spark.createDataFrame([(1, "the of")], "query_id long, text string")
    assert lexical.search(asked, none, 5).collect() == []
    assert lexical.search(asked.limit(0), none, 5).collect() == []


def test_rows_read(spark):
    corpus = spark.createDataFrame([(i, "the " + ("stone" if i % 50 == 0 else "")) for i in range(300)], "ord long, text string")
    asked = spark.createDataFrame([(1, "the stone"), (2, "the the")], "query_id long, text string")
    packed = blocks.packed(lexical.postings(corpus), 100)
    assert {r.query_id: (r.postings, r.blocks) for r in blocks.rows_read(asked, packed).collect()} == {1: (306, 6), 2: (300, 3)}


def test_blocks_of_texts_are_those_of_their_postings(spark, monkeypatch):
    rng = random.Random(5)
    docs = [(3 * i - 50, " ".join(rng.choice(["the", "of", "ab 123", "\u00e9", f"x{rng.randint(0, 40)}"]) for _ in range(rng.randint(0, 30)))) for i in range(200)]
    corpus = spark.createDataFrame([*docs, (9000, None), (9001, ""), (4, "the the of"), (4, "the of the"), (4, "the")], "ord long, text string")
    for width, together in ((7, 1 << 20), (100, 50)):
        monkeypatch.setattr(blocks, "TOGETHER", together)
        want, got = blocks.packed(lexical.postings(corpus), width), blocks.of_texts(corpus, width)
        assert got.dtypes == want.dtypes and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert blocks.of_texts(corpus.limit(0)).collect() == []


def test_an_index_is_written_in_little_more_than_its_texts(spark):
    """No table of postings, and no checkpoint of texts, vectors or blocks."""
    import os

    from leafmill.plans.index import index_of

    def size():
        at = spark.sparkContext.getCheckpointDir()
        return sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(at.removeprefix("file:")) for f in files) if at else 0

    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(20_000)]
    rows = [(i, f"c{i}", 1, "prose", "", "", " ".join(words[int(20_000 * rng.random() ** 3)] for _ in range(250))) for i in range(1500)]
    chunks = spark.createDataFrame(rows, "ord long, id string, page int, type string, course_code string, title string, text string")
    before, text = size(), sum(len(r[-1]) for r in rows)
    index = index_of(chunks)
    assert size() - before < 1.5 * text
    want = Counter(t for r in rows for t in set(r[-1].split()))
    assert {r.term: r.df for r in index.vocabulary.collect()} == want and (index.n, index.n_tokens) == (1500, 1500 * 250)
    assert index.vectors.count() == 1500


def test_small_inputs_are_dealt_to_all_cores(spark, tmp_path):
    from pyspark.sql import functions as F

    from leafmill.plans.stages import dealt

    spark.range(100).coalesce(1).write.parquet(str(tmp_path / "one"))
    one = spark.read.parquet(str(tmp_path / "one"))
    parts = dealt(one).withColumn("part", F.spark_partition_id())
    assert parts.select("part").distinct().count() > 1 and parts.count() == 100
    assert dealt(one, small=0).rdd.getNumPartitions() == one.rdd.getNumPartitions()


def test_padding_keeps_hits_among_the_first_places(spark):
    from leafmill.operators.lexical import padded

    asked = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "query_id long, text string")
    scored = spark.createDataFrame([(1, 0, -0.5), (1, 9, 2.0)], "query_id long, ord long, score double")
    got = [tuple(r) for r in padded(scored, asked, [0, 1, 2], 4).orderBy("query_id", "rank").collect()]
    assert got == [(1, 9, 2.0, 1), (1, 1, 0.0, 2), (1, 2, 0.0, 3), (1, 0, -0.5, 4), (2, 0, 0.0, 1), (2, 1, 0.0, 2), (2, 2, 0.0, 3)]
    assert padded(scored.limit(0), asked.limit(0), [], 4).collect() == []
