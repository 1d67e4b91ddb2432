"""The growing index: after any batches a search equals one over an index built anew."""

import os
import random

import pytest
from pyspark.sql import functions as F

from leafmill.plans.index import index_of
from leafmill.plans.segments import Conflict, Segments
from leafmill.streaming.ingest import ingest_changes

DDL = "id string, ord long, page int, type string, course_code string, title string, text string, deleted boolean"


def batches(seed=3):
    rng = random.Random(seed)
    words = ["stone", "river", "tree", "the", "the", "of", "bridge", "lake"]
    row = lambda i, gone=False: (f"c{i}", i, i % 5, "prose", "", f"t{i}", " ".join(rng.choice(words) for _ in range(rng.randint(1, 12))), gone)
    return [
        [row(i) for i in range(30)],
        [row(i) for i in range(25, 40)] + [row(3), row(4, gone=True), row(99, gone=True)],
        [row(7, gone=True), row(7), row(8), row(50)] + [row(i, gone=True) for i in range(30, 34)],
    ]


def final(parts):
    live = {}
    for part in parts:
        gone = {r[0] for r in part if r[7]}
        for r in part:
            if r[0] not in gone:
                live[r[0]] = r
        for i in gone:
            live.pop(i, None)
    return sorted(live.values(), key=lambda r: r[1])


def found(index, asked):
    return sorted((r.query_id, r["rank"], r.ord, round(r.rrf_score, 9)) for r in index.hits(asked).collect())


def check(spark, segments, parts):
    asked = spark.createDataFrame([(1, "stone bridge"), (2, "the of the river"), (3, "nothing")], "query_id long, text string")
    rows = final(parts)
    chunks = spark.createDataFrame(rows, DDL).drop("deleted")
    built, grown = index_of(chunks.select("ord", "id", "page", "type", "course_code", "title", "text")), segments.index()
    assert (grown.n, grown.n_tokens) == (built.n, built.n_tokens)
    assert sorted(map(tuple, grown.chunks.select("id", "ord", "text").collect())) == sorted((r[0], r[1], r[6]) for r in rows)
    idf = lambda x: {r.term: (r.df, round(r.idf, 9)) for r in x.vocabulary.collect()}
    assert idf(grown) == idf(built)
    assert found(grown, asked) == found(built, asked)
    assert segments.is_fresh(chunks)
    assert not rows or not segments.is_fresh(chunks.withColumn("text", F.concat("text", F.lit("."))))


def test_batches_merge_and_vacuum(spark, tmp_path):
    parts, segments = batches(), Segments(spark, str(tmp_path / "index"))
    for epoch, part in enumerate(parts):
        before = segments.apply(spark.createDataFrame(part, DDL), epoch)
        check(spark, segments, parts[: epoch + 1])
        assert segments.apply(spark.createDataFrame(parts[0], DDL), epoch) == before == segments.manifest()  # a replay
    first = segments.index(version=1)
    assert first.n == 30
    merged = segments.merge(tier=100)
    assert len(merged["segments"]) == 1 and merged["dead"] == []
    check(spark, segments, parts)
    gone = segments.vacuum()
    assert sum(x.startswith("segments/") for x in gone) == 3 and segments.versions() == [merged["version"]]
    check(spark, segments, parts)
    more = [("c500", 500, 1, "prose", "", "", "stone stone lake", False), ("c8", 8, 1, "prose", "", "", None, False)]
    segments.apply(spark.createDataFrame(more, DDL), 7)
    check(spark, segments, [*parts, more])


def test_small_segments_merge_first(spark, tmp_path):
    segments = Segments(spark, str(tmp_path / "index"))
    rows = lambda a, b: spark.createDataFrame([(f"c{i}", i, 1, "prose", "", "", "stone", False) for i in range(a, b)], DDL)
    for epoch, (a, b) in enumerate(((0, 100), (100, 103), (103, 107))):
        segments.apply(rows(a, b), epoch)
    assert sorted(s["rows"] for s in segments.merge()["segments"]) == [7, 100]
    assert segments.index().n == 107 == segments.index().chunks.count()


def test_a_manifest_is_made_once(spark, tmp_path):
    one, two = (Segments(spark, str(tmp_path / "index")) for _ in range(2))
    m = one.manifest()
    one._commit(m)
    with pytest.raises(Conflict):
        two._commit(m)
    assert one.versions() == [1] and not [f for f in os.listdir(tmp_path / "index" / "manifest") if f.startswith("_")]


def test_a_failed_batch_leaves_nothing_that_is_read(spark, tmp_path):
    parts = batches()

    def broken(texts):
        raise ValueError("no model")

    good, bad = Segments(spark, str(tmp_path / "index")), Segments(spark, str(tmp_path / "index"), broken)
    good.apply(spark.createDataFrame(parts[0], DDL), 0)
    with pytest.raises(Exception, match="no model"):
        bad.apply(spark.createDataFrame(parts[1], DDL), 1)
    check(spark, good, parts[:1])
    assert [x for x in good.vacuum() if x.startswith("segments/")]
    good.apply(spark.createDataFrame(parts[1], DDL), 1)
    check(spark, good, parts[:2])


def test_empty_index(spark, tmp_path):
    segments = Segments(spark, str(tmp_path / "index"))
    asked = spark.createDataFrame([(1, "stone")], "query_id long, text string")
    assert segments.index().hits(asked).collect() == [] and segments.merge()["version"] == 0
    segments.apply(spark.createDataFrame([], DDL), 0)
    assert segments.manifest()["segments"] == [] and segments.index().hits(asked).collect() == []


def test_stream_of_changes(spark, tmp_path):
    parts, segments = batches(), Segments(spark, str(tmp_path / "index"))
    source = str(tmp_path / "arriving")
    for i, part in enumerate(parts):
        spark.createDataFrame(part, DDL).coalesce(1).write.mode("append").parquet(source)
        query = ingest_changes(spark, source, DDL, segments, str(tmp_path / "checkpoint"), merge=i > 0)
        query.awaitTermination()
        assert query.exception() is None
        check(spark, segments, parts[: i + 1])
    assert segments.manifest()["epoch"] == 2
