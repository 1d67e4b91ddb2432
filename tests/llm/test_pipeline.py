"""The pipeline on a small table: every stage's decisions take effect."""

import random


def test_pipeline(spark, tmp_path):
    import corpus_pipeline
    from leafmill.llm import near, toxicity

    rng = random.Random(11)
    vocab = ["".join(rng.choice("lmnoprst") for _ in range(5)) for _ in range(300)]
    prose = lambda n: [rng.choice(vocab) for _ in range(n)]
    item = " ".join(prose(20))
    texts = []
    for i in range(300):
        words = prose(60)
        if i % 6 == 0:
            words[5] = words[20] = "vrakus"
        texts.append(" ".join(words))
    texts[1] = texts[2] = texts[3]
    texts[7] = " ".join(prose(20)) + " " + item
    rows = [(i, t, "en", f"src{i % 4}", len(t)) for i, t in enumerate(texts)] + [(300, None, None, None, None), (301, "", "en", "src0", 0)]
    d = str(tmp_path / "sf")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([(i, 1, int(i % 6 == 0)) for i in range(300)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")

    docs = spark.read.parquet(f"{d}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, d)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen.append({r.doc_id for r in docs.collect()})
        assert docs.count() == len(seen[-1])
    toxic = {i for i in range(0, 300, 6)}
    assert seen[0] == set(range(302)) - toxic
    assert seen[1] == seen[0] - {2, 3}
    assert seen[2] == seen[1] - {7}
    assert seen[3] < seen[2] and seen[4] == seen[3]
    assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "shard", "slot"]
    assert {r.doc_id for r in corpus_pipeline.run(spark, d).collect()} == seen[4]
    assert near and toxicity


def test_pipeline_of_empty_tables(spark, tmp_path):
    import corpus_pipeline

    d = str(tmp_path / "sf")
    ddl = {"documents": "doc_id long, text string, lang string, source string, n_chars long", "benchmark": "item_id long, text string", "labels": "doc_id long, quality int, toxic int"}
    for rows in (0, 1):
        at = f"{d}{rows}"
        for name, columns in ddl.items():
            some = [(1, "some words of a text", "en", "s", 20)] if rows and name == "documents" else []
            spark.createDataFrame(some, columns).write.parquet(f"{at}/{name}.parquet")
        out = corpus_pipeline.run(spark, at)
        assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "shard", "slot"] and out.count() <= rows
