"""Preprocessing in one call, settings that reach the generator, and saving an index."""

import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from leafmill.config import Settings
from leafmill.plans.index import Index, index_of
from leafmill.plans.preprocess import STAGES, preprocess


def chunks(spark, n=12):
    return spark.createDataFrame([(i, f"c{i}", i, "prose", "", "", f"stone number {i} and word{i}") for i in range(n)], "ord long, id string, page int, type string, course_code string, title string, text string")


def test_preprocess_writes_its_stages(spark, tmp_path):
    course = "ABC 101 Intro (3-0-3). About it. Prerequisites: XYZ 200."
    prose = "A long paragraph of prose about the life of students that is kept as a record of its page. " * 2
    pages = spark.createDataFrame([(200, course), (200, course), (40, prose), (40, prose), (41, ""), (5, None)], "page int, text string")
    out = preprocess(pages, str(tmp_path / "stages"))
    assert tuple(out) == STAGES
    checks = {r.check: r.value for r in out["diagnostics"].collect()}
    assert checks["pages"] == 6
    for stage in STAGES[:4]:
        assert checks[stage] == out[stage].count() == spark.read.parquet(str(tmp_path / "stages" / stage)).count()
        assert checks[f"{stage} without text"] == 0
    assert checks["courses"] == 1 and checks["courses dropped as repeats"] == 1 and checks["suspicious titles"] == 0
    assert checks["records dropped as repeats"] >= 1 and checks["documents"] == checks["courses"] + checks["records"]
    assert sum(v for k, v in checks.items() if k.startswith("records of type")) == checks["records"]
    assert checks["longest chunk"] == out["chunks"].agg(F.max(F.length("text"))).first()[0]
    assert out["histogram"].agg(F.sum("n_pages")).first()[0] == 6
    again = preprocess(pages.limit(0), str(tmp_path / "stages"))  # over what is there
    assert again["chunks"].count() == 0 and {r.check: r.value for r in again["diagnostics"].collect()}["documents"] == 0


def test_settings_reach_the_generator(spark):
    def told(prompts, options):
        return prompts.map(lambda p: json.dumps(options))

    asked = spark.createDataFrame([(1, "stone number 3")], "query_id long, text string")
    index = index_of(chunks(spark))
    got = index.answer(asked, generator=told, settings=Settings(temperature=0.5, context_tokens=2048)).first().answer
    assert json.loads(got) == {"temperature": 0.5, "num_ctx": 2048}
    turns = spark.createDataFrame([(9, 1, "user", "stone number 3")], "conv_id long, turn long, role string, text string")
    assert json.loads(index.turns(turns, told).first().text)["num_ctx"] == Settings().context_tokens
    plain = index.answer(asked, generator=lambda p: pd.Series(["x"] * len(p))).first().answer
    assert plain == "x"


def test_saving(spark, tmp_path):
    at = str(tmp_path / "deep" / "index")
    few, many = index_of(chunks(spark, 3)), index_of(chunks(spark))
    assert few.save(at, "error") and Index.load(spark, at).n == 3
    assert not many.save(at, "ignore") and Index.load(spark, at).n == 3
    with pytest.raises(FileExistsError):
        many.save(at, "error")
    assert many.save(at)
    loaded = Index.load(spark, at)
    assert loaded.n == 12 and loaded.first == list(range(12))
    assert [p.name for p in (tmp_path / "deep").iterdir() if not p.name.startswith(".")] == ["index"]  # no drafts left
    assert Index.is_fresh(spark, at, chunks(spark), content=True)
    changed = chunks(spark).withColumn("text", F.upper("text"))
    assert Index.is_fresh(spark, at, changed) and not Index.is_fresh(spark, at, changed, content=True)
    asked = spark.createDataFrame([(1, "stone word7"), (2, "zzz")], "query_id long, text string")
    found = lambda x: sorted((r.query_id, r["rank"], r.ord) for r in x.hits(asked).collect())
    assert found(loaded) == found(many)

    class Broken(Index):
        pass

    broken = Broken(*[getattr(many, c) for c in ("chunks", "postings", "vocabulary")], many.vectors.withColumn("v", F.raise_error(F.lit("lost"))), 12, 60)
    with pytest.raises(Exception, match="lost"):
        broken.save(at)
    assert found(Index.load(spark, at)) == found(many)  # what was there stays
