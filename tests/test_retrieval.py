"""The retrieval engine on hand-made cases."""

import pytest
from pyspark.sql import functions as F

from leafmill import config
from leafmill.functions import text as T
from leafmill.operators import answer, chunking, documents, entities, fusion, layout, lexical, records, sections, tables, vectors
from leafmill.plans import index as plan


def one(spark, column, **values):
    ddl = ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'array<array<string>>' if isinstance(v, list) else 'double'}" for k, v in values.items()) or "x string"
    return spark.createDataFrame([tuple(values.values()) or ("",)], ddl).select(column.alias("c")).first().c


@pytest.mark.parametrize(
    ("text", "want"),
    [("COE 486 or coe486", "coe 486 or coe 486 coe486 coe486"), ("COE-486L", "coe 486 l coe486l"), ("open to 100 students in 2025", "open to 100 students in 2025 to100"), ("für MTH\n104", "f r mth 104 mth104"), ("", ""), (None, "")],
)
def test_tokens(spark, text, want):
    assert " ".join(one(spark, T.tokens(F.col("t")), t=text)) == want


def test_codes_end_beside_letters_beyond_ascii(spark):
    """As in the SQL of postings: a code may touch a letter that ASCII lacks, but no letter, digit or _ of it."""
    texts = ["\u00f1ar 116", "nj\u00e1 101\u00e9", "ch 146\u0301", "x_ab 123", "ab 123_", "ab\u000b123", "ab\u00a0123", "ab\f123cd", "\u0130AB-123 A\u0130 200"]
    want = ["ar 116 ar116", "nj 101", "ch 146 ch146", "x ab 123", "ab 123", "ab 123", "ab 123", "ab 123 cd ab123cd", "iab 123 ai 200 iab123 ai200"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", T.tokens(F.col("t")).alias("t")).collect()
    assert [" ".join(r.t) for r in sorted(rows)] == want


def test_cleaning(spark):
    assert one(spark, T.clean_whitespace(F.col("t")), t="  a b\t c\r\n \n\n d​ ") == "a b c\n\n d"
    assert one(spark, T.clean_description(F.col("t")), t="a\nb , c .") == "a b, c."
    assert one(spark, T.repaired_code(F.col("t")), t="GER-Cor e") == "GER-Core"
    assert one(spark, T.lines(F.col("t")), t="a\r\n\n b  c") == ["a", "b c"]


def test_courses(spark):
    text = "ABC 101 Intro (Part One) (3-0-3). Basics. ABC 102 See ABC 103 notes (1-0-1). Junk. QXABC 201 Next Topic (1.5-3-3). Last. Prerequisites: ABC 100 or XYZ 099 or ABC 100; co-requisite: ABC 101L."
    rows = entities.courses(spark.createDataFrame([(1, text)], "page int, text string")).orderBy("item").collect()
    assert [(r.course_code, r.title, r.format) for r in rows] == [("ABC 101", "Intro (Part One)", "3-0-3"), ("XABC 201", "Next Topic", "1.5-3-3")]
    assert rows[0].description == "Basics." and rows[1].prerequisites == ["ABC 100", "XYZ 099"]
    free = entities.unnumbered(spark.createDataFrame([(1, "BPE Bridge Program Elective (3-0-3). Any of these.")], "page int, text string")).first()
    assert (free.course_code, free.format) == ("BPE", "3-0-3")


def test_chunk_spans():
    assert chunking.spans("A" * 1000 + ". " + "B" * 1000 + "? " + "C" * 100) == [(0, 1001), (751, 2104)]
    assert chunking.spans("x" * 3000) == [(0, 1800), (1550, 3000)]
    assert chunking.spans("short") == [(0, 5)] and chunking.spans("") == []
    text = "Some words. " * 900
    got = chunking.spans(text)
    assert got[0][0] == 0 and got[-1][1] == len(text)
    assert all(b - a <= 1800 for a, b in got) and all(0 <= b - c <= 250 for (_, b), (c, _) in zip(got, got[1:], strict=False))


def ranked(spark, ids):
    return spark.createDataFrame([(1, x, i + 1) for i, x in enumerate(ids)], "query_id long, ord string, rank int")


def test_fusion_ties_in_first_seen_order(spark):
    rows = fusion.fuse([ranked(spark, "abc"), ranked(spark, "cda")]).orderBy("rank").collect()
    assert [r.ord for r in rows] == ["a", "c", "b", "d"]
    assert rows[0].rrf_score == rows[1].rrf_score == pytest.approx(0.03226646, abs=1e-8)
    assert [list(r.methods) for r in rows] == [[0, 1], [0, 1], [0], [1]]


def test_bm25_pads_with_the_first_of_the_corpus(spark):
    corpus = spark.createDataFrame([(i, f"word{i} common") for i in range(5)] + [(5, None)], "ord long, text string")
    asked = spark.createDataFrame([(1, "zzz"), (2, "word common word"), (3, None)], "query_id long, text string")
    rows = lexical.search(asked, corpus, 3).orderBy("query_id", "rank").collect()
    assert [r.ord for r in rows if r.query_id == 1] == [0, 1, 2] == [r.ord for r in rows if r.query_id == 3]
    assert len([r for r in rows if r.query_id == 2]) == 3


def test_context_budget(spark):
    hits = [(1, 1, 3, "x" * 9500), (1, 2, 4, "y"), (2, 1, None, "a" * 4990), (2, 2, 5, "b" * 4990), (2, 3, 5, "c" * 90)]
    rows = {r.query_id: r for r in answer.contexts(spark.createDataFrame(hits, "query_id long, rank int, page int, text string")).collect()}
    assert rows[1].n_blocks == rows[2].n_blocks == 1 and rows[2].context.startswith("[p. None] a")


def test_sources(spark):
    rows = [(1, 1, 7, "", "", "prose", ["bm25"]), (1, 2, 7, "", "", "prose", ["vector"]), (1, 3, None, "", "", "", []), (1, 4, 2, "ABC 101", "t", "course", ["bm25", "vector"])]
    got = answer.footers(spark.createDataFrame(rows, "query_id long, rank int, page int, course_code string, title string, type string, methods array<string>")).first().footer
    assert got.split("\n") == ["Sources:", "- excerpt (p. None) [?]", "- ABC 101 (p. 2) [bm25+vector]", "- prose (p. 7) [bm25]"]


def test_history(spark):
    turns = spark.createDataFrame([(1, 0, "user", "What?"), (1, 1, "assistant", "That."), (2, 0, "user", " same ")], "conv_id long, turn long, role string, text string")
    asked = spark.createDataFrame([(1, "And now"), (2, "same"), (3, "alone")], "conv_id long, query string")
    got = {r.conv_id: r.retrieval_query for r in answer.retrieval_queries(asked, turns).collect()}
    assert got == {1: "What? And now", 2: "same", 3: "alone"}
    assert {(r.conv_id, r.turn) for r in answer.before_regeneration(turns).collect()} == set()
    assert answer.transcripts(turns).where("conv_id = 1").first().transcript == "**You**: What?\n\n**Assistant**: That."


def test_lines_are_anchored_and_rules_thinned(spark):
    words = spark.createDataFrame([(1, f"w{i}", float(9 - i), 1.0, float(y)) for i, y in enumerate([10, 12, 13, 14])], "page int, text string, x0 double, x1 double, top double")
    assert [(r.line, r.text) for r in layout.line_texts(layout.words_in_lines(words)).orderBy("line").collect()] == [(0, "w2 w1 w0"), (1, "w3")]
    ys = spark.createDataFrame([([0.0, 0.8, 1.6, 2.4],)], "ys array<double>").select(layout.thinned(F.col("ys")).alias("k")).first().k
    assert ys == [0.0, 1.6]


def test_curriculum_blocks(spark):
    words = [(1, w, 10.0 + 20 * i, 28.0 + 20 * i, 50.0) for i, w in enumerate("FIRST YEAR (30 credit hours)".split())]
    words += [(1, w, x, x + 10, 70.0) for w, x in (("Term", 10.0), ("Course", 60.0), ("Course", 120.0), ("Credit", 250.0), ("Hours", 262.0))]
    rows = [("Fall", "MTH 103", "Calculus I", "3"), ("", "GER-Cor e", "Writing", "3"), ("", "", "see the note", ""), ("", "Total", "", "15")]
    for i, row in enumerate(rows):
        words += [(1, w, x + 9 * j, x + 5, 90.0 + 20 * i) for text, x in zip(row, (10.0, 60.0, 120.0, 250.0), strict=True) for j, w in enumerate(text.split())]
    words = [(*w[:2], float(w[2]), float(w[3]), w[4]) for w in words]
    rules = [(1, 5.0, 290.0, 82.0 + 20 * i, 0.5) for i in range(5)]
    got = layout.curriculum_blocks(
        spark.createDataFrame(words, "page int, text string, x0 double, x1 double, top double"),
        spark.createDataFrame(rules, "page int, x0 double, x1 double, top double, height double"),
        spark.createDataFrame([(1, 600.0, 800.0)], "page int, width double, height double"),
    ).collect()
    assert len(got) == 1 and (got[0].year, got[0].credit_hours) == ("First Year", 30)
    assert [list(r) for r in got[0].rows] == [["Fall", "MTH 103", "Calculus I", "3"], ["Fall", "GER-Core", "Writing", "3"], ["Fall", "", "Total", "15"]]


def test_tables_out_of_pages(spark):
    from leafmill.operators import extraction

    words, rules = [], []
    for year, top, side in (("SECOND", 50.0, 0), ("FIRST", 50.0, 1), ("FIFTH", 300.0, 0)):
        x = 10.0 + 300 * side
        words += [(1, w, x + 20 * i, x + 18 + 20 * i, top) for i, w in enumerate(f"{year} YEAR (30 credit hours)".split())]
        words += [(1, w, x + dx, x + dx + 8, top + 20) for w, dx in (("Term", 0), ("Course", 50), ("#", 65), ("Course", 110), ("Title", 130), ("Credit", 240), ("Hours", 252))]
        words += [(1, w, x + dx, x + dx + 8, top + 40) for w, dx in (("Fall", 0), ("ABC", 50), ("101", 60), ("Topic", 110), ("3", 240))]
        rules += [(1, x - 5, x + 280, top + 32 + 20 * i, 0.5) for i in range(2)]
    words += [(2, "plain", 1.0, 2.0, 3.0)]
    raw = [(1, 0, [["never", "read"]]), (2, 0, [["Fee Type", "Amount"], ["Lab", "5"]]), (2, 1, [["only prose"]])]
    got = extraction.page_tables(
        spark.createDataFrame(words, "page int, text string, x0 double, x1 double, top double"), spark.createDataFrame(rules, "page int, x0 double, x1 double, top double, height double"),
        spark.createDataFrame([(1, 600.0, 800.0), (2, 600.0, 800.0)], "page int, width double, height double"), spark.createDataFrame(raw, "page int, table_index int, rows array<array<string>>"),
    ).orderBy("page", "table_index").collect()
    assert [(r.page, r.table_index, r.table_id, r.year) for r in got] == [
        (1, 0, "page_1_curriculum_2", "First Year"), (1, 1, "page_1_curriculum_1", "Second Year"), (1, 2, "page_1_curriculum_3", "Fifth Year"), (2, 0, "page_2_table_1", None)]
    assert got[0].rows == [["Fall", "ABC 101", "Topic", "3"]] and got[0].text.startswith("Page: 1\nProposed Sequence of Study\nFirst Year\n") and got[3].headers == ["Fee Type", "Amount"]


def test_tables(spark):
    made = lambda rows: one(spark, tables.normalised(F.col("r")), r=rows)
    got = made([["Required Placement Tests", None], ["Physics", "Yes No", "* ** Yes"], ["Other", "x"]])
    assert got.title == "Required Placement Tests" and got.rows == [["Physics", "Yes", "No", "*", "**", "Yes"]] or got.rows[0][0] == "Physics"
    got = made([["Excellent", "A", "4.0"], ["", "A- equals 3.7"], ["Good", "B+", "3.3"]])
    assert got.rows == [["Excellent", "A", "4.0"], ["Excellent", "A-", "3.7"], ["Good", "B+", "3.3"]]
    assert made([["AUD", "Audit", "only"], ["IP", "In progress"]]).rows == [["AUD", "Audit only"], ["IP", "In progress"]]
    assert made([["Tuition (in AED)", ""], ["Regular Semester", ""], ["Per hour", "100", "200"]]).rows == [["Per hour", "100", "200"]]
    assert made([["Required Placement Tests", None], ["Physics", "Yes No Yes No Yes"]]).headers == ["Majors", "Engineering Math", "Business Math", "Architecture Math", "Physics", "English"]
    assert made([["Fee Type", "Amount"], ["Lab", "5"]]).headers == ["Fee Type", "Amount"]
    assert made([["only prose"], ["more prose"]]) is None and made([["x"]]) is None
    assert one(spark, tables.markdown(tables.strings([]), F.col("r")), r=[["a", "b"], ["c"], ["", None]]) == "| a | b |\n| --- | --- |\n| c |  |"


def test_records_and_build(spark):
    prose = "This paragraph is long enough to be kept as one, and it ends with a stop."
    pages = [(16, "Office 1\nab"), (18, "Fall classes begin\nnothing"), (80, "ABC 101 Topic 3\n\n" + prose), (190, "ABC 101 Intro One (3-0-3). Basics of things."), (200, ""), (250, "Professor A of things"), (3, prose), (50, prose + "\n\n" + prose)]
    pages = spark.createDataFrame(pages, "page int, text string")
    rows = records.page_records(pages).collect()
    assert sorted((r.type, r.page) for r in rows) == [("calendar_event", 18), ("curriculum_course", 80), ("directory", 16), ("faculty", 250), ("general_prose", 50), ("general_prose", 50), ("general_prose", 80)]
    t = spark.createDataFrame([(16, "t1", "", ["a"], [["Registrar", "123", "x@y"], ["Telephone", "b"]]), (18, "t2", "", [], [["Fall", "Aug 1"]]), (80, "curriculum_1", "", ["C"], [["ABC 101"]]), (70, "t3", "Fees", ["F"], [["Lab"]])], "page int, table_id string, title string, headers array<string>, rows array<array<string>>")
    texts = sorted((r.type, r.text) for r in records.table_records(t).collect())
    assert texts[0] == ("calendar_event", "Fall, Aug 1") and texts[2] == ("directory", "Registrar — 123, x@y")
    dates = records.table_records(t).where("type = 'calendar_event'").unionByName(records.calendar_lines(pages.where("page = 18")))
    assert {(r.section, r.title) for r in dates.collect()} == {("calendar", "Academic Calendar"), (None, "Academic Calendar")}
    docs = plan.documents_of(pages, t).collect()
    # the directory page has a table, so its lines are covered
    assert len(docs) == 1 + 5 + 4 and {d.id for d in docs} == {"course_00000"} | {f"record_{i:05d}" for i in range(9)}
    assert [(d.section, d.metadata.page) for d in docs if d.type == "course"] == [("course_descriptions", 190)]
    assert len(plan.documents_of(pages).collect()) == 1 + 6
    index = plan.build(pages, t)
    asked = spark.createDataFrame([(1, "what is ABC 101"), (2, "registrar")], "query_id long, text string")
    got = {r.query_id: r for r in index.answer(asked, n=3).collect()}
    assert "Basics of things" in got[1].context and got[1].footer.startswith("Sources:\n- ") and len(got[1].chunks_used) == 3
    assert index.reranked(asked).count() == 10
    with pytest.raises(ValueError):
        index.reranked(asked, depth=2, keep=3)


def test_index_round_trip_and_freshness(spark, tmp_path):
    chunks = spark.createDataFrame([(i, f"c{i}", 1, "t", "", "", f"text number {i}") for i in range(4)], "ord long, id string, page int, type string, course_code string, title string, text string")
    plan.index_of(chunks).save(str(tmp_path))
    back = plan.Index.load(spark, str(tmp_path))
    assert back.n == 4 and plan.Index.is_fresh(spark, str(tmp_path), chunks) and not plan.Index.is_fresh(spark, str(tmp_path), chunks.limit(3))
    assert back.hits(spark.createDataFrame([(1, "number 2")], "query_id long, text string"), n=2).count() == 2


def test_index_options_and_views(spark, tmp_path):
    import pandas as pd

    chunks = spark.createDataFrame([(i, f"c{i}", i, "prose", "ABC 101" if i == 2 else "", "", f"text number {i} " * 200) for i in range(4)], "ord long, id string, page int, type string, course_code string, title string, text string")
    asked = []

    def embedder(texts: pd.Series) -> pd.Series:
        assert len(texts) <= 2
        return vectors.hashed_embedding(texts)

    index = plan.index_of(chunks, embedder, limit=3, batch=2)
    assert index.chunks.count() == index.vectors.count() == 3 and index.query_prefix == config.QUERY_PREFIX and not asked
    q = spark.createDataFrame([(1, "number 2")], "query_id long, text string")
    rows = plan.index_of(chunks).nearest(q, 2).collect()
    assert [r.rank for r in rows] == [1, 2] and all(len(r.snippet) <= 200 for r in rows)
    listed = {r.label: r for r in index.listed(index.search(q)).collect()}
    assert set(listed) == {"ABC 101", "prose"} and all(len(r.snippet) <= 150 for r in listed.values())
    old = spark.createDataFrame([("c0", [9.0]), ("gone", [1.0])], "id string, v array<float>")
    kept = {r.id: r.v for r in vectors.indexed(chunks.select("id", "text"), old).collect()}
    assert set(kept) == {"c0", "c1", "c2", "c3", "gone"} and kept["c0"] == [9.0]
    assert {r.id: len(r.v) for r in vectors.indexed(chunks.select("id", "text"), old, force=True).collect()}["c0"] > 1
    index.save(str(tmp_path / "a"))
    with pytest.warns(UserWarning, match="stale"):
        back = plan.Index.load(spark, str(tmp_path / "a"), chunks)
    assert plan.Index.is_fresh(spark, str(tmp_path / "a"), None) and back.n == 3
    plan.index_of(chunks.limit(0)).save(str(tmp_path / "b"))
    with pytest.warns(UserWarning, match="empty"):
        plan.Index.load(spark, str(tmp_path / "b"))
    got = index.answer(q, settings=config.Settings(top_n=3))
    assert [(r.id, r.label) for r in index.excerpts(got).where("id = 'c2'").collect()] == [("c2", "ABC 101")]
    assert all(len(r.text) <= 800 for r in index.excerpts(got).collect()) and [s.position for s in got.first().sources] == [1, 2, 3]
    assert [(i, "".join(p).startswith("[p. ")) for i, p in index.stream(q)] == [(1, True)]


def test_turns_of_whole_conversations(spark):
    chunks = spark.createDataFrame([(i, f"c{i}", i, "prose", "", "", f"text number {i}") for i in range(4)], "ord long, id string, page int, type string, course_code string, title string, text string")
    turns = spark.createDataFrame([(1, 0, "user", "number 1"), (1, 1, "assistant", "this"), (1, 2, "user", "and more"), (2, 0, "user", "fail"), (3, 0, "user", "x"), (3, 1, "assistant", "y")], "conv_id long, turn long, role string, text string")

    def generator(prompts):
        if len(prompts) and "number" in prompts.iloc[0]:
            raise RuntimeError("no model")
        return prompts

    index = plan.index_of(chunks)
    new = index.turns(turns)
    assert {(r.conv_id, r.turn, r.role) for r in new.collect()} == {(1, 3, "assistant"), (2, 1, "assistant")}
    assert all("no model" in r.text for r in index.turns(turns, generator).collect())
    text = {r.conv_id: r.transcript for r in answer.transcripts(turns.withColumn("sources", F.lit(None).cast("array<struct<label:string,page:int>>")).unionByName(new.select("conv_id", "turn", "role", "text", F.expr("transform(sources, s -> named_struct('label', s.label, 'page', s.page))").alias("sources")))).collect()}
    assert text[1].startswith("**You**: number 1\n\n**Assistant**: this\n\n**You**: and more\n\n**Assistant**: ") and text[1].count("\n  - prose (p. ") == 4


def test_head_and_tail_of_courses(spark):
    rows = spark.createDataFrame([(i, 0, f"ABC {100 + i}", "T") for i in range(40)], "page int, item int, course_code string, title string")
    got = entities.head_and_tail(rows).collect()
    assert [r.course_code for r in got if r.part == "first"] == [f"ABC {100 + i}" for i in range(15)]
    assert sorted(r.course_code for r in got if r.part == "last") == [f"ABC {100 + i}" for i in range(25, 40)]


def test_pages_of_several_files(spark, tmp_path):
    import json

    from leafmill.sources import pages as source

    for name in "ab":
        (tmp_path / f"{name}.json").write_text(json.dumps([{"text": f"{name}{i}"} for i in range(3)] + [{"page": "7", "content": f"{name}7"}, {"blocks": [{"x0": 0, "text": "u"}, {"x0": 1, "text": "v"}]}]))
    got = sorted((r.text, r.page) for r in source.read_pages(spark, str(tmp_path / "*.json")).collect())
    assert got == [("a0", 1), ("a1", 2), ("a2", 3), ("a7", 7), ("b0", 1), ("b1", 2), ("b2", 3), ("b7", 7), ("u\nv", 5), ("u\nv", 5)]


def test_vectors(spark):
    v = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(5)], "ord long, v array<float>")
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, v array<float>")
    assert [r.ord for r in vectors.nearest(q, v, 2).orderBy("rank").collect()] == [4, 3]
    assert vectors.nearest(q.limit(0), v, 2).count() == 0
    stored = spark.createDataFrame([("a", 1), ("b", 1)], "id string, n int")
    new = spark.createDataFrame([("b", 2), ("c", 2)], "id string, n int")
    assert sorted(map(tuple, vectors.upserted(stored, new).collect())) == [("a", 1), ("b", 2), ("c", 2)]


def test_indexed_neighbours_reach_the_recall(spark):
    from collections import Counter

    import numpy as np

    from __spark_entry__ import queries

    rng = np.random.RandomState(4)
    for rows in (rng.randn(1500, 64), rng.randn(30, 64), np.repeat(rng.randn(3, 64), 400, 0) + 0.01 * rng.randn(1200, 64)):
        v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rows)], "ord long, v array<float>")
        v = v.unionByName(spark.createDataFrame([(9000, None)], v.schema))
        q = v.where("ord % 25 = 0").select(F.col("ord").alias("query_id"), "v").where("v is not null")
        got = vectors.nearest_in_cells(q, v, 20).collect()
        assert sorted(Counter(r.query_id for r in got).values()) == [20] * q.count()
        true = {(r.query_id, r.ord, r.distance) for r in vectors.nearest(q, v, 20).collect()}
        assert len(true & {(r.query_id, r.ord, r.distance) for r in got}) >= 0.9 * len(true)
    assert vectors.nearest_in_cells(q.limit(0), v, 20).count() == 0 == vectors.nearest_in_cells(q, v.limit(0), 20).count()
    d = "/root/testdata/sf0.01"
    stored = spark.read.parquet(f"{d}/embeddings.parquet").selectExpr("vec_id AS ord", "embedding AS v")
    q = stored.where("ord % 100 = 0").selectExpr("ord AS query_id", "v")
    true = {(r.query_id, r.ord) for r in vectors.nearest(q, stored, 20).collect()}
    got = {(r.query_id, r.ord) for r in queries()["cosine_hashed"](spark, d).collect()}
    assert len(got) == len(true) == 20 * q.count() and len(got & true) >= 0.9 * len(true)


def test_first_wins_and_numbers(spark):
    rows = spark.createDataFrame([(i, f"k{i % 3}") for i in range(9000, 0, -1)], "i long, k string")
    assert sorted(r.i for r in documents.first_wins(rows, [F.col("k")], ["i"]).collect()) == [1, 2, 3]
    got = documents.numbered(rows, "i", ["k"], block=7).collect()
    assert all(r.position == r.i - 1 for r in got)


def test_streaming_ingest_adds_each_chunk_once(spark, tmp_path):
    from leafmill.streaming.ingest import ingest

    src, store, mark = (str(tmp_path / x) for x in ("in", "store", "mark"))
    for batch in (["a", "b"], ["b", "c"]):
        spark.createDataFrame([(x, f"text {x}") for x in batch], "id string, text string").coalesce(1).write.mode("append").parquet(src)
        ingest(spark, src, "id string, text string", store, mark).awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(store).collect()) == ["a", "b", "c"]


def test_sections_and_settings(spark):
    pages = spark.createDataFrame([(p,) for p in (1, 16, 18, 36, 187, 300)], "page int")
    assert [r.section for r in sections.with_section(pages).orderBy("page").collect()] == ["unknown", "directory", "general", "achievement_courses", "courses", "unknown"]
    assert {r.section: r.n_pages for r in sections.histogram(pages).collect()} == {"exclude": 1, "directory": 1, "general": 1, "achievement_courses": 1, "courses": 1, "unknown": 1}
    config.Settings(top_n=5)
    with pytest.raises(ValueError):
        config.Settings(top_n=2)
