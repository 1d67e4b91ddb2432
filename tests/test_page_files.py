"""The data source of page files: forms of files, ranges, and what rows have."""

import json

import pytest

from leafmill.sources import page_files, pages

BOX = {"x0": 1, "y0": 2.5, "x1": 3, "y1": None, "text": "block"}
PAGES = [
    {"page": 7, "text": "first\n  {\n \"quoted\" }"}, {"page_number": "12", "content": "é 日本 " * 30}, {"text": "no number"}, {"page": "x", "full_text": "odd"},
    {"page": 5, "blocks": [BOX, "plain"]}, {"page": 6, "blocks": [], "text": " "}, {"page": 8, "text": "last", "blocks": None},
]
WANT = [(1, 7, PAGES[0]["text"]), (2, 12, PAGES[1]["content"]), (3, 3, "no number"), (4, 4, "odd"), (5, 5, "block\nplain"), (6, 6, ""), (7, 8, "last")]
FORMS = {
    "indented": lambda rows: json.dumps(rows, indent=2), "wide": lambda rows: json.dumps(rows, indent=4, ensure_ascii=False), "tabs": lambda rows: json.dumps(rows, indent="\t"),
    "flat": lambda rows: json.dumps(rows, indent=0), "one-line": json.dumps, "lines": lambda rows: "\n".join(map(json.dumps, rows)) + "\n", "lines-crlf": lambda rows: "\r\n".join(map(json.dumps, rows)),
}


@pytest.mark.parametrize("form", FORMS)
@pytest.mark.parametrize("size", [1, 7, 64, 300, 1 << 20])
def test_forms_and_ranges(tmp_path, form, size):
    file = tmp_path / "pages.json"
    file.write_text(FORMS[form](PAGES), encoding="utf-8", newline="")
    reader = page_files.PageReader({"path": str(file), "bytes": size})
    parts = reader.partitions()
    assert (len(parts) > 1) == (size < 1 << 20 and form not in ("flat", "one-line"))
    rows = [r for p in parts for r in reader.read(p)]
    assert [r[1:4] for r in rows] == WANT and {r[0] for r in rows} == {str(file)}
    assert rows[4][4] == [(1.0, 2.5, 3.0, None, "block"), (None, None, None, None, "plain")] and rows[5][4] == [] and rows[0][4] is rows[6][4] is None


def test_two_files_by_many_tasks(spark, tmp_path):
    many = [{"page": i, "text": f"text {i} " * 40} for i in range(300)]
    (tmp_path / "a.json").write_text(json.dumps(many, indent=2))
    (tmp_path / "b.json").write_text(json.dumps(PAGES, indent=2))
    (tmp_path / "c.json").write_text(" \n")
    page_files.register(spark)
    df = spark.read.format("leafmill_pages").option("bytes", 20_000).load(str(tmp_path / "*.json"))
    assert df.rdd.getNumPartitions() > 2
    rows = df.collect()
    of = lambda name: sorted(((r.place, r.page, r.text) for r in rows if r.file.endswith(name)))
    assert of("b.json") == WANT and of("a.json") == [(i + 1, i, f"text {i} " * 40) for i in range(300)] and of("c.json") == []
    assert spark.read.format("leafmill_pages").load(f"file://{tmp_path}").count() == 307
    plain = pages.read_pages(spark, str(tmp_path / "a.json")).collect()
    assert sorted((r.page, r.text) for r in plain) == sorted((p, t) for _, p, t in of("a.json"))


def test_errors(spark, tmp_path):
    page_files.register(spark)
    with pytest.raises(Exception, match="no pages at"):
        spark.read.format("leafmill_pages").load(str(tmp_path / "none.json")).collect()
    (tmp_path / "bad.json").write_text('[\n  {"page": 1},\n  {"page": }\n]')
    with pytest.raises(Exception, match="bad.json has an object that is no JSON"):
        spark.read.format("leafmill_pages").load(str(tmp_path / "bad.json")).collect()


def test_a_first_line_longer_than_what_is_read_at_once(tmp_path):
    file = tmp_path / "long.json"
    rows = [{"page": i, "text": "x" * n} for i, n in enumerate((200_000, 3, 70_000, 5))]
    for size in (page_files.AHEAD - 1, 1 << 20):
        file.write_text("\n".join(map(json.dumps, rows)) + "\n")
        reader = page_files.PageReader({"path": str(file), "bytes": size, "places": "false"})
        got = [r[1:4] for p in reader.partitions() for r in reader.read(p)]
        assert got == [(None, r["page"], r["text"]) for r in rows]


def test_query_keeps_blank_texts_and_odd_ids(spark, tmp_path):
    """As its SQL: null and negative ids, ids beyond 32 bits, and texts that are null, empty, blank or long."""
    from leafmill.plans import queries

    ids = [0, 1, -1, -2, None, None, 2**40, 7, 8, 9]
    texts = ["a", "", " ", None, "without id", "", "big", "x" * 70_000, "b\n{", "\t"]
    docs = spark.createDataFrame([(i, t, "en" if t != "a" else None, "web", 0) for i, t in zip(ids, texts, strict=True)], "doc_id long, text string, lang string, source string, n_chars long")
    for name, rows in (("some", docs), ("none", docs.limit(0))):
        rows.coalesce(1).write.parquet(str(tmp_path / name / "documents.parquet"))
    got = queries.QUERIES["page_files"](spark, str(tmp_path / "some")).collect()
    label = lambda i: None if i is None else f"file {int(abs(i) % 2) * (-1 if i < 0 else 1)}"
    want = [(label(i), i, t or "", ["web", None if t == "a" else "en"]) for i, t in zip(ids, texts, strict=True)]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert queries.QUERIES["page_files"](spark, str(tmp_path / "none")).collect() == []
