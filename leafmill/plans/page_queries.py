"""Registered queries of page layout, tables and records, over pages that Spark derives from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import config
from ..functions import text as T
from ..operators import answer, documents, entities, extraction, layout, lexical, records, tables, vectors
from . import index as plan
from . import stages
from .queries import _ASK, _CORPUS_TABLES, _ROUTED, _SCORE, CASE, CLEAN, COURSE_SQL, _corpus, _course_pages, _pages, _questions, _t, _vectors, query


def _rows(*rows) -> F.Column:
    """Columns and strings as rows of cells."""
    return F.array(*[F.array(*[c if isinstance(c, F.Column) else F.lit(c) for c in r]) for r in rows])


_ONE = r"trim(regexp_replace(regexp_replace({0}, '[ \t]+', ' ', 'g'), '\n+', chr(10), 'g'), E' \n\t')"


@query(rf"""SELECT doc_id, {_ONE.format("coalesce(text, '')")} AS matching, trim(regexp_replace(regexp_replace(coalesce(text, '') || ' , and so on ; end', '\s+', ' ', 'g'), '\s+([,.!?;:])', '\1', 'g')) AS description,
 'GER-Core, GER-' || chr(97 + cast(doc_id % 26 AS int)) || 'b' AS code FROM documents""")
def matching_text(spark, d):
    """Text as matching, descriptions and codes see it."""
    torn = F.concat(F.lit("GER-Cor e,  GER-"), F.char(F.col("doc_id") % 26 + 97), F.lit(" b"))
    described = F.concat(F.coalesce("text", F.lit("")), F.lit(" , and so on ; end"))
    return _t(spark, d, "documents").select("doc_id", T.one_newline(F.col("text")).alias("matching"), T.clean_description(described).alias("description"), T.repaired_code(torn).alias("code"))


@query("SELECT p_partkey AS page, 0 AS item, 'BPE' AS course_code, 'Bridge Program Elective' AS title, '3-0-' || (p_partkey % 4) AS format, p_name || ' first.' AS description FROM part UNION ALL SELECT p_partkey, 1, 'BPE', 'Bridge Program Elective', '0-1-1', 'Last.' FROM part")
def unnumbered_courses(spark, d):
    n = F.col("p_partkey")
    text = F.concat(F.lit("Before. BPE Bridge Program Elective (3-0-"), (n % 4).cast("string"), F.lit("). "), F.col("p_name"), F.lit(" first.\nBPE  Bridge\nProgram Elective (0-1-1). Last."))
    return entities.unnumbered(_t(spark, d, "part").select(n.alias("page"), text.alias("text"))).select("page", "item", "course_code", "title", "format", "description")


@query("SELECT p_partkey FROM (SELECT p_partkey, row_number() OVER (PARTITION BY p_partkey % 50, p_brand, p_partkey % 7 ORDER BY p_partkey) AS n FROM part) WHERE n = 1")
def deduplicated_courses(spark, d):
    """The first course of each code, title and page; case of titles and blanks around do not count."""
    n = F.col("p_partkey")
    title = F.when(n % 2 == 0, F.upper("p_brand")).otherwise(F.concat(F.lit(" "), F.lower("p_brand")))
    made = _t(spark, d, "part").select("p_partkey", F.concat(F.lit("ABC "), (n % 50 + 100).cast("string"), F.when(n % 3 == 0, " ").otherwise("")).alias("course_code"), title.alias("title"), (n % 7).alias("page"), n.alias("item"))
    return documents.dedup_courses(made).select("p_partkey")


_LISTED = f"(SELECT *, row_number() OVER (ORDER BY page, item, course_code) AS a, row_number() OVER (ORDER BY page DESC, item DESC, course_code DESC) AS z FROM (SELECT page, item, course_code, title FROM ({COURSE_SQL}) UNION ALL SELECT p_partkey, 1, 'ABC 200', 'Next' FROM part))"


@query(f"SELECT 'first' AS part, a AS place, course_code, title FROM {_LISTED} WHERE a <= 15 UNION ALL SELECT 'last', 16 - z, course_code, title FROM {_LISTED} WHERE z <= 15")
def course_head_and_tail(spark, d):
    return entities.head_and_tail(entities.courses(_course_pages(spark, d))).select("part", F.col("place").cast("long").alias("place"), "course_code", "title")


_HEADING = rf"""SELECT p_partkey, year, credit_hours, year IS NOT NULL AND p_partkey % 2 = 0 AS listed,
 regexp_matches(trim(cell), '(?i)^([A-Z]{{2,5}}\s+\d{{3}}[A-Z]?(\s+or\s+([A-Z]{{2,5}}\s+\d{{3}}[A-Z]?|FRE|MJE|MCE))?|FRE|MJE|MCE|[A-Z]{{2,5}}-[A-Za-z]+)$') AS is_code,
 p_partkey % 6 IN (0, 1, 3, 5) AS starts, p_partkey % 3 = 0 AS is_header FROM
 (SELECT p_partkey, CASE WHEN p_partkey % 4 < 3 THEN ['First', 'Second', 'Third', 'Fourth', 'Fifth'][p_partkey % 5 + 1] || ' Year' END AS year, CASE WHEN p_partkey % 4 < 3 THEN cast(p_partkey % 40 AS int) END AS credit_hours,
  [' ABC 101 ', 'abc 101L or FRE', 'ABC 10', 'MJE', p_name, 'GER-Core'][p_partkey % 6 + 1] AS cell FROM part)"""


@query(_HEADING)
def curriculum_marks(spark, d):
    """What marks a curriculum page, its years, its headers and its course cells."""
    n = F.col("p_partkey")
    pick = lambda values, m: F.element_at(F.array(*[v if isinstance(v, F.Column) else F.lit(v) for v in values]), (n % m + 1).cast("int"))
    heading = F.concat(pick(["FIRST", "second", "Third", "FOURTH", "fifth"], 5), F.when(n % 4 < 3, F.lit(" YEAR ( ")).otherwise(" TERM ("), (n % 40).cast("string"), F.lit(" credit hours)"), F.when(n % 2 == 0, " Course #").otherwise(""))
    cell = pick([" ABC 101 ", "abc 101L or FRE", "ABC 10", "MJE", F.col("p_name"), "GER-Core"], 6)
    begins = pick(["Fall ABC 101 Topic", "MJE Major Elective", "Fall term of Topic 12", "x y GER-Core", "a b c d e f ABC 101", "FRE"], 6)
    header = pick(["Term Course # Course Title Credit Hours", "Term Course Credit", "Course Title Hours"], 3)
    year = layout.year_heading(heading)
    return _t(spark, d, "part").select("p_partkey", year["year"].alias("year"), year["credit_hours"].alias("credit_hours"), layout.is_curriculum_page(heading).alias("listed"),
                                       layout.is_code_cell(cell).alias("is_code"), layout.starts_with_code(F.split(begins, " ")).alias("starts"), layout.is_column_header(header).alias("is_header"))


_HEADER = """hw AS (SELECT c_nationkey AS page, cast(c_custkey % 2 AS int) AS panel, ['term', 'Course', 'title', 'Credit', 'x'][c_custkey % 5 + 1] AS word, cast(c_custkey % 97 AS double) AS x0 FROM customer WHERE c_custkey % 11 < 4),
pick AS (SELECT page, panel, min(x0) FILTER (word = 'term') AS t, list_sort(list_distinct(list(x0) FILTER (word = 'Course'))) AS c, min(x0) FILTER (word = 'Credit') AS k FROM hw GROUP BY page, panel),
col AS (SELECT page, panel, coalesce(t, panel * 100 + 4) AS term, coalesce(c[1], panel * 100 + 35) AS course, coalesce(c[2], panel * 100 + 75) AS title, coalesce(k - 5, panel * 100 + 75) AS credit FROM pick)"""


@query(f"WITH {_HEADER} SELECT page, panel, cast(term AS double) AS term, cast(course AS double) AS course, cast(title AS double) AS title, cast(credit AS double) AS credit, count(*) AS n_words, count(*) FILTER (x < course) AS n_term, count(*) FILTER (x >= course AND x < title) AS n_course, count(*) FILTER (x >= course AND x >= title AND x < credit) AS n_title FROM col JOIN (SELECT c_nationkey AS page, c_custkey % 150 AS x FROM customer) USING (page) GROUP BY ALL")
def curriculum_columns(spark, d):
    """Columns from header words, and the words that fall into each."""
    n, left = F.col("c_custkey"), (F.col("c_custkey") % 2 * 100).cast("double")
    word = F.element_at(tables.strings(["term", "Course", "title", "Credit", "x"]), (n % 5 + 1).cast("int"))
    customers = _t(spark, d, "customer")
    header = customers.where("c_custkey % 11 < 4").select(F.col("c_nationkey").alias("page"), (n % 2).cast("int").alias("panel"), left.alias("left"), (left + 100).alias("right"), word.alias("text"), (n % 97).cast("double").alias("x0"))
    words = customers.select(F.col("c_nationkey").alias("page"), (n % 150).cast("double").alias("x0"))
    cell = layout.cell_column(F.col("x0"), F.col("course"), F.col("title"), F.col("credit"))
    met = words.join(layout.inferred_columns(header), "page").withColumn("cell", cell)
    return met.groupBy("page", "panel", "term", "course", "title", "credit").agg(F.count(F.lit(1)).alias("n_words"), *[F.count_if(F.col("cell") == c).alias(f"n_{c}") for c in ("term", "course", "title")])


@query("""SELECT page, band, coalesce(last_value(nullif(term, '') IGNORE NULLS) OVER (PARTITION BY page ORDER BY band ROWS UNBOUNDED PRECEDING), '') AS term, code, title, credit FROM
 (SELECT page, band, CASE WHEN band IN (1, 4) THEN t ELSE '' END AS term, CASE WHEN band = 6 THEN '' WHEN band % 2 = 0 THEN 'GER-Core' ELSE 'ABC ' || n END AS code, CASE WHEN band = 6 THEN 'Total' ELSE 'Topic ' || n END AS title, CASE WHEN band = 6 THEN cast(16 + n % 3 AS varchar) ELSE '3' END AS credit
  FROM (SELECT l_orderkey AS page, cast(l_linenumber AS int) AS band, ['Fall', 'Spring', 'Summer'][l_orderkey % 3 + 1] AS t, 100 + l_partkey % 900 AS n FROM lineitem) WHERE band NOT IN (3, 4))
 """)
def curriculum_rows_filled(spark, d):
    """Rows of curriculum tables cleaned, totals put in form, rows without a code dropped, terms filled down."""
    n, band = (F.col("l_partkey") % 900 + 100).cast("string"), F.col("l_linenumber")
    term = F.element_at(tables.strings(["Fall", "Spring", "Summer"]), (F.col("l_orderkey") % 3 + 1).cast("int"))
    course = F.when(band == 3, "no code").when(band == 4, term).when(band == 6, "").when(band % 2 == 0, "GER-Cor e").otherwise(F.concat(F.lit("ABC  "), n))
    title = F.when(band == 6, F.concat(F.lit("Total credits "), (F.lit(16) + n.cast("int") % 3).cast("string"))).otherwise(F.concat(F.lit(" Topic  "), n))
    made = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("page"), F.lit(0).alias("panel"), band.cast("int").alias("band"), F.when(band == 1, term).otherwise("").alias("c_term"), course.alias("c_course"), title.alias("c_title"), F.when(band == 6, "").otherwise("3").alias("c_credit"))
    return layout.filled_rows(made).select("page", "band", "term", "code", "title", "credit")


@query("""SELECT user_id AS page, string_agg('w' || event_id, chr(10) ORDER BY value % 700, event_id % 500, 'w' || event_id) AS text FROM events
 WHERE value IS NOT NULL AND value % 700 + 20 > 50 AND value % 700 < 650 AND event_id % 9 <> 0 GROUP BY user_id""")
def page_text(spark, d):
    """Text of pages from blocks outside the header and footer bands, a page for each user."""
    e = _t(spark, d, "events").where("value is not null")
    y, word = F.col("value") % 700, F.when(F.col("event_id") % 9 == 0, " ").otherwise(F.concat(F.lit("w"), F.col("event_id").cast("string")))
    blocks = e.select(F.col("user_id").alias("page"), F.lit(700.0).alias("height"), (F.col("event_id") % 500).cast("double").alias("x0"), (F.col("event_id") % 500 + 9).cast("double").alias("x1"), y.alias("y0"), (y + 20).alias("y1"), word.alias("text"))
    return layout.page_texts(layout.without_bands(blocks))


_TABLE_TEXT = """CASE o_orderkey % 8 WHEN 0 THEN 'Notation | Meaning' || n || 'AUD | Meaning ' || s WHEN 1 THEN 'Category | Grade | Grade Points' || n || 'Excellent | A | 4.0' || n || 'Excellent | A- | 3.7'
 WHEN 2 THEN 'Tuition (in AED)' || n || 'Item | Regular Semester | Summer Term' || n || 'Design | ' || s || ' | 2' WHEN 3 THEN 'Compulsory Fees (in AED)' || n || 'Fee Type | Description | Regular Semester | Summer Term' || n || 'Lab | About | ' || s || ' | 6'
 WHEN 4 THEN 'Required Placement Tests' || n || 'Majors | Engineering Math | Business Math | Architecture Math | Physics | English' || n || 'Physics | Yes | No | Yes | No | Yes' WHEN 5 THEN 'Course | Name' || n || 'x | ' || s ELSE 'p | q' || n || 'x | ' || s END"""


@query(f"SELECT o_orderkey, page, 'Page: ' || page || n || {_TABLE_TEXT} AS text FROM (SELECT o_orderkey, o_orderkey % 270 AS page, chr(10) AS n, cast(o_custkey AS varchar) AS s FROM orders) WHERE o_orderkey % 8 <> 6")
def table_texts(spark, d):
    """Tables of every kind in their normal form and as text; prose in one column falls out."""
    s, k = F.col("o_custkey").cast("string"), F.col("o_orderkey") % 8
    made = [
        _rows(["AUD", "", F.concat(F.lit("Meaning "), s)]), _rows(["Excellent", "(A) equals 4.0"], ["", "A- = 3.7"]),
        _rows(["Tuition (in AED)"], ["Regular Semester"], ["Design", s, "2"]), _rows(["Compulsory Fees (in AED)"], ["Summer Term"], ["Lab", "About", s, "6"]),
        _rows(["Required Placement Tests"], ["Physics", "Yes No Yes No Yes"], ["Astrology", "Yes No Yes No Yes"]), _rows(["Course", "Name"], ["x", s]),
        _rows(["only one cell"], [s]), _rows(["p", "q"], ["", ""], [" x ", s]),
    ]
    rows = F.lit(None)
    for i, m in enumerate(made):
        rows = F.when(k == i, m).otherwise(rows)
    t = _t(spark, d, "orders").select((F.col("o_orderkey") % 270).alias("page"), F.col("o_orderkey").cast("string").alias("table_id"), rows.alias("rows"))
    return tables.processed(t).select(F.col("table_id").cast("long").alias("o_orderkey"), "page", "text")


_SEQ = "'Proposed Sequence of Study'"
_MD = "'| Item | Key |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || c_name || ' | ' || c_custkey || ' |'"


@query(f"""WITH t AS (SELECT *, c_custkey % 270 AS page FROM customer), s AS (SELECT *, {CASE} AS section, {_MD} AS md, page BETWEEN 18 AND 19 AS calendar, c_custkey % 2 = 0 AS plan, CASE WHEN c_custkey % 3 = 0 THEN c_name END AS own FROM t),
w AS (SELECT *, coalesce(own, CASE WHEN plan THEN {_SEQ} ELSE 'Table on page ' || page END) AS name FROM s)
SELECT page, CASE WHEN section = 'directory' THEN 'directory' WHEN calendar THEN 'calendar_event' WHEN plan THEN 'curriculum_course' ELSE 'table' END AS type,
 CASE WHEN section = 'directory' OR NOT calendar AND NOT plan THEN section WHEN calendar THEN 'calendar' ELSE 'programs' END AS section,
 CASE WHEN section = 'directory' THEN c_name WHEN calendar THEN 'Academic Calendar' ELSE name END AS title,
 CASE WHEN section = 'directory' THEN c_name || ' — ' || c_custkey WHEN calendar THEN c_name || ', ' || c_custkey ELSE name || ' (page ' || page || '):' || chr(10) || md END AS text FROM w""")
def table_records(spark, d):
    """Records of tables by their page: directory, calendar, curriculum, reference."""
    n = F.col("c_custkey")
    title = F.when(n % 3 == 0, F.col("c_name")).otherwise("")
    kind = F.when(n % 2 == 0, "curriculum").otherwise("table")
    made = _t(spark, d, "customer").select((n % 270).alias("page"), F.concat(F.lit("page_"), (n % 270).cast("string"), F.lit("_"), kind, F.lit("_1")).alias("table_id"), title.alias("title"), tables.strings(["Item", "Key"]).alias("headers"), _rows([F.col("c_name"), n.cast("string")]).alias("rows"))
    return records.table_records(made).select("page", "type", "section", "title", "text")


@query("""SELECT doc_id, 'ABC 1' || (10 + doc_id % 90) AS course_code, text FROM (SELECT doc_id, 'ABC 1' || (10 + doc_id % 90) || ' Topic ' || (doc_id % 5 + 1) AS text FROM documents
 UNION ALL SELECT doc_id, 'ABC 1' || (10 + doc_id % 90) || ' Free Elective' FROM documents WHERE doc_id % 2 = 0)""")
def curriculum_records(spark, d):
    """Lines of programs that begin with a code; one is added with a number, one with a word, one with neither."""
    code = F.concat(F.lit("ABC 1"), (F.col("doc_id") % 90 + 10).cast("string"))
    extra = F.concat(F.lit("\n"), code, F.lit(" Topic "), (F.col("doc_id") % 5 + 1).cast("string"), F.lit("\n"), code, F.when(F.col("doc_id") % 2 == 0, "  Free Elective").otherwise(" Topic"))
    rows = records.curriculum_lines(_t(spark, d, "documents").select(F.col("doc_id").alias("page"), F.concat(F.coalesce("text", F.lit("")), extra).alias("text")))
    return rows.select(F.col("page").alias("doc_id"), "course_code", "text")


_PARAS = rf"(SELECT doc_id, unnest(list_filter(list_transform(string_split_regex(coalesce(text, '') || chr(10) || ' ' || chr(10) || source || ' of ' || lang || chr(10) || chr(10) || 'too short', '\n\s*\n'), lambda x: {CLEAN.format('x')}), lambda x: x <> '')) AS text FROM documents)"


@query(f"SELECT doc_id, text FROM {_PARAS} WHERE length(text) >= 10")
def faculty_records(spark, d):
    added = F.concat(F.coalesce("text", F.lit("")), F.lit("\n \n"), "source", F.lit(" of "), "lang", F.lit("\n\ntoo short"))
    return records.faculty(_t(spark, d, "documents").select(F.col("doc_id").alias("page"), added.alias("text"))).select(F.col("page").alias("doc_id"), "text")


@query(f"WITH {_ROUTED}, kept AS (SELECT * FROM rec WHERE NOT (type = 'directory' AND page IN (SELECT doc_id % 270 FROM documents WHERE doc_id % 540 = 16))) SELECT cast(page AS bigint) AS page, type, section, text FROM kept")
def covered_pages(spark, d):
    """Records of pages where some have tables: directory pages that have one give no lines of text."""
    covered = _t(spark, d, "documents").where("doc_id % 540 = 16 or doc_id % 540 = 18").select((F.col("doc_id") % 270).cast("int").alias("page"))
    return records.page_records(_pages(spark, d).select("page", "text"), covered).select("page", "type", "section", "text")


@query("SELECT 'page_' || s_suppkey || '_table_' || (i + 1) AS table_id, s_suppkey AS page, cast(i AS int) AS table_index, CASE i WHEN 0 THEN '' ELSE 'Tuition (in AED)' END AS title, 2 - i AS n_rows FROM supplier, (SELECT unnest([0, 1]) AS i)")
def raw_page_tables(spark, d):
    """Two raw tables of every page, numbered and in normal form."""
    n = F.col("s_suppkey")
    both = F.array(F.struct(F.lit(0).alias("table_index"), _rows(["a", F.col("s_name")], ["b", "c"]).alias("rows")), F.struct(F.lit(1).alias("table_index"), _rows(["Tuition (in AED)"], ["Design", n.cast("string"), "2"]).alias("rows")))
    raw = _t(spark, d, "supplier").select(n.alias("page"), F.explode(both).alias("t")).select("page", "t.*")
    return extraction.general_tables(raw).select("table_id", "page", "table_index", "title", F.size("rows").alias("n_rows"))


@query(f"SELECT format('course_{{:05d}}', row_number() OVER (ORDER BY page, item) - 1) AS id, cast(page AS bigint) AS page, course_code, title, 'course_descriptions' AS section, len(pre) AS n_prerequisites FROM (SELECT page, item, course_code, title, p AS pre FROM ({COURSE_SQL}) UNION ALL SELECT p_partkey, 1, 'ABC 200', 'Next', [] FROM part)")
def unified_courses(spark, d):
    """Courses as documents, with their ids in the order of pages and their metadata."""
    none = records.directory_lines(_pages(spark, d).select("page", "text").limit(0))
    made = documents.unified(entities.courses(_course_pages(spark, d)), none)
    return made.select("id", "page", "course_code", "title", "section", F.size("metadata.prerequisites").cast("long").alias("n_prerequisites"))


@query(f"WITH {_CORPUS_TABLES}, {_ASK}, {_SCORE} SELECT query_id, ord, score, rank FROM lex WHERE rank <= 8")
def saved_index_search(spark, d):
    """Search by words in an index that was saved and loaded."""
    chunks = _t(spark, d, "documents").select(F.col("doc_id").alias("ord"), F.col("doc_id").cast("string").alias("id"), (F.col("doc_id") % 270).cast("int").alias("page"), F.col("source").alias("type"), F.lit(None).cast("string").alias("course_code"), F.lit("").alias("title"), "text")
    path = stages.folder(spark, "saved-index")
    plan.index_of(chunks).save(path)
    index = plan.Index.load(spark, path)
    return lexical.search(_questions(spark, d), index.chunks, config.TOP_N, index=index.lexical).select("query_id", "ord", "score", F.col("rank").cast("long").alias("rank"))


@query("SELECT doc_id AS ord, cast(doc_id AS varchar) AS id FROM documents ORDER BY doc_id LIMIT 50")
def limited_index(spark, d):
    """An index of the first chunks in corpus order (the limit is what it shows)."""
    chunks = _corpus(spark, d).select("ord", F.col("ord").cast("string").alias("id"), "text")
    return plan.index_of(chunks, limit=50).vectors.select("ord", "id")


@query("""SELECT query_id, ord, distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, ord) AS rank FROM (
 SELECT a.vec_id AS query_id, b.vec_id AS ord, round(greatest(0.0, 1 - list_cosine_similarity(a.embedding::double[], b.embedding::double[])), 6) AS distance FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0)) WHERE rank <= 20""")
def cosine_exact(spark, d):
    """Exact neighbours of every hundredth vector, both sides on a grid."""
    stored = _vectors(spark, d)
    asked = stored.where("ord % 100 = 0").select(F.col("ord").alias("query_id"), "v")
    return vectors.nearest(asked, stored, config.DEPTH, few=0).select("query_id", "ord", "distance", F.col("rank").cast("long").alias("rank"))


@query("""SELECT conv_id, turn, 'Source ' || turn AS label, conv_id % 270 AS page, substr(coalesce(text, ''), 1, 800) AS text FROM conversations WHERE role <> 'user'""")
def answer_excerpts(spark, d):
    """Beginnings of the chunks that answers used; a chunk that is gone falls out."""
    turns = _t(spark, d, "conversations").where("role <> 'user'")
    key = F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    chunks = turns.select(key.alias("id"), (F.col("conv_id") % 270).alias("page"), F.lit("message").alias("type"), F.lit("").alias("course_code"), F.concat(F.lit("Source "), F.col("turn").cast("string")).alias("title"), F.coalesce("text", F.lit("")).alias("text"))
    used = turns.select(F.struct("conv_id", "turn").alias("query_id"), F.array(key, F.lit("gone")).alias("chunks_used"))
    index = plan.Index(chunks, None, None, None, 0, 0)
    return index.excerpts(used).select("query_id.*", "label", "page", "text")


@query("""SELECT event_id, CASE WHEN user_id % 2 = 0 THEN 'ABC ' || user_id ELSE event_type END AS label, CASE event_id % 3 WHEN 0 THEN 'both' WHEN 1 THEN 'bm25' ELSE 'vector' END AS method, substr(event_type || ' ' || repeat('x' || event_id || ' ', 40), 1, 150) AS snippet FROM events""")
def listed_results(spark, d):
    """Results as a list shows them: label, method, one line of text."""
    n = F.col("event_id")
    found = _t(spark, d, "events").select(n.alias("query_id"), F.lit(1).alias("rank"), F.when(F.col("user_id") % 2 == 0, F.concat(F.lit("ABC "), F.col("user_id").cast("string"))).otherwise("").alias("course_code"), F.col("event_type").alias("type"), F.lit(1).alias("page"),
                                          F.when(n % 3 == 0, F.array(F.lit(0), F.lit(1))).when(n % 3 == 1, F.array(F.lit(0))).otherwise(F.array(F.lit(1))).alias("methods"), F.lit(0.1).alias("rrf_score"), F.concat("event_type", F.lit("\n"), F.repeat(F.concat(F.lit("x"), n.cast("string"), F.lit(" ")), 40)).alias("text"))
    index = plan.Index(found, None, None, None, 0, 0)
    return index.listed(found).select(F.col("query_id").alias("event_id"), "label", "method", "snippet")


@query("""SELECT conv_id, string_agg(CASE WHEN role = 'user' THEN '**You**' ELSE '**Assistant**' END || ': ' || coalesce(text, '') || CASE WHEN role = 'assistant' THEN chr(10) || '  - Source (p. ' || conv_id % 270 || ')' ELSE '' END, chr(10) || chr(10) ORDER BY turn, text) AS transcript, count(*) AS n_messages FROM conversations GROUP BY conv_id""")
def transcript_with_sources(spark, d):
    """Transcripts with the sources of answers; other turns have none."""
    source = F.array(F.struct(F.lit("Source").alias("label"), (F.col("conv_id") % 270).alias("page")))
    return answer.transcripts(_t(spark, d, "conversations").withColumn("sources", source))
