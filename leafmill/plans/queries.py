"""Registered queries of the retrieval engine over the given tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import config
from ..functions import text as T
from ..functions import udtf
from ..sources import page_files as page_source
from ..sources.pages import exists
from ..operators import answer, blocks, chunking, digest, documents, entities, extraction, fusion, layout, lexical, quantised, records, sections, tables, vectors
from . import index as plan
from .segments import Segments
from .stages import folder, materialised

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _pages(spark: SparkSession, d: str) -> DataFrame:
    """Documents as pages of a catalogue of 270 pages; a single line end parts paragraphs."""
    return _t(spark, d, "documents").select((F.col("doc_id") % 270).cast("int").alias("page"), "doc_id", "text")


def _corpus(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents").select(F.col("doc_id").alias("ord"), "text")


def _questions(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


CLEAN = r"trim(regexp_replace(regexp_replace(coalesce({0}, ''), '[ \t]+', ' ', 'g'), '\n\s*\n+', chr(10) || chr(10), 'g'), E' \n\t')"


@query(rf"SELECT doc_id, {CLEAN.format('text')} AS cleaned, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS one_line FROM documents")
def clean_text(spark, d):
    return _t(spark, d, "documents").select("doc_id", T.clean_whitespace(F.col("text")).alias("cleaned"), T.one_line(F.col("text")).alias("one_line"))


WORDS = r"regexp_extract_all(lower(coalesce({0}, '')), '[a-z]+|\d+')"


@query(rf"SELECT doc_id, cast(len({WORDS.format('text')}) AS bigint) AS n_words, cast(len(list_distinct({WORDS.format('text')})) AS bigint) AS n_terms FROM documents")
def tokenize_counts(spark, d):
    words = F.filter(T.tokens(F.col("text")), lambda x: ~x.rlike(r"^[a-z]+\d+[a-z]*$"))
    return _t(spark, d, "documents").select("doc_id", F.size(words).cast("long").alias("n_words"), F.size(F.array_distinct(words)).cast("long").alias("n_terms"))


@query("SELECT doc_id, ['coe', cast(100 + doc_id % 900 AS varchar), 'and', 'mth', cast(100 + doc_id % 800 AS varchar), 'l', 'coe' || (100 + doc_id % 900), 'mth' || (100 + doc_id % 800) || 'l'] AS tokens FROM documents")
def fused_code_tokens(spark, d):
    made = F.concat(F.lit("COE "), (F.col("doc_id") % 900 + 100).cast("string"), F.lit(" and MTH-"), (F.col("doc_id") % 800 + 100).cast("string"), F.lit("L"))
    return _t(spark, d, "documents").select("doc_id", T.tokens(made).alias("tokens"))


@query(r"""SELECT doc_id, i AS item, p AS text FROM (SELECT doc_id, unnest(ps) AS p, unnest(range(len(ps))) AS i FROM
 (SELECT doc_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(regexp_replace(x, '[ \t]+', ' ', 'g'))), lambda x: x <> '') AS ps FROM documents))
 WHERE length(p) >= 100 OR (length(p) >= 40 AND regexp_matches(p, '[.!?]'))""")
def paragraph_records(spark, d):
    pages = _t(spark, d, "documents").select(F.col("doc_id").alias("page"), "text")
    return records.prose(pages, T.lines).select(F.col("page").alias("doc_id"), F.col("item").cast("long").alias("item"), "text")


@query(rf"""SELECT doc_id, i AS item, 'calendar_event' AS type, 'Academic Calendar' AS title, p AS text FROM (SELECT doc_id, unnest(ps) AS p, unnest(range(len(ps))) AS i FROM
 (SELECT doc_id, list_filter(list_transform(string_split(coalesce(text, '') || chr(10) || 'Last Day of ' || source || chr(10) || 'No mark', chr(10)), lambda x: trim(regexp_replace(x, '[ \t]+', ' ', 'g'))), lambda x: x <> '') AS ps FROM documents)) WHERE regexp_matches(lower(p), '{"|".join(config.CALENDAR_WORDS)}')""")
def keyword_lines(spark, d):
    """Lines of a calendar in every document: one that is marked is added, and one that is not."""
    marked = F.concat(F.coalesce("text", F.lit("")), F.lit("\nLast Day of "), "source", F.lit("\nNo mark"))
    rows = records.calendar_lines(_t(spark, d, "documents").select(F.col("doc_id").alias("page"), marked.alias("text")))
    return rows.select(F.col("page").alias("doc_id"), F.col("item").cast("long").alias("item"), "type", "title", "text")


@query(r"""SELECT doc_id, i AS item, p AS text FROM (SELECT doc_id, unnest(ps) AS p, unnest(range(len(ps))) AS i FROM
 (SELECT doc_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(regexp_replace(x, '[ \t]+', ' ', 'g'))), lambda x: x <> '') AS ps FROM documents)) WHERE length(p) >= 3""")
def line_records(spark, d):
    return records.directory_lines(_t(spark, d, "documents").select(F.col("doc_id").alias("page"), "text")).select(F.col("page").alias("doc_id"), F.col("item").cast("long").alias("item"), "text")


CASE = "CASE " + " ".join(f"WHEN page BETWEEN {a} AND {b} THEN '{n}'" for n, a, b in config.SECTION_RANGES) + " ELSE 'unknown' END"
OUT = "(" + " OR ".join(f"page BETWEEN {a} AND {b}" for a, b in config.EXCLUDED_RANGES) + ")"
PAGE_SQL = "(SELECT *, cast(doc_id % 270 AS int) AS page FROM documents)"


@query(f"SELECT doc_id, page, {CASE} AS section FROM {PAGE_SQL}")
def section_lookup(spark, d):
    return sections.with_section(_pages(spark, d)).select("doc_id", "page", "section")


@query(f"SELECT CASE WHEN {OUT} THEN 'exclude' ELSE {CASE} END AS section, count(*) AS n_pages FROM {PAGE_SQL} GROUP BY 1")
def section_histogram(spark, d):
    return sections.histogram(_pages(spark, d))


@query(f"SELECT doc_id, page FROM {PAGE_SQL} WHERE NOT {OUT}")
def excluded_pages(spark, d):
    return sections.indexed_pages(_pages(spark, d)).select("doc_id", "page")


@query("SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY lower(trim(text, E' \\n\\t\\r')) ORDER BY doc_id) AS n FROM documents) WHERE n = 1")
def first_wins_dedup(spark, d):
    return documents.first_wins(_t(spark, d, "documents"), [F.lower(T.strip(F.col("text")))], ["doc_id"]).select("doc_id", "source")


def _course_pages(spark, d):
    """Pages with a course header for every part."""
    n = F.col("p_partkey")
    code = F.concat(F.lit("ABC "), F.lpad((n % 900 + 100).cast("string"), 3, "0"))
    text = F.concat(F.lit("Intro text. "), code, F.lit(" T"), F.col("p_name"), F.lit(" (3-0-"), (n % 4).cast("string"), F.lit("). About it. Prerequisites: XYZ "), (n % 800 + 100).cast("string"), F.lit(" and ABC 101; corequisite: QRS 999. ABC 200 Next (1.5-0-3). More."))
    return _t(spark, d, "part").select(n.cast("int").alias("page"), text.alias("text"))


COURSE_SQL = """SELECT p_partkey AS page, 0 AS item, 'ABC ' || (p_partkey % 900 + 100) AS course_code, 'T' || p_name AS title, '3-0-' || (p_partkey % 4) AS format,
 'About it. Prerequisites: XYZ ' || (p_partkey % 800 + 100) || ' and ABC 101; corequisite: QRS 999.' AS description, list_distinct(['XYZ ' || (p_partkey % 800 + 100), 'ABC 101']) AS p FROM part"""


@query(f"SELECT cast(page AS int) AS page, cast(item AS int) AS item, course_code, title, format, description FROM ({COURSE_SQL}) UNION ALL SELECT cast(p_partkey AS int), 1, 'ABC 200', 'Next', '1.5-0-3', 'More.' FROM part")
def header_extract(spark, d):
    return entities.courses(_course_pages(spark, d)).select("page", "item", "course_code", "title", "format", "description")


@query(f"SELECT cast(page AS int) AS page, unnest(['XYZ ' || (page % 800 + 100), 'ABC 101']) AS code FROM ({COURSE_SQL})")
def prerequisites(spark, d):
    return entities.courses(_course_pages(spark, d)).select("page", F.explode("prerequisites").alias("code"))


@query("SELECT 'courses' AS \"check\", 2 * count(*) AS value FROM part UNION ALL SELECT 'suspicious titles', 0 UNION ALL SELECT 'has ' || c, 0 FROM (SELECT unnest([" + ", ".join(f"'{c}'" for c in config.EXPECTED_CODES) + "]) AS c)")
def course_report(spark, d):
    return entities.report(entities.courses(_course_pages(spark, d)))


@query("SELECT p_partkey, length(t) BETWEEN 2 AND 160 AND NOT regexp_matches(lower(t), '" + "|".join(entities.PROSE) + r"') AND NOT regexp_matches(t, '\b[A-Z]{2,4}\s+\d{3}[A-Z]?\b') AND NOT suffix(t, ':') AS valid FROM (SELECT p_partkey, p_name || CASE p_partkey % 4 WHEN 0 THEN ':' WHEN 1 THEN ' ABC 101' WHEN 2 THEN ' students must' ELSE '' END AS t FROM part)")
def title_filter(spark, d):
    n = F.col("p_partkey") % 4
    t = F.concat("p_name", F.when(n == 0, ":").when(n == 1, " ABC 101").when(n == 2, " students must").otherwise(""))
    return _t(spark, d, "part").select("p_partkey", entities.valid_title(t).alias("valid"))


_TITLED = "(SELECT p_partkey, p_name || CASE p_partkey % 4 WHEN 0 THEN ':' WHEN 1 THEN ' ABC 101' WHEN 2 THEN ' students must' ELSE '' END AS t FROM part)"
_VALID = "length(t) BETWEEN 2 AND 160 AND NOT regexp_matches(lower(t), '" + "|".join(entities.PROSE) + r"') AND NOT regexp_matches(t, '\b[A-Z]{2,4}\s+\d{3}[A-Z]?\b') AND NOT suffix(t, ':')"
_CODED = [*config.EXPECTED_CODES[:-1], "ABC 100", "ABC 200"]


@query(f"""WITH r AS (SELECT {_CODED}[p_partkey % {len(_CODED)} + 1] AS code, {_VALID} AS valid FROM {_TITLED})
SELECT 'courses' AS "check", count(*) AS value FROM r UNION ALL SELECT 'suspicious titles', count(*) FILTER (NOT valid) FROM r
UNION ALL SELECT 'has ' || c, (SELECT count(*) FROM r WHERE code = c) FROM (SELECT unnest({config.EXPECTED_CODES}) AS c)""")
def course_checks(spark, d):
    """The report over courses of which many titles are suspicious and all expected codes but one are there."""
    n = F.col("p_partkey") % 4
    title = F.concat("p_name", F.when(n == 0, ":").when(n == 1, " ABC 101").when(n == 2, " students must").otherwise(""))
    code = F.element_at(tables.strings(_CODED), (F.col("p_partkey") % len(_CODED) + 1).cast("int"))
    return entities.report(_t(spark, d, "part").select(code.alias("course_code"), title.alias("title")))


@query("SELECT n_nationkey, '| Nation | Region | Key |' || chr(10) || '| --- | --- | --- |' || chr(10) || '| ' || n_name || ' | ' || r_name || ' |  |' AS markdown FROM nation JOIN region ON n_regionkey = r_regionkey")
def markdown_rows(spark, d):
    joined = _t(spark, d, "nation").join(_t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.select("n_nationkey", tables.markdown(tables.strings(["Nation", "Region", "Key"]), F.array(F.array("n_name", "r_name"))).alias("markdown"))


@query("SELECT s_suppkey AS page, s_name AS title, s_name || ' — ' || 'Office ' || s_nationkey || ', ' || s_suppkey AS text FROM supplier")
def directory_rows(spark, d):
    row = F.array(F.col("s_name"), F.lit(" "), F.concat(F.lit("Office "), F.col("s_nationkey").cast("string")), F.col("s_suppkey").cast("string"))
    rows = records.directory_rows(_t(spark, d, "supplier").select(F.col("s_suppkey").alias("page"), F.lit(0).alias("item"), row.alias("row")))
    return rows.select("page", "title", "text")


@query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'Notation|Meaning' WHEN 1 THEN 'Category|Grade|Grade Points' WHEN 2 THEN 'Fee|Amount' ELSE 'Majors|Engineering Math|Business Math|Architecture Math|Physics|English' END AS headers, cast(1 AS bigint) AS n_rows FROM orders")
def table_normalisers(spark, d):
    k = F.col("o_orderkey") % 4
    s = F.col("o_orderkey").cast("string")
    rows = F.when(k == 0, F.array(F.array(F.lit("AUD"), F.lit(""), F.concat(F.lit("Meaning "), s)))).when(k == 1, F.array(F.array(F.lit("Excellent"), F.lit("A equals"), F.lit("4.0")))).when(k == 2, F.array(F.array(F.lit("Fee"), F.lit("Amount")), F.array(F.lit("x"), s))).otherwise(F.array(F.array(F.lit("Required Placement Tests")), F.array(F.lit("Physics"), F.lit("Yes No Yes No Yes"))))
    made = _t(spark, d, "orders").select("o_orderkey", tables.normalised(rows).alias("t"))
    return made.select("o_orderkey", F.array_join("t.headers", "|").alias("headers"), F.size("t.rows").cast("long").alias("n_rows"))


@query(r"SELECT page_id, trim(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS title FROM pages")
def html_title_extract(spark, d):
    return _t(spark, d, "pages").select("page_id", T.strip(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("title"))


@query("SELECT doc_id, format('record_{:05d}', row_number() OVER (ORDER BY doc_id) - 1) AS id FROM documents")
def document_ids(spark, d):
    return documents.numbered(_t(spark, d, "documents").select("doc_id"), "doc_id", []).select("doc_id", F.format_string("record_%05d", "position").alias("id"))


@query("SELECT 'file ' || (doc_id % 2) AS file, doc_id AS page, coalesce(text, '') AS text, [source, lang] AS blocks FROM documents")
def page_files(spark, d):
    """Documents written as two indented files of pages and read again by the data source, in ranges of bytes."""
    at = folder(spark, "page-files")
    half = F.coalesce((F.col("doc_id") % 2).cast("string"), F.lit("none"))
    rows = _t(spark, d, "documents").select(half.alias("name"), F.to_json(F.struct(F.col("doc_id").cast("string").alias("page_num"), F.coalesce("text", F.lit("")).alias("content"), F.array(F.struct(F.col("source").alias("text")), F.struct(F.col("lang").alias("text"))).alias("blocks"))).alias("value"))
    rows.write.partitionBy("name").text(at)
    page_source.register(spark)
    out = spark.createDataFrame([], f"file string, {page_source.SCHEMA.partition('place int, ')[2]}")
    reader = spark.read.format("leafmill_pages").option("bytes", 1 << 20).option("blank", "keep").option("places", "false")
    for k in ("0", "1", "-1", "none"):
        if exists(spark, f"{at}/name={k}"):
            found = reader.load(f"{at}/name={k}").drop("place").withColumn("file", F.lit(None if k == "none" else f"file {k}").cast("string"))
            out = out.unionByName(found.withColumn("page", F.lit(None).cast("long")) if k == "none" else found)
    return out.select("file", "page", "text", F.transform("blocks", lambda b: b["text"]).alias("blocks"))


@query("""SELECT 'document' AS type, cast(doc_id AS varchar) AS id, coalesce(text, '') AS text FROM documents
 UNION ALL SELECT 'message', conv_id || '/' || turn, coalesce(text, '') FROM conversations""")
def unified_documents(spark, d):
    a = _t(spark, d, "documents").select(F.lit("document").alias("type"), F.col("doc_id").cast("string").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    b = _t(spark, d, "conversations").select(F.lit("message").alias("type"), F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    return a.unionByName(b)


CHUNK_SQL = rf"""WITH RECURSIVE t AS (SELECT doc_id, {CLEAN.format('text')} AS s FROM documents),
e(doc_id, s, a, b) AS (
  SELECT doc_id, s, 0, 0 FROM t WHERE s <> ''
  UNION ALL
  SELECT doc_id, s, nxt, CASE WHEN nxt + 1800 >= length(s) THEN length(s) ELSE nxt + CASE WHEN stop > 300 THEN stop + 1 ELSE 1800 END END
  FROM (SELECT *, list_max([0] || list_transform(range(1, 1800), lambda i: CASE WHEN substr(w, i, 2) IN ('. ', '? ', '! ') THEN i - 1 ELSE 0 END)) AS stop
    FROM (SELECT *, substr(s, nxt + 1, 1800) AS w FROM (SELECT doc_id, s, CASE WHEN b = 0 THEN 0 ELSE greatest(b - 250, a + 1) END AS nxt FROM e WHERE b < length(s)))))
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY a) - 1 AS ordinal, trim(substr(s, cast(a + 1 AS bigint), cast(b - a AS bigint)), E' \n\t') AS text FROM e WHERE b > 0"""


@query(CHUNK_SQL)
def chunk_text(spark, d):
    rows = chunking.chunks(_t(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"))
    return rows.select(F.col("document_id").alias("doc_id"), F.col("ordinal").cast("long").alias("ordinal"), "text")


@query(f"SELECT doc_id, ordinal, text FROM ({CHUNK_SQL})")
def chunk_table_function(spark, d):
    """Chunks by a table function in SQL."""
    udtf.register(spark)
    _t(spark, d, "documents").createOrReplaceTempView("leafmill_documents")
    return spark.sql("SELECT doc_id, cast(c.ordinal AS bigint) AS ordinal, c.text FROM leafmill_documents d, LATERAL chunk_text(d.text) c")


_ROW_DIGEST = "sha256(coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(text) || ':' || text, '-'))"
_LIMBS = "SELECT count(*) AS n, " + " || ".join(f"format('{{:08x}}', CAST(sum(('0x' || substr(h, {8 * i + 1}, 8))::BIGINT) % 4294967296 AS BIGINT))" for i in range(8)) + f" AS digest FROM (SELECT {_ROW_DIGEST} AS h FROM {{0}})"


@query(_LIMBS.replace("{0}", "documents"))
def content_digest(spark, d):
    """A digest of ids and texts that is the same in any order."""
    return _said(spark, digest.value(digest.digest(_t(spark, d, "documents"), "doc_id", "text")))


_EXCLAIMED = "(SELECT doc_id, CASE WHEN doc_id % 7 = 1 THEN text || '!' ELSE text END AS text FROM documents)"


@query(f"SELECT *, false AS fresh FROM ({_LIMBS.replace('{0}', _EXCLAIMED)})")
def digest_after_upsert(spark, d):
    """The digest of a store after an upsert, from the rows it adds and those it replaces."""
    docs = _t(spark, d, "documents").select("doc_id", "text")
    of = lambda rows: digest.value(digest.digest(rows, "doc_id", "text"))
    stored, old = of(docs), docs.where("doc_id % 7 = 1")
    now = digest.added(digest.added(stored, of(old), -1), of(old.withColumn("text", F.concat("text", F.lit("!")))))
    return _said(spark, now).withColumn("fresh", F.lit(now == stored))


def _said(spark, value):
    return spark.createDataFrame([(value[0], digest.text(value))], "n long, digest string")


@query("""SELECT cast(sum(n) AS bigint) AS n_ids, sha256(string_agg(s, '|' ORDER BY b)) AS signature FROM
 (SELECT substr(md5(id), 1, 3) AS b, count(*) AS n, sha256(string_agg(id, '|' ORDER BY id)) AS s FROM (SELECT cast(doc_id AS varchar) AS id FROM documents) GROUP BY 1)""")
def corpus_signature(spark, d):
    return lexical.signature(_t(spark, d, "documents").select(F.col("doc_id").alias("id")))


_SIGNED = "(SELECT sha256(string_agg(s, '|' ORDER BY b)) FROM (SELECT substr(md5(id), 1, 3) AS b, sha256(string_agg(id, '|' ORDER BY id)) AS s FROM (SELECT cast(doc_id AS varchar) AS id FROM documents WHERE {0}) GROUP BY 1))"


@query(f"SELECT {_SIGNED.format('true')} = {_SIGNED.format('doc_id IS NOT NULL')} AS fresh, {_SIGNED.format('true')} = {_SIGNED.format('doc_id > 0')} AS fresh_after_delete")
def index_freshness(spark, d):
    ids = _t(spark, d, "documents").select(F.col("doc_id").alias("id"))
    now, cut = lexical.signature(ids), lexical.signature(ids.where("id > 0"))
    again = lexical.signature(ids.repartition(3))
    a, b, c = (df.first().signature for df in (now, again, cut))
    return spark.createDataFrame([(a == b, a == c)], "fresh boolean, fresh_after_delete boolean")


@query("SELECT doc_id FROM documents WHERE doc_id % 3 <> 0")
def incremental_new(spark, d):
    ids = _t(spark, d, "documents").select(F.col("doc_id").alias("id"))
    return vectors.missing(ids, ids.where("id % 3 = 0")).select(F.col("id").alias("doc_id"))


@query("SELECT doc_id AS id, CASE WHEN doc_id % 3 = 1 THEN 'new' ELSE 'old' END AS version FROM documents")
def upsert(spark, d):
    ids = _t(spark, d, "documents").select(F.col("doc_id").alias("id"))
    return vectors.upserted(ids.withColumn("version", F.lit("old")), ids.where("id % 3 = 1").withColumn("version", F.lit("new")))


# words and fused codes as the tokens of the engine; the given texts hold next to no codes
_DOC = rf"doc AS MATERIALIZED (SELECT doc_id AS ord, list_concat({WORDS.format('text')}, list_transform(regexp_extract_all(lower(coalesce(text, '')), '\b[a-z]{{2,4}}[\s-]?\d{{3}}[a-z]{{0,2}}\b'), lambda x: regexp_replace(x, '[\s-]', '', 'g'))) AS t FROM documents)"
_POST = "post AS MATERIALIZED (SELECT term, ord, dl, count(*) AS tf FROM (SELECT ord, len(t) AS dl, unnest(t) AS term FROM doc) GROUP BY ALL)"
_STAT = "stat AS MATERIALIZED (SELECT count(*) AS n, sum(len(t)) AS tokens, sum(len(t)) / count(*) AS avgdl FROM doc)"
_VOC = "voc AS MATERIALIZED (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * avg(raw) OVER () ELSE raw END AS idf FROM (SELECT term, count(*) AS df, ln((SELECT n FROM stat) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM post GROUP BY term))"
_ASK = rf"ask AS MATERIALIZED (SELECT query_id, term, count(*) AS times FROM (SELECT item_id AS query_id, unnest({WORDS.format('text')}) AS term FROM benchmark) GROUP BY ALL)"
_SCORE = """score AS MATERIALIZED (SELECT query_id, ord, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / (SELECT avgdl FROM stat)))), 6) AS score FROM ask JOIN voc USING (term) JOIN post USING (term) GROUP BY ALL),
lex AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ord) AS rank FROM (SELECT query_id, ord, coalesce(score, 0.0) AS score FROM (SELECT item_id AS query_id, ord FROM benchmark, doc) LEFT JOIN score USING (query_id, ord))) WHERE rank <= 20)"""
_CORPUS_TABLES = f"{_DOC}, {_POST}, {_STAT}, {_VOC}"
BM25 = f"WITH {_CORPUS_TABLES}, {_ASK}, {_SCORE}"


@query(f"WITH {_DOC}, {_POST} SELECT term, ord, tf, cast(dl AS bigint) AS dl FROM post")
def postings(spark, d):
    return lexical.postings(_corpus(spark, d))


@query(f"WITH {_DOC}, {_POST}, {_STAT}, {_VOC} SELECT term, df, round(idf, 6) AS idf FROM voc")
def vocab_idf(spark, d):
    corpus = _corpus(spark, d)
    return lexical.vocabulary(lexical.postings(corpus), corpus.count()).select("term", "df", F.round("idf", 6).alias("idf"))


@query(f"WITH {_DOC}, {_STAT} SELECT n, cast(tokens AS bigint) AS tokens FROM stat")
def corpus_stats(spark, d):
    return lexical.corpus_stats(_corpus(spark, d))


def _lexical(spark, d):
    return lexical.search(_questions(spark, d), _corpus(spark, d), config.DEPTH)


@query(f"{BM25} SELECT query_id, ord, score, rank FROM lex")
def bm25_batch(spark, d):
    return _lexical(spark, d).select("query_id", "ord", "score", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {_DOC}, {_POST}, {_ASK} SELECT query_id, cast(count(*) AS bigint) AS postings, cast(count(DISTINCT (term, ord // 1024)) AS bigint) AS blocks FROM ask JOIN post USING (term) GROUP BY query_id")
def bm25_rows_read(spark, d):
    """What the blocks of postings save: a question's postings, and the rows that hold them."""
    return blocks.rows_read(_questions(spark, d), blocks.packed(lexical.postings(_corpus(spark, d))))


@query("SELECT item_id AS query_id, doc_id AS ord, 0.0::double AS score FROM benchmark, (SELECT doc_id FROM documents ORDER BY doc_id LIMIT 5)")
def bm25_zero_padding(spark, d):
    asked = _questions(spark, d).withColumn("text", F.lit("qqqqzzzz"))
    return lexical.search(asked, _corpus(spark, d), 5).select("query_id", "ord", "score")


_REVISED = "(SELECT doc_id, CASE WHEN doc_id % 13 = 2 THEN concat(coalesce(text, ''), ' third edition') WHEN doc_id % 7 = 1 THEN concat(coalesce(text, ''), ' revised edition') ELSE text END AS text FROM documents WHERE doc_id % 11 <> 3)"
_REVISED_TABLES = f"{_DOC.replace('FROM documents', f'FROM {_REVISED}')}, {_POST}, {_STAT}, {_VOC}"


def _segmented(spark, d) -> Segments:
    """Three batches: most documents; the others and revised ones; deletions and new revisions.  One comes again, then all are merged."""
    index = Segments(spark, folder(spark, "segments"))
    docs = _t(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("doc_id").alias("ord"), F.col("source").alias("type"), (F.col("doc_id") % 270).cast("int").alias("page"), F.lit(False).alias("deleted"), "text")
    said = lambda words: F.concat(F.coalesce("text", F.lit("")), F.lit(words))
    revised = docs.withColumn("text", F.when(F.col("id") % 7 == 1, said(" revised edition")).otherwise(F.col("text"))).where("id % 5 = 4 or id % 7 = 1")
    last = docs.withColumn("deleted", F.col("id") % 11 == 3).withColumn("text", said(" third edition")).where("deleted or id % 13 = 2")
    for epoch, batch in enumerate((docs.where("id % 5 <> 4"), revised, last)):
        index.apply(batch, epoch)
    index.apply(revised, 1)
    index.merge(tier=100)
    return index


@query(f"WITH {_REVISED_TABLES} SELECT term, df, round(idf, 6) AS idf FROM voc")
def segment_vocabulary(spark, d):
    """The vocabulary that deltas of batches add up to."""
    return _segmented(spark, d).index().vocabulary.select("term", "df", F.round("idf", 6).alias("idf"))


@query(f"WITH {_REVISED_TABLES}, {_ASK}, {_SCORE} SELECT query_id, ord, score, rank FROM lex")
def segment_search(spark, d):
    """A search over segments finds what one over the final documents does."""
    index = _segmented(spark, d).index()
    return lexical.search(_questions(spark, d), index.chunks, config.DEPTH, index=index.lexical).select("query_id", "ord", "score", F.col("rank").cast("long").alias("rank"))


def _vectors(spark, d):
    return _t(spark, d, "embeddings").select(F.col("vec_id").alias("ord"), F.col("embedding").alias("v"))


def _vector_queries(spark, d):
    """The vector of each question: the stored vector of its number."""
    return _questions(spark, d).join(_vectors(spark, d), F.col("query_id") == F.col("ord")).select("query_id", "v")


_NEAR = """near AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, ord) AS rank FROM (
 SELECT q.item_id AS query_id, v.vec_id AS ord, round(greatest(0.0, 1 - list_cosine_similarity(a.embedding::double[], v.embedding::double[])), 6) AS distance FROM benchmark q JOIN embeddings a ON a.vec_id = q.item_id, embeddings v)) WHERE rank <= 20)"""


@query(f"WITH {_NEAR} SELECT query_id, ord, distance, rank FROM near")
def cosine_batch(spark, d):
    return vectors.nearest(_vector_queries(spark, d), _vectors(spark, d), config.DEPTH).select("query_id", "ord", "distance", F.col("rank").cast("long").alias("rank"))


@query()
def cosine_hashed(spark, d):
    """Neighbours of every hundredth vector by the index."""
    stored = _vectors(spark, d)
    return vectors.nearest_in_cells(stored.where("ord % 100 = 0").select(F.col("ord").alias("query_id"), "v"), stored, config.DEPTH)


def _hundredth(spark, d):
    stored = _vectors(spark, d)
    return stored.where("ord % 100 = 0").select(F.col("ord").alias("query_id"), "v"), stored


@query()
def cosine_stored(spark, d):
    """Neighbours of every hundredth vector by the index that is written by cells."""
    asked, stored = _hundredth(spark, d)
    at = folder(spark, "cells")
    quantised.build(stored, at, config.DEPTH)
    return quantised.CellIndex(spark, at).nearest(asked, config.DEPTH)


@query("SELECT method, count(DISTINCT vec_id) AS queries, true AS reached FROM embeddings, (SELECT unnest(['cells', 'stored']) AS method) WHERE vec_id % 100 = 0 GROUP BY method")
def cosine_recall(spark, d):
    """Whether both indexes find nine of ten neighbours of every hundredth vector."""
    asked, stored = _hundredth(spark, d)
    exact = materialised(vectors.nearest(asked, stored, config.DEPTH))
    rows = {"cells": vectors.nearest_in_cells(asked, stored, config.DEPTH), "stored": cosine_stored(spark, d)}
    out = [quantised.recall(found, exact).select(F.lit(name).alias("method"), "queries", (F.col("share") >= 0.9).alias("reached")) for name, found in rows.items()]
    return out[0].unionByName(out[1])


_FUSED = """fused AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, seen) AS rank FROM (
 SELECT query_id, ord, round(sum(1.0::double / (60 + rank)), 10) AS rrf_score, min(m * 1000000 + rank) AS seen, max(CASE WHEN m = 0 THEN rank END) AS r0, max(CASE WHEN m = 1 THEN rank END) AS r1
 FROM (SELECT query_id, ord, rank, 0 AS m FROM lex UNION ALL SELECT query_id, ord, rank, 1 FROM near) GROUP BY query_id, ord))"""


def _both(spark, d):
    near = vectors.nearest(_vector_queries(spark, d), _vectors(spark, d), config.DEPTH)
    return _lexical(spark, d), near


@query(f"{BM25}, {_NEAR}, {_FUSED} SELECT query_id, ord, rrf_score, CASE WHEN r0 IS NOT NULL AND r1 IS NOT NULL THEN 'both' WHEN r0 IS NOT NULL THEN 'bm25' ELSE 'vector' END AS method, rank FROM fused WHERE rank <= 8")
def rrf_fusion(spark, d):
    return fusion.fuse(list(_both(spark, d))).select("query_id", "ord", "rrf_score", fusion.method_label(F.col("methods")).alias("method"), F.col("rank").cast("long").alias("rank"))


@query(f"{BM25}, {_NEAR}, {_FUSED} SELECT query_id, 'bm25' AS method, rank, ord FROM lex WHERE rank <= 8 UNION ALL SELECT query_id, 'vector', rank, ord FROM near WHERE rank <= 8 UNION ALL SELECT query_id, 'fused', rank, ord FROM fused WHERE rank <= 8")
def compare_methods(spark, d):
    return fusion.compare(*_both(spark, d))


def _hits(spark, d, k=config.RERANK_DEPTH):
    found = _lexical(spark, d).where(F.col("rank") <= k)
    docs = _t(spark, d, "documents").select(F.col("doc_id").alias("ord"), "text", F.col("source").alias("type"), (F.col("doc_id") % 270).cast("int").alias("page"))
    return found.join(docs, "ord")


_SET = rf"list_distinct({WORDS.format('{0}')})"


@query(rf"""{BM25}, s AS (SELECT query_id, ord, rank, round(len(list_intersect(qs, t)) / len(qs), 6) AS score FROM (SELECT lex.*, {_SET.format('b.text')} AS qs, doc.t AS t FROM lex JOIN benchmark b ON b.item_id = query_id JOIN doc USING (ord) WHERE rank <= 15))
SELECT * FROM (SELECT query_id, ord, score AS rerank_score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank) AS rerank_rank FROM s) WHERE rerank_rank <= 5""")
def rerank_overlap(spark, d):
    hits = _hits(spark, d).join(_questions(spark, d).select("query_id", F.col("text").alias("query")), "query_id")
    return fusion.rerank(hits).select("query_id", "ord", "rerank_score", F.col("rerank_rank").cast("long").alias("rerank_rank"))


@query(rf"""{BM25}, pair AS MATERIALIZED (SELECT query_id, ord, rank, {_SET.format('b.text')} AS qs, doc.t AS t FROM lex JOIN benchmark b ON b.item_id = query_id JOIN doc USING (ord) WHERE rank <= 15),
occ AS MATERIALIZED (SELECT query_id, ord, i, t[i] AS term FROM (SELECT query_id, ord, qs, t, unnest(range(1, len(t) + 1)) AS i FROM pair) WHERE list_contains(qs, t[i])),
nxt AS (SELECT a.query_id, a.ord, a.i, b.term, max(b.i) AS last FROM occ a JOIN occ b ON a.query_id = b.query_id AND a.ord = b.ord AND b.i <= a.i GROUP BY ALL),
win AS (SELECT query_id, ord, i, i - min(last) + 1 AS w, count(*) AS m FROM nxt GROUP BY query_id, ord, i),
least AS (SELECT query_id, ord, m, min(w) AS w FROM win JOIN (SELECT query_id, ord, max(m) AS m FROM win GROUP BY ALL) USING (query_id, ord, m) GROUP BY ALL),
s AS (SELECT query_id, ord, rank, round(coalesce(m / len(qs) * (1 + m / w) / 2, 0.0), 6) AS score FROM pair LEFT JOIN least USING (query_id, ord))
SELECT * FROM (SELECT query_id, ord, score AS rerank_score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank) AS rerank_rank FROM s) WHERE rerank_rank <= 5""")
def rerank_proximity(spark, d):
    """The default reranker: how many of the question's terms a text has, and how close together."""
    hits = _hits(spark, d).join(_questions(spark, d).select("query_id", F.col("text").alias("query")), "query_id")
    return fusion.rerank(hits, by=fusion.proximity).select("query_id", "ord", "rerank_score", F.col("rerank_rank").cast("long").alias("rerank_rank"))


_BLOCK = """blk AS (SELECT *, sum(length(block)) OVER (PARTITION BY query_id ORDER BY rank) AS cum FROM (SELECT query_id, rank, doc_id % 270 AS page, source, '[p. ' || (doc_id % 270) || '] ' || coalesce(text, '') AS block FROM lex JOIN documents ON ord = doc_id WHERE rank <= 8)),
fit AS (SELECT * FROM blk WHERE rank = 1 OR cum <= 9000)"""


@query(f"{BM25}, {_BLOCK} SELECT query_id, string_agg(block, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS context, count(*) AS n_blocks FROM fit GROUP BY query_id")
def context_pack(spark, d):
    return answer.contexts(_hits(spark, d, config.TOP_N))


@query(f"{BM25}, {_BLOCK}, one AS (SELECT query_id, page, source, min(rank) AS rank FROM fit GROUP BY ALL) SELECT query_id, 'Sources:' || chr(10) || string_agg('- ' || source || ' (p. ' || page || ') [bm25]', chr(10) ORDER BY page, rank) AS footer FROM one GROUP BY query_id")
def sources_footer(spark, d):
    null = F.lit(None).cast("string")
    return answer.footers(answer.packed(_hits(spark, d, config.TOP_N)).select("query_id", "rank", "page", null.alias("course_code"), F.lit("").alias("title"), "type", F.array(F.lit("bm25")).alias("methods")))


@query("SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 6")
def history_tail(spark, d):
    return answer.history_tail(_t(spark, d, "conversations")).select("conv_id", "turn", "role", "text")


def _asked(spark, d):
    convs = _t(spark, d, "conversations").select("conv_id").distinct()
    return convs.withColumn("query", F.concat(F.lit("what about "), F.col("conv_id").cast("string")))


@query("""SELECT conv_id, CASE WHEN last IS NULL OR trim(last, E' \\n\\t') = '' THEN q ELSE last || ' ' || q END AS retrieval_query FROM
 (SELECT conv_id, 'what about ' || conv_id AS q, arg_max(text, turn) FILTER (role = 'user') AS last FROM conversations GROUP BY conv_id)""")
def retrieval_query(spark, d):
    return answer.retrieval_queries(_asked(spark, d), _t(spark, d, "conversations")).select("conv_id", "retrieval_query")


@query("SELECT conv_id, cast(least(count(*), 6) + 2 AS bigint) AS n_messages, 'system' AS first_role, 'Excerpts:' || chr(10) || chr(10) || 'ctx' || chr(10) || chr(10) || '---' || chr(10) || chr(10) || 'Question: what about ' || conv_id AS last_content FROM conversations GROUP BY conv_id")
def messages(spark, d):
    made = answer.messages(_asked(spark, d).withColumn("context", F.lit("ctx")), _t(spark, d, "conversations"))
    return made.select("conv_id", F.size("messages").cast("long").alias("n_messages"), F.col("messages")[0]["role"].alias("first_role"), F.element_at("messages", -1)["content"].alias("last_content"))


@query("SELECT conv_id, string_agg(CASE WHEN role = 'user' THEN '**You**' ELSE '**Assistant**' END || ': ' || coalesce(text, ''), chr(10) || chr(10) ORDER BY turn, text) AS transcript, count(*) AS n_messages FROM conversations GROUP BY conv_id")
def transcript(spark, d):
    return answer.transcripts(_t(spark, d, "conversations"))


@query("SELECT conv_id, turn, role FROM conversations c WHERE turn < coalesce((SELECT max(turn) FROM conversations u WHERE u.conv_id = c.conv_id AND role = 'user'), 1000000000)")
def regenerate_history(spark, d):
    return answer.before_regeneration(_t(spark, d, "conversations")).select("conv_id", "turn", "role")


@query("SELECT cast(d.doc_id AS varchar) AS id, '' AS document_id, coalesce(source, '') AS type, coalesce(lang, '') AS section, cast(coalesce(quality, 0) AS bigint) AS page, '' AS course_code, 'T' || toxic AS title_or, '' AS format, '' AS prerequisites FROM documents d LEFT JOIN labels l USING (doc_id)".replace("'T' || toxic AS title_or", "coalesce('T' || toxic, '') AS title"))
def flatten_metadata(spark, d):
    null = F.lit(None).cast("string")
    joined = _t(spark, d, "documents").join(_t(spark, d, "labels"), "doc_id", "left")
    meta = F.struct(null.alias("course_code"), F.concat(F.lit("T"), F.col("toxic").cast("string")).alias("title"), null.alias("format"), F.expr("cast(null as array<string>)").alias("prerequisites"))
    return documents.flat_metadata(joined.select(F.col("doc_id").cast("string").alias("id"), null.alias("document_id"), F.col("source").alias("type"), F.col("lang").alias("section"), F.col("quality").alias("page"), null.alias("course_code"), F.lit("").alias("title"), meta.alias("metadata")))


@query("SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS filled, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_event FROM events")
def fill_and_boundary(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return _t(spark, d, "events").select("event_id", F.last(F.when(F.col("event_type") == "purchase", F.col("value")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("filled"), F.lead("event_id").over(w).alias("next_event"))


def _grid(spark, d):
    """Events as words on pages: a page for each user, places from id and value."""
    e = _t(spark, d, "events").where("value is not null")
    return e.select(F.col("user_id").alias("page"), F.col("event_id").cast("string").alias("text"), (F.col("event_id") % 500).cast("double").alias("x0"), (F.col("event_id") % 500 + 20).cast("double").alias("x1"), F.round(F.col("value") % 700, 3).alias("top"))


@query("""WITH r AS (SELECT page, array_agg(top ORDER BY top) AS ys FROM (SELECT DISTINCT user_id AS page, cast(floor(value % 700 / 100) * 100 AS double) AS top FROM events WHERE value IS NOT NULL) GROUP BY page),
b AS (SELECT page, unnest(range(len(ys) - 1)) AS band, ys FROM r WHERE len(ys) > 1)
SELECT b.page, cast(band AS bigint) AS band, count(*) AS n_words FROM b JOIN (SELECT user_id AS page, round(value % 700, 3) AS top FROM events WHERE value IS NOT NULL) w ON w.page = b.page AND top > ys[band + 1] + 0.5 AND top < ys[band + 2] - 0.5 GROUP BY ALL""")
def band_range_join(spark, d):
    words = _grid(spark, d)
    raw = _t(spark, d, "events").where("value is not null").select(F.col("user_id").alias("page"), (F.floor(F.col("value") % 700 / 100) * 100).cast("double").alias("top")).distinct()
    rects = raw.select("page", F.lit(0.0).alias("x0"), F.lit(600.0).alias("x1"), "top", F.lit(0.5).alias("height"))
    panels = words.select("page").distinct().select("page", F.lit(0).alias("panel"), F.lit(0.0).alias("left"), F.lit(600.0).alias("right"))
    inside = layout.words_in_bands(words, layout.bands(layout.panel_rules(rects, panels)), panels)
    return inside.groupBy("page", F.col("band").cast("long").alias("band")).agg(F.count(F.lit(1)).alias("n_words"))


@query("""SELECT page, id, "column", row_number() OVER (PARTITION BY page ORDER BY "column", y, x, id) AS position FROM (SELECT page, id, y, x, CASE WHEN c < 0.34 THEN 0 WHEN c < 0.67 THEN 1 ELSE 2 END AS "column" FROM
 (SELECT cast(label AS bigint) AS page, vec_id AS id, cast(vec_id % 7 AS double) AS y, cast(vec_id % 500 AS double) AS x, (vec_id % 500 + 10.0) / max(vec_id % 500 + 20.0) OVER (PARTITION BY label) AS c FROM embeddings))""")
def column_bucket_order(spark, d):
    x = (F.col("vec_id") % 500).cast("double")
    blocks = _t(spark, d, "embeddings").select(F.col("label").cast("long").alias("page"), F.col("vec_id").alias("ord"), x.alias("x0"), (x + 20).alias("x1"), (F.col("vec_id") % 7).cast("double").alias("y0"), F.lit("b").alias("text"))
    return layout.reading_order(blocks).select("page", F.col("ord").alias("id"), F.col("column").cast("int").alias("column"), F.col("position").cast("long").alias("position"))


@query("""WITH RECURSIVE v AS (SELECT user_id AS page, round(value % 700, 3) AS top, event_id, row_number() OVER (PARTITION BY user_id ORDER BY round(value % 700, 3), event_id) AS n FROM events WHERE value IS NOT NULL),
f(page, n, line, anchor) AS (SELECT page, n, 0, top FROM v WHERE n = 1 UNION ALL SELECT v.page, v.n, CASE WHEN v.top - anchor > 3 THEN line + 1 ELSE line END, CASE WHEN v.top - anchor > 3 THEN v.top ELSE anchor END FROM f JOIN v ON v.page = f.page AND v.n = f.n + 1)
SELECT page, cast(line AS bigint) AS line, count(*) AS n_words FROM f GROUP BY ALL""")
def anchored_lines(spark, d):
    return layout.words_in_lines(_grid(spark, d)).groupBy("page", F.col("line").cast("long").alias("line")).agg(F.count(F.lit(1)).alias("n_words"))


@query("""WITH RECURSIVE v AS (SELECT user_id AS page, round(value % 700, 3) AS top, row_number() OVER (PARTITION BY user_id ORDER BY round(value % 700, 3), event_id) AS n FROM events WHERE value IS NOT NULL),
f(page, n, kept, last) AS (SELECT page, n, 1, top FROM v WHERE n = 1 UNION ALL SELECT v.page, v.n, CASE WHEN v.top - last > 1 THEN 1 ELSE 0 END, CASE WHEN v.top - last > 1 THEN v.top ELSE last END FROM f JOIN v ON v.page = f.page AND v.n = f.n + 1)
SELECT page, cast(sum(kept) AS bigint) AS n_rules FROM f GROUP BY page""")
def rule_thinning(spark, d):
    pages = _grid(spark, d).groupBy("page").agg(F.array_sort(F.collect_list("top")).alias("ys"))
    return pages.select("page", F.size(layout.thinned(F.col("ys"))).cast("long").alias("n_rules"))


@query("SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, 'retrieval ' || printf('%.2f', 1.5) || 's · total ' || printf('%.2f', count(*) / 4.0) || 's' AS caption FROM events GROUP BY event_type")
def timing_stats(spark, d):
    by = _t(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"))
    return by.select("*", answer.timing(F.lit(1.5), F.lit(None).cast("double"), F.col("n") / F.lit(4.0)).alias("caption"))


@query()
def answers(spark, d):
    """The whole engine: chunks of all documents, both indexes, fusion, context, footer and default answer."""
    docs = _pages(spark, d)
    chunks = chunking.chunks(docs.select(F.col("doc_id").alias("id"), F.col("page"), F.lit("prose").alias("type"), F.lit(None).cast("string").alias("course_code"), F.lit("").alias("title"), "text"))
    numbered = documents.numbered(chunks, "document_id", ["ordinal"], "ord")
    got = plan.index_of(numbered.select("ord", "id", "page", "type", "course_code", "title", "text")).answer(_questions(spark, d))
    return got.select("query_id", "retrieval_query", "context", "answer", "footer", F.array_join("chunks_used", ",").alias("chunks_used"))


_PARTS = rf"list_filter(list_transform(string_split_regex(coalesce(text, ''), '{{0}}'), lambda x: {CLEAN.format('x')}), lambda x: x <> '')"
_ROUTED = f"""page AS (SELECT page, text, {CASE} AS section FROM {PAGE_SQL} WHERE NOT {OUT}),
line AS (SELECT page, section, unnest({_PARTS.format(chr(92) + 'n')}) AS text, unnest(range(len({_PARTS.format(chr(92) + 'n')}))) AS item FROM page WHERE section = 'directory' OR page BETWEEN 18 AND 19),
para AS (SELECT page, section, unnest({_PARTS.format(chr(92) + 'n' + chr(92) + 's*' + chr(92) + 'n')}) AS text, unnest(range(len({_PARTS.format(chr(92) + 'n' + chr(92) + 's*' + chr(92) + 'n')}))) AS item FROM page WHERE section NOT IN ('courses', 'directory') AND page NOT BETWEEN 18 AND 19),
rec AS (
  SELECT page, item, 'calendar_event' AS type, NULL AS section, text FROM line WHERE section <> 'directory' AND regexp_matches(lower(text), '{"|".join(config.CALENDAR_WORDS)}')
  UNION ALL SELECT page, item, 'directory', NULL, text FROM line WHERE section = 'directory' AND length(text) >= 3
  UNION ALL SELECT page, item, 'faculty', NULL, text FROM para WHERE section = 'faculty' AND length(text) >= 10
  UNION ALL SELECT page, item, 'general_prose', section, text FROM para WHERE section <> 'faculty' AND (length(text) >= 100 OR length(text) >= 40 AND regexp_matches(text, '[.!?]')))"""


@query(rf"""WITH {_ROUTED}, one AS (SELECT type, page, lower(text) AS low, min(struct_pack(item := item, text := text)) AS first, any_value(section) AS section FROM rec GROUP BY ALL)
SELECT format('record_{{:05d}}', row_number() OVER (ORDER BY page, first.item, type, first.text) - 1) AS id, type, coalesce(section, 'unknown') AS section, cast(page AS bigint) AS page, cast(NULL AS varchar) AS course_code, cast(NULL AS varchar) AS title, first.text AS text FROM one""".replace("GROUP BY ALL", "GROUP BY type, page, lower(text)"))
def catalogue_documents(spark, d):
    """Documents built from pages: routed, extracted, deduplicated, numbered.  The given texts hold no courses."""
    return plan.documents_of(_pages(spark, d).select("page", "text")).select("id", "type", "section", "page", "course_code", "title", "text")


@query("SELECT 'First Year' AS year, cast(12 + s_suppkey % 9 AS int) AS year_credit_hours, s_suppkey AS page, 'page_' || s_suppkey || '_curriculum_1' AS table_id, 'ABC ' || (100 + s_suppkey % 900) AS code, 'Fall' AS term FROM supplier")
def curriculum_pages(spark, d):
    """A curriculum page for every supplier, as words and rules, read back as a table."""
    n = F.col("s_suppkey")
    at = lambda text, x, top: F.struct(text.alias("text"), F.lit(float(x)).alias("x0"), F.lit(float(x) + 8).alias("x1"), F.lit(float(top)).alias("top"))
    head = [at(F.lit(w), 10 + 20 * i, 50) for i, w in enumerate(["FIRST", "YEAR"])] + [at(F.concat(F.lit("("), (n % 9 + 12).cast("string")), 50, 50), at(F.lit("credit"), 70, 50), at(F.lit("hours)"), 90, 50)]
    names = [at(F.lit(w), x, 70) for w, x in (("Term", 10), ("Course", 60), ("#", 75), ("Course", 120), ("Title", 140), ("Credit", 250), ("Hours", 262))]
    body = [at(F.lit("Fall"), 10, 90), at(F.lit("ABC"), 60, 90), at((n % 900 + 100).cast("string"), 70, 90), at(F.lit("Topic"), 120, 90), at(F.lit("3"), 250, 90)]
    suppliers = _t(spark, d, "supplier").select(n.alias("page"), F.array(*head, *names, *body).alias("w"))
    words = suppliers.select("page", F.explode("w").alias("w")).select("page", "w.*")
    rects = suppliers.select("page", F.lit(5.0).alias("x0"), F.lit(290.0).alias("x1"), F.explode(F.array(F.lit(82.0), F.lit(102.0))).alias("top"), F.lit(0.5).alias("height"))
    sizes = suppliers.select("page", F.lit(600.0).alias("width"), F.lit(800.0).alias("height"))
    raw = suppliers.select("page", F.lit(0).alias("table_index"), F.array(F.array(F.lit("not"), F.lit("read"))).alias("rows"))
    found = extraction.page_tables(words, rects, sizes, raw)
    return found.select("year", "year_credit_hours", "page", "table_id", F.col("rows")[0][1].alias("code"), F.col("rows")[0][0].alias("term"))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Questions to packed context by BM25."""
    return context_pack(spark, d)
