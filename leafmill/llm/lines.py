"""Operator 3 [native]: line dedup by site-relative frequency.

Pages are grouped by host.  The pages of a host that contain a line, divided by the pages of the
host, are the line's frequency there; a line above the ratio (on a host with enough pages) is
boilerplate and every occurrence on that host goes.

The lines above a ratio r are fewer on a host than its mean number of distinct lines a page
divided by r, so the list of one host is small.  Tables by host (page totals and these lists) are written, and
their size is checked: up to LIST_BYTES they are broadcast; beyond, rows are joined by host and
one of SALTS parts of it, so that a hot host is spread over as many tasks.  Lines are known by 128 bits, of which
64 are looked up in a hash set first.

Defined cases: a null or unusable url is the host ''; a null or empty page has no lines; a page of any length is
treated whole; a line that repeats within a page counts once for it; a line exactly at the ratio stays; repeated
rows and rows with a null id are pages of their own; an empty table gives no rows; further columns, whatever their
names, are ignored by ``analyse``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

RATIO, MIN_PAGES = 0.2, 5
LIST_BYTES, SALTS = 32 << 20, 64
#: Script, style and comments go; so do tags inside a line.  Any other tag ends a line.
DROPPED = r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->|</?(?:a|b|i|em|span|strong|u|small|sup|sub|code|font)(?:\s[^>]*)?>"
BREAK = r"<[^>]*>|[\r\n]"


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def lines_of(html: Column) -> Column:
    """Lines of text, trimmed, inner blanks as they are, none of them empty."""
    parts = F.split(F.regexp_replace(F.coalesce(html.cast("string"), F.lit("")), DROPPED, ""), BREAK)
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != F.lit(""))


def key_of(line: Column) -> Column:
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit("line"), line).alias("b"))


def with_host(rows: DataFrame, hosts: DataFrame, spread: list[str], size: Column, list_bytes: int, how: str = "inner") -> DataFrame:
    """rows joined by host with a table by host that was written; spread: columns that tell a host's rows apart."""
    if (hosts.agg(F.sum(size)).first()[0] or 0) <= list_bytes:
        return rows.join(F.broadcast(hosts), "host", how)
    salted = hosts.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("__salt", F.pmod(F.xxhash64(*spread), F.lit(SALTS)).cast("int")).join(salted, ["host", "__salt"], how).drop("__salt")


def boilerplate(pages: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES, list_bytes: int = LIST_BYTES) -> DataFrame:
    """host, keys: the 128-bit keys of the host's boilerplate lines."""
    hosts = pages.select(host_of(F.col("url")).alias("host"))
    totals = written(hosts.groupBy("host").agg(F.count(F.lit(1)).alias("pages")), "hosts")
    keyed = pages.select(host_of(F.col("url")).alias("host"), F.explode(F.array_distinct(lines_of(F.col("html")))).alias("line")).select("host", key_of(F.col("line")).alias("key"))
    having = keyed.groupBy("host", "key").agg(F.count(F.lit(1)).alias("n"))
    # a line above the ratio is on min_pages * ratio pages at least: drop the many rare ones before the join
    having = having.where(F.col("n") > F.lit(min_pages * ratio))
    common = with_host(having, totals.where(F.col("pages") >= min_pages), ["key"], F.octet_length("host") + 8, list_bytes)
    return common.where(F.col("n") > F.col("pages") * F.lit(ratio)).groupBy("host").agg(F.array_sort(F.collect_list("key")).alias("keys"))


def analyse(pages: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES, list_bytes: int = LIST_BYTES) -> DataFrame:
    """page_id, host, n_lines, n_dropped and the text that stays, for every row."""
    lists = written(boilerplate(pages, ratio, min_pages, list_bytes), "boilerplate")
    lined = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), lines_of(F.col("html")).alias("lines"))
    joined = with_host(lined, lists, ["page_id", "url"], F.octet_length("host") + 24 * F.size("keys"), list_bytes, "left")
    # the first halves of the page's boilerplate lines, by hash sets; then the whole keys
    seen = F.array_intersect(F.transform("lines", lambda x: F.xxhash64(x)), F.transform("keys", lambda k: k["a"]))
    drop = lambda x: F.array_contains(F.col("seen"), F.xxhash64(x)) & F.array_contains(F.col("keys"), key_of(x))
    joined = joined.withColumn("seen", seen)
    kept = F.when(F.coalesce(F.size("seen"), F.lit(0)) <= 0, F.col("lines")).otherwise(F.filter("lines", lambda x: ~drop(x)))
    return joined.withColumn("kept", kept).select(
        "page_id", "host", F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size("kept")).cast("long").alias("n_dropped"), F.array_join("kept", "\n").alias("text")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyse(table(spark, sf_dir, "pages"))


SQL = rf"""
WITH lined AS (
  SELECT row_number() OVER () AS rid, page_id,
    coalesce(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '') AS host,
    list_filter(list_transform(string_split_regex(regexp_replace(coalesce(html, ''), '{DROPPED}', '', 'g'), '{BREAK}'), lambda x: trim(x, ' ')), lambda x: x <> '') AS lines
  FROM pages),
totals AS (SELECT host, count(*) AS pages FROM lined GROUP BY host),
having_line AS (SELECT host, line, count(*) AS n FROM (SELECT host, unnest(list_distinct(lines)) AS line FROM lined) GROUP BY host, line),
common AS (
  SELECT having_line.host, list(line) AS bad FROM having_line JOIN totals USING (host)
  WHERE pages >= {MIN_PAGES} AND n > pages * {RATIO} GROUP BY having_line.host),
kept AS (SELECT lined.*, list_filter(lines, lambda x: NOT list_contains(coalesce(bad, []), x)) AS rest FROM lined LEFT JOIN common USING (host))
SELECT page_id, host, cast(len(lines) AS bigint) AS n_lines, cast(len(lines) - len(rest) AS bigint) AS n_dropped, array_to_string(rest, chr(10)) AS text
FROM kept
"""
