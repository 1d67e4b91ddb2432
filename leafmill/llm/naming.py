"""Operator 12: exact duplicates by deterministic block naming.

A text's key is its bytes without blanks.  The key is cut into blocks of BLOCK bytes; all blocks of all texts are
sorted, and equal blocks get one integer, their name.  Names next to each other are paired (the last of an odd
number with nothing), the pairs are sorted and named in turn, and so on, until each text has one name.  Two texts end
at the same level with the same name exactly where they are equal: nothing is hashed, so nothing collides.

Rows are sorted by ranges of (block, place), so equal blocks may lie in several ranges and a frequent one is
no single task's; a range that begins with the block its neighbour ends with takes its first name from there.
A range's first and last value are all that comes to the driver: two of at most BLOCK bytes a range.

Defined cases: a null text counts as empty; empty keys are equal to each other; a text of any length is treated whole; of
equal texts the one with the most code points stays, then the one with the least id (null ids last), then any one of
rows that agree in both; repeated rows are rows of one group; an empty table gives no rows; further columns, whatever their
names, are ignored by ``groups`` and kept by ``one_of_each``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, dropped, looked_up, table, text_or_empty, written

#: Bytes of a block; a text of up to so many has its name after one sort.
BLOCK = 1024
#: A name: 6 bits of its level, 21 of the range it comes from, 36 of its number there.
LEVEL_BITS, RANGE_BITS = 57, 36
#: The name of a text without any block.
EMPTY = -1
BLANKS = " \t\n\x0b\x0c\r"


def keyed(docs: DataFrame, *more: Column) -> DataFrame:
    """rid (a number of each row), doc_id, points (code points of the text), key (its bytes without blanks), text_sha256 (of the key), more."""
    text = text_or_empty()
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", F.length(text).alias("points"), F.translate(text, BLANKS, "").cast("binary").alias("key"), *more)
    return rows.withColumn("text_sha256", F.sha2("key", 256))


def _ranged(rows: DataFrame, values: list[str]) -> DataFrame:
    """rid, n, idx, part, rank: the rank among the distinct values of its range; and a row for the ends of each range.

    The rows of ends have no rid; rank is their range's last rank, first and last its first and last values.
    """
    kinds = [dict(rows.dtypes)[v].replace("bigint", "long") for v in values]
    ends = [f"{e}_{v} {k}" for e in ("first", "last") for v, k in zip(values, kinds, strict=True)]
    names = ["rid", "n", "idx", "part", "rank", *(e.split()[0] for e in ends)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = part = None
        rank = 0
        for b in batches:
            if not b.num_rows:
                continue
            columns = [b.column(v) for v in values]
            new = np.zeros(b.num_rows, bool)
            for c in columns:
                new[1:] |= _differ(c.slice(1), c.slice(0, b.num_rows - 1))
            if last is None:
                first, part = [c.slice(0, 1) for c in columns], b.column("part")[0]
            else:
                new[0] = any(_differ(c.slice(0, 1), x)[0] for c, x in zip(columns, last, strict=True))
            ranks = rank + np.cumsum(new)
            rank, last = int(ranks[-1]), [c.slice(b.num_rows - 1) for c in columns]
            none = [pa.nulls(b.num_rows, c.type) for c in columns * 2]
            yield pa.RecordBatch.from_arrays([b.column("rid"), b.column("n"), b.column("idx"), b.column("part"), pa.array(ranks, pa.int64()), *none], names=names)
        if last is not None:
            none = pa.nulls(1, pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, none, pa.array([part.as_py()], pa.int32()), pa.array([rank], pa.int64()), *first, *last], names=names)

    bounded_batches(rows.sparkSession)
    spread = F.xxhash64("rid", "idx")
    dealt = rows.withColumn("spread", spread).repartitionByRange(*values, "spread").sortWithinPartitions(*values)
    dealt = dealt.select("rid", "n", "idx", *values, F.spark_partition_id().alias("part"))
    return dealt.mapInArrow(run, f"rid long, n long, idx long, part int, rank long, {', '.join(ends)}")


def _differ(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Where two columns differ; a null is a value like others."""
    same = pc.or_kleene(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a), pc.is_null(b)))
    return ~same.to_numpy(zero_copy_only=False)


def named(rows: DataFrame, values: list[str], level: int) -> tuple[DataFrame, DataFrame]:
    """rid, n, idx, name of rows (rid, n, idx, values): equal values have one name; and the table that is read for it."""
    ranged = written(_ranged(rows, values), "naming-ranks")
    # a row for each range: the ends of neighbours tell which name a run over several ranges has
    before, carried = None, []
    for r in ranged.where("rid is null").drop("rid", "n", "idx").orderBy("part").collect():
        first, last = ([r[f"{e}_{v}"] for v in values] for e in ("first", "last"))
        base = r.part << RANGE_BITS
        if before is not None and before[0] == first:
            carried.append((r.part, before[1]))
            first_name = before[1]
        else:
            first_name = base
        before = last, base + r["rank"] if r["rank"] else first_name
    spark = rows.sparkSession
    carry = F.broadcast(spark.createDataFrame(carried, "part int, carried long"))
    own = F.shiftleft(F.col("part").cast("long"), RANGE_BITS) + F.col("rank")
    name = F.when((F.col("rank") == 0) & F.col("carried").isNotNull(), F.col("carried")).otherwise(own)
    out = ranged.where("rid is not null").join(carry, "part", "left")
    return out.select("rid", "n", "idx", (name + F.lit(level << LEVEL_BITS)).alias("name")), ranged


def names(rows: DataFrame, block: int = BLOCK) -> tuple[DataFrame, list[DataFrame]]:
    """rid, name of every row (rid, key): names are equal where keys are; and the tables that are read for it."""
    n = F.ceil(F.length("key") / block).cast("long")
    cut = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.substring("key", (i * block + 1).cast("int"), F.lit(block)))
    now = rows.where(F.length("key") > 0).select("rid", n.alias("n"), F.posexplode(cut).alias("idx", "block"))
    out = rows.where(F.length("key") == 0).select("rid", F.lit(EMPTY).cast("long").alias("name"))
    now, values, level, tables = now.withColumn("idx", F.col("idx").cast("long")), ["block"], 0, []
    while True:
        now, ranged = named(now, values, level)
        tables.append(ranged)
        out = out.unionByName(now.where("n = 1").select("rid", "name"))
        if ranged.where("n > 1").isEmpty():
            return out, tables
        even = F.col("idx") % 2 == 0
        now = now.where("n > 1").groupBy("rid", "n", F.shiftright("idx", 1).alias("pair")).agg(F.max(F.when(even, F.col("name"))).alias("a"), F.max(F.when(~even, F.col("name"))).alias("b"))
        now = now.select("rid", F.ceil(F.col("n") / 2).alias("n"), F.col("pair").alias("idx"), "a", "b")
        values, level = ["a", "b"], level + 1


def groups(docs: DataFrame, block: int = BLOCK, *more: Column) -> DataFrame:
    """rid, doc_id, keep_id, group_size, kept, text_sha256 and more for every row of docs; no text is moved for it but by ``names``."""
    rows = written(keyed(docs, *more), "naming-rows")
    found, tables = names(rows.select("rid", "key"), block)
    found = written(found, "naming-names")
    dropped(*tables)
    facts = rows.select("rid", "doc_id", "points").join(found, "rid")
    best = F.min(F.struct((-F.col("points")).alias("points"), F.col("doc_id").isNull().alias("none"), "doc_id", "rid"))
    each = facts.groupBy("name").agg(best.alias("top"), F.count(F.lit(1)).alias("n"))
    each = written(each.select("name", F.struct("top.doc_id", "top.rid", "n").alias("group"), "n"), "naming-groups")
    known = looked_up(found, each, "name", "group", "rid", found.count()).select("rid", "group")
    out = rows.drop("key", "points").join(known, "rid")
    return out.select(*(c for c in out.columns if c != "group"), F.col("group.doc_id").alias("keep_id"), F.col("group.n").alias("group_size"), (F.col("group.rid") == F.col("rid")).alias("kept"))


def report(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row."""
    return groups(docs, block).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def one_of_each(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """The rows that stay, with all their columns."""
    return groups(docs, block, F.struct("*").alias("doc")).where("kept").select("doc.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"))


SQL = r"""
WITH row AS (SELECT row_number() OVER () AS rid, doc_id, length(coalesce(text, '')) AS points, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
placed AS (
  SELECT *, row_number() OVER w AS place, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size
  FROM row WINDOW w AS (PARTITION BY norm ORDER BY points DESC, doc_id NULLS LAST, rid))
SELECT doc_id, keep_id, group_size, place = 1 AS kept, sha256(norm) AS text_sha256 FROM placed
"""
