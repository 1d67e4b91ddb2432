"""Operator 2: sharding by a hierarchical weighted hash tree.

A document descends region, rack and shard.  At each level every child draws
``-ln(u) / weight`` with u hashed from the document's id and the child's name, and the least draw
wins.  A child's draw depends on nothing but the id, its name and its weight, so a change of
weights below one node moves documents only into (or out of) the nodes whose weight changed.
A shard that is added beyond the planned tree opens a region of its own, whose only leaf it is:
the documents that move go to it and to no other shard.

Defined cases: a null id is placed as the empty string; equal ids share a shard; a null text has
size 1 and the crc of no bytes; a text of any length is taken whole; rows that agree in id, crc and size are alike, so
their order among their slots carries no meaning: ``assign`` numbers them as one row with a count, ``place``, which has to
keep the other columns of each, in one task; equal draws, which 52 bits all but rule out, go to the first child; an
empty table gives no rows; further columns, whatever their names, are ignored by ``assign`` and kept by ``place``, but
for shard and slot, which it replaces.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, text_or_empty

SHARDS = 16
#: Shards in a rack and racks in a region of the planned tree.
RACK, REGION = 2, 2
#: Blocks of all shards that are numbered on their own, at most: the table of their counts is broadcast.
MAX_BLOCKS, BLOCK_ROWS = 1 << 16, 100
#: Slots that one row with a count becomes at once.
SLOTS = 4096


@dataclass(frozen=True)
class Node:
    """A region, rack or shard; a leaf has a shard number."""

    name: str
    weight: float
    children: tuple[Node, ...] = field(default=())
    shard: int = -1


def planned_tree(n: int, base: int = SHARDS, weights: dict[int, float] | None = None) -> Node:
    """Shards 0 to base - 1 in racks and regions; each further shard in a region of its own."""
    leaf = lambda i: Node(f"shard{i}", (weights or {}).get(i, 1.0), shard=i)
    up = lambda name, kids: Node(name, sum(k.weight for k in kids), tuple(kids))
    base = min(n, base)
    leaves = [leaf(i) for i in range(base)]
    racks = [up(f"rack{i // RACK}", leaves[i : i + RACK]) for i in range(0, base, RACK)]
    regions = [up(f"region{i // REGION}", racks[i : i + REGION]) for i in range(0, len(racks), REGION)]
    regions += [up(f"region+{i}", [up(f"rack+{i}", [leaf(i)])]) for i in range(base, n)]
    return up("root", regions)


def shard_of(key: Column, root: Node) -> Column:
    """The shard of a string key: the tree as one nested expression of hash draws."""

    def draw(path: str, kid: Node) -> Column:
        # 52 bits, moved off zero, so the logarithm is finite
        u = (F.shiftrightunsigned(F.xxhash64(F.lit(path), F.lit(kid.name), key), 12).cast("double") + 0.5) / float(1 << 52)
        return -F.log(u) / kid.weight

    def descend(node: Node, path: str) -> Column:
        if node.shard >= 0:
            return F.lit(node.shard)
        kids = [k for k in node.children if k.weight > 0]
        if not kids:
            raise ValueError(f"{node.name} has no child with a weight")
        if len(kids) == 1:
            return descend(kids[0], f"{path}/{kids[0].name}")
        draws = [draw(path, k) for k in kids]
        best, out = F.least(*draws), None
        for k, d in reversed(list(zip(kids, draws, strict=True))):
            below = descend(k, f"{path}/{k.name}")
            out = below if out is None else F.when(d == best, below).otherwise(out)
        return out

    return descend(root, "").cast("int")


def assign(docs: DataFrame, n_shards: int = SHARDS, base: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    raw = text_or_empty().cast("binary")
    placed = docs.select("doc_id", "text").select(
        "doc_id",
        (F.length(raw) + 1).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.lit("key").alias("law"),
        shard_of(key, planned_tree(n_shards, base)).alias("shard"),
        shard_of(key, planned_tree(n_shards + 1, base)).alias("grown_shard"),
        key.alias("key"),
    )
    # rows that are alike are one row with their count until they have their slots
    alike = placed.groupBy(*placed.columns).agg(F.count(F.lit(1)).alias("n"))
    slots = with_slots(alike, n_shards, F.col("n"))
    # many rows that are alike get their slots in runs of SLOTS, dealt to the tasks
    last = F.col("slot") + F.col("n") - 1
    runs = slots.where(F.col("n") > SLOTS).withColumn("from", F.explode(F.sequence("slot", last, F.lit(SLOTS).cast("long"))))
    runs = runs.withColumn("to", F.least(F.col("from") + SLOTS - 1, last)).repartition("shard", "from")
    few = slots.where(F.col("n") <= SLOTS).withColumn("from", F.col("slot")).withColumn("to", last)
    out = few.unionByName(runs).withColumn("slot", F.explode(F.sequence("from", "to")))
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def with_slots(placed: DataFrame, n_shards: int, n: Column | None = None) -> DataFrame:
    """Number the rows of each shard from 0 without bringing a shard into one task; a row takes n slots.

    A shard's rows fall into blocks by a hash of the id; blocks are numbered on their own and start
    where the counts of the blocks before them end.
    """
    n = F.lit(1) if n is None else n
    rows = placed.agg(F.sum(n)).first()[0] or 0
    blocks = max(1, min(MAX_BLOCKS // n_shards, rows // (BLOCK_ROWS * n_shards)))
    placed = placed.withColumn("block", F.pmod(F.xxhash64(F.lit("slot"), F.col("key"), F.col("text_crc32")), F.lit(blocks)).cast("int"))
    # at most MAX_BLOCKS rows, whatever the input (one a shard where there are more shards)
    counts = placed.groupBy("shard", "block").agg(F.sum(n).alias("n"))
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("shard", "block").orderBy("key", "doc_id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        placed.join(F.broadcast(starts), ["shard", "block"])
        .withColumn("slot", (F.sum(n).over(within) - n + F.col("start")).cast("long"))
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(table(spark, sf_dir, "documents"))


def place(docs: DataFrame, n_shards: int = SHARDS, base: int = SHARDS) -> DataFrame:
    """docs with the columns shard and slot; columns of these names are replaced, all others stay."""
    names = [c for c in docs.columns if c.lower() not in ("shard", "slot")]
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    raw = text_or_empty().cast("binary")
    keyed = docs.select(F.struct("*").alias("doc"), "doc_id", key.alias("key"), F.crc32(raw).alias("text_crc32"), (F.length(raw) + 1).cast("long").alias("size"))
    placed = with_slots(keyed.withColumn("shard", shard_of(F.col("key"), planned_tree(n_shards, base))), n_shards)
    return placed.select(*(F.col("doc").getField(c).alias(c) for c in names), "shard", "slot")
