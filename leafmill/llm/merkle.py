"""Operator 11: a Merkle manifest of a dataset, its trees stored in van Emde Boas order.

Every row is a leaf.  The leaves of a source, by id, are the lowest level of a tree in which each run of ARITY nodes
has one parent; the roots of the sources are the leaves of one tree above.  A tree is stored as aligned
subtrees of LEVELS levels: a block has the ARITY**(LEVELS-1) leaves that lie side by side, and the roots of the blocks
are the leaves of the next tier of blocks, up to one block.  Inside a block the nodes lie in van Emde Boas order: the
upper half of the levels first, then each subtree below, both laid out likewise.  ``address`` computes a node's place
from its depth and index alone; building a block and finding siblings for proofs use nothing else.

Places in a source come from ranges of (source, id, leaf) that are sorted and counted on their own, so no task
gets a source's rows.  Proofs go down from the top: a block gets the path above its root once and adds its own part.

Defined cases: a null value is hashed as ``-``; null ids come first in their source and the null source first of all; rows
of equal id are in the order of their leaves; rows that agree in all are leaves each; a null id counts as empty text
where the tampered half is chosen; a text of any length is hashed whole; an empty table gives no rows; further columns,
whatever their names, are ignored; a tree of one row has its leaf as root and the digest of nothing as proof.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, StringType, StructField, StructType

from .common import BROADCAST_KEYS, dropped, fold, table, written

#: Children of a node, levels of a block and its leaves.
ARITY, LEVELS = 3, 5
WIDTH = ARITY ** (LEVELS - 1)
#: The columns that a leaf covers.
COVERED = ("doc_id", "source", "lang", "n_chars", "text")
#: Bytes of a digest.
SIZE = 32


def subtree_size(levels: int) -> int:
    return (ARITY**levels - 1) // (ARITY - 1)


def address(levels: int, depth: int, index: np.ndarray) -> np.ndarray:
    """Places of the nodes of a depth (0 is the root) in a tree of so many levels."""
    if levels == 1:
        return np.zeros_like(index)
    upper = levels // 2
    if depth < upper:
        return address(upper, depth, index)
    below = ARITY ** (depth - upper)
    return subtree_size(upper) + index // below * subtree_size(levels - upper) + address(levels - upper, depth - upper, index % below)


@lru_cache(maxsize=64)
def addresses(levels: int) -> tuple[np.ndarray, ...]:
    """The places of all nodes, by depth."""
    return tuple(address(levels, d, np.arange(ARITY**d)) for d in range(levels))


def levels_for(leaves: int) -> int:
    """Levels of the smallest tree for so many leaves."""
    levels = 1
    while ARITY ** (levels - 1) < leaves:
        levels += 1
    return levels


def _parent(children: list[bytes]) -> bytes:
    return hashlib.sha256("".join(c.hex() for c in children).encode()).digest()


def laid_out(leaves: list[bytes], levels: int) -> bytes:
    """The nodes of a block, in van Emde Boas order; places without a node are zeros."""
    out, at, now = bytearray(SIZE * subtree_size(levels)), addresses(levels), leaves
    for depth in range(levels - 1, -1, -1):
        for i, node in enumerate(now):
            k = SIZE * int(at[depth][i])
            out[k : k + SIZE] = node
        if depth:
            now = [_parent(now[i : i + ARITY]) for i in range(0, len(now), ARITY)]
    return bytes(out)


def steps(nodes: bytes, levels: int, leaves: int) -> list[bytes]:
    """For each leaf the path to the block's root: per level its place in the run, the number of siblings, and these."""
    at, counts = addresses(levels), [leaves]
    while len(counts) < levels:
        counts.append(-(-counts[-1] // ARITY))
    paths, ups = [b""] * leaves, np.arange(leaves)
    for up in range(levels - 1):
        depth, parts = levels - 1 - up, {}
        for i in range(counts[up]):
            run = range(i - i % ARITY, min(i - i % ARITY + ARITY, counts[up]))
            siblings = [SIZE * int(at[depth][j]) for j in run if j != i]
            parts[i] = bytes((i % ARITY, len(siblings))) + b"".join(nodes[k : k + SIZE] for k in siblings)
        paths = [p + parts[i] for p, i in zip(paths, ups.tolist(), strict=True)]
        ups //= ARITY
    return paths


def read_path(path: bytes) -> list[tuple[int, list[bytes]]]:
    """The levels of a path: place and siblings."""
    out, k = [], 0
    while k < len(path):
        place, n = path[k], path[k + 1]
        out.append((place, [path[k + 2 + SIZE * i : k + 2 + SIZE * (i + 1)] for i in range(n)]))
        k += 2 + SIZE * n
    return out


def folded(leaf: bytes, path: list[tuple[int, list[bytes]]]) -> bytes:
    """The root that a leaf and its siblings lead to."""
    for place, siblings in path:
        leaf = _parent([*siblings[:place], leaf, *siblings[place:]])
    return leaf


@F.pandas_udf(BinaryType())
def _laid_out(digests: pd.Series, levels: pd.Series) -> pd.Series:
    return pd.Series([laid_out(list(d), n) for d, n in zip(digests, levels, strict=True)], dtype=object)


@F.pandas_udf(ArrayType(BinaryType()))
def _paths(nodes: pd.Series, levels: pd.Series, leaves: pd.Series, above: pd.Series) -> pd.Series:
    return pd.Series([[p + a for p in steps(b, n, m)] for b, n, m, a in zip(nodes, levels, leaves, above, strict=True)], dtype=object)


@F.pandas_udf(ArrayType(StructType([StructField("proof", StringType()), StructField("root", BinaryType())])))
def _proofs(nodes: pd.Series, levels: pd.Series, above: pd.Series, given: pd.Series) -> pd.Series:
    """Of each leaf of a block, the digest of its siblings and the root its given digest leads to."""
    out = []
    for b, n, a, leaves in zip(nodes, levels, above, given, strict=True):
        beyond, rows = read_path(a), []
        for p, leaf in zip(steps(b, n, len(leaves)), leaves, strict=True):
            path = read_path(p) + beyond
            rows.append({"proof": hashlib.sha256("".join(s.hex() for _, x in path for s in x).encode()).hexdigest(), "root": folded(leaf, path)})
        out.append(rows)
    return pd.Series(out, dtype=object)


def leaf(text: Column | None = None) -> Column:
    """The digest of a row's covered columns, with another text if given."""

    def part(c: Column) -> Column:
        value = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    values = [F.col(c) if c != "text" or text is None else text for c in COVERED]
    return F.unhex(F.sha2(F.concat(*map(part, values)).cast("binary"), 256))


def leaves(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """doc_id, g (the source as a key in order), leaf, given: the digest of the row as it is found, tampered where said."""
    given = leaf() if tampered is None else F.when(tampered, leaf(F.translate("text", "\n", ""))).otherwise(leaf())
    return docs.select("doc_id", F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("-")).alias("g"), leaf().alias("leaf"), given.alias("given"))


def placed(rows: DataFrame, order: list[str]) -> tuple[DataFrame, list[DataFrame]]:
    """rows (g, ..) with pos, their place in g by the order, and n, the rows of g; and the tables read for it."""
    spread = F.xxhash64(F.monotonically_increasing_id())
    given = written(rows.withColumn("spread", spread), "merkle-rows")
    by = ["g", *order, "spread"]
    ranged = given.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("m", F.monotonically_increasing_id())
    ranged = written(ranged.drop("spread"), "merkle-ranges")
    part = F.shiftright("m", 33).alias("part")
    counts = ranged.groupBy("g", part).agg(F.min("m").alias("first"), F.count(F.lit(1)).alias("c"))
    # a source has a row for each range it lies in
    before = Window.partitionBy("g").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("g", "part", (F.coalesce(F.sum("c").over(before), F.lit(0)) - F.col("first")).alias("shift"), F.sum("c").over(Window.partitionBy("g")).alias("n"))
    starts = written(starts, "merkle-starts")
    few = starts.count() <= BROADCAST_KEYS // 4
    met = ranged.withColumn("part", part).join(F.broadcast(starts) if few else starts, ["g", "part"])
    return met.withColumn("pos", F.col("m") + F.col("shift")).drop("m", "part", "shift"), [given, ranged, starts]


def blocks(rows: DataFrame) -> DataFrame:
    """g, k, n, levels, nodes, items: one tier of blocks of rows (g, pos, n, digest, item)."""
    width = F.lit(WIDTH)
    each = rows.groupBy("g", F.floor(F.col("pos") / width).cast("long").alias("k")).agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("pos", "digest", "item"))).alias("items"))
    fitted = F.lit(LEVELS)
    for levels in range(LEVELS - 1, 0, -1):
        fitted = F.when(F.col("n") <= ARITY ** (levels - 1), F.lit(levels)).otherwise(fitted)
    each = each.withColumn("levels", fitted)
    nodes = _laid_out(F.transform("items", lambda x: x["digest"]), F.col("levels"))
    return each.select("g", "k", "n", "levels", nodes.alias("nodes"), F.transform("items", lambda x: x["item"]).alias("items"))


def forest(rows: DataFrame) -> list[DataFrame]:
    """The written tiers of blocks, lowest first, of rows (g, pos, n, digest, item)."""
    tiers = []
    while True:
        tiers.append(written(blocks(rows), "merkle-blocks"))
        more = tiers[-1].where(F.col("n") > WIDTH)
        if more.isEmpty():
            return tiers
        above = F.ceil(F.col("n") / F.lit(WIDTH)).cast("long")
        rows = more.select("g", F.col("k").alias("pos"), above.alias("n"), _root("nodes").alias("digest"), F.lit(0).alias("item"))


def _root(nodes: str) -> Column:
    return F.substring(nodes, 1, SIZE)


def roots(tiers: list[DataFrame]) -> DataFrame:
    """g, root of every tree."""
    out = [t.where(F.col("n") <= WIDTH).select("g", _root("nodes").alias("root")) for t in tiers]
    return out[0] if len(out) == 1 else out[0].unionByName(roots(tiers[1:]))


def above(tiers: list[DataFrame], tops: DataFrame) -> DataFrame:
    """g, k, path, root: for each block of the lowest tier the path above its root, from that of each tree's (g, path, root)."""
    known = None
    for i in range(len(tiers) - 1, -1, -1):
        start = tiers[i].where(F.col("n") <= WIDTH).select("g", "k").join(tops, "g")
        known = start if known is None else start.unionByName(known)
        if i:
            m = F.least(F.lit(WIDTH).cast("long"), F.col("n") - F.col("k") * WIDTH)
            met = tiers[i].select("g", "k", "n", "levels", "nodes").join(known, ["g", "k"])
            down = met.select("g", "k", "root", F.posexplode(_paths("nodes", "levels", m, "path")).alias("i", "path"))
            known = down.select("g", (F.col("k") * WIDTH + F.col("i")).alias("k"), "path", "root")
    return known.select("g", "k", "path", "root")


def manifest(docs: DataFrame, tampered: Column | None = None) -> tuple[list[DataFrame], list[DataFrame]]:
    """The tiers of the sources and of the tree above them: g, k, n, levels, nodes, items.

    n counts the nodes at a tier's foot in its tree; items of the lowest tier are the rows (doc_id, leaf, given), those of the
    tree above are the keys of the sources.
    """
    rows, used = placed(leaves(docs, tampered), ["doc_id", "leaf"])
    below = forest(rows.select("g", "pos", "n", F.col("leaf").alias("digest"), F.struct("doc_id", "leaf", "given").alias("item")))
    subroots, more = placed(roots(below).select(F.lit("").alias("g"), F.col("g").alias("source"), "root"), ["source"])
    top = forest(subroots.select("g", "pos", "n", F.col("root").alias("digest"), F.col("source").alias("item")))
    dropped(*used, *more)
    return below, top


def prove(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified for every row."""
    below, top = manifest(docs, tampered)
    none = F.lit(b"")
    tops = above(top, roots(top).select("g", none.alias("path"), "root"))
    # of each source: the path from its subroot to the root
    met = top[0].join(tops, ["g", "k"])
    paths = met.select("root", F.explode(F.arrays_zip(F.col("items").alias("g"), _paths("nodes", "levels", F.size("items"), "path").alias("path"))).alias("x"))
    paths = written(paths.select("x.g", "x.path", "root"), "merkle-paths")
    # a path is the same for all of a source, so a block gets it with its subroot
    known = above(below, paths.join(roots(below).withColumnRenamed("root", "subroot"), "g").select("g", "path", F.struct("subroot", "root").alias("root")))
    met = below[0].join(known, ["g", "k"])
    found = _proofs("nodes", "levels", "path", F.transform("items", lambda x: x["given"]))
    rows = met.select("root", F.explode(F.arrays_zip(F.col("items").alias("item"), found.alias("found"))).alias("x")).select("x.item", "x.found", "root.subroot", "root.root")
    text = lambda c: F.lower(F.hex(c))
    return rows.select("item.doc_id", text(F.col("item.leaf")).alias("leaf"), text(F.col("subroot")).alias("subroot"), text(F.col("root")).alias("root"), F.col("found.proof").alias("proof_sha256"), text(F.col("found.root")).alias("folded_root"), (F.col("found.root") == F.col("root")).alias("verified"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return prove(docs, fold("doc_id", 2) == 0)


def _sql_leaf(text: str) -> str:
    part = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || {c}, '-')"
    return f"sha256({' || '.join(part(c) for c in (*COVERED[:-1], text))})"


#: crc32 bit by bit: each character is followed by seven zeros, so every list entry is one step.
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), ''), ''), lambda x: [ascii(x)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
  lambda c, x: CASE WHEN xor(c, x) % 2 = 1 THEN xor(xor(c, x) // 2, 3988292384::BIGINT) ELSE xor(c, x) // 2 END))"""
_TREE = """
{0}(level, g, pos, n, d) AS (
  SELECT 0, g, pos, n, d FROM {1}
  UNION ALL SELECT level + 1, g, pos // 3, (max(n) + 2) // 3, sha256(string_agg(d, '' ORDER BY pos)) FROM {0} WHERE n > 1 GROUP BY level, g, pos // 3),
{0}_run AS (SELECT level, g, pos // 3 AS run, list(d ORDER BY pos) AS ds FROM {0} WHERE n > 1 GROUP BY level, g, pos // 3)"""
_STEP = "list_transform(range(1, len(ds) + 1), lambda i: CASE WHEN i = pos % 3 + 1 THEN {} ELSE ds[i] END)"
_CLIMB = """
{0}(rid, level, g, pos, proof, d) AS (
  SELECT rid, 0, g, pos, proof, d FROM {1}
  UNION ALL SELECT rid, level + 1, g, pos // 3, proof || array_to_string(""" + _STEP.format("''") + """, ''), sha256(array_to_string(""" + _STEP.format("d") + """, ''))
  FROM {0} JOIN {2}_run r USING (level, g) WHERE r.run = pos // 3),
{0}_end AS (SELECT rid, g, arg_max(proof, level) AS proof, arg_max(d, level) AS d FROM {0} GROUP BY rid, g)"""
SQL = f"""
WITH RECURSIVE row AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id, coalesce('=' || source, '-') AS g, {_sql_leaf('text')} AS d,
    CASE WHEN {_CRC} % 2 = 0 THEN {_sql_leaf("replace(text, chr(10), '')")} ELSE {_sql_leaf('text')} END AS given FROM documents),
leaf AS MATERIALIZED (SELECT rid, doc_id, g, d, given, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, d) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM row),
{_TREE.format('low', 'leaf')},
sub AS MATERIALIZED (SELECT g AS source, d, '' AS g, row_number() OVER (ORDER BY encode(g)) - 1 AS pos, count(*) OVER () AS n FROM low WHERE n = 1),
{_TREE.format('high', 'sub')},
low_start AS (SELECT rid, g, pos, '' AS proof, given AS d FROM leaf),
{_CLIMB.format('low_climb', 'low_start', 'low')},
high_start AS (SELECT rid, sub.g, pos, proof, e.d FROM low_climb_end e JOIN sub ON e.g = sub.source),
{_CLIMB.format('high_climb', 'high_start', 'high')}
SELECT doc_id, leaf.d AS leaf, sub.d AS subroot, high.d AS root, sha256(e.proof) AS proof_sha256, e.d AS folded_root, e.d = high.d AS verified
FROM leaf JOIN high_climb_end e USING (rid) JOIN sub ON sub.source = leaf.g JOIN high ON high.n = 1
"""
