"""Operator 10: near-duplicates by min-max hashing.

Each permutation of a document's 5-word shingles gives two signature values, its minimum and its
maximum, so half the hash evaluations fill a signature; bands of it propose candidates, and every
candidate pair is confirmed on the full sets (100 * intersection >= 75 * union).

Exact copies share a set and are one node.  In a bucket, every member is first compared with two
centres, the member that shares most buckets with others and a random one, which joins a large group
in a number of comparisons that grows with the group and not with its square.  A bucket of three
nodes is thereby settled.  The nodes of larger buckets that still hold several components are then
compared across components wherever they can be similar enough at all: the rarest shingles of both, up
to the most that may differ, have one in common.  That condition is exact, so no link that a band
proposes is lost.  Rows of a frequent shingle and pairs of a frequent centre are dealt to several tasks.

With BANDS bands of ROWS values a pair at the threshold is missed with probability
(1 - 0.75**ROWS)**BANDS = 2e-5; pairs above it less often.

Defined cases: a document of fewer than five words is one shingle; one without words or text is
linked with nothing and keeps its own id; a text of any length is treated whole; a null id never becomes a
component's id unless all are null; repeated rows fall into one component; of equal ids all are kept by
``classes`` and one by ``one_of_each``; an empty table gives no rows; further columns, whatever their names, are
ignored by ``classes`` and kept by ``one_of_each``.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_KEYS, SPLIT, dropped, looked_up, map_arrow, row_key, table, text_or_empty, written
from .graph import components
from .rolling import PrefixHash, mixed

WIDTH, PERCENT = 5, 75
BANDS, ROWS = 40, 5
#: Two values from each permutation.
PERMUTATIONS = BANDS * ROWS // 2

_rng = np.random.RandomState(715517)
_MULTIPLY = _rng.randint(0, 1 << 62, PERMUTATIONS, np.uint64) * np.uint64(4) + np.uint64(1)
_ADD = _rng.randint(0, 1 << 63, PERMUTATIONS, np.uint64)
_BAND = _rng.randint(0, 1 << 62, (BANDS, ROWS), np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of the lower-cased text."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - width + 1)
    return np.unique(PrefixHash(b" ".join(words)).of(starts[:n], ends[min(width, len(words)) - 1 :][:n]))


def signature(hashes: np.ndarray) -> np.ndarray:
    """Minimum and maximum of the set under each permutation; the two fall into different bands."""
    low = np.full(PERMUTATIONS, ~np.uint64(0))
    high = np.zeros(PERMUTATIONS, np.uint64)
    for at in range(0, len(hashes), 2048):
        values = _MULTIPLY[:, None] * hashes[None, at : at + 2048] + _ADD[:, None]
        np.minimum(low, values.min(1), out=low)
        np.maximum(high, values.max(1), out=high)
    return np.concatenate([low, high])


def bands(sig: np.ndarray) -> np.ndarray:
    """One 64-bit key a band, different in every band."""
    return mixed((mixed(sig.reshape(BANDS, ROWS)) * _BAND).sum(1) + np.arange(1, BANDS + 1, dtype=np.uint64)).view(np.int64)


def set_key(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def linked(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and the row's key (repeated rows share it)."""
    return docs.select("doc_id", text_or_empty().alias("text")).withColumn("row", row_key())


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, row, n_shingles, node (the set's 128-bit key), bands."""
    kind = dict(docs.dtypes)["doc_id"].replace("bigint", "long")

    def one(batch: pa.RecordBatch) -> dict:
        sets = [shingles(t) for t in batch.column("text").to_pylist()]
        return {"doc_id": batch.column("doc_id"), "row": batch.column("row"), "n_shingles": [len(s) for s in sets], "node": [set_key(s) for s in sets], "bands": [bands(signature(s)) if len(s) else [] for s in sets]}

    return map_arrow(_keyed(docs), one, f"doc_id {kind}, row binary, n_shingles long, node binary, bands array<long>")


def _dealt(node: str, rows: Column) -> Column:
    """The part of a key with so many rows that a node's row belongs to, of SPLIT rows or so."""
    return F.pmod(F.xxhash64(node), F.ceil(rows / SPLIT)).cast("int")


def _parts(rows: Column) -> Column:
    """All parts of a key with so many rows."""
    return F.explode(F.sequence(F.lit(0), (F.ceil(rows / SPLIT) - 1).cast("int")))


def confirmed(pairs: DataFrame, texts: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) of nodes whose full sets are similar enough; texts has node, text.

    pairs also has n, about how many pairs a node has: the text of a goes to each part of its pairs once.
    """
    pairs = pairs.select("a", "b", _dealt("b", F.greatest("n", F.lit(1))).alias("part"))
    left = pairs.select("a", "part").distinct().join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a")
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("tb"))

    def one(batch: pa.RecordBatch) -> dict:
        seen: dict[bytes, np.ndarray] = {}

        def of(node: bytes, text: str) -> np.ndarray:
            if node not in seen:
                if len(seen) > 256:
                    seen.clear()
                seen[node] = shingles(text)
            return seen[node]

        rows = zip(*(batch.column(c).to_pylist() for c in ("a", "b", "ta", "tb")), strict=True)
        good = [(a, b) for a, b, ta, tb in rows if linked(of(a, ta), of(b, tb), percent)]
        return {"a": [a for a, _ in good], "b": [b for _, b in good]}

    return map_arrow(pairs.join(right, "b").join(left, ["a", "part"]).select("a", "b", "ta", "tb"), one, "a binary, b binary")


def possible(texts: DataFrame, percent: int = PERCENT) -> tuple[DataFrame, list[DataFrame]]:
    """Pairs (a, b, n) of nodes (node, text, root) of different roots that can be similar enough; and the tables read for it.

    Sets of n and m shingles need overlap o = ceil(percent (n + m) / (100 + percent)).  With the
    shingles of every set in one order, rarest first, the first common one is among the first n - o + 1
    of the one and the first m - o + 1 of the other.  With n <= m, o is at least that of two sets of n.
    """

    def one(batch: pa.RecordBatch) -> dict:
        sets = [shingles(t) for t in batch.column("text").to_pylist()]
        return {"node": batch.column("node"), "root": batch.column("root"), "h": [s.view(np.int64).tolist() for s in sets]}

    items = map_arrow(texts.select("node", "root", "text"), one, "node binary, root binary, h array<long>").select("node", "root", F.explode("h").alias("h"))
    items = written(items, "near-items")
    rare = items.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h", "n", F.col("n").alias("c"))
    counted = looked_up(items, rare, "h", "c", "node", items.count()).na.fill(1, ["c"])
    ordered = counted.groupBy("node", "root").agg(F.sort_array(F.collect_list(F.struct("c", "h"))).alias("s"))
    n = F.size("s")
    most = n - F.ceil(n * percent / 100).cast("int") + 1
    heads = ordered.select("node", "root", n.alias("n"), F.posexplode(F.slice("s", F.lit(1), most)).alias("i", "x")).where("x.c > 1")
    heads = written(heads.select("node", "root", "n", "i", F.col("x.h").alias("h"), F.col("x.c").alias("c")), "near-heads")
    # of two sets the smaller meets the other with fewer of its first shingles: n - o + 1 at o for its own size
    early = F.col("i") <= F.col("n") - F.ceil(2 * F.col("n") * percent / (100 + percent))
    # within a shingle's nodes, those of the largest component meet only the others
    big = heads.groupBy("h", "c", "root").agg(F.count(F.lit(1)).alias("k"), F.max(early).alias("any")).groupBy("h", "c").agg(F.max(F.struct("k", "root")).alias("top"), F.count(F.lit(1)).alias("roots"), F.max("any").alias("any"))
    big = big.where("roots > 1 and any").select("h", F.col("top.root").alias("top"), _parts(F.col("c")).alias("part"))
    dealt = heads.withColumn("early", early).withColumn("part", _dealt("node", F.col("c"))).join(big, ["h", "part"]).drop("part")
    dealt = written(dealt.withColumn("inside", F.col("root") == F.col("top")).drop("top"), "near-dealt")
    end = lambda rows, k: rows.select("h", "c", *(F.col(c).alias(f"{c}{k}") for c in ("node", "root", "n", "i", "early", "inside")))
    least, need = F.col("n1") <= F.col("n2"), F.ceil((F.col("n1") + F.col("n2")) * percent / (100 + percent))
    close = (F.col("root1") != F.col("root2")) & least & (F.col("i1") <= F.col("n1") - need) & (F.col("i2") <= F.col("n2") - need)
    out = []
    # the smaller set is outside the largest component, or inside it and the other is outside
    for small, large, copied in (("not inside and early", "true", 1), ("inside and early", "not inside", 2)):
        one, two = end(dealt.where(small), 1), end(dealt.where(large), 2)
        part, parts = _dealt("node2" if copied == 1 else "node1", F.col("c")), _parts(F.col("c"))
        one, two = (one.withColumn("part", parts), two.withColumn("part", part)) if copied == 1 else (one.withColumn("part", part), two.withColumn("part", parts))
        out.append(one.join(two.drop("c"), ["h", "part"]).where(close).select(F.least("node1", "node2").alias("a"), F.greatest("node1", "node2").alias("b"), "c"))
    return out[0].unionByName(out[1]).groupBy("a", "b").agg(F.max("c").alias("n")), [items, heads, dealt]


def classes(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, row, n_shingles, component_id, kept for every row."""
    sig = written(signatures(docs), "near-signatures")
    full = sig.where("n_shingles > 0")
    nodes = full.groupBy("node").agg(F.min("doc_id").alias("min_id"), F.first("row").alias("row"), F.first("bands").alias("bands"), F.count(F.lit(1)).alias("rows"))
    nodes = written(nodes, "near-nodes")
    buckets = nodes.select("node", F.explode("bands").alias("bucket"))
    sizes = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = written(buckets.join(sizes, "bucket"), "near-members")
    # two centres: the member that most others share buckets with, and a random one, another in each band
    shared = members.groupBy("node").agg(F.sum("n").alias("shared"))
    draw = F.struct(F.xxhash64("node", "bucket").alias("draw"), "node")
    centres = members.join(shared, "node").groupBy("bucket").agg(F.max(F.struct("shared", "node")).alias("most"), F.min(draw).alias("low"), F.max(draw).alias("high"))
    second = F.when(F.col("low.node") == F.col("most.node"), F.col("high.node")).otherwise(F.col("low.node"))
    centres = centres.select("bucket", F.explode(F.array("most.node", second)).alias("centre"))
    tried = members.join(centres, "bucket").where("node <> centre").groupBy(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).agg(F.max("n").alias("n"))
    tried = written(tried, "near-tried")

    # the texts of the nodes that share any bucket
    wanted = _sized(members.select("node").distinct().join(nodes.select("node", "row"), "node"))
    texts = _keyed(docs).select("row", "text").join(wanted, "row").select("node", "text").dropDuplicates(["node"])
    texts = written(texts, "near-texts")
    links = written(confirmed(tried, texts, percent), "near-links")
    root = components(links)

    # nodes of buckets that hold more than one component and pairs that were not tried
    placed = members.where("n > 3").select("bucket", "node").join(root, "node", "left").select("bucket", "node", F.coalesce("root", "node").alias("root"))
    several = placed.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("bucket")
    left = written(placed.join(several, "bucket").select("node", "root").distinct(), "near-left")
    across, used = possible(texts.join(left, "node"), percent)
    more = written(confirmed(across.join(tried.select("a", "b"), ["a", "b"], "left_anti"), texts, percent), "near-links")
    dropped(*used)
    if not more.isEmpty():
        # the components that these links join
        end = lambda c: left.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))
        joined = components(more.join(end("a"), "a").join(end("b"), "b").select(F.col("a_root").alias("a"), F.col("b_root").alias("b")))
        known = root.unionByName(left).distinct()
        joined = joined.select(F.col("node").alias("root"), F.col("root").alias("above"))
        root = known.join(joined, "root", "left").select("node", F.coalesce("above", "root").alias("root"))

    named = nodes.select("node", "min_id", "rows").join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("min_id").alias("component_id"), F.count(F.lit(1)).alias("n"))
    placed = written(looked_up(named, least, "root", "component_id", "node", nodes.count()).select("node", "component_id", F.col("rows").alias("n")), "near-placed")
    dropped(nodes, members, tried, texts, links, left, more)
    alone = sig.where("n_shingles = 0").select("doc_id", "row", "n_shingles", F.col("doc_id").alias("component_id"))
    out = looked_up(full.select("doc_id", "row", "n_shingles", "node"), placed, "node", "component_id", "row", sig.count()).select("doc_id", "row", "n_shingles", "component_id")
    return out.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _sized(keys: DataFrame) -> DataFrame:
    """Row keys, written; broadcast where their number is within BROADCAST_KEYS."""
    keys = written(keys, "near-keys")
    return F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs with one document of each component, the one of least id; documents without words stay.

    Where rows share that id, the one with the least row key stays, once; rows without an id stay, once each.
    """
    key = F.when(F.col("component_id").isNull(), F.col("row")).otherwise(F.col("component_id").cast("string").cast("binary")).alias("key")
    found = written(classes(docs).select("row", key, "kept", (F.col("n_shingles") > 0).alias("some")), "near-kept")
    rows = found.where("kept and some").groupBy("key", "row").agg(F.count(F.lit(1)).alias("c"))
    several = rows.groupBy("key").agg(F.min(F.struct("row", "c")).alias("top"), F.count(F.lit(1)).alias("rows")).where("rows > 1 or top.c > 1")
    several = written(several, "near-several")
    other = rows.join(several.where("rows > 1").select("key", "top"), "key").where("row <> top.row")
    dropped = found.where("not kept").select("row").unionByName(other.select("row")).distinct()
    keyed = docs.select(F.struct("*").alias("doc"), "doc_id", text_or_empty().alias("text")).select("doc", row_key().alias("row"))
    out = keyed.join(_sized(dropped), "row", "left_anti")
    again = several.where("top.c > 1").select(F.col("top.row").alias("row"))
    if not again.isEmpty():  # repeated rows: one stays
        again = _sized(again)
        out = out.join(again, "row", "left_anti").unionByName(out.join(again, "row", "left_semi").dropDuplicates(["row"]))
    return out.select("doc.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"
SQL = rf"""
WITH RECURSIVE doc AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, coalesce({_WORDS}, []) AS w FROM documents),
sets AS MATERIALIZED (
  SELECT rid, doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_sort(list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(list_slice(w, i, i + 4), ' ')))) END AS s FROM doc),
node AS MATERIALIZED (SELECT row_number() OVER () AS nid, s, len(s) AS n FROM (SELECT DISTINCT s FROM sets WHERE len(s) > 0)),
item AS MATERIALIZED (SELECT nid, n, unnest(s) AS x FROM node),
link AS MATERIALIZED (
  SELECT a.nid AS a, b.nid AS b FROM item a JOIN item b ON a.x = b.x AND a.nid < b.nid
  GROUP BY a.nid, b.nid, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
edge AS MATERIALIZED (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach(a, b) AS (SELECT nid, nid FROM node UNION SELECT reach.a, edge.b FROM reach JOIN edge ON reach.b = edge.a),
root AS MATERIALIZED (SELECT a AS nid, min(b) AS root FROM reach GROUP BY a),
named AS MATERIALIZED (SELECT sets.rid, sets.doc_id, node.n, root.root FROM sets JOIN node USING (s) JOIN root USING (nid)),
least_id AS (SELECT root, min(doc_id) AS component_id FROM named GROUP BY root)
SELECT doc_id, cast(n AS bigint) AS n_shingles, component_id, doc_id IS NOT DISTINCT FROM component_id AS kept FROM named JOIN least_id USING (root)
UNION ALL SELECT doc_id, 0, doc_id, true FROM sets WHERE len(s) = 0
"""
