"""An index that grows: immutable segments, the rows that later ones replace, and a manifest committed for each batch.

A batch of changes (id, ord, page, type, course_code, title, text, deleted) becomes a segment of chunks, postings and
vectors of its own.  Rows of older segments under the same ids are listed as dead, never rewritten, and the
vocabulary gets what the batch adds and takes away.  All of it counts from the moment its manifest is there, which is made
under its number by a rename that fails where another writer was faster; what a failed batch leaves is never read and
``vacuum`` deletes it.  Segments of similar size are merged by ``merge`` without their dead rows.

Defined cases: of several rows of one id in a batch the one of greatest ord counts, a deletion before others of that ord;
deleting an id that is not there changes nothing; an epoch that was applied already changes nothing; ids and
ords are not null, and no two live ids share an ord.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import EMBED_BATCH, QUERY_PREFIX
from ..operators import digest, lexical, vectors
from .index import Index
from .stages import materialised

CHUNK = "ord long, id string, page int, type string, course_code string, title string, text string"
POSTING = "term string, ord long, tf long, dl long"
VECTOR = "ord long, id string, v array<float>"
DEAD = "segment string, ord long"
VOCABULARY = "term string, df long"
#: Changed ids that are broadcast to find what they replace.
FEW_IDS = 1 << 18
#: A segment is merged with smaller ones while it has at most so many times their rows.
TIER = 2


class Conflict(RuntimeError):
    """Another writer has committed meanwhile."""


class Segments:
    def __init__(self, spark: SparkSession, path: str, embedder: Callable[[pd.Series], pd.Series] | None = None, batch: int = EMBED_BATCH) -> None:
        self.spark, self.path, self.embedder, self.batch = spark, path.rstrip("/"), embedder, batch

    # -- files

    def _fs(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _listed(self, folder: str) -> list[str]:
        at, fs = self._fs(f"{self.path}/{folder}")
        return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []

    def versions(self) -> list[int]:
        return [int(n[:-5]) for n in self._listed("manifest") if n.endswith(".json") and n[:-5].isdigit()]

    def manifest(self, version: int | None = None) -> dict:
        """version, epoch, n, tokens, digest, segments (name, rows), dead and vocabulary (names of tables)."""
        if version is None:
            version = max(self.versions(), default=0)
        if not version:
            return {"version": 0, "epoch": -1, "n": 0, "tokens": 0, "segments": [], "dead": [], "vocabulary": [], "digest": digest.NONE}
        return json.loads("\n".join(r.value for r in self.spark.read.text(f"{self.path}/manifest/{version:010}.json").collect()))

    def _commit(self, m: dict) -> dict:
        """Make the manifest under its number, whole or not at all."""
        m = m | {"version": m["version"] + 1}
        final, fs = self._fs(f"{self.path}/manifest/{m['version']:010}.json")
        draft, _ = self._fs(f"{self.path}/manifest/_{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps(m).encode()))
        out.close()
        jvm = self.spark._jvm.org.apache.hadoop.fs
        files = jvm.FileContext.getFileContext(final.toUri(), self.spark._jsc.hadoopConfiguration()) if final.toUri().getScheme() else jvm.FileContext.getFileContext(self.spark._jsc.hadoopConfiguration())
        never = self.spark.sparkContext._gateway.new_array(jvm.Options.Rename, 0)
        try:
            files.rename(draft, final, never)
        except Exception as e:
            fs.delete(draft, False)
            if "FileAlreadyExists" in str(e):
                raise Conflict(f"version {m['version']} is there already") from e
            raise
        return m

    def _write(self, df: DataFrame, name: str) -> None:
        df.write.parquet(f"{self.path}/{name}")

    def _read(self, names: list[str], schema: str) -> DataFrame:
        """The tables under these names, or none."""
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{n}" for n in names]) if names else self.spark.createDataFrame([], schema)

    # -- what is there

    def _live(self, m: dict, table: str, schema: str) -> DataFrame:
        """Rows of all segments but the dead, with their segment."""
        parts = [self._read([f"segments/{s['name']}/{table}"], schema).withColumn("segment", F.lit(s["name"])) for s in m["segments"]]
        rows = reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], f"{schema}, segment string")
        return rows.join(self._read([f"dead/{d}" for d in m["dead"]], DEAD), ["segment", "ord"], "left_anti") if m["dead"] else rows

    def vocabulary(self, m: dict | None = None) -> DataFrame:
        """term, df over all live rows: the sum of what batches added and took away."""
        m = m or self.manifest()
        return self._read([f"vocabulary/{v}" for v in m["vocabulary"]], VOCABULARY).groupBy("term").agg(F.sum("df").alias("df")).where("df <> 0")

    def index(self, version: int | None = None) -> Index:
        """The index as of a version, the last if none is given."""
        m = self.manifest(version)
        tables = [self._live(m, t, s).drop("segment") for t, s in (("chunks", CHUNK), ("postings", POSTING), ("vectors", VECTOR))]
        own = () if self.embedder is None else (self.embedder, QUERY_PREFIX)
        return Index(tables[0], tables[1], lexical.weighted(self.vocabulary(m), m["n"]), tables[2], m["n"], m["tokens"], *own)

    # -- changes

    def apply(self, changes: DataFrame, epoch: int) -> dict:
        """Add a batch of changes; the manifest after it."""
        m = self.manifest()
        if epoch <= m["epoch"]:
            return m
        rest = [c for c in ("page", "type", "course_code", "title", "text") if c in changes.columns]
        deleted = F.coalesce("deleted", F.lit(False)) if "deleted" in changes.columns else F.lit(False)
        rows = changes.select(F.col("id").cast("string").alias("id"), F.struct(F.col("ord").cast("long").alias("ord"), deleted.alias("deleted"), *rest).alias("x"))
        rows = materialised(rows.groupBy("id").agg(F.max("x").alias("x")).select("id", "x.*"))
        missing = {c.split()[0]: c.split()[1] for c in CHUNK.split(", ") if c.split()[0] not in rows.columns}
        new = rows.where("not deleted").withColumns({c: F.lit(None).cast(t) for c, t in missing.items()}).select(*(F.col(c.split()[0]).cast(c.split()[1]) for c in CHUNK.split(", ")))
        ids = rows.select("id")
        ids = F.broadcast(ids) if ids.count() <= FEW_IDS else ids
        old = materialised(self._live(m, "chunks", CHUNK).join(ids, "id", "left_semi").select("segment", "ord", "id", "text"))

        name = f"{epoch:010}-{uuid.uuid4().hex[:8]}"
        at = f"segments/{name}"
        self._write(new, f"{at}/chunks")
        stored = self._read([f"{at}/chunks"], CHUNK)
        self._write(lexical.postings(stored).repartitionByRange("term").sortWithinPartitions("term"), f"{at}/postings")
        self._write(vectors.embed(stored.select("ord", "id", "text"), self.embedder or vectors.hashed_embedding, batch=self.batch).select("ord", "id", "v"), f"{at}/vectors")
        added, gone = self._read([f"{at}/postings"], POSTING), materialised(lexical.postings(old))
        self._write(old.select("segment", "ord"), f"dead/{name}")
        delta = added.select("term", F.lit(1).alias("d")).unionByName(gone.select("term", F.lit(-1).alias("d"))).groupBy("term").agg(F.sum("d").cast("long").alias("df"))
        self._write(delta.where("df <> 0"), f"vocabulary/{name}")
        n_new, n_old = stored.count(), old.count()
        tokens = [posts.agg(F.coalesce(F.sum("tf"), F.lit(0))).first()[0] for posts in (added, gone)]
        of = lambda rows: digest.value(digest.digest(rows, "id", "text"))
        return self._commit(m | {
            "digest": digest.added(digest.added(m["digest"], of(old), -1), of(stored)), "epoch": epoch, "n": m["n"] + n_new - n_old, "tokens": m["tokens"] + tokens[0] - tokens[1],
            "segments": m["segments"] + ([{"name": name, "rows": n_new}] if n_new else []),
            "dead": m["dead"] + ([name] if n_old else []), "vocabulary": [*m["vocabulary"], name]})

    def is_fresh(self, chunks: DataFrame) -> bool:
        """Whether the index has the ids and texts of the chunks, by its digest."""
        return self.manifest()["digest"] == digest.value(digest.digest(chunks, "id", "text"))

    def merge(self, tier: int = TIER, tries: int = 3) -> dict:
        """Put the smallest segments together, while the next is not much larger than all of them; the manifest after it."""
        for left in range(tries - 1, -1, -1):
            m = self.manifest()
            chosen, total = [], 0
            for s in sorted(m["segments"], key=lambda s: (s["rows"], s["name"])):
                if chosen and s["rows"] > tier * total:
                    break
                chosen.append(s["name"])
                total += s["rows"]
            if len(chosen) < 2:
                return m
            try:
                return self._merged(m, chosen)
            except Conflict:
                if not left:
                    raise
        raise AssertionError

    def _merged(self, m: dict, chosen: list[str]) -> dict:
        part = m | {"segments": [s for s in m["segments"] if s["name"] in chosen]}
        others = [s for s in m["segments"] if s["name"] not in chosen]
        name = f"{m['epoch']:010}-{uuid.uuid4().hex[:8]}"
        for table, schema in (("chunks", CHUNK), ("postings", POSTING), ("vectors", VECTOR)):
            rows = self._live(part, table, schema).drop("segment")
            rows = rows.repartitionByRange("term").sortWithinPartitions("term") if table == "postings" else rows
            self._write(rows, f"segments/{name}/{table}")
        dead = self._read([f"dead/{d}" for d in m["dead"]], DEAD).where(~F.col("segment").isin(chosen))
        self._write(dead, f"dead/{name}")
        self._write(self.vocabulary(m), f"vocabulary/{name}")
        rows = self._read([f"segments/{name}/chunks"], CHUNK).count()
        return self._commit(m | {"segments": [*others, {"name": name, "rows": rows}], "dead": [name] if others else [], "vocabulary": [name]})

    def vacuum(self, keep: int = 1) -> list[str]:
        """Delete the tables that none of the last ``keep`` manifests names, and older manifests; what was deleted.

        No other writer may be at work, as its tables are not named yet.
        """
        versions, gone = self.versions(), []
        held = [self.manifest(v) for v in versions[-keep:]]
        used = {f"segments/{s['name']}" for m in held for s in m["segments"]} | {f"{t}/{x}" for m in held for t in ("dead", "vocabulary") for x in m[t]} | {f"manifest/{v:010}.json" for v in versions[-keep:]}
        for folder in ("segments", "dead", "vocabulary", "manifest"):
            for name in self._listed(folder):
                if f"{folder}/{name}" not in used:
                    at, fs = self._fs(f"{self.path}/{folder}/{name}")
                    fs.delete(at, True)
                    gone.append(f"{folder}/{name}")
        return gone
