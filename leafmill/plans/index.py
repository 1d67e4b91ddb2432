"""The retrieval index: build, save, load, search and answer, each for a whole table of questions."""

from __future__ import annotations

import json
import uuid
import warnings
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..config import DEPTH, EMBED_BATCH, EXCERPT_CHARS, QUERY_PREFIX, RERANK_DEPTH, RERANK_KEEP, RRF_K, TOP_N, Settings
from ..operators import answer, chunking, digest, documents, extraction, fusion, lexical, records, vectors
from ..operators.answer import first_sentences, word_by_word
from .stages import dealt, materialised
from .stages import stored as kept

TABLES = ("chunks", "postings", "vocabulary", "vectors")
STATS = "n long, n_tokens long, signature string, content string, first array<long>, schemas array<string>"
#: Hits that are broadcast to find their chunks.
FEW_HITS = 1 << 16
#: Places of the corpus that a saved index knows as its first.
FIRST = 100


@dataclass
class Index:
    """Tables of an index: chunks (ord, id, page, type, course_code, title, text), postings in blocks, vocabulary, vectors, sizes.

    embedder makes the vectors of questions, which have query_prefix before them, as asymmetric models want it.
    """

    chunks: DataFrame
    postings: DataFrame
    vocabulary: DataFrame
    vectors: DataFrame
    n: int
    n_tokens: int
    embedder: Callable[[pd.Series], pd.Series] = vectors.hashed_embedding
    query_prefix: str = ""
    #: The first places of the corpus, if known: what searches with too few hits are filled with.
    first: list[int] | None = None

    @property
    def lexical(self) -> tuple:
        return self.postings, self.vocabulary, self.n, self.n_tokens

    def save(self, path: str, mode: str = "overwrite") -> bool:
        """Write the tables: postings sorted by term, so that files and row groups without a question's terms are passed over.

        They are written beside the path and put there when all are whole.  mode is what to do where an index is:
        overwrite, error or ignore; returns whether this index is there now.
        """
        if mode not in ("overwrite", "error", "ignore"):
            raise ValueError("mode is overwrite, error or ignore")
        spark = self.chunks.sparkSession
        at, draft = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (path, f"{path.rstrip('/')}.{uuid.uuid4().hex}"))
        files = at.getFileSystem(spark._jsc.hadoopConfiguration())
        there = lambda: files.exists(at) and bool(files.listStatus(at))
        if mode != "overwrite" and there():
            if mode == "error":
                raise FileExistsError(f"there is an index at {path}")
            return False
        for name in TABLES:
            df = getattr(self, name)
            df = df.repartitionByRange("term").sortWithinPartitions("term") if name in ("postings", "vocabulary") else df
            df.write.parquet(f"{draft.toString()}/{name}")
        s = lexical.signature(self.chunks).first()
        content = digest.text(digest.value(digest.digest(self.chunks, "id", "text")))
        stats = (self.n, self.n_tokens, s.signature, content, self.first or lexical.first_of(self.chunks, FIRST), [getattr(self, name).schema.json() for name in TABLES])
        spark.createDataFrame([stats], STATS).coalesce(1).write.parquet(f"{draft.toString()}/stats")
        if mode == "overwrite":
            files.delete(at, True)
        elif there():  # another writer was faster
            files.delete(draft, True)
            if mode == "error":
                raise FileExistsError(f"there is an index at {path}")
            return False
        elif files.exists(at):
            files.delete(at, True)
        files.mkdirs(at.getParent())
        if not files.rename(draft, at):
            raise OSError(f"the index could not be put at {path}")
        return True

    @staticmethod
    def load(spark: SparkSession, path: str, chunks: DataFrame | None = None, embedder: Callable[[pd.Series], pd.Series] | None = None) -> Index:
        """A saved index; warns where it is empty, or older than the chunks given."""
        s = spark.read.schema(STATS).parquet(f"{path}/stats").first()
        if not s.n:
            warnings.warn(f"the index at {path} is empty", stacklevel=2)
        if not Index.is_fresh(spark, path, chunks):
            warnings.warn(f"the index at {path} is stale: build it anew", stacklevel=2)
        own = () if embedder is None else (embedder, QUERY_PREFIX)
        kinds = [StructType.fromJson(json.loads(x)) for x in s.schemas]
        found = Index(*[spark.read.schema(kind).parquet(f"{path}/{n}") for n, kind in zip(TABLES, kinds, strict=True)], s.n, s.n_tokens, *own)
        found.first = s["first"]
        return found

    @staticmethod
    def is_fresh(spark: SparkSession, path: str, chunks: DataFrame | None, content: bool = False) -> bool:
        """Whether the saved index has the ids of the chunks, and with content their texts; without any it counts as fresh."""
        if chunks is None:
            return True
        stats = spark.read.parquet(f"{path}/stats").first()
        if content:
            return stats.content == digest.text(digest.value(digest.digest(chunks, "id", "text")))
        return stats.signature == lexical.signature(chunks).first().signature

    def embedded(self, questions: DataFrame) -> DataFrame:
        return vectors.embed(questions.select("query_id", "text"), self.embedder, self.query_prefix)

    def hits(self, questions: DataFrame, depth: int = DEPTH, n: int = TOP_N, k: int = RRF_K) -> DataFrame:
        """query_id, ord, rrf_score, methods, rank_0, rank_1, rank: both searches fused, for questions (query_id, text)."""
        words = lexical.search(questions, self.chunks, depth, index=self.lexical, first=self.first)
        return fusion.fuse([words, vectors.nearest(self.embedded(questions), self.vectors, depth)], k, n)

    def nearest(self, questions: DataFrame, n: int = 5) -> DataFrame:
        """query_id, rank, id, page, distance, snippet: search by vectors alone."""
        found = vectors.nearest(self.embedded(questions), self.vectors, n).join(self.chunks, "ord")
        return found.select("query_id", "rank", "id", "page", "distance", F.trim(F.substring("text", 1, 200)).alias("snippet"))

    def listed(self, found: DataFrame) -> DataFrame:
        """query_id, rank, label, page, method, rrf_score, snippet of ``search``, as a list of results shows them."""
        label = F.coalesce(F.nullif("course_code", F.lit("")), F.col("type"))
        return found.select("query_id", "rank", label.alias("label"), "page", fusion.method_label(F.col("methods")).alias("method"), "rrf_score", fusion.snippet(F.col("text")).alias("snippet"))

    def search(self, questions: DataFrame, **options) -> DataFrame:
        found = materialised(self.hits(questions, **options))
        # few hits go to the chunks, whose texts else move
        return (F.broadcast(found) if found.count() <= FEW_HITS else found).join(self.chunks, "ord")

    def reranked(self, questions: DataFrame, depth: int = RERANK_DEPTH, keep: int = RERANK_KEEP, model=None) -> DataFrame:
        if keep > depth:
            raise ValueError("more to keep than to rerank")
        found = self.search(questions, n=depth).join(questions.select("query_id", F.col("text").alias("query")), "query_id")
        return fusion.rerank(found, model, keep, by=fusion.proximity)

    def answer(self, questions: DataFrame, turns: DataFrame | None = None, generator=first_sentences, n: int | None = None, settings: Settings | None = None) -> DataFrame:
        """questions (query_id, text, conv_id if there are turns) with context, messages, answer, footer and sources.

        chunks_used lists all that were found, sources those that were packed.  A generator with a parameter ``options``
        gets the settings' temperature and size of the context.
        """
        settings, spark = settings or Settings(), questions.sparkSession
        n = settings.top_n if n is None else n
        turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string") if turns is None or not settings.memory else turns
        asked = questions.withColumn("conv_id", F.col("conv_id") if "conv_id" in questions.columns else F.lit(None).cast("long")).withColumn("query", F.col("text"))
        asked = answer.retrieval_queries(asked, turns)
        found = materialised(self.search(asked.select("query_id", F.col("retrieval_query").alias("text")), n=n))
        sources = answer.packed(found).withColumn("methods", answer.method_names(F.col("methods")))
        out = asked.join(answer.contexts(found), "query_id", "left").withColumn("context", F.coalesce("context", F.lit("")))
        used = found.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"]).alias("chunks_used"))
        listed = answer.unique_sources(sources).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("position", "label", "page", "type", answer.badge(F.col("methods")).alias("badge")))).alias("sources"))
        out = answer.answers(answer.messages(out, turns), answer.with_options(generator, settings)).join(answer.footers(sources), "query_id", "left").join(used, "query_id", "left").join(listed, "query_id", "left")
        return out.select("query_id", "conv_id", "query", "retrieval_query", "context", "messages", "answer", "footer", "chunks_used", "sources")

    def turns(self, turns: DataFrame, generator=first_sentences, settings: Settings | None = None) -> DataFrame:
        """The conversations (conv_id, turn, role, text) that end with a question, each with its answer as one more turn.

        conv_id, turn, role, text, sources, chunks_used.  A generator that fails on a question gives an answer that says so.
        """
        last = turns.groupBy("conv_id").agg(F.max(F.struct("turn", "role", "text")).alias("last")).where("last.role = 'user'")
        asked = last.select(F.col("conv_id").alias("query_id"), "conv_id", F.col("last.text").alias("text"), F.col("last.turn").alias("turn"))
        before = turns.join(asked.select("conv_id", F.col("turn").alias("__turn")), "conv_id").where("turn < __turn").drop("__turn")
        got = self.answer(asked, before, answer.guarded(generator), settings=settings).join(asked.select("conv_id", "turn"), "conv_id")
        return got.select("conv_id", (F.col("turn") + 1).alias("turn"), F.lit("assistant").alias("role"), F.col("answer").alias("text"), "sources", "chunks_used")

    def stream(self, questions: DataFrame, pieces=word_by_word, settings: Settings | None = None) -> Iterator[tuple[int, Iterator[str]]]:
        """For each question, in order, its id and the pieces of its answer: found at once, generated as they are taken."""
        found = self.answer(questions, settings=settings).select("query_id", "context").orderBy("query_id")
        for r in found.toLocalIterator():
            yield r.query_id, pieces(r.context) if r.context else iter([answer.NOTHING])

    def excerpts(self, answered: DataFrame, chars: int = EXCERPT_CHARS) -> DataFrame:
        """query_id, position, id, label, page, text: the beginnings of the chunks used; ids that are gone fall out."""
        used = answered.select("query_id", F.posexplode("chunks_used").alias("position", "id"))
        label = F.coalesce(F.nullif("course_code", F.lit("")), F.nullif("title", F.lit("")), F.col("type"))
        return used.join(self.chunks, "id").select("query_id", "position", "id", label.alias("label"), "page", F.substring("text", 1, chars).alias("text"))


def index_of(chunks: DataFrame, embedder: Callable[[pd.Series], pd.Series] | None = None, limit: int | None = None, batch: int = EMBED_BATCH, stored: DataFrame | None = None, force: bool = False) -> Index:
    """chunks: ord, id, page, type, course_code, title, text; the first of them with a limit.

    stored: vectors (id, v) of an earlier index, which stay for the ids they have unless force is set.
    """
    chunks = kept(dealt(chunks) if limit is None else chunks.orderBy("ord").limit(limit), "chunks")
    make = embedder or vectors.hashed_embedding
    if stored is None or force:  # no vector has to find its chunk
        vecs = vectors.embed(chunks.select("ord", "id", "text"), make, batch=batch).select("ord", "id", "v")
    else:
        vecs = chunks.select("ord", "id").join(vectors.indexed(chunks, stored, make, batch), "id").select("ord", "id", "v")
    vecs = kept(vecs, "vectors")
    posts, vocab, n, n_tokens = lexical.blocked(chunks)
    return Index(chunks, posts, vocab, vecs, n, n_tokens, *(() if embedder is None else (embedder, QUERY_PREFIX)))


def documents_of(pages: DataFrame, tables: DataFrame | None = None) -> DataFrame:
    """Pages (page, text) and tables as unified documents: records and courses, deduplicated, with ids."""
    found = records.page_records(pages, tables)
    if tables is not None:
        found = found.unionByName(records.table_records(tables))
    courses, found = materialised(records.page_courses(pages)), materialised(found)
    return materialised(documents.unified(documents.dedup_courses(courses), documents.dedup_records(found)))


def build(pages: DataFrame, tables: DataFrame | None = None, **options) -> Index:
    chunks = chunking.chunks(documents_of(pages, tables))
    numbered = documents.numbered(chunks.withColumn("__key", F.coalesce("page", F.lit(0))), "__key", ["document_id", "ordinal"], "ord")
    return index_of(numbered.select("ord", "id", "page", "type", "course_code", "title", "text"), **options)


def build_from_layout(pages: DataFrame, words: DataFrame, rects: DataFrame, sizes: DataFrame, raw: DataFrame, **options) -> Index:
    """An index of pages and of the tables found in their layout; see ``extraction.page_tables``."""
    return build(pages, materialised(extraction.page_tables(words, rects, sizes, raw)), **options)
