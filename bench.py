"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import functions as F

from leafmill.plans import index as plan
from leafmill.plans import queries as Q
from verify_queries import session

HEADLINE = ["chunk_text", "bm25_batch", "cosine_batch", "rrf_fusion", "context_pack", "sources_footer", "answers"]


def main() -> None:
    d, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark, took = session(cpus), {}

    def timed(name: str, run) -> None:
        began = time.time()
        run()
        took[name] = round(time.time() - began, 3)

    sink = lambda df: df.write.format("noop").mode("overwrite").save()
    sink(spark.read.parquet(f"{d}/documents.parquet"))
    asked, folder = Q._questions(spark, d), tempfile.mkdtemp(prefix="spark-")
    docs = Q._pages(spark, d)
    none = F.lit("")
    chunks = docs.select(F.col("doc_id").alias("ord"), F.col("doc_id").cast("string").alias("id"), "page", F.lit("prose").alias("type"), none.alias("course_code"), none.alias("title"), "text")
    # postings, vocabulary, embeddings and all files
    timed("index_build", lambda: plan.index_of(chunks).save(folder))
    timed("search_batch", lambda: sink(plan.Index.load(spark, folder).hits(asked)))
    one = spark.createDataFrame([(r.query_id, r.text) for r in asked.limit(1).collect()], "query_id long, text string")
    timed("search_one", lambda: sink(plan.Index.load(spark, folder).hits(one)))
    for name in HEADLINE:
        timed(name, lambda name=name: sink(Q.QUERIES[name](spark, d)))
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "seconds_a_question": round(took["search_batch"] / max(1, asked.count()), 4), "sf": d.rstrip("/").rpartition("sf")[2]}))


if __name__ == "__main__":
    main()
