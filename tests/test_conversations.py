"""A stream of turns against the batch functions."""

import random

import pytest
from pyspark.sql import functions as F

from leafmill.operators import answer
from leafmill.streaming import conversations

DDL = "conv_id long, turn long, role string, text string"


def plain(rows):
    out = {}
    for c in {r[0] for r in rows}:
        said = sorted((r for r in rows if r[0] == c), key=lambda r: r[1])
        last = None
        for i, (_, turn, role, text) in enumerate(said):
            text = text or ""
            if role == "user":
                q = text if last is None or not last.strip() or last.strip() == text.strip() else f"{last} {text}"
                out[c, turn] = (text, q, [r[2] for r in said[max(0, i - 6) : i]], [r[3] or "" for r in said[max(0, i - 6) : i]])
                last = text
    return out


@pytest.fixture
def ending(spark):
    """Streams with timeouts end when all there is has been read."""
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    yield
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")


def test_turn_by_turn(spark, tmp_path, ending):
    rng = random.Random(7)
    rows = [(c, t, "user" if t % 2 == 0 else rng.choice(["assistant", "system"]), rng.choice(["what", " what ", "why so", "", None, "who"])) for c in range(6) for t in range(rng.randint(1, 13))]
    source, sink, at = (str(tmp_path / x) for x in ("turns", "out", "checkpoint"))
    for low, high in ((0, 1), (1, 2), (2, 7), (5, 99)):  # turns 5 and 6 arrive again
        part = [r for r in rows if low <= r[1] < high]
        rng.shuffle(part)
        spark.createDataFrame(part, DDL).repartition(2).write.mode("append").parquet(source)
        stream = conversations.followed(spark.readStream.schema(DDL).parquet(source))
        query = stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", at).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    found = spark.read.parquet(sink).collect()
    got = {(r.conv_id, r.turn): (r["query"], r.retrieval_query, r.roles, r.contents) for r in found}
    assert len(got) == len(found) and got == plain(rows)
    # the batch functions say the same of each conversation's last question
    turns = spark.createDataFrame(rows, DDL).withColumn("text", F.coalesce("text", F.lit("")))
    last = turns.where("role = 'user'").groupBy("conv_id").agg(F.max(F.struct("turn", "text")).alias("x")).select("conv_id", F.col("x.turn").alias("turn"), F.col("x.text").alias("query"))
    earlier = turns.join(last.select("conv_id", F.col("turn").alias("at")), "conv_id").where("turn < at").drop("at")
    for r in answer.retrieval_queries(last, earlier).collect():
        assert got[r.conv_id, r.turn][1] == r.retrieval_query
    tails = {}
    for r in answer.history_tail(earlier).orderBy("turn").collect():
        tails.setdefault(r.conv_id, []).append((r.role, r.text))
    for r in last.collect():
        assert list(zip(*got[r.conv_id, r.turn][2:], strict=True)) == tails.get(r.conv_id, [])
