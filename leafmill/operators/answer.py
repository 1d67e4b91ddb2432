"""From hits to answers: context within a budget, sources, history, messages and transcripts."""

from __future__ import annotations

import inspect
from collections.abc import Callable, Iterator
from functools import partial

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import CONTEXT_CHARS, HISTORY_TURNS, Settings
from ..functions.text import strip

SYSTEM = "Answer from the excerpts alone. Each is labelled with its page as [p. N]; name the page of every fact, and say so if the excerpts hold no answer."
NOTHING = "No relevant excerpts were found for this question."
BREAK = "\n\n---\n\n"


def packed(hits: DataFrame, budget: int = CONTEXT_CHARS) -> DataFrame:
    """hits (query_id, rank, page, text) that fit: the first always, then as long as the running length does."""
    block = F.concat(F.lit("[p. "), F.coalesce(F.col("page").cast("string"), F.lit("None")), F.lit("] "), F.coalesce("text", F.lit("")))
    run = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = hits.withColumn("block", block).withColumn("__sum", F.sum(F.length("block")).over(run)).withColumn("__n", F.count(F.lit(1)).over(run))
    return rows.where((F.col("__n") == 1) | (F.col("__sum") <= budget)).drop("__sum", "__n")


def contexts(hits: DataFrame, budget: int = CONTEXT_CHARS) -> DataFrame:
    """query_id, context, n_blocks."""
    item = F.struct("rank", "block")
    return packed(hits, budget).groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda b: b["block"]), BREAK).alias("context"), F.count(F.lit(1)).alias("n_blocks"))


def source_label() -> Column:
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in ("course_code", "title", "type")], F.lit("excerpt"))


def unique_sources(sources: DataFrame) -> DataFrame:
    """sources (query_id, rank, page, course_code, title, type, methods) once for each label and page, by page."""
    named = sources.withColumn("label", source_label()).withColumn("at", F.coalesce("page", F.lit(0)))
    first = Window.partitionBy("query_id", "label", "page").orderBy("at", "rank")
    rows = named.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")
    return rows.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy("at", "rank")))


def footers(sources: DataFrame) -> DataFrame:
    """query_id, footer: a line for each source with the methods that found it."""
    via = F.coalesce(F.nullif(F.array_join("methods", "+"), F.lit("")), F.lit("?"))
    line = F.concat(F.lit("- "), "label", F.lit(" (p. "), F.coalesce(F.col("page").cast("string"), F.lit("None")), F.lit(") ["), via, F.lit("]"))
    rows = unique_sources(sources).withColumn("line", line)
    return rows.groupBy("query_id").agg(F.concat(F.lit("Sources:\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "line"))), lambda x: x["line"]), "\n")).alias("footer"))


def method_names(methods: Column) -> Column:
    return F.array_sort(F.transform(methods, lambda m: F.when(m == 0, "bm25").otherwise("vector")))


def badge(methods: Column) -> Column:
    return F.when(F.size(methods) == 0, "?").when(F.size(methods) == 2, "both").otherwise(F.array_join(methods, " "))


def history_tail(turns: DataFrame, pairs: int = HISTORY_TURNS) -> DataFrame:
    """The last messages of each conversation (conv_id, turn, role, text)."""
    back = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return turns.withColumn("back", F.row_number().over(back)).where(F.col("back") <= 2 * pairs).drop("back")


def retrieval_queries(questions: DataFrame, turns: DataFrame) -> DataFrame:
    """questions (conv_id, query) with the last user turn before them, unless it says the same."""
    last = turns.where("role = 'user'").groupBy("conv_id").agg(F.max_by("text", "turn").alias("last"))
    same = F.col("last").isNull() | (strip(F.col("last")) == "") | (strip(F.col("last")) == strip(F.col("query")))
    return questions.join(last, "conv_id", "left").withColumn("retrieval_query", F.when(same, F.col("query")).otherwise(F.concat_ws(" ", "last", "query"))).drop("last")


def messages(asked: DataFrame, turns: DataFrame, pairs: int = HISTORY_TURNS) -> DataFrame:
    """asked (conv_id, query, context) with the messages for a model: instructions, history, question."""
    item = F.struct("turn", "role", "text")
    tail = history_tail(turns, pairs).groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(item)), lambda m: F.struct(m["role"].alias("role"), m["text"].alias("content"))).alias("history"))
    question = F.concat(F.lit("Excerpts:\n\n"), "context", F.lit(BREAK + "Question: "), "query")
    one = lambda role, text: F.array(F.struct(F.lit(role).alias("role"), text.alias("content")))
    empty = F.expr("cast(array() as array<struct<role:string,content:string>>)")
    return asked.join(tail, "conv_id", "left").withColumn("messages", F.concat(one("system", F.lit(SYSTEM)), F.coalesce("history", empty), one("user", question))).drop("history")


def first_sentences(prompts: pd.Series) -> pd.Series:
    """The default generator: the beginning of the best excerpt, with its page."""
    return prompts.map(lambda c: c.split(BREAK)[0][:400] if c else NOTHING)


def answers(asked: DataFrame, generator: Callable[[pd.Series], pd.Series] = first_sentences) -> DataFrame:
    """asked (.., context) with an answer; without context the model is not called."""
    made = F.pandas_udf(_series(generator), "string")
    return asked.withColumn("answer", F.when(F.coalesce("context", F.lit("")) == "", F.lit(NOTHING)).otherwise(made("context")))


def _series(generator: Callable[[pd.Series], pd.Series]):
    def run(prompts: pd.Series) -> pd.Series:
        return generator(prompts.fillna(""))

    return run  # a plain function with hints, whatever the generator is


def with_options(generator: Callable[..., pd.Series], settings: Settings) -> Callable[[pd.Series], pd.Series]:
    """The generator with the settings as its ``options``, where it has that parameter."""
    if "options" not in inspect.signature(generator).parameters:
        return generator
    return partial(generator, options={"temperature": settings.temperature, "num_ctx": settings.context_tokens})


def guarded(generator: Callable[[pd.Series], pd.Series]) -> Callable[[pd.Series], pd.Series]:
    """The generator prompt by prompt, with an error as the answer to a prompt it fails on."""

    def one(prompt: str, **options) -> str:
        try:
            return generator(pd.Series([prompt]), **options).iloc[0]
        except Exception as e:  # noqa: BLE001  the user's own code
            return f"Something went wrong generating an answer: {e}"

    if "options" in inspect.signature(generator).parameters:
        return lambda prompts, options: prompts.map(lambda p: one(p, options=options))
    return lambda prompts: prompts.map(one)


def word_by_word(context: str) -> Iterator[str]:
    """The default generator of a stream: its answer in pieces, made as they are taken."""
    for word in first_sentences(pd.Series([context])).iloc[0].split(" "):
        yield word + " "


def transcripts(turns: DataFrame) -> DataFrame:
    """conv_id, transcript, n_messages: the messages in order with who said them.

    Where turns have sources (label, page), they follow the answer, one a line.
    """
    who = F.when(F.col("role") == "user", "**You**").otherwise("**Assistant**")
    line = F.concat(who, F.lit(": "), F.coalesce("text", F.lit("")))
    if "sources" in turns.columns:
        listed = F.transform("sources", lambda x: F.concat(F.lit("\n  - "), x["label"], F.lit(" (p. "), F.coalesce(x["page"].cast("string"), F.lit("None")), F.lit(")")))
        line = F.concat(line, F.when(F.col("role") == "assistant", F.coalesce(F.array_join(listed, ""), F.lit(""))).otherwise(""))
    rows = turns.withColumn("line", line)
    return rows.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "line"))), lambda x: x["line"]), "\n\n").alias("transcript"), F.count(F.lit(1)).alias("n_messages"))


def timing(retrieval: Column, first: Column, total: Column) -> Column:
    """The timings that there are, as one caption."""
    part = lambda name, c: F.when(c.isNotNull(), F.concat(F.lit(name), F.format_string("%.2f", c), F.lit("s")))
    return F.concat_ws(" · ", part("retrieval ", retrieval), part("first token ", first), part("total ", total))


def before_regeneration(turns: DataFrame) -> DataFrame:
    """History without the last question and what was answered to it."""
    last = turns.where("role = 'user'").groupBy("conv_id").agg(F.max("turn").alias("last"))
    return turns.join(last, "conv_id", "left").where("last is null or turn < last").drop("last")
