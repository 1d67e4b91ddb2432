"""Operator 4: toxicity by weak supervision.

1. Voters: terms (words and word beginnings) that stand out in labelled toxic rows, lexicons in four
   languages, and patterns of writing.  Each votes toxic, clean or not at all on a text.
2. A generative label model estimates each voter's rates given the unseen class by expectation
   maximisation, and the correlations of voters within a class, by which it discounts voters that
   repeat each other.  A row's label is one more voter, so a wrong label can be outvoted.
3. A linear classifier is fitted to the posterior labels and scores every text.

The voters and both models are fitted on at most SAMPLE labelled rows that may be learnt from, taken
by a hash of the id; scoring is one pass over all texts without a shuffle.

Defined cases: a null text scores as an empty one; a text of any length is scored whole; where no labelled row
may be learnt from, or none of a class, every score is the share of toxic rows (0 if there are none); a document
labelled twice counts as toxic if any label says so; of several texts under one id the first in order is learnt
from, so an id counts once; a null id or label is not learnt from, and its row is scored; terms that stand out alike are
taken in the order of their bytes; repeated rows score alike; an empty table gives no rows; further columns, whatever
their names, are ignored by ``learn`` and ``score`` and kept by ``keep_clean``.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD_TABLE, dropped, fold, map_arrow, table, text_or_empty, written

SAMPLE, MAX_TERMS, STEMS = 20_000, 200, (4, 5, 6)
MIN_ROWS, MIN_Z = 3, 4.0

#: Common insults, by language.
LEXICONS = {
    "en": "idiot idiots moron morons stupid scum trash clown loser losers pathetic worthless disgusting dumb garbage imbecile jerk filth vermin pig",
    "de": "idiot dumm dummkopf abschaum trottel versager arschloch widerlich depp mistkerl wertlos schwein",
    "fr": "idiot idiote imbecile stupide ordure salaud connard crétin abruti débile dégoûtant minable",
    "es": "idiota imbécil estúpido estúpida basura escoria payaso patético asqueroso tonto inútil cerdo",
}
#: Patterns of writing, on the raw text.
PATTERNS = {
    "shouting": r"(?:\b[A-Z]{4,}\b[^A-Za-z]+){3}",
    "exclaiming": r"!{2,}",
    "masked": r"\b[A-Za-z]{1,3}[*@#$]{2,}[A-Za-z]*",
    "spelled_out": r"\b(?:[A-Za-z][.\-_]){3,}[A-Za-z]\b",
    "addressed": r"(?i)\byou(?:'re| are)? (?:\w+ )?(?:all|people|lot)\b",
    "wish_of_harm": r"(?i)\b(?:shut up|go away|get lost|drop dead)\b",
}


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(WORD_TABLE).split()


def terms_of(words: list[bytes]) -> set[bytes]:
    """Words, and beginnings of words marked with a star."""
    out = set(words)
    for w in list(out):
        out.update([w[:n] + b"*" for n in STEMS if len(w) > n])
    return out


class Voters:
    """Terms, lexicons and patterns; what each says on a text."""

    def __init__(self, terms: list[bytes]) -> None:
        self.whole = {t: i for i, t in enumerate(terms) if not t.endswith(b"*")}
        self.begun = {t[:-1]: i for i, t in enumerate(terms) if t.endswith(b"*")}
        self.lexicons = [frozenset(w.encode() for w in words.split()) for words in LEXICONS.values()]
        self.patterns = [re.compile(p) for p in PATTERNS.values()]
        self.n_terms = len(terms)
        #: terms, lexicons, patterns, "no term at all", "several terms"
        self.size = self.n_terms + len(self.lexicons) + len(self.patterns) + 2

    def counts(self, text: str) -> np.ndarray:
        """How often each term, lexicon and pattern occurs in the whole text."""
        out = np.zeros(self.size, np.float32)
        words = words_of(text)
        whole, begun = self.whole.get, self.begun.get
        for w in words:
            if (i := whole(w)) is not None:
                out[i] += 1
            for n in STEMS:
                if len(w) > n and (i := begun(w[:n])) is not None:
                    out[i] += 1
        present, at = set(words), self.n_terms
        for lexicon in self.lexicons:
            out[at] = len(lexicon & present)
            at += 1
        for p in self.patterns:
            out[at] = p.search(text) is not None
            at += 1
        found = int((out[: self.n_terms] > 0).sum())
        out[at], out[at + 1] = found == 0, found > 1
        return out


def standing_out(rows: DataFrame, y_rows: tuple[int, int], limit: int = MAX_TERMS) -> list[bytes]:
    """The terms whose share of toxic rows is significantly above that of clean rows."""

    def one(batch: pa.RecordBatch) -> dict:
        seen: dict[bytes, list[int]] = {}
        for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist(), strict=True):
            for t in terms_of(words_of(text)):
                seen.setdefault(t, [0, 0])[y] += 1
        toxic = {t: c for t, c in seen.items() if c[1]}  # a term that only clean rows have cannot stand out
        return {"term": list(toxic), "n0": [c[0] for c in toxic.values()], "n1": [c[1] for c in toxic.values()]}

    n0, n1 = map(float, y_rows)
    counted = map_arrow(rows.select("text", "y"), one, "term binary, n0 long, n1 long").groupBy("term").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    p = (F.col("n0") + F.col("n1")) / (n0 + n1)
    z = (F.col("n1") / n1 - F.col("n0") / n0) / F.sqrt(p * (1 - p) * (1 / n0 + 1 / n1) + 1e-12)
    best = counted.where((F.col("n1") >= MIN_ROWS) & (F.col("n1") / n1 > 4 * F.col("n0") / n0)).select("term", "n0", "n1", z.alias("z")).where(F.col("z") >= MIN_Z)
    chosen: list[bytes] = []
    taken: dict[bytes, int] = {}
    # a longer term adds nothing where a shorter beginning of it was taken
    for r in best.orderBy(F.desc("z"), "term").limit(8 * limit).collect():
        t = bytes(r.term)
        stem = t.rstrip(b"*")
        if len(chosen) < limit and not any(stem[:n] in taken for n in STEMS):
            chosen.append(t)
            if t.endswith(b"*"):
                taken[stem] = r.n1
    return chosen


class LabelModel:
    """Rates of binary voters given the class, their correlations within a class, and the class's share."""

    def __init__(self, votes: np.ndarray, labels: np.ndarray, rounds: int = 25) -> None:
        v = np.column_stack([votes, labels]).astype(np.float64)
        q = np.where(labels > 0, 0.95, 0.02)  # the start; the rounds decide, but for the class's share
        self.prior = float(np.clip((labels > 0).mean(), 1e-4, 1 - 1e-4))
        for _ in range(rounds):
            self.toxic = (q @ v + 0.5) / (q.sum() + 1)
            self.clean = ((1 - q) @ v + 0.5) / ((1 - q).sum() + 1)
            self.discount = 1 / self.repeats(v, q)
            q = self.posterior(v)
        self.q = q

    def repeats(self, v: np.ndarray, q: np.ndarray) -> np.ndarray:
        """For each voter, 1 plus its squared correlations with other voters within the classes."""
        h = (q > 0.5).astype(np.float64)  # whole rows: shares of a row in both classes would look like correlation
        left = v - np.outer(h, h @ v / max(h.sum(), 1)) - np.outer(1 - h, (1 - h) @ v / max((1 - h).sum(), 1))
        sd = np.sqrt((left**2).mean(0)) + 1e-3  # voters that say next to nothing repeat nobody
        self.correlation = (left.T @ left) / len(v) / np.outer(sd, sd)
        off = self.correlation - np.diag(np.diag(self.correlation))
        return 1 + (off**2).sum(0)

    def posterior(self, v: np.ndarray) -> np.ndarray:
        on = np.log(self.toxic / self.clean) * self.discount
        off = np.log((1 - self.toxic) / (1 - self.clean)) * self.discount
        logit = np.log(self.prior / (1 - self.prior)) + v @ on + (1 - v) @ off
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def fit_linear(x: np.ndarray, q: np.ndarray, penalty: float = 2.0, rounds: int = 12) -> np.ndarray:
    """Logistic regression on soft labels by Newton steps; the last weight is the constant's."""
    x = np.column_stack([x, np.ones(len(x))]).astype(np.float64)
    w = np.zeros(x.shape[1])
    keep = np.full(x.shape[1], penalty)
    keep[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(keep), x.T @ (q - p) - keep * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


class Model:
    """Voters with the classifier's weights, or a constant where nothing could be learnt."""

    def __init__(self, voters: Voters, weights: np.ndarray | None, constant: float = 0.0) -> None:
        self.voters, self.weights, self.constant = voters, weights, constant

    def score(self, text: str) -> float:
        if self.weights is None:
            return self.constant
        x = np.log1p(self.voters.counts(text)).astype(np.float64)
        return float(1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -30, 30))))


def learn(docs: DataFrame, labels: DataFrame, may_learn: Column, sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` labelled rows for which ``may_learn`` (of doc_id) holds."""
    spark = docs.sparkSession
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).where(may_learn).groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("y"))
    # bounded: at most ``sample`` pairs of numbers
    chosen = known.orderBy(F.xxhash64(F.lit("toxicity"), F.col("doc_id")), "doc_id").limit(sample)
    chosen = written(chosen, "toxicity-sample")
    found = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(chosen), "doc_id")
    rows = written(found.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y")).select("text", "y"), "toxicity-rows")
    by = {r.y: r.n for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n0, n1 = by.get(0, 0), by.get(1, 0)
    if not n0 or not n1:
        return Model(Voters([]), None, float(n1 > 0))
    voters = Voters(standing_out(rows, (n0, n1)))
    sent = spark.sparkContext.broadcast(voters)

    def one(batch: pa.RecordBatch) -> dict:
        counts = [np.minimum(sent.value.counts(t), 255).astype(np.uint8).tobytes() for t in batch.column("text").to_pylist()]
        return {"y": batch.column("y"), "counts": counts}

    # bounded: ``sample`` rows of MAX_TERMS and a few bytes
    got = sorted((r.y, bytes(r.counts)) for r in map_arrow(rows, one, "y int, counts binary").collect())
    dropped(chosen, rows)
    counts = np.array([np.frombuffer(c, np.uint8) for _, c in got])
    y = np.array([y for y, _ in got])
    q = LabelModel((counts > 0).astype(np.float32), y).q
    return Model(voters, fit_linear(np.log1p(counts.astype(np.float64)), q))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = dict(docs.dtypes)["doc_id"].replace("bigint", "long")

    def one(batch: pa.RecordBatch) -> dict:
        return {"doc_id": batch.column("doc_id"), "score": [sent.value.score(t) for t in batch.column("text").to_pylist()]}

    return map_arrow(docs.select("doc_id", text_or_empty().alias("text")), one, f"doc_id {kind}, score double")


def keep_clean(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """docs without those whose score reaches the threshold; null texts stay."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(texts):
        return texts.fillna("").map(lambda t: sent.value.score(t)).astype("float64")

    return docs.where(scored("text") < threshold)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), fold("doc_id", 5) == 0
    model = learn(docs, table(spark, sf_dir, "labels"), ~held_out)
    return score(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
