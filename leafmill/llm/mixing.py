"""Operator 9: mixing sources to target weights by iterative proportional fitting.

Documents are counted into cells of source, language and topic by their tokens.  The cells' weights
are raked until their token totals meet the target share of every source, language and topic
at once, and each document is kept by a calibrated probability, decided by a hash of its id, so the choice is
the same on every run and machine.

The probabilities keep ``share`` of all tokens: a value's target is at most what it has, the rest goes to the
other values in proportion, and cells that reach 1 stay there while the others are raked on.  A stray value is
kept whole and changes next to nothing else.  Values without any tokens are left to the other margins.

A marginal's target shares are those given (a table of value and share), else its natural shares to the power
ALPHA.  Of given targets, values without tokens are passed over; a value that is not among them has the target 0.
``achieved`` reports what every value was to have and has.

Cells are sums over all rows.  Up to CELLS of them with names of CELL_BYTES (both checked) are raked on the
driver and broadcast, so no document is shuffled; more are raked and joined by Spark.

Defined cases: a null source or language is the value ''; a null text has no tokens and topic 'short'; a text of
any length is counted whole; documents without tokens have the probability of their cell; rows without an id draw
as the empty string; repeated rows and rows of one id draw alike, so those of a cell stay or go together; ties
do not arise; an empty table gives no rows; further columns, also such as topic, p or w, are ignored by ``mixed`` and
kept by ``mix``.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, table, text_or_empty, written

ALPHA, ROUNDS, CELLS, CELL_BYTES = 0.7, 20, 100_000, 32 << 20
MARGINS = ("source", "lang", "topic")
#: Share of all tokens that is kept; a probability this near to 1 is 1.
SHARE, NEAR = 0.3, 1e-9


def topic_of(text: Column, tokens: Column) -> Column:
    """A plain rule, where no topic is given: licence texts, symbol-ridden texts, long and short prose."""
    return (
        F.when(F.lower(text).contains("license"), F.lit("legal"))
        .when(text.rlike(r"[|#$%&*]"), F.lit("symbols"))
        .when(tokens >= 300, F.lit("long"))
        .otherwise(F.lit("short"))
    )


def tokens_of(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"[ \t\n\r\f\x0b]+"), lambda w: w != F.lit(""))).cast("long")


def named(c: str, name: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name)


def _topic(text: Column, tokens: Column, topic: Column | None) -> Column:
    return topic_of(text, tokens) if topic is None else F.coalesce(topic.cast("string"), F.lit(""))


def described(docs: DataFrame, topic: Column | None = None) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens of every row; topic is a column of docs, or follows a plain rule."""
    text = text_or_empty()
    rows = docs.select(F.struct("*").alias("doc"), tokens_of(text).alias("n_tokens"), _topic(text, tokens_of(text), topic).alias("topic"))
    return rows.select("doc.doc_id", named("doc.source", "source"), named("doc.lang", "lang"), "topic", "n_tokens")


def cells_of(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*MARGINS).agg(F.sum("n_tokens").alias("tokens"))


def targets_of(cells: DataFrame, margin: str, alpha: float = ALPHA, given: DataFrame | None = None) -> DataFrame:
    """margin's values that have tokens, their total and target share."""
    by = cells.groupBy(margin).agg(F.sum("tokens").cast("double").alias("total")).where("total > 0")
    if given is None:
        by = by.withColumn("part", F.pow("total", F.lit(alpha)))
    else:
        wanted = given.groupBy(F.coalesce(F.col("value").cast("string"), F.lit("")).alias(margin)).agg(F.sum(F.col("share").cast("double")).alias("part"))
        by = by.join(wanted, margin, "left").withColumn("part", F.greatest(F.coalesce("part", F.lit(0.0)), F.lit(0.0)))
    every = by.agg(F.sum("part")).first()[0] or 1.0
    return by.select(margin, "total", (F.col("part") / F.lit(every)).alias("target"))


def rake(keys: list[np.ndarray], tokens: np.ndarray, targets: list[np.ndarray], rounds: int = ROUNDS) -> np.ndarray:
    """Factors on the cells' tokens whose totals meet each margin's targets in turn.  keys: positions in targets."""
    w = np.ones(len(tokens))
    total = tokens.sum()
    for _ in range(rounds):
        for key, target in zip(keys, targets, strict=True):
            have = np.bincount(key, w * tokens, len(target)) / total
            w *= np.divide(target, have, out=np.zeros_like(target), where=have > 0)[key]
    return w


def level(most: np.ndarray, at: np.ndarray, want: float, rounds: int = 50) -> float:
    """c with sum(min(most, c * at)) = want, from below by Newton steps; where all are full, the last c."""
    c = want / at.sum() if at.sum() else 0.0
    for _ in range(rounds):
        full = c * at >= most
        if full.all() or (new := (want - most[full].sum()) / at[~full].sum() if at[~full].sum() else c) <= c:
            break
        c = new
    return c


def _capped(p: np.ndarray) -> np.ndarray:
    return np.where(p >= 1 - NEAR, 1.0, p)


def bounded(keys: list[np.ndarray], tokens: np.ndarray, targets: list[np.ndarray], share: float, rounds: int = ROUNDS) -> np.ndarray:
    """Probabilities of the cells that keep ``share`` of the tokens, by the targets as far as there are tokens."""
    want, p = share * tokens.sum(), np.full(len(tokens), float(share))
    if not tokens.sum():
        return np.ones(len(tokens))
    totals = [np.bincount(key, tokens, len(t)) for key, t in zip(keys, targets, strict=True)]
    goals = [np.minimum(total, level(total, t, want) * t) for total, t in zip(totals, targets, strict=True)]
    for _ in range(rounds):
        for key, total, goal in zip(keys, totals, goals, strict=True):
            full = np.bincount(key, np.where(p >= 1, tokens, 0), len(goal))
            part = np.bincount(key, np.where(p < 1, p * tokens, 0), len(goal))
            have = full + part
            step = np.where(have >= goal, goal / np.where(have > 0, have, 1), np.where(part > 0, (goal - full) / np.where(part > 0, part, 1), 1))
            p = _capped(p * np.where(total > 0, step, 1)[key])
    return _capped(level(tokens, p * tokens, want) * p)


def _level_spark(rows: DataFrame, most: str, at: Column, want: float, rounds: int = 50) -> float:
    """``level`` over rows, by one aggregate a step."""
    rows = rows.select(F.col(most).cast("double").alias("most"), at.cast("double").alias("at"))
    c = want / (rows.agg(F.sum("at")).first()[0] or np.inf)
    for _ in range(rounds):
        full = F.lit(c) * F.col("at") >= F.col("most")
        held, left = rows.agg(F.sum(F.when(full, F.col("most"))), F.sum(F.when(~full, F.col("at")))).first()
        if not left or (new := (want - (held or 0.0)) / left) <= c:
            break
        c = new
    return c


def _stepped(now: DataFrame, steps: DataFrame, margin: str, most: int = CELLS) -> DataFrame:
    """now with the step of its margin's value; few values are broadcast, so their many cells do not meet in a task."""
    steps = written(steps, "mix-steps")
    return now.join(F.broadcast(steps) if steps.count() <= most else steps, margin, "left")


def _weights_spark(cells: DataFrame, targets: list[DataFrame], share: float, rounds: int) -> DataFrame:
    """w and p as ``rake`` and ``bounded`` have them, for more cells than the driver should hold; each round is written."""
    total = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    if not total:
        return cells.select(*MARGINS, F.lit(1.0).alias("w"), F.lit(1.0).alias("p"))
    targets = [written(t, "mix-targets") for t in targets]
    now, w, p, t = cells.withColumn("w", F.lit(1.0)).withColumn("p", F.lit(float(share))), F.col("w"), F.col("p"), F.col("tokens").cast("double")
    goals = [F.lit(_level_spark(by, "total", F.col("target"), share * total)) * F.col("target") for by in targets]
    for _ in range(rounds):
        for margin, by, goal in zip(MARGINS, targets, goals, strict=True):
            sums = now.groupBy(margin).agg(F.sum(w * t).alias("raked"), F.sum(F.when(p >= 1, t).otherwise(0.0)).alias("full"), F.sum(F.when(p < 1, p * t).otherwise(0.0)).alias("part"))
            have, want = F.col("full") + F.col("part"), F.least(F.col("total"), goal)
            step = F.when((have >= want) & (have > 0), want / have).when((have < want) & (F.col("part") > 0), (want - F.col("full")) / F.col("part")).otherwise(1.0)
            rake_step = F.when(F.col("raked") > 0, F.col("target") * total / F.col("raked")).otherwise(0.0)
            now = _stepped(now, sums.join(by, margin).select(margin, step.alias("step"), rake_step.alias("rake_step")), margin)
            moved = p * F.coalesce("step", F.lit(1.0))
            now = now.withColumn("p", F.when(moved >= 1 - NEAR, 1.0).otherwise(moved)).withColumn("w", w * F.coalesce("rake_step", F.lit(0.0))).drop("step", "rake_step")
        before, now = now, written(now, "mix-round")
        dropped(before)
    moved = p * F.lit(_level_spark(now, "tokens", p * t, share * total))
    return now.select(*MARGINS, "w", F.when(moved >= 1 - NEAR, 1.0).otherwise(moved).alias("p"))


def weights(cells: DataFrame, alpha: float = ALPHA, rounds: int = ROUNDS, most: int = CELLS, share: float = SHARE, targets: dict[str, DataFrame] | None = None) -> DataFrame:
    """source, lang, topic, w, p: the raked factor of each cell (cells has tokens) and its probability.

    The probabilities keep ``share`` (above 0, up to 1) of the tokens.  targets: tables (value, share) for some of
    the margins.
    """
    if not 0 < share <= 1:
        raise ValueError("share is above 0 and at most 1")
    if unknown := set(targets or ()) - set(MARGINS):
        raise ValueError(f"no margins {sorted(unknown)}")
    cells = written(cells, "cells")
    n, size = cells.agg(F.count(F.lit(1)), F.sum(sum(F.octet_length(m) for m in MARGINS))).first()
    aims = [targets_of(cells, m, alpha, (targets or {}).get(m)) for m in MARGINS]
    if n > most or (size or 0) > CELL_BYTES:
        return _weights_spark(cells, aims, share, rounds)
    rows = sorted(cells.collect(), key=lambda r: tuple(r[m] for m in MARGINS))
    tokens = np.array([float(r.tokens) for r in rows])
    keys, shares = [], []
    for m, aim in zip(MARGINS, aims, strict=True):
        # the values of a margin are no more than the cells
        values, wanted = sorted({r[m] for r in rows}), {r[m]: r.target for r in aim.collect()}
        place = {v: i for i, v in enumerate(values)}
        keys.append(np.array([place[r[m]] for r in rows], np.int64))
        shares.append(np.array([wanted.get(v, 0.0) for v in values]))
    w = rake(keys, tokens, shares, rounds) if tokens.sum() else np.ones(len(rows))
    p = bounded(keys, tokens, shares, share, rounds)
    raked = [(*(r[m] for m in MARGINS), float(x), float(y)) for r, x, y in zip(rows, w, p, strict=True)]
    return F.broadcast(cells.sparkSession.createDataFrame(raked, "source string, lang string, topic string, w double, p double"))


def achieved(docs: DataFrame, share: float = SHARE, targets: dict[str, DataFrame] | None = None, topic: Column | None = None) -> DataFrame:
    """margin, value, tokens, target, share, residual: each value's target share, what it is expected to have, and the rest."""
    cells = written(cells_of(described(docs, topic)), "cells")
    kept = written(cells.join(weights(cells, share=share, targets=targets), list(MARGINS)).withColumn("kept", F.col("p") * F.col("tokens")), "mix-kept")
    total, out = kept.agg(F.sum("kept")).first()[0] or 1.0, None
    for m in MARGINS:
        by = kept.groupBy(m).agg(F.sum("kept").alias("kept")).join(targets_of(cells, m, ALPHA, (targets or {}).get(m)), m)
        part = by.select(F.lit(m).alias("margin"), F.col(m).alias("value"), F.col("total").cast("long").alias("tokens"), "target", (F.col("kept") / F.lit(total)).alias("share"))
        out = part if out is None else out.unionByName(part)
    return out.withColumn("residual", F.col("target") - F.col("share"))


def drawn(doc_id: Column) -> Column:
    """52 bits of a digest as a number from 0 to 1, the same in any engine; whether it is below the cell's p."""
    bits = F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 13), 16, 10)
    return bits.cast("double") / float(1 << 52) < F.col("p")


def mixed(docs: DataFrame, alpha: float = ALPHA, rounds: int = ROUNDS, share: float = SHARE, targets: dict[str, DataFrame] | None = None, topic: Column | None = None) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens, weight, p, sampled for every row."""
    rows = described(docs, topic)
    joined = rows.join(weights(cells_of(rows), alpha, rounds, share=share, targets=targets), list(MARGINS))
    return joined.select("doc_id", *MARGINS, "n_tokens", F.round("w", 6).alias("weight"), F.round("p", 6).alias("p"), drawn(F.col("doc_id")).alias("sampled"))


def mix(docs: DataFrame, alpha: float = ALPHA, rounds: int = ROUNDS, share: float = SHARE, targets: dict[str, DataFrame] | None = None, topic: Column | None = None) -> DataFrame:
    """The rows of docs that are drawn, with their columns."""
    w = weights(cells_of(described(docs, topic)), alpha, rounds, share=share, targets=targets)
    text = text_or_empty()
    placed = docs.select(F.struct("*").alias("doc"), named("source", "source"), named("lang", "lang"), _topic(text, tokens_of(text), topic).alias("topic"))
    return placed.join(w, list(MARGINS)).where(drawn(F.col("doc.doc_id"))).select("doc.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents"))


def oracle(alpha: float = ALPHA, rounds: int = ROUNDS, share: float = SHARE) -> str:
    """The same in SQL: cells, targets, the raking of w and of p round by round, and the draw."""
    steps = [
        r"""d AS MATERIALIZED (SELECT *, CASE WHEN contains(lower(t), 'license') THEN 'legal' WHEN regexp_matches(t, '[|#$%&*]') THEN 'symbols' WHEN n_tokens >= 300 THEN 'long' ELSE 'short' END AS topic
  FROM (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, coalesce(text, '') AS t, cast(len(list_filter(string_split_regex(coalesce(text, ''), '[ \t\n\r\f\x0b]+'), lambda x: x <> '')) AS bigint) AS n_tokens FROM documents))""",
        f"c0 AS MATERIALIZED (SELECT source, lang, topic, cast(sum(n_tokens) AS double) AS tokens, 1.0::double AS w, {share}::double AS p FROM d GROUP BY ALL)",
        "total AS (SELECT sum(tokens) AS total FROM c0)",
    ]
    # the level c with sum(least(most, c * part)) = want: rows in the order of most / part, those before the first that is not full
    level = """(SELECT arg_min(c, i) FROM (SELECT row_number() OVER w AS i, (want - coalesce(sum(most) OVER w, 0)) / nullif(sum(part) OVER () - coalesce(sum(part) OVER w, 0), 0) AS c, most / part AS r
    FROM ({rows}) WHERE part > 0 WINDOW w AS (ORDER BY most / part, most ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) WHERE c <= r)"""
    for m in MARGINS:
        steps.append(f"s_{m} AS MATERIALIZED (SELECT {m}, total, part / sum(part) OVER () AS target FROM (SELECT {m}, sum(tokens) AS total, pow(sum(tokens), {alpha}) AS part FROM c0 GROUP BY {m} HAVING sum(tokens) > 0))")
        rows = f"SELECT total AS most, target AS part, {share} * (SELECT total FROM total) AS want FROM s_{m}"
        steps.append(f"t_{m} AS MATERIALIZED (SELECT {m}, target, least(total, target * coalesce({level.format(rows=rows)}, 1e300)) AS goal FROM s_{m})")
    n = 0
    for _ in range(rounds):
        for m in MARGINS:
            over = f"OVER (PARTITION BY {m})"
            steps.append(f"""c{n + 1} AS MATERIALIZED (SELECT source, lang, topic, tokens, w, CASE WHEN p >= 1 - {NEAR} THEN 1.0::double ELSE p END AS p FROM (
  SELECT source, lang, topic, tokens, w * coalesce(target / nullif(raked / (SELECT total FROM total), 0), 0) AS w,
    p * CASE WHEN goal IS NULL THEN 1 WHEN f + q >= goal AND f + q > 0 THEN goal / (f + q) WHEN f + q < goal AND q > 0 THEN (goal - f) / q ELSE 1 END AS p
  FROM (SELECT *, sum(w * tokens) {over} AS raked, sum(CASE WHEN p >= 1 THEN tokens ELSE 0 END) {over} AS f, sum(CASE WHEN p < 1 THEN p * tokens ELSE 0 END) {over} AS q FROM c{n}) LEFT JOIN t_{m} USING ({m})))""")
            n += 1
    rows = f"SELECT tokens AS most, p * tokens AS part, {share} * (SELECT total FROM total) AS want FROM c{n}"
    steps.append(f"last AS MATERIALIZED (SELECT source, lang, topic, w, CASE WHEN p >= 1 - {NEAR} THEN 1.0::double ELSE p END AS p FROM (SELECT source, lang, topic, w, p * coalesce({level.format(rows=rows)}, 1) AS p FROM c{n}))")
    return "WITH " + ",\n".join(steps) + """
SELECT doc_id, source, lang, topic, n_tokens, round(w, 6) AS weight, round(p, 6) AS p,
  cast(concat('0x', substr(md5(coalesce(cast(doc_id AS varchar), '')), 1, 13)) AS bigint) / 4503599627370496.0 < p AS sampled
FROM d JOIN last USING (source, lang, topic)
"""


SQL = oracle()
