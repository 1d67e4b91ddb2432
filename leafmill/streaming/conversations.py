"""Conversations as state: each question that arrives leaves with its retrieval query and the history before it.

The state of a conversation is its last messages, so a question needs no join with what was said before.  It is kept for
``ttl`` after the last message and then forgotten.

Defined cases: messages of one batch count in the order of their turns; a turn that is not above the last one, as
when a batch is read again, is passed over; a null text counts as empty; the messages of other roles than
``user`` are remembered and give no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..config import HISTORY_TURNS

OUT = "conv_id long, turn long, query string, retrieval_query string, roles array<string>, contents array<string>"
#: The last messages, and the last question.
STATE = "turns array<long>, roles array<string>, texts array<string>, asked string"
#: Milliseconds that a silent conversation is remembered.
TTL = 24 * 3600 * 1000


def _follower(keep: int, ttl: int):
    def run(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        arrived = pd.concat(list(rows)).drop_duplicates("turn").sort_values("turn")
        turns, roles, texts, last = state.get if state.exists else ([], [], [], None)
        turns, roles, texts, out = list(turns), list(roles), list(texts), []
        for turn, role, text in zip(arrived["turn"].tolist(), arrived["role"], arrived["text"].fillna(""), strict=True):
            if turns and turn <= turns[-1]:
                continue
            if role == "user":
                query = text if last is None or not last.strip() or last.strip() == text.strip() else f"{last} {text}"
                out.append((key[0], turn, text, query, roles, texts))
                last = text
            turns, roles, texts = ([*x, y][-keep:] for x, y in ((turns, turn), (roles, role), (texts, text)))
        state.update((turns, roles, texts, last))
        state.setTimeoutDuration(ttl)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])

    return run


def followed(turns: DataFrame, pairs: int = HISTORY_TURNS, ttl: int = TTL) -> DataFrame:
    """conv_id, turn, query, retrieval_query, roles, contents for each question of a stream of turns (conv_id, turn, role, text).

    With a trigger of what is available now the stream does not end, as times run out at any time: stop it, or switch
    ``spark.sql.streaming.noDataMicroBatches.enabled`` off.
    """
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    return rows.groupBy("conv_id").applyInPandasWithState(_follower(2 * pairs, ttl), OUT, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)
