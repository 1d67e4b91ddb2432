"""Overlapping chunks that end at sentences."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import CHUNK_ADVANCE, CHUNK_CHARS, CHUNK_OVERLAP
from ..functions.text import clean_whitespace
from ..plans.stages import dealt


def spans(text: str, most: int = CHUNK_CHARS, overlap: int = CHUNK_OVERLAP, advance: int = CHUNK_ADVANCE) -> list[tuple[int, int]]:
    """Where chunks begin and end: at the last sentence end of each window that is far enough along."""
    out, start = [], 0
    while text:
        end = min(start + most, len(text))
        if end < len(text):
            stop = max(text.rfind(mark, start, end) for mark in (". ", "? ", "! ")) - start
            end = start + stop + 1 if stop > advance else end
        out.append((start, end))
        if end == len(text):
            break
        start = max(end - overlap, start + 1)
    return out


def chunk_texts(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: [c for c in (t[a:b].strip() for a, b in spans(t)) if c])


def chunks(documents: DataFrame) -> DataFrame:
    """documents (id, text and more) as chunks: id, document_id, ordinal and the chunk's text."""
    udf = F.pandas_udf(chunk_texts, "array<string>")
    others = [c for c in documents.columns if c not in ("id", "text")]
    rows = dealt(documents).withColumn("__c", udf(clean_whitespace(F.col("text")))).select(F.col("id").alias("document_id"), *others, F.posexplode("__c").alias("ordinal", "text"))
    return rows.select(F.concat(F.col("document_id").cast("string"), F.lit("_chunk_"), F.format_string("%03d", "ordinal")).alias("id"), "document_id", "ordinal", *others, "text")
