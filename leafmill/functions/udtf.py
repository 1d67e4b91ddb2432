"""Functions for SQL: ``chunk_text`` as a table function beside the expressions of the library."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from ..config import CHUNK_CHARS, CHUNK_OVERLAP
from ..operators.chunking import spans

_BLANKS = re.compile(r"[ \t]+")
_PARAGRAPHS = re.compile(r"\n[ \t\n\x0b\x0c\r]*\n+")
_SPLIT = str.maketrans({"\xa0": " ", "\r": "\n", "​": None})


def cleaned(text: str | None) -> str:
    """What ``functions.text.clean_whitespace`` gives, where there is no JVM."""
    return _PARAGRAPHS.sub("\n\n", _BLANKS.sub(" ", (text or "").translate(_SPLIT))).strip()


class ChunkText:
    """Rows (ordinal, begins, ends, text) of a text's overlapping chunks; begins and ends are places in the cleaned text."""

    def eval(self, text: str, most: int = CHUNK_CHARS, overlap: int = CHUNK_OVERLAP) -> Iterator[tuple[int, int, int, str]]:
        if not 0 <= overlap < most:
            raise ValueError("the overlap is less than the size of a chunk")
        clean, n = cleaned(text), 0
        for a, b in spans(clean, most, overlap):
            if part := clean[a:b].strip():
                yield n, a, b, part
                n += 1


def register(spark: SparkSession) -> None:
    """Make ``SELECT .. FROM documents, LATERAL chunk_text(text)`` work in this session."""
    spark.udtf.register("chunk_text", udtf(ChunkText, returnType="ordinal int, begins int, ends int, text string"))
