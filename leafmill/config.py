"""Fixed values and settings with their valid ranges."""

from __future__ import annotations

from dataclasses import dataclass

# First and last page of each section, in the order in which they take precedence.
SECTION_RANGES = [
    ("achievement_courses", 35, 37),
    ("courses", 187, 248),
    ("faculty", 249, 254),
    ("directory", 16, 16),
    ("admissions", 38, 44),
    ("policies", 45, 67),
    ("tuition_scholarships", 68, 71),
    ("programs", 72, 186),
    ("general", 9, 34),
]
# Pages without text worth indexing; pages of the calendar.
EXCLUDED_RANGES = [(1, 8), (11, 13), (17, 17), (20, 20), (22, 23), (255, 266)]
CALENDAR_PAGES = (18, 19)
# Words that mark a calendar line.
CALENDAR_WORDS = ["semester", "registration", "classes begin", "classes end", "last day", "withdrawal", "final examination", "holiday", "break", "add/drop"]
# Codes that an extraction must have found.
EXPECTED_CODES = ["MTH 103", "MTH 221", "MTH 225", "MTH 243", "CMP 220", "COE 486"]

# Sizes of chunks and contexts, depths of searches, constants of the two rankings.
CHUNK_CHARS, CHUNK_OVERLAP, CHUNK_ADVANCE = 1800, 250, 300
DEPTH, TOP_N, RRF_K = 20, 8, 60
RERANK_DEPTH, RERANK_KEEP, RERANK_BATCH = 15, 5, 32
CONTEXT_CHARS, HISTORY_TURNS = 9000, 3
DESCRIPTION_CHARS = 5000
BM25_K1, BM25_B, BM25_EPSILON = 1.5, 0.75, 0.25
EMBED_BATCH, EXCERPT_CHARS, REPORT_ROWS = 32, 800, 15
# What an asymmetric embedding model wants before a question; the title of calendar records.
QUERY_PREFIX = "Represent this sentence for searching relevant passages: "
CALENDAR_TITLE = "Academic Calendar"


@dataclass(frozen=True)
class Settings:
    """What a user may set for answers."""

    top_n: int = TOP_N
    temperature: float = 0.1
    context_tokens: int = 4096
    memory: bool = True

    def __post_init__(self) -> None:
        if not 3 <= self.top_n <= 15:
            raise ValueError("top_n lies between 3 and 15")
        if not 0 <= self.temperature <= 1:
            raise ValueError("temperature lies between 0 and 1")
        if not 1024 <= self.context_tokens <= 32768:
            raise ValueError("context_tokens lies between 1024 and 32768")
