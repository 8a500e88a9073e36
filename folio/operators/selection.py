"""Which chapters are wanted, and which books are too large."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, functions as F

# Limits of a range of chapters, of a book's spans, and of a chapter's length.
MAX_CHAPTER_RANGE, MAX_SPANS, MAX_CHAPTER_MINUTES = 10_000, 20_000, 90


def chapter_ranges(text: str | None) -> list[tuple[int, int]]:
    """"1-3,5" as [(1, 3), (5, 5)]; no ranges for no text. A range needs both bounds, in ascending order, from 1 on."""
    ranges = []
    for part in filter(None, (p.strip() for p in (text or "").split(","))):
        found = re.fullmatch(r"(\d+)(?:\s*-\s*(\d+))?", part)
        low, high = (int(found[1]), int(found[2] or found[1])) if found else (0, 0)
        if not 1 <= low <= high or high - low >= MAX_CHAPTER_RANGE:
            raise ValueError(f"{part!r} is no range of chapters: give one chapter, or both bounds in ascending order (at most {MAX_CHAPTER_RANGE} chapters)")
        ranges.append((low, high))
    return ranges


def only_chapters(rows: DataFrame, ranges: list[tuple[int, int]]) -> DataFrame:
    """Rows of the chapters in the ranges, or all without any. The condition reaches the scan."""
    if not ranges:
        return rows
    wanted = F.lit(False)
    for low, high in ranges:
        wanted = wanted | F.col("ch").between(low, high)
    return rows.where(wanted)


def rejected_books(spans: DataFrame, timings: DataFrame | None = None, most_spans: int = MAX_SPANS, most_minutes: int = MAX_CHAPTER_MINUTES) -> DataFrame:
    """(book_id, ch, problem, n): books of more spans than most_spans (ch is null) and chapters of timings (book_id, ch, end_ms) longer than
    most_minutes. 0 is no limit."""
    books = spans.groupBy("book_id").agg(F.count("*").alias("n")).where((F.lit(most_spans) > 0) & (F.col("n") > most_spans))
    out = books.select("book_id", F.lit(None).cast("int").alias("ch"), F.lit("spans").alias("problem"), "n")
    if timings is None:
        return out
    chapters = timings.groupBy("book_id", "ch").agg(F.max("end_ms").alias("n")).where((F.lit(most_minutes) > 0) & (F.col("n") > most_minutes * 60_000))
    return out.unionByName(chapters.select("book_id", "ch", F.lit("minutes").alias("problem"), F.col("n").cast("long")))
