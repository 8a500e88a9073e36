"""Cuts of long texts, as expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Code points of a text's blocks.
BLOCK = 256


def text_blocks(text: Column) -> Column:
    """A text as an array of BLOCK code points each (the last one may be shorter)."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))


def cut(blocks: Column, start: Column, end: Column) -> Column:
    """Code points from start to end (exclusive) of a text in blocks, without walking from the text's beginning."""
    first = F.floor(start / BLOCK).cast("int")
    count = F.greatest(F.floor((end - 1) / BLOCK).cast("int") - first + 1, F.lit(0))
    joined = F.array_join(F.slice(blocks, first + 1, count), "")
    return F.when(end > start, F.substring(joined, start - first * BLOCK + 1, end - start)).otherwise("")
