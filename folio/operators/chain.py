"""Analysis of a book chunk by chunk, where each chunk is read in the light of what was known before it.

A result is kept under the content of its chunk and the fingerprint of the state before it. When a chunk changes, it and those behind it are worked out again
only until the state is what it once was: from there on the kept results fit. Books run side by side; a book's chunks are read in order, with one state, and
not gathered.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from folio.functions.keys import content_key

#: Chunks that are held at once.
STEP_ROWS = 64
RESULTS = "book_id string, ord int, chunk_key string, before string, after string, result string, reused boolean"


def fingerprint(state: Any) -> str:
    """SHA-256 of a state's canonical JSON."""
    return hashlib.sha256(json.dumps(state, sort_keys=True, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()


@dataclass
class Analysis:
    """analyze: what a chunk (its columns by name) tells, given the state before it; advance: the state after that; both in values that JSON has.
    The state of a book begins as `start`."""

    analyze: Callable[[dict, Any], Any]
    advance: Callable[[Any, Any], Any]
    start: Any = field(default_factory=dict)
    version: str = "1"


def analysis_chain(chunks: DataFrame, analysis: Analysis, kept: DataFrame | None = None) -> DataFrame:
    """(see RESULTS) a row for each chunk: its result as JSON, fingerprints of the state before and after it, and whether the result was kept from before.

    chunks: book_id, ord and what `analyze` reads; `ord` is unique in a book. kept: rows of earlier runs, of any number of them; they count for the same
    book, content and version wherever the chunk stands now. Null columns are read as such; an empty table gives an empty result."""
    read = [c for c in chunks.columns if c not in ("book_id", "ord")]
    shaped = chunks.select(F.col("book_id").cast("string"), F.col("ord").cast("int"), *read)
    keyed = shaped.withColumn("chunk_key", content_key(F.lit(analysis.version), F.struct(*sorted(read))))
    found = F.lit(None).cast("array<struct<before:string,result:string>>")
    if kept is None:
        known = keyed.withColumn("known", found)
    else:
        # A chunk has as many kept results as it was met with different states.
        last = kept.groupBy("book_id", "chunk_key", "before").agg(F.max("result").alias("result"))
        own = last.groupBy("book_id", "chunk_key").agg(F.collect_list(F.struct("before", "result")).alias("known"))
        known = keyed.join(own, ["book_id", "chunk_key"], "left")
    ordered = known.repartition("book_id").sortWithinPartitions("book_id", "ord")
    names = [f.split()[0] for f in RESULTS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book, state, mark = ..., None, ""
        for batch in (whole.slice(lo, STEP_ROWS) for whole in batches for lo in range(0, whole.num_rows, STEP_ROWS)):
            out = []
            for row in batch.to_pylist():
                if row["book_id"] != book:
                    book, state = row["book_id"], json.loads(json.dumps(analysis.start))
                    mark = fingerprint(state)
                fits = {k["before"]: k["result"] for k in row["known"] or ()}
                before, reused = mark, mark in fits
                result = json.loads(fits[mark]) if reused else analysis.analyze({c: row[c] for c in read}, state)
                state = analysis.advance(state, result)
                mark = fingerprint(state)
                out.append((book, row["ord"], row["chunk_key"], before, mark, json.dumps(result, sort_keys=True, ensure_ascii=False), reused))
            columns = list(zip(*out, strict=True))
            kinds = (pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return ordered.mapInArrow(run, RESULTS)


def last_states(results: DataFrame) -> DataFrame:
    """(book_id, after): the fingerprint of each book's state at its end."""
    return results.groupBy("book_id").agg(F.max_by("after", "ord").alias("after"))
