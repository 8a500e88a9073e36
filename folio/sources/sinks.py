"""Writing manifests and caches."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, functions as F


def job_manifests(chapters: DataFrame) -> DataFrame:
    """One row for each job: its chapters in order as an array, and their total length. A job has few chapters."""
    return chapters.groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("ch", "title", "duration_ms"))).alias("chapters"), F.sum("duration_ms").alias("duration_ms"), F.count("*").alias("n_chapters"))


def write_manifests(manifests: DataFrame, path: str) -> None:
    write_json(manifests, path)


def append_cache(clips: DataFrame, path: str) -> None:
    """Clips by kind, added to what is stored under the path: a key that is there already is not written again, and of several
    clips of one key in clips one is."""
    new = clips.dropDuplicates(["kind", "clip_key"])
    try:
        stored = clips.sparkSession.read.schema(clips.schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
    else:
        new = new.join(stored.select("kind", "clip_key"), ["kind", "clip_key"], "left_anti")
    new.write.mode("append").partitionBy("kind").parquet(path)


def write_json(rows: DataFrame, path: str) -> None:
    """Rows as JSON lines with nulls written, in place of what was there."""
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def wav_bytes(samples: Column, rate: Column) -> Column:
    """A mono WAV file of 16-bit samples (an array of small ints), as bytes: a header of 44, and each sample low byte first."""

    def low_first(value: Column, size: int) -> Column:
        digits = F.lpad(F.hex(value.cast("long").bitwiseAND((1 << 8 * size) - 1)), 2 * size, "0")
        return F.unhex(F.concat(*[F.substring(digits, 2 * k - 1, 2) for k in range(size, 0, -1)]))

    n = F.size(samples) * 2
    body = F.unhex(F.array_join(F.transform(samples, lambda x: F.hex(low_first(x, 2))), ""))
    chars = lambda text: F.lit(text).cast("binary")
    head = [chars("RIFF"), low_first(n + 36, 4), chars("WAVEfmt "), low_first(F.lit(16), 4), low_first(F.lit(1), 2), low_first(F.lit(1), 2), low_first(rate, 4), low_first(rate * 2, 4), low_first(F.lit(2), 2), low_first(F.lit(16), 2), chars("data"), low_first(n, 4)]
    return F.concat(*head, body)


def write_wavs(tracks: DataFrame, path: str) -> None:
    """One row (name, rate, samples) as one file name.wav under the path, which all executors must share. A file is written under another name
    first and then renamed, so that a task that runs again leaves no half of one."""
    files = tracks.select("name", wav_bytes(F.col("samples"), F.col("rate")).alias("content"))

    def write(rows: Iterator[Row]) -> None:
        os.makedirs(path, exist_ok=True)
        for row in rows:
            part = os.path.join(path, f".{row.name}.{uuid.uuid4().hex}")
            with open(part, "wb") as f:
                f.write(row.content)
            os.replace(part, os.path.join(path, f"{row.name}.wav"))

    files.foreachPartition(write)
