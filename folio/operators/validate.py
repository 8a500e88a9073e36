"""Holding what was said of a chunk to the chunk: labels and cues that do not fit are dropped, filled in or clamped, and chunks
that cannot be mended are named."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from folio import schema as S
from folio.functions.text import normalize_name, strip
from folio.operators.cache import first_wins
from folio.operators.characters import described
from folio.operators.script import character_keys

CHUNK = ["book_id", "ch", "chunk"]


@dataclass
class Checked:
    labels: DataFrame
    sfx: DataFrame
    music: DataFrame
    problems: DataFrame  # (book_id, ch, chunk, span_id, problem)
    invalid: DataFrame  # (book_id, ch, chunk, problem, n)


def _clamp(value: str, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), F.col(value)))


def known_speakers(labels: DataFrame, characters: DataFrame, updates: DataFrame) -> DataFrame:
    """labels with speaker as the book calls them: by a name or alias, by a descriptor that fits one person, or by a name or
    alias of the chunk's own updates (book_id, ch, chunk, ord, name, aliases); any other name as it is."""
    key = normalize_name(F.col("speaker"))
    names = character_keys(characters).withColumnRenamed("name", "_name")
    kinds = described(characters).withColumnsRenamed({"key": "_kind", "name": "_kind_name"})
    calls = updates.select(*CHUNK, "ord", F.col("name").alias("_new"), F.explode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("call"))
    new = first_wins(calls.select(*CHUNK, normalize_name(F.col("call")).alias("key"), "ord", "_new"), [*CHUNK, "key"], ["ord", "_new"]).drop("ord")
    told = labels.withColumn("key", key).join(names, ["book_id", "key"], "left").withColumn("_kind", F.lower(F.regexp_replace(strip(F.col("speaker")), r"\s+", " ")))
    told = told.join(kinds, ["book_id", "_kind"], "left").join(new, [*CHUNK, "key"], "left")
    speaker = F.when(F.coalesce("key", F.lit("")).isin("", S.NARRATOR.lower()), S.NARRATOR).otherwise(F.coalesce("_name", "_kind_name", strip(F.col("_new")), strip(F.col("speaker"))))
    return told.withColumn("speaker", speaker).select(*labels.columns)


def checked_analysis(spans: DataFrame, labels: DataFrame, sfx: DataFrame, music: DataFrame, characters: DataFrame, updates: DataFrame, fill: DataFrame | None = None) -> Checked:
    """Labels and cues of chunks, mended. spans: (book_id, ch, chunk, para, s, span_id, kind); labels: (book_id, ch, chunk, ord, span_id, speaker,
    emotion, delivery); sfx and music: cues with (book_id, ch, chunk, ord, span_id) and duration_s and intensity, or energy; fill: (book_id, span_id, speaker)
    for quotes without a label, which else go to the narrator.

    Labels of unknown spans, of narration, and further ones of a span are dropped. A chunk with more than S.MAX_UNLABELLED_SHARE of its
    quotes unlabelled, or with a cue outside it, is invalid: nothing of it is returned."""
    known = spans.select(*CHUNK, "span_id", F.col("kind").alias("_kind"))
    placed = labels.join(known, [*CHUNK, "span_id"], "left")
    fit = placed.where("_kind = 'quote'").drop("_kind")
    first = first_wins(fit, [*CHUNK, "span_id"], ["ord"])
    missing = spans.where("kind = 'quote'").select(*CHUNK, "span_id").join(first, [*CHUNK, "span_id"], "left_anti")
    quotes = spans.where("kind = 'quote'").groupBy(*CHUNK).agg(F.count("*").alias("quotes"))
    unlabelled = missing.groupBy(*CHUNK).agg(F.count("*").alias("n")).join(quotes, CHUNK).where(F.col("n") > S.MAX_UNLABELLED_SHARE * F.col("quotes"))
    cues = sfx.select(*CHUNK, "span_id").unionByName(music.select(*CHUNK, "span_id"))
    outside = cues.join(known, [*CHUNK, "span_id"], "left_anti").groupBy(*CHUNK).agg(F.count("*").alias("n"))
    invalid = unlabelled.select(*CHUNK, F.lit("unlabelled").alias("problem"), "n").unionByName(outside.select(*CHUNK, F.lit("outside").alias("problem"), "n"))
    bad = invalid.select(*CHUNK).distinct()
    valid = lambda df: df.join(bad, CHUNK, "left_anti")

    narrator = F.lit(S.NARRATOR)
    filled = valid(missing)
    filled = filled.withColumn("speaker", narrator) if fill is None else filled.join(fill.select("book_id", "span_id", "speaker"), ["book_id", "span_id"], "left").withColumn("speaker", F.coalesce("speaker", narrator))
    filled = filled.select(*CHUNK, "span_id", F.lit(None).cast("int").alias("ord"), "speaker", F.lit("neutral").alias("emotion"), F.lit("normal").alias("delivery"))
    every = known_speakers(valid(first).unionByName(filled.select(*first.columns)), characters, updates)
    length, loud, energy = _clamp("duration_s", S.MIN_SFX_SECONDS, S.MAX_SFX_SECONDS), _clamp("intensity", 0.0, 1.0), _clamp("energy", 0.0, 1.0)

    def problem(df: DataFrame, name: str) -> DataFrame:
        return valid(df).select(*CHUNK, "span_id", F.lit(name).alias("problem"))

    dropped = placed.where("_kind is null"), placed.where("_kind = 'narration'"), fit.join(first.select(*CHUNK, "span_id", "ord"), [*CHUNK, "span_id", "ord"], "left_anti")
    problems = problem(missing, "no label")
    for df, name in zip((*dropped, sfx.where((length != F.col("duration_s")) | (loud != F.col("intensity"))), music.where(energy != F.col("energy"))), ("unknown span", "narration", "further label", "clamped", "clamped"), strict=True):
        problems = problems.unionByName(problem(df, name))
    return Checked(every, valid(sfx).withColumns({"duration_s": length, "intensity": loud}), valid(music).withColumn("energy", energy), problems, invalid)


def label_coverage(rows: DataFrame, labels: DataFrame, key: str, by: str) -> DataFrame:
    """(by, n, labelled, share): how many rows of each group there are, how many of them have a label, and which share that is. A key with several labels counts once for each."""
    has = labels.select(key, F.lit(True).alias("_has"))
    told = rows.join(has, key, "left").groupBy(by).agg(F.count("*").alias("n"), F.count("_has").alias("labelled"))
    return told.withColumn("share", F.col("labelled") / F.col("n"))
