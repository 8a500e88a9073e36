"""From labelled spans to a script: speakers, sound cues and music regions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from folio.functions.text import normalize_name
from folio.operators.cache import first_wins
from folio.schema import NARRATOR

CARRY_ENERGY, DEFAULT_MOOD = 0.2, "calm"


def character_keys(characters: DataFrame) -> DataFrame:
    """(book_id, key, name): each normalized name or alias with the first character, in list order, that has it."""
    keys = characters.select("book_id", "ord", "name", F.posexplode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("pos", "alias"))
    return first_wins(keys.select("book_id", normalize_name(F.col("alias")).alias("key"), "ord", "pos", "name"), ["book_id", "key"], ["ord", "pos"]).select("book_id", "key", "name")


def unknown_labels(labels: DataFrame, spans: DataFrame) -> DataFrame:
    return labels.join(spans.select("book_id", "span_id"), ["book_id", "span_id"], "left_anti")


def assemble_segments(spans: DataFrame, labels: DataFrame, characters: DataFrame) -> DataFrame:
    """Segments of a script. The first label of a span counts; narration, and speech without a label or with a
    speaker that no character is called by, is the narrator's."""
    first = first_wins(labels.select("book_id", "span_id", "ord", "speaker", "emotion", "delivery"), ["book_id", "span_id"], ["ord"])
    said = first.withColumn("key", normalize_name(F.col("speaker"))).join(character_keys(characters), ["book_id", "key"], "left").select("book_id", "span_id", "emotion", "delivery", "name")
    quote = F.col("kind") == "quote"
    order = Window.partitionBy("book_id", "ch").orderBy("para", "s")
    joined = spans.join(said, ["book_id", "span_id"], "left")
    return joined.select(
        "book_id", "ch", (F.row_number().over(order) - 1).alias("idx"), "span_id", "para",
        F.when(quote, F.coalesce("name", F.lit(NARRATOR))).otherwise(NARRATOR).alias("speaker"),
        F.when(quote, "dialogue").otherwise("narration").alias("kind"), "text",
        F.when(quote, F.coalesce("emotion", F.lit("neutral"))).otherwise("neutral").alias("emotion"),
        F.when(quote, F.coalesce("delivery", F.lit("normal"))).otherwise("normal").alias("delivery"),
        (F.col("scene_break_before") & (F.col("s") == 0)).alias("scene_break_before"),
    )


def ambient_ends(segments: DataFrame) -> DataFrame:
    """segments with scene_end: the last idx before the next scene break, or of the chapter."""
    after = Window.partitionBy("book_id", "ch").orderBy("idx").rowsBetween(1, Window.unboundedFollowing)
    last = F.max("idx").over(Window.partitionBy("book_id", "ch"))
    return segments.withColumn("scene_end", F.coalesce(F.min(F.when(F.col("scene_break_before"), F.col("idx"))).over(after) - 1, last))


def anchored_cues(cues: DataFrame, segments: DataFrame) -> DataFrame:
    """Cues with their anchor's offset in the span (0 and found = false if it is not there), a number in the chapter, and, for
    ambient ones, the end of the scene. Cues of unknown spans go."""
    own = ambient_ends(segments).select("book_id", "ch", "span_id", "idx", F.col("text").alias("span_text"), "scene_end")
    at = F.when(F.length("anchor_text") > 0, F.expr("instr(lower(span_text), lower(anchor_text))")).otherwise(0)
    order = Window.partitionBy("book_id", "ch").orderBy("ord")
    found = cues.drop("ch").join(own, ["book_id", "span_id"]).withColumn("_at", at)
    return found.select(
        *[c for c in cues.columns if c != "ch"], "ch", "idx", (F.col("_at") > 0).alias("found"), F.greatest(F.col("_at") - 1, F.lit(0)).alias("anchor_offset"),
        F.when(F.col("kind") == "ambient", F.col("scene_end")).alias("end_idx"), F.format_string("c%dx%03d", "ch", F.row_number().over(order)).alias("id"),
    )


def music_on_segments(events: DataFrame, segments: DataFrame) -> DataFrame:
    """Music events (book_id, span_id, chunk, n, action, mood, energy) as `music_regions` takes them: at the idx of their segment, and with
    ord, their place in the order of the analysis (chunk, then n). Events of unknown spans go."""
    placed = events.drop("ch", "idx").join(segments.select("book_id", "ch", "span_id", "idx"), ["book_id", "span_id"])
    order = F.row_number().over(Window.partitionBy("book_id", "ch").orderBy("chunk", "n")) - 1
    return placed.withColumn("ord", order).select("book_id", "ch", "idx", "ord", "action", "mood", "energy")


def music_regions(events: DataFrame, chapters: DataFrame) -> DataFrame:
    """Regions (book_id, ch, n, start_idx, end_idx, mood, energy) from start, change and stop events (book_id, ch, idx, ord, action,
    mood, energy). chapters: (book_id, ch, n_spans, prior_mood).

    The last event on a span counts, except that a stop cannot undo an earlier region of no length. A mood carried
    into the chapter opens a region at its start; a region ends before the next event; a chapter without any region has a calm one."""
    key = ["book_id", "ch"]
    carried = chapters.where(F.coalesce("prior_mood", F.lit("none")) != "none").select(*key, F.lit(0).alias("idx"), F.lit(-1).alias("ord"), F.lit("start").alias("action"), F.col("prior_mood").alias("mood"), F.lit(CARRY_ENERGY).alias("energy"))
    every = events.select(*key, "idx", "ord", "action", "mood", "energy").unionByName(carried)
    last = every.groupBy(*key, "idx").agg(F.max_by(F.struct("action", "mood", "energy"), "ord").alias("e")).select(*key, "idx", "e.*")
    order = Window.partitionBy(*key).orderBy("idx")
    ended = last.withColumn("next", F.lead("idx").over(order)).join(chapters.select(*key, "n_spans"), key)
    open_ = ended.where(F.col("action") != "stop").select(*key, F.col("idx").alias("start_idx"), (F.coalesce("next", "n_spans") - 1).alias("end_idx"), "mood", "energy").where("end_idx >= start_idx")
    silent = chapters.where("n_spans > 0").join(open_.select(*key).distinct(), key, "left_anti").select(*key, F.lit(0).alias("start_idx"), (F.col("n_spans") - 1).alias("end_idx"), F.lit(DEFAULT_MOOD).alias("mood"), F.lit(CARRY_ENERGY).alias("energy"))
    return open_.unionByName(silent).withColumn("n", F.row_number().over(Window.partitionBy(*key).orderBy("start_idx")))


def line_counts(segments: DataFrame) -> DataFrame:
    """(speaker, n, first_idx): lines of dialogue of each speaker, and where the first of them stands in its chapter."""
    return segments.where("kind = 'dialogue'").groupBy("speaker").agg(F.count("*").alias("n"), F.min("idx").alias("first_idx"))
