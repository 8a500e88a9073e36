"""A chapter from its script to its sound: which clips it needs, where each piece of speech, effect and bed lies, and the mix.

Places are prefix sums within prefix sums: pieces in a segment, segments in a chapter. Nothing here looks at samples but the mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from folio import schema as S
from folio.operators import mix, speech
from folio.operators.timeline import CHAPTER, piece_durations, timeline
from folio.sources.stored import stored

# Fades in ms (in, out).
VOICE_FADES, IMPACT_FADES, AMBIENT_FADES, MUSIC_FADE_OUT_MS = (10, 10), (20, 200), (800, 1500), 3000
PLACED = [*CHAPTER, "track", "clip_key", "ref", "start_ms", "end_ms", "gain_db", "fade_in_ms", "fade_out_ms", "loop"]


def piece_places(jobs: DataFrame, clips: DataFrame, segments: DataFrame) -> DataFrame:
    """(book_id, ch, span_id, piece, clip_key, start_ms, end_ms): pieces of speech one after the other from where their segment starts, a gap between two.
    jobs: from speech.plan_tts; clips: clip_key, duration_ms; segments: book_id, ch, span_id, start_ms. A clip that was not measured takes no time; pieces of no segment go."""
    long_ = jobs.join(clips.select("clip_key", F.col("duration_ms").cast("long").alias("_ms")), "clip_key", "left").withColumn("_ms", F.coalesce("_ms", F.lit(0)))
    before = Window.partitionBy(*CHAPTER, "span_id").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    placed = long_.withColumn("_at", F.coalesce(F.sum(F.col("_ms") + S.PIECE_GAP_MS).over(before), F.lit(0)))
    found = placed.join(segments.select(*CHAPTER, "span_id", F.col("start_ms").alias("_start")), [*CHAPTER, "span_id"])
    return found.select(*CHAPTER, "span_id", "piece", "clip_key", (F.col("_start") + F.col("_at")).alias("start_ms"), (F.col("_start") + F.col("_at") + F.col("_ms")).alias("end_ms"))


def chapter_placements(segments: DataFrame, jobs: DataFrame, clips: DataFrame, cues: DataFrame, regions: DataFrame, seed: Column, sfx_most_ms: int = 22_000, music_least_ms: int = 3_000, music_most_ms: int = 120_000, music: bool = True) -> DataFrame:
    """Every clip of every chapter with its place (see PLACED): track is voice, sfx, ambient or music, ref the segment, cue or region.

    segments: a script (book_id, ch, idx, span_id, para, speaker, kind, text, emotion, delivery, scene_break_before); jobs: speech.plan_tts of it; clips: clip_key, duration_ms of
    the jobs' clips; cues: from script.anchored_cues; regions: from script.music_regions; seed: what the seeds of effects and music follow. A segment lasts as
    long as its pieces with the gaps between them, none if it has no text."""
    cues, regions = stored(cues, "cues"), stored(regions, "regions")
    measured = segments.drop("duration_ms").join(piece_durations(jobs, clips), [*CHAPTER, "idx"], "left").withColumn("duration_ms", F.coalesce("duration_ms", F.lit(0)))
    laid = stored(timeline(stored(measured, "segments"), cues, regions, music), "timeline")
    spoken = laid.where("track = 'voice'").withColumnRenamed("ref", "span_id")
    pieces = piece_places(jobs, clips, spoken).join(spoken.select(*CHAPTER, "span_id", "gain_db"), [*CHAPTER, "span_id"])
    fades = lambda df, fade_in, fade_out, loop: df.withColumns({"fade_in_ms": fade_in if isinstance(fade_in, Column) else F.lit(fade_in), "fade_out_ms": F.lit(fade_out), "loop": F.lit(loop)}).select(*PLACED)
    voice = fades(pieces.withColumns({"track": F.lit("voice"), "ref": F.col("span_id")}), *VOICE_FADES, False)
    asked = speech.sfx_requests(cues, sfx_most_ms, seed).select(*CHAPTER, "id", "ord", "clip_key")
    sfx = laid.where("track = 'sfx'")
    hits = fades(sfx.join(asked.select(*CHAPTER, F.col("id").alias("ref"), "clip_key"), [*CHAPTER, "ref"]), *IMPACT_FADES, False)
    beds = sfx.join(asked.select(*CHAPTER, F.concat(F.lit("bed"), F.col("ord").cast("string")).alias("ref"), "clip_key", "id"), [*CHAPTER, "ref"])
    out = voice.unionByName(hits).unionByName(fades(beds.withColumns({"track": F.lit("ambient"), "ref": F.col("id")}), *AMBIENT_FADES, True))
    if not music:
        return out
    regions = regions if "prompt" in regions.columns else regions.withColumn("prompt", F.lit(""))
    named = regions.withColumn("ref", F.concat(F.lit("music"), F.col("n").cast("string"))).select(*CHAPTER, "ref", "n", "mood", "energy", "prompt")
    played = speech.music_requests(laid.where("track = 'music'").join(named, [*CHAPTER, "ref"]), music_least_ms, music_most_ms, seed)
    first = F.row_number().over(Window.partitionBy(*CHAPTER).orderBy("n")) == 1
    return out.unionByName(fades(played, F.when(first, S.MUSIC_FIRST_FADE_MS).otherwise(S.MUSIC_FADE_MS), MUSIC_FADE_OUT_MS, True))


def rendered_chapters(placements: DataFrame, clips: DataFrame, rate: int) -> DataFrame:
    """Stems and mix of every chapter in buckets (see mix.mix_chapters) from placements and clips (clip_key, samples at that rate)."""
    return mix.mix_chapters(mix.fitted_clips(placements, clips, rate), rate)


def chapter_cues(placements: DataFrame, cues: DataFrame, regions: DataFrame) -> DataFrame:
    """What a manifest tells of each effect, bed and region of music (see speech.chapter_cues)."""
    told = placements.withColumn("track", F.when(F.col("track") == "ambient", "sfx").otherwise(F.col("track")))
    regions = regions if "prompt" in regions.columns else regions.withColumn("prompt", F.lit(""))
    named = regions.withColumn("id", F.concat(F.lit("music"), F.col("n").cast("string")))
    return speech.chapter_cues(told, cues, named)
