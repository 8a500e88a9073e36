"""The schedule of a chapter: pauses, voice, effects and music, as prefix sums and intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from folio import schema as S

CHAPTER = ["book_id", "ch"]


def pause_ms() -> Column:
    """Pause before a segment: by what changed since the one before, scaled by emotion; null for the first."""
    order = Window.partitionBy(*CHAPTER).orderBy("idx")
    before = F.lag(F.struct("para", "speaker")).over(order)
    base = F.when(F.col("scene_break_before"), S.PAUSE_SCENE_MS).when(F.col("para") != before["para"], S.PAUSE_PARAGRAPH_MS).when(F.col("speaker") != before["speaker"], S.PAUSE_SPEAKER_MS).otherwise(S.PAUSE_SAME_MS)
    scaled = F.bround(base * S.lookup(S.EMOTION_PAUSE, F.col("emotion"), 1.0)).cast("int")
    return F.when(before.isNotNull(), F.greatest(F.lit(S.PAUSE_MIN_MS), F.least(F.lit(S.PAUSE_MAX_MS), scaled)))


def blocking(cue: DataFrame) -> Column:
    """Loud impacts that open a narration span and therefore come before its words."""
    early = F.coalesce(F.col("anchor_offset") / F.nullif(F.length("span_text"), F.lit(0)), F.lit(0.0)) < S.BLOCKING_FRACTION
    return (F.col("kind") == "impact") & (F.col("intensity") >= S.BLOCKING_INTENSITY) & (F.col("segment_kind") == "narration") & F.col("found") & early


def schedule(segments: DataFrame, gaps: DataFrame | None = None, music: bool = True) -> DataFrame:
    """segments (with duration_ms) with start_ms and end_ms: the sum of all pauses, gaps and durations before. gaps: (book_id, ch,
    idx, gap_ms) of blocking effects. One shuffle by chapter, shared by both windows."""
    order = Window.partitionBy(*CHAPTER).orderBy("idx")
    paused = segments.withColumn("pause_ms", F.coalesce(pause_ms(), F.lit(0)))
    if gaps is not None:
        paused = paused.join(gaps, [*CHAPTER, "idx"], "left")
    gap = F.coalesce(F.col("gap_ms"), F.lit(0)) if gaps is not None else F.lit(0)
    upto = F.sum(F.col("pause_ms") + gap + F.col("duration_ms")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    end = F.lit(S.MUSIC_INTRO_MS if music else S.INTRO_MS) + upto
    return paused.withColumn("end_ms", end.cast("long")).withColumn("start_ms", F.col("end_ms") - F.col("duration_ms"))


def piece_durations(jobs: DataFrame, clips: DataFrame) -> DataFrame:
    """(book_id, ch, idx, duration_ms) of segments from their pieces' clips, with a gap between pieces; an unmeasured clip takes 0 ms."""
    long_ = jobs.join(clips.select("clip_key", F.col("duration_ms").alias("_ms")), "clip_key", "left")
    return long_.groupBy(*CHAPTER, "idx").agg((F.sum(F.coalesce("_ms", F.lit(0))) + S.PIECE_GAP_MS * (F.count("*") - 1)).alias("duration_ms"))


def anchor_ms(start: Column, end: Column, offset: Column, length: Column) -> Column:
    share = F.when(length > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), offset / length))).otherwise(0.0)
    return F.bround(start + share * (end - start)).cast("long")


def impact_gain_db(intensity: Column, bed_db: float) -> Column:
    return F.greatest(F.lit(-20.0), F.least(F.lit(0.0), bed_db + (intensity - S.BLOCKING_INTENSITY) * 10.0))


def merged_beds(placed: DataFrame) -> DataFrame:
    """Placements (book_id, ch, clip_key, ord, start_ms, end_ms) of looping clips: one that starts while an earlier one of its clip
    still runs extends it."""
    clip = Window.partitionBy(*CHAPTER, "clip_key").orderBy("ord")
    reach = F.max("end_ms").over(clip.rowsBetween(Window.unboundedPreceding, -1))
    island = placed.withColumn("_new", F.coalesce(F.col("start_ms") > reach, F.lit(True))).withColumn("_island", F.sum(F.col("_new").cast("int")).over(clip))
    return island.groupBy(*CHAPTER, "clip_key", "_island").agg(F.min_by("start_ms", "ord").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.min("ord").alias("ord")).drop("_island")


def music_placements(regions: DataFrame, duration: Column) -> DataFrame:
    """regions (book_id, ch, n, start_ms, end_ms of their segments) with lead and tail; each runs some way into the next."""
    order = Window.partitionBy(*CHAPTER).orderBy("n")
    clamp = lambda x, low, high: F.greatest(low, F.least(high, x))
    start = clamp(F.col("start_ms") - S.MUSIC_LEAD_MS, F.lit(0), duration)
    led = regions.withColumn("_start", start).withColumn("_tail", clamp(F.col("end_ms") + S.MUSIC_TAIL_MS, F.col("_start"), duration)).withColumn("_next", F.lead("_start").over(order))
    end = F.when(F.col("_next").isNotNull(), clamp(F.col("_next") + S.MUSIC_OVERLAP_MS, F.col("_start"), duration)).otherwise(F.col("_tail"))
    fade = F.when(F.row_number().over(order) == 1, S.MUSIC_FIRST_FADE_MS).otherwise(S.MUSIC_FADE_MS)
    return led.withColumns({"end_ms": end, "fade_in_ms": fade}).withColumn("start_ms", F.col("_start")).drop("_start", "_tail", "_next")


def neighbour_text(segments: DataFrame, chars: int = 200) -> DataFrame:
    """segments with previous_text and next_text of the same speaker: the narrator's in the chapter, others' in the paragraph."""
    order = Window.partitionBy(*CHAPTER, "speaker", F.when(F.col("speaker") != S.NARRATOR, F.col("para"))).orderBy("idx")
    return segments.withColumns({"previous_text": F.right(F.lag("text").over(order), F.lit(chars)), "next_text": F.left(F.lead("text").over(order), F.lit(chars))})


def timeline(segments: DataFrame, cues: DataFrame, regions: DataFrame, music: bool = True, sfx_db: float = -12.0, music_db: float = -18.0) -> DataFrame:
    """All placements (book_id, ch, track, ref, start_ms, end_ms, gain_db) of chapters. segments carry duration_ms; cues come from
    script.anchored_cues, regions from script.music_regions."""
    own = segments.select(*CHAPTER, "idx", F.col("kind").alias("segment_kind"), F.col("text").alias("span_text"))
    told = cues.join(own, [*CHAPTER, "idx"])
    told = told.withColumn("blocks", blocking(told)).withColumn("gap_ms", F.when(F.col("blocks"), F.least(F.col("duration_ms") * S.BLOCKING_GAP, F.lit(float(S.BLOCKING_GAP_MAX_MS))).cast("int")).otherwise(0))
    gaps = told.groupBy(*CHAPTER, "idx").agg(F.sum("gap_ms").alias("gap_ms"))
    timed = schedule(segments, gaps, music)
    voice = timed.select(*CHAPTER, F.lit("voice").alias("track"), F.col("span_id").alias("ref"), "start_ms", "end_ms", S.lookup(S.DELIVERY_GAIN_DB, F.col("delivery"), 0.0).alias("gain_db"))
    times = timed.select(*CHAPTER, "idx", F.col("start_ms").alias("s_ms"), F.col("end_ms").alias("e_ms"))
    placed = told.join(times, [*CHAPTER, "idx"]).withColumn("at", anchor_ms(F.col("s_ms"), F.col("e_ms"), F.col("anchor_offset"), F.length("span_text")))
    since = F.sum("gap_ms").over(Window.partitionBy(*CHAPTER, "idx").orderBy("ord").rowsBetween(0, Window.unboundedFollowing))
    hit = placed.where("kind <> 'ambient'").withColumn("start", F.when(F.col("blocks"), F.col("s_ms") - since).otherwise(F.greatest(F.lit(0), F.col("at") - S.SFX_LEAD_MS)))
    hits = hit.select(*CHAPTER, F.lit("sfx").alias("track"), F.col("id").alias("ref"), F.col("start").cast("long").alias("start_ms"), (F.col("start") + F.greatest("duration_ms", F.lit(500))).cast("long").alias("end_ms"), impact_gain_db(F.col("intensity"), sfx_db).alias("gain_db"))
    ends = times.select(*CHAPTER, F.col("idx").alias("end_idx"), F.col("e_ms").alias("scene_ms"))
    beds = placed.where("kind = 'ambient'").join(ends, [*CHAPTER, "end_idx"], "left").withColumn("start_ms", F.greatest(F.lit(0), F.col("at") - S.AMBIENT_LEAD_MS))
    beds = beds.withColumn("end_ms", F.greatest("start_ms", F.coalesce("scene_ms", "e_ms")))
    merged = merged_beds(beds.select(*CHAPTER, F.sha2("description", 256).alias("clip_key"), "ord", "start_ms", "end_ms"))
    beds = merged.select(*CHAPTER, F.lit("sfx").alias("track"), F.concat(F.lit("bed"), F.col("ord").cast("string")).alias("ref"), "start_ms", "end_ms", F.lit(sfx_db + S.AMBIENT_OFFSET_DB).alias("gain_db"))
    out = voice.unionByName(hits).unionByName(beds)
    if not music:
        return out
    long_ = out.groupBy(*CHAPTER).agg((F.max("end_ms") + S.OUTRO_MS).alias("chapter_ms"))
    first = times.select(*CHAPTER, F.col("idx").alias("start_idx"), F.col("s_ms").alias("start_ms"))
    last = times.select(*CHAPTER, F.col("idx").alias("end_idx"), F.col("e_ms").alias("end_ms"))
    placed = music_placements(regions.join(first, [*CHAPTER, "start_idx"]).join(last, [*CHAPTER, "end_idx"]).join(long_, CHAPTER), F.col("chapter_ms"))
    return out.unionByName(placed.select(*CHAPTER, F.lit("music").alias("track"), F.concat(F.lit("music"), F.col("n").cast("string")).alias("ref"), "start_ms", "end_ms", F.lit(music_db).alias("gain_db")))
