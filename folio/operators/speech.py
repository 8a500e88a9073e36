"""From a script and a cast to requests for clips: who speaks with which voice, what is said in one piece, and keys of all of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from folio import schema as S
from folio.functions.keys import clip_key, request, stable_seed, content_key
from folio.operators.timeline import neighbour_text

SETTINGS = ("stability", "similarity_boost", "style", "speed", "pitch_shift")


def split_text(text: Column, max_chars: int, whole_sentences: bool = False) -> Column:
    """A text as an array of pieces of at most max_chars: whole sentences packed as long as they fit. A sentence that is too long is
    cut at its last blank that leaves a shorter piece, or else at max_chars; what is left of it is packed with what follows. With whole_sentences it is not cut: it is a
    piece of its own, longer than max_chars. A text that fits is one piece, an empty one none."""
    trimmed = F.trim(text)
    sentences = F.split(trimmed, r"(?<=[.!?])\s+")
    parts = F.lit(rf"(?s)\S.{{0,{max_chars - 1}}}$|\S.{{0,{max(0, max_chars - 2)}}}(?= )|\S.{{0,{max_chars - 1}}}")
    # Parts of a sentence that is too long are pieces of their own, but for its last one.
    told = F.flatten(F.transform(sentences, lambda s: F.transform(F.when(F.length(s) <= max_chars, F.array(s)).otherwise(F.regexp_extract_all(s, parts, F.lit(0))), lambda x: F.trim(x))))
    alone = F.flatten(F.transform(sentences, lambda s: F.when(F.length(s) <= max_chars, F.array(F.lit(False))).otherwise(F.transform(F.regexp_extract_all(s, parts, F.lit(0)), lambda x, k: k < F.size(F.regexp_extract_all(s, parts, F.lit(0))) - 1))))
    if whole_sentences:
        told, alone = sentences, F.transform(sentences, lambda s: F.lit(False))
    empty = F.array().cast("array<string>")
    start = F.struct(F.lit("").alias("open"), empty.alias("out"))

    def add(a: Column, z: Column) -> Column:
        joined = F.concat_ws(" ", F.nullif(a["open"], F.lit("")), z["part"])
        closed = F.when(a["open"] == "", a["out"]).otherwise(F.array_append(a["out"], a["open"]))
        fits = ~z["alone"] & (F.length(joined) <= max_chars)
        out = F.when(z["alone"], F.array_append(closed, z["part"])).when(fits, a["out"]).otherwise(closed)
        return F.struct(F.when(z["alone"], F.lit("")).when(fits, joined).otherwise(z["part"]).alias("open"), out.alias("out"))

    packed = F.aggregate(F.arrays_zip(told.alias("part"), alone.alias("alone")), start, add, lambda a: F.array_append(a["out"], a["open"]))
    pieces = F.when(F.length(trimmed) <= max_chars, F.array(trimmed)).otherwise(packed)
    return F.filter(F.coalesce(pieces, empty), lambda p: p != "")


def with_voices(segments: DataFrame, cast: DataFrame) -> DataFrame:
    """segments with voice_id, seed and the settings of their speaker's voice, or else of the narrator's in their book. cast: (book_id,
    character, voice_id, seed, stability, similarity_boost, style, speed, pitch_shift), one row for each character of a book."""
    own = ["voice_id", "seed", *SETTINGS]
    voice = F.struct(*own)
    of = cast.select("book_id", F.col("character").alias("speaker"), voice.alias("_own"))
    narrator = cast.where(F.col("character") == S.NARRATOR).select("book_id", voice.alias("_narrator"))
    found = segments.join(of, ["book_id", "speaker"], "left").join(narrator, "book_id", "left").withColumn("_voice", F.coalesce("_own", "_narrator"))
    return found.select(*segments.columns, *[F.col(f"_voice.{c}").alias(c) for c in own])


def plan_tts(segments: DataFrame, cast: DataFrame, max_chars: int, family: str = "basic", version: str = "1", whole_sentences: bool = False) -> DataFrame:
    """(book_id, ch, idx, span_id, piece, text, voice_id, settings, emotion, delivery, previous_text, next_text, seed, clip_key): a row
    for each piece of each segment that has text. The text before and after a piece is that of its segment, or of the same speaker's nearest segment
    (see timeline.neighbour_text), as far as S.NEIGHBOUR_CHARS reach. whole_sentences: as of split_text."""
    from folio.operators.casting import settings_for

    spoken = settings_for(with_voices(neighbour_text(segments, S.NEIGHBOUR_CHARS), cast))
    cut = spoken.withColumn("pieces", split_text(F.col("text"), max_chars, whole_sentences)).select("*", F.posexplode_outer("pieces").alias("piece", "said")).where(F.col("said").isNotNull())
    before = F.when(F.col("piece") > 0, F.right(F.element_at("pieces", F.col("piece")), F.lit(S.NEIGHBOUR_CHARS))).otherwise(F.col("previous_text"))
    after = F.when(F.col("piece") + 1 < F.size("pieces"), F.left(F.try_element_at("pieces", F.col("piece") + 2), F.lit(S.NEIGHBOUR_CHARS))).otherwise(F.col("next_text"))
    asked = request(
        text=F.col("said"), voice_id=F.col("voice_id"), settings=request(**{c: F.col(c) for c in SETTINGS}), emotion=F.col("emotion"), delivery=F.col("delivery"),
        previous_text=F.nullif(before, F.lit("")), next_text=F.nullif(after, F.lit("")), seed=F.col("seed"),
    )
    jobs = cut.select("book_id", "ch", "idx", "span_id", "piece", asked.alias("request"))
    return jobs.select("book_id", "ch", "idx", "span_id", "piece", "request.*", clip_key("tts", family, version, F.col("request")).alias("clip_key"))


def sfx_requests(cues: DataFrame, most_ms: int, seed: Column, family: str = "basic", version: str = "1") -> DataFrame:
    """cues (kind, duration_ms, description, intensity) with request and clip_key. A bed is asked for at one length, an impact at its own
    within the limits; the seed follows the description."""
    ambient = F.col("kind") == "ambient"
    length = F.when(ambient, F.least(F.lit(S.AMBIENT_REQUEST_MS), F.lit(most_ms))).otherwise(F.least(F.greatest(F.col("duration_ms"), F.lit(S.SFX_MIN_REQUEST_MS)), F.lit(most_ms)))
    asked = request(description=F.col("description"), kind=F.col("kind"), duration_ms=length.cast("int"), loop=ambient, intensity=F.col("intensity"), seed=stable_seed(content_key(seed, F.col("description"))))
    return cues.withColumn("request", asked).withColumn("clip_key", clip_key("sfx", family, version, F.col("request")))


def music_requests(regions: DataFrame, least_ms: int, most_ms: int, seed: Column, family: str = "basic", version: str = "1") -> DataFrame:
    """regions (mood, energy, prompt, start_ms, end_ms) with request and clip_key: a little longer than the region, within the limits. The
    seed follows the mood and the prompt (its mood's own if it has none), so that beds are used again."""
    prompt = F.coalesce(F.nullif("prompt", F.lit("")), S.lookup(S.MUSIC_PROMPTS, F.col("mood"), S.MUSIC_PROMPTS["calm"]))
    wanted = F.least(F.col("end_ms") - F.col("start_ms") + S.MUSIC_REQUEST_PAD_MS, F.lit(S.MUSIC_REQUEST_CAP_MS))
    length = F.greatest(F.lit(least_ms), F.least(F.lit(most_ms), wanted)).cast("int")
    asked = request(prompt=prompt, mood=F.col("mood"), energy=F.col("energy"), duration_ms=length, loopable=F.lit(True), seed=stable_seed(content_key(seed, F.col("mood"), prompt)))
    return regions.withColumn("request", asked).withColumn("clip_key", clip_key("music", family, version, F.col("request")))


def chapter_segments(segments: DataFrame, timings: DataFrame, cast: DataFrame) -> DataFrame:
    """What a manifest tells of each segment: its text, voice and times. Segments without times are left out."""
    timed = segments.drop("start_ms", "end_ms").join(timings.select("book_id", "ch", "idx", "start_ms", "end_ms"), ["book_id", "ch", "idx"])
    return with_voices(timed, cast).select("book_id", "ch", "idx", "span_id", "para", "speaker", "voice_id", "kind", "text", "emotion", "delivery", "start_ms", "end_ms")


def chapter_cues(placements: DataFrame, sfx: DataFrame, music: DataFrame) -> DataFrame:
    """What a manifest tells of each effect and region of music: placements (book_id, ch, track, ref, start_ms, end_ms, gain_db) with what their cue says, null
    where no cue has that id."""
    key = ["book_id", "ch", "ref"]
    effects = placements.where("track = 'sfx'").join(sfx.select("book_id", "ch", F.col("id").alias("ref"), "description", F.col("kind").alias("sfx_kind"), F.col("span_id").alias("anchor_segment"), "anchor_text"), key, "left")
    beds = placements.where("track = 'music'").join(music.select("book_id", "ch", F.col("id").alias("ref"), "mood", "prompt"), key, "left")
    return effects.unionByName(beds, allowMissingColumns=True)
