"""Vocabularies, lookup tables and table schemas of books, scripts, timings and ledgers.

Every table carries book_id, so that many books are processed side by side.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

NARRATOR = "NARRATOR"

# Closed vocabularies, in their order.
AGES = ("child", "teen", "young", "adult", "middle-aged", "elderly")
STAGES = ("ingest", "analyze", "cast", "render", "finalize")
STAGE_WEIGHTS = (2, 28, 2, 66, 2)
QUOTE_STYLES = ("double", "single", "guillemet", "dash")

# Pacing in ms.
INTRO_MS, MUSIC_INTRO_MS, PIECE_GAP_MS, OUTRO_MS = 500, 1500, 120, 2500
PAUSE_SAME_MS, PAUSE_SPEAKER_MS, PAUSE_PARAGRAPH_MS, PAUSE_SCENE_MS = 250, 400, 650, 1500
PAUSE_MIN_MS, PAUSE_MAX_MS = 150, 2500
EMOTION_PAUSE = {"urgent": 0.6, "hesitant": 1.3, "melancholy": 1.3, "weary": 1.3}
DELIVERY_GAIN_DB = {"normal": 0.0, "strained": 0.0, "quiet": -4.0, "whisper": -8.0, "shout": 3.0}
BLOCKING_INTENSITY, BLOCKING_FRACTION, BLOCKING_GAP, BLOCKING_GAP_MAX_MS = 0.7, 0.25, 0.6, 1500
SFX_LEAD_MS, AMBIENT_LEAD_MS, AMBIENT_OFFSET_DB = 120, 300, -10.0
MUSIC_LEAD_MS, MUSIC_TAIL_MS, MUSIC_OVERLAP_MS, MUSIC_FADE_MS, MUSIC_FIRST_FADE_MS = 800, 1500, 3000, 2500, 1500

# Requests for clips, their limits, and what music is asked for in each mood.
SCHEMA_VERSION = 1
NEIGHBOUR_CHARS = 200
SFX_MIN_REQUEST_MS, AMBIENT_REQUEST_MS, MUSIC_REQUEST_PAD_MS, MUSIC_REQUEST_CAP_MS = 500, 15000, 4000, 120000
MUSIC_PROMPTS = {
    "calm": "soft ambient pad, slow and gentle, warm piano touches, unobtrusive underscore",
    "warm": "warm acoustic guitar and strings, gentle and homely, light and comforting underscore",
    "tense": "low pulsing drone with tremolo strings, tension building, dark suspense underscore",
    "ominous": "dark low cluster drone, distant rumble, slow ominous swell, unsettling underscore",
    "melancholy": "slow minor piano arpeggio with soft strings, wistful and reflective underscore",
    "sad": "sparse minor pad and lonely cello, slow and mournful, sorrowful underscore",
    "hopeful": "rising major arpeggio with light strings, gentle optimism, uplifting underscore",
    "adventurous": "driving rhythmic strings and percussion, bold and energetic, adventurous underscore",
    "joyful": "bright staccato strings and playful woodwinds, cheerful and lively underscore",
    "mysterious": "detuned fifths and shimmering bells, curious and mysterious, subtle underscore",
    "romantic": "lush major ninth pad with soft harp, tender and intimate, romantic underscore",
    "none": "silence",
}

# Limits that a chunk's labels and cues are held to.
MAX_UNLABELLED_SHARE, MIN_SFX_SECONDS, MAX_SFX_SECONDS = 0.2, 0.5, 30.0

# Assumptions of the cost estimate.
CHARS_PER_TOKEN, TOKENS_PER_CHUNK, TOKENS_PER_QUOTE = 4, 900, 25
OUTPUT_TOKENS_PER_CHUNK, MUSIC_SECONDS_PER_CHAPTER, SFX_SECONDS_PER_PARAGRAPH = 1500, 120, 1

BOOK_TABLES = {
    "paragraphs": "book_id string, ch int, para int, text string, scene_break_before boolean",
    "spans": "book_id string, ch int, para int, s int, span_id string, kind string, text string, start_char int, end_char int",
    "labels": "book_id string, span_id string, ord int, speaker string, emotion string, delivery string",
    "characters": "book_id string, ord int, name string, aliases array<string>, gender string, age string, description string, voice_notes string, first_chapter int, line_count int, provisional boolean",
    "segments": "book_id string, ch int, idx int, span_id string, para int, speaker string, kind string, text string, emotion string, delivery string, scene_break_before boolean",
    "sfx_cues": "book_id string, ch int, ord int, span_id string, anchor_text string, description string, kind string, duration_ms int, intensity double",
    "music_events": "book_id string, ch int, span_id string, ord int, action string, mood string, energy double, prompt string",
    "voices": "id string, name string, family string, gender string, age string, tags array<string>, description string",
    "usage_events": "id bigint, job_id string, ts timestamp, capability string, family string, unit_type string, units double, cache_hit boolean, cost_usd double, duration_ms int, meta_json string",
}


def lookup(table: dict, key: Column, default) -> Column:
    """The value of a small fixed table, as an expression."""
    return F.coalesce(F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[key], F.lit(default))
