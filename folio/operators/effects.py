"""Sound effects and music that narration asks for: rules over spans, moods over paragraphs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F


@dataclass(frozen=True)
class Rule:
    name: str
    pattern: str
    anchor: str | None
    description: str
    kind: str
    seconds: float
    intensity: float
    variants: tuple[tuple[str, str, float], ...] = ()  # (pattern in the span, description, seconds)
    unless: str | None = None  # no cue where the paragraph has this


# The rules, in their order.
RULES = (
    Rule("thunder", r"\bthunder\w*", None, "a single deep thunderclap with a long distant rumble", "impact", 3.0, 0.9),
    Rule("slam", r"\bslam(?:med|ming|s)?\b", None, "a wooden shutter slamming hard against a stone wall", "impact", 1.5, 0.8, ((r"\bagain and again\b", "shutter banging repeatedly", 4.0),)),
    Rule("snap", r"\bsnap(?:ped|ping|s)?\b", None, "a taut rope snapping with a sharp crack", "impact", 0.8, 0.7),
    Rule("bell", r"\bbell\b[^.!?]*\brang\b|\brang\b[^.!?]*\bbell\b", r"\bbell\b", "a great bronze bell striking, deep resonant tone rolling out over water", "impact", 4.0, 0.8, ((r"\btwice\b", "two bell strikes, deep bronze tone with a long decay", 6.0),)),
    Rule("gulls", r"\bgulls?\b", None, "seagulls crying over rocks with a light sea breeze", "ambient", 12.0, 0.4),
    Rule("footsteps", r"\bboots crunch\w*|\bcrunching\b|\bfootsteps\b", r"\bcrunch\w*|\bfootsteps\b", "boots crunching on loose stones, hurried footsteps", "impact", 2.0, 0.5),
    Rule("fire", r"\bcrackled\b|\bcrackling fire\b", r"\bcrackl\w*", "a log fire crackling in a grate", "ambient", 15.0, 0.4),
    Rule("kettle", r"\bkettle\b[^.!?]*\bwhistl\w*", r"\bwhistl\w*", "a kettle coming to the boil, a rising whistle", "impact", 3.0, 0.5),
    Rule("hooves", r"\bhooves\b", None, "horse hooves clattering on a stone road, approaching", "impact", 4.0, 0.6),
    Rule("needles", r"\bneedles clicking\b", None, "knitting needles clicking softly and steadily", "ambient", 8.0, 0.3),
    Rule("wind", r"\bwind\b", None, "wind gusting and moaning around a stone building", "ambient", 15.0, 0.4),
    Rule("sea", r"\bsea\b|\bwaves\b[^.!?]*\bbreaking\b", r"\bsea\b|\bwaves\b", "waves breaking on rocks, steady sea wash", "ambient", 15.0, 0.4),
    Rule("knock", r"\bknock(?:ed|ing|s)?\b", None, "knuckles knocking on a wooden door", "impact", 1.0, 0.5),
    Rule("cough", r"\bcough(?:ed|ing|s)?\b", None, "a dry rattling cough", "impact", 1.0, 0.4),
    Rule("whistling", r"\bwhistling\b", None, "a man whistling a tune while he works", "impact", 3.0, 0.3, unless=r"\bkettle\b"),
)
MOST_A_PARAGRAPH = 3
# Words of each mood (a pattern of two words counts double), energies, and paragraphs within which a mood must be confirmed.
MOODS = {
    "tense": (r"\bstorm", r"\bthunder", r"\bwind\b", r"\bslam", r"\bshout"),
    "calm": (r"\bgr[ae]y\b", r"\bquiet", r"\bgulls?\b", r"\bmorning\b", r"\bflat\b"),
    "warm": (r"\bfire\b", r"\btea\b", r"\bkettle\b", r"\bknitting\b", r"\bcottage\b"),
    "melancholy": (r"\bletter\b", r"\bclosing\b", r"\bleave\b", r"\bnobody answered\b", r"\bcrumpled\b"),
    "hopeful": (r"\bmended\b", r"\bwhistling\b", r"\bfollowed him everywhere\b"),
}
ENERGY = {"tense": 0.7}
OTHER_ENERGY, FIRST_MOOD, LOOK_AHEAD = 0.3, "calm", 3


def _before(text: Column, pattern: str) -> Column:
    """Code points before the first match of a pattern."""
    return F.length(F.regexp_extract(text, f"(?is)^(.*?)(?:{pattern})", 1))


def _cue(rule: Rule, number: int, text: Column, paragraph: Column) -> Column:
    """What a rule makes of a span, or null."""
    pattern = F.lit(f"(?i){rule.pattern}")
    match = F.regexp_substr(text, pattern)
    anchor = F.regexp_substr(match, F.lit(f"(?i){rule.anchor}")) if rule.anchor else match
    offset = _before(text, rule.pattern) + (_before(match, rule.anchor) if rule.anchor else 0)
    told = F.struct(F.lit(rule.description).alias("description"), F.lit(int(rule.seconds * 1000)).alias("duration_ms"))
    for condition, description, seconds in reversed(rule.variants):
        told = F.when(text.rlike(f"(?i){condition}"), F.struct(F.lit(description).alias("description"), F.lit(int(seconds * 1000)).alias("duration_ms"))).otherwise(told)
    cue = F.struct(
        F.lit(number).alias("rule"), F.coalesce(anchor, match).alias("anchor_text"), F.when(anchor.isNull(), _before(text, rule.pattern)).otherwise(offset).cast("int").alias("anchor_offset"),
        told["description"].alias("description"), F.lit(rule.kind).alias("kind"), told["duration_ms"].alias("duration_ms"), F.lit(rule.intensity).alias("intensity"),
    )
    fits = match.isNotNull()
    return F.when(fits & ~paragraph.rlike(f"(?i){rule.unless}") if rule.unless else fits, cue)


def effect_cues(spans: DataFrame, rules: tuple[Rule, ...] = RULES, most: int = MOST_A_PARAGRAPH) -> DataFrame:
    """Cues (book_id, ch, ord, span_id, anchor_text, anchor_offset, description, kind, duration_ms, intensity) of the narration in spans (book_id, ch, para, s,
    span_id, kind, text, paragraph: the text of the whole paragraph).

    Each rule gives a span one cue at most. In a paragraph the rules that come first win, then the earlier spans; cues are numbered
    in the order of the text. Rules are expressions: spans are read once, and only cues are shuffled."""
    told = spans.where("kind = 'narration'")
    made = F.filter(F.array(*[_cue(r, k, F.col("text"), F.col("paragraph")) for k, r in enumerate(rules)]), lambda c: c.isNotNull())
    # The outer form, as for the inner one Spark would work out all rules once more to drop spans without cues before.
    cues = told.select("book_id", "ch", "para", "s", "span_id", F.explode_outer(made).alias("c")).where(F.col("c").isNotNull()).select("book_id", "ch", "para", "s", "span_id", "c.*")
    rank = F.row_number().over(Window.partitionBy("book_id", "ch", "para").orderBy("rule", "s"))
    kept = cues.withColumn("_rank", rank).where(F.col("_rank") <= most)
    order = F.row_number().over(Window.partitionBy("book_id", "ch").orderBy("para", "s", "anchor_offset", "rule")) - 1
    return kept.withColumn("ord", order).select("book_id", "ch", "ord", "span_id", "anchor_text", "anchor_offset", "description", "kind", "duration_ms", "intensity")


def paragraph_moods(paras: DataFrame, moods: dict[str, tuple[str, ...]] = MOODS) -> DataFrame:
    """paras (book_id, ch, para, text) with mood: the one with most words in the paragraph, null without any. Of several, the one in
    force before the chapter (column prior_mood, if there is one) stays; else the first in the order of moods."""
    score = lambda ps: sum((F.regexp_count("text", F.lit(f"(?i){p}")) * (2 if " " in p else 1) for p in ps), F.lit(0))
    scored = paras.withColumns({f"_{m}": score(ps) for m, ps in moods.items()})
    most = F.greatest(*[F.col(f"_{m}") for m in moods])
    tied = F.array_compact(F.array(*[F.when((F.col(f"_{m}") == most) & (most > 0), m) for m in moods]))
    first = F.try_element_at(tied, F.lit(1))
    kept = F.when(F.array_contains(tied, F.col("prior_mood")), F.col("prior_mood")).otherwise(first) if "prior_mood" in paras.columns else first
    return scored.withColumn("mood", kept).select(*paras.columns, "mood")


def music_cues(moods: DataFrame) -> DataFrame:
    """(book_id, ch, para, action, mood, energy) from paragraphs with mood, prior_mood (in force before the chapter, or 'none') and
    reset (whether a scene begins there).

    A chapter without music starts with its first mood (or a calm one). Another mood is taken up where the next one within LOOK_AHEAD
    paragraphs agrees, or where a scene begins. What is in force is the last mood so taken up, so windows tell it."""
    order = Window.partitionBy("book_id", "ch").orderBy("para")
    chapter = Window.partitionBy("book_id", "ch").orderBy("para").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    silent = F.coalesce("prior_mood", F.lit("none")) == "none"
    ahead = F.first("mood", ignorenulls=True).over(order.rowsBetween(1, LOOK_AHEAD))
    told = moods.withColumns({"_n": F.row_number().over(order), "_first": F.coalesce(F.first("mood", ignorenulls=True).over(chapter), F.lit(FIRST_MOOD)), "_ahead": ahead})
    opens = silent & (F.col("_n") == 1)
    sure = F.when(opens, F.col("_first")).when(F.col("mood").isNotNull() & ((F.col("_ahead") == F.col("mood")) | F.col("reset")), F.col("mood"))
    marked = told.withColumn("_opens", opens).withColumn("_sure", sure)
    before = F.coalesce(F.last("_sure", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.when(~silent, F.col("prior_mood")))
    cues = marked.withColumn("_before", before).where(F.col("_sure").isNotNull() & (F.col("_opens") | ~F.col("_sure").eqNullSafe(F.col("_before"))))
    energy = F.coalesce(*[F.when(F.col("_sure") == m, e) for m, e in ENERGY.items()], F.lit(OTHER_ENERGY))
    return cues.select("book_id", "ch", "para", F.when(F.col("_opens"), "start").otherwise("change").alias("action"), F.col("_sure").alias("mood"), energy.alias("energy"))


def moods_in_force(events: DataFrame, chapters: DataFrame) -> DataFrame:
    """chapters (book_id, ch) with prior_mood: what the last event (book_id, ch, idx, ord, action, mood) of the chapters before left in
    force, 'none' after a stop or without any."""
    last = events.groupBy("book_id", "ch").agg(F.max_by(F.when(F.col("action") == "stop", "none").otherwise(F.col("mood")), F.struct("idx", "ord")).alias("_mood"))
    order = Window.partitionBy("book_id").orderBy("ch").rowsBetween(Window.unboundedPreceding, -1)
    return chapters.join(last, ["book_id", "ch"], "left").withColumn("prior_mood", F.coalesce(F.last("_mood", ignorenulls=True).over(order), F.lit("none"))).drop("_mood")
