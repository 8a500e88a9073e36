"""Content-addressed reuse: what is cached, what is missing, what comes first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from folio.functions.keys import content_key
from folio.schema import SCHEMA_VERSION


def first_wins(rows: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key: a map-side combined minimum, so a hot key gathers no rows."""
    rest = [c for c in rows.columns if c not in keys]
    first = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*[F.col(o) if isinstance(o, str) else o for o in order])).alias("_first"))
    return first.select(*keys, "_first.*").select(*rows.columns)


def misses(plan: DataFrame, cached: DataFrame, key: str = "clip_key") -> DataFrame:
    """One row for each key that is planned and not cached."""
    return plan.dropDuplicates([key]).join(cached.select(key), key, "left_anti")


def hits(plan: DataFrame, cached: DataFrame, key: str = "clip_key") -> DataFrame:
    return plan.dropDuplicates([key]).join(cached.select(key), key, "left_semi")


def stale_assignments(assignments: DataFrame, voices: DataFrame) -> DataFrame:
    """Assignments whose voice is no longer in the catalog."""
    return assignments.join(voices.select(F.col("id").alias("voice_id")), "voice_id", "left_anti")


def fresh(entries: DataFrame, now: Column, max_age_s: int | None = None) -> DataFrame:
    """Entries (written_at) that are no older than max_age_s; all of them without a limit."""
    return entries if max_age_s is None else entries.where(F.unix_timestamp(now) - F.unix_timestamp("written_at") <= max_age_s)


def hit_rows(plan: DataFrame, cached: DataFrame, produced: DataFrame, key: str = "clip_key") -> DataFrame:
    """Rows of the plan that the cache serves and this run did not make itself: only these count as hits."""
    return plan.join(cached.select(key).distinct(), key, "left_semi").join(produced.select(key).distinct(), key, "left_anti")


def analysis_keys(chunks: DataFrame, analyzer: dict[str, str]) -> DataFrame:
    """chunks (chunk_json, cast_fingerprint) with analysis_key: it changes with the analyzer, the chunk, and the cast before it."""
    maker = [F.lit(analyzer[k]) for k in ("family", "version", "model")]
    return chunks.withColumn("analysis_key", content_key(F.lit("analysis"), *maker, F.lit(SCHEMA_VERSION), F.col("chunk_json"), F.col("cast_fingerprint")))


def to_render(chapters: DataFrame, rendered: DataFrame) -> DataFrame:
    """Chapters (book_id, ch, render_key) without an output of the same key."""
    return chapters.join(rendered.select("book_id", "ch", "render_key"), ["book_id", "ch", "render_key"], "left_anti")


def without_outputs(outputs: DataFrame, recast: DataFrame, kept: tuple[str, ...] = ("tts",)) -> DataFrame:
    """Outputs (book_id, ch, kind) that stay when the books of recast (book_id) get other voices: those of other books, and the kinds kept."""
    return outputs.join(recast.select("book_id", F.lit(True).alias("_recast")).distinct(), "book_id", "left").where(F.col("_recast").isNull() | F.col("kind").isin(*kept)).drop("_recast")
