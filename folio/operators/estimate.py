"""What a book will take: counts of its parts and their price."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from folio import schema as S


def estimate(paras: DataFrame, spans: DataFrame, chunks: DataFrame, prices: dict[str, float]) -> DataFrame:
    """One row for each book. Each table is aggregated by book before the joins. spans: one row for each span, or totals (see segment.span_totals)."""
    p = paras.groupBy("book_id").agg(F.count("*").alias("paragraphs"), F.countDistinct("ch").alias("chapters"), F.sum(F.length("text")).alias("chars"))
    s = spans if "speech_chars" in spans.columns else spans.groupBy("book_id").agg(F.count("*").alias("spans"), F.count_if(F.col("kind") == "quote").alias("quotes"), F.sum(F.length("text")).alias("speech_chars"))
    c = chunks.groupBy("book_id").agg(F.countDistinct("ch", "chunk").alias("chunks"))
    told = p.join(s, "book_id", "left").join(c, "book_id", "left").na.fill(0)
    tokens = F.floor(F.col("chars") / S.CHARS_PER_TOKEN) + S.TOKENS_PER_CHUNK * F.col("chunks")
    out = S.OUTPUT_TOKENS_PER_CHUNK * F.col("chunks") + S.TOKENS_PER_QUOTE * F.col("quotes")
    cost = (
        tokens * prices.get("input_token", 0.0) + out * prices.get("output_token", 0.0) + F.col("speech_chars") * prices.get("character", 0.0)
        + F.col("chapters") * S.MUSIC_SECONDS_PER_CHAPTER * prices.get("music_second", 0.0) + F.col("paragraphs") * S.SFX_SECONDS_PER_PARAGRAPH * prices.get("sfx_second", 0.0)
    )
    return told.withColumns({"input_tokens": tokens.cast("long"), "output_tokens": out.cast("long"), "cost_usd": F.round(cost, 6)})
