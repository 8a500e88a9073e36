"""A corpus pipeline over documents: each stage works on all that the one before it kept.

Toxic documents go, lines that many documents share go, of each near-duplicate group one document stays, sources
are mixed to their targets, and the rest is encoded. Every stage but the last returns the columns
of documents.

All stages alike: a null doc_id, lang, source or n_chars passes through; repeated rows are documents of their own, treated alike until one of a group or
of a length is chosen; columns beyond those of documents are left behind, whatever their names; texts of any length are read whole; an empty table gives
an empty one with the same columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from folio.llm import lines, mixing, pieces, simhash, toxicity
from folio.llm.storage import store

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject: score below its threshold. Null and empty texts are scored like any other and stay unless the model says
    otherwise; a score at the threshold is rejected. Without labels of both classes everything stays."""
    return toxicity.without_toxic(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without the lines that many share; n_chars follows the text where a line went. Null text stays null, empty text is one empty line and stays; a document that
    loses all its lines stays with an empty text. A line is told by its key, so that lines equal but for case and outer blanks go together."""
    had = docs.select(*COLUMNS).withColumn("_null", F.col("text").isNull())
    kept = lines.dedup_lines(had)
    text = F.when(~F.col("_null"), F.col("text")).alias("text")
    n_chars = F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars")
    return kept.select("doc_id", text, "lang", "source", n_chars)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints: the one of the smallest doc_id, and of several rows with that id the first by text. Documents without a word (null, empty,
    blanks) have fingerprint zero and are linked like any other; in a group without any id all stay."""
    return simhash.one_of_each_group(docs.select(*COLUMNS))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target asks for: none, one or two copies. Documents without a word come as often as the whole of their source fits in its target. A null source is a source; of
    equally long documents a hash of seed and id decides."""
    return mixing.mixed_documents(docs.select(*COLUMNS))


def to_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as piece ids, whole. Null text has null ids, empty text none (n_ids 0 for both)."""
    return pieces.encode(docs.select(*COLUMNS)).select("doc_id", "lang", "source", "n_ids", "ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("simhash_dedup", drop_near_duplicates),
    ("mixing", mix),
    ("pieces", to_pieces),
]

#: No stage but the second is SQL: tests/llm holds each against a plain version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each stored and read again; rows of the last. Reruns agree."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), name)
    return docs
