"""Importance resampling: documents drawn by how much likelier they are in target text than in raw text.

Unigrams and bigrams are hashed to buckets; target and raw text each become a distribution over the
buckets. A document's log-ratio plus Gumbel noise from a seeded hash is its key, and the documents of
the k largest keys are the sample: a draw without replacement by importance weight. The k-th
key is found by counting digits of the keys, so no sort or list of all rows is needed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from folio.llm.storage import store
from folio.llm.text import chunks, hashes, words

BUCKETS = 1 << 16
ADDED = 0.05
SHARE = 0.8
SEED = 1
#: Target ids that are sent to all tasks at most (8 bytes each); more are joined by a shuffle of the texts, with the same result.
BROADCAST_IDS = 1 << 20
#: Keys are compared in steps of this size.
STEP = 2.0**-20
_DIGIT_BITS, _DIGITS = 11, 5


def gram_buckets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text) of every word and every two words in order, lower-cased."""
    codes, n_words, vocabulary = words(texts)
    doc = np.repeat(np.arange(len(n_words)), n_words)
    if not len(codes):
        return codes, doc
    h = hashes(pc.utf8_lower(vocabulary), SEED)[codes]
    inside = doc[1:] == doc[:-1]
    two = ((h[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ (h[1:] >> np.uint64(7)) ^ h[1:])[inside] * np.uint64(0xC2B2AE3D27D4EB4F)
    bucket = np.concatenate([h >> np.uint64(48), two >> np.uint64(48)]).astype(np.int64)
    owner = np.concatenate([doc, doc[1:][inside]])
    order = np.argsort(owner, kind="stable")
    return bucket[order], owner[order]


def bucket_counts(docs: DataFrame) -> np.ndarray:
    """Counts of all buckets over all rows of docs (text)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in chunks(batches):
            total += np.bincount(gram_buckets(batch.column("text"))[0], minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["bucket", "n"])

    found = docs.select("text").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(BUCKETS, np.int64)
    out[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    return out


def kth_largest(keys: DataFrame, column: str, k: int) -> int | None:
    """The k-th largest value of a column of whole numbers from 0 below 2^55, by counting one digit at a time."""
    if k <= 0:
        return None
    value, left = 0, k
    for d in range(_DIGITS - 1, -1, -1):
        shift = d * _DIGIT_BITS
        own = keys.where(F.shiftright(F.col(column), shift + _DIGIT_BITS) == value) if d < _DIGITS - 1 else keys
        counts = own.groupBy(F.shiftright(F.col(column), shift).bitwiseAND((1 << _DIGIT_BITS) - 1).alias("digit")).agg(F.count("*").alias("n")).collect()  # 2048 rows at most
        for r in sorted(counts, key=lambda r: -r.digit):
            if left <= r.n:
                value = (value << _DIGIT_BITS) | r.digit
                break
            left -= r.n
        else:
            return 0
    return value


def resample(docs: DataFrame, target_ids: DataFrame, share: float = SHARE, seed: int = SEED, broadcast_ids: int = BROADCAST_IDS) -> DataFrame:
    """doc_id, n_grams, log_ratio, sample_key, kept: a row for each row of docs.

    target_ids (doc_id) names the target documents: all rows of docs with one of these ids shape the target
    distribution, whatever their number (broadcast_ids changes the plan alone). round(share * rows) documents of largest key are kept; all rows at
    the last key are, so repeated rows stay or go together. Null or empty text has no n-grams and
    log-ratio 0. Without any target text all ratios are 0 and the draw is uniform. A null doc_id gets the noise of
    its own constant. Other columns are ignored. An empty table gives an empty result.
    """
    picked = store(target_ids.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct(), "target-ids")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    target = bucket_counts(rows.join(picked.hint("broadcast" if picked.count() <= broadcast_ids else "merge"), "doc_id", "left_semi"))
    raw = bucket_counts(rows)
    ratio = np.zeros(BUCKETS)
    if target.sum():
        ratio = np.log((target + ADDED) / (target.sum() + ADDED * BUCKETS)) - np.log((raw + ADDED) / (raw.sum() + ADDED * BUCKETS))
    shared = docs.sparkSession.sparkContext.broadcast(ratio)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            bucket, owner = gram_buckets(batch.column("text"))
            n = np.bincount(owner, minlength=batch.num_rows)
            total = np.bincount(owner, weights=shared.value[bucket], minlength=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), pa.array(np.round(total, 6))], ["doc_id", "n_grams", "log_ratio"])

    scored = rows.mapInArrow(weigh, "doc_id long, n_grams long, log_ratio double")
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.coalesce("doc_id", F.lit(-1))), 11).cast("double") + 0.5) / F.lit(2.0**53)
    keyed = scored.withColumn("sample_key", F.col("log_ratio") - F.log(-F.log(u)))
    offset = 2.0**33  # keys from -2^33 to 2^33, in steps
    keyed = store(keyed.withColumn("step", F.floor((F.least(F.greatest("sample_key", F.lit(-offset + 1)), F.lit(offset - 1)) + offset) / STEP).cast("long")), "sample-keys")
    last = kth_largest(keyed, "step", round(share * keyed.count()))
    kept = F.lit(False) if last is None else F.col("step") >= last
    return keyed.select("doc_id", "n_grams", "log_ratio", "sample_key", kept.alias("kept"))
