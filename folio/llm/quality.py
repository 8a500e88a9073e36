"""Quality rules: plain counts, and divergence of a text's histograms from language references.

A text's histogram of character classes and its histogram of common words are compared with those of every language by
Jensen-Shannon distance (base 2, 0 to 1); the nearest language counts. References are gathered from all
documents with a language that pass the base rules. Both passes are narrow; only bounded count vectors
(classes, and hash buckets of words, for each language) are shuffled between them.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from folio.llm.storage import store
from folio.llm.text import chunks, flat_bytes, hashes, words

MIN_WORDS = 10
REPEAT_PERCENT = 20
WINDOW = 5
#: Guards: a text with fewer words is not compared by its words or its characters.
LEAST_WORDS = 40
LEAST_CHAR_WORDS = 20
#: A text is rejected beyond these distances to its nearest language: above those of nearly all labelled good texts.
MOST_CHAR_DISTANCE = 0.30
MOST_WORD_DISTANCE = 0.50
#: Common words that a language's histogram holds, and buckets that words are hashed to.
COMMON = 100
BUCKETS = 1 << 16
#: Languages whose counts a task holds before it sends them on.
HELD_LANGUAGES = 16

# Character classes: fixed values.
CLASSES = ("lower", "upper", "digit", "space", "break", "stop", "call", "quote", "symbol", "other", "beyond")
_SETS = {"space": " ", "break": "\t\n\x0b\x0c\r", "stop": ".,;:", "call": "!?", "quote": "'\"()-", "symbol": "#*$%&|<>"}


def _byte_classes() -> np.ndarray:
    table = np.full(256, CLASSES.index("other"), np.int64)
    for first, last, name in (("a", "z", "lower"), ("A", "Z", "upper"), ("0", "9", "digit")):
        table[ord(first) : ord(last) + 1] = CLASSES.index(name)
    for name, chars in _SETS.items():
        table[[ord(c) for c in chars]] = CLASSES.index(name)
    table[0xC0:] = CLASSES.index("beyond")
    table[0x80:0xC0] = len(CLASSES)  # the rest of a character
    return table


BYTE_CLASS = _byte_classes()


class Counts:
    """What both passes need of a run of texts."""

    def __init__(self, texts: pa.Array):
        self.codes, self.n_words, self.vocabulary = words(texts)
        flat, lengths = flat_bytes(texts)
        n = len(lengths)
        doc = np.repeat(np.arange(n), lengths)
        self.classes = np.bincount(doc * (len(CLASSES) + 1) + BYTE_CLASS[flat], minlength=n * (len(CLASSES) + 1)).reshape(n, -1)[:, : len(CLASSES)]
        blank = self.classes[:, CLASSES.index("space")] + self.classes[:, CLASSES.index("break")]
        self.word_chars = self.classes.sum(1) - blank
        self.n_symbols = self.classes[:, CLASSES.index("symbol")]
        self.n_repeat_words = repeat_words(self.codes, self.n_words)
        self.base_failed = (self.n_words < MIN_WORDS) | (100 * self.n_repeat_words > REPEAT_PERCENT * self.n_words)

    def buckets(self) -> np.ndarray:
        """Hash bucket of each word, lower-cased and without punctuation at its ends."""
        plain = pc.utf8_lower(pc.utf8_trim(self.vocabulary, characters=".,;:!?'\"()-"))
        return (hashes(plain) % np.uint64(BUCKETS)).astype(np.int64)[self.codes] if len(self.codes) else np.zeros(0, np.int64)


def repeat_words(codes: np.ndarray, n_words: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Number of words of each text in windows that the text has twice or more."""
    doc = np.repeat(np.arange(len(n_words)), n_words)
    last = len(codes) - window + 1
    if last <= 0:
        return np.zeros(len(n_words), np.int64)
    at = np.flatnonzero(doc[:last] == doc[window - 1 :])
    rng = np.random.default_rng(4)
    mixed = doc[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for k in range(window):
        salt, by = rng.integers(1, 1 << 63, 2, dtype=np.uint64)
        x = (codes[at + k].astype(np.uint64) + salt) * (by | np.uint64(1))
        mixed ^= (x ^ (x >> np.uint64(31))) * (salt | np.uint64(1))
    order = np.argsort(mixed, kind="stable")
    at, mixed = at[order], mixed[order]
    same = mixed[1:] == mixed[:-1]
    if same.any():
        i = np.flatnonzero(same)
        equal = doc[at[i]] == doc[at[i + 1]]
        for k in range(window):
            equal &= codes[at[i] + k] == codes[at[i + 1] + k]
        same[i] = equal
    twice = np.zeros(len(at), bool)
    twice[1:] |= same
    twice[:-1] |= same
    edge = np.zeros(len(codes) + window, np.int64)
    np.add.at(edge, at[twice], 1)
    np.add.at(edge, at[twice] + window, -1)
    covered = np.cumsum(edge)[: len(codes)] > 0
    return np.bincount(doc[covered], minlength=len(n_words))


def dup_lines(text: bytes | None) -> int:
    lines = [x for x in (text or b"").split(b"\n") if x.strip(b" \t\n\x0b\x0c\r")]
    return len(lines) - len(set(lines))


def language_references(docs: DataFrame, common: int = COMMON) -> dict:
    """For each language: shares of the character classes, its `common` most frequent word buckets and
    their shares. What comes to the driver is classes + common numbers for each language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(len(CLASSES) + BUCKETS, np.int64))

        def told() -> Iterator[pa.RecordBatch]:
            for lang, total in sums.items():
                at = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(total[at])], ["lang", "bin", "n"])

        for batch in chunks(batches):
            found = Counts(batch.column("text"))
            langs = np.array(batch.column("lang").to_pylist(), object)
            fit = ~found.base_failed & (found.n_words >= LEAST_WORDS)
            bucket, doc = found.buckets(), np.repeat(np.arange(len(langs)), found.n_words)
            for lang in {*langs[fit]} - {None}:
                own = fit & (langs == lang)
                sums[lang][: len(CLASSES)] += found.classes[own].sum(0)
                sums[lang][len(CLASSES) :] += np.bincount(bucket[own[doc]], minlength=BUCKETS)
                if len(sums) >= HELD_LANGUAGES:
                    yield from told()
                    sums.clear()
        yield from told()

    known = docs.where("lang is not null").select(F.col("lang").cast("string"), "text")
    sums = store(known.mapInArrow(count, "lang string, bin int, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n")), "language-counts")
    is_word = F.col("bin") >= len(CLASSES)
    total = F.sum("n").over(Window.partitionBy("lang", is_word))
    rank = F.row_number().over(Window.partitionBy("lang", is_word).orderBy(F.desc("n"), "bin"))
    top = sums.withColumn("total", total).withColumn("rank", rank).where(~is_word | (F.col("rank") <= common))
    out: dict = {}
    for r in top.orderBy("lang", "bin").collect():
        own = out.setdefault(r.lang, {"classes": np.zeros(len(CLASSES)), "words": []})
        if r.bin < len(CLASSES):
            own["classes"][r.bin] = r.n / r.total
        else:
            own["words"].append((r.bin - len(CLASSES), r.n / r.total))
    return out


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of the rows of p from q."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(p > 0, p * np.log2(p / m), 0).sum(-1)
        right = np.where(q > 0, q * np.log2(q / m), 0).sum(-1)
    return np.sqrt(np.clip((left + right) / 2, 0, 1))


def quality_rules(docs: DataFrame, char_distance: float = MOST_CHAR_DISTANCE, word_distance: float = MOST_WORD_DISTANCE, common: int = COMMON) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, char_distance,
    word_distance, kept: a row for each row of docs.

    Null text has no words, so the base rules fail it, as they do any text under MIN_WORDS words. Distances are null below
    the length guards (LEAST_CHAR_WORDS and LEAST_WORDS words) and where there is no reference at all; then they reject
    nothing. Every language has a reference, of its `common` most frequent words; a text farther than char_distance or word_distance
    from all of them is not kept. A null language adds to no reference; a text is held against all languages, whatever its own. Repeated rows count again and
    get equal results. Columns beside doc_id, text and lang are ignored. An empty table gives an
    empty result.
    """
    references = docs.sparkSession.sparkContext.broadcast(language_references(docs, common))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = references.value
        for batch in chunks(batches):
            found = Counts(batch.column("text"))
            n = batch.num_rows
            with np.errstate(divide="ignore", invalid="ignore"):
                shares = found.classes / found.classes.sum(1, keepdims=True)
            by_char, by_word = np.full(n, np.inf), np.full(n, np.inf)
            bucket, doc = found.buckets(), np.repeat(np.arange(n), found.n_words)
            for own in known.values():
                by_char = np.fmin(by_char, js_distance(shares, own["classes"]))
                slot = np.full(BUCKETS, len(own["words"]))
                slot[[b for b, _ in own["words"]]] = np.arange(len(own["words"]))
                width = len(own["words"]) + 1
                mine = np.bincount(doc * width + slot[bucket], minlength=n * width).reshape(n, width) / np.maximum(found.n_words, 1)[:, None]
                theirs = np.array([s for _, s in own["words"]])
                by_word = np.fmin(by_word, js_distance(mine, np.append(theirs, max(0.0, 1 - theirs.sum()))))
            no_char = (found.n_words < LEAST_CHAR_WORDS) | ~np.isfinite(by_char)
            no_word = (found.n_words < LEAST_WORDS) | ~np.isfinite(by_word)
            far = (~no_char & (by_char > char_distance)) | (~no_word & (by_word > word_distance))
            dups = np.array([dup_lines(t) for t in batch.column("text").cast(pa.binary()).to_pylist()], np.int64)
            longs = [found.n_words, found.word_chars, found.n_symbols, dups, found.n_repeat_words]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(np.asarray(x, np.int64)) for x in longs], pa.array(found.base_failed), pa.array(by_char, mask=no_char), pa.array(by_word, mask=no_word), pa.array(~found.base_failed & ~far)],
                ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "char_distance", "word_distance", "kept"],
            )

    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, char_distance double, word_distance double, kept boolean"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(judge, schema)
