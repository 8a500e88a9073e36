"""Language identification as a mixture of languages within each document.

Every language is a model of hashed byte n-grams within words. A document's words are drawn from a
mixture of the languages; expectation-maximisation estimates its proportions, and a penalised
likelihood chooses how many languages it has. Counts for the models come from all labelled documents
and meet as bounded vectors, one for each language. No language is left out, and no number of
languages of a text is ruled out: what a task holds grows with the number of languages alone.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, functions as F

from folio.llm.storage import store
from folio.llm.text import CHUNK_BYTES, chunks, words

#: Buckets that n-grams are hashed to, and the added count of each.
BUCKETS = 1 << 16
ADDED = 0.5
SIZES = (1, 2, 3)
ROUNDS = 12
#: Weight of a further language in the penalty.
PENALTY = 1.0
#: Languages whose counts a task holds before it sends them on; languages that the driver reads at once.
HELD_LANGUAGES = 16
READ_LANGUAGES = 32
#: Likelihoods (word and language) that a task holds at once, about; one longer text stands alone.
HELD_LIKELIHOODS = 1 << 22
UNKNOWN = "und"
HELD_OUT = (4, 2)
_LETTER = regex.compile(r"\p{L}")


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def grams(vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, word) of the byte n-grams of each word: lower-cased, with its ends marked."""
    plain = pc.utf8_lower(pc.utf8_trim(vocabulary, characters=".,;:!?'\"()-[]{}|*#%&$<>=_0123456789")).cast(pa.binary()).to_pylist()
    if not plain:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    joined = np.frombuffer(b" " + b" ".join(plain) + b" ", np.uint8).astype(np.uint64)
    lengths = np.fromiter(map(len, plain), np.int64, len(plain))
    word = np.repeat(np.arange(len(plain)), lengths + 1)  # of each byte after the first blank
    out, owner = [], []
    for n in SIZES:
        if len(joined) < n + 1:
            continue
        windows = [joined[k : len(joined) - n + 1 + k] for k in range(n)]
        start = np.arange(len(windows[0]))
        inside = np.ones(len(start), bool)
        for k, x in enumerate(windows):
            inside &= (x != 32) | (k in (0, n - 1) and n > 1)
        code = np.full(len(start), n, np.uint64)
        for x in windows:
            code = (code << np.uint64(8)) | x
        if n == 2:  # not the two marks of an empty word
            inside &= (windows[0] != 32) | (windows[1] != 32)
        own = word[(start - 1 + (windows[0] == 32)).clip(0, max(len(word) - 1, 0))] 
        code = (code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)
        out.append(code[inside].astype(np.int64))
        owner.append(own[inside])
    return (np.concatenate(out), np.concatenate(owner)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def language_models(labelled: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and log-probabilities (bucket, language) of all rows of labelled (text, lang): 256 KB for each language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(BUCKETS, np.int64))

        def told() -> Iterator[pa.RecordBatch]:
            for lang, total in sums.items():
                at = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * (len(at) + 1), pa.string()), pa.array(np.append(at, BUCKETS).astype(np.int32)), pa.array(np.append(total[at], 0))], ["lang", "bin", "n"])

        for batch in chunks(batches):
            codes, n_words, vocabulary = words(batch.column("text"))
            bucket, owner = grams(vocabulary)
            coded = batch.column("lang").dictionary_encode()
            doc_lang = np.repeat(coded.indices.to_numpy(zero_copy_only=False), n_words)
            order = np.argsort(doc_lang, kind="stable")
            ends = np.searchsorted(doc_lang[order], np.arange(len(coded.dictionary) + 1))
            for k, lang in enumerate(coded.dictionary.to_pylist()):
                times = np.bincount(codes[order[ends[k] : ends[k + 1]]], minlength=len(vocabulary))
                sums[lang] += np.bincount(bucket, weights=times[owner], minlength=BUCKETS).astype(np.int64)
                if len(sums) >= HELD_LANGUAGES:
                    yield from told()
                    sums.clear()
        yield from told()

    rows = labelled.where("lang is not null and text is not null").select(F.col("lang").cast("string"), "text")
    sums = store(rows.mapInArrow(count, "lang string, bin int, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n")), "language-grams")
    langs = sorted(r.lang for r in sums.where(F.col("bin") == BUCKETS).select("lang").collect())  # a row for each language
    log_p = np.empty((BUCKETS, len(langs)), np.float32)
    for first in range(0, len(langs), READ_LANGUAGES):
        some = {lang: k for k, lang in enumerate(langs[first : first + READ_LANGUAGES])}
        own = sums.where(F.col("lang").isin(*some) & (F.col("bin") < BUCKETS)).toArrow()
        counts = np.full((BUCKETS, len(some)), ADDED)
        coded = own.column("lang").combine_chunks().dictionary_encode()
        at = np.array([some[x] for x in coded.dictionary.to_pylist()], np.int64)[coded.indices.to_numpy(zero_copy_only=False)] if own.num_rows else np.zeros(0, np.int64)
        counts[own.column("bin").to_numpy(), at] += own.column("n").to_numpy()
        log_p[:, first : first + len(some)] = np.log(counts / counts.sum(0, keepdims=True))
    return langs, log_p


def _mixture(doc: np.ndarray, times: np.ndarray, like: np.ndarray, start: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Proportions of each document after the rounds from `start`, and its log-likelihood. like: (row, language)."""
    share, n = start, len(start)
    total = np.maximum(np.bincount(doc, weights=times, minlength=n), 1e-300)
    for _ in range(rounds):
        joint = share[doc] * like
        weight = times / np.maximum(joint.sum(1), 1e-300)
        share = np.stack([np.bincount(doc, weights=joint[:, k] * weight, minlength=n) for k in range(like.shape[1])], 1) / total[:, None]
    ll = np.bincount(doc, weights=times * np.log(np.maximum((share[doc] * like).sum(1), 1e-300)), minlength=n)
    return share, ll


def proportions(codes: np.ndarray, n_words: np.ndarray, vocabulary: pa.Array, log_p: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """Chosen languages' proportions (0 for the others) of each text. A text without n-grams has all zero.

    All languages are mixed first; then the m of largest share are mixed alone, for m from 1 on. The m of the best
    penalised likelihood is chosen. The search of a text ends where no further language can raise it: the log-likelihood is concave in the proportions, so
    no mixture is above that of all languages by more than its steepest rise towards a single one."""
    n, k = len(n_words), log_p.shape[1]
    bucket, owner = grams(vocabulary)
    size = np.bincount(owner, minlength=len(vocabulary))
    like = np.stack([np.bincount(owner, weights=log_p[bucket, j], minlength=len(vocabulary)) for j in range(k)], 1)
    like = np.exp(np.maximum(like - like.max(1, keepdims=True), -50)) if len(vocabulary) else like
    doc = np.repeat(np.arange(n), n_words)
    ok = size[codes] > 0
    pair, times = np.unique(doc[ok] * max(1, len(vocabulary)) + codes[ok], return_counts=True)
    doc, word = pair // max(1, len(vocabulary)), pair % max(1, len(vocabulary))
    cost = np.log(np.maximum(np.bincount(doc, weights=times, minlength=n), 2)) * penalty
    best, best_value = np.zeros((n, k)), np.full(n, -np.inf)
    share, whole = _mixture(doc, times, like[word], np.full((n, k), 1 / k))
    ratio = times / np.maximum((share[doc] * like[word]).sum(1), 1e-300)
    rise = np.stack([np.bincount(doc, weights=ratio * like[word, j], minlength=n) for j in range(k)], 1).max(1) - np.bincount(doc, weights=times, minlength=n)
    bound = whole + np.maximum(rise, 0)
    order = np.argsort(-share, axis=1, kind="stable")
    open_, some = np.arange(n), np.bincount(doc, minlength=n) > 0
    for m in range(1, k + 1):
        top = order[open_, :m]
        start = np.maximum(np.take_along_axis(share[open_], top, 1), 1e-6)
        start /= start.sum(1, keepdims=True)
        found, ll = _mixture(doc, times, like[word[:, None], top[doc]], start, 0 if m == 1 else ROUNDS // 2)
        value = ll - (m - 1) * cost[open_]
        better = value > best_value[open_]
        rows = open_[better]
        best[rows] = 0
        best[rows[:, None], top[better]] = found[better]
        best_value[rows] = value[better]
        go_on = bound[open_] - m * cost[open_] > best_value[open_]
        if not go_on.any():
            break
        moved = np.cumsum(go_on) - 1
        stays = go_on[doc]
        doc, word, times, open_ = moved[doc[stays]], word[stays], times[stays], open_[go_on]
    best[~some] = 0
    return best


def identify(docs: DataFrame, labelled: DataFrame, penalty: float = PENALTY) -> DataFrame:
    """doc_id, lang_pred, score (proportion of that language), languages (all chosen ones with their proportions).

    Models are learnt from `labelled` (text, lang): one for every language in it, each of 256 KB in every task. `penalty`
    weighs a further language of a text by the log of its words. Rows without text or language teach nothing. Null text,
    text without a letter, and any text if nothing was learnt give `und` with score 0. A text whose
    letters give no n-gram known to favour a language still gets the likeliest one. Equal proportions go to
    the first language in code-point order. Repeated rows get equal results, a null doc_id stays null,
    other columns are ignored. An empty table gives an empty result.
    """
    models = docs.sparkSession.sparkContext.broadcast(language_models(labelled))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, log_p = models.value
        for batch in chunks(batches, size=min(CHUNK_BYTES, max(1 << 14, 8 * HELD_LIKELIHOODS // max(1, len(langs))))):
            texts = batch.column("text").to_pylist()
            letter = np.array([bool(t and _LETTER.search(t)) for t in texts])
            share = proportions(*words(batch.column("text")), log_p, penalty) if langs else np.zeros((batch.num_rows, 1))
            known = letter & bool(langs)
            best = share.argmax(1)
            score = np.where(known, share[np.arange(len(share)), best], 0.0)
            pred = [langs[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)]
            chosen = [[{"lang": langs[j], "share": float(row[j])} for j in np.argsort(-row, kind="stable") if row[j] > 0] if k else [] for row, k in zip(share, known, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(pred, pa.string()), pa.array(np.clip(score, 0, 1)), pa.array(chosen, pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())])))], ["doc_id", "lang_pred", "score", "languages"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double, languages array<struct<lang:string,share:double>>")
