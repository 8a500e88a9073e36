"""Toxic spans by a linear-chain conditional random field.

Labels say only whether a document is toxic, so its tokens are labelled first: a token of a toxic
document is toxic if it, its beginning or its end is far more frequent in toxic documents than
in others. A two-state chain is then trained on these tokens. Scoring runs the forward-backward
recursion over every token of a text; the marginals give the offending spans, and their
aggregate, calibrated on the labels, gives the document's score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, functions as F

from folio.llm.langid import held_out
from folio.llm.text import chunks, hashes, words

HELD_OUT = (3, 1)
THRESHOLD = 0.7
SPAN_PROBABILITY = 0.5
LEAST_MARGINAL = 0.35
#: Bounds of the labelled sample that the model is fitted on: documents of each class, and bytes of their texts together.
SAMPLE_DOCS = 2_000
SAMPLE_BYTES = 6 << 20
#: Feature buckets, documents that a telling feature needs, and its least log-odds.
BUCKETS = 1 << 18
LEAST_DOCS = 6
LEAST_LOG_ODDS = 2.5
ROUNDS = 30
LEARNING_RATE = 0.5
L2 = 1e-4
BLOCK = 32
#: Minimum hashes by which copies in the sample are told.
COPY_HASHES = 6
#: Tokens of the sample that one step of the fit works on.
FIT_TOKENS = 1 << 16
_WORD = regex.compile(r"[^\x20\x09-\x0D]+")


def features(vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, word) of each word's features: its letters, their beginnings of 3 to 8 and their ends of 3 to 5."""
    plain = pc.utf8_lower(pc.replace_substring_regex(vocabulary, r"\P{L}+", ""))
    size = pc.utf8_length(plain).to_numpy(zero_copy_only=False)
    told, owner = [], []
    for seed, n in enumerate((None, 3, 4, 5, 6, 7, 8, -3, -4, -5)):
        at = np.flatnonzero(size >= abs(n or 0))
        part = plain.take(pa.array(at)) if n else plain
        if n:
            part = pc.utf8_slice_codeunits(part, 0, n) if n > 0 else pc.utf8_slice_codeunits(part, n)
        coded = part.dictionary_encode()
        told.append((hashes(coded.dictionary, 70 + seed) % np.uint64(BUCKETS))[coded.indices.to_numpy(zero_copy_only=False)] if len(at) else np.zeros(0, np.uint64))
        owner.append(at)
    return np.concatenate(told).astype(np.int64), np.concatenate(owner)


def _blocks(n_words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tokens in rows of BLOCK, each row of one document (-1: none): rows, first row of each document, rows of
    each document, documents by falling number of rows."""
    per = -(-n_words // BLOCK)
    first = np.cumsum(per) - per
    doc = np.repeat(np.arange(len(n_words)), per)
    base = (np.cumsum(n_words) - n_words)[doc] + (np.arange(len(doc)) - first[doc]) * BLOCK
    at = base[:, None] + np.arange(BLOCK)
    at[at >= np.cumsum(n_words)[doc][:, None]] = -1
    return at, first, per, np.argsort(-per, kind="stable")


def ratios(e: np.ndarray, n_words: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward ratios (toxic to clean) of each token. e: its potential for toxic; a: 2 x 2 transition
    factors; a text starts from clean. Blocks are multiplied out first, so that long texts take few steps."""
    at, first, per, order = _blocks(n_words)
    x = np.where(at >= 0, np.exp(np.clip(e, -30, 30))[at] if len(e) else 1.0, 1.0)
    real = at >= 0
    n = len(at)
    p = np.tile(np.eye(2), (n, 1, 1))
    for j in range(BLOCK):
        y = x[:, j]
        c0 = p[:, :, 0] * a[0, 0] + p[:, :, 1] * a[1, 0]
        c1 = (p[:, :, 0] * a[0, 1] + p[:, :, 1] * a[1, 1]) * y[:, None]
        step = np.stack([c0, c1], 2)
        p = np.where(real[:, j, None, None], step / step.max((1, 2), keepdims=True), p)
    into, back = np.zeros(n), np.ones(n)
    active, sizes = order, per[order]
    v = np.zeros(len(order))
    u = np.ones(len(order))
    for k in range(int(per.max(initial=0))):
        m = int(np.searchsorted(-sizes, -k, side="left"))  # documents with more than k rows
        row = first[active[:m]] + k
        into[row] = v[:m]
        q = p[row]
        v[:m] = (q[:, 0, 1] + v[:m] * q[:, 1, 1]) / (q[:, 0, 0] + v[:m] * q[:, 1, 0])
        row = first[active[:m]] + sizes[:m] - 1 - k
        back[row] = u[:m]
        q = p[row]
        u[:m] = (q[:, 1, 0] + q[:, 1, 1] * u[:m]) / (q[:, 0, 0] + q[:, 0, 1] * u[:m])
    forward, backward = np.zeros(x.shape), np.ones(x.shape)
    r = into
    for j in range(BLOCK):
        r = np.where(real[:, j], x[:, j] * (a[0, 1] + a[1, 1] * r) / (a[0, 0] + a[1, 0] * r), r)
        forward[:, j] = r
    s = back
    for j in range(BLOCK - 1, -1, -1):
        backward[:, j] = s
        s = np.where(real[:, j], (a[1, 0] + a[1, 1] * x[:, j] * s) / (a[0, 0] + a[0, 1] * x[:, j] * s), s)
    return forward[real], backward[real]


def marginals(e: np.ndarray, n_words: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Probability of each token to be toxic, given its whole text."""
    f, b = ratios(e, n_words, a)
    return f * b / (1 + f * b)


@dataclass
class Model:
    weight: np.ndarray  # of each feature bucket
    bias: float
    transition: np.ndarray  # 2 x 2 factors
    calibration: np.ndarray  # of 1 and the aggregates

    def potentials(self, vocabulary: pa.Array) -> np.ndarray:
        bucket, owner = features(vocabulary)
        return np.bincount(owner, weights=self.weight[bucket], minlength=len(vocabulary)) + self.bias

    def tokens(self, codes: np.ndarray, n_words: np.ndarray, vocabulary: pa.Array) -> np.ndarray:
        return marginals(self.potentials(vocabulary)[codes] if len(codes) else np.zeros(0), n_words, self.transition)

    def score(self, p: np.ndarray, n_words: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(aggregates(p, n_words) @ self.calibration, -30, 30)))


def aggregates(p: np.ndarray, n_words: np.ndarray) -> np.ndarray:
    """1 and three aggregates of the marginals that reach LEAST_MARGINAL (so that long texts do not add up what is in none of their
    tokens): the probability that any token is toxic, the log of one more than the expected number, and the same of its percentage."""
    doc = np.repeat(np.arange(len(n_words)), n_words)
    told = np.where(p >= LEAST_MARGINAL, p, 0.0)
    none = np.bincount(doc, weights=np.log1p(-np.minimum(told, 1 - 1e-9)), minlength=len(n_words))
    count = np.bincount(doc, weights=told, minlength=len(n_words))
    return np.stack([np.ones(len(n_words)), -np.expm1(none), np.log1p(count), np.log1p(100 * count / np.maximum(n_words, 1))], 1)


def _runs(n_words: np.ndarray, tokens: int = FIT_TOKENS) -> list[tuple[int, int]]:
    """First and last token of runs of whole documents with about `tokens` tokens."""
    ends = np.cumsum(n_words)
    cuts = [0]
    while len(ends) and cuts[-1] < ends[-1]:
        k = int(np.searchsorted(ends, cuts[-1] + tokens, side="right"))
        cuts.append(int(ends[min(max(k - 1, int(np.searchsorted(ends, cuts[-1], side="right"))), len(ends) - 1)]))
    return list(zip(cuts[:-1], cuts[1:], strict=True))


def first_of_copies(codes: np.ndarray, n_words: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Whether each document shares none of its minimum hashes (over three words in order) with an earlier one of its class.
    Copies tell no more than their first: without this, all words of a copied toxic document would look toxic."""
    rng = np.random.default_rng(7)
    new = np.ones(len(n_words), bool)
    ends = np.cumsum(n_words)
    long_ = np.flatnonzero(n_words >= 3)
    if not len(long_):
        return new
    spread = rng.integers(1, 1 << 63, int(codes.max()) + 1, dtype=np.uint64)
    x = spread[codes]
    three = x[:-2] * np.uint64(0x9E3779B97F4A7C15) + (x[1:-1] ^ (x[1:-1] >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F) + x[2:]
    at = np.stack([ends[long_] - n_words[long_], ends[long_] - 2], 1).ravel()
    for _ in range(COPY_HASHES):
        mixed = (three ^ (three >> np.uint64(31))) * rng.integers(1, 1 << 63, dtype=np.uint64)
        mixed ^= mixed >> np.uint64(33)
        least = np.minimum.reduceat(np.append(mixed, np.uint64((1 << 64) - 1)), at)[::2] * np.uint64(2) + toxic[long_].astype(np.uint64)
        first = np.zeros(len(long_), bool)
        first[np.unique(least, return_index=True)[1]] = True
        new[long_] &= first
    return new


def token_labels(codes: np.ndarray, n_words: np.ndarray, bucket: np.ndarray, owner: np.ndarray, n_vocabulary: int, toxic: np.ndarray) -> np.ndarray:
    """1 for the tokens of toxic documents that have a telling feature."""
    doc = np.repeat(np.arange(len(n_words)), n_words)
    order = np.argsort(owner, kind="stable")
    start = np.searchsorted(owner[order], np.arange(n_vocabulary + 1))
    found = bucket[order]
    t, c = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    new = first_of_copies(codes, n_words, toxic)
    for lo, hi in _runs(n_words):
        own = new[doc[lo:hi]]
        pair = np.unique(doc[lo:hi][own] * n_vocabulary + codes[lo:hi][own])
        d, w = pair // n_vocabulary, pair % n_vocabulary
        n = start[w + 1] - start[w]
        at = np.repeat(start[w] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        per_doc = np.unique(np.repeat(d, n) * BUCKETS + found[at])
        of, which = per_doc // BUCKETS, per_doc % BUCKETS
        t += np.bincount(which[toxic[of] == 1], minlength=BUCKETS)
        c += np.bincount(which[toxic[of] == 0], minlength=BUCKETS)
    odds = np.log((t + 0.5) / (toxic[new].sum() + 1)) - np.log((c + 0.5) / ((1 - toxic[new]).sum() + 1))
    telling = (t >= LEAST_DOCS) & (odds >= LEAST_LOG_ODDS)
    word = np.zeros(n_vocabulary, bool)
    word[owner[telling[bucket]]] = True
    return (word[codes] & (toxic[doc] == 1)).astype(float)


def fit(texts: list[str | None], toxic: list[int], rate: float) -> Model | None:
    """The model of some labelled texts; rate: share of toxic documents among all labelled ones. None without both classes."""
    y = np.array(toxic, np.int64)
    if not len(y) or y.min() == y.max():
        return None
    codes, n_words, vocabulary = words(pa.array(texts, pa.string()))
    bucket, owner = features(vocabulary)
    label = token_labels(codes, n_words, bucket, owner, max(1, len(vocabulary)), y)
    weight, bias = np.zeros(BUCKETS), -4.0
    log_a = np.log(np.array([[0.98, 0.02], [0.8, 0.2]]))
    starts = np.zeros(len(codes), bool)
    starts[(np.cumsum(n_words) - n_words)[n_words > 0]] = True
    before = np.where(starts, 0.0, np.concatenate([[0.0], label[:-1]]) if len(label) else label)
    seen = np.array([[((1 - before) * (1 - label)).sum(), ((1 - before) * label).sum()], [(before * (1 - label)).sum(), (before * label).sum()]])
    del before
    first = np.cumsum(n_words) - n_words
    runs = [(lo, hi, n_words[(first >= lo) & (first < hi)]) for lo, hi in _runs(n_words)]
    m = [np.zeros(BUCKETS), 0.0, np.zeros((2, 2))]
    v = [np.zeros(BUCKETS), 0.0, np.zeros((2, 2))]
    scale = max(1.0, label.sum())
    for step in range(1, ROUNDS + 1):
        by_word = np.bincount(owner, weights=weight[bucket], minlength=len(vocabulary)) + bias
        a = np.exp(log_a)
        miss, expected = np.zeros(len(vocabulary)), np.zeros((2, 2))
        for lo, hi, own in runs:
            e = by_word[codes[lo:hi]]
            f, b = ratios(e, own, a)
            miss += np.bincount(codes[lo:hi], weights=label[lo:hi] - f * b / (1 + f * b), minlength=len(vocabulary))
            r = np.where(starts[lo:hi], 0.0, np.concatenate([[0.0], f[:-1]]))
            x = np.exp(np.clip(e, -30, 30))
            pairs = [np.full(len(r), a[0, 0]), a[0, 1] * x * b, r * a[1, 0], r * a[1, 1] * x * b]
            z = sum(pairs)
            expected += np.array([(q / z).sum() for q in pairs]).reshape(2, 2)
        grads = [np.bincount(bucket, weights=miss[owner], minlength=BUCKETS) / scale - L2 * weight, miss.sum() / scale, (seen - expected) / scale]
        steps = []
        for k, g in enumerate(grads):
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.99 * v[k] + 0.01 * g * g
            steps.append(LEARNING_RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6))
        touched = np.abs(grads[0]) > 1e-7
        weight, bias, log_a = weight + np.where(touched, steps[0], 0) * 0.5, bias + steps[1] * 0.2, log_a + steps[2] * 0.2
    a = np.exp(log_a)
    by_word = np.bincount(owner, weights=weight[bucket], minlength=len(vocabulary)) + bias
    p = np.concatenate([np.zeros(0), *[marginals(by_word[codes[lo:hi]], own, a) for lo, hi, own in runs]])
    z = aggregates(p, n_words)
    share = y.mean()
    cost = np.where(y == 1, rate / share, (1 - rate) / (1 - share))
    return Model(weight, float(bias), a, _logistic(z, y, cost))


def _logistic(z: np.ndarray, y: np.ndarray, cost: np.ndarray, rounds: int = 60, ridge: float = 1e-4) -> np.ndarray:
    """Newton's method with shorter steps where a whole one does not lower the loss; weights of the aggregates stay at zero or above."""
    cost = cost / cost.sum()

    def loss(w: np.ndarray) -> float:
        u = z @ w
        return float((cost * (np.logaddexp(0, u) - y * u)).sum() + ridge / 2 * (w * w).sum())

    w = np.zeros(z.shape[1])
    now = loss(w)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        g = z.T @ (cost * (y - p)) - ridge * w
        free = np.array([True, *((w[1:] > 0) | (g[1:] > 0))])
        h = (z[:, free] * (cost * p * (1 - p))[:, None]).T @ z[:, free] + ridge * np.eye(free.sum())
        step, size = np.zeros(len(w)), 1.0
        step[free] = np.linalg.solve(h, g[free])
        while size > 1e-6:
            new = w + size * step
            new[1:] = np.maximum(new[1:], 0)
            if (then := loss(new)) < now:
                break
            size /= 2
        else:
            break
        done, w, now = now - then < 1e-10, new, then
        if done:
            break
    return w


def labelled_sample(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_DOCS, class_bytes: int = SAMPLE_BYTES) -> tuple[list, list, float]:
    """Texts and labels of a bounded sample, and the share of toxic labels. In each class, ids are taken in the order of their
    hash, per_class of them at most, as long as their texts together fit class_bytes; one that no longer fits is passed over, so
    that long texts are as welcome as short ones. Sizes are gathered first, and only the texts of the sample come to the driver."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    known = known.where(~held_out(F.col("doc_id"), *HELD_OUT))
    rate = known.agg(F.avg("toxic")).first()[0] or 0.0
    order = [F.xxhash64("doc_id"), "doc_id"]
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    first = known.where("toxic = 1").orderBy(*order).limit(per_class).unionByName(known.where("toxic = 0").orderBy(*order).limit(per_class))
    sizes = own.join(F.broadcast(first), "doc_id").groupBy("doc_id", "toxic").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).alias("bytes"))
    room, picked = {0: class_bytes, 1: class_bytes}, []
    for r in sizes.orderBy(*order).collect():  # 2 * per_class rows at most
        if r.bytes <= room[r.toxic]:
            room[r.toxic] -= r.bytes
            picked.append((r.doc_id, r.toxic))
    chosen = docs.sparkSession.createDataFrame(picked, "doc_id long, toxic int")
    rows = own.join(F.broadcast(chosen), "doc_id").orderBy(*order, "text").select("text", "toxic").toArrow()
    return rows.column("text").to_pylist(), rows.column("toxic").to_pylist(), rate


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, per_class: int = SAMPLE_DOCS, class_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """doc_id, held_out, score, predicted, spans (start, end, probability, in code points): a row for each row of docs.

    The model is fitted on at most per_class labelled documents of each class with at most class_bytes bytes of text together
    (see `labelled_sample`), none of them held out (doc_id's crc32 by HELD_OUT); a doc_id labelled twice counts as toxic if any label says so. Null or empty
    text is scored like a text without words. Without labels of both classes every score is 0. Every
    token of a long text counts. Repeated rows get equal results, a null doc_id stays null and is not
    held out, other columns are ignored. An empty table gives an empty result.
    """
    broadcast = docs.sparkSession.sparkContext.broadcast(fit(*labelled_sample(docs, labels, per_class, class_bytes)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = broadcast.value
        for batch in chunks(batches):
            n = batch.num_rows
            score, spans = np.zeros(n), [[] for _ in range(n)]
            if model is not None:
                codes, n_words, vocabulary = words(batch.column("text"))
                p = model.tokens(codes, n_words, vocabulary)
                score = model.score(p, n_words)
                doc = np.repeat(np.arange(n), n_words)
                hit = np.flatnonzero(p >= SPAN_PROBABILITY)
                first = np.cumsum(n_words) - n_words
                for k in np.unique(doc[hit]):
                    own = hit[doc[hit] == k] - first[k]
                    found = list(_WORD.finditer(batch.column("text")[int(k)].as_py()))
                    spans[k] = [{"start": found[w].start(), "end": found[w].end(), "probability": float(p[first[k] + w])} for w in own]
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("probability", pa.float64())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= threshold).astype(np.int32)), pa.array(spans, kind)], ["doc_id", "held_out", "score", "predicted", "spans"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id"), *HELD_OUT).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, spans array<struct<start:int,end:int,probability:double>>")


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, per_class: int = SAMPLE_DOCS, class_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """The rows of docs that are not predicted toxic, with all their columns, whatever their names.

    The model is that of `toxicity`. Rows with null or empty text stay unless a text without words scores the threshold; without labels
    of both classes every row stays. Rows of a null doc_id are judged by their text, repeated rows stay or go
    together, long texts are judged as a whole. An empty table gives an empty result."""
    broadcast = docs.sparkSession.sparkContext.broadcast(fit(*labelled_sample(docs, labels, per_class, class_bytes)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = broadcast.value
        for batch in chunks(batches):
            if model is not None:
                codes, n_words, vocabulary = words(batch.column("text"))
                batch = batch.filter(pa.array(model.score(model.tokens(codes, n_words, vocabulary), n_words) < threshold))
            yield batch

    return docs.mapInArrow(run, docs.schema)
