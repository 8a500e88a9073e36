"""Byte-level BPE encoding and decoding.

A text is split by a pattern; a task merges every distinct match once. Over the byte positions of a match lies a
segment tree: the leaf at a position holds the rank of the pair that starts there, a node the smallest rank
below it with its leftmost position. The root names the next merge; it changes at most three pairs (the merged
one, the one before and the one behind), and each is a point update along one path to the root. Matches
of similar length are merged together, one merge of each in a step; long ones go one by one.
"""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, types as T

from folio.llm.storage import replaced
from folio.llm.text import chunks

#: The vocabulary's file, and the pattern that goes with it (as its library's README names it).
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes of text that are encoded, and ids that are decoded, in one step; one longer text stands alone.
STEP_BYTES, STEP_IDS = 1 << 21, 1 << 18
#: Distinct segments and matches, and bytes of each, that a task remembers; beyond either it starts anew.
HELD_WORDS, HELD_BYTES = 1 << 17, 1 << 25
#: Matches with more pairs than this, and fewer of a length than that, are merged one by one.
LONG_PAIRS, FEW_WORDS = 1024, 16
#: Nodes of all trees that are merged together.
TREE_NODES = 1 << 17
NONE = np.iinfo(np.int64).max
_GLUED = re.compile(r"(?<=\S)(?= )")


@dataclass
class BytePairs:
    """A vocabulary: bytes of each id, id of each single byte, and of each pair of ids that can merge (sorted by
    left * 2^32 + right) the rank. `made` holds the id that a rank makes; `whole` the ids of matches that need no merge."""

    surface: list[bytes]
    byte_ids: np.ndarray
    pairs: np.ndarray
    ranks: np.ndarray
    made: np.ndarray
    whole: dict[bytes, int]
    pattern: str = PATTERN

    def __post_init__(self) -> None:
        self.lengths = np.array([len(x) for x in self.surface], np.int64)
        self.begins = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(self.surface), np.uint8)
        # Open addressing: a pair lies at the first free place from its own on.
        self.bits = max(4, (4 * len(self.pairs)).bit_length())
        self.slots, self.values = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int64)
        left = np.arange(len(self.pairs))
        at = self._place(self.pairs)
        while len(left):
            free = self.slots[at] < 0
            self.slots[at[free]] = self.pairs[left[free]]  # of several that want one place the last gets it
            self.values[at[free]] = self.ranks[left[free]]
            on = self.slots[at] != self.pairs[left]
            left, at = left[on], (at[on] + 1) & ((1 << self.bits) - 1)
        self.by_pair = None

    def _place(self, pairs: np.ndarray) -> np.ndarray:
        return ((pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids, -1 where it cannot merge."""
        pairs = (left << 32) | right
        at = self._place(pairs)
        found = self.slots[at]
        out = np.where(found == pairs, self.values[at], -1)
        on = np.flatnonzero((found != pairs) & (found >= 0))
        at = at[on]
        while len(on):
            at = (at + 1) & ((1 << self.bits) - 1)
            found = self.slots[at]
            hit = found == pairs[on]
            out[on[hit]] = self.values[at[hit]]
            more = ~hit & (found >= 0)
            on, at = on[more], at[more]
        return out

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words (matches of the pattern) end to end, and how many each has."""
        if not words:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        begins = np.cumsum(lengths) - lengths
        flat = np.frombuffer(b"".join(words), np.uint8)
        known = np.fromiter((self.whole.get(w, -1) for w in words), np.int64, len(words)) if self.whole else np.full(len(words), -1)
        known = np.where((known < 0) & (lengths == 1), self.byte_ids[flat[np.minimum(begins, len(flat) - 1)]], known)
        bits = np.where(known >= 0, -2, np.where(lengths == 0, -1, np.ceil(np.log2(np.maximum(lengths - 1, 1))).astype(np.int64)))
        owners, found, counts = [np.flatnonzero(known >= 0)], [known[known >= 0]], [np.ones((known >= 0).sum(), np.int64)]
        for b in np.unique(bits[bits >= 0]).tolist():
            mine, size = np.flatnonzero(bits == b), 1 << b
            if size > LONG_PAIRS or (size > FEW_WORDS and len(mine) < FEW_WORDS):
                for k in mine.tolist():
                    owners.append(np.array([k]))
                    found.append(self._merge_one(words[k], size))
                    counts.append(np.array([len(found[-1])]))
                continue
            step = max(FEW_WORDS, TREE_NODES // (2 * size))
            for lo in range(0, len(mine), step):
                part = mine[lo : lo + step]
                ids, n = self._merge_many(flat, begins[part], lengths[part], size)
                owners.append(part)
                found.append(ids)
                counts.append(n)
        owner, ids, n = np.concatenate(owners), np.concatenate(found), np.concatenate(counts)
        total = np.zeros(len(words), np.int64)
        total[owner] = n
        start = np.cumsum(total) - total
        out = np.empty(len(ids), np.int64)
        out[np.repeat(start[owner] - (np.cumsum(n) - n), n) + np.arange(len(ids))] = ids
        return out, total

    def _merge_many(self, text: np.ndarray, begins: np.ndarray, lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Words of at most size + 1 bytes. Row w of every array belongs to word w; arrays are read flat."""
        n, width = len(lengths), size + 1
        row, col = np.repeat(np.arange(n), lengths), np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        ids = np.full(n * width, -1, np.int64)
        ids[row * width + col] = self.byte_ids[text[begins[row] + col]]
        after = np.tile(np.arange(1, width + 1), n)
        before = np.tile(np.arange(-1, width - 1), n)
        first = np.flatnonzero(col + 1 < lengths[row])
        at = row[first] * width + col[first]
        rank = self.rank(ids[at], ids[at + 1])
        tree = np.full((n, 2 * size), NONE, np.int64)
        tree[row[first], size + col[first]] = np.where(rank >= 0, rank * size + col[first], NONE)
        half = size
        while half > 1:
            half //= 2
            tree[:, half : 2 * half] = np.minimum(tree[:, 2 * half : 4 * half : 2], tree[:, 2 * half + 1 : 4 * half : 2])
        flat, live = tree.reshape(-1), np.arange(n)
        while True:
            top = flat[live * (2 * size) + 1]
            live, top = live[top < NONE], top[top < NONE]
            if not len(live):
                break
            base, p = live * width, top % size
            mid = after[base + p]
            end = after[base + mid]
            ids[base + p] = self.made[top // size]
            ids[base + mid] = -1
            after[base + p] = end
            inner = end < lengths[live]
            before[(base + end)[inner]] = p[inner]
            prior = before[base + p]
            has = prior >= 0
            left = np.concatenate([(base + p)[inner], (base + prior)[has]])
            right = np.concatenate([(base + end)[inner], (base + p)[has]])
            start = np.concatenate([p[inner], prior[has]])
            rank = self.rank(ids[left], ids[right])
            value = np.concatenate([np.full(len(live), NONE), np.full((~inner).sum(), NONE), np.where(rank >= 0, rank * size + start, NONE)])
            where = np.concatenate([live, live[~inner], live[inner], live[has]]) * (2 * size)
            node = np.concatenate([mid, p[~inner], start])
            # A merged pair's second part may be the last byte, where no leaf is.
            ok = node < size
            value, where, node = value[ok], where[ok], node[ok] + size
            flat[where + node] = value
            while size > 1 and node[0] > 1:
                node = node >> 1
                flat[where + node] = np.minimum(flat[where + 2 * node], flat[where + 2 * node + 1])
        left = ids >= 0
        return ids[left], left.reshape(n, width).sum(1)

    def _merge_one(self, word: bytes, size: int) -> np.ndarray:
        """The same for one word, of any length."""
        if self.by_pair is None:
            self.by_pair = dict(zip(self.pairs.tolist(), self.ranks.tolist(), strict=True))
        rank_of, made, none = self.by_pair, self.made, int(NONE)
        ids = self.byte_ids[np.frombuffer(word, np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        leaves = np.full(size, NONE, np.int64)
        first = np.array(ids, np.int64)
        rank = self.rank(first[:-1], first[1:])
        leaves[: n - 1] = np.where(rank >= 0, rank * size + np.arange(n - 1), NONE)
        levels = [leaves]
        while len(levels[-1]) > 1:
            levels.append(np.minimum(levels[-1][::2], levels[-1][1::2]))
        tree = [none] + list(chain.from_iterable(x.tolist() for x in reversed(levels)))

        def put(at: int, value: int) -> None:
            node = at + size
            tree[node] = value
            while node > 1:
                node >>= 1
                a, b = tree[2 * node], tree[2 * node + 1]
                if b < a:
                    a = b
                if tree[node] == a:
                    return
                tree[node] = a

        while tree[1] < none:
            rank, p = divmod(tree[1], size)
            mid = after[p]
            end = after[mid]
            ids[p], ids[mid], after[p] = int(made[rank]), -1, end
            if mid < size:
                put(mid, none)
            if end < n:
                before[end] = p
                r = rank_of.get((ids[p] << 32) | ids[end])
                put(p, none if r is None else r * size + p)
            else:
                put(p, none)
            q = before[p]
            if q >= 0:
                r = rank_of.get((ids[q] << 32) | ids[p])
                put(q, none if r is None else r * size + q)
        return np.array([x for x in ids if x >= 0], np.int64)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The bytes of each run of ids."""
        n = self.lengths[ids]
        at = np.repeat(self.begins[ids] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        joined = self.bytes[at].tobytes()
        ends = np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], np.cumsum(counts)])].tolist()
        return [joined[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


class Store:
    """What a task knows of the keys it has met: a list of numbers for each, end to end, from `make` (keys to numbers and
    how many each has). If bounded, it forgets all when it holds too much."""

    def __init__(self, make: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], bounded: bool = True):
        self.make, self.bounded = make, bounded
        self.clear()

    def clear(self) -> None:
        self.code: dict[str, int] = {}
        self.held = 0
        self.values, self.first, self.n = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def codes(self, keys: list[str]) -> np.ndarray:
        """The place of each key; it holds until the next call."""
        if self.bounded and (len(self.code) > HELD_WORDS or self.held > HELD_BYTES):
            self.clear()
        code = self.code
        new = list(dict.fromkeys([k for k in keys if k not in code]))
        if new:
            values, n = self.make(new)
            code.update(zip(new, range(len(self.n), len(self.n) + len(new)), strict=True))
            self.first = np.concatenate([self.first, len(self.values) + np.cumsum(n) - n])
            self.values, self.n = np.concatenate([self.values, values]), np.concatenate([self.n, n])
            self.held += sum(map(len, new)) + 8 * len(values)
        return np.fromiter(map(code.__getitem__, keys), np.int64, len(keys))

    def lists(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of all codes end to end, and how many each has."""
        n = self.n[codes]
        at = np.repeat(self.first[codes] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return self.values[at], n


class Encoder:
    """Encodes texts in a task. The pattern never matches across a blank behind a character that is no white space, so texts are first
    cut there, and each distinct segment is split and encoded once."""

    def __init__(self, model: BytePairs):
        self.split = regex.compile(model.pattern).findall
        self.words = Store(lambda words: model.encode_words([w.encode() for w in words]))
        self.segments = Store(self.segment_ids)

    def segment_ids(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all segments end to end, and how many each has."""
        # Segments that start with a blank and end in no white space are split end to end, as one text.
        plain = np.fromiter((s[:1] == " " and not s[-1].isspace() for s in segments), bool, len(segments))
        joined = [s for s, ok in zip(segments, plain.tolist(), strict=True) if ok]
        words = self.split("".join(joined))
        ends = np.cumsum(np.fromiter(map(len, joined), np.int64, len(joined)))
        n_words = np.zeros(len(segments), np.int64)
        n_words[plain] = np.diff(np.searchsorted(np.cumsum(np.fromiter(map(len, words), np.int64, len(words))), ends, side="right"), prepend=0)
        others = np.flatnonzero(~plain)
        parts = [self.split(segments[k]) for k in others.tolist()]
        n_words[others] = list(map(len, parts))
        codes = self.words.codes(words + list(chain.from_iterable(parts)))
        order = np.argsort(np.concatenate([np.repeat(np.flatnonzero(plain), n_words[plain]), np.repeat(others, n_words[others])]), kind="stable") if len(others) else slice(None)
        ids, n = self.words.lists(codes[order])
        return ids, np.bincount(np.repeat(np.arange(len(segments)), n_words), weights=n, minlength=len(segments)).astype(np.int64)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and how many each has (null: none)."""
        keys, codes, n_parts = segments(texts)
        ids, n = self.segments.lists(self.segments.codes(keys)[codes])
        return ids, np.bincount(np.repeat(np.arange(len(texts)), n_parts), weights=n, minlength=len(texts)).astype(np.int64)


def segments(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Texts cut before each blank that stands behind no white space: the distinct segments, the code of each segment in order, and
    the number of segments of each text (null and empty: none)."""
    whole = pc.fill_null(texts.cast(pa.string()), "")
    lists = pc.split_pattern(whole, " ")
    flat, counts = lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = flat.dictionary_encode()
    code, keys = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_pylist()
    ends = np.cumsum(counts)
    first = ends - counts
    # Parts that end in white space, and empty ones but a text's first, are glued to what follows.
    spaced = [" " + k for k in keys]
    loose = np.fromiter(map(str.isspace, [k[-1] for k in spaced]), bool, len(keys))[code]
    loose[first] &= np.fromiter((keys[c] != "" for c in code[first].tolist()), bool, len(first))
    loose[ends - 1] = False
    owner = np.repeat(np.arange(len(counts)), counts)
    bad = np.unique(owner[loose])
    # A text's first part has no blank before it.
    extra: dict[str, int] = {}
    code[first] = [len(spaced) + extra.setdefault(keys[c], len(extra)) for c in code[first].tolist()]
    empty = len(spaced) + extra[""] if "" in extra else -1
    glued: dict[int, list[int]] = {}
    for k in bad.tolist():
        own = _GLUED.split(whole[k].as_py())
        glued[k] = [len(spaced) + extra.setdefault(s, len(extra)) for s in own]
    keep = code != empty
    if len(bad):
        keep &= ~np.isin(owner, bad)
        parts = np.split(np.arange(len(code)), ends[:-1])
        code = np.concatenate([np.array(glued[k], np.int64) if k in glued else code[p][keep[p]] for k, p in enumerate(parts)])
        n = np.bincount(owner[keep], minlength=len(counts))
        n[bad] = [len(glued[k]) for k in bad.tolist()]
    else:
        code, n = code[keep], np.bincount(owner[keep], minlength=len(counts))
    return spaced + list(extra), code, n


def load_ranks(path: str = RANKS, pattern: str = PATTERN) -> BytePairs:
    """A file of base64 tokens with ranks. As in the library of such files, two neighbours merge if their joined bytes are a token, and
    a match that is a token itself needs no merge."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(None, map(bytes.strip, f)))}
    return make_pairs(ranks, [(ranks[t[:k]], ranks[t[k:]], r, r) for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks], ranks, pattern)


def load_merges(path: str, pattern: str = PATTERN) -> BytePairs:
    """A JSON file with a vocabulary in the byte-level alphabet and its merges in order: only listed pairs merge."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    byte_of = {c: b for b, c in byte_alphabet().items()}
    vocab = model["vocab"]
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    ids = {bytes(byte_of[c] for c in token): k for token, k in vocab.items() if all(c in byte_of for c in token)}
    return make_pairs(ids, [(vocab[a], vocab[b], rank, vocab[a + b]) for rank, (a, b) in enumerate(merges)], {}, pattern)


def make_pairs(ids: dict[bytes, int], merges: list[tuple[int, int, int, int]], whole: dict[bytes, int], pattern: str = PATTERN) -> BytePairs:
    """From the id of each token's bytes and merges (left id, right id, rank, id made). Every single byte must be a token."""
    surface = [b""] * (max(ids.values()) + 1)
    for token, k in ids.items():
        surface[k] = token
    table = np.array([ids[bytes([b])] for b in range(256)], np.int64)
    rows = np.array(sorted({(a << 32) | b: (rank, to) for a, b, rank, to in merges}.items(), key=lambda x: x[0]), dtype=object)
    pairs = np.array([x[0] for x in rows], np.int64)
    ranks = np.array([x[1][0] for x in rows], np.int64)
    made = np.zeros(int(ranks.max(initial=-1)) + 1, np.int64)
    made[ranks] = [x[1][1] for x in rows]
    return BytePairs(surface, table, pairs, ranks, made, whole, pattern)


def byte_alphabet() -> dict[int, str]:
    """The printable character of each byte in byte-level vocabularies: itself if it is visible Latin-1, else the next from U+0100 on."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(seen)]
    return {b: chr(b) for b in seen} | {b: chr(256 + k) for k, b in enumerate(hidden)}


def encode(docs: DataFrame, model: BytePairs | None = None) -> DataFrame:
    """docs with ids (array of token ids) and n_tokens.

    Texts are encoded whole; special tokens in them are plain text. Null text has null ids, empty text none
    (n_tokens 0 for both). Pairs of one rank merge from the left. A text of one long match takes time in proportion
    to n log n. Other columns pass through; columns named ids or n_tokens, in any letter case, are replaced. Repeated rows get equal results, and
    an empty table gives an empty result. Every text survives decoding.
    """
    docs = replaced(docs, ["ids", "n_tokens"])
    shared = docs.sparkSession.sparkContext.broadcast(model or load_ranks())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in chunks(batches, size=STEP_BYTES):
            ids, counts = encoder.encode(batch.column("text"))
            null = pc.is_null(batch.column("text")).to_numpy(zero_copy_only=False)
            offsets = pa.array(np.append(np.cumsum(counts) - counts, counts.sum()).astype(np.int32), mask=np.append(null, False))
            lists = pa.ListArray.from_arrays(offsets, pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists, pa.array(counts)], [*batch.schema.names, "ids", "n_tokens"])

    schema = T.StructType([*docs.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType())])
    return docs.mapInArrow(run, schema)


def decode(encoded: DataFrame, model: BytePairs | None = None) -> DataFrame:
    """encoded with decoded (binary): the bytes of each row's ids.

    Null ids have null, no ids empty bytes; null or unknown ids in an array are skipped. Ids need not end at a
    character's end, so bytes are not made text here. A column named decoded is replaced, all others pass through; repeated rows get equal
    results, and an empty table gives an empty result.
    """
    encoded = replaced(encoded, ["decoded"])
    shared = encoded.sparkSession.sparkContext.broadcast(model or load_ranks())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = np.cumsum(pc.fill_null(pc.list_value_length(batch.column("ids")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            cuts = np.flatnonzero(np.diff(ends // STEP_IDS, prepend=0)).tolist()
            for lo, hi in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                if lo == hi:
                    continue
                part = batch.slice(lo, hi - lo)
                lists = part.column("ids")
                ids = pc.fill_null(lists.flatten(), -1).to_numpy(zero_copy_only=False).astype(np.int64)
                owner = np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
                ok = (ids >= 0) & (ids < len(shared.value.surface))
                found = shared.value.decode(ids[ok], np.bincount(owner[ok], minlength=len(lists)))
                out = pa.array([None if null else x for null, x in zip(pc.is_null(lists).to_pylist(), found, strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns, out], [*part.schema.names, "decoded"])

    return encoded.mapInArrow(run, T.StructType([*encoded.schema.fields, T.StructField("decoded", T.BinaryType())]))
