"""Encoding to and decoding from the pieces of a SentencePiece model, by unigram Viterbi.

The pieces, with log scores, lie in a double-array trie over UTF-8 bytes. In a task, every distinct word of
a run of texts is encoded once: the trie is walked from all byte positions at the same time, and
the best path is found position by position for all words together. Blanks are written as the
whitespace marker (with one more before the text); a character in no piece becomes its bytes, or
the unknown piece if the model has no byte pieces. Decoding joins the bytes of the pieces.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, types as T

from folio.llm.storage import replaced
from folio.llm.text import chunks

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARKER = "▁"
#: How far an unknown character lies below the lowest score.
UNKNOWN_COST = 10.0
#: Words longer than this are searched one by one, not position by position with the others.
LONG_BYTES = 96
#: Bytes of text that are encoded, and ids that are decoded, in one step; one longer text stands alone.
STEP_BYTES, STEP_IDS = 1 << 19, 1 << 18
_SEGMENT = re.compile(rb" *[^ ]+| +")


class DoubleArray:
    """A trie in two arrays: the child of state s by byte c is t = base[s] + c + 1, if check[t] is s. value[t]: the
    number of the key that ends there, or -1."""

    def __init__(self, keys: list[bytes]):
        root: dict = {}
        for k, key in enumerate(keys):
            node = root
            for c in key:
                node = node.setdefault(c, {})
            node[-1] = k
        size = 1 << 16
        self.base, self.check, self.value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        used = bytearray(size)
        used[0] = 1
        todo, free, top = [(root, 0)], 1, 0
        while todo:
            node, at = todo.pop()
            self.value[at] = node.pop(-1, -1)
            codes = sorted(node)
            if not codes:
                continue
            if len(codes) > 8:  # dense nodes go behind all others: fewer tries
                b = top
            else:
                while used[free]:
                    free += 1
                b = max(0, free - codes[0] - 1)
            tried = b
            while b + 258 > len(used) or any(used[b + c + 1] for c in codes):
                if b + 258 > len(used):
                    self._grow()
                    used.extend(bytes(len(used)))
                else:
                    b += 1
            if b - tried > 64:  # what lies before is nearly full
                free = max(free, b)
            self.base[at] = b
            for c in codes:
                used[b + c + 1] = 1
                self.check[b + c + 1] = at
                top = max(top, b + c + 1)
                todo.append((node[c], b + c + 1))
        self._grow(258)

    def _grow(self, more: int | None = None) -> None:
        n = more or len(self.base)
        self.base = np.concatenate([self.base, np.zeros(n, np.int32)])
        self.check = np.concatenate([self.check, np.full(n, -1, np.int32)])
        self.value = np.concatenate([self.value, np.full(n, -1, np.int32)])

    def matches(self, flat: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, key) of all keys in flat that start at one of starts and end by its stop."""
        out = []
        state, at, origin, stop = np.zeros(len(starts), np.int64), starts.copy(), starts, stops
        while len(at):
            t = self.base[state] + flat[at].astype(np.int64) + 1
            ok = self.check[t] == state
            t, at, origin, stop = t[ok], at[ok] + 1, origin[ok], stop[ok]
            key = self.value[t]
            hit = key >= 0
            out.append((origin[hit], at[hit], key[hit]))
            on = at < stop
            state, at, origin, stop = t[on], at[on], origin[on], stop[on]
        return tuple(np.concatenate(x).astype(np.int64) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3


@dataclass
class Pieces:
    """A model: the bytes of each id's piece (marker as blank), scores of the pieces that text can hold, and special ids."""

    surface: list[bytes]
    ids: np.ndarray  # ids of the trie's keys
    scores: np.ndarray  # and their log scores
    trie: DoubleArray
    byte_ids: np.ndarray | None
    unknown: int
    alone: bool  # no piece goes on over a blank after another character

    def __post_init__(self) -> None:
        self.lowest = float(self.scores.min(initial=0.0)) - UNKNOWN_COST
        self.lengths = np.array([len(x) for x in self.surface], np.int64)
        self.begins = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(self.surface), np.uint8)

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and how many each has. An empty text has none."""
        parts = [(_SEGMENT.findall(b" " + t) if self.alone else [b" " + t]) if t else [] for t in texts]
        n_parts = np.fromiter(map(len, parts), np.int64, len(parts))
        coded = pa.array([s for p in parts for s in p], pa.binary()).dictionary_encode()
        ids, n_ids = self._encode_words(coded.dictionary.to_pylist())
        code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        first = np.cumsum(n_ids) - n_ids
        n = n_ids[code]
        at = np.repeat(first[code] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        per_text = np.bincount(np.repeat(np.arange(len(texts)), n_parts), weights=n, minlength=len(texts)).astype(np.int64)
        return ids[at], per_text

    def _encode_words(self, own: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        if not own:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        lengths = np.fromiter(map(len, own), np.int64, len(own))
        flat = np.frombuffer(b"".join(own), np.uint8)
        begin = np.cumsum(lengths) - lengths
        word = np.repeat(np.arange(len(own)), lengths)
        chars = np.flatnonzero((flat & 0xC0) != 0x80)
        start, end, key = self.trie.matches(flat, chars, (begin + lengths)[word[chars]])
        # A character that is no piece by itself may stand as unknown.
        char_end = np.append(chars[1:], len(flat))
        char_end = np.minimum(char_end, (begin + lengths)[word[chars]])
        single = np.zeros(len(flat) + 1, bool)
        whole = np.zeros(len(flat), np.int64)
        whole[chars] = char_end
        single[start[whole[start] == end]] = True
        lone = ~single[chars]
        start, end = np.concatenate([start, chars[lone]]), np.concatenate([end, char_end[lone]])
        key = np.concatenate([key, np.full(lone.sum(), -1)])
        score = np.where(key >= 0, self.scores[key] if len(self.scores) else 0.0, self.lowest)
        slot = word[start] + start  # a node before each byte of a word, and one behind its last
        to = word[start] + end
        best = np.full(len(flat) + len(own), -np.inf)
        best[begin + np.arange(len(own))] = 0.0
        back = np.full(len(best), -1, np.int64)
        local = end - begin[word[start]]
        short = lengths[word[start]] <= LONG_BYTES
        order = np.lexsort((start[short], local[short]))
        idx = np.flatnonzero(short)[order]
        cuts = np.searchsorted(local[idx], np.arange(1, LONG_BYTES + 2))
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            m = idx[lo:hi]
            if not len(m):
                continue
            value = best[slot[m]] + score[m]
            np.maximum.at(best, to[m], value)
            m = m[value == best[to[m]]][::-1]  # of equal paths the longest last piece stays
            back[to[m]] = m
        long_ = np.flatnonzero(~short)
        long_ = long_[np.lexsort((start[long_], to[long_]))]
        for m, s, t, x in zip(long_.tolist(), slot[long_].tolist(), to[long_].tolist(), score[long_].tolist(), strict=True):
            if best[s] + x > best[t]:
                best[t] = best[s] + x
                back[t] = m
        return self._paths(flat, begin, lengths, start, end, key, slot, back)

    def _paths(self, flat, begin, lengths, start, end, key, slot, back) -> tuple[np.ndarray, np.ndarray]:
        n = len(begin)
        at, stop = begin + lengths + np.arange(n), begin + np.arange(n)
        live, taken, owner = np.arange(n), [], []
        while len(live):
            m = back[at[live]]
            taken.append(m)
            owner.append(live)
            at[live] = slot[m]
            live = live[at[live] > stop[live]]
        taken, owner = np.concatenate(taken), np.concatenate(owner)
        order = np.lexsort((start[taken], owner))
        taken, owner = taken[order], owner[order]
        unknown = key[taken] < 0
        width = np.where(unknown & (self.byte_ids is not None), end[taken] - start[taken], 1)
        at = np.repeat(np.arange(len(taken)), width)
        k = np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)
        ids = np.where(unknown, self.unknown, self.ids[np.maximum(key[taken], 0)] if len(self.ids) else self.unknown)[at]
        if self.byte_ids is not None:
            raw = unknown[at]
            ids[raw] = self.byte_ids[flat[(start[taken][at] + k)[raw]]]
        return ids, np.bincount(owner, weights=width, minlength=n).astype(np.int64)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """The texts: bytes of their pieces without the first blank; bytes that are no UTF-8 become U+FFFD."""
        n = self.lengths[ids]
        at = np.repeat(self.begins[ids] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        joined = self.bytes[at].tobytes()
        ends = np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], np.cumsum(counts)])].tolist()
        parts = (joined[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True))
        return [(p[1:] if p[:1] == b" " else p).decode("utf-8", "replace") for p in parts]


def load_pieces(path: str = MODEL, scores: str = "rank") -> Pieces:
    """A model file. scores: "model" takes the file's scores (a unigram model); "rank" reads them as merge ranks (a BPE
    model has no probabilities) and gives rank r the log score -log(r + 2), as in a Zipf distribution."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = model.get_piece_size()
    surface, keys, ids, values, byte_ids = [], [], [], [], {}
    for k in range(size):
        piece = model.id_to_piece(k)
        if model.is_byte(k):
            byte_ids[int(piece[1:-1], 16)] = k
            surface.append(bytes([int(piece[1:-1], 16)]))
        elif model.is_control(k) or model.is_unknown(k) or model.is_unused(k):
            surface.append(" ⁇ ".encode() if model.is_unknown(k) else b"")
        else:
            own = piece.replace(MARKER, " ").encode()
            surface.append(own)
            keys.append(own)
            ids.append(k)
            values.append(float(model.get_score(k)))
    return make_pieces(surface, keys, ids, [-math.log(2 - v) for v in values] if scores == "rank" else values, byte_ids, model.unk_id())


def make_pieces(surface: list[bytes], keys: list[bytes], ids: list[int], scores: list[float], byte_ids: dict[int, int], unknown: int) -> Pieces:
    table = np.array([byte_ids[k] for k in range(256)]) if len(byte_ids) == 256 else None
    alone = not any(b" " in k.lstrip(b" ") for k in keys)
    return Pieces(surface, np.array(ids, np.int64), np.array(scores, np.float64), DoubleArray(keys), table, unknown, alone)


def encode(docs: DataFrame, model: Pieces | None = None) -> DataFrame:
    """docs with ids (array of piece ids) and n_ids.

    Null text has null ids, empty text none (n_ids 0 for both). Texts are encoded whole. Other columns pass
    through; columns named ids or n_ids are replaced. Repeated rows get equal results, and an empty table
    gives an empty result. Every text survives decoding if the model has byte pieces; a marker
    character in a text is encoded by its bytes, so it does not come back as a blank.
    """
    docs = replaced(docs, ["ids", "n_ids"])
    shared = docs.sparkSession.sparkContext.broadcast(model or load_pieces())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, size=STEP_BYTES):
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            ids, counts = shared.value.encode([t or b"" for t in texts])
            offsets = pa.array([None if t is None else o for t, o in zip(texts, (np.cumsum(counts) - counts).tolist(), strict=True)] + [int(counts.sum())], pa.int32())
            lists = pa.ListArray.from_arrays(offsets, pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists, pa.array(counts)], [*batch.schema.names, "ids", "n_ids"])

    schema = T.StructType([*docs.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_ids", T.LongType())])
    return docs.mapInArrow(run, schema)


def decode(encoded: DataFrame, model: Pieces | None = None) -> DataFrame:
    """encoded with decoded: the text of each row's ids; null for null ids. Null or unknown ids in an array are skipped, and no ids
    are an empty text. Repeated rows get equal results, and an empty table gives an empty one. Lists of any length are decoded whole.
    A column named decoded, in any letter case, is replaced; all others pass through."""
    encoded = replaced(encoded, ["decoded"])
    shared = encoded.sparkSession.sparkContext.broadcast(model or load_pieces())

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
                texts = shared.value.decode(ids[ok], np.bincount(owner[ok], minlength=len(lists)))
                out = pc.if_else(pc.is_null(lists), pa.scalar(None, pa.string()), pa.array(texts, pa.string()))
                yield pa.RecordBatch.from_arrays([*part.columns, out], [*part.schema.names, "decoded"])

    return encoded.mapInArrow(run, T.StructType([*encoded.schema.fields, T.StructField("decoded", T.StringType())]))



