"""Line de-duplication with two Bloom filters: hashes seen once and hashes seen twice.

The hashes of each document's lines, added up within a task, are shuffled by their first bits. The
owner of a segment of the hash space passes its hashes through two filters, sized by what it got:
a hash that the first filter has goes to the second. Only hashes in the second are counted, and
those of enough documents are suspects. Lines whose hash is no suspect stay where they are; the others
are shuffled and counted exactly by their full key, and only keys with enough documents are then
dropped. Segments grow in number with the lines, not in size.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from folio.llm.storage import free_names, replaced, store
from folio.llm.text import chunks

SPACE = b" \t\n\x0b\x0c\r"
MIN_CHARS = 1
MIN_DOCS = 10
#: Filter bits for each hash, and probes of a hash.
BITS_PER_HASH = 16
PROBES = 2
#: Line hashes of a segment, about; hashes that a task adds up before it sends them on, and that a filter takes in one step.
SEGMENT_ROWS = 1 << 17
HELD_HASHES = 1 << 20
FILTER_STEP = 1 << 14
#: Suspects (8 bytes each) and keys to drop are sent to all tasks up to these bounds; beyond them they are joined.
BROADCAST_HASHES = 1 << 22
BROADCAST_BYTES = 8 << 20


def line_key(line: bytes) -> bytes:
    return line.strip(SPACE).lower()


def _keys(text: bytes | None, min_chars: int) -> list[bytes | None]:
    """The key of each line, None where it is too short to count."""
    keys = [line_key(x) for x in (text or b"").split(b"\n")]
    if min_chars <= 1:
        return [k or None for k in keys]
    return [k if len(k.decode("utf-8", "replace")) >= min_chars else None for k in keys]


def _probes(hashes: np.ndarray, bits: int) -> np.ndarray:
    step = (hashes >> np.uint64(32)) | np.uint64(1)
    return np.stack([(hashes + np.uint64(k) * step) & np.uint64(bits - 1) for k in range(PROBES)])


class TwoFilters:
    """Bit arrays of hashes seen in a document and in a further one. No hash that was seen in two documents
    is missing from the second; a hash in it may have been seen less often."""

    def __init__(self, bits: int):
        self.bits = bits
        self.once = np.zeros(bits // 8, np.uint8)
        self.twice = np.zeros(bits // 8, np.uint8)

    def add(self, hashes: np.ndarray, n: np.ndarray | None = None) -> None:
        """Hashes, and the number of documents of each (by default 1); a hash may come again."""
        found, at, times = np.unique(hashes, return_inverse=True, return_counts=True)
        most = np.ones(len(found), np.int64)
        if n is not None:
            np.maximum.at(most, at, n)
        again = (times > 1) | (most > 1) | has(self.once, found, self.bits)
        self._set(self.twice, found[again])
        self._set(self.once, found)

    def _set(self, where: np.ndarray, hashes: np.ndarray) -> None:
        for at in _probes(hashes, self.bits):
            np.bitwise_or.at(where, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))


def has(where: np.ndarray, hashes: np.ndarray, bits: int) -> np.ndarray:
    out = np.ones(len(hashes), bool)
    for at in _probes(hashes, bits):
        out &= (where[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return out


def filter_bits(hashes: int, bits_per_hash: int = BITS_PER_HASH) -> int:
    """A power of two from 1,024 on."""
    return 1 << max(10, (max(1, hashes * bits_per_hash) - 1).bit_length())


def _line_hashes(keys: list[bytes]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(k) for k in keys], np.uint64)


def suspected(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, bits_per_hash: int = BITS_PER_HASH, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """hash: those of line keys that are found in at least min_docs rows of docs, keys of one hash taken together."""
    breaks = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit("")))
    lines = docs.agg(F.count("*") + F.coalesce(F.sum(breaks), F.lit(0))).first()[0]
    segment_bits = max(0, (lines // segment_rows).bit_length())

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n_held = [], 0

        def added() -> pa.RecordBatch:
            found, n = np.unique(np.concatenate(held), return_counts=True)
            segment = (found >> np.uint64(64 - segment_bits)).astype(np.int64) if segment_bits else np.zeros(len(found), np.int64)
            return pa.RecordBatch.from_arrays([pa.array(segment), pa.array(found.view(np.int64)), pa.array(n)], ["segment", "hash", "n"])

        for batch in chunks(batches):
            held.append(_line_hashes([k for t in batch.column("text").to_pylist() for k in {*_keys(t, min_chars)} - {None}]))
            n_held += len(held[-1])
            if n_held >= HELD_HASHES:
                yield added()
                held, n_held = [], 0
        if n_held:
            yield added()

    def repeated(table: pa.Table) -> pa.Table:
        hashes, n = table.column("hash").to_numpy().view(np.uint64), table.column("n").to_numpy()
        filters = TwoFilters(filter_bits(len(hashes), bits_per_hash))
        for at in range(0, len(hashes), FILTER_STEP):
            filters.add(hashes[at : at + FILTER_STEP], n[at : at + FILTER_STEP])
        twice = has(filters.twice, hashes, filters.bits)
        found, at = np.unique(hashes[twice], return_inverse=True)
        total = np.zeros(len(found), np.int64)
        np.add.at(total, at, n[twice])
        return pa.table({"hash": found[total >= min_docs].view(np.int64)})

    rows = docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(collect, "segment long, hash long, n long")
    return rows.groupBy("segment").applyInArrow(repeated, "hash long")


def repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, bits_per_hash: int = BITS_PER_HASH, segment_rows: int = SEGMENT_ROWS, broadcast_hashes: int = BROADCAST_HASHES) -> DataFrame:
    """key (binary), n_docs, first_id (smallest doc_id, null if none has one) of the line keys
    found in at least min_docs rows of docs (at least 2)."""
    min_docs = max(2, min_docs)
    hashes = store(suspected(docs, min_chars, min_docs, bits_per_hash, segment_rows), "suspects")
    few = hashes.count() <= broadcast_hashes
    known = docs.sparkSession.sparkContext.broadcast(np.sort(hashes.toArrow().column("hash").to_numpy()) if few else None)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            counts: Counter[bytes] = Counter()
            first: dict[bytes, int | None] = {}
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                for k in {*_keys(text, min_chars)} - {None}:
                    counts[k] += 1
                    old = first.get(k)
                    first[k] = doc_id if old is None else old if doc_id is None else min(old, doc_id)
            keys = list(counts)
            own = _line_hashes(keys).view(np.int64)
            if known.value is not None:
                at = np.searchsorted(known.value, own)
                hit = np.flatnonzero(np.append(known.value, 0)[at] == own) if len(known.value) else np.zeros(0, np.int64)
                hit = hit[at[hit] < len(known.value)]
                own, keys = own[hit], [keys[k] for k in hit]
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(keys, pa.binary()), pa.array([counts[k] for k in keys], pa.int64()), pa.array([first[k] for k in keys], pa.int64())], ["hash", "key", "n", "first_id"])

    found = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")).mapInArrow(count, "hash long, key binary, n long, first_id long")
    if not few:
        found = found.join(hashes.hint("merge"), "hash", "left_semi")
    return found.groupBy("key").agg(F.sum("n").alias("n_docs"), F.min("first_id").alias("first_id")).where(F.col("n_docs") >= min_docs)


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, keep_first: bool = False, bits_per_hash: int = BITS_PER_HASH, segment_rows: int = SEGMENT_ROWS, broadcast_hashes: int = BROADCAST_HASHES, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """docs with `text` cut to its kept lines, plus n_lines (before) and n_dropped.

    A line's key is the line without ASCII white space at its ends, A-Z lower-cased. Keys of at least
    min_chars code points in at least min_docs rows lose all their lines; with keep_first the first
    line of the smallest doc_id that has the key stays. Each row of docs counts as a document, so
    repeated rows count again. Null or empty text is one empty line and comes back as "". A null
    doc_id is counted like any other and never first. Other columns pass through; columns
    named n_lines or n_dropped are replaced, and no other name clashes. An empty table gives an empty
    result. bits_per_hash, segment_rows and the two bounds of broadcasts change the plan, not the result.
    """
    docs = replaced(docs, ["n_lines", "n_dropped"])
    bad = store(repeated_lines(docs, min_chars, min_docs, bits_per_hash, segment_rows, broadcast_hashes), "repeated-lines")
    size = bad.agg(F.coalesce(F.sum(F.octet_length("key") + 64), F.lit(0))).first()[0]
    extra = [T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())]
    if size <= broadcast_bytes:
        keys = docs.sparkSession.sparkContext.broadcast({bytes(r.key): r.first_id for r in bad.select("key", "first_id").toLocalIterator()})
        return docs.mapInArrow(_dropping(min_chars, keep_first, keys), T.StructType([*docs.schema.fields, *extra]))
    return _joined(docs, bad, min_chars, keep_first, T.StructType([*docs.schema.fields, *extra]))


def _dropping(min_chars: int, keep_first: bool, keys=None, given: str = "", unused: tuple[str, ...] = ()):
    """Rows in, rows out without the columns `given` and `unused`; the keys to drop come from a broadcast or from the
    row's own column `given`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            texts, totals, dropped = [], [], []
            own = batch.column(given).to_pylist() if keys is None else [None] * batch.num_rows
            for doc_id, text, listed in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), own, strict=True):
                bad = keys.value if keys is not None else {bytes(x["key"]): x["first_id"] for x in listed or ()}
                raw = (text or "").encode("utf-8", "surrogatepass")
                lines, kept, saved = raw.split(b"\n"), [], set()
                for line, key in zip(lines, _keys(raw, min_chars), strict=True):
                    if key is not None and key in bad:
                        if not (keep_first and doc_id is not None and bad[key] == doc_id and key not in saved):
                            continue
                        saved.add(key)
                    kept.append(line)
                texts.append(b"\n".join(kept).decode("utf-8", "surrogatepass"))
                totals.append(len(lines))
                dropped.append(len(lines) - len(kept))
            columns = {n: batch.column(n) for n in batch.schema.names if n not in (given, *unused)} | {"text": pa.array(texts, pa.string())}
            columns |= {"n_lines": pa.array(totals, pa.int64()), "n_dropped": pa.array(dropped, pa.int64())}
            yield pa.RecordBatch.from_pydict(columns)

    return run


def _joined(docs: DataFrame, bad: DataFrame, min_chars: int, keep_first: bool, schema: T.StructType) -> DataFrame:
    """The same without a broadcast: each row's lines are joined with the keys to drop. Rows are
    told apart by doc_id and two hashes of the text; equal rows lose the same lines."""
    a, b, given = free_names(docs.columns, "_a", "_b", "_bad")
    marked = docs.withColumns({a: F.xxhash64("doc_id", "text"), b: F.xxhash64(F.lit(7), "text", "doc_id")})

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            rows = [(x, y, k) for x, y, t in zip(*(batch.column(n).to_pylist() for n in (a, b, "text")), strict=True) for k in {*_keys(t, min_chars)} - {None}]
            x, y, k = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64()), pa.array(k, pa.binary())], [a, b, "key"])

    lines = marked.select(a, b, F.col("text").cast("binary").alias("text")).mapInArrow(split, f"`{a}` long, `{b}` long, key binary")
    per_row = lines.join(bad, "key").groupBy(a, b).agg(F.collect_set(F.struct("key", "first_id")).alias(given))
    return marked.join(per_row, [a, b], "left").mapInArrow(_dropping(min_chars, keep_first, given=given, unused=(a, b)), schema)
