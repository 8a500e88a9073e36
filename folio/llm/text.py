"""Words and bytes of Arrow text columns, for use inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Bytes of text that a task holds in its working arrays at once; one longer text stands alone.
CHUNK_BYTES = 4 << 20


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows with about `size` bytes of text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(lengths.astype(np.int64))
        start, base = 0, 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, base + size, side="right")))
            yield batch.slice(start, stop - start)
            start, base = stop, int(ends[stop - 1])


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words `[^\\x20\\x09-\\x0D]+` of each text (none for null): code of each word in order, number
    of words of each text, and the distinct words that the codes stand for."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.string()), ""))
    flat, offsets = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    full = pc.not_equal(pc.binary_length(flat), 0)
    ends = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False), dtype=np.int64)])
    coded = flat.filter(full).dictionary_encode()
    at = ends[offsets - offsets[0]]
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.diff(at), coded.dictionary


def hashes(values: pa.Array, seed: int = 0) -> np.ndarray:
    """XXH64 of each string."""
    digest = xxhash.xxh64_intdigest
    return np.array([digest(v, seed) for v in values.cast(pa.binary()).to_pylist()], dtype=np.uint64)


def flat_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts end to end (null: none), and the number of bytes of each."""
    whole = pc.fill_null(texts.cast(pa.binary()), b"")
    offsets = np.frombuffer(whole.buffers()[1], np.int32)[whole.offset : whole.offset + len(whole) + 1].astype(np.int64)
    data = whole.buffers()[2]
    flat = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return flat, np.diff(offsets)
