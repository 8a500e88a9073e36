"""SimHash near-duplicates through vantage-point trees.

Fingerprints have 64 bits and link at `radius` (4) or fewer differing bits. The bits are cut into
three blocks; two fingerprints within 5 bits differ by at most 1 bit in one block, so each
block gets a vantage-point tree over the Hamming metric of its own bits, searched with radius 1.
A tree is fitted on a bounded sample; every distinct fingerprint is then routed down it: to its
home shard, and to each later shard whose distance bounds its radius-1 ball overlaps (the triangle
inequality prunes all others). Shards are compared in their tasks, pairs are verified on all
64 bits, and only the edges of a spanning forest of each shard leave the task. A shard that the
sample shows to be larger than `grid_rows` (many fingerprints with equal bits in a block) is
dealt over a grid of tasks in which each two parts meet once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from folio.llm.components import connected_components
from folio.llm.storage import free_names, store
from folio.llm.text import chunks

RADIUS = 4
SEED = 42
SHINGLE_WORDS = 4
#: First bit and number of bits of each block.
BLOCKS = ((0, 22), (22, 21), (43, 21))
BLOCK_RADIUS = RADIUS // len(BLOCKS)
#: Fingerprints that a tree is fitted on at most (and of an eighth of all); those that a shard should hold, and those at which it
#: is dealt over a grid.
SAMPLE_ROWS = 1 << 16
SHARD_ROWS = 1 << 13
GRID_ROWS = 1 << 17
#: Pairs compared in one step of a task.
STEP = 1 << 20


def fingerprint(text: bytes | None, shingle: int = SHINGLE_WORDS) -> int:
    """64-bit SimHash of whole text: A-Z lower-cased, words between ASCII white space, repeated
    shingles counted each time; without words it is zero."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths).tolist()
    n = max(1, len(words) - shingle + 1)
    stops = ends[min(shingle, len(words)) - 1 :].tolist()
    digest, view = xxhash.xxh64_intdigest, memoryview(joined)
    total, counts = n, np.zeros(64, np.int64)
    for at in range(0, n, STEP >> 4):
        part = [digest(view[a:b], SEED) for a, b in zip(starts[at : at + (STEP >> 4)], stops[at : at + (STEP >> 4)], strict=False)]
        bits = np.unpackbits(np.array(part, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(0, dtype=np.int64)
    set_bits = np.packbits(2 * counts > total, bitorder="little")
    return int(set_bits.view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, fp): one row for each document, fp as a signed long. Null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            found = np.array([fingerprint(t, shingle) for t in batch.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, fp long")


class VantageTree:
    """A vantage-point tree over some bits of a fingerprint. `nodes` holds (vantage, median
    distance, inner child, outer child) for inner nodes and (leaf number,) for leaves."""

    def __init__(self, sample: np.ndarray, first: int, bits: int, leaf: int, rows: int, grid_rows: int):
        self.first, self.mask = np.uint64(first), np.uint64((1 << bits) - 1)
        self.nodes: list[tuple] = []
        self.grid: list[int] = []
        values = self.values(sample)
        per = rows / max(1, len(values))
        rng = np.random.default_rng(first + 1)
        todo = [(values, self._new())]
        while todo:
            own, at = todo.pop()
            split = self._split(own, rng) if len(own) > leaf else None
            if split is None:
                self.nodes[at] = (len(self.grid),)
                self.grid.append(max(1, math.ceil(len(own) * per / grid_rows)))
                continue
            vantage, median, near = split
            inner, outer = self._new(), self._new()
            self.nodes[at] = (vantage, median, inner, outer)
            todo += [(own[near], inner), (own[~near], outer)]

    def _new(self) -> int:
        self.nodes.append(())
        return len(self.nodes) - 1

    @staticmethod
    def _split(own: np.ndarray, rng) -> tuple | None:
        """Of a few vantage points, the one whose median distance parts the values most evenly and
        leaves least on its boundary; None when all values are equal."""
        best = None
        for vantage in rng.choice(own, 6):
            distance = np.bitwise_count(own ^ vantage)
            median = int(np.median(distance))
            for cut in (median - 1, median):
                near = distance <= cut
                share = near.mean()
                if 0 < share < 1:
                    cost = abs(share - 0.5) + ((distance == cut) | (distance == cut + 1)).mean()
                    if best is None or cost < best[0]:
                        best = (cost, vantage, cut, near)
        return best and best[1:]

    def values(self, fps: np.ndarray) -> np.ndarray:
        return (fps >> self.first) & self.mask

    def homes(self, values: np.ndarray) -> np.ndarray:
        out = np.zeros(len(values), np.int64)
        for leaf, idx in self._walk(values, np.arange(len(values)), 0):
            out[idx] = leaf
        return out

    def visits(self, values: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
        """Leaves and the rows whose ball of that radius reaches into them."""
        return self._walk(values, np.arange(len(values)), radius)

    def _walk(self, values: np.ndarray, idx: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
        todo = [(0, idx)]
        while todo:
            at, idx = todo.pop()
            if not len(idx):
                continue
            node = self.nodes[at]
            if len(node) == 1:
                yield node[0], idx
                continue
            vantage, median, inner, outer = node
            distance = np.bitwise_count(values[idx] ^ vantage).astype(np.int64)
            todo += [(inner, idx[distance - radius <= median]), (outer, idx[distance + radius > median])]


def routed(tree: VantageTree, fps: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(leaf, i, j, row): the tasks in which each fingerprint takes part. A row is at home in one
    leaf and visits those leaves of a greater number that its ball reaches, so two near rows meet in
    exactly one leaf. A leaf on a grid of g parts compares parts i and j in task (i, j)."""
    values = tree.values(fps)
    home = tree.homes(values)
    part = (fps * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
    for leaf, idx in tree.visits(values, BLOCK_RADIUS):
        idx = idx[home[idx] <= leaf]
        g = tree.grid[leaf]
        own = (part[idx] % np.uint64(g)).astype(np.int64)
        at_home = home[idx] == leaf
        for other in range(g):
            same = np.full(len(idx), other)
            i = np.where(at_home, np.minimum(own, other), same)
            j = np.where(at_home, np.maximum(own, other), same)
            yield np.full(len(idx), leaf), i, j, idx


def shard_edges(fps: np.ndarray, first: int, bits: int, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Edges (fingerprint, smaller fingerprint) that connect all rows of a shard which link directly
    or through rows of the shard, found among pairs with at most 1 differing bit in the block."""
    fps = np.unique(fps)
    value = (fps >> np.uint64(first)) & np.uint64((1 << bits) - 1)
    order = np.argsort(value, kind="stable")
    fps, value = fps[order], value[order]
    runs, start, size = np.unique(value, return_index=True, return_counts=True)
    label = np.arange(len(fps))
    pairs = []
    for mask in [0] + [1 << k for k in range(bits)]:
        to = np.searchsorted(runs, runs ^ np.uint64(mask))
        ok = (to < len(runs)) & (to >= np.arange(len(runs)))
        ok[ok] = runs[to[ok]] == (runs ^ np.uint64(mask))[ok]
        a, b = np.flatnonzero(ok), to[ok]
        if mask == 0:
            a, b = a[size[a] > 1], b[size[b] > 1]
        pairs.append(np.stack([a, b]))
    a, b = np.concatenate(pairs, axis=1)
    work = size[a] * size[b]
    large = work > STEP
    for x, y in zip(a[large], b[large], strict=True):
        label = _link_large(fps, label, (start[x], size[x]), (start[y], size[y]), radius)
    a, b, work = a[~large], b[~large], work[~large]
    cuts = [*np.searchsorted(np.cumsum(work), np.arange(0, work.sum(), STEP), side="left"), len(work)]
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        n = work[lo:hi]
        if not n.sum():
            continue
        k = np.repeat(np.arange(lo, hi), n)
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        i, j = start[a[k]] + at // size[b[k]], start[b[k]] + at % size[b[k]]
        near = (np.bitwise_count(fps[i] ^ fps[j]) <= radius) & (i != j)
        label = _joined(label, i[near], j[near])
    root = _least(fps, label)
    moved = root != fps
    return fps[moved], root[moved]


def _link_large(fps, label, one, two, radius, block: int = 1024) -> np.ndarray:
    """Two long runs, block by block. Rows within the radius of the first row of a block are joined
    through it; blocks that are already in one component are not compared."""
    a = np.arange(one[0], one[0] + one[1])
    b = np.arange(two[0], two[0] + two[1])
    for run in (a, b):
        near = run[np.bitwise_count(fps[run] ^ fps[run[0]]) <= radius]
        label = _joined(label, near, np.full(len(near), run[0]))
    for p in range(0, len(a), block):
        for q in range(0, len(b), block):
            x, y = a[p : p + block], b[q : q + block]
            if (label[x] == label[x[0]]).all() and (label[y] == label[x[0]]).all():
                continue
            i, j = np.nonzero(np.bitwise_count(fps[x][:, None] ^ fps[y][None, :]) <= radius)
            apart = label[x[i]] != label[y[j]]
            label = _joined(label, x[i[apart]], y[j[apart]])
    return label


def _joined(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels (each the number of a row in the same component) after joining rows i and j."""
    while len(i):
        x, y = label[i], label[j]
        apart = x != y
        if not apart.any():
            break
        i, j, x, y = i[apart], j[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
    return label


def _least(fps: np.ndarray, label: np.ndarray) -> np.ndarray:
    """The smallest fingerprint (as a signed number) of each row's component."""
    signed = fps.view(np.int64)
    least = np.full(len(fps), np.iinfo(np.int64).max)
    np.minimum.at(least, label, signed)
    return least[label].view(np.uint64)


def near_edges(distinct: DataFrame, rows: int, sample_rows: int = SAMPLE_ROWS, shard_rows: int = SHARD_ROWS, grid_rows: int = GRID_ROWS) -> DataFrame:
    """(a, b) edges between fingerprints of `distinct` (column fp) that give the same components
    as all pairs within the radius. The sample is the rows of least hash: an eighth, `sample_rows` at most."""
    sample = distinct.orderBy(F.xxhash64("fp"), "fp").limit(min(sample_rows, max(256, rows // 8))).select("fp").toArrow().column(0).to_numpy().astype(np.int64).view(np.uint64)
    leaf = max(8, math.ceil(len(sample) * shard_rows / max(rows, 1) / 2))
    trees = [VantageTree(sample, first, bits, leaf, rows, grid_rows) for first, bits in BLOCKS]
    schema = "block int, leaf long, i long, j long, fp long"

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column("fp").to_numpy().view(np.uint64)
            for block, tree in enumerate(trees):
                for leaf_, i, j, idx in routed(tree, fps):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(idx), block, np.int32)), pa.array(leaf_), pa.array(i), pa.array(j), pa.array(fps[idx].view(np.int64))],
                        ["block", "leaf", "i", "j", "fp"],
                    )

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        a, b = shard_edges(table.column("fp").to_numpy().view(np.uint64), *BLOCKS[key[0].as_py()])
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    return distinct.select("fp").mapInArrow(route, schema).groupBy("block", "leaf", "i", "j").applyInArrow(compare, "a long, b long")


def simhash_groups(docs: DataFrame, shingle: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: the smallest doc_id reachable over links.

    Null or empty text has fingerprint zero and links like any other. Equal fingerprints are one
    class from the start, so copies cost one row each and no pair. Rows of one doc_id each give
    a row. A null doc_id is returned and linked, but never names a component unless no other row
    of it has an id. Other columns of docs are ignored. An empty table gives an empty result.
    """
    prints = store(fingerprints(docs, shingle), "fingerprints")
    distinct = store(prints.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "distinct-fingerprints")
    labels = connected_components(near_edges(distinct, distinct.count()), "a", "b")
    named = distinct.join(labels, distinct.fp == labels.node, "left").select("fp", "least_id", F.coalesce("component", "fp").alias("component"))
    least = named.groupBy("component").agg(F.min("least_id").alias("component_id"))
    classes = named.join(least, "component").select("fp", "component_id")
    return prints.join(classes, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each_group(docs: DataFrame, shingle: int = SHINGLE_WORDS) -> DataFrame:
    """The documents whose doc_id is their component_id, with the columns of docs.

    Of rows that repeat this doc_id, one stays: the first by text, then by its other columns. In a
    component without any id nothing tells its rows apart, so all of them stay. Links and
    components come from `simhash_groups`, which see for null, empty and long texts."""
    kept_id, row = free_names(docs.columns, "_kept", "_row")
    groups = store(simhash_groups(docs, shingle), "simhash-groups")
    ids = groups.where("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("n"))
    ids = store(ids.select(F.col("doc_id").alias(kept_id), "n"), "simhash-kept")
    single, several = (ids.where(c).select(kept_id).hint("merge") for c in ("n = 1", "n > 1"))
    # The ids grow with the documents, so they are never broadcast: each text is shuffled once, at every size.
    out = docs.join(single, F.col("doc_id") == F.col(kept_id), "left_semi")
    if ids.where("n > 1").limit(1).count():
        rows = docs.join(several, F.col("doc_id") == F.col(kept_id), "left_semi")
        whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
        first = rows.groupBy("doc_id").agg(F.min_by(whole, F.struct("text", F.to_json(whole))).alias(row))
        out = out.unionByName(first.select(f"{row}.*"))
    if groups.where("component_id is null").limit(1).count():
        out = out.unionByName(docs.where("doc_id is null"))
    return out
