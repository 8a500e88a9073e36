"""Alignment of two tokenizers: which ids stand for the same bytes, how often, and how well each document agrees.

Every text, with a blank before it, is encoded by a byte-level BPE (side A) and a SentencePiece model (side B). Byte offsets where tokens of
both sides end cut them into groups; tokens with common bytes are linked. Texts are taken in runs of a bounded size. A run's links are added
up to one row for each pair of ids, and go to the stripe of their B id: a task owns a stripe, adds all runs' counts into a dense
block (B ids of the stripe by A ids), and takes row maxima. Counts then meet the runs' pairs stripe by stripe, each stripe cut
into slices of a bounded number of pairs, and what a pair scores goes back to its run, where documents sum it up.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.taskcontext import TaskContext

from folio.llm.bytepairs import BytePairs, Encoder, Store, load_merges, segments
from folio.llm.storage import replaced, store
from folio.llm.text import chunks

SIDE_A = "/opt/tokenizers/byte_bpe_50k.json"
SIDE_B = "/opt/tokenizers/piece_bpe_32k.model"
MARKER = "▁"
#: Bytes of a stripe's dense block of counts.
STRIPE_BYTES = 64 << 20
#: Text of a run (one longer text is a run by itself) and of a step in it; distinct segments that a run may hold.
RUN_BYTES, STEP_BYTES, RUN_SEGMENTS = 16 << 20, 2 << 20, 1 << 18
#: Pairs of a stripe that are scored in one task, about.
SLICE_PAIRS = 1 << 21
#: Runs, and slices of stripes, that share a task where there are many of them.
GROUPS_A_TASK = 4
MEASURES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


@dataclass
class PieceSide:
    """A SentencePiece model as bytes, with the bytes of each piece (marker as blank)."""

    proto: bytes
    surface: list[bytes]
    blank: int  # the piece of one blank
    alone: bool  # no piece goes on over a blank behind another character

    def __post_init__(self) -> None:
        self.lengths = np.array([len(x) for x in self.surface], np.int64)
        self.model = None

    def __getstate__(self) -> dict:
        return {**self.__dict__, "model": None}

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts that begin with a blank, which the model adds itself, end to end, and how many each has."""
        if self.model is None:
            import sentencepiece

            self.model = sentencepiece.SentencePieceProcessor(model_proto=self.proto)
        ids = [x or [self.blank] for x in self.model.encode([t[1:] for t in texts], num_threads=1)] if texts else []
        n = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter((k for x in ids for k in x), np.int64, int(n.sum())), n


def load_side(path: str = SIDE_B) -> PieceSide:
    import sentencepiece

    with open(path, "rb") as f:
        proto = f.read()
    model = sentencepiece.SentencePieceProcessor(model_proto=proto)
    surface, alone = [], True
    for k in range(model.get_piece_size()):
        piece = model.id_to_piece(k)
        if model.is_byte(k):
            surface.append(bytes([int(piece[1:-1], 16)]))
        elif model.is_control(k) or model.is_unknown(k) or model.is_unused(k):
            surface.append(b"")
        else:
            surface.append(piece.replace(MARKER, " ").encode())
            alone &= MARKER not in piece.lstrip(MARKER)
    return PieceSide(proto, surface, model.piece_to_id(MARKER), alone)


class Aligner:
    """Aligns texts in a task. Neither side has a token over a blank behind a character that is no white space, so texts are cut there, and
    each distinct segment is encoded and aligned once."""

    def __init__(self, a: BytePairs, b: PieceSide):
        self.a, self.b = a, b
        self.encoder = Encoder(a)
        self.clear()

    def clear(self) -> None:
        self.store = Store(self._align, bounded=False)
        self.text: list[str] = []
        self.measures = np.zeros((5, 0), np.int64)

    def _align(self, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Links of each segment, as a number for each: B id * number of A ids + A id. Text and measures (n_a, n_b, n_groups, n_links, and
        whether B has other bytes) of the segments are added to those of the task."""
        raw = [k.encode() for k in keys]
        a_ids, n_a = self.encoder.segment_ids(keys)
        b_ids, n_b = self.b.encode(keys)
        surface, ends = self.b.surface, np.cumsum(n_b)
        listed = b_ids.tolist()
        joined = [b"".join([surface[i] for i in listed[lo:hi]]) for lo, hi in zip((ends - n_b).tolist(), ends.tolist(), strict=True)]
        bad = np.fromiter((x != y for x, y in zip(joined, raw, strict=True)), bool, len(raw))
        a_ids, b_ids = a_ids[~np.repeat(bad, n_a)], b_ids[~np.repeat(bad, n_b)]
        n_a, n_b = np.where(bad, 0, n_a), np.where(bad, 0, n_b)
        size = np.where(bad, 0, np.fromiter(map(len, raw), np.int64, len(raw)))
        end_a, end_b = np.cumsum(self.a.lengths[a_ids]), np.cumsum(self.b.lengths[b_ids])
        stops = np.cumsum(size)
        cuts = np.union1d(end_a, end_b)
        at_a, at_b = np.searchsorted(end_a, cuts), np.searchsorted(end_b, cuts)
        both = cuts[(end_a[at_a] == cuts) & (end_b[at_b] == cuts)] if len(cuts) else cuts
        n_links = np.diff(np.searchsorted(cuts, stops, side="right"), prepend=0)
        n_groups = np.diff(np.searchsorted(both, stops, side="right"), prepend=0)
        self.measures = np.concatenate([self.measures, np.stack([n_a, n_b, n_groups, n_links, bad.astype(np.int64)])], axis=1)
        self.text += self._group_texts(a_ids, b_ids, end_a, end_b, both, n_a + n_b)
        return b_ids[at_b] * len(self.a.surface) + a_ids[at_a], n_links

    def _group_texts(self, a_ids, b_ids, end_a, end_b, both, n) -> list[str]:
        """Each segment's groups as `a1,a2|b1;`, end to end."""
        group = np.concatenate([np.searchsorted(both, end_a), np.searchsorted(both, end_b)])
        side = np.repeat([0, 1], [len(a_ids), len(b_ids)])
        order = np.lexsort((side, group))  # both sides are in order already, and the sort is stable
        ids, key = np.concatenate([a_ids, b_ids])[order], (group * 2 + side)[order]
        last = np.append(key[1:] != key[:-1], True) if len(key) else np.zeros(0, bool)
        sign = pa.array([",", "|", ";"]).take(pa.array(np.where(last, 1 + key % 2, 0)))
        words = pc.binary_join_element_wise(pa.array(ids).cast(pa.string()), sign, "")
        offsets = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
        return pc.binary_join(pa.ListArray.from_arrays(offsets, words), "").to_pylist()

    def codes(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Codes of all texts' segments in order, and how many each text has (null and empty: none)."""
        whole = texts.cast(pa.string())
        spaced = pc.if_else(pc.equal(pc.binary_length(whole), 0), pa.scalar(None, pa.string()), pc.binary_join_element_wise("", whole, " "))
        if self.b.alone:
            keys, codes, n = segments(spaced)
        else:
            keys = [t for t in spaced.to_pylist() if t is not None]
            codes, n = np.arange(len(keys)), pc.is_valid(spaced).to_numpy(zero_copy_only=False).astype(np.int64)
        return self.store.codes(keys)[codes], n


def _lists(values: np.ndarray, counts: np.ndarray, kind=np.int32) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(values.astype(kind)))


def _flat(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return lists.flatten().to_numpy(zero_copy_only=False)


_DOC, _PAIRS, _SEGMENTS = 0, 1, 2
_CODED = "run long, kind int, stripe int, xs array<int>, ys array<int>, ns array<int>, groups string, n_a long, n_b long, n_groups long, n_links long"


def coded_runs(docs: DataFrame, a: BytePairs, b: PieceSide, stripes: int) -> DataFrame:
    """Every document, and what each run of documents holds. Rows of kind 0 are documents: `row` (their columns), groups, measures, and
    codes (xs) and counts (ys) of their distinct segments. Rows of kind 1 are the pairs of one run and stripe: A ids (xs), B ids (ys)
    and how many links of the run have each (ns). A row of kind 2 lists codes of a run's segments (xs), how many links each has (ys), and
    of each link the place of its pair in the run (ns; pairs of all stripes end to end)."""
    others = [c for c in docs.columns if c.lower() != "text"]
    shaped = docs.select(F.struct(*([F.col(f"`{c}`") for c in others] or [F.lit(0)])).alias("row"), F.col("text").cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast((a, b))
    fields = [*T._parse_datatype_string(_CODED).fields, T.StructField("row", shaped.schema["row"].dataType)]
    arrow = {f.name: t for f, t in zip(fields, _arrow_types(fields), strict=True)}
    width = len(a.surface)

    def batch_of(n: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns[name].cast(t) if name in columns else pa.nulls(n, t) for name, t in arrow.items()], list(arrow))

    def documents(part: pa.RecordBatch, aligner: Aligner, run: int, total: list[np.ndarray]) -> pa.RecordBatch:
        code, n = aligner.codes(part.column("text"))
        owner = np.repeat(np.arange(part.num_rows), n)
        add = lambda weights: np.bincount(owner, weights=weights, minlength=part.num_rows).astype(np.int64)
        wrong = add(aligner.measures[4][code]) > 0
        keep = ~wrong[owner]
        code, owner = code[keep], owner[keep]
        n = np.where(wrong, 0, n)
        cuts, listed, text = np.cumsum(n), code.tolist(), aligner.text
        groups = ["".join([text[c] for c in listed[lo:hi]])[:-1] for lo, hi in zip((cuts - n).tolist(), cuts.tolist(), strict=True)]
        span = max(len(aligner.text), 1)
        distinct, times = np.unique(owner * span + code, return_counts=True)
        total.append(np.bincount(code, minlength=span))
        per_doc = np.bincount(distinct // span, minlength=part.num_rows)
        measures = {k: pa.array(add(aligner.measures[j][code])) for j, k in enumerate(MEASURES[:4])}
        fixed = {"run": pa.array(np.full(part.num_rows, run)), "kind": pa.array(np.full(part.num_rows, _DOC))}
        return batch_of(part.num_rows, **fixed, **measures, xs=_lists(distinct % span, per_doc), ys=_lists(times, per_doc), groups=pa.array(groups, pa.string()), row=part.column("row"))

    def closing(aligner: Aligner, run: int, total: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        times = np.zeros(len(aligner.text), np.int64)
        for t in total:
            times[: len(t)] += t[: len(times)]
        used = np.flatnonzero(times)
        links, n = aligner.store.lists(used)
        pairs, at = np.unique(links, return_inverse=True)
        counts = np.zeros(len(pairs), np.int64)
        np.add.at(counts, at, np.repeat(times[used], n))
        b_ids, a_ids = pairs // width, pairs % width
        order = np.argsort(b_ids % stripes, kind="stable")
        place = np.empty(len(pairs), np.int64)
        place[order] = np.arange(len(pairs))
        found, sizes = np.unique(b_ids[order] % stripes, return_counts=True)
        fixed = lambda k, kind: {"run": pa.array(np.full(k, run)), "kind": pa.array(np.full(k, kind))}
        yield batch_of(len(found), **fixed(len(found), _PAIRS), stripe=pa.array(found), xs=_lists(a_ids[order], sizes), ys=_lists(b_ids[order], sizes), ns=_lists(counts[order], sizes))
        one = lambda values: _lists(values, np.array([len(values)]))
        yield batch_of(1, **fixed(1, _SEGMENTS), xs=one(used), ys=one(n), ns=one(place[at]))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, number, size, total = Aligner(*shared.value), 0, 0, []
        first = TaskContext.get().partitionId() << 32
        for part in chunks(batches, size=STEP_BYTES):
            bytes_ = pc.sum(pc.binary_length(part.column("text"))).as_py() or 0
            if total and (size + bytes_ > RUN_BYTES or len(aligner.text) > RUN_SEGMENTS):
                yield from closing(aligner, first + number, total)
                number, size, total = number + 1, 0, []
                if len(aligner.text) > RUN_SEGMENTS:
                    aligner.clear()
            yield documents(part, aligner, first + number, total)
            size += bytes_
        if total:
            yield from closing(aligner, first + number, total)

    return shaped.mapInArrow(code, T.StructType(fields))


def _arrow_types(fields: list[T.StructField]) -> list[pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_schema

    return list(to_arrow_schema(T.StructType(fields), prefers_large_types=False).types)


def striped_counts(pairs: DataFrame, width: int, height: int, stripes: int) -> DataFrame:
    """stripe, b, best, xs, ns: of each B id that has links, the A ids (xs), how many links of the corpus hold each pair (ns), and the highest of them.
    pairs: rows of kind 1. A task owns a stripe and holds its dense block alone, whatever the number of rows."""
    rows = -(-height // stripes)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, np.ndarray] = {}
        for batch in batches:
            sizes = pc.list_value_length(batch.column("xs")).to_numpy(zero_copy_only=False)
            stripe = np.repeat(batch.column("stripe").to_numpy(zero_copy_only=False), sizes)
            at = (_flat(batch.column("ys")).astype(np.int64) // stripes) * width + _flat(batch.column("xs"))
            n = _flat(batch.column("ns")).astype(np.int64)
            for k in np.unique(stripe).tolist():
                if k not in blocks:
                    blocks[k] = np.zeros(rows * width, np.int64)
                np.add.at(blocks[k], at[stripe == k], n[stripe == k])
        for k, block in blocks.items():
            square = block.reshape(rows, width)
            row, col = np.nonzero(square)
            held, sizes = np.unique(row, return_counts=True)
            best = square.max(axis=1)[held]
            columns = [pa.array(np.full(len(held), k, np.int32)), pa.array((held * stripes + k).astype(np.int32)), pa.array(best), _lists(col, sizes), _lists(square[row, col], sizes, np.int64)]
            yield pa.RecordBatch.from_arrays(columns, ["stripe", "b", "best", "xs", "ns"])

    mine = pairs.select("stripe", "xs", "ys", "ns").repartitionById(stripes, F.col("stripe"))
    return mine.mapInArrow(count, "stripe int, b int, best long, xs array<int>, ns array<long>")


def _spread(df: DataFrame, groups: int, *keys: str) -> DataFrame:
    """df dealt by its keys to as many tasks as there are GROUPS_A_TASK groups, where those are more than Spark would use."""
    tasks = groups // GROUPS_A_TASK
    return df.repartition(tasks, *keys) if tasks > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def _scores(pairs: DataFrame, counts: DataFrame, width: int, height: int, stripes: int, slice_pairs: int) -> DataFrame:
    """run, stripe, ns, best: in the order of the run's pairs in a stripe, corpus-wide counts and whether they are their B id's highest."""
    rows = -(-height // stripes)
    sizes = {r.stripe: r.n for r in pairs.groupBy("stripe").agg(F.sum(F.size("xs")).alias("n")).collect()}  # a row for each stripe at most
    n_slices = F.element_at(F.array(*[F.lit(max(1, -(-sizes.get(k, 0) // slice_pairs))) for k in range(stripes)]), F.col("stripe") + 1)
    asked = pairs.select("run", "stripe", "xs", "ys", F.pmod(F.xxhash64("run"), n_slices).cast("int").alias("slice"))
    known = counts.withColumn("slice", F.explode(F.sequence(F.lit(0), n_slices - 1)))

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        block, best = np.zeros(rows * width, np.int64), np.zeros(rows, np.int64)
        own = right.column("b").to_numpy() // stripes
        sizes = pc.list_value_length(right.column("xs")).to_numpy()
        block[np.repeat(own, sizes).astype(np.int64) * width + _flat(right.column("xs"))] = _flat(right.column("ns"))
        best[own] = right.column("best").to_numpy()
        row = _flat(left.column("ys")).astype(np.int64) // stripes
        n = block[row * width + _flat(left.column("xs"))]
        sizes = pc.list_value_length(left.column("xs")).to_numpy()
        return pa.table({"run": left.column("run"), "stripe": left.column("stripe"), "ns": _lists(n, sizes, np.int64), "best": _lists(n == best[row], sizes, bool)})

    keys = ("stripe", "slice")
    groups = sum(max(1, -(-n // slice_pairs)) for n in sizes.values())
    asked, known = _spread(asked, groups, *keys), _spread(known, groups, *keys)
    return asked.groupBy(*keys).cogroup(known.groupBy(*keys)).applyInArrow(score, "run long, stripe int, ns array<long>, best array<boolean>")


def align(docs: DataFrame, a: BytePairs | None = None, b: PieceSide | None = None, digests: dict[str, Column] | None = None, stripe_bytes: int = STRIPE_BYTES, slice_pairs: int = SLICE_PAIRS) -> DataFrame:
    """docs without text, with n_a, n_b, n_groups, n_links, n_best, count_sum (long), and groups (`a1,a2|b1;a3|b2,b3`: A and B ids of each group in order).

    n_links counts pairs of an A and a B token with common bytes, count_sum sums over them how many links of all docs have the same two
    ids, and n_best counts those of which that number is the highest of their B id, ties included. Null and empty texts, and texts that a side does
    not give back byte by byte (a marker character in a text, for instance), have no tokens: all measures 0, groups ''. Special
    tokens in texts are plain text. Each row counts as a document, so repeated rows count again. An empty table gives an empty
    result. Other columns pass through; columns called like a new one are replaced. digests: columns made from `groups` and the first four measures, which
    are stored in its place (groups are about 2.4 times as long as the texts). stripe_bytes and slice_pairs change the plan, not the result.
    """
    a, b = a or load_merges(SIDE_A), b or load_side()
    digests = digests or {"groups": F.col("groups")}
    docs = replaced(docs, [*MEASURES, *digests])
    width, height = len(a.surface), len(b.surface)
    stripes = max(1, -(-8 * width * height // stripe_bytes))
    coded = coded_runs(docs, a, b, stripes)
    own = [F.when(F.col("kind") == _DOC, v).alias(f"digest_{k}") for k, (_, v) in enumerate(digests.items())]
    kept = store(coded.select("run", "kind", "stripe", "xs", "ys", "ns", *MEASURES[:4], "row", *own), "coded-runs")
    pairs = kept.where(F.col("kind") == _PAIRS)
    scores = _scores(pairs, striped_counts(pairs, width, height, stripes), width, height, stripes, slice_pairs)
    names = [f"digest_{k}" for k in range(len(digests))]
    rest = kept.where(F.col("kind") != _PAIRS).select("run", "kind", "xs", "ys", "ns", "row", *MEASURES[:4], *names)
    out = ["row", *MEASURES[:4], *names]

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        is_doc = pc.equal(left.column("kind"), _DOC)
        mine, lists = left.filter(is_doc), left.filter(pc.invert(is_doc))
        right = right.sort_by("stripe")
        value = np.stack([_flat(right.column("best")).astype(np.int64), _flat(right.column("ns")).astype(np.int64)])
        code, n, place = (_flat(lists.column(k)).astype(np.int64) for k in ("xs", "ys", "ns"))
        ends = np.cumsum(n)
        running = np.concatenate([np.zeros((2, 1), np.int64), np.cumsum(value[:, place], axis=1)], axis=1)
        of_code = np.zeros((2, int(code.max(initial=-1)) + 1), np.int64)
        of_code[:, code] = running[:, ends] - running[:, ends - n]
        sizes = pc.list_value_length(mine.column("xs")).to_numpy()
        parts = of_code[:, _flat(mine.column("xs"))] * _flat(mine.column("ys"))
        ends = np.cumsum(sizes)
        running = np.concatenate([np.zeros((2, 1), np.int64), np.cumsum(parts, axis=1)], axis=1)
        sums = running[:, ends] - running[:, ends - sizes]
        return mine.select(out).append_column("n_best", pa.array(sums[0])).append_column("count_sum", pa.array(sums[1]))

    schema = T.StructType([rest.schema[k] for k in out] + [T.StructField(k, T.LongType()) for k in MEASURES[4:]])
    runs = kept.where(F.col("kind") == _SEGMENTS).count()
    rest, scores = _spread(rest, runs, "run"), _spread(scores, runs, "run")
    joined = rest.groupBy("run").cogroup(scores.groupBy("run")).applyInArrow(finish, schema)
    fields = [F.col("row")[f.name].alias(f.name) for f in rest.schema["row"].dataType.fields]
    return joined.select(*fields, *MEASURES, *[F.col(n).alias(k) for n, k in zip(names, digests, strict=True)])


def pair_counts(docs: DataFrame, a: BytePairs | None = None, b: PieceSide | None = None, stripe_bytes: int = STRIPE_BYTES) -> DataFrame:
    """a, b (ids), n (links of all docs that hold them) and is_best (no other A id has more links with that B id); nulls, ties and so on as in `align`."""
    a, b = a or load_merges(SIDE_A), b or load_side()
    width, height = len(a.surface), len(b.surface)
    stripes = max(1, -(-8 * width * height // stripe_bytes))
    pairs = coded_runs(docs.select("text"), a, b, stripes).where(F.col("kind") == _PAIRS)
    rows = striped_counts(pairs, width, height, stripes).select("b", "best", F.explode(F.arrays_zip(F.col("xs").alias("a"), F.col("ns").alias("n"))).alias("pair"))
    return rows.select(F.col("pair.a").alias("a"), "b", F.col("pair.n").alias("n"), (F.col("pair.n") == F.col("best")).alias("is_best"))
