"""Embedding near-duplicates by sorted projection passes.

In each label, whatever its size, each pass orders the vectors by the concatenated sign bits of random hyperplanes and
compares every vector with the next `window` ones. Only codes, ids and a short sketch (more sign bits) are
sorted; the sketch rules out pairs that cannot link, and vectors are fetched only for rows that still
have a candidate in another component. How often a pair at the threshold meets depends on how the
label's vectors lie, so it is measured: a bounded sample of each label gets planted partners at the threshold,
and passes go on until the share of those that met reaches `recall`. Labels that do not reach it in `most_passes` are compared in full,
part against part: the exact way for them.

Links verified in double precision are joined; then each component is compared in full, so a group larger than
a window has all its links counted. What can be missed is a pair that no pass
brings together and no chain of links connects.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from folio.llm.components import connected_components
from folio.llm.simhash import _joined
from folio.llm.storage import store

COSINE = 0.93
WINDOW = 32
RECALL = 0.99
SEED = 6
#: Bits that a pass is ordered by, and bits of a sketch (a multiple of 64); a sketch lets a pair at the threshold pass up to this
#: many standard deviations of its differing bits.
BITS = 62
SKETCH_BITS = 256
SKETCH_DEVIATIONS = 5
#: Rows of a window task.
BLOCK_ROWS = 1_024
#: A label or component of more members than SPLIT_ROWS is cut in two; a part never holds more than PART_VALUES numbers (65,536
#: vectors of 64). Members of small ones that share a task, about; cosines that a task holds at once.
SPLIT_ROWS = 1_024
PART_VALUES = 1 << 22
SHARED_ROWS = 8_192
STRIP_VALUES = 1 << 22
BUCKETS = 256
#: Passes of a batch (the first has one alone); rows of a label that get planted partners, about; passes after which a label is compared in
#: full: so many, and as many more for each FULL_ROWS of its rows, as a full comparison costs more there; rows of an ordered partition, about; active rows that are
#: sent to all tasks at most.
PASSES = 4
SAMPLE_ROWS = 1_024
FULL_PASSES = 8
FULL_ROWS = 32_768
ORDERED_ROWS = 1 << 18
BROADCAST_ROWS = 1 << 18


def _unit(column: pa.Array, size: int) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _usable(v: str):
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(F.col(v).isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def _vector_type(df: DataFrame) -> str:
    return df.schema["vector"].dataType.simpleString()


# --- passes over large labels ---------------------------------------------------------------------


def planted_partners(sampled: DataFrame, cosine: float = COSINE, seed: int = SEED) -> DataFrame:
    """Two partners at the threshold for each sampled row (lab, rid, vector): plant 1 lies in a random direction from it, plant 2
    in the direction of another sampled row of its label."""
    number = pa.float32() if "float" in _vector_type(sampled) else pa.float64()

    def partners(table: pa.Table) -> pa.Table:
        table = table.sort_by("rid").combine_chunks()
        size = len(table.column("vector")[0])
        x = _unit(table.column("vector").combine_chunks(), size)
        any_way = np.random.default_rng([seed, size, len(x)]).standard_normal(x.shape)

        def across(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            y = y - (x * y).sum(1, keepdims=True) * x
            length = np.sqrt((y * y).sum(1, keepdims=True))
            return y / np.maximum(length, 1e-9), length > 1e-6

        first, usable = across(any_way)
        second, other = across(np.roll(x, 1, axis=0))
        second = np.where(other, second, first)
        made = [np.where(usable, cosine * x + np.sqrt(max(0.0, 1 - cosine * cosine)) * d, x) for d in (first, second)]
        out = [pa.table({"lab": table.column("lab"), "rid": table.column("rid"), "plant": pa.array(np.full(len(x), k, np.int32)), "vector": pa.array(list(y), pa.list_(number))}) for k, y in enumerate(made, 1)]
        return pa.concat_tables(out)

    return sampled.select("lab", "rid", "vector").groupBy("lab").applyInArrow(partners, f"lab long, rid long, plant int, vector {_vector_type(sampled)}")


def coded_rows(rows: DataFrame, first: int, passes: int, seed: int = SEED) -> DataFrame:
    """Each row (lab, rid, plant, vector) once for each pass from `first` on: its code in the pass and its sketch, without its vector."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            sizes = np.diff(batch.column("vector").offsets.to_numpy())
            for size in np.unique(sizes):
                rows = batch.filter(pa.array(sizes == size))
                if size not in planes:
                    each = [np.random.default_rng([seed, int(size), p]).standard_normal((size, BITS)) for p in range(first, first + passes)]
                    planes[size] = np.concatenate(each, 1), np.random.default_rng([seed, int(size)]).standard_normal((size, SKETCH_BITS))
                x = _unit(rows.column("vector"), size)
                codes = (x @ planes[size][0] > 0).reshape(-1, passes, BITS) @ (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64))
                sketch = pa.FixedSizeBinaryArray.from_buffers(pa.binary(SKETCH_BITS // 8), len(x), [None, pa.py_buffer(np.packbits(x @ planes[size][1] > 0, axis=1).tobytes())]).cast(pa.binary())
                for p in range(passes):
                    yield pa.RecordBatch.from_arrays([rows.column("lab"), pa.array(np.full(len(x), first + p, np.int32)), pa.array(codes[:, p]), rows.column("rid"), rows.column("plant"), sketch], ["lab", "pass", "code", "rid", "plant", "sketch"])

    return rows.select("lab", "rid", "plant", "vector").mapInArrow(code, "lab long, pass int, code long, rid long, plant int, sketch binary")


def sketch_limit(cosine: float) -> int:
    """Differing sketch bits up to which two vectors may reach the cosine."""
    share = math.acos(max(-1.0, min(1.0, cosine))) / math.pi
    return math.ceil(SKETCH_BITS * share + SKETCH_DEVIATIONS * math.sqrt(SKETCH_BITS * share * (1 - share)))


def window_rows(coded: DataFrame, cosine: float = COSINE, window: int = WINDOW, block: int = BLOCK_ROWS, partitions: int = 1) -> DataFrame:
    """(kind, block, rank, lab, pass, rid): kind 0, rows that have a candidate of another component within `window` ranks, in the
    blocks in which they are to be compared; kind 1 and 2, sampled rows that came within a window of that planted partner.
    coded has lab, pass, code, rid, plant (-1 for the rows of the table that are no sample), comp and sketch. Windows end at partitions: the fewer there are, the less is lost."""
    order, most = ["lab", "pass", "code", "rid", "plant"], sketch_limit(cosine)
    ordered = coded.select(*order, "comp", "sketch").repartitionByRange(partitions, *order).sortWithinPartitions(*order)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, np.ndarray] = {}
        base = TaskContext.get().partitionId() << 33
        start = 0  # rank of the first row of `kept`
        for batch in batches:
            own = {n: batch.column(n).to_numpy() for n in ("lab", "pass", "rid", "plant", "comp")}
            own["sketch"] = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint64).reshape(-1, SKETCH_BITS // 64)
            n_kept = len(kept["rid"]) if kept else 0
            x = {n: np.concatenate([kept[n], v]) if kept else v for n, v in own.items()}
            n = len(x["rid"])
            active, met = [], []
            for step in range(1, window + 1):
                i = np.arange(max(0, n_kept - step), n - step)
                j = i + step
                near = (x["lab"][i] == x["lab"][j]) & (x["pass"][i] == x["pass"][j])
                near &= np.bitwise_count(x["sketch"][i] ^ x["sketch"][j]).sum(1, dtype=np.int64) <= most
                i, j = i[near], j[near]
                real = (x["plant"][i] <= 0) & (x["plant"][j] <= 0) & (x["comp"][i] != x["comp"][j])
                at = base + (start + i[real]) // block
                active += [np.stack([at, i[real]]), np.stack([at, j[real]])]
                pair = (x["rid"][i] == x["rid"][j]) & (np.minimum(x["plant"][i], x["plant"][j]) == 0)
                met.append(np.stack([np.maximum(x["plant"][i], x["plant"][j])[pair], i[pair]]))
            blocks, at = np.unique(np.concatenate(active, 1), axis=1)
            kinds, sampled = np.unique(np.concatenate(met, 1), axis=1)
            row = np.concatenate([at, sampled])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([np.zeros(len(at)), kinds]).astype(np.int32)), pa.array(np.concatenate([blocks, np.zeros(len(kinds), np.int64)])), pa.array(start + row), *[pa.array(x[c][row]) for c in ("lab", "pass", "rid")]],
                ["kind", "block", "rank", "lab", "pass", "rid"],
            )
            kept = {c: v[max(0, n - window) :] for c, v in x.items()}
            start += max(0, n - window)

    return ordered.mapInArrow(scan, "kind int, block long, rank long, lab long, pass int, rid long")


def window_edges(active: DataFrame, cosine: float = COSINE, window: int = WINDOW) -> DataFrame:
    """(a, b) edges that connect what links within `window` ranks, from rows (block, rank, lab, pass, rid, vector)."""

    def compare(table: pa.Table) -> pa.Table:
        table = table.sort_by([("pass", "ascending"), ("lab", "ascending"), ("rank", "ascending")]).combine_chunks()
        rid, rank, lab, turn = (table.column(n).to_numpy() for n in ("rid", "rank", "lab", "pass"))
        vectors = table.column("vector").combine_chunks()
        sizes = np.diff(vectors.offsets.to_numpy())
        label = np.arange(len(rid))
        for size in np.unique(sizes):
            idx = np.flatnonzero(sizes == size)
            x = _unit(vectors.take(pa.array(idx)), size)
            for step in range(1, min(window, len(idx) - 1) + 1):
                i, j = idx[:-step], idx[step:]
                at = np.flatnonzero((lab[i] == lab[j]) & (turn[i] == turn[j]) & (rank[j] - rank[i] <= window))
                at = at[np.einsum("ij,ij->i", x[at], x[at + step]) >= cosine]
                label = _joined(label, idx[at], idx[at + step])
        moved = label != np.arange(len(rid))
        return pa.table({"a": rid[moved], "b": rid[label[moved]]})

    return active.groupBy("block").applyInArrow(compare, "a long, b long")


def pass_edges(rows: DataFrame, cosine: float = COSINE, window: int = WINDOW, recall: float = RECALL, seed: int = SEED, full_passes: int = FULL_PASSES) -> tuple[DataFrame, DataFrame]:
    """Edges within labels from rows (lab, rid, n: rows of the label, vector), and (lab, share): the measured recall of the labels that
    reached `recall`, the lesser share of met partners of both kinds. Every batch of passes is done before the next begins, so that its shuffles need not be kept."""
    sampled = F.pmod(F.xxhash64("rid", F.lit(seed)), F.col("n")) < SAMPLE_ROWS
    rows = rows.withColumn("plant", F.when(sampled, 0).otherwise(-1)).select("lab", "rid", "n", "plant", "vector")
    total = rows.count()
    labels = store(rows.groupBy("lab").agg(F.first("n").alias("n"), F.count_if(F.col("plant") == 0).alias("drawn")), "labels")
    planted = store(planted_partners(rows.where("plant = 0"), cosine, seed), "planted")
    every = rows.drop("n").unionByName(planted)
    edges, comps, met, shares = None, None, None, None
    pending, passes, batch = labels.select("lab"), 0, 1
    while not pending.isEmpty():
        coded = coded_rows(every.join(pending, "lab", "left_semi"), passes, batch, seed)
        if comps is None:
            coded = coded.withColumn("comp", F.col("rid"))
        else:
            coded = coded.join(comps, coded.rid == comps.node, "left").withColumn("comp", F.coalesce("component", "rid"))
        found = store(window_rows(coded, cosine, window, partitions=max(1, 3 * batch * total // ORDERED_ROWS)), "window-rows")
        active = found.where("kind = 0").drop("kind")
        hint = "broadcast" if active.count() <= BROADCAST_ROWS else "merge"
        new = window_edges(rows.select("rid", "vector").join(active.hint(hint), "rid"), cosine, window)
        edges = store(new if edges is None else new.unionByName(edges), "window-edges")
        comps = store(connected_components(edges, "a", "b"), "pass-components")
        hits = found.where("kind > 0").select("lab", "rid", "kind")
        met = store((hits if met is None else hits.unionByName(met)).distinct(), "met")
        passes, batch = passes + batch, PASSES
        of = met.groupBy("lab").agg(*[F.count_if(F.col("kind") == k).alias(f"met{k}") for k in (1, 2)])
        least = F.when(F.col("drawn") > 0, F.coalesce(F.least("met1", "met2"), F.lit(0)) / F.col("drawn")).otherwise(1.0)
        shares = store(labels.join(of, "lab", "left").select("lab", "n", least.alias("share")), "recall")
        most = full_passes * (1 + F.col("n") / FULL_ROWS)
        pending = shares.where((F.col("share") < recall) & (F.lit(passes) < most)).select("lab")
    return edges, (labels.select("lab", F.lit(1.0).alias("share")) if shares is None else shares.where(F.col("share") >= recall).select("lab", "share"))


# --- full comparison ------------------------------------------------------------------------------


def _dealt(members: DataFrame, part_rows: int, buckets: int) -> DataFrame:
    """Members by the two parts (i, j) of their component that a task compares. A component of over SPLIT_ROWS members is cut in two
    by hash, and in as many parts as PART_VALUES (or part_rows, if it is not 0) asks for; each two parts meet in a task of their
    own. Smaller ones share tasks."""
    most = F.lit(part_rows) if part_rows else F.greatest(F.lit(1), F.floor(F.lit(PART_VALUES) / F.size("vector")))
    g = F.greatest(F.least(F.lit(2), F.ceil(F.col("n_members") / SPLIT_ROWS)), F.ceil(F.col("n_members") / most)).cast("long")
    dealt = members.withColumn("g", g).withColumn("own", F.pmod(F.xxhash64("rid"), F.col("g"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("g") - 1)))
    return dealt.select(
        F.when(F.col("g") > 1, F.col("component")).otherwise(F.pmod(F.xxhash64("component"), F.lit(buckets))).alias("k"), (F.col("g") > 1).alias("large"),
        F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "rid", "component", "copies", "vector",
    )


def _compared(table: pa.Table, key: tuple) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each component of a task, in strips: its rows, its unit vectors, and the rows of one part and of the other that are to
    be compared. Within one part every row meets every row."""
    comp, own = (table.column(n).to_numpy() for n in ("component", "own"))
    i, j = key[2].as_py(), key[3].as_py()
    vectors = table.column("vector").combine_chunks()
    starts = np.flatnonzero(np.concatenate([[True], comp[1:] != comp[:-1]]))
    for a, b in zip(starts, [*starts[1:], len(comp)], strict=True):
        x = _unit(vectors.slice(a, b - a), len(vectors[a]))
        left, right = np.flatnonzero(own[a:b] == i), np.flatnonzero(own[a:b] == j)
        strip = max(16, STRIP_VALUES // max(1, len(right)))
        for p in range(0, len(left), strip):
            yield slice(a, b), x, left[p : p + strip], right, i == j


def full_edges(members: DataFrame, cosine: float = COSINE, part_rows: int = 0, buckets: int = BUCKETS) -> DataFrame:
    """(a, b) edges that connect all that links within each label (component) of members."""

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("component", "ascending"), ("rid", "ascending")]).combine_chunks()
        rid, root = table.column("rid").to_numpy(), np.arange(table.num_rows)
        for at, x, one, two, same in _compared(table, key):
            two = two[np.searchsorted(two, one[0]) :] if same else two
            s, t = np.nonzero(x[one] @ x[two].T >= cosine)
            root = _joined(root, at.start + one[s], at.start + two[t])
        moved = root != np.arange(len(rid))
        return pa.table({"a": rid[moved], "b": rid[root[moved]]})

    return _dealt(members, part_rows, buckets).groupBy("k", "large", "i", "j").applyInArrow(compare, "a long, b long")


def exact_links(members: DataFrame, cosine: float = COSINE, part_rows: int = 0) -> DataFrame:
    """(rid, n_other) for the members (rid, component, n_members, copies, vector) of components:
    the copies of other vectors of the component that link. No pair leaves a task."""

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("component", "ascending"), ("rid", "ascending")]).combine_chunks()
        rid, copies = table.column("rid").to_numpy(), table.column("copies").to_numpy().astype(np.float64)
        out = np.zeros(len(rid))
        for at, x, one, two, same in _compared(table, key):
            links = x[one] @ x[two].T >= cosine
            if same:
                links[np.arange(len(one)), np.searchsorted(two, one)] = False
            links = links.astype(np.float64)
            out[at.start + one] += links @ copies[at.start + two]
            if not same:
                out[at.start + two] += links.T @ copies[at.start + one]
        return pa.table({"rid": rid, "n": out.astype(np.int64)})

    return _dealt(members, part_rows, BUCKETS).groupBy("k", "large", "i", "j").applyInArrow(compare, "rid long, n long").groupBy("rid").agg(F.sum("n").alias("n_other"))


def near_vectors(vectors: DataFrame, cosine: float = COSINE, window: int = WINDOW, recall: float = RECALL, seed: int = SEED, full_passes: int = FULL_PASSES) -> DataFrame:
    """vec_id, n_links, component_id, kept (vec_id = component_id): one row for each row of vectors.

    Vectors are compared when their labels are equal and not null and they have the same length. A vector
    that is null, empty, zero, or holds a null or non-finite component links with nothing, and so does a row
    with a null label or vec_id (then kept is false, as it has no component_id). Equal vectors
    of a label (by two 64-bit hashes) are one class, whose members link with each other and share all links; repeated rows
    count as further vectors. Passes with windows of `window` rows run until `recall` of the partners planted at the threshold have met; a label that does not come so far
    in full_passes (more in very large ones) is compared in full and exact; with full_passes 0 all labels are. Other columns are ignored. An empty table gives
    an empty result.
    """
    kind = vectors.schema["embedding"].dataType.simpleString()
    vector = F.col("embedding") if kind in ("array<float>", "array<double>") else F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("string").alias("label"), vector.alias("vector"))
    fit = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & _usable("vector")
    told = rows.withColumns({"k1": F.xxhash64("label", "vector"), "k2": F.xxhash64(F.lit(seed), "vector", "label")})
    usable = told.where(fit)
    classes = usable.groupBy("label", "k1", "k2").agg(F.min("vec_id").alias("rid"), F.count("*").alias("copies"), F.first("vector").alias("vector"))
    reps = store(classes.withColumn("dim", F.size("vector")).withColumn("least_id", F.col("rid")), "vectors")
    if reps.groupBy("rid").count().where("count > 1").limit(1).count():  # a vec_id that is repeated with another vector: number the classes apart
        reps = reps.withColumn("rid", F.col("k1"))
    counts = store(reps.groupBy("dim", "label").agg(F.count("*").alias("n_members")), "label-sizes")
    sized = reps.join(counts, ["dim", "label"]).withColumn("lab", F.xxhash64("dim", "label"))
    found, whole = None, sized
    if full_passes > 0:
        several = sized.where("n_members > 1").select("lab", "rid", F.col("n_members").alias("n"), "vector")
        found, reached = pass_edges(several, cosine, window, recall, seed, full_passes)
        whole = sized.where("n_members > 1").join(reached, "lab", "left_anti")
    whole = whole.select("rid", F.col("lab").alias("component"), "n_members", F.lit(1).alias("copies"), "vector")
    buckets = max(BUCKETS, (counts.agg(F.sum("n_members")).first()[0] or 0) // SHARED_ROWS)
    edges = full_edges(whole, cosine, buckets=buckets)
    labels = store(connected_components(edges if found is None else edges.unionByName(found), "a", "b"), "vector-components")
    sizes = labels.groupBy("component").agg(F.count("*").alias("n_members"))
    inside = reps.join(labels.join(sizes, "component"), reps.rid == labels.node)
    links = exact_links(inside.select("rid", "component", "n_members", "copies", "vector"), cosine)
    narrow = reps.select("k1", "k2", "rid", "least_id", "copies").join(labels, F.col("rid") == F.col("node"), "left")
    narrow = store(narrow.join(links, "rid", "left").select("k1", "k2", "rid", "least_id", "copies", "component", "n_other"), "vector-links")
    named = narrow.where("component is not null").groupBy("component").agg(F.min("least_id").alias("component_id"))
    per_class = narrow.join(named, "component", "left").select("k1", "k2", F.coalesce("component_id", "least_id").alias("component_id"), (F.col("copies") - 1 + F.coalesce("n_other", F.lit(0))).alias("n_links"))
    keys = told.select("vec_id", *[F.when(fit, F.col(k)).alias(k) for k in ("k1", "k2")])
    out = keys.join(per_class, ["k1", "k2"], "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
