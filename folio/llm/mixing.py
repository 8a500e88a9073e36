"""Mixing sources to target weights by subset-sum budget fitting.

Each source's target is its weighted share of the mix, cut at a multiple of its size. Whole passes
over a source come first. For the rest of its budget the documents are counted by exact length; the
same share of every length is taken, and a bounded knapsack over the lengths left fits what is
still missing. The chosen number of each length is then filled in the order of a seeded hash.
Only (source, length) counts meet in a task; documents are never gathered.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from folio.llm.storage import free_names, store

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_TIMES = 2
SEED = 8
#: Words that the knapsack fits at most, and rows of one length that one task ranks.
KNAPSACK_WORDS = 1 << 16
RANKED_ROWS = 1 << 17


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST_TIMES) -> DataFrame:
    """source, source_size, target from one row (source, source_size) for each source.

    Weights repeat over the sources in code-point order, null last. A target is weight * level, cut at most * size. The level at
    which the targets add up to share * all sizes is found by sums alone: sources below their cut share what the others
    leave, and those that then pass it are cut too, until none does. Sources are numbered in sorted ranges, so no task sees all of them."""
    order = F.col("source").asc_nulls_last()
    ranged = store(sizes.select("source", F.col("source_size").cast("long")).repartitionByRange(order).sortWithinPartitions(order).withColumn("at", F.monotonically_increasing_id()), "sources")
    part = F.shiftright("at", 33)
    counts = sorted((r.part, r.n) for r in ranged.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())  # a row for each partition
    bases = [(p, sum(n for _, n in counts[:k])) for k, (p, _) in enumerate(counts)]
    before = sizes.sparkSession.createDataFrame(bases, "part long, base long")
    rank = F.col("base") + F.col("at") - F.shiftleft("part", 33)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    told = ranged.withColumn("part", part).join(F.broadcast(before), "part").select("source", "source_size", weight.alias("w"), (F.col("source_size").cast("double") * most).alias("cap"))
    total = share * float(told.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0])
    level, cut = 0.0, -1
    while True:
        full = F.col("cap") < F.col("w") * level
        now = told.agg(F.count_if(full).alias("cut"), F.coalesce(F.sum(F.when(full, F.col("cap"))), F.lit(0.0)).alias("given"), F.coalesce(F.sum(F.when(~full, F.col("w"))), F.lit(0.0)).alias("open")).first()
        if now.cut == cut or not now.open:
            break
        cut, level = now.cut, max(level, (total - now.given) / now.open)
    return told.select("source", "source_size", F.least(F.col("cap"), F.col("w") * F.lit(level if now.open else float("inf"))).alias("target"))


def fit_counts(lengths: np.ndarray, counts: np.ndarray, budget: int, knapsack: int = KNAPSACK_WORDS) -> np.ndarray:
    """How many of each length (distinct, positive) to take so that their sum comes as near to budget
    from below as the knapsack reaches."""
    total = int((lengths * counts).sum())
    if budget >= total:
        return counts.copy()
    taken = (counts * (max(0, budget - knapsack // 2) / max(total, 1))).astype(np.int64)  # the rest is left to the knapsack
    left = budget - int((lengths * taken).sum())
    for at in np.argsort(-lengths, kind="stable"):  # longest first, down to what the knapsack fits
        if left <= knapsack:
            break
        more = min(int(counts[at] - taken[at]), (left - knapsack // 2) // int(lengths[at]))
        if more > 0:
            taken[at] += more
            left -= more * int(lengths[at])
    left = max(left, 0)
    room = min(left, knapsack)
    usable = np.flatnonzero((lengths <= room) & (counts > taken))
    reached = np.full(room + 1, -1, np.int64)  # the item that first reached a sum
    reached[0] = 0
    items = [(0, 0)]
    for at in usable:
        free, size = min(int(counts[at] - taken[at]), room // int(lengths[at])), 1
        while free > 0 and reached[room] < 0:
            n = min(size, free)
            w = n * int(lengths[at])
            new = np.flatnonzero((reached[: room + 1 - w] >= 0) & (reached[w:] < 0)) + w if w <= room else ()
            if len(new):
                items.append((at, n))
                reached[new] = len(items) - 1
            free -= n
            size *= 2
        if reached[room] >= 0:
            break
    at = int(np.flatnonzero(reached >= 0)[-1])
    while at:
        which, n = items[reached[at]]
        taken[which] += n
        at -= n * int(lengths[which])
    return taken


def mix_sources(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST_TIMES, seed: int = SEED, ranked_rows: int = RANKED_ROWS) -> DataFrame:
    """doc_id, source, size (words), source_size, target, times: how often the mix takes the row.

    Null text has size 0; rows of size 0 are taken as often as the whole passes over their source. Null is a source of its
    own, ordered last. Rows are chosen within a length by a seeded hash of doc_id, then by doc_id, so
    reruns agree; rows that repeat a doc_id at one size are exchangeable. A null doc_id is hashed
    like any other. Other columns are ignored. An empty table gives an empty result.
    """
    light = store(docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size")), "sizes")
    by_size = store(light.groupBy("source", "size").agg(F.count("*").alias("n")), "size-counts")
    targets = source_targets(by_size.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, share, most)
    told = by_size.join(targets.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")

    def fit(table: pa.Table) -> pa.Table:
        size, n = table.column("size").to_numpy(), table.column("n").to_numpy()
        total, target = table.column("source_size")[0].as_py(), table.column("target")[0].as_py()
        passes = min(most, int(target // total)) if total else 0
        extra = np.zeros(len(size), np.int64)
        if total and passes < most:
            order = np.argsort(size, kind="stable")
            order = order[size[order] > 0]
            extra[order] = fit_counts(size[order], n[order], round(target) - passes * total)
        return table.append_column("passes", pa.array(np.full(len(size), passes, np.int64))).append_column("extra", pa.array(extra))

    plan = store(told.groupBy("source").applyInArrow(fit, "source string, size long, n long, source_size long, target double, passes long, extra long"), "mix-plan")
    return _filled(light, plan, seed, ranked_rows)


def _filled(light: DataFrame, plan: DataFrame, seed: int, ranked_rows: int) -> DataFrame:
    """The first `extra` rows of each length, by hash and doc_id, are taken once more than the others. A length of more than
    ranked_rows rows is cut into ranges of the hash; only the range in which its count ends is ranked."""
    told = plan.withColumnsRenamed({"source": "_source", "size": "_size"})
    dealt = light.join(told, F.col("source").eqNullSafe(F.col("_source")) & (F.col("size") == F.col("_size"))).withColumn("h", F.xxhash64(F.lit(seed), F.coalesce("doc_id", F.lit(-1))))
    names = ["doc_id", "source", "size", "source_size", "target", "times"]
    cut = (F.col("extra") > 0) & (F.col("extra") < F.col("n"))
    settled = dealt.where(~cut).withColumn("times", F.col("passes") + (F.col("extra") > 0).cast("long")).select(*names)
    rank = F.row_number().over(Window.partitionBy("source", "size").orderBy("h", "doc_id"))
    small = dealt.where(cut & (F.col("n") <= ranked_rows)).withColumn("times", F.col("passes") + (rank <= F.col("extra")).cast("long")).select(*names)
    out = settled.unionByName(small)
    if not plan.where(cut & (F.col("n") > ranked_rows)).limit(1).count():
        return out
    ranges = F.ceil(2 * F.col("n") / ranked_rows)
    large = dealt.where(cut & (F.col("n") > ranked_rows)).withColumn("range", F.shiftright((F.shiftright("h", 32) + 2**31) * ranges, 32))
    counts = large.groupBy("source", "size", "range").agg(F.count("*").alias("own"), F.first("extra").alias("most"))
    before = F.coalesce(F.sum("own").over(Window.partitionBy("source", "size").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ends = counts.withColumn("left", F.greatest(F.lit(0), F.least(F.col("own"), F.col("most") - before))).withColumnsRenamed({"source": "_s", "size": "_z", "range": "_r"}).drop("most")
    placed = large.join(ends, F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_z")) & (F.col("range") == F.col("_r")))
    whole = placed.where("left = 0 or left = own").withColumn("times", F.col("passes") + (F.col("left") > 0).cast("long"))
    rank = F.row_number().over(Window.partitionBy("source", "size", "range").orderBy("h", "doc_id"))
    part = placed.where("left > 0 and left < own").withColumn("times", F.col("passes") + (rank <= F.col("left")).cast("long"))
    return out.unionByName(whole.select(*names)).unionByName(part.select(*names))


def mixed_documents(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST_TIMES, seed: int = SEED) -> DataFrame:
    """The rows of docs, each as often as the mix takes it (0 to `most` times), with their columns.

    Rows that repeat doc_id, source and size are exchangeable for the mix; where it takes some of
    them more often than others, they are ordered by text and then by their other columns."""
    names = free_names(docs.columns, "_mix_id", "_mix_source", "_mix_size", "_n", "_low", "_sum", "_high", "_own_id", "_own_source", "_own_size", "_copy", "_rank")
    key, (n, low, sum_, high), own, (copy, at) = names[:3], names[3:7], names[7:10], names[10:]
    times = mix_sources(docs, weights, share, most, seed).select(F.col("doc_id").alias(key[0]), F.col("source").alias(key[1]), F.col("size").alias(key[2]), "times")
    like = times.groupBy(*key).agg(F.count("*").alias(n), F.min("times").alias(low), F.sum("times").alias(sum_), F.max("times").alias(high))
    like = store(like.where(F.col(sum_) > 0), "mix-times")
    rows = docs.withColumns(dict(zip(own, (F.col("doc_id").cast("long"), F.col("source").cast("string"), word_count(F.col("text"))), strict=True)))
    same = F.col(own[0]).eqNullSafe(F.col(key[0])) & F.col(own[1]).eqNullSafe(F.col(key[1])) & (F.col(own[2]) == F.col(key[2]))
    repeated = lambda df, n: df.withColumn(copy, F.explode(F.array_repeat(F.lit(1), n.cast("int")))).select(*[F.col(f"`{c}`") for c in docs.columns])
    # The documents taken grow with the input, so they are never broadcast: each text is shuffled once, at every size.
    alike = F.col(low) == F.col(high)
    out = repeated(rows.join(like.where(alike).hint("merge"), same), F.col(low))
    if like.where(~alike).limit(1).count():
        whole = F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns]))
        rank = F.row_number().over(Window.partitionBy(*key).orderBy("text", whole))
        ranked = rows.join(like.where(~alike).hint("merge"), same).withColumn(at, rank)
        above = F.col(sum_) - F.col(n) * F.col(low)
        out = out.unionByName(repeated(ranked, F.col(low) + (F.col(at) <= above).cast("long")))
    return out
