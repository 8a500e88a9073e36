"""How far the sources of each language diverge: every pair of sources, and the terms by which a source stands out.

Shares of terms are whole numbers, p = 1 + floor(10^9 (count + 2) / (N + 2 V)). Most terms do not occur in most sources and have the
source's baseline there, so a pair's sum over all V terms is taken from the baselines, corrected for each source by how many of its terms have
which p, and corrected once more for terms that both sources have. The terms of a group are ranked by radix select: a histogram over the high
bits of the values, then one over the low bits of those at its k-th place, gives the k-th value; ties at it are cut down by histograms
over the next UTF-8 bytes behind what they all begin with. No group is ever sorted or gathered.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from folio.llm.storage import store
from folio.llm.text import chunks, flat_bytes, words

#: A term is in the vocabulary of a language from so many documents on; so many terms are ranked for each group.
MIN_DOCS, TOP = 10, 10
SCALE = 1_000_000_000
#: Text whose terms a task adds up before it sends them on, and pairs of counts that it takes in one step.
STEP_BYTES, STEP_PAIRS = 8 << 20, 1 << 19
#: Values are below 2^30, as (p - q)^2 / (p + q) <= |p - q|. Bits of a digit.
DIGIT_BITS = 15
#: Groups (a source of a language) are sent to all tasks up to this number, and joined beyond.
BROADCAST_GROUPS = 1 << 16
_FOLD = np.full(256, 0x20, np.uint8)
_FOLD[0x80:] = np.arange(0x80, 0x100)
_FOLD[0x61:0x7B] = _FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches, size=STEP_BYTES):
        flat, lengths = flat_bytes(batch.column("text"))
        offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
        folded = pa.Array.from_buffers(pa.string(), batch.num_rows, [None, pa.py_buffer(offsets), pa.py_buffer(_FOLD[flat])])
        code, n, terms = words(folded)
        lang, source = batch.column("lang").dictionary_encode(), batch.column("source").dictionary_encode()
        group = lang.indices.to_numpy(zero_copy_only=False).astype(np.int64) * len(source.dictionary) + source.indices.to_numpy(zero_copy_only=False)
        span = max(len(terms), 1)
        per_doc, times = np.unique(np.repeat(np.arange(batch.num_rows), n) * span + code, return_counts=True)
        found, at, docs = np.unique(group[per_doc // span] * span + per_doc % span, return_inverse=True, return_counts=True)
        total = np.zeros(len(found), np.int64)
        np.add.at(total, at, times)
        take = lambda values, places: values.take(pa.array(places)).cast(pa.string())
        groups = found // span
        columns = [take(lang.dictionary, groups // len(source.dictionary)), take(source.dictionary, groups % len(source.dictionary)), take(terms, found % span), pa.array(total), pa.array(docs)]
        yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])


def vocabulary_counts(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """lang, source, term, n, n_lang, leads: how often each source, and its language, has each term of the language's vocabulary (n > 0); one source of
    each term leads. A (lang, term) has a row for each source at most, so the windows here are bounded."""
    shaped = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    rows = shaped.mapInArrow(_counted, "lang string, source string, term string, n long, docs long")
    added = rows.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")
    wide = added.withColumns({"in_docs": F.sum("docs").over(term), "n_lang": F.sum("n").over(term), "leads": F.min("source").over(term) == F.col("source")})
    return wide.where(F.col("in_docs") >= min_docs).select("lang", "source", "term", "n", "n_lang", "leads")


def share(n: Column, total: Column, vocabulary: Column) -> Column:
    """p of a count; null without a vocabulary. Exact to 10^28, as decimals."""
    whole = lambda c, digits: c.cast(T.DecimalType(digits, 0))
    return F.lit(1) + F.call_function("div", whole(F.lit(SCALE), 10) * whole(n + 2, 20), F.nullif(whole(total + 2 * vocabulary, 20), whole(F.lit(0), 20)))


def difference(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def groups_of(docs: DataFrame, counts: DataFrame) -> DataFrame:
    """lang, source, total, lang_total, vocabulary, p0 (share of a term that the group lacks): a row for each (lang, source) of docs, even without terms."""
    seen = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    sums = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = counts.where("leads").groupBy("lang").agg(F.sum("n_lang").alias("lang_total"), F.count("*").alias("vocabulary"))
    out = seen.join(sums, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["total", "lang_total", "vocabulary"])
    return out.withColumn("p0", share(F.lit(0), F.col("total"), F.col("vocabulary")))


def _common_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, one, two, value: corrections for terms of two sources (one < two), added up over a task's terms. Rows come in
    order of (lang, term), and a term's rows may end in the next batch."""
    rest, names, sums = None, {}, {}

    def corrected(table: pa.Table) -> None:
        columns = {k: table.column(k).combine_chunks() for k in ("lang", "source", "term")}
        coded = {k: v.dictionary_encode() for k, v in columns.items()}
        index = {k: v.indices.to_numpy(zero_copy_only=False).astype(np.int64) for k, v in coded.items()}
        p, p0 = table.column("p").to_numpy(), table.column("p0").to_numpy()
        new = np.ones(len(p), bool)
        new[1:] = (np.diff(index["lang"]) != 0) | (np.diff(index["term"]) != 0)
        begin = np.maximum.accumulate(np.where(new, np.arange(len(p)), 0))
        order = np.lexsort((_ranks(coded["source"].dictionary)[index["source"]], begin))
        p, p0, group = p[order], p0[order], (index["lang"] * len(coded["source"].dictionary) + index["source"])[order]
        known, group = np.unique(group, return_inverse=True)
        place = {}
        for k, g in enumerate(known.tolist()):
            name = (coded["lang"].dictionary[g // len(coded["source"].dictionary)].as_py(), coded["source"].dictionary[g % len(coded["source"].dictionary)].as_py())
            place[k] = names.setdefault(name, len(names))
        group = np.fromiter(place.values(), np.int64, len(place))[group]
        before = np.arange(len(p)) - begin
        ends = np.cumsum(before)
        lo = 0
        while lo < len(p):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + STEP_PAIRS, side="right")))
            n = before[lo:hi]
            right = np.repeat(np.arange(lo, hi), n)
            left = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin[lo:hi], n)
            f = lambda x, y: (x - y) * (x - y) // (x + y)
            value = f(p[left], p[right]) - f(p[left], p0[right]) - f(p0[left], p[right]) + f(p0[left], p0[right])
            pair, at = np.unique((group[left] << 32) | group[right], return_inverse=True)
            total = np.zeros(len(pair), np.int64)
            np.add.at(total, at, value)
            for key, x in zip(pair.tolist(), total.tolist(), strict=True):
                sums[key] = sums.get(key, 0) + x
            lo = hi

    def told() -> pa.RecordBatch:
        own = list(names)
        rows = [(own[k >> 32][0], own[k >> 32][1], own[k & 0xFFFFFFFF][1], v) for k, v in sums.items()]
        names.clear()
        sums.clear()
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.string(), pa.string(), pa.int64()))], ["lang", "one", "two", "value"])

    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([rest, table]) if rest is not None else table
        last = {k: table.column(k)[-1].as_py() for k in ("lang", "term")} if len(table) else None
        cut = len(table)
        while cut and all(table.column(k)[cut - 1].as_py() == v for k, v in last.items()):
            cut -= 1
        corrected(table.slice(0, cut))
        rest = table.slice(cut)
        if len(sums) > STEP_PAIRS:
            yield told()
    if rest is not None:
        corrected(rest)
    yield told()


def _ranks(values: pa.Array) -> np.ndarray:
    """Place of each string in the order of its UTF-8 bytes."""
    out = np.empty(len(values), np.int64)
    out[np.array(sorted(range(len(values)), key=values.cast(pa.binary()).to_pylist().__getitem__), np.int64)] = np.arange(len(values))
    return out


def pair_divergences(shares: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item (another source of the language), value: the sum of differences over the language's vocabulary, for every ordered pair.
    shares: lang, source, term, p, p0 of the terms that occur."""
    one = groups.select("lang", "source", "vocabulary", "p0")
    two = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    base = one.join(two, "lang").where("source <> item").select("lang", "source", "item", F.coalesce(F.col("vocabulary") * difference(F.col("p0"), F.col("q0")), F.lit(0)).alias("value"))
    kinds = shares.groupBy("lang", "source", "p", "p0").count()
    moved = F.col("count") * (difference(F.col("p"), F.col("q0")) - difference(F.col("p0"), F.col("q0")))
    single = kinds.join(two, "lang").where("source <> item").groupBy("lang", "source", "item").agg(F.sum(moved).alias("value"))
    ordered = shares.select("lang", "term", "source", "p", "p0").repartition("lang", "term").sortWithinPartitions("lang", "term")
    common = ordered.mapInArrow(_common_terms, "lang string, one string, two string, value long").groupBy("lang", "one", "two").agg(F.sum("value").alias("value"))
    swap = lambda df, a, b: df.select("lang", F.col(b).alias("source"), F.col(a).alias("item"), "value")
    parts = [base, single, swap(single, "source", "item"), swap(common, "one", "two"), swap(common, "two", "one")]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def _at_kth(histogram: DataFrame, keys: list[str], digit: Column, need: Column) -> DataFrame:
    """keys, digit, count and before (rows at earlier digits) of the digit, in the given order, at which `need` rows are reached; of the last digit where
    there are fewer. A group has as many rows as a digit has values, at most."""
    passed = F.sum("count").over(Window.partitionBy(*keys).orderBy(digit).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    last = F.lead("digit").over(Window.partitionBy(*keys).orderBy(digit)).isNull()
    told = histogram.withColumns({"passed": passed, "last": last}).withColumn("before", F.col("passed") - F.col("count"))
    return told.where((F.col("before") < need) & ((F.col("passed") >= need) | F.col("last")))


def _common_starts(low: pd.Series, high: pd.Series) -> pd.Series:
    """How many bytes both begin with."""
    return pd.Series([len(os.path.commonprefix([a, b])) for a, b in zip(low, high, strict=True)], dtype="int32")


def radix_top(rows: DataFrame, keys: list[str], k: int = TOP, broadcast_groups: int = BROADCAST_GROUPS) -> DataFrame:
    """Of each group (keys) the k rows with the highest value (0 <= value < 2^30), ties by the smallest item in UTF-8 bytes; keys, item, value. Items of a
    group differ. rows are read once for each digit and once for the result, so they should be a stored table."""
    rows = rows.select(*keys, "item", "value")
    high, low = F.shiftright("value", DIGIT_BITS), F.col("value").bitwiseAND((1 << DIGIT_BITS) - 1)
    first = _at_kth(rows.groupBy(*keys, high.alias("digit")).count(), keys, F.col("digit").desc(), F.lit(k))
    first = store(first.select(*keys, F.col("digit").alias("high"), (F.lit(k) - F.col("before")).alias("need")), "radix")
    few = first.count() <= broadcast_groups
    near = lambda df: F.broadcast(df) if few else df.hint("merge")
    second = rows.withColumn("digit", low).join(near(first), keys).where(high == F.col("high")).groupBy(*keys, "high", "need", "digit").count()
    kth = _at_kth(second, keys, F.col("digit").desc(), F.col("need"))
    bound = F.shiftleft("high", DIGIT_BITS).bitwiseOR(F.col("digit")).alias("bound")
    bounds = store(kth.select(*keys, bound, (F.col("need") - F.col("before")).alias("need"), F.col("count").alias("ties")), "radix")
    found = rows.join(near(bounds), keys)
    taken = found.where((F.col("value") > F.col("bound")) | ((F.col("value") == F.col("bound")) & (F.col("ties") <= F.col("need")))).select(*keys, "item", "value")
    open_ = found.where((F.col("value") == F.col("bound")) & (F.col("ties") > F.col("need")))
    common_start = F.pandas_udf(_common_starts, "int")
    left = store(open_.select(*keys, "item", "value", F.col("item").cast("binary").alias("bytes"), "need"), "radix")
    while not left.isEmpty():
        ends = left.groupBy(*keys).agg(F.min("bytes").alias("low"), F.max("bytes").alias("high")).select(*keys, common_start("low", "high").alias("start"))
        digits = store(left.join(near(ends), keys).withColumn("digit", F.hex(F.expr("substring(bytes, start + 1, 2)"))).drop("start"), "radix")
        cut = _at_kth(digits.groupBy(*keys, "need", "digit").count(), keys, F.col("digit").asc(), F.col("need"))
        cut = store(cut.select(*keys, F.col("digit").alias("at"), "before", "count"), "radix")
        told = digits.join(near(cut), keys)
        whole = F.col("count") <= F.col("need") - F.col("before")
        taken = taken.unionByName(told.where((F.col("digit") < F.col("at")) | ((F.col("digit") == F.col("at")) & whole)).select(*keys, "item", "value"))
        more = told.where((F.col("digit") == F.col("at")) & ~whole)
        left = store(more.select(*keys, "item", "value", "bytes", (F.col("need") - F.col("before")).alias("need")), "radix")
    return taken


def source_divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, broadcast_groups: int = BROADCAST_GROUPS) -> DataFrame:
    """lang, source, part, item, value, rank. Part `pair`: item is another source of the language, value how far the two diverge, all ranks. Part `term`: item is
    a term that the source has more of than its language, value by how much, ranks to `top`.

    docs: text, lang, source; other columns, whatever their names, have no effect. Null text, lang and source are ''. Terms are runs of letters A-Z (lower-cased) and of characters
    beyond ASCII. A language keeps terms of at least min_docs of its rows; repeated rows count again. A group without terms has shares like any
    other, and 0 as value where its language keeps no term; a language of one source has no pairs. Ties of value rank by the item's UTF-8 bytes. All sums are
    exact. An empty table gives an empty result. broadcast_groups changes the plan, not the result.
    """
    docs = docs.select("text", "lang", "source")
    counts = store(vocabulary_counts(docs, min_docs), "term-counts")
    groups = store(groups_of(docs, counts), "groups")
    few = groups.count() <= broadcast_groups
    own = groups.select("lang", "source", "total", "lang_total", "vocabulary", "p0")
    joined = counts.join(F.broadcast(own) if few else own.hint("merge"), ["lang", "source"])
    shares = joined.select("lang", "source", "term", "p0", share(F.col("n"), F.col("total"), F.col("vocabulary")).alias("p"), share(F.col("n_lang"), F.col("lang_total"), F.col("vocabulary")).alias("q"))
    shares = store(shares, "shares")
    rising = shares.where("p > q").select("lang", "source", F.col("term").alias("item"), difference(F.col("p"), F.col("q")).alias("value"))
    terms = radix_top(rising, ["lang", "source"], top, broadcast_groups).withColumn("part", F.lit("term"))
    pairs = pair_divergences(shares, groups).withColumn("part", F.lit("pair"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), F.col("item"))
    return pairs.unionByName(terms).select("lang", "source", "part", "item", "value", F.row_number().over(order).alias("rank"))
