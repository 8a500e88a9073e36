"""Array expressions that stay near linear on long arrays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def _scan(values: Column, start: Column, add: Callable[[Column, Column], Column]) -> Column:
    """All partial results of a fold. Appending copies the array, so the time is quadratic in its length."""
    step = lambda a, x: F.struct(add(a["at"], x).alias("at"), F.array_append(a["out"], add(a["at"], x)).alias("out"))
    return F.aggregate(values, F.struct(start.alias("at"), F.array().cast("array<int>").alias("out")), step)["out"]


def running(values: Column, add: Callable[[Column, Column], Column] = lambda a, x: a + x) -> Column:
    """Running sums (or another associative fold with neutral 0) of an array of ints. The array is cut into about sqrt(n) runs of
    about sqrt(n); runs are folded apart and then moved by what lies before them: n^1.5 copied values for n, not n^2."""
    zero = F.lit(0)
    size = F.greatest(F.ceil(F.sqrt(F.size(values))), F.lit(1)).cast("int")
    count = F.ceil(F.size(values) / size).cast("int")
    runs = F.transform(F.sequence(zero, F.greatest(count - 1, zero)), lambda k: F.slice(values, k * size + 1, size))
    totals = F.transform(runs, lambda r: F.aggregate(r, zero, lambda a, x: add(a, x)))
    before = F.concat(F.array(zero), F.slice(_scan(totals, zero, add), 1, F.greatest(count - 1, zero)))
    moved = F.transform(F.arrays_zip(runs.alias("run"), before.alias("base")), lambda z: _scan(z["run"], z["base"], add))
    return F.when(F.size(values) > 0, F.flatten(moved)).otherwise(F.array().cast("array<int>"))


def merged_maps(first: Column, *later: Column) -> Column:
    """One map of all entries; of a key that several maps have, the last one's value counts."""
    absent = lambda more: lambda k, v: ~F.map_contains_key(more, k)
    out = first
    for more in later:
        out = F.map_concat(F.map_filter(out, absent(more)), more)
    return out
