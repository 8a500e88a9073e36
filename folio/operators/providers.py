"""Work that somebody's function does (speech, effects, music, analysis): asked for once a key, made once, and accounted for.

What is in the cache is not asked for again. All that is missing passes the function once, in Arrow batches, and what comes out is written as one table before
anything is taken from it: clips and usage are two views of it, so that no retried task calls twice for one of them, or counts what the other does not have.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from folio.operators.cache import first_wins, hit_rows
from folio.sources.stored import stored


@dataclass
class Served:
    clips: DataFrame  # clip_key and what the function gave
    usage: DataFrame  # job_id, clip_key, capability, family, unit_type, units, cache_hit
    failed: DataFrame  # job_id, clip_key, problem


@dataclass
class Provider:
    """A function from a batch of requests to a batch of as many results, with who it is. `schema` names its results; a result whose `units` are
    null has failed, for the reason in `problem`."""

    capability: str
    family: str
    unit_type: str
    function: Callable[[pa.RecordBatch], pa.RecordBatch]
    schema: str
    batch_rows: int = 64


def serve(plan: DataFrame, cached: DataFrame, provider: Provider) -> Served:
    """plan (job_id, ord, clip_key, and what the function reads) against cached (clip_key).

    Of several rows of one key the first by (job_id, ord) is asked and pays; further rows of a key that the cache had count as hits, those of a key that is made
    now are neither. Null keys are not asked for. Nothing is called again by reading the results, and a second run on a cache that has got the clips calls
    nothing. An empty plan gives empty results."""
    plan = plan.where("clip_key is not null")
    first = first_wins(plan, ["clip_key"], ["job_id", "ord"]).join(cached.select("clip_key").distinct(), "clip_key", "left_anti")
    results = T._parse_datatype_string(provider.schema)
    schema = T.StructType([first.schema["job_id"], first.schema["clip_key"], *results.fields, T.StructField("units", T.DoubleType()), T.StructField("problem", T.StringType())])
    names = [f.name for f in schema.fields]

    def call(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, provider.batch_rows):
                part = batch.slice(lo, provider.batch_rows)
                made = provider.function(part)
                if made.num_rows != part.num_rows:
                    raise ValueError(f"{provider.family}: {made.num_rows} results for {part.num_rows} requests")
                yield pa.RecordBatch.from_arrays([part.column("job_id"), part.column("clip_key"), *[made.column(n) for n in names[2:]]], names)

    made = stored(first.mapInArrow(call, schema), f"{provider.capability}-made")
    good = made.where("units is not null")
    maker = [F.lit(provider.capability).alias("capability"), F.lit(provider.family).alias("family"), F.lit(provider.unit_type).alias("unit_type")]
    paid = good.select("job_id", "clip_key", *maker, "units", F.lit(False).alias("cache_hit"))
    free = hit_rows(plan, cached, made).select("job_id", "clip_key", *maker, F.lit(0.0).alias("units"), F.lit(True).alias("cache_hit"))
    return Served(good.select("clip_key", *[f.name for f in results.fields]), paid.unionByName(free), made.where("units is null").select("job_id", "clip_key", "problem"))
