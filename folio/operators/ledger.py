"""The job ledger: jobs, stages, events and usage as append-only tables."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window, functions as F

from folio.schema import STAGES, STAGE_WEIGHTS
from folio.sources.stored import stored


def usage_totals(usage: DataFrame) -> DataFrame:
    """calls, hits and cost of each job: one map-side combined aggregate."""
    return usage.groupBy("job_id").agg(
        F.count_if(~F.col("cache_hit")).alias("calls"), F.count_if("cache_hit").alias("hits"),
        F.round(F.coalesce(F.sum("cost_usd"), F.lit(0.0)), 6).alias("cost_usd"),
    )


def exact_sum(value: Column) -> Column:
    """The sum of doubles as their decimals add up, the same in any order of rows. Where some value has more than ten places, is no number or is too large,
    it is the sum of doubles."""
    exact = value.try_cast("decimal(28,10)")
    fits = F.count(value) == F.count_if(exact.cast("double") == value)
    return F.coalesce(F.when(fits, F.try_sum(exact).cast("double")), F.sum(value))


def added_in_order(rows: DataFrame, keys: list[str], value: Column, order: str, name: str) -> DataFrame:
    """(keys, name): the sum of doubles added one after another in the order of a column, whatever the order of rows. Rows are sorted and pass a window,
    which keeps a running sum and no group."""
    upto = F.sum(value).over(Window.partitionBy(keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.select(*keys, order, upto.alias(name)).groupBy(keys).agg(F.max_by(name, order).alias(name))


def usage_by_capability(usage: DataFrame, order: str | None = None) -> DataFrame:
    """Units as their decimals add up or, with order, as doubles do in the order of that column."""
    keys = ["job_id", "capability", "unit_type"]
    if order is None:
        return usage.groupBy(keys).agg(exact_sum(F.col("units")).alias("units"))
    return added_in_order(usage, keys, F.col("units"), order, "units")


def usage_nested(usage: DataFrame, order: str | None = None) -> DataFrame:
    """capability -> unit_type -> units as maps. The number of entries is that of the vocabulary, not of rows."""
    inner = usage_by_capability(usage, order).groupBy("job_id", "capability").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("unit_type", "units")))).alias("units"))
    return inner.groupBy("job_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("capability", "units")), lambda a, b: F.when(a["capability"] < b["capability"], -1).otherwise(1))).alias("by_capability"))


def with_cost(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """Cost of each usage row: 0 on a cache hit, else units times the price of its unit."""
    cost = F.when(F.col("cache_hit"), 0.0).otherwise(F.col("units") * F.coalesce("price", F.lit(0.0)))
    return usage.drop("cost_usd").join(prices, ["family", "unit_type"], "left").withColumn("cost_usd", F.round(cost, 6)).drop("price")


def events_after(events: DataFrame, after: int, limit: int, job_id: str | None = None) -> DataFrame:
    """A page of the log by key: the filter reaches the scan, the limit is a top-k."""
    own = events if job_id is None else events.where(F.col("job_id") == job_id)
    return own.where(F.col("id") > after).orderBy("id").limit(limit)


def latest_jobs(jobs: DataFrame, limit: int) -> DataFrame:
    return jobs.orderBy(F.desc("created_at"), F.desc("id")).limit(limit)


def current_rows(changes: DataFrame, key: str = "id", at: str = "updated_at") -> DataFrame:
    """The last version of each row of an append-only table of changes; ties by all columns."""
    rest = [c for c in changes.columns if c not in (key, at)]
    last = changes.groupBy(key).agg(F.max(F.struct(at, *rest)).alias("_last"))
    return last.select(key, f"_last.{at}", *[f"_last.{c}" for c in rest])


def overall_progress(stages: DataFrame, order: str | None = None) -> DataFrame:
    """Weighted progress in percent from (job_id, stage, state, done, total). The sum is rounded to 12 places first: its error is below that, so that a
    half rounds up whatever the order of the stages. With order, doubles add up in the order of that column, and a half is what ten times their sum shows."""
    weight = F.create_map(*[F.lit(x) for pair in zip(STAGES, STAGE_WEIGHTS, strict=True) for x in pair])[F.col("stage")]
    share = F.when(F.col("state").isin("done", "skipped"), 1.0).when(F.col("total") > 0, F.least(F.lit(1.0), F.col("done") / F.col("total"))).otherwise(0.0)
    if order is None:
        return stages.groupBy("job_id").agg(F.round(F.round(F.least(F.lit(100.0), F.sum(weight * share)), 12), 1).alias("percent"))
    told = added_in_order(stages, ["job_id"], weight * share, order, "percent")
    return told.select("job_id", (F.round(F.least(F.lit(100.0), "percent") * 10) / 10).alias("percent"))


def new_job_stages(jobs: DataFrame) -> DataFrame:
    """Five pending stages for each job."""
    stage = F.posexplode(F.array(*[F.lit(s) for s in STAGES])).alias("ordinal", "stage")
    return jobs.select(F.col("id").alias("job_id"), stage).select("job_id", "ordinal", "stage", F.lit("pending").alias("state"), F.lit(0).alias("done"), F.lit(0).alias("total"), F.lit(0).alias("attempts"))


def reset_stages_from(stages: DataFrame, start: str) -> DataFrame:
    again = F.array_position(F.array(*[F.lit(s) for s in STAGES]), F.col("stage")) >= STAGES.index(start) + 1
    return stages.withColumns({"state": F.when(again, "pending").otherwise(F.col("state")), "done": F.when(again, 0).otherwise(F.col("done")), "total": F.when(again, 0).otherwise(F.col("total"))})


def requeue_orphans(jobs: DataFrame) -> DataFrame:
    """Jobs that a stopped worker left running are queued again."""
    return jobs.withColumn("status", F.when(F.col("status") == "running", "queued").otherwise(F.col("status")))


def without_jobs(table: DataFrame, gone: DataFrame, key: str = "job_id") -> DataFrame:
    """A table without the rows of deleted jobs (their ids in column id)."""
    return table.join(gone.select(F.col("id").alias(key)), key, "left_anti")


def newest_job(jobs: DataFrame, digests: DataFrame) -> DataFrame:
    """(source_sha256, id): the newest job made from each of the files in digests (source_sha256)."""
    own = jobs.join(digests.select("source_sha256").distinct(), "source_sha256", "left_semi")
    return own.groupBy("source_sha256").agg(F.max_by("id", F.struct("created_at", "id")).alias("id"))


def running_floor(jobs: DataFrame, own_id: str) -> DataFrame:
    """floor: when the first of the other running jobs began, null without any."""
    return jobs.where((F.col("id") != own_id) & (F.col("status") == "running")).agg(F.min("started_at").alias("floor"))


def set_stages(stages: DataFrame, changes: DataFrame) -> DataFrame:
    """stages (job_id, stage, state, attempts, started_at, finished_at) after changes (job_id, stage, state, ts): a stage that starts to run counts
    one more attempt and forgets its end, one that is done, failed or skipped gets its end."""
    new = changes.select("job_id", "stage", F.col("state").alias("_state"), "ts")
    runs, ends = F.col("_state") == "running", F.col("_state").isin("done", "failed", "skipped")
    done = stages.join(new, ["job_id", "stage"], "left").withColumns({
        "attempts": F.col("attempts") + F.coalesce(runs.cast("int"), F.lit(0)),
        "started_at": F.when(runs, F.col("ts")).otherwise(F.col("started_at")),
        "finished_at": F.when(runs, None).when(ends, F.col("ts")).otherwise(F.col("finished_at")),
        "state": F.coalesce("_state", "state"),
    })
    return done.select(*stages.columns)


def numbered_events(new: DataFrame, after: int, order: list[str]) -> DataFrame:
    """new with id: after + 1, after + 2, ... in the order of its columns, dense and the same in every run. Rows are sorted in
    ranges, and each range is numbered behind the rows of those before it."""
    names = ["_at", "_part"]
    ranged = new.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(names[0], F.monotonically_increasing_id()).withColumn(names[1], F.shiftright(names[0], 33))
    per = ranged.groupBy(names[1]).agg(F.count("*").alias("_n"))  # a row for each partition
    before = per.select(names[1], (F.sum("_n").over(Window.orderBy(names[1])) - F.col("_n")).alias("_before"))
    own = F.col(names[0]) - F.shiftleft(F.col(names[1]), 33)
    return ranged.join(F.broadcast(before), names[1]).withColumn("id", F.lit(after) + F.col("_before") + own + 1).select("id", *new.columns)


def lru_prune(entries: DataFrame, cap: int, floor=None) -> DataFrame:
    """Entries to delete, oldest first, until those kept take at most cap bytes; entries used at or after `floor`
    are spared, and a cap of 0 means no limit. Columns: key, bytes, used_at.

    Entries are read once to total them by second. From these totals come the day, and in it the second, in which the total passes the
    cap; all older ones go by a range of used_at, which reaches the scan. Only that second's entries are looked at row by row: sorted in ranges, and
    each range's rows counted behind those of the ranges before it."""
    if cap == 0:
        return entries.limit(0)
    seconds = stored(entries.groupBy(F.date_trunc("second", "used_at").alias("at")).agg(F.sum("bytes").alias("n")), "seconds")

    def passing(totals: DataFrame, newer: int):
        upto = F.sum("n").over(Window.orderBy(F.desc("at")))
        told = totals.withColumn("newer", F.lit(newer) + upto - F.col("n"))
        return told.where((F.col("newer") <= cap) & (F.col("newer") + F.col("n") > cap)).orderBy("at").first()

    day = passing(seconds.groupBy(F.date_trunc("day", "at").alias("at")).agg(F.sum("n").alias("n")), 0)
    if day is None:
        return entries.limit(0)
    second = passing(seconds.where(F.date_trunc("day", "at") == F.lit(day["at"])), day["newer"])
    low = F.lit(second["at"]).cast(entries.schema["used_at"].dataType)
    high = F.lit(second["at"] + timedelta(seconds=1)).cast(entries.schema["used_at"].dataType)
    order = [F.desc("used_at"), F.desc("key")]
    own, part, before = "_own", "_part", "_before"
    ranged = entries.where((F.col("used_at") >= low) & (F.col("used_at") < high)).repartitionByRange(*order).withColumn(part, F.spark_partition_id())
    ranged = stored(ranged, "last-second")
    sizes = ranged.groupBy(part).agg(F.sum("bytes").alias("_n"))  # a row for each partition
    placed = ranged.join(F.broadcast(sizes.select(part, (F.sum("_n").over(Window.orderBy(part)) - F.col("_n")).alias(before))), part)
    within = F.sum("bytes").over(Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    last = placed.withColumn(own, within).where(F.col(own) + F.col(before) + second["newer"] > cap).select(*entries.columns)
    gone = entries.where(F.col("used_at") < low).unionByName(last)
    return gone if floor is None else gone.where(F.col("used_at") < floor)


def usage_details(usage: DataFrame, column: str, schema: str) -> DataFrame:
    """Of each job, how many usage rows it has (n) and the sum of each number that their JSON column holds by the schema; what is no such JSON adds nothing."""
    told = usage.select("job_id", F.from_json(column, schema).alias("_told"))
    return told.groupBy("job_id").agg(F.count("*").alias("n"), *[F.sum(F.col("_told")[f.name]).alias(f.name) for f in told.schema["_told"].dataType.fields])


def write_clustered(rows: DataFrame, path: str, key: str, partitions: int | None = None) -> None:
    """rows as Parquet in ranges of the key, sorted by it, with a Bloom filter for it: a look-up of one key opens the files whose range has it, and
    in them the row groups whose filter does."""
    ranged = rows.repartitionByRange(partitions, key) if partitions else rows.repartitionByRange(key)
    named = {f"parquet.bloom.filter.enabled#{key}": "true", f"parquet.bloom.filter.expected.ndv#{key}": "100000"}
    ranged.sortWithinPartitions(key).write.options(**named).mode("overwrite").parquet(path)


def write_bucketed(rows: DataFrame, table: str, key: str, buckets: int) -> None:
    """rows as a table in buckets of the key, sorted by it: two such tables with as many buckets join by it without a shuffle."""
    rows.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).mode("overwrite").saveAsTable(table)
