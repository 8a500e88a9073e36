"""The ledger as a stream: tailing an append-only log, and totals as they grow (an extension of the batch queries)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from folio.schema import BOOK_TABLES


def tail_events(spark: SparkSession, path: str, schema: str = BOOK_TABLES["usage_events"]) -> DataFrame:
    """New rows of a folder of Parquet files; the query's checkpoint remembers what was read."""
    return spark.readStream.schema(schema).parquet(path)


def pending_once(submitted: DataFrame, key: str = "job_id", at: str = "ts", within: str = "1 hour") -> DataFrame:
    """Submissions without those of a key seen shortly before."""
    return submitted.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, within).dropDuplicatesWithinWatermark([key])


def running_usage(events: DataFrame) -> DataFrame:
    return events.groupBy("job_id", "capability").agg(F.sum("units").alias("units"), F.round(F.sum("cost_usd"), 6).alias("cost_usd"), F.count_if("cache_hit").alias("hits"))


def usage_by_window(events: DataFrame, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", window), "capability").agg(F.sum("units").alias("units"), F.count("*").alias("n"))


def each_batch(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Everything that is there, batch by batch, then an end: chapters are rendered as they arrive."""
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def publish_chapters(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Finished chapters (book_id, ch, ...) as Parquet by book and chapter, as they come: a batch replaces the chapters that it has and no others, so that one that is
    run again, or a chapter that is rendered anew, leaves no second copy."""

    def write(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("book_id", "ch").parquet(path)

    return each_batch(stream, write, checkpoint)


STAGE_STATE = "state string, attempts int, started_at long, finished_at long, seq long"
STAGE_ROWS = f"job_id string, stage string, {STAGE_STATE}"


class StageMachine(StatefulProcessor):
    """The state of each stage of a job, from changes (stage, state, ts, seq) of any batch: a start counts an attempt and clears the end, an end has its time, and a change
    that comes late (a lesser seq than one that was seen) tells nothing. A job without a change for `idle_ms` of event time is forgotten."""

    def __init__(self, idle_ms: int | None = None):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.stages = handle.getMapState("stages", "stage string", STAGE_STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        told: dict[str, tuple] = {}
        for change in pd.concat(list(rows)).sort_values("seq").itertuples(index=False):
            own = (change.stage,)
            state, attempts, started, finished, seq = self.stages.getValue(own) if self.stages.containsKey(own) else ("pending", 0, None, None, -1)
            if change.seq <= seq:
                continue
            if change.state == "running":
                attempts, started, finished = attempts + 1, int(change.ts), None
            elif change.state in ("done", "failed", "skipped"):
                finished = int(change.ts)
            value = (change.state, attempts, started, finished, int(change.seq))
            self.stages.updateValue(own, value)
            told[change.stage] = value
        if self.idle_ms is not None:
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            self.handle.registerTimer(timerValues.getCurrentWatermarkInMs() + self.idle_ms)
        yield pd.DataFrame([(key[0], stage, *value) for stage, value in told.items()], columns=["job_id", "stage", "state", "attempts", "started_at", "finished_at", "seq"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.stages.clear()
        yield pd.DataFrame([], columns=["job_id", "stage", "state", "attempts", "started_at", "finished_at", "seq"])

    def close(self) -> None:
        pass


def stage_states(changes: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """Stages of jobs (see STAGE_ROWS) as they change, from a stream of changes (job_id, stage, state, ts: milliseconds, seq). State is kept for each job and comes back from the query's
    checkpoint; it needs the RocksDB state store (see `rocksdb`). idle_ms needs a watermark on the stream."""
    return changes.groupBy("job_id").transformWithStateInPandas(StageMachine(idle_ms), STAGE_ROWS, "Update", "None" if idle_ms is None else "EventTime")


def rocksdb(spark: SparkSession) -> None:
    """The state store that keyed state needs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
