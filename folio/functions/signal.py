"""Signals: arrays of samples in -1..1. Cheap ones are expressions; filters and mixes run in Arrow batches."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F, types as T

FLOOR_DB = -120.0
#: Length of a mix's buckets; buckets that a task holds; groups in which a bucket's partial sums are added first.
BUCKET_MS = 10_000
HELD = 64
SALTS = 32


def db_to_gain(db: Column) -> Column:
    return F.pow(F.lit(10.0), db / 20)


def dbfs(x: Column) -> Column:
    return 20 * F.log10(F.greatest(x, F.lit(1e-6)))


def rms(samples: Column) -> Column:
    total = F.aggregate(samples, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return F.when(F.size(samples) > 0, F.sqrt(total / F.size(samples))).otherwise(0.0)


def rms_dbfs(samples: Column) -> Column:
    return dbfs(rms(samples))


def rms_envelope(samples: Column, frame: int) -> Column:
    """RMS of each frame; the last one is filled up with zeros."""
    n = F.ceil(F.size(samples) / frame).cast("int")
    square = lambda part: F.aggregate(part, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.sqrt(square(F.slice(samples, i * frame + 1, F.lit(frame))) / frame))).otherwise(F.array().cast("array<double>"))


def soft_limit(samples: Column, ceiling: float = 0.891, knee: float = 0.7) -> Column:
    """Samples above the knee bend towards the ceiling along tanh."""
    room = ceiling - knee
    return F.transform(samples, lambda x: F.when(F.abs(x) <= knee, x.cast("double")).otherwise(F.signum(x) * (knee + room * F.tanh((F.abs(x) - knee) / room))))


def to_int16(samples: Column) -> Column:
    return F.transform(samples, lambda x: F.bround(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x.cast("double"))) * 32767).cast("smallint"))


def to_float(samples: Column) -> Column:
    return F.transform(samples, lambda x: x / F.lit(32768.0))


def envelope(x: np.ndarray, frame: int) -> np.ndarray:
    n = -(-len(x) // frame)
    return np.sqrt((np.pad(x, (0, n * frame - len(x))).reshape(n, frame) ** 2).mean(1)) if n else np.zeros(0)


def trim_silence(x: np.ndarray, rate: int, threshold_db: float = -45.0, keep_ms: int = 40) -> np.ndarray:
    """x without what lies before its first and after its last loud frame but for keep_ms; as it is without a loud frame."""
    frame = max(1, rate // 100)
    loud = np.flatnonzero(20 * np.log10(np.maximum(envelope(x, frame), 1e-6)) > threshold_db)
    if not len(loud):
        return x
    keep = rate * keep_ms // 1000
    return x[max(0, loud[0] * frame - keep) : min(len(x), (loud[-1] + 1) * frame + keep)]


def normalize_rms(x: np.ndarray, rate: int, target_db: float = -20.0, most_db: float = 12.0, peak_db: float = -1.0) -> np.ndarray:
    frames = envelope(x, max(1, rate // 100))
    voiced = frames[frames > 10 ** (-50 / 20)]
    if not len(voiced):
        return x
    gain = min(10 ** (target_db / 20) / math.sqrt((voiced**2).mean()), 10 ** (most_db / 20), 10 ** (peak_db / 20) / max(np.abs(x).max(), 1e-9))
    return x * gain


def fade(x: np.ndarray, rate: int, in_ms: int, out_ms: int) -> np.ndarray:
    x = x.copy()
    a, b = min(len(x), rate * in_ms // 1000), min(len(x), rate * out_ms // 1000)
    x[:a] *= np.linspace(0, 1, a, endpoint=False)
    x[len(x) - b :] *= np.linspace(1, 0, b)
    return x


def loop_to_length(x: np.ndarray, n: int, overlap: int) -> np.ndarray:
    """x again and again, each time faded into the next at equal power."""
    if not len(x) or n <= len(x):
        return x[:n] if len(x) else np.zeros(n)
    overlap = min(overlap, len(x) // 2)
    t = np.linspace(0, math.pi / 2, overlap)
    out, at = np.zeros(n + 2 * len(x)), 0
    out[: len(x)] = x
    while at + len(x) < n:
        at += len(x) - overlap
        out[at : at + overlap] = out[at : at + overlap] * np.cos(t) + x[:overlap] * np.sin(t)
        out[at + overlap : at + len(x)] = x[overlap:]
    return out[:n]


def resample(x: np.ndarray, rate: int, to: int) -> np.ndarray:
    """Linear interpolation; before a lower rate a windowed-sinc filter takes what it could not hold."""
    if rate == to or not len(x):
        return x
    if to < rate:
        k = np.arange(-50, 51)
        taps = np.sinc(k * to / rate) * np.kaiser(101, 8.0)
        x = np.convolve(x, taps / taps.sum(), mode="same")
    n = max(1, round(len(x) * to / rate))
    return np.interp(np.arange(n) * rate / to, np.arange(len(x)), x)


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal values begin, and how long each is."""
    begins = np.flatnonzero(np.append(True, values[1:] != values[:-1])[: len(values)])
    return begins, np.diff(np.append(begins, len(values)))


def pauses(busy: np.ndarray, least: int) -> np.ndarray:
    """Whether each frame lies in a run of at least `least` frames that are not busy."""
    _, lengths = _runs(busy)
    return ~busy & (np.repeat(lengths, lengths) >= least)


def soon(flags: np.ndarray, frames: int) -> np.ndarray:
    """Whether a frame or one of the next `frames` is set: a difference of running counts."""
    counts = np.concatenate([[0], np.cumsum(flags)])
    last = np.minimum(np.arange(len(flags)) + frames + 1, len(flags))
    return counts[last] > counts[:-1]


def glide(goal: np.ndarray, down: float, up: float) -> np.ndarray:
    """A level that follows its goal: each frame keeps the share `down` or `up` of the way that is left. While a goal holds, what is left shrinks as a
    power, so each run of equal goals is worked out at once from the level before it."""
    level, parts = goal[0] if len(goal) else 0.0, [np.zeros(0)]
    begins, lengths = _runs(goal)
    for at, n in zip(begins.tolist(), lengths.tolist(), strict=True):
        aim = goal[at]
        parts.append(aim + (level - aim) * np.power(down if aim < level else up, np.arange(1, n + 1)))
        level = parts[-1][-1]
    return np.concatenate(parts)


def duck_gain(speaks: np.ndarray, depth_db: float, boost_db: float = 0.0, least_gap_ms: int = 0, held: np.ndarray | None = None, frame_ms: int = 20, attack_ms: int = 40, release_ms: int = 600, ahead_ms: int = 60) -> np.ndarray:
    """Gain of a bed in each frame: depth_db lower while a voice speaks (from ahead_ms before it on) or something else is held, boost_db
    higher in pauses of least_gap_ms or more. The gain glides: fast down, slowly up."""
    frames = lambda ms: math.ceil(ms / frame_ms)
    busy = soon(speaks, frames(ahead_ms)) | (np.zeros(len(speaks), bool) if held is None else held)
    quiet, loud = 10 ** (-abs(depth_db) / 20), 10 ** (boost_db / 20)
    return glide(np.where(pauses(busy, frames(least_gap_ms)), loud, quiet), math.exp(-frame_ms / attack_ms), math.exp(-frame_ms / release_ms))


def map_samples(rows: DataFrame, function: Callable[[np.ndarray], np.ndarray], column: str = "samples") -> DataFrame:
    """rows with each array of samples replaced by the function of it; null stays null."""
    kind = T.ArrayType(T.DoubleType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(column)
            for k in range(batch.num_rows):  # one row's samples at a time
                own = lists[k].values
                out = pa.array([None if own is None else function(own.to_numpy(zero_copy_only=False).astype(np.float64))], pa.list_(pa.float64()))
                row = batch.slice(k, 1)
                yield row.set_column(row.schema.get_field_index(column), column, out)

    return rows.mapInArrow(run, T.StructType([T.StructField(f.name, kind) if f.name == column else f for f in rows.schema.fields]))


def mix_tracks(placed: DataFrame, rate: int, bucket_ms: int = BUCKET_MS) -> DataFrame:
    """(book_id, ch, track, bucket, start, samples) from placements (start_ms, gain_db, samples): the sum of a track's clips
    in fixed buckets of time. `start` is the bucket's first sample; samples end with the last one placed in the bucket, and what
    is missing is silence. Clips are cut at the buckets and summed where they are read, so that a task holds HELD buckets at
    most; the sums of a bucket are then added in two steps, however many clips overlap there."""
    size = max(1, bucket_ms * rate // 1000)
    keys = ["book_id", "ch", "track", "bucket"]
    schema = "book_id string, ch int, track string, bucket long, salt int, samples array<double>"
    first = F.floor(F.col("start_ms").cast("long") * rate / 1000)
    cut = placed.where(F.size("samples") > 0).withColumn("first", first).withColumn("last", F.col("first") + F.size("samples") - 1)
    cut = cut.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("first") / size), F.floor(F.col("last") / size))))
    low, high = F.greatest("first", F.col("bucket") * size), F.least("last", F.col("bucket") * size + size - 1)
    cut = cut.select(
        "book_id", F.col("ch").cast("int").alias("ch"), "track", "bucket", (low - F.col("bucket") * size).cast("int").alias("offset"),
        db_to_gain(F.col("gain_db")).alias("gain"), F.slice("samples", (low - F.col("first") + 1).cast("int"), (high - low + 1).cast("int")).cast("array<double>").alias("samples"),
    )

    def rows(held: dict[tuple, np.ndarray], salt: int) -> pa.RecordBatch:
        at = list(held)
        columns = [pa.array([k[i] for k in at], kind) for i, kind in enumerate((pa.string(), pa.int32(), pa.string(), pa.int64()))]
        return pa.RecordBatch.from_arrays([*columns, pa.array([salt] * len(at), pa.int32()), pa.array(list(held.values()), pa.list_(pa.float64()))], [*keys, "salt", "samples"])

    def add(held: dict[tuple, np.ndarray], key: tuple, offset: int, clip: np.ndarray) -> None:
        end = offset + len(clip)
        old = held.get(key, clip[:0])
        if len(old) < end:
            old = np.concatenate([old, np.zeros(end - len(old))])
        old[offset:end] += clip
        held[key] = old

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        salt = TaskContext.get().partitionId() % SALTS
        for batch in batches:
            columns = [batch.column(n) for n in (*keys, "offset", "gain", "samples")]
            for k in range(batch.num_rows):
                *key, offset, gain = (c[k].as_py() for c in columns[:-1])
                add(held, tuple(key), offset, columns[-1][k].values.to_numpy(zero_copy_only=False) * gain)
                if len(held) >= HELD:
                    yield rows(held, salt)
                    held = {}
        if held:
            yield rows(held, salt)

    def total(table: pa.Table) -> pa.Table:
        held: dict[tuple, np.ndarray] = {}
        key = tuple(table.column(n)[0].as_py() for n in keys)
        for clip in table.column("samples"):
            add(held, key, 0, clip.values.to_numpy(zero_copy_only=False))
        return pa.Table.from_batches([rows(held, 0)])

    summed = cut.mapInArrow(partial, schema).groupBy(*keys, "salt").applyInArrow(total, schema).groupBy(*keys).applyInArrow(total, schema)
    return summed.select("book_id", "ch", "track", "bucket", (F.col("bucket") * size).alias("start"), "samples")
