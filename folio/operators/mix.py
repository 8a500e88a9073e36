"""Mixing a chapter: clips fitted to their places, beds that give way to the voice, and stems that add up to the mix.

Sound is handled in buckets of S seconds, never as whole tracks. What must be known of a whole chapter (when the voice speaks, and how loud the
mix gets) is a frame every FRAME_MS and one number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from folio.functions import signal

# Frames, speech, and how beds give way to it.
FRAME_MS, SPEECH_DB, ATTACK_MS, RELEASE_MS, AHEAD_MS = 20, -45.0, 40, 600, 60
MUSIC_DUCK_DB, MUSIC_BOOST_DB, MUSIC_GAP_MS, AMBIENT_DUCK_DB = 0.0, 5.0, 1200, 4.0
KNEE_DB, CEILING_DB = -3.0, -1.0
CHAPTER = ["book_id", "ch"]


def fitted_clips(placements: DataFrame, clips: DataFrame, rate: int) -> DataFrame:
    """placements (clip_key, start_ms, end_ms, gain_db, fade_in_ms, fade_out_ms, loop) with the samples of their clip (clip_key, samples), looped or cut
    to the place and faded. Placements of no length, before the start, or of no clip go."""
    told = placements.where((F.col("start_ms") >= 0) & (F.col("end_ms") > F.col("start_ms"))).join(clips.select("clip_key", "samples"), "clip_key")
    schema = told.schema

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [batch.column(n).to_pylist() for n in ("start_ms", "end_ms", "fade_in_ms", "fade_out_ms", "loop")]
            fitted = []
            for start, end, fade_in, fade_out, loop, x in zip(*own, batch.column("samples"), strict=True):
                x, n = np.asarray(x.values.to_numpy(zero_copy_only=False), np.float64), end * rate // 1000 - start * rate // 1000
                fitted.append(signal.fade(signal.loop_to_length(x, n, rate // 2) if loop else x[:n], rate, fade_in, fade_out))
            at = batch.schema.get_field_index("samples")
            yield batch.set_column(at, "samples", pa.array(fitted, batch.schema.field(at).type))

    return told.mapInArrow(fit, schema)


def frame_levels(track: DataFrame, rate: int) -> DataFrame:
    """Buckets of a track with levels: the level in dB of each frame."""
    frame = max(1, FRAME_MS * rate // 1000)
    return track.select(*CHAPTER, "bucket", F.transform(signal.rms_envelope(F.col("samples"), frame), signal.dbfs).alias("levels"))


def duck_curves(voice: DataFrame, impacts: DataFrame, chapters: DataFrame, rate: int, bucket_ms: int = signal.BUCKET_MS) -> DataFrame:
    """(book_id, ch, bucket, music, ambient): gains of beds for each frame of a bucket, with one frame before and one after it, from the buckets
    of the voice and of the impacts. chapters: (book_id, ch, n_buckets). A task holds the frames of one chapter, 50 a second."""
    n_frames = bucket_ms // FRAME_MS
    levels = frame_levels(voice, rate).withColumnRenamed("levels", "voice")
    busy = frame_levels(impacts, rate).withColumnRenamed("levels", "impact")
    every = chapters.select(*CHAPTER, F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_buckets") - 1)).alias("bucket"))
    rows = every.join(levels, [*CHAPTER, "bucket"], "left").join(busy, [*CHAPTER, "bucket"], "left")

    def curves(table: pa.Table) -> pa.Table:
        table = table.sort_by("bucket")

        def loud(name: str) -> np.ndarray:
            out = np.zeros((table.num_rows, n_frames), bool)
            for k, own in enumerate(table.column(name).to_pylist()):
                out[k, : len(own or ())] = np.array(own or (), float) > SPEECH_DB
            return out.ravel()

        speaks, held = loud("voice"), loud("impact")
        music = signal.duck_gain(speaks, MUSIC_DUCK_DB, MUSIC_BOOST_DB, MUSIC_GAP_MS, held, FRAME_MS, ATTACK_MS, RELEASE_MS, AHEAD_MS)
        ambient = signal.duck_gain(speaks, AMBIENT_DUCK_DB, 0.0, 0, None, FRAME_MS, ATTACK_MS, RELEASE_MS, AHEAD_MS)
        cut = lambda x: pa.array(list(np.lib.stride_tricks.sliding_window_view(np.pad(x, 1, mode="edge"), n_frames + 2)[::n_frames]), pa.list_(pa.float64()))
        return pa.table({"book_id": table.column("book_id"), "ch": table.column("ch"), "bucket": table.column("bucket"), "music": cut(music), "ambient": cut(ambient)})

    return rows.groupBy(*CHAPTER).applyInArrow(curves, "book_id string, ch int, bucket long, music array<double>, ambient array<double>")


def mix_chapters(placed: DataFrame, rate: int, bucket_ms: int = signal.BUCKET_MS) -> DataFrame:
    """(book_id, ch, bucket, start, voice, music, sfx, mix, limited): stems and mix of each bucket as 16-bit samples, all of one length, from
    fitted clips (book_id, ch, track: voice, music, sfx or ambient, start_ms, gain_db, samples). sfx holds impacts and ambient beds.

    Music rises where the voice pauses for long, ambient beds fall where it speaks. Where no sample of a chapter's sum passes the ceiling, the mix is
    the sum of the 16-bit stems; else the sum is limited (limited is true for the whole chapter)."""
    tracks = signal.mix_tracks(placed, rate, bucket_ms)
    of = lambda name: tracks.where(F.col("track") == name)
    chapters = tracks.groupBy(*CHAPTER).agg((F.max("bucket") + 1).alias("n_buckets"))
    curves = duck_curves(of("voice"), of("sfx"), chapters, rate, bucket_ms)
    stems = curves
    for name in ("voice", "music", "ambient", "sfx"):
        stems = stems.join(of(name).select(*CHAPTER, "bucket", F.col("samples").alias(f"x_{name}")), [*CHAPTER, "bucket"], "left")
    frame, size = max(1, FRAME_MS * rate // 1000), max(1, bucket_ms * rate // 1000)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {n: [] for n in ("voice", "music", "sfx", "peak")}
            array = lambda name, k: np.zeros(0) if batch.column(name)[k].values is None else batch.column(name)[k].values.to_numpy(zero_copy_only=False)
            for k in range(batch.num_rows):
                raw = {n: array(f"x_{n}", k) for n in ("voice", "music", "ambient", "sfx")}
                n = max(map(len, raw.values()))
                centres = np.arange(-1, len(array("music", k)) - 1) * frame + frame / 2
                gain = {name: np.interp(np.arange(n), centres, array(name, k)) for name in ("music", "ambient")}
                full = {name: np.pad(x, (0, n - len(x))) * gain.get(name, 1.0) for name, x in raw.items()}
                own = {"voice": full["voice"], "music": full["music"], "sfx": full["sfx"] + full["ambient"]}
                for name, x in own.items():
                    out[name].append(x)
                out["peak"].append(float(np.abs(sum(own.values())).max(initial=0.0)))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in (*CHAPTER, "bucket")], *[pa.array(out[k], pa.list_(pa.float64())) for k in ("voice", "music", "sfx")], pa.array(out["peak"], pa.float64())], [*CHAPTER, "bucket", *out])

    added = stems.mapInArrow(add, "book_id string, ch int, bucket long, voice array<double>, music array<double>, sfx array<double>, peak double")
    loudest = added.groupBy(*CHAPTER).agg((F.max("peak") > 10 ** (CEILING_DB / 20)).alias("limited"))
    whole = added.join(loudest, CHAPTER)
    sum_of = lambda columns, zero: F.transform(columns[0], lambda x, i: x + sum((F.coalesce(F.get(c, i), zero) for c in columns[1:]), zero))
    names = ("voice", "music", "sfx")
    quantized = whole.select(*CHAPTER, "bucket", "limited", *[signal.to_int16(F.col(n)).alias(n) for n in names], sum_of([F.col(n) for n in names], F.lit(0.0)).alias("sum"))
    plain = F.transform(sum_of([F.transform(n, lambda x: x.cast("int")) for n in names], F.lit(0)), lambda x: F.least(F.lit(32767), F.greatest(F.lit(-32768), x)).cast("smallint"))
    bent = signal.to_int16(signal.soft_limit(F.col("sum"), 10 ** (CEILING_DB / 20), 10 ** (KNEE_DB / 20)))
    return quantized.select(*CHAPTER, "bucket", (F.col("bucket") * size).alias("start"), *names, F.when(F.col("limited"), bent).otherwise(plain).alias("mix"), "limited")


def finished_clips(clips: DataFrame, rate: int, trim: bool) -> DataFrame:
    """clips (rate, samples) at one rate, without the silence at their ends if trim is set, at the level of speech, as 16-bit samples."""

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = []
            for own, x in zip(batch.column("rate").to_pylist(), batch.column("samples"), strict=True):
                y = signal.resample(np.asarray(x.values.to_numpy(zero_copy_only=False), np.float64), own, rate)
                y = signal.normalize_rms(signal.trim_silence(y, rate) if trim else y, rate)
                done.append(np.round(np.clip(y, -1, 1) * 32767).astype(np.int16))
            at = {n: batch.schema.get_field_index(n) for n in ("rate", "samples")}
            yield batch.set_column(at["rate"], "rate", pa.array([rate] * batch.num_rows, pa.int32())).set_column(at["samples"], "samples", pa.array(done, pa.list_(pa.int16())))

    own = clips.withColumns({"rate": F.col("rate").cast("int"), "samples": F.col("samples").cast("array<double>")})
    schema = ", ".join(f"`{f.name}` {'array<smallint>' if f.name == 'samples' else f.dataType.simpleString()}" for f in own.schema.fields)
    return own.mapInArrow(finish, schema)
