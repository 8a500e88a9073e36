"""WAV files as a data source of Spark: `spark.read.format("wav")` and `df.write.format("wav")`, once `register` was called.

Reading deals the files in groups to tasks, and opens only those that a filter on the name leaves; without samples asked for (option samples=false) only headers are
read. Writing stages each task's files under a hidden folder; they are moved to their names when all tasks are done, so that a failed job leaves nothing. The folder
must be one that the driver and all executors share.
"""

from __future__ import annotations

import os
import shutil
import uuid
import wave
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

SCHEMA = "name string, rate int, samples array<smallint>"
#: Bytes of the files that a task reads, about.
GROUP_BYTES = 64 << 20


@dataclass
class Files(InputPartition):
    paths: list[str]


class WavReader(DataSourceReader):
    def __init__(self, path: str, samples: bool):
        self.path, self.samples, self.names = path, samples, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("name",):
                self._only({f.value})
            elif isinstance(f, In) and f.attribute == ("name",):
                self._only(set(f.value))
            else:
                yield f

    def _only(self, names: set[str]) -> None:
        self.names = names if self.names is None else self.names & names

    def partitions(self) -> list[Files]:
        found = sorted(n for n in os.listdir(self.path) if n.endswith(".wav") and not n.startswith("."))
        groups, size = [[]], 0
        for name in found:
            if self.names is not None and name[:-4] not in self.names:
                continue
            path = os.path.join(self.path, name)
            if groups[-1] and size + os.path.getsize(path) > GROUP_BYTES:
                groups.append([])
                size = 0
            groups[-1].append(path)
            size += os.path.getsize(path)
        return [Files(g) for g in groups]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        for path in partition.paths:
            with wave.open(path) as f:
                if (f.getnchannels(), f.getsampwidth()) != (1, 2):
                    raise ValueError(f"{path}: not mono with 16 bits a sample")
                samples = np.frombuffer(f.readframes(f.getnframes()), "<i2") if self.samples else None
                columns = [pa.array([os.path.basename(path)[:-4]]), pa.array([f.getframerate()], pa.int32()), pa.array([samples], pa.list_(pa.int16()))]
            yield pa.RecordBatch.from_arrays(columns, ["name", "rate", "samples"])


@dataclass
class Staged(WriterCommitMessage):
    files: list[tuple[str, str]]


class WavWriter(DataSourceWriter):
    def __init__(self, path: str):
        self.path, self.staging = path, os.path.join(path, f".staged-{uuid.uuid4().hex}")

    def write(self, iterator: Iterator) -> Staged:
        os.makedirs(self.staging, exist_ok=True)
        files = []
        for row in iterator:
            part = os.path.join(self.staging, uuid.uuid4().hex)
            with wave.open(part, "wb") as f:
                f.setnchannels(1)
                f.setsampwidth(2)
                f.setframerate(row.rate)
                f.writeframes(np.asarray(row.samples, "<i2").tobytes())
            files.append((part, f"{row.name}.wav"))
        return Staged(files)

    def commit(self, messages: list[Staged | None]) -> None:
        for message in messages:
            for part, name in message.files if message else ():
                os.replace(part, os.path.join(self.path, name))
        shutil.rmtree(self.staging, ignore_errors=True)

    def abort(self, messages: list[Staged | None]) -> None:
        shutil.rmtree(self.staging, ignore_errors=True)


class Wav(DataSource):
    @classmethod
    def name(cls) -> str:
        return "wav"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WavReader:
        return WavReader(self.options["path"], self.options.get("samples", "true").lower() == "true")

    def writer(self, schema: StructType, overwrite: bool) -> WavWriter:
        os.makedirs(self.options["path"], exist_ok=True)
        return WavWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Wav)
