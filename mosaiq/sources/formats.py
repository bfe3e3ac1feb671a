"""Data sources of the library: motion arrays and wav files read in parts, and records written as XML with commit."""

from __future__ import annotations

import json
import struct
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.sax.saxutils import escape, quoteattr

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, DataFrameReader, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

MARKER = "tx ty tz qx qy qz qw".split()
#: Rows of a batch, and samples of a partition of a wav file.
ROWS, SAMPLES = 1 << 16, 1 << 22


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def listed(path: str, suffix: str) -> list[str]:
    """The files under a folder with a suffix, in order, or the file itself; as paths of the file system."""
    system, p = located(path)
    if system.get_file_info(p).type == fs.FileType.Directory:
        return sorted(x.path for x in system.get_file_info(fs.FileSelector(p, recursive=True)) if x.path.endswith(suffix))
    return [p]


class _Pruned(DataSourceReader):
    """Takes filters for single values of ``column``, so that other values' partitions aren't made."""

    column = ""

    def __init__(self) -> None:
        self.wanted: set | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if values is None or f.attribute != (self.column,):
                yield f
                continue
            self.wanted = values if self.wanted is None else self.wanted & values

    def has(self, value) -> bool:
        return self.wanted is None or value in self.wanted


@dataclass
class Member(InputPartition):
    path: str
    member: str
    record_id: int
    labels: list[int]


class MotionSource(DataSource):
    """``spark.read.format("mosaiq_motion").option("meta", ...).load(npz)``: a row for each record, frame and marker.

    ``meta`` is a JSON file with ``marker_names`` and ``records`` of ``data_id`` and ``labels``; the arrays (frames x
    markers x 7) are members of npz files, one of them or a folder. Each record is a partition, so that
    one file is read by as many tasks as it has records, and a task holds one record's array. Filters for
    values of ``record_id`` leave the others' partitions out. Option ``samples``, if given, is the number of
    records that there must be.
    """

    @classmethod
    def name(cls) -> str:
        return "mosaiq_motion"

    def schema(self) -> str:
        return "record_id long, t int, marker string, " + ", ".join(f"{c} double" for c in MARKER) + ", labels array<long>"

    def reader(self, schema: StructType) -> DataSourceReader:
        return MotionReader(dict(self.options))


class MotionReader(_Pruned):
    column = "record_id"

    def __init__(self, options: dict[str, str]):
        super().__init__()
        self.options = options
        system, p = located(options["meta"])
        with system.open_input_file(p) as f:
            self.meta = json.loads(f.read())

    def partitions(self) -> list[InputPartition]:
        system, where = located(self.options["path"])[0], {}
        for path in listed(self.options["path"], ".npz"):
            with system.open_input_file(path) as f, zipfile.ZipFile(f) as z:
                where |= {name.removesuffix(".npy"): path for name in z.namelist()}
        records = self.meta["records"]
        checked(len(records), self.options)
        missing = [r["data_id"] for r in records if r["data_id"] not in where]
        if missing:
            raise ValueError(f"records without an array: {missing[:5]}")
        return [Member(where[r["data_id"]], f"{r['data_id']}.npy", k, r.get("labels") or []) for k, r in enumerate(records) if self.has(k)]

    def read(self, partition: Member) -> Iterator[pa.RecordBatch]:
        system, names = located(self.options["path"])[0], self.meta["marker_names"]
        with system.open_input_file(partition.path) as f, zipfile.ZipFile(f) as z, z.open(partition.member) as member:
            x = np.lib.format.read_array(member)
        step = max(1, ROWS // max(1, x.shape[1]))
        for low in range(0, len(x), step):
            part = x[low : low + step].astype(float)
            t, k = np.indices(part.shape[:2]).reshape(2, -1)
            labels = pa.array([partition.labels] * len(t), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(t), partition.record_id)), pa.array((t + low).astype(np.int32)), pa.array(names).take(pa.array(k)), *(pa.array(part[..., i].ravel()) for i in range(len(MARKER))), labels], names=["record_id", "t", "marker", *MARKER, "labels"])


@dataclass
class Stretch(InputPartition):
    path: str
    rate: int
    at: int
    first: int
    n: int


class WavSource(DataSource):
    """``spark.read.format("mosaiq_wav").load(path)``: rows ``path, rate, first, samples`` of 16-bit mono sounds, in order.

    A file is read in stretches of ``samples_per_task`` samples (4 million if not given), each by a task that reads these bytes
    alone; only headers are read beforehand. Filters for values of ``path`` leave other files out. Option
    ``samples``, if given, is the number of files that there must be.
    """

    @classmethod
    def name(cls) -> str:
        return "mosaiq_wav"

    def schema(self) -> str:
        return "path string, rate int, first long, samples array<int>"

    def reader(self, schema: StructType) -> DataSourceReader:
        return WavReader(dict(self.options))


def wav_header(f) -> tuple[int, int, int]:
    """Rate, place of the first sample's byte, and number of samples of an open 16-bit mono file."""
    riff, _, kind = struct.unpack("<4sI4s", f.read(12))
    if (riff, kind) != (b"RIFF", b"WAVE"):
        raise ValueError("not a wav file")
    rate = None
    while True:
        head = f.read(8)
        if len(head) < 8:
            raise ValueError("a wav file without data")
        name, size = struct.unpack("<4sI", head)
        if name == b"data":
            break
        body = f.read(size + size % 2)
        if name == b"fmt ":
            _, channels, rate, _, _, bits = struct.unpack("<HHIIHH", body[:16])
            if (channels, bits) != (1, 16):
                raise ValueError("only 16-bit mono sounds are read")
    if rate is None:
        raise ValueError("a wav file without a format")
    return rate, f.tell(), size // 2


class WavReader(_Pruned):
    column = "path"

    def __init__(self, options: dict[str, str]):
        super().__init__()
        self.options = options

    def partitions(self) -> list[InputPartition]:
        system, out = located(self.options["path"])[0], []
        files = listed(self.options["path"], ".wav")
        checked(len(files), self.options)
        step = int(self.options.get("samples_per_task", SAMPLES))
        for path in filter(self.has, files):
            with system.open_input_file(path) as f:
                rate, at, n = wav_header(f)
            out += [Stretch(path, rate, at, k, min(step, n - k)) for k in range(0, max(n, 1), step)]
        return out

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        system = located(self.options["path"])[0]
        with system.open_input_file(partition.path) as f:
            f.seek(partition.at + 2 * partition.first)
            x = np.frombuffer(f.read(2 * partition.n), "<i2").astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array([partition.path]), pa.array([partition.rate], pa.int32()), pa.array([partition.first], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x))], names=["path", "rate", "first", "samples"])


def checked(n: int, options: dict[str, str]) -> None:
    """An error unless ``n`` is the number of samples that the options expect."""
    if "samples" in options and int(options["samples"]) != n:
        raise ValueError(f"{n} samples, not {options['samples']}")


@dataclass
class Written(WriterCommitMessage):
    held: str
    final: str
    rows: int


class RecordsSource(DataSource):
    """``records.write.format("mosaiq_records").mode("append").save(folder)``: sound records as XML, and the same format to read them.

    Rows are ``style, audio, transcription, tags``. Each task writes a file of records into a hidden folder of the
    job; only when all tasks have ended are the files moved to their names. If a task fails for good, the
    folder is deleted and nothing stays. Mode ``overwrite`` deletes the earlier files when the job commits.
    """

    @classmethod
    def name(cls) -> str:
        return "mosaiq_records"

    def schema(self) -> str:
        return "style string, audio string, transcription string, tags array<string>"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        if set(schema.names) != {"style", "audio", "transcription", "tags"}:
            raise ValueError("records have style, audio, transcription and tags")
        return RecordsWriter(self.options["path"], overwrite)

    def reader(self, schema: StructType) -> DataSourceReader:
        return RecordsReader(dict(self.options))


def _element(kind: str, text: str | None, **attributes: str | None) -> str:
    inside = "".join(f" {k}={quoteattr(v)}" for k, v in attributes.items() if v is not None)
    return f"<{kind}{inside}/>" if text is None else f"<{kind}{inside}>{text}</{kind}>"


class RecordsWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path, overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        system, folder = located(self.path)
        held = f"{folder}/_temporary-{self.job}"
        system.create_dir(held, recursive=True)
        task = TaskContext.get()
        name, n = f"part-{task.partitionId():05d}-{self.job}.xml", 0
        with system.open_output_stream(f"{held}/{task.taskAttemptId()}-{name}") as f:
            f.write(b'<?xml version="1.0" encoding="UTF-8"?>\n<records>\n')
            for r in iterator:
                text = lambda x: None if x is None else escape(x)
                inside = [_element("audio", text(r["audio"]))] if r["audio"] is not None else []
                inside += [_element("trans", text(r["transcription"]))] if r["transcription"] is not None else []
                inside += [_element("tag", None, name=t) for t in r["tags"] or []]
                f.write((_element("record", "".join(inside), style=r["style"]) + "\n").encode())
                n += 1
            f.write(b"</records>\n")
        return Written(f"{held}/{task.taskAttemptId()}-{name}", f"{folder}/{name}", n)

    def commit(self, messages: list) -> None:
        system, folder = located(self.path)
        if self.overwrite:
            for x in system.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
                if x.path.endswith(".xml"):
                    system.delete_file(x.path)
        for m in messages:
            if m is not None and m.rows:
                system.move(m.held, m.final)
        self._clear()

    def abort(self, messages: list) -> None:
        self._clear()

    def _clear(self) -> None:
        system, folder = located(self.path)
        if system.get_file_info(held := f"{folder}/_temporary-{self.job}").type == fs.FileType.Directory:
            system.delete_dir(held)


class RecordsReader(DataSourceReader):
    """A file is a partition; records are read one by one."""

    def __init__(self, options: dict[str, str]):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in listed(self.options["path"], ".xml") if "/_temporary-" not in p]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        from xml.etree import ElementTree

        with located(self.options["path"])[0].open_input_stream(partition.value) as f:
            for _, e in ElementTree.iterparse(f):
                if e.tag == "record":
                    text = lambda name: None if e.find(name) is None else e.find(name).text or ""  # noqa: B023, E731
                    yield e.get("style"), text("audio"), text("trans"), [t.get("name") for t in e.findall("tag")]
                    e.clear()


SOURCES = {"motion": MotionSource, "wav": WavSource, "records": RecordsSource}


def register(spark: SparkSession) -> None:
    """Makes the formats known to a session, and lets Spark push filters to them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in SOURCES.values():
        spark.dataSource.register(source)


def loader(spark: SparkSession, name: str, **options: str) -> DataFrameReader:
    """A reader by the name of a kind of data, with its options; an unknown name is an error."""
    if name not in SOURCES:
        raise ValueError(f"no loader {name}: {', '.join(SOURCES)}")
    register(spark)
    reader = spark.read.format(SOURCES[name].name())
    for k, v in options.items():
        reader = reader.option(k, str(v))
    return reader


def load(spark: SparkSession, name: str, path: str, **options: str) -> DataFrame:
    return loader(spark, name, **options).load(path)
