"""``format("pcap")``: captures read once or as they grow, and written.

``register(spark)`` first. Files are those that Arrow's file systems reach from every executor; for
stores that only Spark's readers reach, use ``read_pcap(..., whole=True)``. A file is read in
blocks and never whole.

- ``spark.read``: columns are flat (``tcp_dst_port``, ``ip_src``, …), so Spark pushes equality on them
  into the decoder.
- ``spark.readStream``: the offset is a byte position for each file, so packets that a running
  capture appends come as they are written, and a restarted query goes on where it stopped.
- ``df.write``: ``timestamp_ns`` and ``frame`` (an Ethernet frame) to one capture for each task.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from .bulk import Tests, decoded
from .packets import FIELDS, HEADER, Capture, file_header, packet_record, raw_packets
from .pcap import _ARROW
from .store import listed, opened, resolve

COLUMNS = (("type", "string"), ("timestamp_ns", "long"), ("path", "string"), *FIELDS)
_SCHEMA = pa.schema([(n, _ARROW[t]) for n, t in COLUMNS])


def _path(options: dict) -> str:
    if not options.get("path"):
        raise ValueError("the pcap format needs a path")
    return options["path"]


def _batches(found: Iterator[tuple[pa.Array, dict[str, pa.Array]]], path: str) -> Iterator[pa.RecordBatch]:
    for times, columns in found:
        same = [pa.array([x] * len(times), pa.string()) for x in ("network", path)]
        yield pa.RecordBatch.from_arrays([same[0], times, same[1], *columns.values()], schema=_SCHEMA)


class PcapReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.interface = _path(options), options.get("interface")
        self.tests: Tests = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes equality and membership on one column as a hint; Spark applies every filter again."""
        for f in filters:
            if isinstance(f, EqualTo) and len(f.attribute) == 1:
                self.tests.append((f.attribute, (f.value,)))
            elif isinstance(f, In) and len(f.attribute) == 1:
                self.tests.append((f.attribute, tuple(f.value)))
            yield f

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(path) for path, _ in listed(self.path)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        with opened(partition.value) as f:
            yield from _batches(decoded(f, self.interface, self.tests), partition.value)


@dataclass
class Range(InputPartition):
    """Packets of ``path`` that start in ``start:stop``, both of which are ends of packets."""

    path: str
    start: int
    stop: int


class PcapStreamReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path, self.interface = _path(options), options.get("interface")
        self.known: dict[str, tuple[int, int]] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        now = {}
        for path, size in listed(self.path):
            seen, end = self.known.get(path, (0, 0))
            if size < seen:
                end = 0
            if size != seen:
                end = self._whole(path, end)
            now[path] = (size, end)
        self.known = now
        return {path: end for path, (_, end) in now.items()}

    @staticmethod
    def _whole(path: str, end: int) -> int:
        """The end of the last whole packet, looking from ``end`` on."""
        with opened(path) as f:
            header = f.read(HEADER)
        if len(header) < HEADER:
            return 0
        capture, end = Capture.of(header), end or HEADER
        with opened(path, end) as f:
            for after, _, _, _ in raw_packets(f, capture, end):
                end = after
        return end

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        out = []
        for path, stop in sorted(end.items()):
            at = start.get(path, 0)
            at = HEADER if at > stop or not at else at
            if at < stop:
                out.append(Range(path, at, stop))
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        with opened(partition.path) as f:
            capture = Capture.of(f.read(HEADER))
        with opened(partition.path, partition.start) as f:
            yield from _batches(decoded(f, self.interface, [], capture, partition.start, partition.stop), partition.path)


@dataclass
class Written(WriterCommitMessage):
    path: str


class PcapWriter(DataSourceArrowWriter):
    """Files appear under their names only when the whole write is committed, so a task that is tried again leaves no second one."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = _path(options), overwrite

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        fs, folder = resolve(self.path)
        fs.create_dir(folder, recursive=True)
        at = f"{folder}/.{uuid.uuid4().hex}.pcap"
        with fs.open_output_stream(at, compression=None) as out:
            out.write(file_header())
            for batch in batches:
                times, frames = batch.column(batch.schema.get_field_index("timestamp_ns")), batch.column(batch.schema.get_field_index("frame"))
                for ns, frame in zip(times.to_pylist(), frames, strict=True):
                    if ns is not None and frame.is_valid:
                        out.write(packet_record(ns, frame.as_py()))
        return Written(at)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, folder = resolve(self.path)
        new = [m.path for m in messages if m is not None]
        if self.overwrite:
            for f in fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True)):
                if f.type == pafs.FileType.File and f.path not in new:
                    fs.delete_file(f.path)
        for i, path in enumerate(new):
            fs.move(path, f"{folder}/part-{i:05}-{path.rpartition('/.')[2]}")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, _ = resolve(self.path)
        for m in messages:
            if m is not None:
                fs.delete_file(m.path)


class PcapDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pcap"

    def schema(self) -> str:
        return ", ".join(f"`{n}` {t}" for n, t in COLUMNS)

    def reader(self, schema: StructType) -> PcapReader:
        return PcapReader(self.options)

    def streamReader(self, schema: StructType) -> PcapStreamReader:
        return PcapStreamReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> PcapWriter:
        if not {"timestamp_ns", "frame"} <= set(schema.fieldNames()):
            raise ValueError("a capture is written from the columns timestamp_ns and frame")
        return PcapWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Makes the format known to the session, and lets Spark push predicates into its reader."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PcapDataSource)
