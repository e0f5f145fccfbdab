"""``spark.readStream.format("tail")``: lines of files as they grow.

``register(spark)`` first. The offset of a stream is a byte position for each file, so a restarted query goes on where
it stopped, and lines appended to a file come as they are written. A file that became shorter was
replaced, and is read from its start. Only whole lines are taken: bytes after the last line end wait.

Options: ``path`` (a file, folder, or pattern in the last part), ``startingPosition`` (``start``, or
``end`` to skip what is there when the stream first starts), ``maxBytesPerPartition``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from .store import listed, opened, resolve

BACK = 1 << 16
ROWS = 50_000
_SCHEMA = pa.schema([("path", pa.string()), ("value", pa.string())])


def last_line_end(path: str, size: int, least: int = 0) -> int:
    """The position after the last line end among the bytes from ``least`` to ``size``; ``least`` if there is none."""
    fs, at = resolve(path)
    with fs.open_input_file(at) as f:
        end = size
        while end > least:
            begin = max(least, end - BACK)
            f.seek(begin)
            found = f.read(end - begin).rfind(b"\n")
            if found >= 0:
                return begin + found + 1
            end = begin
    return least


@dataclass
class Range(InputPartition):
    """Lines of ``path`` that start in ``start:stop``."""

    path: str
    start: int
    stop: int


class TailReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path = options.get("path")
        if not self.path:
            raise ValueError("the tail format needs a path")
        self.from_end = options.get("startingPosition", "start") == "end"
        self.chunk = int(options.get("maxBytesPerPartition", 64 << 20))
        self.known: dict[str, tuple[int, int]] = {}

    def initialOffset(self) -> dict:
        return self.latestOffset() if self.from_end else {}

    def latestOffset(self) -> dict:
        now = {}
        for path, size in listed(self.path):
            seen, end = self.known.get(path, (0, 0))
            if size < seen:
                end = 0
            if size != seen:
                end = last_line_end(path, size, end)
            now[path] = (size, end)
        self.known = now
        return {path: end for path, (_, end) in now.items()}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        out = []
        for path, stop in sorted(end.items()):
            at = start.get(path, 0)
            at = 0 if at > stop else at
            out += [Range(path, a, min(stop, a + self.chunk)) for a in range(at, stop, self.chunk)]
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        # a line belongs to the range that it starts in; the byte before tells whether one starts at once
        at = max(0, partition.start - 1)
        with opened(partition.path, at) as f:
            if partition.start:
                at += len(f.readline())
            lines: list[str] = []
            while at < partition.stop:
                line = f.readline()
                if not line:
                    break
                at += len(line)
                lines.append(line.rstrip(b"\r\n").decode("utf-8", "replace"))
                if len(lines) >= ROWS:
                    yield _batch(partition.path, lines)
                    lines = []
            if lines:
                yield _batch(partition.path, lines)


def _batch(path: str, lines: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([path] * len(lines), pa.string()), pa.array(lines, pa.string())], schema=_SCHEMA)


class TailDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tail"

    def schema(self) -> str:
        return "path string, value string"

    def streamReader(self, schema: StructType) -> TailReader:
        return TailReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TailDataSource)
