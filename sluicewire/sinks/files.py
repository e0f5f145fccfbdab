"""Event lines to files: JSON lines, and retention of rotated ones."""

from __future__ import annotations

import re
import time
from bisect import bisect_left
from collections import deque
from collections.abc import Iterable, Iterator, Sequence
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.payload import to_json_lines

#: Rotation limits of the file sink.
MAX_BYTES, MAX_AGE_S, MAX_FILES = 100_000_000, 7 * 86_400, 10
_ROTATED = re.compile(r"\.(\d{8}_\d{6})(?:_(\d+))?")
#: Bytes of lines that reach the driver as one row, compressed.
BLOCK_BYTES, CODEC = 1 << 20, "zstd"


def write_json_lines(events: DataFrame, path: str, max_records: int | None = None, mode: str = "append") -> None:
    """A folder of text files, one event a line; ``max_records`` bounds each file."""
    writer = to_json_lines(events).write.mode(mode)
    if max_records:
        writer = writer.option("maxRecordsPerFile", max_records)
    writer.text(path)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "append") -> None:
    """Results as parquet, orc, csv or json."""
    df.write.mode(mode).format(fmt).save(path)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines with their ends, joined to compressed blocks of about BLOCK_BYTES; ``ends``: where each line ends in its block, as 64-bit integers.

    The driver receives a partition's blocks at once, so their size counts.
    """
    for batch in batches:
        lines = batch.column(0).cast(pa.large_string())
        if lines.null_count:
            raise ValueError("an event without a type has no line")
        if not len(lines):
            continue
        _, at, text = lines.buffers()
        at, first = np.frombuffer(at, np.int64)[lines.offset : lines.offset + len(lines) + 1], 0
        while first < len(lines):
            last = max(first + 1, int(np.searchsorted(at, at[first] + BLOCK_BYTES, "right")) - 1)
            block, ends = text[int(at[first]) : int(at[last])], (at[first + 1 : last + 1] - at[first]).tobytes()
            yield pa.record_batch({k: pa.array([pa.compress(x, CODEC, asbytes=True)], pa.binary()) for k, x in (("text", block), ("ends", ends))} | {"lines": pa.array([last - first])})
            first = last


def _parted(text: bytes, ends: bytes, lines: int) -> tuple[pa.Buffer, memoryview]:
    ends = memoryview(pa.decompress(ends, 8 * lines, CODEC)).cast("B").cast("q")
    return pa.decompress(text, ends[-1], CODEC), ends


class RotatingFile:
    """One local file of lines, renamed with a time stamp once it is large or old; the oldest beyond a number go.

    For a single reader on one machine: lines pass through the driver, in blocks that executors join.
    """

    def __init__(self, path: str, max_bytes: int = MAX_BYTES, max_age_s: float = MAX_AGE_S, max_files: int = MAX_FILES):
        self.path, self.max_bytes, self.max_age_s, self.max_files = Path(path), max_bytes, max_age_s, max_files

    def rotated(self) -> list[Path]:
        """Rotated files, oldest first."""
        found = [(at, p) for p in self.path.parent.glob("*") if p.name.startswith(self.path.name) and (at := self._stamp(p))]
        return [p for _, p in sorted(found)]

    def _stamp(self, path: Path) -> tuple[str, int] | None:
        """When a rotated file was renamed, and which of that second's it is."""
        m = _ROTATED.fullmatch(path.name, len(self.path.name))
        return m and (m[1], int(m[2] or 0))

    def _rotate(self, kept: deque[Path]) -> None:
        """``kept``: the rotated files, which the new one joins. A folder may hold very many: none is listed or tried again."""
        stamp = time.strftime("%Y%m%d_%H%M%S")
        before = self._stamp(kept[-1]) if kept else None
        n = before[1] + 1 if before and before[0] == stamp else 0
        while (to := self.path.with_name(f"{self.path.name}.{stamp}" + (f"_{n}" if n else ""))).exists():
            n += 1
        self.path.rename(to)
        kept.append(to)
        while len(kept) > self.max_files:
            kept.popleft().unlink(missing_ok=True)

    def write(self, lines: Iterable[str]) -> int:
        """Appends lines; how many."""
        return self._append((text, (len(text),)) for line in lines for text in [line.encode() + b"\n"])

    def _append(self, blocks: Iterable[tuple[bytes, Sequence[int]]]) -> int:
        """Appends blocks of whole lines, given with the position after each line; how many lines."""
        n = size = 0
        out = born = kept = None
        try:
            for text, ends in blocks:
                text, first, start = memoryview(text), 0, 0
                while first < len(ends):
                    if out is None:
                        self.path.parent.mkdir(parents=True, exist_ok=True)
                        out = self.path.open("ab")
                        size, born = out.tell(), self._born()
                    # up to the line that fills the file, or one line if the file is old
                    last = first if self._old(born) else min(bisect_left(ends, start + self.max_bytes - size, first), len(ends) - 1)
                    out.write(text[start : ends[last]])
                    size += ends[last] - start
                    n += last + 1 - first
                    first, start = last + 1, ends[last]
                    if size >= self.max_bytes or self._old(born):
                        out.close()
                        out = None
                        kept = deque(self.rotated()) if kept is None else kept
                        self._rotate(kept)
        finally:
            if out is not None:
                out.close()
        return n

    def _old(self, born: float) -> bool:
        return time.time() - born >= self.max_age_s

    def _born(self) -> float:
        stat = self.path.stat()
        return time.time() if stat.st_size == 0 else getattr(stat, "st_birthtime", stat.st_ctime)

    def write_batch(self, events: DataFrame, batch_id: int = 0) -> None:
        lines = to_json_lines(events).select(F.concat("value", F.lit("\n")))
        blocks = lines.mapInArrow(_joined, "text binary, ends binary, lines long").toLocalIterator(prefetchPartitions=True)
        self._append(_parted(r["text"], r["ends"], r["lines"]) for r in blocks)
