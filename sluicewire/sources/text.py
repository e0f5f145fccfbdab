"""Log files as events, read once or as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lang import parse_filter
from ..operators.predicates import keep
from . import received, tail
from .formats import detect_format, event_time, parse_lines


def _envelope(lines: DataFrame, fmt: str, name: str | None, pattern: str | None, year: int | None, where: str | None) -> DataFrame:
    parsed = parse_lines(lines, fmt, pattern=pattern, year=year)
    now = F.current_timestamp()
    out = parsed.select("type", F.coalesce(event_time(), now).alias("ts"), F.struct(F.lit("file").alias("type"), F.lit(name).cast("string").alias("name")).alias("source"), "data")
    return keep(out, parse_filter(where)) if where else out


def read_logs(spark: SparkSession, path: str, fmt: str | None = None, where: str | None = None, name: str | None = None, pattern: str | None = None, year: int | None = None) -> DataFrame:
    """Events (type, ts, source, data) of the files at ``path`` (globs and folders too).

    ``where`` is the input's filter. Events without a time of their own get the current one.
    """
    return _envelope(spark.read.text(path), fmt or detect_format(path), name or path, pattern, year, where)


def stream_logs(spark: SparkSession, path: str, fmt: str | None = None, where: str | None = None, name: str | None = None, pattern: str | None = None, year: int | None = None, max_files: int | None = None) -> DataFrame:
    """The same as a stream of the files that appear in the folder ``path``.

    It follows files, not bytes appended to them; for these see ``tail_logs``.
    """
    reader = spark.readStream
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return _envelope(reader.text(path), fmt or detect_format(path), name or path, pattern, year, where)


def tail_logs(spark: SparkSession, path: str, fmt: str | None = None, where: str | None = None, name: str | None = None, pattern: str | None = None, year: int | None = None, from_end: bool = False) -> DataFrame:
    """The same as a stream of the lines that files at ``path`` have (or, ``from_end``, get from now on), as they grow."""
    tail.register(spark)
    lines = spark.readStream.format("tail").option("startingPosition", "end" if from_end else "start").load(path)
    return _envelope(lines, fmt or detect_format(path), name or path, pattern, year, where)


def stream_udp(spark: SparkSession, port: int, host: str = "0.0.0.0", fmt: str = "syslog", where: str | None = None, pattern: str | None = None) -> DataFrame:
    """Datagrams that the driver receives as a stream of lines."""
    received.register(spark)
    lines = spark.readStream.format("udp").option("host", host).option("port", port).load()
    return _envelope(lines, fmt, f"{host}:{port}", pattern, None, where)


def stream_socket(spark: SparkSession, host: str, port: int, fmt: str = "syslog", where: str | None = None, pattern: str | None = None) -> DataFrame:
    """Lines of a TCP socket as a stream (for tests: Spark's socket source is not fault-tolerant)."""
    lines = spark.readStream.format("socket").option("host", host).option("port", port).load()
    return _envelope(lines, fmt, f"{host}:{port}", pattern, None, where)
