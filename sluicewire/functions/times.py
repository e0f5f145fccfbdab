"""The event time of a DataFrame and exact differences between event times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NAMES = ("ts", "timestamp", "event_time", "time")


def time_column(df: DataFrame, name: str | None = None) -> str:
    """``name``, or the first usual name of a time column that ``df`` has."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    for n in [name] if name else _NAMES:
        if isinstance(kinds.get(n), (T.TimestampType, T.TimestampNTZType)):
            return n
    raise ValueError(f"no time column among {', '.join(kinds)}" if not name else f"{name} is not a time column")


def micros(column: Column, kind: T.DataType) -> Column:
    """Microseconds since 1970 in UTC; a time without zone is taken as UTC (the session's zone is UTC)."""
    return F.unix_micros(column.cast("timestamp") if isinstance(kind, T.TimestampNTZType) else column)


def nanos(df: DataFrame, time: str) -> Column:
    """``timestamp_ns`` where a row has it, else the time column's microseconds as nanoseconds."""
    coarse = micros(F.col(time), df.schema[time].dataType) * 1000
    return F.coalesce(F.col("timestamp_ns").cast("long"), coarse) if "timestamp_ns" in df.columns else coarse
