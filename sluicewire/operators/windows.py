"""Time windows: tumbling, sliding (gaps allowed), and sessions with a strict gap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.times import micros
from ..lang.ast import WindowSpec


def windowed(df: DataFrame, time: str, spec: WindowSpec) -> tuple[DataFrame, Column]:
    """``df`` (with a row for each window that a row is in, if there are several) and the window to group by."""
    size = f"{spec.size_ms} milliseconds"
    if spec.kind == "tumbling":
        return df, F.window(time, size)
    if spec.kind == "session":
        # Spark joins events exactly a gap apart; a session here needs less than the gap
        return df, F.session_window(time, f"{spec.size_ms * 1000 - 1} microseconds")
    slide = spec.slide_ms or spec.size_ms
    if slide <= spec.size_ms:
        return df, F.window(time, size, f"{slide} milliseconds")
    # windows with gaps between them: at most one holds a row
    at = micros(F.col(time), df.schema[time].dataType)
    start = at - F.pmod(at, F.lit(slide * 1000))
    inside = df.where(at - start < spec.size_ms * 1000)
    kind = df.schema[time].dataType.simpleString()
    bound = lambda us: F.timestamp_micros(us).cast(kind)
    return inside, F.struct(bound(start).alias("start"), bound(start + spec.size_ms * 1000).alias("end"))


def bounds(window: Column, spec: WindowSpec) -> list[Column]:
    """window_start and window_end; a session ends a whole gap after its last event."""
    end = window["end"] + F.expr("INTERVAL 0.000001 SECOND") if spec.kind == "session" else window["end"]
    return [window["start"].alias("window_start"), end.alias("window_end")]
