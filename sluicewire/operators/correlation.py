"""Correlation: pairs of events within a time of each other.

The band join becomes an equi-join: with bins as wide as the window, a left event goes to the bins
that its window touches (three at most), a right one to its own, so every pair meets in exactly
one bin, and the residual decides. On streams the bins are the equality that state needs, and the
band on event time lets it be dropped.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fields import Resolver
from ..functions.times import micros, nanos
from ..lang import ast
from .predicates import predicate


#: Spark's mark of a column that has a watermark.
_WATERMARK = "spark.watermarkDelayMs"


def _side(df: DataFrame, where: ast.Expr | None, time: str, keys: list[str], prefix: str) -> DataFrame:
    resolve = Resolver(df)
    kept = df if where is None else df.filter(predicate(where, resolve))
    cols = [F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(f"{prefix}_event"), F.col(time).alias(f"_{prefix}_time"), nanos(df, time).alias(f"_{prefix}_ns")]
    return kept.select(*cols, *[resolve(k).value().alias(f"_{prefix}_k{i}") for i, k in enumerate(keys)])


def band_join(left: DataFrame, right: DataFrame, within_ms: int, n_keys: int = 0, ordered: bool = False, left_kind=None, right_kind=None) -> DataFrame:
    """Pairs of sides made by ``_side``: ``0 <= right - left <= w`` if ordered, else ``|left - right| <= w``."""
    # a band of zero pairs equal times; its bins are a millisecond wide
    width = max(1, within_ms) * 1000
    l_us = micros(F.col("_left_time"), left_kind)
    r_us = micros(F.col("_right_time"), right_kind)
    bin_of = lambda us: F.floor(us / F.lit(width)).cast("long")
    low = l_us if ordered else l_us - width
    # a nanosecond time may lie up to one microsecond after its truncated one
    left = left.withColumn("_bin", F.explode(F.sequence(bin_of(low - (0 if ordered else 1)), bin_of(l_us + width + 1))))
    right = right.withColumn("_rbin", bin_of(r_us))
    diff = F.col("_right_ns") - F.col("_left_ns")
    limit = F.lit(within_ms * 1_000_000)
    cond = [F.col("_bin") == F.col("_rbin"), *[F.col(f"_left_k{i}") == F.col(f"_right_k{i}") for i in range(n_keys)]]
    cond.append(diff.between(F.lit(0), limit) if ordered else F.abs(diff) <= limit)
    if left.isStreaming or right.isStreaming:
        slack = F.make_dt_interval(secs=F.lit((width + 1) / 1e6).cast("decimal(18,6)"))
        cond += [F.col("_right_time") >= F.col("_left_time") - slack, F.col("_right_time") <= F.col("_left_time") + slack]
    return left.join(right, reduce(lambda a, b: a & b, cond))


def correlate(df: DataFrame, stage: ast.Correlate, time: str) -> DataFrame:
    """left_event, right_event, time_diff_ms (left less right), window_ms, ts (the later time).

    The bound is inclusive; an event on both sides pairs with itself. With ``on``, fields must be equal.
    """
    kind = df.schema[time].dataType
    left = _side(df, stage.left, time, [a for a, _ in stage.on], "left")
    right = _side(df, stage.right, time, [b for _, b in stage.on], "right")
    return _pairs(band_join(left, right, stage.within_ms, len(stage.on), stage.ordered, kind, kind), stage.within_ms)


def _diff_ms() -> Column:
    return ((F.col("_left_ns") - F.col("_right_ns")) / F.lit(1e6)).cast("double")


def _pairs(joined: DataFrame, within_ms: int) -> DataFrame:
    # on streams the later time keeps the mark of an event time: whichever event comes last, it is not behind the watermark
    marks = [f.metadata for f in joined.schema.fields if f.name in ("_left_time", "_right_time") and _WATERMARK in f.metadata]
    mark = {"metadata": max(marks, key=lambda m: m[_WATERMARK])} if marks else {}
    return joined.select("left_event", "right_event", _diff_ms().alias("time_diff_ms"), F.lit(within_ms).cast("long").alias("window_ms"), F.greatest("_left_time", "_right_time").alias("ts", **mark))


def correlate_frames(left: DataFrame, right: DataFrame, within_ms: int, time: str = "ts", on: tuple[tuple[str, str], ...] = ()) -> DataFrame:
    """The same for two DataFrames, all of whose rows take part."""
    a = _side(left, None, time, [x for x, _ in on], "left")
    b = _side(right, None, time, [x for _, x in on], "right")
    return _pairs(band_join(a, b, within_ms, len(on), False, left.schema[time].dataType, right.schema[time].dataType), within_ms)


def log_network(df: DataFrame, within_ms: int = 100, time: str = "ts") -> DataFrame:
    """The built-in correlator: log with network events; correlation_type, window_ms, log, network, time_diff_ms, and the log's time."""
    kind = df.schema[time].dataType
    log = _side(df, ast.Compare("type", "==", "log"), time, [], "left")
    net = _side(df, ast.Compare("type", "==", "network"), time, [], "right")
    joined = band_join(log, net, within_ms, 0, False, kind, kind)
    return joined.select(F.lit("time_based").alias("correlation_type"), F.lit(within_ms).cast("long").alias("window_ms"), F.col("left_event").alias("log"), F.col("right_event").alias("network"), _diff_ms().alias("time_diff_ms"), F.col("_left_time").alias("ts"))
