"""Grouped aggregation: count, sum, avg, min, max, percentile, distinct.

Missing and non-numeric values of a measured field count as 0.0. The percentile is the value at
index ``min(floor(p / 100 * n), n - 1)`` of the sorted values. In batch it comes from counts of
distinct values, cut into ranges, so no group is gathered in a task; on
streams it sorts the group's values.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fields import Resolver, quoted
from ..functions.times import nanos
from ..lang import ast
from .predicates import keep
from .windows import bounds, windowed

def _metric(f: ast.Func, resolve: Resolver, streaming: bool) -> Column:
    if f.name == "count":
        return F.count(F.lit(1))
    field = resolve(f.field)
    if f.name == "distinct":
        value = field.value()
        return F.size(F.collect_set(value)).cast("long") if streaming else F.count_distinct(value)
    x = field.measure()
    if f.name == "percentile":
        values = F.sort_array(F.collect_list(x))
        n = F.count(F.lit(1))
        return F.get(values, F.least(F.floor(F.lit(f.p / 100.0) * n).cast("int"), (n - 1).cast("int")))
    return {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}[f.name](x)


#: Ranges of values into which a group is cut to find its percentiles.
RANGES = 1024
#: Of inputs that the plan estimates at no more bytes than one task takes, groups are sorted whole instead.
SORTED_BYTES = 256 << 20


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of the size of ``df``."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def _joined(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """An equi-join on ``keys`` in which nulls are equal; without keys, ``right`` has at most one row."""
    renamed = right.select(*[F.col(k).alias(f"right_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    if not keys:
        return left.join(F.broadcast(renamed), F.lit(True), how)
    cond = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"right_{k}")) for k in keys])
    return left.join(renamed, cond, how).drop(*[f"right_{k}" for k in keys])


def _range_of(v: Column, splits: Column) -> Column:
    """How many of the increasing ``splits`` are at most ``v``, by binary search."""
    steps = [1 << i for i in reversed(range(RANGES.bit_length()))]
    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), lambda at, s: F.when((at + s <= F.size(splits)) & (F.get(splits, at + s - 1) <= v), at + s).otherwise(at))


def _percentiles(df: DataFrame, keys: list[str], funcs: dict[str, ast.Func]) -> DataFrame:
    """``keys``, the exact percentiles ``funcs`` (by the name of their column) of the column ``x``, and ``n``, the number of rows.

    Distinct values are counted. Those of a small input are sorted, with a running sum. A larger one's
    groups are cut into ranges by their approximate quantiles. The ranges' counts tell which of them a percentile's index falls in, and only the values of these
    are sorted: what a task sees of a hot group is a range, not the group.
    """
    counts = df.groupBy(*keys, "x").agg(F.count(F.lit(1)).alias("c"))
    group = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    index = {name: F.least(F.floor(F.lit(f.p / 100.0) * F.col("n")), F.col("n") - 1) for name, f in funcs.items()}
    if estimated_bytes(df) <= SORTED_BYTES:
        running = counts.select("*", F.sum("c").over(group.orderBy("x").rowsBetween(Window.unboundedPreceding, 0)).alias("so_far"), F.sum("c").over(group).alias("n"))
        return running.groupBy(*keys).agg(*[F.min(F.when(F.col("so_far") > i, F.col("x"))).alias(name) for name, i in index.items()], F.max("n").alias("n"))
    splits = counts.groupBy(*keys).agg(F.percentile_approx("x", [i / RANGES for i in range(1, RANGES)], 10 * RANGES).alias("splits"))
    ranged = _joined(counts, splits, keys).withColumn("r", _range_of(F.col("x"), F.col("splits"))).drop("splits")
    sums = ranged.groupBy(*keys, "r").agg(F.sum("c").alias("rc"))
    # at most RANGES rows for each group
    placed = sums.select("*", (F.sum("rc").over(group.orderBy("r").rowsBetween(Window.unboundedPreceding, 0)) - F.col("rc")).alias("before"), F.sum("rc").over(group).alias("n"))
    hit = reduce(lambda a, b: a | b, [(F.col("before") <= i) & (i < F.col("before") + F.col("rc")) for i in index.values()])
    inside = _joined(ranged, placed.where(hit), [*keys, "r"])
    so_far = F.col("before") + F.sum("c").over(Window.partitionBy(*keys, "r").orderBy("x").rowsBetween(Window.unboundedPreceding, 0))
    here = inside.select("*", so_far.alias("so_far"))
    return here.groupBy(*keys).agg(*[F.min(F.when((F.col("before") <= i) & (F.col("so_far") > i), F.col("x"))).alias(name) for name, i in index.items()], F.max("n").alias("n"))


def aggregate(df: DataFrame, stage: ast.Aggregate, time: str | None = None) -> DataFrame:
    """Keys, window_start and window_end (if windowed), and a column for each function.

    Without rows there are no groups, not even the global one. Inside, keys and metrics go by
    numbers, so that columns may have any name.
    """
    if stage.where is not None:
        df = keep(df, stage.where)
    streaming = df.isStreaming
    resolve = Resolver(df)
    metrics = {f"m{i}": f for i, f in enumerate(dict.fromkeys(stage.funcs))}
    late = {m: f for m, f in metrics.items() if f.name == "percentile" and not streaming}
    window = None
    if stage.window is not None:
        df, window = windowed(df, time, stage.window)
    keys = {f"k{i}": name for i, name in enumerate(dict.fromkeys(stage.by))}
    by = [resolve(name).value().alias(k) for k, name in keys.items()]
    group = [*by, *([window.alias("w")] if window is not None else [])]
    out = df.groupBy(*group).agg(*[_metric(f, resolve, streaming).alias(m) for m, f in metrics.items() if m not in late], F.count(F.lit(1)).alias("rows"))
    if not group:
        out = out.where("rows > 0")
    shared = [*keys, *(["w"] if window is not None else [])]
    fields = list(dict.fromkeys(f.field for f in late.values()))
    session = window is not None and stage.window.kind == "session"
    if len(fields) == 1 and not session and all(m in late or f.name == "count" for m, f in metrics.items()):
        # the counts of values have all that is asked
        part = _percentiles(df.select(*group, resolve(fields[0]).measure().alias("x")), shared, late)
        out, fields = part.select(*shared, *late, *[F.col("n").alias(m) for m in metrics if m not in late]), []
        out = out if group else out.where(F.coalesce(*[F.col(m) for m in late]).isNotNull())
    for field in fields:
        if session:
            # a session is only known once events are grouped: take its bounds, then the events inside
            values = _session_values(df.select(*by, F.col(quoted(time)).alias("at"), resolve(field).measure().alias("x")), out, list(keys))
        else:
            values = df.select(*group, resolve(field).measure().alias("x"))
        part = _percentiles(values, shared, {m: f for m, f in late.items() if f.field == field}).drop("n")
        out = _joined(out, part, shared, "left")
    edges = bounds(F.col("w"), stage.window) if window is not None else []
    return out.select(*[F.col(k).alias(name) for k, name in keys.items()], *edges, *[F.col(m).alias(f.column) for m, f in metrics.items()])


def _session_values(events: DataFrame, sessions: DataFrame, keys: list[str]) -> DataFrame:
    """Each event's measure (``x``) with the session ``w`` it fell in: the last one of its keys that starts no later."""
    kind = sessions.schema["w"].dataType
    starts = sessions.select(*keys, F.col("w.start").alias("at"), F.lit(None).cast("double").alias("x"), "w")
    over = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    both = events.select(*keys, "at", "x", F.lit(None).cast(kind).alias("w")).unionByName(starts)
    last = F.last("w", ignorenulls=True).over(over.orderBy("at", F.col("w").isNull()).rowsBetween(Window.unboundedPreceding, 0))
    return both.select(*keys, "x", F.col("w").isNull().alias("event"), last.alias("inside")).where("event").select(*keys, "x", F.col("inside").alias("w"))


#: Begins the names of columns that only ``running`` sees.
OWN = "\0"


def running(df: DataFrame, stage: ast.Aggregate, time: str) -> DataFrame:
    """``df`` with the aggregates of its group up to each row, in time order (then ``seq``, if there is one).

    A column of ``df`` with the name of an aggregate gives way to it. The groups of a large input are
    cut into ranges of time: a row's aggregate is that of its range so far and of the ranges before,
    so that no task takes a whole hot group. Percentiles can't be put together like that: they hold
    the group's values in every row.
    """
    if stage.window is not None:
        raise ValueError("a running aggregate has no window")
    if stage.where is not None:
        df = keep(df, stage.where)
    resolve, own = Resolver(df), lambda name: F.col(OWN + name)
    funcs = {f"f{i}": f for i, f in enumerate(dict.fromkeys(stage.funcs))}
    keys = {f"k{i}": resolve(k).value() for i, k in enumerate(dict.fromkeys(stage.by))}
    names = [OWN + k for k in keys]
    # what is measured of each row; the value itself of a distinct count, and later whether it is new
    measures = {name: F.lit(1).cast("long") if f.name == "count" else resolve(f.field).value() if f.name == "distinct" else resolve(f.field).measure() for name, f in funcs.items()}
    rows = df.select("*", nanos(df, time).alias(OWN + "at"), *[c.alias(OWN + n) for n, c in (keys | measures).items()])
    order = [own("at"), *([F.col("seq")] if "seq" in df.columns else [])]
    for name, f in funcs.items():
        if f.name == "distinct":
            # a value counts where it first appears in its group, so that no row holds a set
            new = F.row_number().over(Window.partitionBy(*names, OWN + name).orderBy(*order)) == 1
            rows = rows.withColumn(OWN + name, (new & own(name).isNotNull()).cast("long"))
    group = Window.partitionBy(*names) if names else Window.partitionBy(F.lit(0))
    until = (Window.unboundedPreceding, 0)
    large = estimated_bytes(df) > SORTED_BYTES
    here = group
    if large:
        splits = rows.agg(F.percentile_approx(own("at"), [i / RANGES for i in range(1, RANGES)], 10 * RANGES).alias("s")).first()["s"] or []
        table = F.from_json(F.lit(json.dumps(sorted(set(splits)))), "array<bigint>")
        rows = rows.withColumn(OWN + "range", _range_of(own("at"), table))
        here = Window.partitionBy(*names, OWN + "range")
    merge = {"min": F.min, "max": F.max}
    # an average is put together from a sum and a count
    parts = {n: merge.get(f.name, F.sum)(own(n)) for n, f in funcs.items() if f.name != "percentile"}
    parts |= {n + "n": F.count(F.lit(1)) for n, f in funcs.items() if f.name == "avg"}
    out = rows.select("*", *[c.over(here.orderBy(*order).rowsBetween(*until)).alias(OWN + "so_far_" + n) for n, c in parts.items()])
    total = {n: own("so_far_" + n) for n in parts}
    if large:
        sums = rows.groupBy(*names, OWN + "range").agg(*[c.alias(OWN + "all_" + n) for n, c in parts.items()])
        # at most RANGES rows for each group
        earlier = group.orderBy(OWN + "range").rowsBetween(Window.unboundedPreceding, -1)
        again = {n: (F.min if funcs.get(n) and funcs[n].name == "min" else F.max if funcs.get(n) and funcs[n].name == "max" else F.sum)(own("all_" + n)) for n in parts}
        before = sums.select(*names, OWN + "range", *[c.over(earlier).alias(OWN + "before_" + n) for n, c in again.items()])
        out = _joined(out, before, [*names, OWN + "range"])
        put = {"min": F.least, "max": F.greatest}
        total = {n: put[funcs[n].name](c, own("before_" + n)) if n in funcs and funcs[n].name in put else c + F.coalesce(own("before_" + n), F.lit(0)) for n, c in total.items()}
    results = []
    for name, f in funcs.items():
        if f.name == "percentile":
            over = group.orderBy(*order).rowsBetween(*until)
            n = F.count(F.lit(1)).over(over)
            col = F.get(F.sort_array(F.collect_list(own(name)).over(over)), F.least(F.floor(F.lit(f.p / 100.0) * n).cast("int"), (n - 1).cast("int")))
        else:
            col = total[name] / total[name + "n"] if f.name == "avg" else total[name]
        results.append(col.alias(f.column))
    new = {f.column.lower() for f in funcs.values()}
    return out.select(*[F.col(quoted(c)) for c in df.columns if c.lower() not in new], *results)
