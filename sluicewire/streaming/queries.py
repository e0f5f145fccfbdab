"""Queries as Structured Streaming jobs: output modes, watermarks and sinks."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.fields import quoted
from ..functions.places import names, remove, shared_folder
from ..functions.times import time_column
from ..lang import ast, parse
from ..operators.aggregates import aggregate
from ..plans import compile_query, to_payload


def with_event_time(df: DataFrame, delay: str = "10 seconds", time: str | None = None) -> DataFrame:
    """A stream with a watermark on its event time; a time without zone is first made one of the session's zone."""
    name = time_column(df, time)
    if df.schema[name].dataType.typeName() == "timestamp_ntz":
        df = df.withColumn(name, df[name].cast("timestamp"))
    return df.withWatermark(name, delay)


def output_mode(pipeline: ast.Pipeline) -> str:
    """append, where rows are final (filters, correlations, closed windows); update for running aggregates; complete where results are ordered."""
    aggregates = [s for s in pipeline.stages if isinstance(s, ast.Aggregate)]
    if any(isinstance(s, (ast.Top, ast.OrderBy)) for s in pipeline.stages):
        if not aggregates:
            raise ValueError("a stream can only be ordered after an aggregate")
        return "complete"
    return "update" if any(s.window is None for s in aggregates) else "append"


def start(df: DataFrame, text: str, handler: Callable[[DataFrame, int], None] | None = None, delay: str = "10 seconds", checkpoint: str | None = None, once: bool = False, name: str | None = None, payloads: bool = False, time: str | None = None) -> StreamingQuery:
    """Starts a query over a stream of events.

    Results go to ``handler(batch, id)``, or else to the in-memory table ``name``. ``payloads``: as
    derived events. ``once``: what is there now, then stop.
    """
    pipeline = parse(text)
    stream = with_event_time(df, delay, time)
    out = compile_query(stream, pipeline, time)
    if payloads:
        out = to_payload(out, pipeline.stages[-1])
    writer = out.writeStream.outputMode(output_mode(pipeline))
    writer = writer.foreachBatch(handler) if handler else writer.format("memory").queryName(name)
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    if once:
        writer = writer.trigger(availableNow=True)
    return writer.start()


class MergedAggregate:
    """Counts, sums, averages, minima and maxima of a streaming correlation without a window, merged over batches.

    A stream-stream join only appends, so each batch's partial aggregate is added to the state of
    the batch before, and both are tables in ``folder`` (in the shared folder, if not given; give one
    to go on after a restart, as with the query's checkpoint): groups never pass through the
    driver. A batch that is tried again starts from the same state, and replaces its own. Percentiles
    and distinct counts don't merge; give these a window.
    """

    def __init__(self, stage: ast.Aggregate, folder: str | None = None):
        if stage.window is not None or {f.name for f in stage.funcs} & {"percentile", "distinct"}:
            raise ValueError("only count, sum, avg, min and max without a window can be merged")
        self.stage, self.folder = stage, folder
        fields = dict.fromkeys(f.field for f in stage.funcs if f.field)
        self.parts = ast.Aggregate((ast.Func("count"), *(ast.Func(n, f) for f in fields for n in ("sum", "min", "max"))), stage.by, stage.where)

    def _states(self, spark: SparkSession) -> list[int]:
        """The batches whose state is there, in order."""
        return [int(n) for n in names(spark, self.folder) if n.isdigit() and "_SUCCESS" in names(spark, f"{self.folder}/{n}")]

    def __call__(self, pairs: DataFrame, batch_id: int) -> None:
        spark = pairs.sparkSession
        self.folder = self.folder or f"{shared_folder(spark)}/merged-{uuid.uuid4().hex}"
        before = [b for b in self._states(spark) if b < batch_id]
        keys, cols = [quoted(k) for k in dict.fromkeys(self.stage.by)], [f.column for f in self.parts.funcs]
        now = aggregate(pairs, self.parts)
        if before:
            both = spark.read.parquet(f"{self.folder}/{before[-1]:020}").unionByName(now, allowMissingColumns=True)
            merge = {"min": F.min, "max": F.max}
            now = both.groupBy(*keys).agg(*[merge.get(f.name, F.sum)(quoted(f.column)).alias(f.column) for f in self.parts.funcs])
        now.select(*keys, *map(quoted, cols)).write.mode("overwrite").parquet(f"{self.folder}/{batch_id:020}")
        for old in before[:-1]:
            remove(spark, f"{self.folder}/{old:020}")

    def results(self, spark: SparkSession) -> DataFrame | None:
        """A row for each group, with the asked functions; None before the first batch."""
        there = self._states(spark) if self.folder else []
        if not there:
            return None
        state = spark.read.parquet(f"{self.folder}/{there[-1]:020}")
        asked = [(F.col(quoted(f.field)) / F.col("count") if f.name == "avg" else F.col(quoted(f.column))).alias(f.column) for f in dict.fromkeys(self.stage.funcs)]
        return state.select(*[quoted(k) for k in dict.fromkeys(self.stage.by)], *asked)
