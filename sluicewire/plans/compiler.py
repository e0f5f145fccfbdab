"""Compiles a pipeline, stage by stage, each over the output of the one before."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame

from ..functions.times import time_column
from ..lang import ast, parse
from ..operators.aggregates import aggregate, running
from ..operators.correlation import correlate
from ..operators.ordering import order_by, top
from ..operators.predicates import keep, show


def compile_stage(df: DataFrame, stage: ast.Stage, time: str | None = None, run: bool = False) -> DataFrame:
    """One stage over ``df``. ``time`` names the event time, if it isn't the usual one."""
    if time is not None and time not in df.columns:
        time = None
    if isinstance(stage, ast.Filter):
        return keep(df, stage.where)
    if isinstance(stage, ast.Show):
        return show(df, stage.fields, stage.where)
    if isinstance(stage, ast.Aggregate):
        if run:
            return running(df, stage, time_column(df, time))
        if df.isStreaming and stage.window is None and "left_event" in df.columns:
            raise ValueError("a streaming correlation can only be aggregated in windows; aggregate each batch in foreachBatch instead")
        return aggregate(df, stage, time_column(df, time) if stage.window is not None else None)
    if isinstance(stage, ast.Correlate):
        return correlate(df, stage, time_column(df, time))
    if isinstance(stage, ast.Top):
        return top(df, stage.n, stage.key)
    if isinstance(stage, ast.OrderBy):
        return order_by(df, stage.keys)
    if isinstance(stage, ast.Limit):
        return df.limit(stage.n)
    raise TypeError(f"not a stage: {stage!r}")


def compile_query(df: DataFrame, pipeline: ast.Pipeline, time: str | None = None, running: bool = False) -> DataFrame:
    return reduce(lambda d, s: compile_stage(d, s, time, running and isinstance(s, ast.Aggregate)), pipeline.stages, df)


def query(df: DataFrame, text: str, time: str | None = None, running: bool = False) -> DataFrame:
    """The result of a query over events, batch or streaming.

    ``running``: aggregates without a window give a row for each event, of its group so far.
    """
    return compile_query(df, parse(text), time, running)
