"""Prometheus text: counters of events, and a gauge for each metric of an aggregation."""

from __future__ import annotations

import os
import re
import tempfile
import threading
from collections import Counter
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fields import quoted
from ..lang import ast

PREFIX = "sluicewire"
TYPES = ("log", "network", "correlation", "error")


def metric_name(text: str) -> str:
    out = re.sub(r"[^a-zA-Z0-9_:]", "_", text)
    return "_" + out if out[:1].isdigit() else out


def label_value(value) -> str:
    text = "null" if value is None else str(value)
    return text.replace("\\", "\\\\").replace("\n", "\\n").replace('"', '\\"')


class PrometheusText:
    """Collects batches, and renders them. Gauges show the last flush's results; counters go on."""

    def __init__(self, path: str | None = None, prefix: str = PREFIX):
        self.path, self.prefix = Path(path) if path else None, prefix
        self.by_type: Counter[str] = Counter()
        self.bytes = 0
        self.gauges: dict[str, dict[tuple, float]] = {}
        self.lock = threading.Lock()

    def count_events(self, events: DataFrame, batch_id: int = 0) -> None:
        """Adds a batch of events (type, and data or all columns as their size)."""
        body = F.col("data").cast("string") if "data" in events.columns and events.schema["data"].dataType.typeName() in ("string", "variant") else F.to_json(F.struct(*[F.col(quoted(c)) for c in events.columns]))
        rows = events.groupBy(F.coalesce("type", F.lit("unknown")).alias("t")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(body)).alias("b")).collect()
        with self.lock:
            for r in rows:
                self.by_type[r["t"]] += r["n"]
                self.bytes += r["b"] or 0

    def gauge_results(self, results: DataFrame, stage: ast.Aggregate) -> None:
        """Takes an aggregation's result: a gauge for each function, labelled by the group. Groups pass through the driver one by one."""
        names = list(dict.fromkeys(stage.by))
        for row in results.toLocalIterator():
            labels = tuple((metric_name(k), label_value(row[k])) for k in names)
            with self.lock:
                for f in dict.fromkeys(stage.funcs):
                    if row[f.column] is not None:
                        self.gauges.setdefault(metric_name(f"{self.prefix}_{f.column}"), {})[labels] = float(row[f.column])

    def render(self) -> str:
        out = []

        def metric(name: str, kind: str, lines: list[str]) -> None:
            out.extend([f"# TYPE {name} {kind}", *lines])

        with self.lock:
            metric(f"{self.prefix}_events_total", "counter", [f"{self.prefix}_events_total {sum(self.by_type.values())}"])
            metric(f"{self.prefix}_events_by_type", "counter", [f'{self.prefix}_events_by_type{{type="{label_value(t)}"}} {self.by_type[t]}' for t in sorted({*TYPES, *self.by_type})])
            metric(f"{self.prefix}_bytes_processed", "counter", [f"{self.prefix}_bytes_processed {self.bytes}"])
            metric(f"{self.prefix}_correlations_found", "counter", [f"{self.prefix}_correlations_found {self.by_type['correlation']}"])
            for name in sorted(self.gauges):
                metric(name, "gauge", [f"{name}{{{','.join(f'{k}={chr(34)}{v}{chr(34)}' for k, v in labels)}}} {value:.6f}" if labels else f"{name} {value:.6f}" for labels, value in sorted(self.gauges[name].items())])
        return "\n".join(out) + "\n"

    def flush(self) -> str:
        """Writes the text over the file at once, and forgets the gauges."""
        text = self.render()
        if self.path:
            self.path.parent.mkdir(parents=True, exist_ok=True)
            fd, name = tempfile.mkstemp(dir=self.path.parent, prefix=self.path.name)
            with os.fdopen(fd, "w") as f:
                f.write(text)
            os.replace(name, self.path)
        with self.lock:
            self.gauges.clear()
        return text
