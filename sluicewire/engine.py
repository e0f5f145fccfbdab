"""A monitor over several inputs: one stream of events, queries and sinks on it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.correlation import log_network
from .plans import query
from .sources.pcap import read_pcap, stream_live, stream_pcap
from .sources.text import read_logs, stream_logs, stream_udp, tail_logs


def union_events(*inputs: DataFrame) -> DataFrame:
    """All inputs as one stream of events; columns that an input lacks are null.

    Payloads of different types become VARIANT, without their null fields: these are missing, not null.
    """
    kinds = {d.schema["data"].dataType.simpleString() for d in inputs if "data" in d.columns}
    if len(kinds) > 1:
        inputs = tuple(d if "data" not in d.columns or d.schema["data"].dataType.typeName() == "variant" else d.withColumn("data", F.parse_json(F.to_json("data"))) for d in inputs)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), inputs)


@dataclass
class Monitor:
    """Inputs are added, then queried together; ``streaming``: they are followed, else read once."""

    spark: SparkSession
    streaming: bool = False
    watermark: str = "10 seconds"
    inputs: list[DataFrame] = field(default_factory=list)
    within_ms: int | None = 100

    def add(self, events: DataFrame) -> Monitor:
        self.inputs.append(events)
        return self

    def add_log_input(self, path: str, fmt: str | None = None, where: str | None = None, follow: bool = True, **options) -> Monitor:
        """Log files; a stream takes lines as they are appended or, without ``follow``, files as they appear (from any store that Spark reads)."""
        read = read_logs if not self.streaming else tail_logs if follow else stream_logs
        return self.add(read(self.spark, path, fmt, where, **options))

    def add_network_input(self, path: str, where: str | None = None) -> Monitor:
        """Capture files; a stream takes packets as they are appended."""
        return self.add((stream_pcap if self.streaming else read_pcap)(self.spark, path, where))

    def add_live_input(self, interface: str | None = None, where: str | None = None) -> Monitor:
        """Packets of a network interface of the driver; only streams have them."""
        if not self.streaming:
            raise ValueError("live packets come only to a streaming monitor")
        return self.add(stream_live(self.spark, interface, where))

    def add_udp_input(self, address: str, fmt: str = "syslog", where: str | None = None, pattern: str | None = None) -> Monitor:
        """Datagrams to ``host:port``; only streams have them."""
        if not self.streaming:
            raise ValueError("datagrams come only to a streaming monitor")
        host, _, port = address.rpartition(":")
        return self.add(stream_udp(self.spark, int(port), host or "0.0.0.0", fmt, where, pattern))

    def enable_correlation(self, within_ms: int | None = 100) -> Monitor:
        """The built-in correlator's window; None turns it off."""
        self.within_ms = within_ms
        return self

    def events(self) -> DataFrame:
        if not self.inputs:
            raise ValueError("no inputs")
        out = union_events(*self.inputs)
        return out.withWatermark("ts", self.watermark) if out.isStreaming else out

    def query(self, text: str, **options) -> DataFrame:
        return query(self.events(), text, **options)

    def correlations(self) -> DataFrame:
        if self.within_ms is None:
            raise ValueError("correlation is turned off")
        return log_network(self.events(), self.within_ms)

    def on_event(self, handler: Callable[[DataFrame, int], None], text: str | None = None, checkpoint: str | None = None, once: bool = False):
        """Starts a streaming query that hands every batch of results to ``handler(batch, id)``."""
        df = self.query(text) if text else self.events()
        writer = df.writeStream.foreachBatch(handler)
        if checkpoint:
            writer = writer.option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if once else writer).start()
