"""Flows: packets of one connection, and what only shows over several of them.

A connection is a protocol and two endpoints, whichever way a packet goes. The client is the side
that sent the first SYN without ACK, or else the first packet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _endpoint(side: str) -> Column:
    port = F.coalesce(F.col(f"data.tcp_{side}_port"), F.col(f"data.udp_{side}_port"), F.lit(0).cast("long"))
    return F.struct(F.col(f"data.ip_{side}").alias("ip"), port.alias("port"))


def flows(packets: DataFrame) -> DataFrame:
    """One network event for each connection among ``packets`` (timestamp_ns, data): type, timestamp_ns (its end), ts, data.

    ``data``: protocol, client and server (ip, port), packets, bytes, start_ns, duration_ms, latency_ms
    (from the client's first packet to the server's first answer to it; null without one) and
    tcp.retransmits (segments with data, SYN or FIN whose sequence number and length that side had sent
    before). Packets without addresses are in no flow. Segments are counted before
    flows are, so one busy connection is not gathered in a task.
    """
    src, dst = _endpoint("src"), _endpoint("dst")
    tcp = F.col("data.protocol") == "tcp"
    rows = packets.where(F.col("data.ip_src").isNotNull() & F.col("data.protocol").isNotNull()).select(
        F.col("data.protocol").alias("protocol"),
        F.least(src, dst).alias("a"),
        F.greatest(src, dst).alias("b"),
        (src <= dst).alias("forward"),
        F.col("timestamp_ns").alias("ns"),
        F.col("data.length").alias("length"),
        F.coalesce(F.col("data.tcp_flag_syn"), F.lit(False)).alias("syn"),
        F.coalesce(F.col("data.tcp_flag_ack"), F.lit(False)).alias("ack"),
        F.when(tcp & ((F.coalesce(F.octet_length("data.payload"), F.lit(0)) > 0) | F.col("data.tcp_flag_syn") | F.col("data.tcp_flag_fin")), F.struct(F.col("data.tcp_seq").alias("seq"), F.octet_length("data.payload").alias("n"), F.col("data.tcp_flag_syn").alias("syn"), F.col("data.tcp_flag_fin").alias("fin"))).alias("segment"),
    )
    connection = ["protocol", "a", "b"]
    opening = F.col("syn") & ~F.col("ack")
    segments = rows.groupBy(*connection, "forward", "segment").agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("bytes"), F.min("ns").alias("first"), F.max("ns").alias("last"), F.min(F.when(opening, F.col("ns"))).alias("opened"))
    sides = [F.min(F.when(F.col("forward") == side, F.col("first"))).alias(f"first_{name}") for side, name in ((True, "ab"), (False, "ba"))]
    found = segments.groupBy(*connection).agg(
        F.sum("n").alias("packets"),
        F.sum("bytes").alias("bytes"),
        F.min("first").alias("start_ns"),
        F.max("last").alias("end_ns"),
        F.sum(F.when(F.col("segment").isNotNull(), F.col("n") - 1).otherwise(0)).alias("retransmits"),
        F.min(F.struct(F.coalesce("opened", F.lit(2**63 - 1)).alias("opened"), "first", (~F.col("forward")).alias("back"))).alias("begins"),
        *sides,
    )
    client_is_a = ~F.col("begins.back")
    asked, answered = F.when(client_is_a, F.col("first_ab")).otherwise(F.col("first_ba")), F.when(client_is_a, F.col("first_ba")).otherwise(F.col("first_ab"))
    data = F.struct(
        "protocol",
        F.when(client_is_a, F.col("a")).otherwise(F.col("b")).alias("client"),
        F.when(client_is_a, F.col("b")).otherwise(F.col("a")).alias("server"),
        "packets",
        "bytes",
        "start_ns",
        ((F.col("end_ns") - F.col("start_ns")) / 1e6).alias("duration_ms"),
        F.when(answered >= asked, (answered - asked) / 1e6).alias("latency_ms"),
        F.struct("retransmits").alias("tcp"),
    )
    return found.select(F.lit("network").alias("type"), F.col("end_ns").alias("timestamp_ns"), F.timestamp_micros(F.expr("end_ns div 1000")).alias("ts"), data.alias("data"))
