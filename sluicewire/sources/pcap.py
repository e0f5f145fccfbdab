"""Capture files as network events.

Spark lists the files, and executors read them in blocks of packets, one task for one or more files. A filter's
conjuncts on ports, addresses and protocol are pushed into the decoder, so packets that fail them are never made
into rows; the whole filter is applied again after.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fields import NETWORK_ALIASES
from ..lang import ast, parse_filter
from ..operators.predicates import keep
from .bulk import decoded
from .packets import FIELDS
from .store import opened

_ARROW = {"double": pa.float64(), "long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}
_DATA = pa.struct([(n, _ARROW[t]) for n, t in FIELDS])
_SCHEMA = pa.schema([("timestamp_ns", pa.int64()), ("path", pa.string()), ("data", _DATA)])
_DDL = "timestamp_ns long, path string, data struct<" + ", ".join(f"{n}:{t}" for n, t in FIELDS) + ">"
_PUSHABLE = ("dst_port", "src_port", "src_ip", "dst_ip", "protocol", "ip_src", "ip_dst", "tcp_dst_port", "tcp_src_port", "udp_dst_port", "udp_src_port", "ip_protocol")


def pushed(where: ast.Expr | None) -> list[tuple[tuple[str, ...], object]]:
    """Top-level conjuncts of the kind field == literal, as (fields of which one must equal, value)."""
    if isinstance(where, ast.And):
        return pushed(where.left) + pushed(where.right)
    if isinstance(where, ast.Compare) and where.op == "==" and not isinstance(where.value, bool):
        name = where.field.removeprefix("network.")
        if name in _PUSHABLE:
            value = where.value.text if isinstance(where.value, ast.Word) else where.value
            return [(NETWORK_ALIASES.get(name, (name,)), value)]
    return []


def capture_filter(text: str) -> ast.Expr:
    """A predicate of the query language, or the usual subset of capture filter syntax: proto, [src|dst] port N, [src|dst] host A, with and, or, not."""
    words = text.replace("(", " ( ").replace(")", " ) ").split()
    at = 0

    def take(*options: str) -> str | None:
        nonlocal at
        if at < len(words) and words[at].lower() in options:
            at += 1
            return words[at - 1].lower()
        return None

    def primitive() -> ast.Expr:
        nonlocal at
        if take("("):
            out = either()
            if not take(")"):
                raise ValueError("expected ) in capture filter")
            return out
        proto = take("tcp", "udp", "icmp")
        side, what = take("src", "dst"), take("port", "host")
        if not what:
            if not proto or side:
                raise ValueError(f"not a capture filter: {text}")
            return ast.Compare("network.protocol", "==", proto)
        value = words[at] if at < len(words) else ""
        at += 1
        kind, literal = ("port", int(value)) if what == "port" else ("ip", value)
        tests = [ast.Compare(f"network.{s}_{kind}", "==", literal) for s in ([side] if side else ["src", "dst"])]
        out: ast.Expr = tests[0] if side else ast.Or(*tests)
        return ast.And(ast.Compare("network.protocol", "==", proto), out) if proto else out

    def negated() -> ast.Expr:
        return ast.Not(negated()) if take("not", "!") else primitive()

    def both() -> ast.Expr:
        out = negated()
        while take("and", "&&"):
            out = ast.And(out, negated())
        return out

    def either() -> ast.Expr:
        out = both()
        while take("or", "||"):
            out = ast.Or(out, both())
        return out

    try:
        out = either()
        if at == len(words):
            return out
    except (ValueError, IndexError):
        pass
    return parse_filter(text)


def read_pcap(spark: SparkSession, path: str, where: str | None = None, interface: str | None = None, whole: bool = False) -> DataFrame:
    """Network events (type, timestamp_ns, ts, source, data) of the capture files at ``path``.

    ``whole``: through Spark's reader of whole files (up to 2 GB each), for stores that Arrow's file
    systems don't reach.
    """
    expr = capture_filter(where) if where else None

    tests = [(names, (value,)) for names, value in pushed(expr)]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            contents = batch.column(1) if whole else [None] * batch.num_rows
            for name, content in zip(batch.column(0).to_pylist(), contents, strict=True):
                with io.BytesIO(content.as_py()) if whole else opened(name) as file:
                    for times, columns in decoded(file, interface, tests):
                        data = pa.StructArray.from_arrays(list(columns.values()), fields=list(_DATA))
                        yield pa.RecordBatch.from_arrays([times, pa.array([name] * len(times), pa.string()), data], schema=_SCHEMA)

    raw = spark.read.format("binaryFile").load(path).select("path", *(["content"] if whole else [])).mapInArrow(decode, _DDL)
    return network_events(raw, expr)


def network_events(raw: DataFrame, where: ast.Expr | None = None) -> DataFrame:
    """The envelope of decoded packets (timestamp_ns, path, data), and their filter."""
    out = raw.select(F.lit("network").alias("type"), "timestamp_ns", F.timestamp_micros(F.expr("timestamp_ns div 1000")).alias("ts"), F.struct(F.lit("pcap").alias("type"), F.col("path").alias("name")).alias("source"), "data")
    return keep(out, where) if where is not None else out


def stream_pcap(spark: SparkSession, path: str, where: str | None = None, interface: str | None = None) -> DataFrame:
    """The same as a stream of the packets that captures at ``path`` have and get."""
    from .pcap_format import register

    register(spark)
    reader = spark.readStream.format("pcap")
    return _from_flat((reader.option("interface", interface) if interface else reader).load(path), where)


def stream_live(spark: SparkSession, interface: str | None = None, where: str | None = None) -> DataFrame:
    """The same as a stream of the packets that the driver's network interface (or all of them) gets and sends."""
    from .received import register

    register(spark)
    reader = spark.readStream.format("live")
    return _from_flat((reader.option("interface", interface) if interface else reader).load(), where)


def _from_flat(flat: DataFrame, where: str | None) -> DataFrame:
    return network_events(flat.select("timestamp_ns", "path", F.struct(*[n for n, _ in FIELDS]).alias("data")), capture_filter(where) if where else None)
