"""HTTP and DNS payloads of packets to structs, decoded in batches."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

HTTP = "kind string, method string, uri string, version string, status_code int, reason string, headers map<string,string>"
_RR = "array<struct<name:string,type:int,class:int,ttl:long,rdata:string>>"
DNS = f"id int, qr int, opcode int, aa int, tc int, rd int, ra int, rcode int, qdcount int, ancount int, nscount int, arcount int, questions array<struct<name:string,type:int,class:int>>, answers {_RR}, authorities {_RR}, additionals {_RR}"
METHODS = ("GET", "POST", "PUT", "DELETE", "HEAD", "OPTIONS", "PATCH", "CONNECT", "TRACE")
#: Compression pointers that a name may follow; more are a loop.
MAX_POINTERS = 32


def parse_http(data: bytes | None) -> dict | None:
    """The start line and headers of an HTTP/1.x message, or None. Header names are lower case; the last of equal ones wins."""
    if not data:
        return None
    head = data.partition(b"\r\n\r\n")[0].decode("latin-1")
    first, *lines = head.replace("\r\n", "\n").split("\n")
    parts = first.split(" ", 2)
    out: dict = dict.fromkeys(("method", "uri", "version", "status_code", "reason"))
    if parts[0].startswith("HTTP/1.") and len(parts) >= 2 and parts[1].isdigit():
        out |= {"kind": "response", "version": parts[0], "status_code": int(parts[1]), "reason": parts[2] if len(parts) > 2 else None}
    elif parts[0] in METHODS and len(parts) == 3 and parts[2].startswith("HTTP/1."):
        out |= {"kind": "request", "method": parts[0], "uri": parts[1], "version": parts[2]}
    else:
        return None
    out["headers"] = {k.strip().lower(): v.strip() for k, colon, v in (x.partition(":") for x in lines) if colon}
    return out


def _name(data: bytes, at: int) -> tuple[str, int]:
    labels, after, hops = [], None, 0
    while True:
        n = data[at]
        if n >= 0xC0:
            hops += 1
            if hops > MAX_POINTERS:
                raise ValueError("looping name")
            after = at + 2 if after is None else after
            at = (n & 0x3F) << 8 | data[at + 1]
        elif n:
            if at + 1 + n > len(data):
                raise ValueError("name past the end")
            labels.append(data[at + 1 : at + 1 + n].decode("latin-1"))
            at += 1 + n
        else:
            return ".".join(labels), at + 1 if after is None else after


def _records(data: bytes, at: int, n: int) -> tuple[list[dict], int]:
    out = []
    for _ in range(n):
        name, at = _name(data, at)
        kind, cls, ttl, size = struct.unpack_from(">HHIH", data, at)
        at += 10
        body = data[at : at + size]
        if len(body) < size:
            raise ValueError("record past the end")
        rdata = None
        if kind == 1 and size == 4:
            rdata = ".".join(map(str, body))
        elif kind == 28 and size == 16:
            rdata = ":".join(f"{x:x}" for x in struct.unpack(">8H", body))
        elif kind in (2, 5, 12):
            rdata = _name(data, at)[0]
        out.append({"name": name, "type": kind, "class": cls, "ttl": ttl, "rdata": rdata})
        at += size
    return out, at


def parse_dns(data: bytes | None) -> dict | None:
    """A DNS message, or None if it's cut off or malformed."""
    if not data or len(data) < 12:
        return None
    ident, flags, qd, an, ns, ar = struct.unpack_from(">6H", data)
    out: dict = {"id": ident, "qr": flags >> 15, "opcode": flags >> 11 & 15, "aa": flags >> 10 & 1, "tc": flags >> 9 & 1, "rd": flags >> 8 & 1, "ra": flags >> 7 & 1, "rcode": flags & 15, "qdcount": qd, "ancount": an, "nscount": ns, "arcount": ar}
    try:
        at, questions = 12, []
        for _ in range(qd):
            name, at = _name(data, at)
            kind, cls = struct.unpack_from(">HH", data, at)
            questions.append({"name": name, "type": kind, "class": cls})
            at += 4
        out["questions"] = questions
        for key, n in (("answers", an), ("authorities", ns), ("additionals", ar)):
            out[key], at = _records(data, at, n)
    except (IndexError, struct.error, ValueError):
        return None
    return out


def _column(parse, ddl: str):
    fields = [c.strip().split(" ")[0] for c in ddl.split(", ")]

    def run(payloads: pd.Series) -> pd.DataFrame:
        got = [parse(p) or {} for p in payloads]
        return pd.DataFrame({f: pd.Series([g.get(f) for g in got], dtype=object) for f in fields})

    return run


def http_message(payload: Column) -> Column:
    """A struct of a payload's HTTP message; all its fields are null if there is none."""
    return F.pandas_udf(_column(parse_http, HTTP), HTTP)(payload)


def dns_message(payload: Column) -> Column:
    return F.pandas_udf(_column(parse_dns, DNS), DNS)(payload)
