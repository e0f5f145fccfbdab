"""Packet dissection: Ethernet, IPv4, TCP, UDP and ICMP headers to flat fields."""

from __future__ import annotations

import io
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

ETHERNET, VLAN, IPV4 = 1, 0x8100, 0x0800
_TCP_FLAGS = ("fin", "syn", "rst", "psh", "ack", "urg", "ece", "cwr")

#: Field names and Spark types of a packet event's data.
FIELDS = (
    ("timestamp", "double"), ("length", "long"), ("captured_length", "long"), ("interface", "string"),
    ("ethernet_src", "string"), ("ethernet_dst", "string"), ("ethernet_type", "long"),
    ("ip_version", "long"), ("ip_src", "string"), ("ip_dst", "string"), ("ip_protocol", "long"), ("ip_ttl", "long"), ("ip_length", "long"),
    ("protocol", "string"),
    ("tcp_src_port", "long"), ("tcp_dst_port", "long"), ("tcp_seq", "long"), ("tcp_ack", "long"),
    *((f"tcp_flag_{f}", "boolean") for f in _TCP_FLAGS),
    ("tcp_window", "long"), ("tcp_checksum", "long"), ("tcp_urgent", "long"),
    ("udp_src_port", "long"), ("udp_dst_port", "long"), ("udp_length", "long"), ("udp_checksum", "long"),
    ("icmp_type", "long"), ("icmp_code", "long"), ("icmp_checksum", "long"),
    ("payload", "binary"),
)


def _mac(b: bytes) -> str:
    return ":".join(f"{x:02x}" for x in b)


def _ip(b: bytes) -> str:
    return ".".join(map(str, b))


def dissect(frame: bytes) -> dict:
    """Header fields of an Ethernet frame, as far as its bytes go; the rest of layer 4 is ``payload``."""
    out: dict = {}
    if len(frame) < 14:
        return out
    kind, at = struct.unpack_from(">H", frame, 12)[0], 14
    out |= {"ethernet_dst": _mac(frame[:6]), "ethernet_src": _mac(frame[6:12])}
    if kind == VLAN and len(frame) >= 18:
        kind, at = struct.unpack_from(">H", frame, 16)[0], 18
    out["ethernet_type"] = kind
    if kind != IPV4 or len(frame) < at + 20 or frame[at] >> 4 != 4:
        return out
    head = (frame[at] & 15) * 4
    total, fragment = struct.unpack_from(">H", frame, at + 2)[0], struct.unpack_from(">H", frame, at + 6)[0] & 0x1FFF
    proto = frame[at + 9]
    out |= {"ip_version": 4, "ip_length": total, "ip_ttl": frame[at + 8], "ip_protocol": proto, "ip_src": _ip(frame[at + 12 : at + 16]), "ip_dst": _ip(frame[at + 16 : at + 20])}
    if head < 20 or fragment:
        return out
    end = min(len(frame), at + total) if total >= head else len(frame)
    seg = frame[at + head : end]
    if proto == 6 and len(seg) >= 20:
        src, dst, seq, ack, off, flags, window, checksum, urgent = struct.unpack_from(">HHIIBBHHH", seg)
        out |= {"protocol": "tcp", "tcp_src_port": src, "tcp_dst_port": dst, "tcp_seq": seq, "tcp_ack": ack, "tcp_window": window, "tcp_checksum": checksum, "tcp_urgent": urgent}
        out |= {f"tcp_flag_{name}": bool(flags >> i & 1) for i, name in enumerate(_TCP_FLAGS)}
        out["payload"] = seg[max(20, (off >> 4) * 4) :]
    elif proto == 17 and len(seg) >= 8:
        src, dst, length, checksum = struct.unpack_from(">HHHH", seg)
        out |= {"protocol": "udp", "udp_src_port": src, "udp_dst_port": dst, "udp_length": length, "udp_checksum": checksum, "payload": seg[8:]}
    elif proto == 1 and len(seg) >= 4:
        kind, code, checksum = struct.unpack_from(">BBH", seg)
        out |= {"protocol": "icmp", "icmp_type": kind, "icmp_code": code, "icmp_checksum": checksum, "payload": seg[4:]}
    return out


class PcapError(ValueError):
    """The bytes are no capture file."""


#: The first bytes of a capture file: byte order, and nanoseconds in a unit of its times.
MAGIC = {b"\xd4\xc3\xb2\xa1": ("<", 1000), b"\x4d\x3c\xb2\xa1": ("<", 1), b"\xa1\xb2\xc3\xd4": (">", 1000), b"\xa1\xb2\x3c\x4d": (">", 1)}
HEADER = 24


@dataclass(frozen=True)
class Capture:
    """What a capture file's header says."""

    order: str
    unit: int
    link: int

    @classmethod
    def of(cls, header: bytes) -> Capture:
        if header[:4] not in MAGIC or len(header) < HEADER:
            raise PcapError("not a pcap file")
        order, unit = MAGIC[header[:4]]
        return cls(order, unit, struct.unpack_from(order + "I", header, 20)[0] & 0xFFFF)


def raw_packets(file: BinaryIO, capture: Capture, at: int = HEADER, stop: int | None = None) -> Iterator[tuple[int, int, int, bytes]]:
    """(position after it, time in nanoseconds, length on the wire, bytes) of the packets from ``at`` on, that start before ``stop``.

    ``file`` stands at ``at``, the start of a packet. Only one packet is held at a time; one that is
    cut off at the end of the file ends it.
    """
    head = struct.Struct(capture.order + "IIII")
    while stop is None or at < stop:
        record = file.read(16)
        if len(record) < 16:
            return
        sec, sub, captured, length = head.unpack(record)
        body = file.read(captured)
        if len(body) < captured:
            return
        at += 16 + captured
        yield at, sec * 1_000_000_000 + sub * capture.unit, length, body


def read_packets(file: BinaryIO, interface: str | None = None, capture: Capture | None = None, at: int = HEADER, stop: int | None = None) -> Iterator[tuple[int, dict]]:
    """(time in nanoseconds, fields) of each packet of an open capture file (either byte order, micro- or nanoseconds).

    With ``capture``, ``file`` stands at ``at`` behind the header.
    """
    capture = capture or Capture.of(file.read(HEADER))
    for _, ns, length, body in raw_packets(file, capture, at, stop):
        fields = {"timestamp": ns / 1e9, "length": length, "captured_length": len(body), "interface": interface}
        yield ns, fields | dissect(body) if capture.link == ETHERNET else fields


def packets(data: bytes, interface: str | None = None) -> Iterator[tuple[int, dict]]:
    """The same of a capture file's bytes."""
    return read_packets(io.BytesIO(data), interface)


def file_header() -> bytes:
    """The header of a capture file in nanoseconds, little-endian, of Ethernet frames."""
    return struct.pack("<IHHiIII", 0xA1B23C4D, 2, 4, 0, 0, 65535, ETHERNET)


def packet_record(ns: int, frame: bytes) -> bytes:
    """A packet as it stands behind such a header."""
    return struct.pack("<IIII", ns // 1_000_000_000, ns % 1_000_000_000, len(frame), len(frame)) + frame


def write_pcap(frames: list[tuple[int, bytes]]) -> bytes:
    """A capture file of (time in nanoseconds, Ethernet frame)."""
    return file_header() + b"".join(packet_record(ns, frame) for ns, frame in frames)
