"""Packets of a capture decoded many at a time: whole columns by NumPy, as ``packets.dissect`` would give them one by one."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from typing import BinaryIO

import numpy as np
import pyarrow as pa

from .packets import _TCP_FLAGS, ETHERNET, FIELDS, HEADER, IPV4, VLAN, Capture

#: Bytes of a capture decoded together, and the longest packet that is believed.
BLOCK, LONGEST = 1 << 22, 1 << 28
Tests = list[tuple[tuple[str, ...], tuple]]


def blocks(file: BinaryIO, capture: Capture, at: int = HEADER, stop: int | None = None) -> Iterator[tuple[bytes, np.ndarray]]:
    """Bytes with the positions of the whole packets in them, from ``at`` (where ``file`` stands) on, that start before ``stop``."""
    captured = struct.Struct(capture.order + "I").unpack_from
    held = b""
    while data := file.read(BLOCK):
        held += data
        starts, pos, n = [], 0, len(held)
        while pos + 16 <= n and (stop is None or at + pos < stop):
            size = captured(held, pos + 8)[0]
            if size > LONGEST:
                stop = at + pos
                break
            if pos + 16 + size > n:
                break
            starts.append(pos)
            pos += 16 + size
        if starts:
            yield held, np.array(starts, dtype=np.int64)
        at, held = at + pos, held[pos:]
        if stop is not None and at >= stop:
            return


def _strings(numbers: np.ndarray, valid: np.ndarray, text) -> pa.Array:
    """``text`` of each number, formatted once for each distinct one; null where not valid."""
    distinct, which = np.unique(numbers, return_inverse=True)
    return pa.array([text(int(x)) for x in distinct], pa.string()).take(pa.array(which, mask=~valid))


def _mac(x: int) -> str:
    return ":".join(f"{x >> s & 255:02x}" for s in range(40, -8, -8))


def _ip(x: int) -> str:
    return ".".join(str(x >> s & 255) for s in (24, 16, 8, 0))


class _Bytes:
    """Numbers at positions of a block; positions past its end read as zero."""

    def __init__(self, held: bytes):
        self.raw = np.frombuffer(held + bytes(64), dtype=np.uint8)
        self.last = len(held) + 55

    def big(self, at: np.ndarray, size: int) -> np.ndarray:
        at = np.minimum(at, self.last)
        out = np.zeros(len(at), dtype=np.int64)
        for i in range(size):
            out = out << 8 | self.raw[at + i]
        return out

    def slices(self, base: np.ndarray, start: np.ndarray, length: np.ndarray, valid: np.ndarray) -> pa.Array:
        """Stretches as a binary array, in the order of increasing ``base``, at or behind which each lies.

        The block itself is an array of them and of the gaps between them, of which they are taken.
        """
        if not len(start):
            return pa.array([], pa.binary())
        begin = np.where(valid, start, base)
        edges = np.stack([begin, np.where(valid, start + length, begin)], axis=1).ravel().astype(np.int32)
        both = pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer(edges), pa.py_buffer(self.raw)])
        return both.take(pa.array(np.arange(0, len(edges) - 1, 2), mask=~valid))


def decode(held: bytes, starts: np.ndarray, capture: Capture, interface: str | None, tests: Tests) -> tuple[pa.Array, dict[str, pa.Array]]:
    """Times in nanoseconds, and the columns of FIELDS, of the packets at ``starts`` that pass ``tests``.

    A test is a choice of fields, one of which must be one of some values.
    """
    data = _Bytes(held)
    record = np.frombuffer(held, dtype=np.uint8)[starts[:, None] + np.arange(16)].view(capture.order + "u4").astype(np.int64)
    ns = record[:, 0] * 1_000_000_000 + record[:, 1] * capture.unit
    size, frame = record[:, 2], starts + 16
    ether = (size >= 14) & (capture.link == ETHERNET)
    kind = data.big(frame + 12, 2)
    tagged = ether & (kind == VLAN) & (size >= 18)
    kind = np.where(tagged, data.big(frame + 16, 2), kind)
    ip_at = np.where(tagged, 18, 14)
    ip = frame + ip_at
    first = data.big(ip, 1)
    is_ip = ether & (kind == IPV4) & (size >= ip_at + 20) & (first >> 4 == 4)
    head, total, proto = (first & 15) * 4, data.big(ip + 2, 2), data.big(ip + 9, 1)
    whole = is_ip & (head >= 20) & (data.big(ip + 6, 2) & 0x1FFF == 0)
    end = np.where(total >= head, np.minimum(size, ip_at + total), size)
    l4, length = ip + head, np.maximum(0, end - ip_at - head)
    tcp, udp, icmp = whole & (proto == 6) & (length >= 20), whole & (proto == 17) & (length >= 8), whole & (proto == 1) & (length >= 4)
    ports = data.big(l4, 2), data.big(l4 + 2, 2)
    long = lambda x, valid: pa.array(x, pa.int64(), mask=~valid)
    every = np.ones(len(starts), dtype=bool)
    flags = data.big(l4 + 13, 1)
    out = {
        "timestamp": pa.array(ns / 1e9),
        "length": long(record[:, 3], every),
        "captured_length": long(size, every),
        "interface": pa.array([interface], pa.string()).take(pa.array(np.zeros(len(starts), np.int64))),
        "ethernet_src": _strings(data.big(frame + 6, 6), ether, _mac),
        "ethernet_dst": _strings(data.big(frame, 6), ether, _mac),
        "ethernet_type": long(kind, ether),
        "ip_version": long(first >> 4, is_ip),
        "ip_src": _strings(data.big(ip + 12, 4), is_ip, _ip),
        "ip_dst": _strings(data.big(ip + 16, 4), is_ip, _ip),
        "ip_protocol": long(proto, is_ip),
        "ip_ttl": long(data.big(ip + 8, 1), is_ip),
        "ip_length": long(total, is_ip),
        "protocol": pa.array(["tcp", "udp", "icmp"]).take(pa.array(np.where(tcp, 0, np.where(udp, 1, 2)), mask=~(tcp | udp | icmp))),
        "tcp_src_port": long(ports[0], tcp),
        "tcp_dst_port": long(ports[1], tcp),
        "tcp_seq": long(data.big(l4 + 4, 4), tcp),
        "tcp_ack": long(data.big(l4 + 8, 4), tcp),
        **{f"tcp_flag_{name}": pa.array((flags >> i & 1).astype(bool), mask=~tcp) for i, name in enumerate(_TCP_FLAGS)},
        "tcp_window": long(data.big(l4 + 14, 2), tcp),
        "tcp_checksum": long(data.big(l4 + 16, 2), tcp),
        "tcp_urgent": long(data.big(l4 + 18, 2), tcp),
        "udp_src_port": long(ports[0], udp),
        "udp_dst_port": long(ports[1], udp),
        "udp_length": long(data.big(l4 + 4, 2), udp),
        "udp_checksum": long(data.big(l4 + 6, 2), udp),
        "icmp_type": long(data.big(l4, 1), icmp),
        "icmp_code": long(data.big(l4 + 1, 1), icmp),
        "icmp_checksum": long(data.big(l4 + 2, 2), icmp),
    }
    skip = np.where(tcp, np.maximum(20, (data.big(l4 + 12, 1) >> 4) * 4), np.where(udp, 8, 4))
    has, start, left = tcp | udp | icmp, l4 + skip, np.maximum(0, length - skip)
    times = pa.array(ns)
    if tests:
        chosen = np.flatnonzero(_passing(out | {"payload": None}, tests, len(starts)))
        keep = pa.array(chosen)
        times, out = times.take(keep), {name: c.take(keep) for name, c in out.items()}
        has, start, left, frame = has[chosen], start[chosen], left[chosen], frame[chosen]
    out["payload"] = data.slices(frame, start, left, has)
    return times, {name: out[name] for name, _ in FIELDS}


def _passing(columns: dict, tests: Tests, n: int) -> np.ndarray:
    """Which packets pass; a test on a column that isn't here is left to whoever asked."""
    ok = np.ones(n, dtype=bool)
    for names, values in tests:
        one = np.zeros(n, dtype=bool)
        for name in names:
            column = columns.get(name)
            if column is None:
                one[:] = True
                continue
            plain = column.to_numpy(zero_copy_only=False)
            for v in values:
                one |= np.asarray(plain == v, dtype=bool) if v is not None else np.asarray(column.is_null())
        ok &= one
    return ok


def decoded(file: BinaryIO, interface: str | None, tests: Tests, capture: Capture | None = None, at: int = HEADER, stop: int | None = None) -> Iterator[tuple[pa.Array, dict[str, pa.Array]]]:
    """The same of an open capture, block by block; with ``capture``, ``file`` stands at ``at`` behind the header."""
    capture = capture or Capture.of(file.read(HEADER))
    for held, starts in blocks(file, capture, at, stop):
        times, columns = decode(held, starts, capture, interface, tests)
        if len(times):
            yield times, columns
