"""MPEG audio columns: write payloads into audio frames, and probe audio bytes of any origin.

``encode`` stores bytes losslessly: each 576-byte block is the ancillary data of one silent MPEG-1
Layer III frame, between an ID3v2 tag (with the unpadded length), an ``Info`` frame with a seek
table, and the end. ``probe`` resynchronises on frame headers in any byte string, parses ID3v1 and
ID3v2 tags and Xing, Info and VBRI tables with their seek entries, verifies the frame checksums of
all layers, and gives exact durations (samples over rate) and the byte offset of every frame. Frames
come first: bytes that a frame covers are never read as a tag. Free-format frames (without a bit
rate) are skipped.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import accumulate

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import beside, documents, holds, named

BLOCK = 576
#: kbit/s by (MPEG-1, layer) and (MPEG-2/2.5, layer); fixed values of ISO 11172-3 and 13818-3.
BITRATES = {
    (1, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}


@dataclass(frozen=True)
class Header:
    version: int  # bits: 3 MPEG-1, 2 MPEG-2, 0 MPEG-2.5
    layer: int
    protected: bool
    rate: int
    kbps: int
    mono: bool
    length: int
    samples: int
    bound: int = 32  # the subband from which joint stereo shares its allocations

    @property
    def side(self) -> int:
        """Bytes of Layer III side information."""
        return (17 if self.mono else 32) if self.version == 3 else (9 if self.mono else 17)

    def allocation_bits(self) -> tuple[int, ...]:
        """For each subband of Layer II the bits of an allocation; fixed values of ISO 11172-3 (B.2) and 13818-3 (B.1)."""
        if self.version != 3:
            return (4,) * 4 + (3,) * 7 + (2,) * 19
        each = self.kbps if self.mono else self.kbps // 2
        if each <= 48 and self.rate != 48000 or each < 56:
            return (4,) * 2 + (3,) * (10 if self.rate == 32000 else 6)
        return (4,) * 3 + (4,) * 8 + (3,) * 12 + (2,) * (4 if self.rate == 48000 or each <= 80 else 7)


@lru_cache(maxsize=4096)
def parse_header(word: bytes) -> Header | None:
    """A frame header from four bytes, or None if they can't be one (free format is not taken)."""
    if len(word) < 4 or word[0] != 0xFF or word[1] & 0xE0 != 0xE0:
        return None
    version, layer = word[1] >> 3 & 3, 4 - (word[1] >> 1 & 3)
    rate_at, bitrate_at = word[2] >> 2 & 3, word[2] >> 4
    if version == 1 or layer == 4 or rate_at == 3 or bitrate_at in (0, 15):
        return None
    kbps, rate, pad = BITRATES[1 if version == 3 else 2, layer][bitrate_at], RATES[version][rate_at], word[2] >> 1 & 1
    samples = 384 if layer == 1 else 1152 if layer == 2 or version == 3 else 576
    length = (12000 * kbps // rate + pad) * 4 if layer == 1 else samples * 125 * kbps // rate + pad
    bound = 4 * (word[3] >> 4 & 3) + 4 if word[3] >> 6 == 1 else 32
    return Header(version, layer, not word[1] & 1, rate, kbps, word[3] >> 6 == 3, length, samples, bound)


@lru_cache(maxsize=4096)
def crc16(data: bytes, bits: int | None = None) -> int:
    """The frame checksum of the first ``bits`` bits (all): polynomial 0x8005, initial value 0xFFFF."""
    crc, left = 0xFFFF, 8 * len(data) if bits is None else bits
    for b in data:
        if left < 8:
            b &= 0xFF00 >> left
        crc ^= b << 8
        for _ in range(min(8, left)):
            crc = (crc << 1 ^ 0x8005 if crc & 0x8000 else crc << 1) & 0xFFFF
        left = max(0, left - 8)
    return crc


def covered_bits(data: bytes, at: int, h: Header) -> int:
    """How many bits after the checksum of the frame at ``at`` it covers, besides the header's last 16."""
    if h.layer == 3:
        return 8 * h.side
    channels = 1 if h.mono else 2
    if h.layer == 1:
        return 4 * (32 if h.mono else 2 * h.bound + 32 - h.bound)
    # Layer II: the allocations, then two bits for each channel of a subband that has any
    body, x, used = int.from_bytes(data[at + 6 : at + 46].ljust(40, b"\0")), 0, 0
    for subband, n in enumerate(h.allocation_bits()):
        shared = subband >= h.bound
        for _ in range(1 if shared else channels):
            used += bool(body >> (320 - x - n) & ((1 << n) - 1)) * (channels if shared else 1)
            x += n
    return x + 2 * used


def checksum_ok(data: bytes, at: int, h: Header) -> bool:
    """Whether a protected frame's checksum is right."""
    bits = covered_bits(data, at, h)
    body = data[at + 6 : min(at + h.length, at + 6 + (bits + 7) // 8)]
    return 8 * len(body) >= bits and crc16(data[at + 2 : at + 4] + body, 16 + bits) == int.from_bytes(data[at + 4 : at + 6])


# 224 kbit/s at 48 kHz, mono, with checksum: 672 bytes, of which 4 + 2 + 17 are not free.
_HEAD = bytes((0xFF, 0xFA, 0xC4, 0xC0))
_FRAME = parse_header(_HEAD)
_LEAD = _HEAD + struct.pack(">H", crc16(_HEAD[2:] + bytes(_FRAME.side))) + bytes(_FRAME.side)
_REST = bytes(_FRAME.length - len(_LEAD) - BLOCK)


def _syncsafe(n: int) -> bytes:
    return bytes(n >> s & 127 for s in (21, 14, 7, 0))


def encode(data: bytes) -> bytes:
    """Audio that carries ``data``, padded with bytes 255 to a positive multiple of 576."""
    payload = data + b"\xff" * (-len(data) % BLOCK if data else BLOCK)
    n = len(payload) // BLOCK
    body = b"\x03payload_bytes\x00" + str(len(data)).encode()
    frame = b"TXXX" + _syncsafe(len(body)) + b"\0\0" + body
    tag = b"ID3\x04\0\0" + _syncsafe(len(frame)) + frame
    total = (n + 1) * _FRAME.length
    toc = bytes(min(255, 256 * (1 + n * i // 100) // (n + 1)) for i in range(100))
    info = b"Info" + struct.pack(">III", 7, n, total) + toc
    first = _LEAD + info + bytes(_FRAME.length - len(_LEAD) - len(info))
    return b"".join([tag, first, *(x for i in range(n) for x in (_LEAD, payload[i * BLOCK : (i + 1) * BLOCK], _REST))])


@dataclass
class Probe:
    frames: int = 0
    samples: int = 0
    rate: int = 0
    version: int = 0
    layer: int = 0
    mono: bool = False
    kbps_min: int = 0
    kbps_max: int = 0
    checksums: int = 0
    checksums_bad: int = 0
    skipped: int = 0
    table: str = ""
    table_frames: int = 0
    table_bytes: int = 0
    table_seek: list[int] = field(default_factory=list)
    tags: dict[str, str] = field(default_factory=dict)
    offsets: list[int] = field(default_factory=list)

    def feature(self) -> str:
        seek = zlib.crc32(struct.pack(f"<{len(self.offsets)}Q", *self.offsets))
        return f"v{self.version}l{self.layer}:{self.rate}:{'mono' if self.mono else 'stereo'}:{self.kbps_min}-{self.kbps_max}:frames={self.frames}:duration={self.samples}/{self.rate or 1}:crc={self.checksums - self.checksums_bad}/{self.checksums}:skipped={self.skipped}:table={self.table or '-'}/{self.table_frames}/{self.table_bytes}:seek={seek:08x}"


def _synchsafe_int(raw: bytes) -> int:
    return sum((b & 127) << s for b, s in zip(raw, range(7 * (len(raw) - 1), -1, -7), strict=True))


def _id3v2(data: bytes, tags: dict[str, str]) -> int:
    """Reads an ID3v2.2, 2.3 or 2.4 tag at the start; the offset after it."""
    if data[:3] != b"ID3" or len(data) < 10 or max(data[6:10]) > 127:
        return 0
    major, flags, size = data[3], data[5], _synchsafe_int(data[6:10])
    body, at = data[10 : 10 + size], 0
    if flags & 0x80 and major < 4:  # zero bytes were put in behind each 255
        body = body.replace(b"\xff\0", b"\xff")
    if flags & 0x40 and major >= 3 and len(body) >= 4:  # an extended header
        at = _synchsafe_int(body[:4]) if major >= 4 else int.from_bytes(body[:4]) + 4
    wide = 3 if major < 3 else 4
    head = 6 if major < 3 else 10
    while at + head <= len(body) and body[at]:
        name, raw = body[at : at + wide], body[at + wide : at + 2 * wide]
        n = _synchsafe_int(raw) if major >= 4 else int.from_bytes(raw)
        value = body[at + head : at + head + n]
        if major >= 4:
            if body[at + 9] & 2 or flags & 0x80:
                value = value.replace(b"\xff\0", b"\xff")
            value = value[4:] if body[at + 9] & 1 else value
        if name[:1] == b"T" and value:
            text = value[1:].decode({0: "latin-1", 1: "utf-16", 2: "utf-16-be"}.get(value[0], "utf-8"), "replace").rstrip("\0")
            key, _, value = text.partition("\0") if name in (b"TXXX", b"TXX") else (name.decode("latin-1"), "", text)
            tags[key] = value
        at += head + n
    return min(len(data), 10 + size + (10 if flags & 0x10 else 0))


def _id3v1(raw: bytes) -> dict[str, str]:
    return {k: raw[a:b].split(b"\0")[0].decode("latin-1").strip() for k, a, b in (("title", 3, 33), ("artist", 33, 63), ("album", 63, 93))}


def _table(data: bytes, at: int, h: Header, p: Probe) -> bool:
    """Reads a Xing, Info or VBRI table from the frame at ``at``; whether it has one."""
    end = at + h.length
    for crc in (0, 2):
        x = at + 4 + crc + h.side
        if data[x : x + 4] in (b"Xing", b"Info") and x + 16 <= end:
            p.table = data[x : x + 4].decode()
            flags, x = int.from_bytes(data[x + 4 : x + 8]), x + 8
            if flags & 1:
                p.table_frames, x = int.from_bytes(data[x : x + 4]), x + 4
            if flags & 2:
                p.table_bytes, x = int.from_bytes(data[x : x + 4]), x + 4
            if flags & 4 and x + 100 <= end:  # parts of 256 of the bytes
                p.table_seek = [b * p.table_bytes // 256 for b in data[x : x + 100]]
            return True
    x = at + 36
    if data[x : x + 4] == b"VBRI" and x + 18 <= end:
        p.table, p.table_bytes, p.table_frames = "VBRI", int.from_bytes(data[x + 10 : x + 14]), int.from_bytes(data[x + 14 : x + 18])
        if x + 26 <= end:
            entries, scale, width = (int.from_bytes(data[x + i : x + i + 2]) for i in (18, 20, 22))
            if 1 <= width <= 4 and x + 26 + entries * width <= end:
                steps = [int.from_bytes(data[i : i + width]) * scale for i in range(x + 26, x + 26 + entries * width, width)]
                p.table_seek = list(accumulate(steps))
        return True
    return False


def probe(data: bytes | None) -> Probe:
    """What the audio holds. Null, empty or frameless bytes give no frames and count as skipped.

    An ID3v1 tag is the last 128 bytes, where no frame covers them.
    """
    p = Probe()
    data = data or b""
    at, end = _id3v2(data, p.tags), len(data)
    tag = end - 128 if data[-128:-125] == b"TAG" else end
    kind: tuple | None = None
    synced = False
    while at + 4 <= end:
        if at == tag:
            p.tags |= _id3v1(data[at:])
            end = at
            break
        h = parse_header(data[at : at + 4])
        ok = h is not None and at + h.length <= end and (kind is None or kind == (h.version, h.layer, h.rate))
        if ok and not synced:  # after a loss (and at first) the next header must follow, or the end
            after = at + h.length
            nxt = parse_header(data[after : after + 4]) if after + 4 <= end else None
            ok = after in (tag, end) or nxt is not None and (nxt.version, nxt.layer, nxt.rate) == (h.version, h.layer, h.rate)
        if not ok:
            synced = False
            nxt_at = data.find(b"\xff", at + 1, end)
            nxt_at = nxt_at if nxt_at >= 0 else end
            nxt_at = tag if at < tag < nxt_at else nxt_at
            p.skipped += nxt_at - at
            at = nxt_at
            continue
        synced = True
        if h.protected:
            p.checksums += 1
            p.checksums_bad += not checksum_ok(data, at, h)
        if kind is None:
            kind = (h.version, h.layer, h.rate)
            p.version, p.layer, p.rate, p.mono = {3: 1, 2: 2, 0: 25}[h.version], h.layer, h.rate, h.mono
            if _table(data, at, h, p):
                at += h.length
                continue
        p.offsets.append(at)
        p.frames += 1
        p.samples += h.samples
        p.kbps_min = min(p.kbps_min or h.kbps, h.kbps)
        p.kbps_max = max(p.kbps_max, h.kbps)
        at += h.length
    p.skipped += max(0, end - at)
    return p


def payload(data: bytes, offsets: list[int]) -> bytes:
    """The bytes that ``encode`` put into the frames at ``offsets``."""
    n = len(_LEAD)
    return b"".join([data[x + n : x + n + BLOCK] for x in offsets])


def _encoded(texts: pd.Series) -> pd.Series:
    return pd.Series([encode((t or "").encode()) for t in texts], dtype=object)


def encode_column(text: Column) -> Column:
    """A binary column of audio for a text column; null counts as the empty text."""
    return F.pandas_udf(_encoded, "binary")(text)


PROBE_SCHEMA = "frames long, samples long, rate int, tags map<string,string>, offsets array<long>, skipped long, checksums long, checksums_bad long, table string, table_seek array<long>, feature string"
_PROBED = [c.split()[0] for c in PROBE_SCHEMA.split(", ")]


def probe_table(df: DataFrame, media: str, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all) with one probe of ``media`` a row: durations (samples, rate), seek offsets, tags, checks.

    Null, empty and frameless media have no frames. Rows are probed one by one, so repeated ones
    stay and give the same, and an empty table gives no rows. An audio of any length is read whole.
    A kept column with the name of a probed one is replaced by it; others keep name and values.
    """

    def run(col: pd.Series) -> pd.DataFrame:
        found = [probe(x) for x in col]
        return pd.DataFrame({name: [p.feature() if name == "feature" else getattr(p, name) for p in found] for name in _PROBED})

    return beside(df, F.pandas_udf(run, PROBE_SCHEMA)(named(media)), _PROBED, keep)


_DIGEST = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text becomes audio, and all figures are read from the audio's bytes; one is held at a time."""
    holds("media", crc16.cache_clear)
    for batch in batches:
        out: list[list] = [[] for _ in _DIGEST.names]
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
            data = encode((text.as_py() or "").encode())
            p = probe(data)
            back = payload(data, p.offsets)
            row = (doc_id, int(p.tags["payload_bytes"]), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(data), hashlib.sha256(data).hexdigest(), p.feature())
            for col, x in zip(out, row, strict=True):
                col.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, _DIGEST, strict=True)], schema=_DIGEST)


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts become audio, which is then read as any audio would be: all figures come from its bytes.

    A null text counts as the empty one, which is stored as 576 bytes 255. Texts of any length are
    stored whole. Equal texts give equal values, repeated rows stay, and an empty table gives no
    rows. Other columns of the table are not read.
    """
    docs = documents(spark, sf_dir).select(F.col("doc_id").cast("long"), "text")
    return docs.mapInArrow(_digests, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
