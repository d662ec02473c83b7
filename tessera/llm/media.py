"""Ogg containers: writing, verified reading and features.

``mux`` lays packets of several logical streams into checksummed pages;
``demux`` verifies each page's checksum and sequence number, reassembles
packets from the lacing values (across pages), splits the logical streams and
derives each packet's timestamp from the granule positions.

Defined results: null or empty content is a payload of 64 zero bytes; equal
content gives equal containers; damaged or truncated containers raise
``OggError`` in ``demux`` and give a row with ``error`` set in ``probe``.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import encoded

UNIT = 64
#: Samples per data packet: more than one page holds of some, so that packets span pages.
PACKET = 24_000
RATE = 8_000
SAMPLES, INDEX = 0x53414D50, 0x494E4458
CONTINUED, FIRST, LAST = 1, 2, 4
_HEAD = struct.Struct("<4sBBqIIIB")
_REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


class OggError(ValueError):
    """A container that breaks the format, with the byte offset of the page."""


def page_checksum(page: bytes) -> int:
    """The container's CRC (polynomial 0x04C11DB7, most significant bit first, start 0).

    zlib's CRC has the same polynomial with bits reversed, so reversing the bits
    of the input bytes and of the result gives the one from the other.
    """
    reg = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(reg.to_bytes(4, "little").translate(_REVERSED), "big")


@dataclass
class Packet:
    data: bytes
    start: int | None = None  # in samples
    end: int | None = None


@dataclass
class Stream:
    serial: int
    packets: list[Packet] = field(default_factory=list)
    pages: int = 0
    ended: bool = False

    @property
    def payload(self) -> bytes:
        return b"".join(p.data for p in self.packets[1:])


def _page(flags: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    raw = _HEAD.pack(b"OggS", 0, flags, granule, serial, number, 0, len(lacing)) + lacing + body
    return raw[:22] + struct.pack("<I", page_checksum(raw)) + raw[26:]


def _pages(serial: int, packets: list[tuple[bytes, int]]) -> Iterator[bytes]:
    """Pages of one logical stream; packets are (data, granule at their end); the first has a page of its own."""
    number = 0
    groups = [g for g in (packets[:1], packets[1:]) if g]
    for group in groups:
        lacing, owner = bytearray(), []
        for i, (data, _) in enumerate(group):
            part = b"\xff" * (len(data) // 255) + bytes([len(data) % 255])
            lacing += part
            owner += [i] * len(part)
        body = b"".join(d for d, _ in group)
        at = 0
        for k in range(0, len(lacing), 255):
            cut = bytes(lacing[k : k + 255])
            done = [owner[k + j] for j, v in enumerate(cut) if v < 255]
            flags = (CONTINUED if k and lacing[k - 1] == 255 else 0) | (0 if number else FIRST)
            if group is groups[-1] and k + 255 >= len(lacing):
                flags |= LAST
            n = sum(cut)
            yield _page(flags, group[done[-1]][1] if done else -1, serial, number, cut, body[at : at + n])
            at += n
            number += 1


def mux(payload: bytes, n_bytes: int) -> bytes:
    """A container with the payload as 8-bit samples in one stream and its unpadded size in a second one, interleaved."""
    data = [(b"raw8" + struct.pack("<IB", RATE, 1), 0)]
    for i in range(0, len(payload), PACKET):
        x = payload[i : i + PACKET]
        data.append((x, i + len(x)))
    index = [(b"size" + struct.pack("<Q", n_bytes), 0), (struct.pack("<QI", len(payload), len(data) - 1), len(payload))]
    a, b = list(_pages(SAMPLES, data)), list(_pages(INDEX, index))
    return b"".join([a[0], b[0], *a[1:], *b[1:]])


def demux(raw: bytes) -> dict[int, Stream]:
    """Logical streams by serial number; raises OggError where the bytes are not a whole, sound container."""
    streams: dict[int, Stream] = {}
    partial: dict[int, bytearray] = {}
    at = 0
    while at < len(raw):
        if len(raw) - at < 27:
            raise OggError(f"truncated page header at {at}")
        magic, version, flags, granule, serial, number, crc, n = _HEAD.unpack_from(raw, at)
        if magic != b"OggS" or version:
            raise OggError(f"no page at {at}")
        lacing = raw[at + 27 : at + 27 + n]
        size = 27 + n + sum(lacing)
        if len(lacing) < n or at + size > len(raw):
            raise OggError(f"truncated page at {at}")
        if page_checksum(raw[at : at + 22] + b"\0\0\0\0" + raw[at + 26 : at + size]) != crc:
            raise OggError(f"checksum of the page at {at}")
        if (serial in streams) == bool(flags & FIRST):
            raise OggError(f"stream {serial:#x} begins wrongly at {at}")
        s = streams.setdefault(serial, Stream(serial))
        if s.ended or number != s.pages or bool(flags & CONTINUED) != (serial in partial):
            raise OggError(f"page order in stream {serial:#x} at {at}")
        s.pages += 1
        held, pos, done = partial.pop(serial, None), at + 27 + n, []
        held = bytearray() if held is None else held
        open_ = bool(flags & CONTINUED)
        for v in lacing:
            held += raw[pos : pos + v]
            pos += v
            open_ = v == 255
            if not open_:
                done.append(Packet(bytes(held)))
                held = bytearray()
        if open_:
            partial[serial] = held
        if done and s.packets:
            # the granule is where the page's last complete packet ends; earlier ones lie before it
            end = granule
            for p in reversed(done):
                p.end, p.start = end, end - len(p.data)
                end = p.start
        s.packets += done
        s.ended = bool(flags & LAST)
        at += size
    if partial or not streams or not all(s.ended for s in streams.values()):
        raise OggError("the container ends within a stream")
    return streams


def payload_of(text: bytes) -> bytes:
    """The text with zero bytes up to a positive multiple of the unit."""
    return text + bytes(max(UNIT, -(-len(text) // UNIT) * UNIT) - len(text))


def features(streams: dict[int, Stream]) -> str:
    s = streams[SAMPLES]
    x = np.frombuffer(s.payload, np.uint8).astype(np.int64) - 128
    turns = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    rate = struct.unpack_from("<I", s.packets[0].data, 4)[0]
    last = s.packets[-1]
    return (
        f"streams={len(streams)};pages={sum(t.pages for t in streams.values())};packets={len(s.packets) - 1};samples={len(x)};"
        f"rate={rate};duration_us={last.end * 1_000_000 // rate};last_start_us={last.start * 1_000_000 // rate};"
        f"sum={int(x.sum())};energy={int((x * x).sum())};peak={int(np.abs(x).max())};crossings={turns}"
    )


STORED = (
    "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
    "media_sha256 string, feature string"
)


def _stored(text: bytes) -> tuple:
    media = mux(payload_of(text), len(text))
    streams = demux(media)
    back = streams[SAMPLES].payload
    size = struct.unpack_from("<Q", streams[INDEX].packets[0].data, 4)[0]
    return (size, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), features(streams), media)


def store(df: DataFrame, key: str, text: str, with_media: bool = False) -> DataFrame:
    """Each text as an Ogg container, read back: key, the columns of STORED, and the container itself on demand.

    Null texts count as empty; duplicate keys and extra columns don't matter, as
    rows are independent (no shuffle).  An empty table gives an empty result.
    """
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = encoded(batch.column(1))
            for i in range(0, len(texts), 256):
                rows = list(zip(*map(_stored, texts[i : i + 256])))
                types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
                cols = [pa.array(c, t) for c, t in zip(rows, types)][: 8 if with_media else 7]
                names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "media"]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, len(rows[0])), *cols], [key, *names[: len(cols)]])

    return df.select(F.col(key), F.col(text)).mapInArrow(run, f"`{key}` {kind}, {STORED}" + (", media binary" if with_media else ""))


def probe(df: DataFrame, key: str, media: str) -> DataFrame:
    """Per packet of each container: key, serial, packet, start_us, end_us, data, error (then the others are null)."""
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = []
                try:
                    for s in demux(raw or b"").values():
                        for i, p in enumerate(s.packets):
                            us = [None if t is None else t * 1_000_000 // RATE for t in (p.start, p.end)]
                            rows.append((k, s.serial, i, *us, p.data, None))
                except OggError as e:
                    rows = [(k, None, None, None, None, None, str(e))]
                cols = list(zip(*rows))
                types = [batch.schema.field(0).type, pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], [key, "serial", "packet", "start_us", "end_us", "data", "error"])

    return df.select(F.col(key), F.col(media)).mapInArrow(run, f"`{key}` {kind}, serial long, packet int, start_us long, end_us long, data binary, error string")
