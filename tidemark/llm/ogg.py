"""Ogg media columns: pages with checksums, lacing, several logical streams and granule positions.

``write_ogg`` stores bytes as 8-bit samples in packets of 576, dealt in turn to two logical streams whose pages
interleave.  ``read_pages`` checks every page's checksum, ``read_packets`` puts packets together from lacing values,
also over page borders, and ``read_samples`` sorts the streams' packets by the times that the granule positions give.
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

from ._common import schema_of

PACKET = 576
RATE = 8000
_PAGE = "<4sBBqIIIB"
_PAGE_SIZE = struct.calcsize(_PAGE)
_HEAD = "<7sBHII"
_MAGIC = b"\x01raw8bt"
CONTINUED, FIRST, LAST = 1, 2, 4
_REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


class OggError(ValueError):
    """The bytes are no sound Ogg file."""


def checksum(data: bytes) -> int:
    """Ogg's CRC-32: polynomial 0x04C11DB7, most significant bit first, start 0.  It is zlib's CRC over bit-reversed
    bytes, with zlib's inversions undone, read backwards."""
    raw = zlib.crc32(data.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(raw.to_bytes(4, "little").translate(_REVERSED), "big")


@dataclass
class Page:
    serial: int
    sequence: int
    granule: int
    flags: int
    lacing: bytes
    body: bytes


@dataclass
class Packet:
    serial: int
    data: bytes
    #: The granule position of the page that the packet ends on; only the last packet ending on a page has it.
    granule: int | None = None
    first: bool = False


@dataclass
class Media:
    payload: bytes
    packets: int
    streams: int
    pages: int
    samples: int
    times: list[int] = field(default_factory=list)


def page(serial: int, sequence: int, granule: int, flags: int, lacing: bytes, body: bytes) -> bytes:
    head = struct.pack(_PAGE, b"OggS", 0, flags, granule, serial, sequence, 0, len(lacing)) + lacing
    return b"".join((head[:22], struct.pack("<I", checksum(head + body)), head[26:], body))


def lace(size: int) -> bytes:
    return b"\xff" * (size // 255) + bytes((size % 255,))


def write_ogg(payload: bytes, packet: int = PACKET, streams: int = 2) -> bytes:
    """``payload``, its length a positive multiple of ``packet``, as an Ogg file of ``streams`` logical streams at
    most; packet k goes to stream k mod streams, and a page's granule position is the sample after its last packet."""
    n = len(payload) // packet
    if not n or n * packet != len(payload):
        raise ValueError("the payload must be a positive multiple of the packet length")
    streams = min(streams, n)
    out, rounds = [], max(1, 255 // len(lace(packet)))
    for s in range(streams):
        head = struct.pack(_HEAD, _MAGIC, streams, s, packet, RATE)
        out.append(page(s + 1, 0, 0, FIRST, lace(len(head)), head))
    sequence = [1] * streams
    for at in range(0, n, rounds * streams):
        for s in range(streams):
            own = range(at + s, min(n, at + rounds * streams), streams)
            if own:
                body = b"".join(payload[k * packet : (k + 1) * packet] for k in own)
                ends = own[-1] + streams >= n
                out.append(page(s + 1, sequence[s], (own[-1] + 1) * packet, LAST * ends, lace(packet) * len(own), body))
                sequence[s] += 1
    return b"".join(out)


def read_pages(data: bytes) -> Iterator[Page]:
    at = 0
    while at < len(data):
        if len(data) - at < _PAGE_SIZE:
            raise OggError("cut page header")
        magic, version, flags, granule, serial, sequence, said, n = struct.unpack_from(_PAGE, data, at)
        if magic != b"OggS" or version:
            raise OggError(f"no page at byte {at}")
        lacing = data[at + 27 : at + 27 + n]
        end = at + 27 + n + sum(lacing)
        if len(lacing) < n or end > len(data):
            raise OggError("cut page")
        if checksum(data[at : at + 22] + b"\0\0\0\0" + data[at + 26 : end]) != said:
            raise OggError(f"wrong checksum of the page at byte {at}")
        yield Page(serial, sequence, granule, flags, lacing, data[at + 27 + n : end])
        at = end


def read_packets(pages: Iterator[Page]) -> Iterator[Packet]:
    """Packets in the order in which they end, of all logical streams."""
    open_: dict[int, list[bytes]] = {}
    expected: dict[int, int] = {}
    ended: set[int] = set()
    for p in pages:
        if p.flags & FIRST and p.serial in expected or not p.flags & FIRST and p.serial not in expected:
            raise OggError(f"stream {p.serial} begins twice or not at all")
        if p.serial in ended or p.sequence != expected.get(p.serial, p.sequence):
            raise OggError(f"a page of stream {p.serial} is missing or comes after its end")
        expected[p.serial] = p.sequence + 1
        part = open_.pop(p.serial, None)
        if (part is not None) != bool(p.flags & CONTINUED):
            raise OggError(f"stream {p.serial}: a packet is cut")
        part, at, done = part or [], 0, []
        size, pending = 0, bool(p.flags & CONTINUED)
        for value in p.lacing:
            size, pending = size + value, True
            if value < 255:
                done.append(Packet(p.serial, b"".join((*part, p.body[at : at + size])), None, bool(p.flags & FIRST)))
                part, at, size, pending = [], at + size, 0, False
        if pending:
            open_[p.serial] = [*part, p.body[at : at + size]]
        if done:
            done[-1].granule = p.granule
        yield from done
        if p.flags & LAST:
            ended.add(p.serial)
    if open_ or ended != set(expected):
        raise OggError("a stream has no end")


def read_samples(data: bytes) -> Media:
    """The payload of ``write_ogg``'s bytes.  Each packet's time comes from the granule position of the page that it
    ends on, counted back over the packets after it."""
    pages = list(read_pages(data))
    heads: dict[int, tuple[int, int, int]] = {}
    waiting: dict[int, list[bytes]] = {}
    timed: list[tuple[int, bytes]] = []
    for p in read_packets(iter(pages)):
        if p.first and p.serial not in heads:
            magic, streams, _, packet, _ = struct.unpack(_HEAD, p.data)
            if magic != _MAGIC:
                raise OggError("unknown codec")
            heads[p.serial] = streams, packet, len(heads)
            continue
        waiting.setdefault(p.serial, []).append(p.data)
        if p.granule is not None:
            streams, packet, _ = heads[p.serial]
            group = waiting.pop(p.serial)
            timed += [(p.granule - packet - (len(group) - 1 - i) * streams * packet, x) for i, x in enumerate(group)]
    timed.sort(key=lambda x: x[0])
    times = [t for t, _ in timed]
    at = 0
    for t, x in timed:
        if t != at:
            raise OggError("granule positions leave a gap")
        at += len(x)
    return Media(b"".join(x for _, x in timed), len(timed), len(heads), len(pages), at, times)


def pad(text: bytes, unit: int = PACKET) -> bytes:
    return text + b"\xff" * (max(unit, -(-len(text) // unit) * unit) - len(text))


def features(media: Media) -> str:
    x = np.frombuffer(media.payload, np.uint8)
    total, squares = int(x.sum(dtype=np.uint64)), int(np.square(x, dtype=np.uint64).sum())
    return f"streams={media.streams};pages={media.pages};packets={media.packets};ms={media.samples * 1000 // RATE};mean={total / len(x):.4f};power={squares / len(x):.4f}"


def media_columns(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep_media: bool = False) -> DataFrame:
    """Each text stored as an Ogg file and read back: (id, n_bytes, payload_bytes, payload_sha256, tail_crc32,
    media_bytes, media_sha256, feature[, media]).

    A null text counts as empty and gives one packet of padding; null ids and repeated rows keep their rows; other
    columns are dropped.  Equal texts have equal values.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part, rows = batch.slice(at, 256), []
                for text in part.column(1).cast(pa.binary()).to_pylist():
                    text = text or b""
                    stored = write_ogg(pad(text))
                    media = read_samples(stored)
                    payload = media.payload
                    row = (len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), features(media))
                    rows.append((*row, stored) if keep_media else row)
                cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *cols], names)

    more = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string" + ", media binary" * keep_media
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()] + [pa.binary()] * keep_media
    schema = schema_of(docs, id_col, more=more)
    names = [f"c{i}" for i in range(len(schema))]
    return docs.select(id_col, text_col).mapInArrow(run, schema)
