"""Media columns: Ogg containers written and read per row, in Arrow batches.

Writing: a payload becomes packets of ``PACKET`` 8-bit samples, dealt in turn to ``STREAMS`` logical streams. Each stream
begins with a header packet on its own page (magic, channel, sample rate, packet length); the pages of all streams are interleaved. Pages carry lacing values, granule positions
(index of the sample after the last packet that ends on the page), sequence numbers and checksums.

Reading: pages are found by their capture pattern, their checksums verified, packets reassembled from lacing values (also across pages), streams demultiplexed by serial number, and
time stamps derived from granule positions over the sample rate. Packets of all streams merge by their granule positions.

Checksums use the container's polynomial (0x04C11DB7, most significant bit first, no inversion). ``zlib.crc32`` is the
reflected form of the same polynomial, so bits are reversed around it and its inversions undone.

Defined cases: a null or empty payload still is one packet of filler; a damaged, truncated or foreign byte string gives a
null payload and ``ok`` false, never an error; repeated rows give equal bytes.
"""
from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

PACKET = 576
STREAMS = 2
RATE = 8000
PACKETS_PER_PAGE = 32
FILLER = 255
MAGIC = b"\x01pcm8col"
_HEAD = struct.Struct("<4sBBqIIIB")
_ID = struct.Struct("<8sBBIII")
_REVERSED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))
CONTINUED, FIRST, LAST = 1, 2, 4
MAX_ROWS = 256
MAX_BYTES = 64 << 20


def checksum(data: bytes) -> int:
    raw = zlib.crc32(data.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int(f"{raw:032b}"[::-1], 2)


def page(flags: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    head = bytearray(_HEAD.pack(b"OggS", 0, flags, granule, serial, number, 0, len(lacing)))
    head += lacing
    whole = bytes(head) + body
    return whole[:22] + struct.pack("<I", checksum(whole)) + whole[26:]


def lace(n: int) -> bytes:
    """A packet's segment table: 255s and a last value under 255 (0 where the length is a multiple)."""
    return b"\xff" * (n // 255) + bytes([n % 255])


def write(payload: bytes) -> bytes:
    """The container of a payload whose length is a multiple of ``PACKET``."""
    pages = []
    count = len(payload) // PACKET
    for s in range(STREAMS):
        ident = _ID.pack(MAGIC, 0, s, RATE, PACKET, len(range(s, count, STREAMS)))
        pages.append(page(FIRST, 0, s + 1, 0, lace(len(ident)), ident))
    number = [1] * STREAMS
    run = PACKETS_PER_PAGE * STREAMS
    for at in range(0, max(count, 1), run):
        for s in range(STREAMS):
            mine = range(at + s, min(at + run, count), STREAMS)
            last = LAST if at + run >= count else 0
            body = b"".join(payload[k * PACKET: (k + 1) * PACKET] for k in mine)
            granule = (mine[-1] + 1) * PACKET if len(mine) else (-1 if count > s else 0)
            if not len(mine) and not last:
                continue
            pages.append(page(last, granule, s + 1, number[s], lace(PACKET) * len(mine), body))
            number[s] += 1
    return b"".join(pages)


class Damaged(ValueError):
    """The bytes are no whole container of this kind."""


def pages_of(data: bytes) -> Iterator[tuple[int, int, int, int, bytes, int, int]]:
    """``flags, granule, serial, number, lacing, start, end`` of every page; raises on a false checksum."""
    at = 0
    while at < len(data):
        if len(data) - at < 27:
            raise Damaged("truncated page header")
        magic, version, flags, granule, serial, number, crc, n = _HEAD.unpack_from(data, at)
        if magic != b"OggS" or version:
            raise Damaged("no page here")
        lacing = data[at + 27: at + 27 + n]
        start = at + 27 + n
        end = start + sum(lacing)
        if len(lacing) < n or end > len(data):
            raise Damaged("truncated page")
        if checksum(data[at: at + 22] + b"\0\0\0\0" + data[at + 26: end]) != crc:
            raise Damaged("false checksum")
        yield flags, granule, serial, number, lacing, start, end
        at = end


def demultiplex(data: bytes) -> dict[int, list[tuple[bytes, int]]]:
    """Packets of each logical stream with the granule position of the page they end on (-1: not the last there)."""
    streams: dict[int, list[tuple[bytes, int]]] = {}
    open_packet: dict[int, bytearray] = {}
    expected: dict[int, int] = {}
    ended: set[int] = set()
    for flags, granule, serial, number, lacing, start, _ in pages_of(data):
        if flags & FIRST:
            if serial in streams:
                raise Damaged("a stream begins twice")
            streams[serial], expected[serial] = [], 0
        if serial not in streams or serial in ended or number != expected[serial]:
            raise Damaged("a page is missing or out of order")
        expected[serial] += 1
        if bool(flags & CONTINUED) != (serial in open_packet):
            raise Damaged("a continued packet lacks its other part")
        part = open_packet.pop(serial, bytearray())
        ends = [i for i, v in enumerate(lacing) if v < 255]
        at, done = start, -1
        for e in ends:
            n = sum(lacing[done + 1: e + 1])
            packet = bytes(part) + data[at: at + n] if part else data[at: at + n]
            part = bytearray()
            streams[serial].append((packet, granule if e == ends[-1] else -1))
            at, done = at + n, e
        if done + 1 < len(lacing):
            open_packet[serial] = part + data[at: at + sum(lacing[done + 1:])]
        if flags & LAST:
            ended.add(serial)
    if open_packet or ended != set(streams):
        raise Damaged("a stream does not end")
    return streams


def read(data: bytes) -> tuple[bytes, list[tuple[int, int, float]]]:
    """The payload and ``(stream, packets, seconds)`` of each stream; raises ``Damaged``."""
    streams = demultiplex(data)
    timed, shape = [], []
    for serial, packets in sorted(streams.items()):
        if not packets or len(packets[0][0]) != _ID.size:
            raise Damaged("no stream header")
        magic, _, channel, rate, size, count = _ID.unpack(packets[0][0])
        if magic != MAGIC or count != len(packets) - 1 or not rate or not size:
            raise Damaged("another kind of stream")
        step = size * len(streams)
        end = 0
        # a page gives the position of its last packet; those before it lie one step apart
        for k in range(count, 0, -1):
            body, granule = packets[k]
            if granule >= 0:
                end = granule
            if len(body) != size:
                raise Damaged("a packet has another length")
            timed.append((end, channel, body))
            end -= step
        shape.append((channel, count, max((g for _, g in packets), default=0) / rate))
    timed.sort(key=lambda x: x[:2])
    if any(t != (i + 1) * len(b) for i, (t, _, b) in enumerate(timed)):
        raise Damaged("time stamps leave a gap")
    return b"".join(b for _, _, b in timed), shape


def pad(data: bytes, unit: int = PACKET) -> bytes:
    n = max(unit, -(-len(data) // unit) * unit)
    return data + bytes([FILLER]) * (n - len(data))


def _rows(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of at most ``MAX_ROWS`` rows and, but for single rows, ``MAX_BYTES`` in a column, so that the bytes made at once stay few."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    at = 0
    while at < batch.num_rows:
        end, total = at + 1, size[at]
        while end < batch.num_rows and end - at < MAX_ROWS and total + size[end] <= MAX_BYTES:
            total, end = total + size[end], end + 1
        yield batch.slice(at, end - at)
        at = end


def with_media(df: DataFrame, text: str, media: str = "media") -> DataFrame:
    """``df`` with the container of the UTF-8 bytes of ``text`` (null: empty) as a binary column; a column of that name is replaced."""
    df = df.drop(media) if media in df.columns and media != text else df
    schema = T.StructType([*df.schema.fields, T.StructField(media, T.BinaryType())])
    names = [f.name for f in schema]

    def encode(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in rows:
            for b in _rows(whole, whole.schema.get_field_index(text)):
                col = b.column(b.schema.get_field_index(text)).cast(pa.large_binary())
                made = [write(pad(x.as_py() or b"")) for x in col]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made, pa.binary())], names=names)

    return df.mapInArrow(encode, schema)


def features(payload: bytes, shape: list[tuple[int, int, float]]) -> str:
    """Streams with packets and duration, then mean, deviation, zero crossings and peak of the centred samples."""
    x = np.frombuffer(payload, dtype=np.uint8)
    mean = float(x.mean())
    centred = x > mean
    crossings = int(np.count_nonzero(centred[1:] != centred[:-1]))
    streams = ",".join(f"{c}:{n}:{s:.3f}" for c, n, s in shape)
    return f"streams={streams};mean={mean:.4f};sd={float(x.std()):.4f};crossings={crossings};peak={int(x.max())}"


def read_media(df: DataFrame, keep: list[str], media: str = "media", payload: bool = True) -> DataFrame:
    """``keep`` columns with ``ok, payload (on request), payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature``."""
    out = "ok boolean, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    schema = T.StructType(list(df.select(*keep).schema.fields))
    for part in (out + (", payload binary" if payload else "")).split(", "):
        schema = schema.add(*part.split(" "))
    names = [f.name for f in schema]
    types = [pa.bool_(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]

    def decode(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in rows:
            for b in _rows(whole, whole.num_columns - 1):
                found = []
                for x in b.column(b.num_columns - 1):
                    m = x.as_py()
                    try:
                        p, shape = read(m or b"")
                        if not p:
                            raise Damaged("no payload")
                        found.append((True, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), len(m), hashlib.sha256(m).hexdigest(), features(p, shape), p))
                    except Damaged:
                        found.append((False, None, None, None, None if m is None else len(m), None if m is None else hashlib.sha256(m).hexdigest(), None, None))
                columns = [pa.array(c, t) for c, t in zip(zip(*found), types)][: len(types) - (not payload)]
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], *columns], names=names)

    return df.select(*keep, F.col(media)).mapInArrow(decode, schema)
