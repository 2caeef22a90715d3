"""Media columns in Ogg: text stored as 8-bit samples, read back page by page.

A file holds two logical streams whose pages interleave: uncompressed samples under an OggPCM header (unsigned 8-bit,
one channel), and marks, one packet for each page of samples with its last position and the CRC-32 of its bytes.
Reading checks each page's checksum, joins the packets from the lacing values (over page ends too), sorts the pages by
serial number into streams, and derives each packet's end, in samples and seconds, from the granule positions.

Defined results: null text is empty text; a payload is padded with spaces to a positive multiple of 192 bytes; equal
texts give equal files; a page with a wrong checksum is left out and counted, and packets that it cuts are lost and
counted; null media gives no streams; every row gives one row, repeated rows too, each by itself, so there are no ties; a
very long text is one file, made in its task as a whole; an empty table gives no rows; columns other than doc_id and text
are not read, so no name can clash.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from imgtrace.llm.common import pieces_of, text_or_empty

RATE = 8000
UNIT = 192
PACKET_SAMPLES = 1920
CONTINUED, FIRST, LAST = 1, 2, 4
_PAGE = struct.Struct("<4sBBqIIIB")
_PCM_HEADER = struct.Struct(">8sHHIIBBHI")
_MARK = struct.Struct("<QI")
PCM_MAGIC, MARK_MAGIC = b"PCM     ", b"MARKS   "

_REVERSED_BYTES = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def page_checksum(page: bytes) -> int:
    """CRC of a page whose checksum field is 0: polynomial 0x04C11DB7, most significant bit first, from 0.

    zlib has the same polynomial with bits in the other order, so bytes and result are reversed around it.
    """
    crc = zlib.crc32(page.translate(_REVERSED_BYTES), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(crc.to_bytes(4, "little").translate(_REVERSED_BYTES), "big")


class StreamWriter:
    """Lays the packets of one logical stream out over pages."""

    def __init__(self, serial: int) -> None:
        self.serial, self.number = serial, 0
        self.lacing, self.body = bytearray(), bytearray()
        self.granule, self.continued = -1, False

    def flush(self, flags: int = 0) -> bytes:
        flags |= (CONTINUED if self.continued else 0) | (0 if self.number else FIRST)
        head = _PAGE.pack(b"OggS", 0, flags, self.granule, self.serial, self.number, 0, len(self.lacing)) + self.lacing
        page = bytearray(head + self.body)
        page[22:26] = page_checksum(bytes(page)).to_bytes(4, "little")
        self.continued = bool(self.lacing) and self.lacing[-1] == 255
        self.number += 1
        self.lacing, self.body, self.granule = bytearray(), bytearray(), -1
        return bytes(page)

    def add(self, packet: bytes, granule: int) -> Iterator[bytes]:
        """Takes a packet that ends at the granule position; gives the pages that this fills."""
        lacing = b"\xff" * (len(packet) // 255) + bytes([len(packet) % 255])
        done = 0
        while lacing:
            if len(self.lacing) == 255:
                yield self.flush()
            room = lacing[: 255 - len(self.lacing)]
            n = sum(room)
            self.lacing += room
            self.body += packet[done : done + n]
            done += n
            lacing = lacing[len(room) :]
        self.granule = granule


def write(payload: bytes) -> bytes:
    """An Ogg file with the payload as samples."""
    serial = zlib.crc32(payload)
    sound, marks = StreamWriter(serial), StreamWriter(serial ^ 1)
    pages = [*sound.add(_PCM_HEADER.pack(PCM_MAGIC, 0, 0, 1, RATE, 8, 1, PACKET_SAMPLES, 0), 0), sound.flush()]
    pages += [*marks.add(MARK_MAGIC, 0), marks.flush()]
    per_page = 255 // (PACKET_SAMPLES // 255 + 1) * PACKET_SAMPLES
    for start in range(0, len(payload), per_page):
        end = min(len(payload), start + per_page)
        for at in range(start, end, PACKET_SAMPLES):
            stop = min(end, at + PACKET_SAMPLES)
            pages += sound.add(payload[at:stop], stop)
        pages.append(sound.flush(LAST if end == len(payload) else 0))
        pages += [*marks.add(_MARK.pack(end, zlib.crc32(payload[start:end])), end), marks.flush(LAST if end == len(payload) else 0)]
    return b"".join(pages)


@dataclass
class Stream:
    """What one logical stream holds; ends has the granule position at which each packet ends, or -1."""

    serial: int
    packets: list[bytes] = field(default_factory=list)
    ends: list[int] = field(default_factory=list)
    lost: int = 0
    closed: bool = False


@dataclass
class _Open:
    stream: Stream
    expected: int = 0
    part: bytes | None = None


def read(media: bytes) -> tuple[dict[int, Stream], int]:
    """The streams by serial number, and the count of pages with a wrong checksum or shape."""
    streams: dict[int, _Open] = {}
    bad, at = 0, media.find(b"OggS")
    while at >= 0:
        if len(media) - at < _PAGE.size:
            bad += 1
            break
        _, version, flags, granule, serial, number, checksum, n = _PAGE.unpack_from(media, at)
        lacing = media[at + _PAGE.size : at + _PAGE.size + n]
        body = at + _PAGE.size + n
        end = body + sum(lacing)
        page = media[at:end]
        if version or len(lacing) < n or end > len(media) or page_checksum(page[:22] + b"\0\0\0\0" + page[26:]) != checksum:
            bad += 1
            at = media.find(b"OggS", at + 4)
            continue
        own = streams.setdefault(serial, _Open(Stream(serial)))
        _take_page(own, media, body, lacing, flags, granule, number)
        at = end if media[end : end + 4] == b"OggS" else media.find(b"OggS", end)
    for own in streams.values():
        own.stream.lost += own.part is not None
    return {k: own.stream for k, own in streams.items()}, bad


def _take_page(own: _Open, media: bytes, at: int, lacing: bytes, flags: int, granule: int, number: int) -> None:
    stream, part = own.stream, own.part
    if part is not None and (number != own.expected or not flags & CONTINUED):
        stream.lost += 1
        part = None
    skip = bool(flags & CONTINUED) and part is None
    own.expected = number + 1
    begun = len(stream.packets)
    size = start = 0
    for value in lacing:
        size += value
        if value < 255:
            if skip:
                skip = False
            else:
                stream.packets.append((part or b"") + media[at + start : at + start + size])
                stream.ends.append(-1)
            part, start, size = None, start + size, 0
    if lacing and lacing[-1] == 255 and not skip:
        part = (part or b"") + media[at + start : at + start + size]
    own.part = part
    stream.closed |= bool(flags & LAST)
    if len(stream.packets) > begun and granule >= 0:
        stream.ends[-1] = granule
        if begun:  # samples take a byte each; the header takes none
            for k in range(len(stream.packets) - 2, begun - 1, -1):
                stream.ends[k] = stream.ends[k + 1] - len(stream.packets[k + 1])


def samples_of(streams: dict[int, Stream]) -> tuple[list[bytes], list[int], int]:
    """Packets of samples, their ends, and the rate, from the first stream with an OggPCM header."""
    for stream in streams.values():
        if stream.packets and stream.packets[0].startswith(PCM_MAGIC) and len(stream.packets[0]) == _PCM_HEADER.size:
            return stream.packets[1:], stream.ends[1:], _PCM_HEADER.unpack(stream.packets[0])[4]
    return [], [], RATE


def marks_agree(streams: dict[int, Stream], payload: bytes) -> bool:
    """Whether the stream of marks has the right positions and check values for the payload."""
    at = 0
    for stream in streams.values():
        if stream.packets[:1] == [MARK_MAGIC]:
            for packet in stream.packets[1:]:
                end, check = _MARK.unpack(packet)
                if zlib.crc32(payload[at:end]) != check:
                    return False
                at = end
    return at == len(payload)


def feature(payload: bytes, packets: int, end: int, rate: int) -> str:
    """Whole-number features of the samples."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    n = max(1, len(x))
    crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    step = int(np.abs(np.diff(x)).sum())
    return (
        f"packets={packets};milliseconds={end * 1000 // rate};mean={int(x.sum()) * 1000 // n};power={int((x * x).sum()) // n};"
        f"crossings={crossings};step={step * 1000 // n};peak={int(np.abs(x).max(initial=0))}"
    )


def pad(text: bytes) -> bytes:
    return text + b" " * (-len(text) % UNIT if text else UNIT)


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes (of the text) and media (the Ogg file) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces_of(batch):
                texts = [x.encode() for x in part.column(1).to_pylist()]
                media = pa.array([write(pad(x)) for x in texts], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(len, texts), pa.int64()), media], ["doc_id", "n_bytes", "media"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return source.mapInArrow(run, "doc_id long, n_bytes long, media binary")


def packets(stored: DataFrame) -> DataFrame:
    """A row for each packet of each stream: doc_id, serial, packet, size, ends_at (granule), seconds, data."""
    schema = "doc_id long, serial long, packet long, size long, ends_at long, seconds double, data binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in schema.split(", ")]
        for batch in batches:
            for part in pieces_of(batch, "media"):
                rows = []
                for doc_id, media in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    streams, _ = read(media or b"")
                    rate = samples_of(streams)[2]
                    for s in streams.values():
                        rows += [(doc_id, s.serial, k, len(x), end, end / rate if end >= 0 else None, x) for k, (x, end) in enumerate(zip(s.packets, s.ends, strict=True))]
                types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)

    return stored.select("doc_id", "media").mapInArrow(run, schema)


def read_back(stored: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media, payload, n_streams, bad_pages, lost_packets, marks_agree and feature of rows of doc_id, n_bytes and media."""
    schema = "doc_id long, n_bytes long, media binary, payload binary, n_streams int, bad_pages int, lost_packets int, marks_agree boolean, feature string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in schema.split(", ")]
        for batch in batches:
            for part in pieces_of(batch, "media"):
                out: list[list] = [[] for _ in range(6)]
                for media in part.column(2).to_pylist():
                    streams, bad = read(media or b"")
                    found, ends, rate = samples_of(streams)
                    payload = b"".join(found)
                    end = ends[-1] if ends else 0
                    row = (payload, len(streams), bad, sum(s.lost for s in streams.values()), marks_agree(streams, payload), feature(payload, len(found), end, rate))
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
                types = (pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(x, t) for x, t in zip(out, types, strict=True))], names)

    return stored.select("doc_id", "n_bytes", "media").mapInArrow(run, schema)
