"""TIFF stacks as a source and a sink: spark.read.format("tiff_pages").load(folder), df.write.format("tiff_stack").save(folder).

Both need a folder that the driver and all executors see under one path. The driver reads the chains of page directories
only, a few bytes a page; a partition is a range of pages of a file, read where they lie and passed on as Arrow batches.
Classic files and those with 64-bit offsets are read, in either byte order, grey, in strips, plain or deflated, with or
without horizontal differences. Values become 16 signed bits: unsigned 16-bit and signed 32-bit ones are halved downward.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from imgtrace.functions import temporal
from imgtrace.operators.catalog import row_slice

SCHEMA = "file string, page int, position long, height int, width int, pixels array<smallint>"
# Fixed values of the format: sizes of field types, and numbers of tags and compressions.
_KINDS = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 16: "Q", 17: "q", 18: "Q"}
WIDTH, HEIGHT, BITS, COMPRESSION, OFFSETS, SAMPLES, ROWS, COUNTS, PREDICTOR, TILES, SAMPLE = 256, 257, 258, 259, 273, 277, 278, 279, 317, 322, 339
PLAIN, DEFLATE, OLD_DEFLATE = 1, 8, 32946
_SUFFIXES = (".tif", ".tiff")


@dataclass(frozen=True)
class Form:
    """How a file writes numbers: its byte order, and whether offsets have 64 bits."""

    order: str
    big: bool

    @property
    def offset(self) -> str:
        return self.order + ("Q" if self.big else "I")

    @property
    def count(self) -> str:
        return self.order + ("Q" if self.big else "H")


def _take(file: BinaryIO, at: int, form: str) -> tuple:
    file.seek(at)
    data = file.read(struct.calcsize(form))
    if len(data) < struct.calcsize(form):
        raise ValueError("a file ends before its directory does")
    return struct.unpack(form, data)


def directories(file: BinaryIO) -> tuple[Form, list[int]]:
    """The file's form, and where the directory of each page begins."""
    file.seek(0)
    head = file.read(16)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    version = struct.unpack_from(order + "H", head, 2)[0] if order and len(head) >= 8 else 0
    if version not in (42, 43):
        raise ValueError("not a TIFF file")
    form = Form(order, version == 43)
    entry = 20 if form.big else 12
    (at,) = struct.unpack_from(form.offset, head, 8 if form.big else 4)
    found: list[int] = []
    while at:
        if found and at in (found[0], found[-1]):
            raise ValueError("a chain of directories that runs in a ring")
        found.append(at)
        (n,) = _take(file, at, form.count)
        (at,) = _take(file, at + struct.calcsize(form.count) + entry * n, form.offset)
    return form, found


def tags_of(file: BinaryIO, form: Form, at: int) -> dict[int, tuple]:
    (n,) = _take(file, at, form.count)
    first, entry, inline = at + struct.calcsize(form.count), (20 if form.big else 12), (8 if form.big else 4)
    file.seek(first)
    block = file.read(entry * n)
    out = {}
    for k in range(n):
        tag, kind, count = struct.unpack_from(form.order + ("HHQ" if form.big else "HHI"), block, entry * k)
        if kind in _KINDS:
            layout = f"{form.order}{count}{_KINDS[kind]}"
            if struct.calcsize(layout) <= inline:
                out[tag] = struct.unpack_from(layout, block, entry * k + entry - inline)
            else:
                out[tag] = _take(file, struct.unpack_from(form.offset, block, entry * k + entry - inline)[0], layout)
    return out


def shape_of(tags: dict[int, tuple]) -> tuple[int, int]:
    return tags[HEIGHT][0], tags[WIDTH][0]


def page_of(file: BinaryIO, form: Form, at: int) -> np.ndarray:
    """A page as 16 signed bits."""
    tags = tags_of(file, form, at)
    one = lambda tag, usual: tags.get(tag, (usual,))[0]
    packing, predictor = one(COMPRESSION, PLAIN), one(PREDICTOR, 1)
    if TILES in tags or one(SAMPLES, 1) != 1 or packing not in (PLAIN, DEFLATE, OLD_DEFLATE) or predictor not in (1, 2):
        raise ValueError("only grey pages in strips, plain or deflated, can be read")
    height, width = shape_of(tags)
    kind = {1: "u", 2: "i", 3: "f"}[one(SAMPLE, 1)] + str(one(BITS, 1) // 8)
    if kind not in ("u1", "i1", "u2", "i2", "u4", "i4", "f4"):
        raise ValueError(f"pixels of type {kind} can't be read")
    strips = []
    for offset, count in zip(tags[OFFSETS], tags[COUNTS], strict=True):
        file.seek(offset)
        data = file.read(count)
        strips.append(data if packing == PLAIN else zlib.decompress(data))
    values = np.frombuffer(b"".join(strips), form.order + kind)[: height * width].reshape(height, width)
    if predictor == 2:
        values = np.cumsum(values, axis=1, dtype=values.dtype.newbyteorder("="))
    if kind in ("u2", "i4"):
        return np.clip(values >> 1, -32768, 32767).astype(np.int16)
    return values.astype(np.int16)


def _natural(name: str) -> list:
    return [(0, int(x), "") if x.isdigit() else (1, 0, x.lower()) for x in re.findall(r"\d+|\D+", name)]


def stacks(folder: str, ignored: set[str]) -> list[str]:
    """The folder's TIFF files in natural order, without those whose stem is ignored."""
    names = [n for n in os.listdir(folder) if os.path.splitext(n)[1].lower() in _SUFFIXES and os.path.splitext(n)[0] not in ignored and not n.startswith((".", "_"))]
    return [os.path.join(folder, n) for n in sorted(names, key=lambda n: (_natural(n), n))]


@dataclass
class _Pages(InputPartition):
    path: str
    form: Form
    places: list[int]
    first: int
    position: int


class _Reader(DataSourceReader):
    def __init__(self, folder: str, batch: int, ignored: set[str]) -> None:
        self.folder, self.batch, self.ignored = folder, batch, ignored

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        before, shapes = 0, {}
        for path in stacks(self.folder, self.ignored):
            with open(path, "rb") as file:
                form, places = directories(file)
                if not places:
                    raise ValueError(f"{os.path.basename(path)} has no page")
                shapes[os.path.basename(path)] = shape_of(tags_of(file, form, places[0]))
            out += [_Pages(path, form, places[k : k + self.batch], k, before + k) for k in range(0, len(places), self.batch)]
            before += len(places)
        usual = next(iter(shapes.values()), None)
        others = [f"{name} {shape}" for name, shape in shapes.items() if shape != usual]
        if others:
            raise ValueError(f"all files must have pages of one shape, here {usual}, but for {', '.join(others[:5])}{f' and {len(others) - 5} more' if len(others) > 5 else ''}")
        return out

    def read(self, partition: _Pages | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # a folder without files
            return
        with open(partition.path, "rb") as file:
            for k in range(0, len(partition.places), 8):
                pages = [page_of(file, partition.form, at) for at in partition.places[k : k + 8]]
                n = len(pages)
                ends = np.cumsum([0, *(p.size for p in pages)]).astype(np.int32)
                pixels = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([p.ravel() for p in pages])))
                numbers = np.arange(k, k + n)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([os.path.basename(partition.path)] * n),
                        pa.array((partition.first + numbers).astype(np.int32)),
                        pa.array(partition.position + numbers),
                        pa.array(np.array([p.shape[0] for p in pages], np.int32)),
                        pa.array(np.array([p.shape[1] for p in pages], np.int32)),
                        pixels,
                    ],
                    names=["file", "page", "position", "height", "width", "pixels"],
                )


class TiffPages(DataSource):
    """A row for each page; position counts a folder's pages over its files. Options: batch (pages a partition, 256), ignored (stems, by commas)."""

    @classmethod
    def name(cls) -> str:
        return "tiff_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        ignored = {x.strip() for x in self.options.get("ignored", "").split(",") if x.strip()}
        return _Reader(self.options["path"], int(self.options.get("batch", 256)), ignored)


def converted(pages: DataFrame, planes: int, channels: int, first_row: Column | None = None, last_row: Column | None = None) -> DataFrame:
    """plane, channel, frame, height, width and pixels of a folder's pages (channels vary fastest), without an incomplete last cycle.

    Rows of the image from first_row to last_row, both included, can be cut out by plane and channel.
    """
    placed = temporal.demultiplexed(pages.select(F.col("position").alias("page"), "height", "width", "pixels"), "page", planes, channels)
    if first_row is None:
        return placed.select("plane", "channel", "frame", "height", "width", "pixels")
    cut = row_slice(F.col("pixels"), F.col("width"), first_row, last_row)
    return placed.select("plane", "channel", "frame", (last_row - first_row + 1).cast("int").alias("height"), "width", cut.alias("pixels"))


# ---- sink


def write_stack(file: BinaryIO, pages: Iterator[np.ndarray]) -> int:
    """Writes pages as 16 signed bits with 64-bit offsets, each page's directory after its pixels; returns their number."""
    file.write(struct.pack("<2sHHHQ", b"II", 43, 8, 0, 0))
    link, n = 8, 0
    for page in pages:
        data = np.ascontiguousarray(page, "<i2").tobytes()
        at = file.tell()
        file.write(data)
        place = file.tell()
        tags = ((WIDTH, 4, page.shape[1]), (HEIGHT, 4, page.shape[0]), (BITS, 3, 16), (COMPRESSION, 3, PLAIN), (262, 3, 1), (OFFSETS, 16, at), (SAMPLES, 3, 1), (ROWS, 4, page.shape[0]), (COUNTS, 16, len(data)), (SAMPLE, 3, 2))
        file.write(struct.pack("<Q", len(tags)) + b"".join(struct.pack("<HHQQ", tag, kind, 1, value) for tag, kind, value in tags))
        end = file.tell()
        file.write(struct.pack("<Q", 0))
        file.seek(link)
        file.write(struct.pack("<Q", place))
        file.seek(end + 8)
        link, n = end, n + 1
    return n


@dataclass
class _Written(WriterCommitMessage):
    written: str | None
    name: str


class _Writer(DataSourceArrowWriter):
    def __init__(self, folder: str) -> None:
        self.folder = folder

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        os.makedirs(self.folder, exist_ok=True)
        hidden = os.path.join(self.folder, f".{uuid.uuid4().hex}.writing")
        first: list[int] = []

        def pages() -> Iterator[np.ndarray]:
            for batch in iterator:
                column = {n: batch.column(batch.schema.get_field_index(n)) for n in ("frame", "height", "width", "pixels")}
                for k in range(batch.num_rows):
                    first.append(column["frame"][k].as_py()) if not first else None
                    yield np.asarray(column["pixels"][k].values.to_numpy(zero_copy_only=False)).reshape(column["height"][k].as_py(), column["width"][k].as_py())

        with open(hidden, "wb") as file:
            write_stack(file, pages())
        if not first:
            os.remove(hidden)
            return _Written(None, "")
        return _Written(hidden, os.path.join(self.folder, f"frames-{first[0]:012d}.tif"))

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        kept = [m for m in messages if m and m.written]
        if len({m.name for m in kept}) < len(kept):
            self.abort(messages)
            raise ValueError("two tasks began with the same frame")
        for m in kept:
            os.replace(m.written, m.name)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        for m in messages:
            if m and m.written and os.path.exists(m.written):
                os.remove(m.written)


class TiffStack(DataSource):
    """Writes (frame, height, width, pixels), a file for each partition, named by its first frame; files show once all are written.

    Frames lie in a file in the order of their rows: sort and range-partition a movie by frame before.
    """

    @classmethod
    def name(cls) -> str:
        return "tiff_stack"

    def schema(self) -> str:
        return "frame long, height int, width int, pixels array<smallint>"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"])
