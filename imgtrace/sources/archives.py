"""Saved arrays (.npy, .npz) as tables: rows of plain arrays, and lists of records whose fields differ in length.

Both need a folder that the driver and all executors see under one path. The driver reads the archives' directories and
the arrays' headers only; a partition is a range of rows or records, of which a task reads just that part of each member
that is stored as it is (packed members are read up to the part).

A list keeps a field of unequal lengths as one flat member and a member of counts; a field that some records lack has counts
of its own, 0 for none. Members with a row for each record are fields too, and those of one row hold for all records.
"""

from __future__ import annotations

import os
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from numpy.lib import format as npy
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

COUNTS = "_counts"


@dataclass(frozen=True)
class Header:
    shape: tuple[int, ...]
    dtype: np.dtype
    begin: int

    @property
    def row(self) -> int:
        return int(np.prod(self.shape[1:], dtype=np.int64)) * self.dtype.itemsize


def header_of(file: BinaryIO) -> Header:
    version = npy.read_magic(file)
    shape, by_column, dtype = {(1, 0): npy.read_array_header_1_0, (2, 0): npy.read_array_header_2_0}[version](file)
    if dtype.hasobject or (by_column and len(shape) > 1):
        raise ValueError("only arrays of numbers that lie row by row can be read")
    return Header(shape, dtype, file.tell())


def rows_of(file: BinaryIO, header: Header, start: int, end: int) -> np.ndarray:
    """Rows start to end (exclusive) of an array, as (rows, values); a single number is one row."""
    file.seek(header.begin + start * header.row)
    data = np.frombuffer(file.read((end - start) * header.row), header.dtype)
    return data.reshape(end - start, -1) if end > start else np.zeros((0, 1), header.dtype)


@contextmanager
def member(path: str, name: str) -> Iterator[tuple[BinaryIO, Header]]:
    if path.endswith(".npy"):
        with open(path, "rb") as file:
            yield file, header_of(file)
    else:
        with zipfile.ZipFile(path) as archive, archive.open(f"{name}.npy") as file:
            yield file, header_of(file)


def members(path: str) -> dict[str, Header]:
    if path.endswith(".npy"):
        with member(path, "") as (_, header):
            return {os.path.splitext(os.path.basename(path))[0]: header}
    with zipfile.ZipFile(path) as archive:
        out = {}
        for name in archive.namelist():
            if name.endswith(".npy"):
                with archive.open(name) as file:
                    out[name[: -len(".npy")]] = header_of(file)
        return out


def _files(folder: str, suffixes: tuple[str, ...]) -> list[str]:
    if os.path.isfile(folder):
        return [folder]
    return [os.path.join(folder, n) for n in sorted(os.listdir(folder)) if n.endswith(suffixes) and not n.startswith((".", "_"))]


def _double_lists(rows: list[np.ndarray | None]) -> pa.Array:
    lengths = [0 if r is None else len(r) for r in rows]
    flat = np.concatenate([np.asarray(r, np.float64) for r in rows if r is not None] or [np.zeros(0)])
    offsets = pa.array(np.cumsum([0, *lengths]).astype(np.int32), mask=np.array([*(r is None for r in rows), False]))
    return pa.ListArray.from_arrays(offsets, pa.array(flat))


# ---- rows of arrays


@dataclass
class _Rows(InputPartition):
    path: str
    name: str
    start: int
    end: int


class _RowReader(DataSourceReader):
    def __init__(self, folder: str, batch: int, wanted: set[str]) -> None:
        self.folder, self.batch, self.wanted = folder, batch, wanted

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for path in _files(self.folder, (".npy", ".npz")):
            for name, header in members(path).items():
                if not self.wanted or name in self.wanted:
                    n = header.shape[0] if header.shape else 1
                    out += [_Rows(path, name, k, min(n, k + self.batch)) for k in range(0, n, self.batch)]
        return out

    def read(self, partition: _Rows | None) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        with member(partition.path, partition.name) as (file, header):
            for k in range(partition.start, partition.end, 64):
                rows = rows_of(file, header, k, min(partition.end, k + 64))
                n = len(rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([os.path.basename(partition.path)] * n), pa.array([partition.name] * n), pa.array(np.arange(k, k + n)), pa.array([list(header.shape)] * n, pa.list_(pa.int64())), _double_lists(list(rows))],
                    names=["file", "member", "row", "shape", "numbers"],
                )


class ArrayRows(DataSource):
    """spark.read.format("array_rows").load(folder or file): a row for each first index of each array. Options: batch (rows a partition, 4096), members (by commas)."""

    @classmethod
    def name(cls) -> str:
        return "array_rows"

    def schema(self) -> str:
        return "file string, member string, row long, shape array<long>, numbers array<double>"

    def reader(self, schema) -> DataSourceReader:
        return _RowReader(self.options["path"], int(self.options.get("batch", 4096)), {x.strip() for x in self.options.get("members", "").split(",") if x.strip()})


# ---- lists of records


def _grouped(option: str) -> dict[str, str]:
    """The counts of each field that shares them: "pixel_counts:y_pixels,x_pixels;..."."""
    out = {}
    for group in option.split(";"):
        counts, _, fields = group.partition(":")
        out |= {f.strip(): counts.strip() for f in fields.split(",") if f.strip()}
    return out


class _ListReader(DataSourceReader):
    def __init__(self, folder: str, batch: int, grouped: dict[str, str]) -> None:
        self.folder, self.batch, self.grouped = folder, batch, grouped

    def _counted(self, found: dict[str, Header]) -> dict[str, str]:
        """Members of unequal lengths and their counts, as far as both are there."""
        own = {n[: -len(COUNTS)]: n for n in found if n.endswith(COUNTS) and n[: -len(COUNTS)] in found}
        return {f: c for f, c in {**self.grouped, **own}.items() if f in found and c in found}

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for path in _files(self.folder, (".npz",)):
            found = members(path)
            counted = self._counted(found)
            plain = {n: h for n, h in found.items() if n not in counted and n not in counted.values()}
            lengths = {found[c].shape[0] for c in counted.values()} or {max((h.shape[0] for h in plain.values() if h.shape), default=0)}
            if len(lengths) > 1:
                raise ValueError(f"{os.path.basename(path)}: counts of different numbers of records")
            (n,) = lengths
            out += [_Rows(path, "", k, min(n, k + self.batch)) for k in range(0, n, self.batch)]
        return out

    def read(self, partition: _Rows | None) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        found, start, end = members(partition.path), partition.start, partition.end
        counted = self._counted(found)
        fields: dict[str, list[np.ndarray | None]] = {}
        cuts: dict[str, np.ndarray] = {}
        for counts in set(counted.values()):
            with member(partition.path, counts) as (file, header):
                cuts[counts] = rows_of(file, header, 0, end)[:, 0].astype(np.int64)
        for name, header in found.items():
            if name in counted.values():
                continue
            with member(partition.path, name) as (file, header):
                if name in counted:
                    sizes = cuts[counted[name]]
                    before = int(sizes[:start].sum())
                    flat = rows_of(file, header, before, before + int(sizes[start:].sum())).ravel()
                    parts = np.split(flat, np.cumsum(sizes[start:])[:-1])
                    optional = counted[name] == name + COUNTS
                    fields[name] = [None if optional and not len(p) else p for p in parts]
                elif not header.shape or header.shape[0] == 1 != end:
                    fields[name] = [rows_of(file, header, 0, 1)[0]] * (end - start)
                elif header.shape[0] >= end:
                    fields[name] = list(rows_of(file, header, start, end))
        names = sorted(fields)
        each = [fields[f][i] for i in range(end - start) for f in names]
        offsets = pa.array(np.arange(end - start + 1, dtype=np.int32) * len(names))
        maps = pa.MapArray.from_arrays(offsets, pa.array(names * (end - start)), _double_lists(each))
        yield pa.RecordBatch.from_arrays([pa.array([os.path.basename(partition.path)] * (end - start)), pa.array(np.arange(start, end)), maps], names=["file", "item", "fields"])


@dataclass
class _Written(WriterCommitMessage):
    hidden: str | None
    name: str


class _ListWriter(DataSourceArrowWriter):
    def __init__(self, folder: str, grouped: dict[str, str], optional: set[str]) -> None:
        self.folder, self.grouped, self.optional = folder, grouped, optional

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        records, first = [], None
        for batch in iterator:
            items = batch.column(batch.schema.get_field_index("item")).to_pylist()
            records += [dict(m) for m in batch.column(batch.schema.get_field_index("fields")).to_pylist()]
            first = items[0] if first is None and items else first
        if first is None:
            return _Written(None, "")
        arrays: dict[str, np.ndarray] = {}
        for name in sorted({f for r in records for f in r}):
            values = [np.asarray(r.get(name) or [], np.float64) for r in records]
            if name in self.grouped or name in self.optional:
                if name in self.grouped or any(len(v) for v in values):
                    counts = self.grouped.get(name, name + COUNTS)
                    arrays[counts] = np.array([len(v) for v in values], np.uint32)
                    arrays[name] = np.concatenate(values)
            else:
                arrays[name] = np.stack(values)
        os.makedirs(self.folder, exist_ok=True)
        hidden = os.path.join(self.folder, f".{uuid.uuid4().hex}.writing")
        with open(hidden, "wb") as file:
            np.savez(file, **arrays)
        return _Written(hidden, os.path.join(self.folder, f"records-{first:012d}.npz"))

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        for m in messages:
            if m and m.hidden:
                os.replace(m.hidden, m.name)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        for m in messages:
            if m and m.hidden and os.path.exists(m.hidden):
                os.remove(m.hidden)


class RecordLists(DataSource):
    """spark.read.format("record_lists").load(folder or file), df.write.format("record_lists").save(folder).

    Rows are (file, item, fields): each field of a record as a list of numbers, null where the record lacks it; fields whose
    members a file does not have are not in the map. Options: grouped (counts that several fields share, as in
    "pixel_counts:y_pixels,x_pixels"), optional (fields with counts of their own, when writing), batch (records a
    partition, 4096). Writing gives a file for each partition, named by its first item.
    """

    @classmethod
    def name(cls) -> str:
        return "record_lists"

    def schema(self) -> str:
        return "file string, item long, fields map<string, array<double>>"

    def reader(self, schema) -> DataSourceReader:
        return _ListReader(self.options["path"], int(self.options.get("batch", 4096)), _grouped(self.options.get("grouped", "")))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        optional = {x.strip() for x in self.options.get("optional", "").split(",") if x.strip()}
        return _ListWriter(self.options["path"], _grouped(self.options.get("grouped", "")), optional)


def region_pixels(records: DataFrame) -> DataFrame:
    """file, roi, y, x, pixel (where the image's width is known) and weight of saved regions' masks."""
    field = lambda name: F.col("fields")[name]
    zipped = F.arrays_zip(field("y_pixels").alias("y"), field("x_pixels").alias("x"), field("pixel_weights").alias("weight"))
    rows = records.select("file", F.col("item").alias("roi"), field("frame_width")[0].alias("width"), F.explode(zipped).alias("p"))
    whole = lambda c: c.cast("long")
    return rows.select("file", "roi", whole(F.col("p.y")).alias("y"), whole(F.col("p.x")).alias("x"), whole(F.col("p.y") * F.col("width") + F.col("p.x")).alias("pixel"), F.col("p.weight").alias("weight"))
