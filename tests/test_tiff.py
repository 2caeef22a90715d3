"""TIFF stacks: files built by hand in every supported form, several files a recording, and what the sink writes."""

import os
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from imgtrace.sources import tiff


def build(pages, order="<", big=False, deflate=False, predictor=1, strips=1):
    """A TIFF file of pages of one type, with directories before or after their pixels."""
    offset, inline = order + ("Q" if big else "I"), 8 if big else 4
    out = bytearray((b"II" if order == "<" else b"MM") + (struct.pack(order + "HHHQ", 43, 8, 0, 0) if big else struct.pack(order + "HI", 42, 0)))
    link = 8 if big else 4
    for page in pages:
        kind, bits = {"u": 1, "i": 2, "f": 3}[page.dtype.kind], page.dtype.itemsize * 8
        rows = -(-page.shape[0] // strips)
        places, sizes = [], []
        for top in range(0, page.shape[0], rows):
            part = page[top : top + rows]
            if predictor == 2:
                part = np.diff(part, axis=1, prepend=np.zeros((len(part), 1), part.dtype))
            data = part.astype(part.dtype.newbyteorder(order)).tobytes()
            data = zlib.compress(data) if deflate else data
            places.append(len(out))
            sizes.append(len(data))
            out += data
        long = 16 if big else 4
        fields = [(256, 3, [page.shape[1]]), (257, 3, [page.shape[0]]), (258, 3, [bits]), (259, 3, [8 if deflate else 1]), (273, long, places), (277, 3, [1]), (278, 3, [rows]), (279, long, sizes), (317, 3, [predictor]), (339, 3, [kind]), (305, 2, [0])]
        entries = b""
        for tag, field, values in fields:
            form = f"{order}{len(values)}{ {2: 'c', 3: 'H', 4: 'I', 16: 'Q'}[field] }" if field != 2 else "1c"
            packed = struct.pack(form, *values) if field != 2 else b"\0"
            if len(packed) > inline:
                at = len(out)
                out += packed
                packed = struct.pack(offset, at)
            entries += struct.pack(order + ("HHQ" if big else "HHI"), tag, field, len(values)) + packed.ljust(inline, b"\0")
        struct.pack_into(offset, out, link, len(out))
        out += struct.pack(order + ("Q" if big else "H"), len(fields)) + entries
        link = len(out)
        out += struct.pack(offset, 0)
    return bytes(out)


def _load(spark, folder, **options):
    spark.dataSource.register(tiff.TiffPages)
    return spark.read.format("tiff_pages").options(**options).load(str(folder))


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("big", [False, True])
def test_every_form_and_type(tmp_path, order, big):
    rng = np.random.default_rng(1)
    for dtype, want in (("u2", lambda p: p // 2), ("i4", lambda p: np.clip(p // 2, -32768, 32767)), ("i2", lambda p: p), ("u1", lambda p: p), ("i1", lambda p: p), ("f4", lambda p: p.astype("i2"))):
        info = np.iinfo(dtype) if dtype != "f4" else np.iinfo("i2")
        pages = [rng.integers(info.min, info.max, (5, 4), endpoint=True).astype(dtype) for _ in range(3)]
        for deflate, predictor, strips in ((False, 1, 1), (True, 1, 2), (True, 2, 3)):
            if dtype == "f4" and predictor == 2:
                continue
            path = tmp_path / "a.tif"
            path.write_bytes(build(pages, order, big, deflate, predictor, strips))
            with open(path, "rb") as file:
                form, places = tiff.directories(file)
                assert (form.order, form.big, len(places)) == (order, big, 3)
                for page, at in zip(pages, places, strict=True):
                    assert tiff.page_of(file, form, at).tolist() == want(page.astype("i8" if dtype != "f4" else "f4")).astype("i2").tolist()


def test_files_of_a_recording_in_natural_order(spark, tmp_path):
    value = lambda k: np.full((2, 3), 2 * k, "u2")
    (tmp_path / "run_10.tif").write_bytes(build([value(k) for k in (5, 6)]))
    (tmp_path / "run_2.TIFF").write_bytes(build([value(k) for k in (0, 1, 2, 3, 4)], ">", True))
    (tmp_path / "run_11.tif").write_bytes(build([value(k) for k in (7, 8, 9, 10)]))
    (tmp_path / "stack.tif").write_bytes(build([np.zeros((9, 9), "u2")]))
    (tmp_path / ".hidden.tif").write_bytes(b"junk")
    pages = _load(spark, tmp_path, ignored="stack, other", batch=2)
    assert pages.rdd.getNumPartitions() == 3 + 1 + 2
    rows = sorted(pages.collect(), key=lambda r: r.position)
    assert [(r.position, r.file, r.page, r.pixels[0]) for r in rows] == [(k, f, p, k) for k, (f, p) in enumerate([("run_2.TIFF", p) for p in range(5)] + [("run_10.tif", 0), ("run_10.tif", 1)] + [("run_11.tif", p) for p in range(4)])]
    out = tiff.converted(pages, 2, 2)
    got = {(r.plane, r.channel, r.frame): r.pixels[0] for r in out.collect()}
    assert got == {(p, c, f): 4 * f + 2 * p + c for p in (0, 1) for c in (0, 1) for f in (0, 1)}  # 11 pages: three are left over
    with pytest.raises(Exception, match=r"one shape, here \(2, 3\), but for stack.tif \(9, 9\)"):
        _load(spark, tmp_path).collect()


def test_regions_are_cut_from_both_channels(spark, tmp_path):
    pages = [np.arange(24, dtype="i2").reshape(6, 4) + 100 * k for k in range(8)]
    (tmp_path / "a.tif").write_bytes(build(pages))
    out = tiff.converted(_load(spark, tmp_path), 1, 2, F.lit(2), F.lit(4)).collect()
    assert len(out) == 8
    for r in out:
        assert (r.height, r.width) == (3, 4) and r.pixels == pages[2 * r.frame + r.channel][2:5].ravel().tolist()


def test_what_cannot_be_read(spark, tmp_path):
    for name, data in (("short", build([np.zeros((2, 2), "u2")])[:-2]), ("other", b"PK" + bytes(30)), ("empty", struct.pack("<2sHI", b"II", 42, 0))):
        folder = tmp_path / name
        folder.mkdir()
        (folder / "a.tif").write_bytes(data)
        with pytest.raises(Exception, match="ends before|not a TIFF|has no page"):
            _load(spark, folder).collect()
    ring = bytearray(build([np.zeros((2, 2), "u2")]))
    ring[-4:] = ring[4:8]
    (tmp_path / "ring.tif").write_bytes(ring)
    with open(tmp_path / "ring.tif", "rb") as file, pytest.raises(ValueError, match="ring"):
        tiff.directories(file)
    assert _load(spark, tmp_path, ignored="ring").count() == 0  # no file left: an empty table


def test_the_sink_writes_what_the_source_reads(spark, tmp_path):
    rng = np.random.default_rng(2)
    stack = rng.integers(-32768, 32767, (25, 7, 5)).astype("i2")
    spark.dataSource.register(tiff.TiffStack)
    rows = spark.createDataFrame([(t, 7, 5, f.ravel().tolist()) for t, f in enumerate(stack)], "frame long, height int, width int, pixels array<smallint>")
    rows.repartitionByRange(4, "frame").sortWithinPartitions("frame").write.format("tiff_stack").mode("append").save(str(tmp_path / "out"))
    names = sorted(os.listdir(tmp_path / "out"))
    assert len(names) == 4 and names[0] == "frames-000000000000.tif" and all(n.endswith(".tif") for n in names)
    back = sorted(_load(spark, tmp_path / "out").collect(), key=lambda r: r.position)
    assert [r.pixels for r in back] == [f.ravel().tolist() for f in stack]
    with pytest.raises(Exception, match="same frame"):
        same = rows.where("frame < 2").select(F.lit(3).cast("long").alias("frame"), "height", "width", "pixels")
        same.repartition(2).write.format("tiff_stack").mode("append").save(str(tmp_path / "bad"))
    assert [n for n in os.listdir(tmp_path / "bad") if not n.startswith(".")] == []
