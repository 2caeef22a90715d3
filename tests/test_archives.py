"""Saved arrays and lists of records against what numpy reads."""

import os

import numpy as np
import pytest

from imgtrace.sources import archives

GROUPED = "pixel_counts:y_pixels,x_pixels,pixel_weights"


def _regions(seed, n):
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        size = int(rng.integers(1, 9))
        out.append({"y_pixels": rng.integers(0, 99, size), "x_pixels": rng.integers(0, 99, size), "pixel_weights": rng.random(size).astype("f4"), "centroids": rng.integers(0, 99, 2), "radius": rng.random(1).astype("f4"), "soma_mask": rng.random(size) < 0.5 if rng.random() < 0.6 else None})
    return out


def _save(path, regions, packed=False, with_soma=True):
    arrays = {"pixel_counts": np.array([len(r["y_pixels"]) for r in regions], "u4"), "frame_width": np.array([512], "u4")}
    arrays |= {f: np.concatenate([r[f] for r in regions]) for f in ("y_pixels", "x_pixels", "pixel_weights")}
    arrays |= {"centroids": np.stack([r["centroids"] for r in regions]).astype("i4"), "radius": np.concatenate([r["radius"] for r in regions])}
    if with_soma:
        arrays["soma_mask_counts"] = np.array([0 if r["soma_mask"] is None else len(r["soma_mask"]) for r in regions], "u4")
        arrays["soma_mask"] = np.concatenate([r["soma_mask"] for r in regions if r["soma_mask"] is not None])
    (np.savez_compressed if packed else np.savez)(path, **arrays)


def _load(spark, path, **options):
    spark.dataSource.register(archives.RecordLists)
    return spark.read.format("record_lists").options(**options).load(str(path))


@pytest.mark.parametrize("packed", [False, True])
def test_lists_of_regions_of_unequal_size(spark, tmp_path, packed):
    whole = {"a.npz": _regions(1, 23), "b.npz": _regions(2, 1)}
    for name, regions in whole.items():
        _save(tmp_path / name, regions, packed, with_soma=name == "a.npz")
    for batch in (5, 4096):
        rows = _load(spark, tmp_path, grouped=GROUPED, batch=batch).collect()
        assert len(rows) == 24
        for r in rows:
            want = whole[r.file][r.item]
            for f in ("y_pixels", "x_pixels", "pixel_weights", "centroids", "radius"):
                assert r.fields[f] == [float(x) for x in want[f]]
            assert r.fields["frame_width"] == [512] and "pixel_counts" not in r.fields
            if r.file == "a.npz":
                assert r.fields["soma_mask"] == (None if want["soma_mask"] is None else [float(x) for x in want["soma_mask"]])
            else:
                assert "soma_mask" not in r.fields


def test_lists_round_trip(spark, tmp_path):
    _save(tmp_path / "a.npz", _regions(3, 17))
    first = _load(spark, tmp_path / "a.npz", grouped=GROUPED)
    out = first.select("item", "fields").repartitionByRange(3, "item").sortWithinPartitions("item")
    out.write.format("record_lists").options(grouped=GROUPED, optional="soma_mask").mode("append").save(str(tmp_path / "out"))
    assert len(os.listdir(tmp_path / "out")) == 3
    again = _load(spark, tmp_path / "out", grouped=GROUPED).collect()
    starts = {f: int(f[len("records-") : -len(".npz")]) for f in os.listdir(tmp_path / "out")}
    assert {starts[r.file] + r.item: r.fields for r in again} == {r.item: r.fields for r in first.collect()}
    assert set(np.load(tmp_path / "out" / "records-000000000000.npz").files) >= {"pixel_counts", "soma_mask", "soma_mask_counts", "frame_width"}


def test_lists_that_do_not_fit_together(spark, tmp_path):
    np.savez(tmp_path / "a.npz", x=np.arange(5), x_counts=np.array([2, 3]), y=np.arange(4), y_counts=np.array([4]))
    with pytest.raises(Exception, match="different numbers of records"):
        _load(spark, tmp_path).collect()
    np.savez(tmp_path / "a.npz", x=np.array([{}], dtype=object))
    with pytest.raises(Exception, match="arrays of numbers"):
        _load(spark, tmp_path).collect()
    (tmp_path / "none").mkdir()
    assert _load(spark, tmp_path / "none").count() == 0


def test_rows_of_arrays(spark, tmp_path):
    rng = np.random.default_rng(4)
    traces, offsets, movie = rng.random((150, 7)).astype("f4"), rng.integers(-9, 9, 31).astype("i4"), rng.integers(0, 99, (9, 4, 3)).astype("i2")
    np.save(tmp_path / "traces.npy", traces)
    np.savez(tmp_path / "rest.npz", offsets=offsets, movie=movie, rate=np.float64(30.5))
    spark.dataSource.register(archives.ArrayRows)
    load = lambda **o: spark.read.format("array_rows").options(**o).load(str(tmp_path))
    rows = load(batch=40).collect()
    want = {("traces.npy", "traces"): traces, ("rest.npz", "offsets"): offsets, ("rest.npz", "movie"): movie, ("rest.npz", "rate"): np.array([30.5])}
    assert len(rows) == 150 + 31 + 9 + 1
    for r in rows:
        array = want[r.file, r.member]
        assert r.numbers == np.ravel(array[r.row]).astype(float).tolist() and tuple(r.shape) == (array.shape if r.member != "rate" else ())
    assert {r.member for r in load(members="movie, traces").select("member").distinct().collect()} == {"movie", "traces"}


def test_saved_masks_as_pixels(spark, tmp_path):
    regions = _regions(5, 6)
    _save(tmp_path / "a.npz", regions)
    got = {(r.roi, r.y, r.x, r.pixel, round(r.weight, 6)) for r in archives.region_pixels(_load(spark, tmp_path, grouped=GROUPED)).collect()}
    assert got == {(k, int(y), int(x), int(y) * 512 + int(x), round(float(w), 6)) for k, r in enumerate(regions) for y, x, w in zip(r["y_pixels"], r["x_pixels"], r["pixel_weights"], strict=True)}
