"""Sources, sinks and the count-window stream."""

import json

import numpy as np
import pytest

from imgtrace.sources import acquisition, frames
from imgtrace.streaming import bins


def test_frames_round_trip_with_filters(spark, tmp_path):
    rows = [("r1" if k < 6 else "r2", 0, k % 2, k, 1, 2, [k, 40000]) for k in range(10)]
    table = spark.createDataFrame(rows, "recording_id string, plane int, channel int, frame int, h int, w int, pixels array<int>")
    frames.write_frames(table, str(tmp_path / "movie"))
    got = frames.read_frames(spark, str(tmp_path / "movie"), "r1", 2, 5)
    assert sorted((r.frame, list(r.pixels)) for r in got.collect()) == [(k, [k, frames.MOST]) for k in (2, 3, 4)]
    plan = got._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(recording_id" in plan and "GreaterThanOrEqual(frame,2)" in plan


def test_raw_movie(spark, tmp_path):
    movie = np.random.default_rng(0).integers(-5, 900, (7, 3, 4)).astype("<i2")
    (tmp_path / "m.bin").write_bytes(movie.tobytes())
    spark.dataSource.register(frames.RawMovie)
    out = spark.read.format("raw_movie").option("height", 3).option("width", 4).option("batch", 3).load(str(tmp_path / "m.bin"))
    assert out.rdd.getNumPartitions() == 3
    assert [list(r.pixels) for r in sorted(out.collect(), key=lambda r: r.frame)] == movie.reshape(7, -1).tolist()


def test_acquisition_settings(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"frame_rate": 30.0, "plane_number": 3, "channel_number": 1, "roi_number": 2, "roi_lines": [[1], [2]]}, indent=1))
    (tmp_path / "b.json").write_text(json.dumps({"frame_rate": 0, "plane_number": 1, "channel_number": 1, "roi_x_coordinates": [1, 2]}))
    rows = acquisition.read(spark, str(tmp_path))
    broken = {r.file.rpartition("/")[2]: {k for k in acquisition.rules() if r[k]} for r in rows.select("file", *(c.alias(k) for k, c in acquisition.rules().items())).collect()}
    assert broken == {"a.json": set(), "b.json": {"frame_rate_not_positive", "roi_x_count"}}
    planes = acquisition.planes(rows.where("plane_number = 3")).orderBy("virtual_plane").collect()
    assert [(r.region, r.plane, r.sampling_rate) for r in planes] == [(k // 3, k % 3, 10.0) for k in range(6)]
    (tmp_path / "c.json").write_text("{broken")
    with pytest.raises(Exception):
        acquisition.read(spark, str(tmp_path)).collect()


def test_bins_of_a_stream_cross_batches(spark, tmp_path):
    source = tmp_path / "in"
    schema = "region long, frame long, value double"
    for k in range(3):
        rows = [(r, k * 4 + i, float(k * 4 + i + r)) for r in (0, 1) for i in range(4)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    query = bins.counted_bins(stream, "region", "frame", "value", 5).writeStream.format("memory").queryName("bins_out").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    query.stop()
    got = sorted((r.region, r.bin, r.f) for r in spark.table("bins_out").collect())
    assert got == [(r, b, 5 * b + 2.0 + r) for r in (0, 1) for b in (0, 1)]
