"""Faults that only odd or large inputs showed."""

import math
import random

import pytest
from pyspark.sql import functions as F

from imgtrace.operators import classifier, extraction, masks, neuropil, tracking
from imgtrace.plans import records


def test_logistic_layer_reads_equal_rows_once(spark):
    rows = [(i, [0.5, 1.0] if i % 3 else [0.25, 1.0], float(i % 2)) for i in range(600)]
    out = classifier.weighed(spark.createDataFrame(rows, "key long, odds array<double>, label double"))
    assert sorted((r.odds[0], r.label, r.n) for r in out.collect()) == [(0.25, 0.0, 100.0), (0.25, 1.0, 100.0), (0.5, 0.0, 200.0), (0.5, 1.0, 200.0)]


def test_regions_beyond_the_image_have_no_surround(spark):
    masks = spark.createDataFrame([(1, 33), (1, 34), (2, 433), (2, 470)], "roi long, pixel long")
    out = {(r.roi, r.pixel) for r in neuropil.surrounds(masks, "roi", "pixel", 10, 10, 1, 1).collect()}
    assert out == {(1, p) for p in (22, 25, 42, 45)}


def test_grown_surrounds_pass_over_pixels_beyond_the_image(spark):
    near, far = [(0, 1, 33), (0, 1, 34), (0, 2, 71)], [(0, 3, 433), (0, 2, 999), (1, 4, 100_000)]
    found = lambda rows: {tuple(r) for r in extraction.surrounds(spark.createDataFrame(rows, "plane long, roi long, pixel long"), "plane", "roi", "pixel", 10, 10, 1, 40).collect()}
    want = found(near)
    assert found(near + far) == want and {r for _, r, _ in want} == {1, 2}


def test_near_regions_without_shared_pixels_make_no_rows(spark):
    masks = spark.createDataFrame([(r, r % 2, 5.0, 5.0, r * 3 + k) for r in range(40) for k in range(4)], "roi long, recording long, y double, x double, pixel long")
    pairs = tracking._distances(masks, 0.9, F.col("y_a") == F.col("y_b"), "y", "x")
    assert sorted((r.a, r.b, round(r.d, 6)) for r in pairs.collect()) == [(r, r + 1, round(6 / 7, 6)) for r in range(39)]


def test_means_of_surrounds_meet_the_movie_by_lines(spark):
    around = spark.createDataFrame([(1, 0, [0, 2]), (1, 1, [1]), (2, 1, [0, 1, 2]), (3, 2, [0])], "roi long, y long, xs array<long>")
    movie = spark.createDataFrame([(0, 7, 1.0), (2, 7, 2.0), (4, 7, 6.0), (3, 7, None), (5, 8, 4.0)], "pixel long, frame long, value double")
    out = {(r.roi, r.frame): r.neuropil for r in extraction.line_means(around, movie, "roi", "pixel", "frame", "value", 3).collect()}
    assert out == {(1, 7): 3.0, (2, 7): 6.0, (2, 8): 4.0}


def test_pairs_on_shared_pixels_are_dealt_by_their_number(spark, monkeypatch):
    rows = spark.createDataFrame([(r, p) for r in range(12) for p in range(r % 3, 9)], "roi long, pixel long")
    want = {tuple(r) for r in masks.shared_pixels(rows, rows, "roi", "pixel").collect()}
    monkeypatch.setattr(masks, "PAIRS", 50)
    out = masks.shared_pixels(rows, rows, "roi", "pixel")
    assert {tuple(r) for r in out.collect()} == want and len(want) == 144
    held = [sum(r % 3 <= p for r in range(12)) for p in range(9)]
    assert "hashpartitioning(a#" in (plan := out._jdf.queryExecution().executedPlan().toString()) and f", {sum(n * n for n in held) // 50 + 1})" in plan


def test_near_pairs_are_sent_to_no_single_task(spark):
    rois = spark.createDataFrame([(k, k % 2, float(k), 0.0) for k in range(6)], "roi long, recording long, y double, x double")
    out = masks.near_pairs(rois, "roi", "recording", "y", "x", 1.5)
    assert sorted((r.a, r.b) for r in out.collect()) == [(k, k + 1) for k in range(5)]
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()


def test_means_of_boxes_are_those_of_their_places(spark, monkeypatch):
    rng, height, width = random.Random(6), 12, 10
    held = sorted({(p, 2 * r + p, rng.randrange(40 * (r % 2), 130)) for p in range(2) for r in range(4) for _ in range(4)})
    movie = [(p, f, rng.uniform(0, 9)) for f in range(7) for p in range(-1, 125) if rng.random() < 0.9 and not (f == 3 and p < 60)]
    movie += [(55, 0, 4.0), (55, 0, 5.0), (77, 0, None), (21, 1, math.inf), (88, 2, math.nan)]
    regions, table = spark.createDataFrame(held, "plane long, roi long, pixel long"), spark.createDataFrame(movie, "pixel long, frame long, value double")
    names = ("plane", "roi", "pixel", height, width, 1, 20)
    want = {}
    for r in extraction.surrounds(regions, *names).collect():
        for p, f, v in movie:
            if p == r.pixel and v is not None:
                want.setdefault((r.roi, f), []).append(v)
    around = extraction.surround_boxes(regions, *names)
    for places, frames, at_once in ((30, 3, 2), (4096, 64, 256)):
        monkeypatch.setattr(extraction, "PLACES", places)
        monkeypatch.setattr(extraction, "FRAMES", frames)
        monkeypatch.setattr(extraction, "REGIONS", at_once)
        out = extraction.surround_means(*around, table, "plane", "roi", "pixel", "frame", "value", height, width)
        got = {(r.roi, r.frame): r.neuropil for r in out.collect()}
        assert got == pytest.approx({k: sum(v) / len(v) for k, v in want.items()}, nan_ok=True) and len(got) == out.count()
    assert any(map(math.isnan, got.values())) and math.inf in got.values()


def test_extracted_traces_make_no_lists_of_places(spark):
    plan = records.extract_traces(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "array_except" not in plan and "collect_set" not in plan


def test_pairs_on_shared_pixels_pass_no_shuffle(spark, monkeypatch):
    rng = random.Random(9)
    held = sorted({(rng.randrange(30) ** 2, rng.randrange(25)) for _ in range(200)}) + [(7, None), (900, 3), (900, None), (None, 4), (None, 5)]
    rows = spark.createDataFrame(held, "roi long, pixel long")
    own = {a: {p for r, p in held if r == a} for a in {r for r, _ in held} - {None}}
    met = {(a, b): len(own[a] & own[b] - {None}) for a in own for b in own}
    shared = {(a, b, n, len(own[a]), len(own[b])) for (a, b), n in met.items() if n}
    score = {(a, b): n / (na + nb - n) for a, b, n, na, nb in shared if a < b}
    for pairs in (40, 4_000_000):
        monkeypatch.setattr(masks, "PAIRS", pairs)
        out = masks.jaccard(rows, "roi", "pixel")
        got = [(r.a, r.b, r.jaccard) for r in out.collect()]
        assert {(a, b): j for a, b, j in got} == pytest.approx(score) and len(got) == len(score)
        got = [tuple(r) for r in masks.shared_pixels(rows, rows, "roi", "pixel").collect()]
        assert set(got) == shared and len(got) == len(shared)
        after, lists = out._jdf.queryExecution().executedPlan().toString().split("Generate", 1)
        assert "Exchange" not in after and "Exchange" in lists


def test_numbers_go_one_to_a_task(spark):
    for tasks in (1, 2, 13):
        numbers = spark.createDataFrame([(k, n) for k, n in enumerate(masks._one_a_task(spark, tasks))], "task long, a long")
        placed = numbers.repartition(tasks, "a").select("task", F.spark_partition_id().alias("at")).collect()
        assert sorted(tuple(r) for r in placed) == [(k, k) for k in range(tasks)]


def test_least_overlaps_pass_no_shuffle_as_pairs(spark, monkeypatch):
    rows = spark.createDataFrame([(r, p) for r in range(14) for p in range(r % 4, 3 + r)] + [(3, None)], "roi long, pixel long")
    own = {r: set(range(r % 4, 3 + r)) for r in range(14)}
    size = lambda r: len(own[r]) + (r == 3)
    monkeypatch.setattr(masks, "PAIRS", 30)
    out = masks.least_overlap(rows, "roi", "pixel")
    want = {(a, b): len(own[a] & own[b]) / min(size(a), size(b)) for a in own for b in own if a < b and own[a] & own[b]}
    assert {(r.a, r.b): r.overlap for r in out.collect()} == pytest.approx(want) and out.count() == len(want)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString().split("Generate", 1)[0]


def test_blocks_may_outnumber_their_tasks(spark):
    rows = spark.createDataFrame([(r, p) for r in range(20) for p in range(r % 3, 6)], "roi long, pixel long")
    lists = rows.groupBy(F.col("pixel")).agg(F.collect_list("roi").alias("ys"), F.collect_list(F.lit(1)).alias("n_ys"))
    met = masks._blocks(rows, "roi", "pixel", 7).join(lists, "pixel")
    out = {tuple(r) for r in masks._counted(met, 2).select("a", "b", "shared").collect()}
    assert out == {(a, b, 6 - max(a % 3, b % 3)) for a in range(20) for b in range(20)}
