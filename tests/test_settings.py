"""Rules on settings, and whether recordings are ready, by hand-made cases and plain loops."""

import random

from imgtrace.operators import settings

GOOD = {
    "main.tau": "1.0", "main.two_channels": "false", "main.first_channel_functional": "true", "main.second_channel_functional": "false", "registration.align_by_first_channel": "true",
    "registration.maximum_offset_fraction": "0.1", "one_photon_registration.enabled": "false", "one_photon_registration.spatial_highpass_window": "42", "nonrigid_registration.enabled": "true",
    "nonrigid_registration.block_size": "[128, 128]", "spike_deconvolution.baseline_method": "maximin", "diffeomorphic_registration.speed_factor": "3", "file_io.data_path": None,
}


def _found(spark, **changes):
    rows = [(k, n, v) for k, over in changes.items() for n, v in {**GOOD, **over}.items()]
    table = spark.createDataFrame(rows, "key string, name string, value string")
    return table, {(r.key, r.name, r.kind, r.problem) for r in settings.findings(table).collect()}


def test_rules_on_settings(spark):
    cases = {
        "good": {}, "tau": {"main.tau": "0"}, "share": {"registration.maximum_offset_fraction": "1.01"}, "word": {"main.tau": "soon"}, "blocks": {"nonrigid_registration.block_size": "[128, 0]"},
        "off": {"nonrigid_registration.block_size": "[0, 0]", "nonrigid_registration.enabled": "false"}, "odd": {"one_photon_registration.enabled": "true", "one_photon_registration.spatial_highpass_window": "43"},
        "zero": {"one_photon_registration.enabled": "True", "one_photon_registration.spatial_highpass_window": "0"}, "unused": {"one_photon_registration.spatial_highpass_window": "43"}, "method": {"spike_deconvolution.baseline_method": "minimax"},
        "fast": {"diffeomorphic_registration.speed_factor": "7"}, "back": {"diffeomorphic_registration.speed_factor": "-1"}, "path": {"file_io.data_path": "/data"}, "none": {"main.first_channel_functional": "false"},
        "second": {"registration.align_by_first_channel": "False"}, "missing": {"main.tau": None},
    }
    table, found = _found(spark, **cases)
    out = "out of range"
    assert found == {
        ("tau", "main.tau", "error", out), ("share", "registration.maximum_offset_fraction", "error", out), ("word", "main.tau", "error", out), ("blocks", "nonrigid_registration.block_size", "error", out),
        ("odd", "one_photon_registration.spatial_highpass_window", "error", "not even"), ("zero", "one_photon_registration.spatial_highpass_window", "error", out), ("method", "spike_deconvolution.baseline_method", "error", "not one of its words"),
        ("fast", "diffeomorphic_registration.speed_factor", "warning", out), ("back", "diffeomorphic_registration.speed_factor", "error", out),
        ("path", "file_io.data_path", "warning", "set later"), ("none", "main.first_channel_functional", "error", "no functional channel"), ("second", "registration.align_by_first_channel", "warning", "no second channel"),
    }
    verdicts = {r.key: (r.errors, r.warnings, r.valid) for r in settings.verdicts(table, settings.findings(table)).collect()}
    assert verdicts["good"] == (0, 0, True) and verdicts["back"] == (1, 0, False) and verdicts["fast"] == (0, 1, True) and len(verdicts) == len(cases)


def test_readiness_is_what_loops_give(spark):
    rng = random.Random(1)
    recordings = [(k, rng.randint(1, 3), rng.randint(1, 2)) for k in range(40)]
    files = [(k, f"f{i}", rng.choice([0, 1, 50, 301, 700]), *rng.choice([(8, 8)] * 4 + [(8, 9)]), rng.choice(["uint16"] * 5 + ["int16", "uint8"])) for k in range(38) for i in range(rng.randint(0, 4))]
    out = settings.readiness(spark.createDataFrame(recordings, "recording long, planes int, channels int"), spark.createDataFrame(files, "recording long, file string, pages long, height int, width int, kind string"))
    got = {r.recording: r for r in out.collect()}
    assert set(got) == set(range(40))
    for k, planes, channels in recordings:
        own = sorted(f for f in files if f[0] == k)
        full = [f for f in own if f[2]]
        shapes = {}
        for f in full:
            shapes.setdefault(f[3:5], []).append(f)
        alike = max(shapes.values(), key=lambda fs: (sum(f[2] for f in fs), [-ord(c) for c in fs[0][1]]), default=[])
        pages = sum(f[2] for f in alike)
        kind = full[0][5] if full else None
        frames, left = divmod(pages, planes * channels)
        errors = (not own) + len(own) - len(full)
        warnings = (len(full) > len(alike)) + any(f[5] != kind for f in full) + (left > 0) + (0 < pages and frames < 200) + (kind == "uint8") + (kind == "uint16")
        r = got[k]
        assert (r.files, r.empty_files, r.pages, r.kind, r.odd_files, r.frames, r.left_over, r.errors, r.warnings, r.valid) == (len(own), len(own) - len(full), pages, kind, len(full) - len(alike), frames, left, errors, warnings, errors == 0)
        assert (r.height, r.width) == (alike[0][3:5] if alike else (None, None))


def test_values_are_read_once(spark):
    values = spark.range(40).selectExpr("id % 4 as key", "if(id < 20, 'main.tau', 'roi_detection.enabled') as name", "cast(id % 3 as string) as value")
    assert settings.findings(values)._jdf.queryExecution().optimizedPlan().toString().count("Range (") == 1


def test_repeated_rows_and_rows_without_key_are_found(spark):
    rows = [(None, "main.tau", "0"), (1, "main.tau", "0"), (1, "main.tau", "0"), (None, "nonrigid_registration.enabled", "true"), (None, "nonrigid_registration.block_size", "0"), (1, None, "0"), (1, "no.rule", "0")]
    found = settings.findings(spark.createDataFrame(rows, "key long, name string, value string")).collect()
    assert sorted((r.key or 0, r.name, r.kind) for r in found) == [(0, "main.tau", "error"), (1, "main.tau", "error"), (1, "main.tau", "error")]


def test_values_of_any_kind_have_a_finding(spark):
    switch, even, blocks = "one_photon_registration.enabled", "one_photon_registration.pre_smoothing_sigma", "nonrigid_registration.block_size"
    values = ["NaN", "Infinity", "1e30", "43.5", "[43, 2]", "[44, 1]", "[44, x]", "", " 44 ", None]
    rows = [(k, n, v) for k, value in enumerate(values) for n, v in ((switch, "true"), (even, value), ("nonrigid_registration.enabled", "true"), (blocks, value))]
    found = {(r.key, r.name, r.problem) for r in settings.findings(spark.createDataFrame(rows, "key long, name string, value string")).collect()}
    assert found == {(3, even, "not even"), (4, even, "not even"), *((k, n, "out of range") for k in (6, 7) for n in (even, blocks))}


def test_keys_meet_by_numbers_only(spark):
    values = spark.range(40).selectExpr("id % 4 as key", "if(id < 20, 'main.tau', 'roi_detection.enabled') as name", "cast(id % 3 as string) as value")
    plan = settings.findings(values)._jdf.queryExecution().executedPlan().toString()
    assert "ObjectHashAggregate" not in plan and "lambda" not in plan and plan.count("Exchange hashpartitioning") == 1
    met = plan[plan.index("Exchange hashpartitioning") :].split("Project [", 1)[1].split("]", 1)[0]
    assert [c.split("#")[0] for c in met.split(", ")] == ["key", "rule", "fact"]


def test_findings_on_the_whole_come_once_and_by_key(spark):
    pair = ("main.first_channel_functional", "main.second_channel_functional")
    rows = [(k, n, "false") for k in (1, 1, None) for n in pair] + [(2, pair[0], "false"), (3, pair[1], "False"), (4, pair[0], "true"), (4, pair[1], "false")]
    found = settings.findings(spark.createDataFrame(rows, "key long, name string, value string")).collect()
    assert sorted((r.key or 0, r.name, r.problem) for r in found) == [(k, pair[0], "no functional channel") for k in (0, 1)]
