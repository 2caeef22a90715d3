"""Rules on recordings' settings and files: what is wrong, what is odd, and whether a recording can be processed.

Settings are rows (key, name, value as text), so many recordings' are checked by one join with a small table of rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Each setting's least and greatest value, with an open end marked; what breaks it is an error or a warning;
# and the setting that must be on for the rule to hold. Lists of numbers are checked value by value.
RULES = (
    ("main.tau", "(0", None, "error", None),
    ("registration.reference_frame_count", "(0", None, "error", None),
    ("registration.batch_size", "(0", None, "error", None),
    ("registration.maximum_offset_fraction", "(0", "1", "error", None),
    ("registration.spatial_smoothing_sigma", "0", None, "error", None),
    ("registration.temporal_smoothing_sigma", "0", None, "error", None),
    ("registration.bad_frame_threshold", "(0", None, "error", None),
    ("registration.registration_metric_principal_components", "0", None, "error", None),
    ("one_photon_registration.spatial_highpass_window", "(0", None, "error", "one_photon_registration.enabled"),
    ("one_photon_registration.pre_smoothing_sigma", "0", None, "error", "one_photon_registration.enabled"),
    ("one_photon_registration.edge_taper_pixels", "0", None, "error", "one_photon_registration.enabled"),
    ("nonrigid_registration.signal_to_noise_threshold", "(0", None, "error", "nonrigid_registration.enabled"),
    ("nonrigid_registration.maximum_block_offset", "(0", None, "error", "nonrigid_registration.enabled"),
    ("nonrigid_registration.block_size", "(0", None, "error", "nonrigid_registration.enabled"),
    ("roi_detection.preclassification_threshold", "0", "1", "error", "roi_detection.enabled"),
    ("roi_detection.threshold_scaling", "(0", None, "error", "roi_detection.enabled"),
    ("roi_detection.spatial_highpass_window", "(0", None, "error", "roi_detection.enabled"),
    ("roi_detection.maximum_overlap", "(0", "1", "error", "roi_detection.enabled"),
    ("roi_detection.temporal_highpass_window", "(0", None, "error", "roi_detection.enabled"),
    ("roi_detection.maximum_iterations", "(0", None, "error", "roi_detection.enabled"),
    ("roi_detection.maximum_binned_frames", "(0", None, "error", "roi_detection.enabled"),
    ("signal_extraction.minimum_neuropil_pixels", "(0", None, "error", None),
    ("signal_extraction.inner_neuropil_border_radius", "0", None, "error", None),
    ("signal_extraction.cell_probability_percentile", "0", "100", "error", None),
    ("signal_extraction.classification_threshold", "0", "1", "error", None),
    ("signal_extraction.batch_size", "(0", None, "error", None),
    ("signal_extraction.colocalization_threshold", "0", "1", "error", None),
    ("spike_deconvolution.neuropil_coefficient", "0", "1", "warning", None),
    ("spike_deconvolution.baseline_window", "(0", None, "error", None),
    ("spike_deconvolution.baseline_sigma", "0", None, "error", None),
    ("spike_deconvolution.baseline_percentile", "0", "100", "error", None),
    ("roi_selection.probability_threshold", "0", "1", "error", None),
    ("roi_selection.maximum_size", "(0", None, "error", None),
    ("roi_selection.mroi_region_margin", "0", None, "error", None),
    ("roi_selection.probability_threshold_channel_2", "0", "1", "error", None),
    ("roi_selection.maximum_size_channel_2", "(0", None, "error", None),
    ("roi_selection.mroi_region_margin_channel_2", "0", None, "error", None),
    ("diffeomorphic_registration.grid_sampling_factor", "(0", "1", "error", None),
    ("diffeomorphic_registration.final_grid_sampling", "(0", None, "error", None),
    ("diffeomorphic_registration.scale_sampling", "(0", None, "error", None),
    ("diffeomorphic_registration.speed_factor", "(0", None, "error", None),
    ("diffeomorphic_registration.speed_factor", "1", "5", "warning", None),
    ("roi_tracking.threshold", "0", "1", "error", None),
    ("roi_tracking.mask_prevalence", "0", "100", "error", None),
    ("roi_tracking.pixel_prevalence", "0", "100", "error", None),
    ("roi_tracking.step_sizes", "(0", None, "error", None),
    ("roi_tracking.bin_size", "(0", None, "error", None),
    ("roi_tracking.maximum_distance", "(0", None, "error", None),
    ("roi_tracking.minimum_size", "(0", None, "error", None),
)
# Settings whose whole part must be even, words that settings take, and settings that the pipeline sets itself.
EVEN = {"one_photon_registration.spatial_highpass_window": "one_photon_registration.enabled", "one_photon_registration.pre_smoothing_sigma": "one_photon_registration.enabled"}
WORDS = {
    "spike_deconvolution.baseline_method": ("maximin", "constant", "constant_percentile"),
    "diffeomorphic_registration.image_type": ("mean", "enhanced_mean", "maximum_projection"),
}
SET_LATER = ("file_io.data_path", "file_io.output_path", "recording_io.recording_directories")
# Kinds of pixels that are read as they are and those that are halved, and how many frames a plane should have.
NATIVE, HALVED, FEW_FRAMES = ("uint16", "int16", "int32"), ("uint16", "int32"), 200

# Switches of which two that are off make a finding: its name, kind and problem.
TOGETHER = (
    ("main.first_channel_functional", "main.second_channel_functional", "main.first_channel_functional", "error", "no functional channel"),
    ("main.two_channels", "registration.align_by_first_channel", "registration.align_by_first_channel", "warning", "no second channel"),
)


def _numbers(value: Column) -> Column:
    """The numbers of a value as text: one, or a list in brackets; null for what is none."""
    return F.split(F.regexp_replace(value, r"[\[\]()\s]", ""), ",").try_cast("array<double>")


def rules_table(spark: SparkSession) -> tuple[DataFrame, dict[int, int]]:
    """A row for each test of a setting: what it looks at, what it tells, and what that hangs on; and which facts fall by others.

    What other tests of a key hang on is a fact, and has a bit: switches that are on or off, and errors of settings that
    have warnings too. A test tells only with the facts `needs` and `also` (0: none) and without all of `against`. Errors
    that need a switch are no facts without it: their bits are given with the switch's.
    """
    limit = lambda text: None if text is None else float(text.strip("("))
    tests = [(n, "range", limit(low), (low or "").startswith("("), limit(high), None, n, kind, "out of range", needs) for n, low, high, kind, needs in RULES]
    tests += [(n, "even", None, False, None, None, n, "error", "not even", needs) for n, needs in EVEN.items()]
    tests += [(n, "word", None, False, None, list(words), n, "error", "not one of its words", None) for n, words in WORDS.items()]
    tests += [(n, "later", None, False, None, None, n, "warning", "set later", None) for n in SET_LATER]
    switches = sorted({t[-1] for t in tests if t[-1]})
    tests += [(n, "on", None, False, None, None, None, None, None, None) for n in switches]
    told = {first: what for first, _, *what in TOGETHER}
    tests += [(n, "off", None, False, None, None, *told.get(n, (None, None, None)), None) for *both, _, _, _ in TOGETHER for n in both]
    warned = {t[6] for t in tests if t[7] == "warning"}
    bits: dict[int, int] = {}
    for k, (*_, name, kind, _, _) in enumerate(tests):
        if kind is None or tests[k][1] == "off" or (kind == "error" and name in warned):
            bits[k] = 1 << len(bits)
    switch = {(t[1], t[0]): bits[k] for k, t in enumerate(tests) if t[1] in ("on", "off")}
    also = {first: switch["off", second] for first, second, *_ in TOGETHER}
    rows, falls = [], {}
    for k, (*what, name, kind, problem, needs) in enumerate(tests):
        against = sum(b for e, b in bits.items() if kind == "warning" and tests[e][6:8] == (name, "error"))
        rows.append((k, *what, name, kind, problem, switch.get(("on", needs), 0), also.get(what[0], 0) if what[1] == "off" else 0, against, bits.get(k, 0)))
        if k in bits and needs:
            falls[bits[k]] = switch["on", needs]
    schema = "rule int, name string, test string, low double, open boolean, high double, words array<string>, told string, kind string, problem string, needs long, also long, against long, fact long"
    return spark.createDataFrame(rows, schema), falls


def findings(values: DataFrame) -> DataFrame:
    """key, name, kind (error or warning) and problem of settings (key, name, value as text; null: not set) that break a rule.

    A recording has no functional channel if both of its switches are off, and can't be aligned by a second channel that
    it does not have. Of a setting with errors no warnings are told. A setting that is missing, or null, breaks no rule on its value; one that is no number breaks its own.
    The values are read once: each meets the rules of its name, and only rows that break one, or that others hang on, go on,
    as numbers, to meet those of their key.
    """
    rules, falls = rules_table(values.sparkSession)
    value, test = F.col("value"), F.col("test")
    numeric = sorted({n for n, *_ in RULES} | set(EVEN))
    numbers = F.when(F.col("one").isNull() & F.col("name").isin(*numeric), _numbers(value))
    read = values.select("key", "name", "value", value.try_cast("double").alias("one")).withColumn("numbers", numbers).withColumn("in_order", F.sort_array("numbers"))  # null first
    ends = {"first": F.get("numbers", 0), "least": F.get("in_order", 0), "most": F.try_element_at("in_order", F.lit(-1))}
    read = read.select("key", "name", "value", *(F.coalesce("one", c).alias(n) for n, c in ends.items()))
    first, least, most = F.col("first"), F.col("least"), F.col("most")
    outside = least.isNull() | (least < F.col("low")) | (F.col("open") & (least == F.col("low"))) | F.coalesce(most > F.col("high"), F.lit(False))
    odd = (first >= 0) & (first % 2 >= 1) & (first % 2 < 2)  # the whole part, of any size
    broken = (
        F.when(test == "range", value.isNotNull() & outside)
        .when(test == "even", odd)
        .when(test == "word", ~F.array_contains("words", value))
        .when(test == "later", value != "")
        .when(test == "on", F.lower(value) == "true")
        .when(test == "off", F.lower(value) == "false")
    )
    met = read.join(F.broadcast(rules), "name").where(broken).select("key", "rule", "fact")  # a fixed table
    of_key = Window.partitionBy("key").orderBy("rule")
    every = F.bit_or("fact").over(of_key.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    facts = met.select("key", "rule", every.alias("facts"), F.lag("rule").over(of_key).alias("before"))
    has = lambda bits: F.col("facts").bitwiseAND(bits) != 0
    on = lambda bits: has(bits) & F.col("key").isNotNull()
    fallen = sum((F.when(on(F.lit(s)), 0).otherwise(b) for b, s in falls.items()), F.lit(0)).cast("long")
    facts = facts.withColumn("facts", F.col("facts").bitwiseAND(F.bitwise_not(fallen)))
    once = (F.col("also") == 0) | (has(F.col("also")) & ~F.col("rule").eqNullSafe(F.col("before")))  # told of a key, not of its rows
    tells = F.col("kind").isNotNull() & ((F.col("needs") == 0) | on(F.col("needs"))) & once & ~has(F.col("against"))
    out = rules.select("rule", "told", "kind", "problem", "needs", "also", "against")
    return facts.join(F.broadcast(out), "rule").where(tells).select("key", F.col("told").alias("name"), "kind", "problem")


def verdicts(keys: DataFrame, found: DataFrame) -> DataFrame:
    """key, errors, warnings and valid of every key."""
    count = lambda kind: F.count(F.when(F.col("kind") == kind, 1))
    counted = found.groupBy("key").agg(count("error").alias("errors"), count("warning").alias("warnings"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return keys.select("key").distinct().join(counted, "key", "left").select("key", zero("errors"), zero("warnings"), (F.coalesce("errors", F.lit(0)) == 0).alias("valid"))


def readiness(recordings: DataFrame, files: DataFrame) -> DataFrame:
    """What each recording (recording, planes, channels) holds by its files (recording, file, pages, height, width, kind), and whether it can be processed.

    height and width are those that most pages have (ties: the first file's in order), pages counts those; files of another
    shape are counted as odd. Errors: no file, and files without pages. Warnings: odd shapes, kinds that differ from the
    first file's, a last cycle that is not full, few frames, and kinds that are cast or halved.
    """
    full = files.where("pages > 0")
    shapes = full.groupBy("recording", "height", "width").agg(F.sum("pages").alias("pages"), F.count("*").alias("alike"), F.min("file").alias("first"))
    usual = shapes.withColumn("place", F.row_number().over(Window.partitionBy("recording").orderBy(F.desc("pages"), "first"))).where("place = 1").drop("place", "first")
    kinds = full.groupBy("recording").agg(F.min_by("kind", "file").alias("kind"), F.count("*").alias("full"))
    others = full.join(kinds.select("recording", F.col("kind").alias("usual")), "recording").groupBy("recording").agg(F.count(F.when(F.col("kind") != F.col("usual"), 1)).alias("other_kinds"))
    counts = files.groupBy("recording").agg(F.count("*").alias("files"), F.count(F.when(F.coalesce("pages", F.lit(0)) == 0, 1)).alias("empty_files"))
    joined = recordings
    for part in (counts, usual, kinds, others):
        joined = joined.join(part, "recording", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    cycle = F.greatest(F.col("planes") * F.col("channels"), F.lit(1))
    flag = lambda condition: F.coalesce(condition, F.lit(False)).cast("int")
    out = joined.select(
        "recording", zero("files").alias("files"), zero("empty_files").alias("empty_files"), zero("pages").alias("pages"), "height", "width", "kind",
        (zero("full") - zero("alike")).alias("odd_files"), zero("other_kinds").alias("other_kinds"), F.floor(zero("pages") / cycle).alias("frames"), (zero("pages") % cycle).alias("left_over"),
    )
    warnings = (F.col("odd_files") > 0, F.col("other_kinds") > 0, F.col("left_over") > 0, (F.col("pages") > 0) & (F.col("frames") < FEW_FRAMES), ~F.col("kind").isin(*NATIVE), F.col("kind").isin(*HALVED))
    errors = flag(F.col("files") == 0) + F.col("empty_files")
    return out.withColumns({"errors": errors, "warnings": sum((flag(w) for w in warnings), F.lit(0)), "valid": errors == 0})
