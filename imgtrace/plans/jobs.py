"""The graph of processing phases as data: what is ready, what is missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Each phase of a recording's plane, and the phase it needs.
PHASES = {"binarize": None, "register": "binarize", "detect": "register", "extract": "detect", "combine": "extract"}


def _phases(df: DataFrame) -> DataFrame:
    rows = [(name, needs, k) for k, (name, needs) in enumerate(PHASES.items())]
    return df.sparkSession.createDataFrame(rows, "phase string, needs string, k int")


def finished_up_to(reached: DataFrame, plane: str, count: str) -> DataFrame:
    """plane and phase of the first `count` phases of each plane."""
    phases = _phases(reached)
    return reached.join(phases, F.col("k") < F.col(count)).select(F.col(plane).alias("plane"), "phase")


def ready(done: DataFrame, planes: DataFrame) -> DataFrame:
    """plane and phase of the jobs that are not done, and whose needs are."""
    every = planes.select("plane").withColumn("p", F.explode(F.array(*(F.struct(F.lit(n).alias("phase"), F.lit(d).cast("string").alias("needs")) for n, d in PHASES.items())))).select("plane", "p.*")
    open_ = every.join(done, ["plane", "phase"], "left_anti")
    met = open_.join(done.select("plane", F.col("phase").alias("needs")).withColumn("met", F.lit(True)), ["plane", "needs"], "left")
    return met.where(F.col("needs").isNull() | F.col("met")).select("plane", "phase")


def missing(planes: DataFrame, actual: DataFrame, plane: str, kinds: list[str]) -> DataFrame:
    """plane and kind of the expected artifacts that are not there."""
    expected = planes.select(plane, F.explode(F.array(*(F.lit(k) for k in kinds))).alias("kind"))
    return expected.join(actual.select(plane, "kind").distinct(), [plane, "kind"], "left_anti")


def overall(rows: DataFrame, recording: str, status: str, done: str, failed: str, running: str) -> DataFrame:
    """Overall status of each recording: completed if all jobs are done, failed if one is, else as far as they got."""
    is_ = lambda s: F.col(status) == s
    state = F.when(F.bool_and(is_(done)), "completed").when(F.bool_or(is_(failed)), "failed").when(F.bool_or(is_(running)), "processing").otherwise("scheduled")
    return rows.groupBy(recording).agg(state.alias("overall"), F.count("*").alias("jobs"), F.count(F.when(is_(failed), 1)).alias("failed"))


# ---- pipelines: phases as rows, jobs as phases times specifiers

#: name, needed phase, whether the phase has a job for each specifier, and whether such a job needs only the one of its own specifier.
SINGLE = (("binarize", None, False, False), ("register", "binarize", True, False), ("process", "register", True, True), ("combine", "process", False, False))
MULTI = (("discover", None, False, False), ("extract", "discover", True, False))
_PIPELINE = "phase string, needs string, each boolean, same boolean, k int"


def phases(spark: SparkSession, pipeline: tuple = SINGLE) -> DataFrame:
    return spark.createDataFrame([(*row, k) for k, row in enumerate(pipeline)], _PIPELINE)


def universe(specifiers: DataFrame, recording: str, specifier: str, pipeline: tuple = SINGLE) -> DataFrame:
    """recording, phase, specifier (empty where the phase has one job), k (the phase's place) and job_id of all jobs that recordings need."""
    named = specifiers.select(F.col(recording).alias("recording"), F.col(specifier).cast("string").alias("specifier")).distinct()
    steps = F.broadcast(phases(specifiers.sparkSession, pipeline))
    each = named.join(steps.where("each")).select("recording", "phase", "specifier", "k")
    once = named.select("recording").distinct().join(steps.where("not each")).select("recording", "phase", F.lit("").alias("specifier"), "k")
    return each.unionAll(once).withColumn("job_id", job_id(F.col("recording"), F.col("phase"), F.col("specifier")))


def job_id(recording: Column, phase: Column, specifier: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", recording.cast("string"), phase, specifier), 256), 1, 16)


def prerequisites(jobs: DataFrame, pipeline: tuple = SINGLE) -> DataFrame:
    """job_id and needs_id: the jobs of the needed phase that a job waits for, all of them or that of its specifier."""
    steps = F.broadcast(phases(jobs.sparkSession, pipeline).select("phase", "needs", "same").where("needs is not null"))
    wanted = jobs.join(steps, "phase").select("recording", "specifier", "job_id", F.col("needs").alias("phase"), "same")
    there = jobs.select("recording", "phase", F.col("specifier").alias("other"), F.col("job_id").alias("needs_id"))
    return wanted.join(there, ["recording", "phase"]).where(~F.col("same") | (F.col("specifier") == F.col("other"))).select("job_id", "needs_id")


def runnable(jobs: DataFrame, edges: DataFrame, succeeded: DataFrame, submitted: DataFrame) -> DataFrame:
    """job_id, waits_for (needed jobs that neither succeeded nor are submitted) and runnable, of the submitted jobs."""
    fine = succeeded.select("job_id").union(submitted.select("job_id")).distinct().select(F.col("job_id").alias("needs_id"), F.lit(True).alias("fine"))
    open_ = edges.join(fine, "needs_id", "left").where("fine is null").groupBy("job_id").agg(F.count("*").alias("waits_for"))
    asked = jobs.join(submitted.select("job_id").distinct(), "job_id", "left_semi").select("job_id")
    return asked.join(open_, "job_id", "left").select("job_id", F.coalesce("waits_for", F.lit(0)).alias("waits_for"), F.col("waits_for").isNull().alias("runnable"))


def downstream(asked: DataFrame, recording: str, phase: str, pipeline: tuple = SINGLE) -> DataFrame:
    """recording and phase of every phase from the earliest asked one on; names that are no phase are left out."""
    steps = F.broadcast(phases(asked.sparkSession, pipeline).select(F.col("phase").alias("step"), "k"))
    first = asked.join(steps, F.col(phase) == F.col("step")).groupBy(F.col(recording).alias("recording")).agg(F.min("k").alias("first"))
    return first.join(steps, F.col("k") >= F.col("first")).select("recording", F.col("step").alias("phase"))


def execution_place(phase: Column, pipeline: tuple = SINGLE) -> list[Column]:
    """What to sort by: known phases by their place, then the others by name."""
    known = F.array_position(F.array(*(F.lit(p[0]) for p in pipeline)), phase)
    return [F.when(known > 0, known).asc_nulls_last(), phase.asc()]


def ready_single(planes: DataFrame, recording: str, converted: str, registered: str, processed: str) -> DataFrame:
    """recording, and how many jobs of each phase are ready: binarizing always, and the others once what they need is there."""
    flag = lambda c: F.coalesce(F.col(c).cast("int"), F.lit(0))
    return planes.groupBy(F.col(recording).alias("recording")).agg(
        F.lit(1).cast("long").alias("binarize"),
        F.sum(flag(converted)).alias("register"),
        F.sum(flag(registered)).alias("process"),
        F.min(flag(processed)).cast("long").alias("combine"),
    )


def ready_multi(recordings: DataFrame, dataset: str, processed: str, tracked: str) -> DataFrame:
    """dataset, whether it can be discovered (all recordings are processed), and how many recordings can be extracted."""
    flag = lambda c: F.coalesce(F.col(c).cast("int"), F.lit(0))
    return recordings.groupBy(F.col(dataset).alias("dataset")).agg((F.min(flag(processed)) == 1).alias("discover"), F.sum(flag(tracked)).alias("extract"))
