"""Job state: legal transitions, latest states and counts over an append-only log of events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..schemas import JOB_STATUSES, TERMINAL

# Legal steps of a job; a step to the same state is an accepted repeat where listed.
TRANSITIONS = (("pending", "running"), ("running", "running"), ("running", "completed"), ("completed", "completed"), ("pending", "failed"), ("running", "failed"), ("failed", "failed"), ("pending", "cancelled"), ("running", "cancelled"))


def is_terminal(status: Column) -> Column:
    return status.isin(*TERMINAL)


def can_cancel(status: Column) -> Column:
    return status.isin("pending", "running")


def can_retry(status: Column) -> Column:
    return status == "failed"


def legal(before: Column, after: Column) -> Column:
    steps = F.array(*[F.lit(f"{a}>{b}") for a, b in TRANSITIONS])
    return F.array_contains(steps, F.concat(before, F.lit(">"), after))


def fold(events: DataFrame) -> DataFrame:
    """job_id, status, accepted, rejected: each job's events in order, illegal ones left out; jobs begin as pending.

    events: job_id, at, seq, status.
    """
    ordered = events.groupBy("job_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "seq", "status"))), lambda e: e["status"]).alias("steps"))
    start = F.struct(F.lit("pending").alias("status"), F.lit(0).alias("accepted"), F.lit(0).alias("rejected"))

    def step(acc: Column, to: Column) -> Column:
        ok = legal(acc["status"], to)
        return F.struct(F.when(ok, to).otherwise(acc["status"]).alias("status"), (acc["accepted"] + ok.cast("int")).alias("accepted"), (acc["rejected"] + (~ok).cast("int")).alias("rejected"))

    return ordered.select("job_id", F.aggregate("steps", start, step).alias("end")).select("job_id", "end.*")


def latest(log: DataFrame, key: str, order: list) -> DataFrame:
    """The last row of each key: a view of current states over a log."""
    w = W.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return log.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def status_counts(jobs: DataFrame) -> DataFrame:
    """All statuses with their number of jobs, zeros included."""
    names = jobs.sparkSession.createDataFrame([(s,) for s in JOB_STATUSES], "status string")
    counts = jobs.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    return names.join(counts, "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))


def fail_orphans(jobs: DataFrame) -> DataFrame:
    """What a restart does: unfinished jobs have failed."""
    lost = F.col("status").isin("pending", "running")
    return jobs.withColumn("error_message", F.when(lost, "interrupted by a restart").otherwise(F.col("error_message"))).withColumn("status", F.when(lost, "failed").otherwise(F.col("status")))


def retry(jobs: DataFrame) -> DataFrame:
    """New pending jobs for failed ones."""
    return jobs.where(can_retry(F.col("status"))).select(F.sha2(F.concat_ws("|", F.lit("retry"), "id"), 256).alias("id"), "repo_url", "artifact_type", F.lit("pending").alias("status"), F.lit(None).cast("string").alias("error_message"))
