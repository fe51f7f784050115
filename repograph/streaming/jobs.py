"""Live job states: a stream of events folded by the legal transitions, and windowed counts.

Events reach a stream in any order, but a job's state depends on their order by (at, seq).  So each job keeps, beside
its settled state, the events that the watermark has not passed.  A timer at the earliest of them folds what has become
final and frees it.  Every micro-batch that touches a job reports the state with all its waiting events folded in order, so what is reported
last does not depend on how the stream was cut into micro-batches.  Events behind the watermark are dropped by Spark, which
counts them.  A job in a terminal state without events for ``expiry`` is forgotten; if one comes later, it begins anew.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.jobs import TRANSITIONS
from ..schemas import TERMINAL
from ..storage import ready, shared_dir

EVENTS = "job_id string, at timestamp, seq long, status string"
STATES = "job_id string, status string, accepted int, rejected int"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY = 86_400_000


def read_events(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(EVENTS).parquet(folder)


def folded(state: tuple[str, int, int], steps: list[str]) -> tuple[str, int, int]:
    status, accepted, rejected = state
    for step in steps:
        if (status, step) in TRANSITIONS:
            status, accepted = step, accepted + 1
        else:
            rejected += 1
    return status, accepted, rejected


class JobFold(StatefulProcessor):
    """The state of one job: what is settled, and the events that may still be overtaken."""

    def __init__(self, expiry_ms: int):
        self.expiry_ms = expiry_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.settled = handle.getValueState("settled", "status string, accepted int, rejected int, last_ms long")
        self.waiting = handle.getMapState("waiting", "at_us long, seq long", "status string")

    def now(self) -> tuple[tuple[str, int, int], int]:
        if not self.settled.exists():
            return ("pending", 0, 0), -1
        status, accepted, rejected, last = self.settled.get()
        return (status, accepted, rejected), last

    def set_timer(self, at_ms: int) -> None:
        """The job's only timer."""
        for other in list(self.handle.listTimers()):
            self.handle.deleteTimer(other)
        self.handle.registerTimer(at_ms)

    def next_timer(self, last: int) -> None:
        ahead = [k[0] // 1000 for k in self.waiting.keys()]
        self.set_timer(min(ahead) + 1 if ahead else last + self.expiry_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            for at, seq, status in zip(batch["at"], batch["seq"], batch["status"]):
                self.waiting.updateValue((at.value // 1000, int(seq)), (status,))
        state, last = self.now()
        events = sorted((k[0], k[1], v[0]) for k, v in self.waiting.iterator())
        last = max(last, events[-1][0] // 1000)
        self.settled.update((*state, last))
        self.next_timer(last)
        end = folded(state, [e[2] for e in events])
        yield pd.DataFrame([(key[0], *end)], columns=["job_id", "status", "accepted", "rejected"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed, (state, last) = timerValues.getCurrentWatermarkInMs(), self.now()
        final = sorted((k[0], k[1], v[0]) for k, v in self.waiting.iterator() if k[0] // 1000 < passed)
        for at, seq, _ in final:
            self.waiting.removeKey((at, seq))
        state = folded(state, [e[2] for e in final])
        if not self.waiting.exists() and passed >= last + self.expiry_ms and state[0] in TERMINAL:
            self.settled.clear()
        else:
            self.settled.update((*state, last))
            if final or self.waiting.exists():
                self.next_timer(last)
        return iter([])  # what was reported holds the waiting events already


def states(events: DataFrame, late: str = "1 hour", expiry_ms: int = 30 * DAY) -> DataFrame:
    """The state of every job that a micro-batch touched (output mode update)."""
    spark = events.sparkSession
    ready(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    watched = events.select("job_id", "at", "seq", "status").withWatermark("at", late)
    return watched.groupBy("job_id").transformWithStateInPandas(JobFold(expiry_ms), STATES, "Update", "EventTime")


def run_states(events: DataFrame, late: str = "1 hour", expiry_ms: int = 30 * DAY, checkpoint: str | None = None) -> DataFrame:
    """The last reported state of each job after all that the stream has now.

    Each micro-batch is a folder that a repeated attempt overwrites.  ``checkpoint``: a folder of an earlier run that goes on from there.
    """
    spark = events.sparkSession
    home = checkpoint or f"{shared_dir(spark)}/repograph-stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{home}/out/number={number}")

    stream = states(events, late, expiry_ms).writeStream.outputMode("update").option("checkpointLocation", f"{home}/checkpoint").trigger(availableNow=True).foreachBatch(write).start()
    stream.awaitTermination()
    told = spark.read.schema(STATES + ", batch long").parquet(f"{home}/out/number=*")
    newest = W.partitionBy("job_id").orderBy(F.desc("batch"))
    return told.withColumn("place", F.row_number().over(newest)).where("place = 1").drop("place", "batch")


def counts(events: DataFrame, window: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Events by status in tumbling windows, closed by the watermark."""
    return events.withWatermark("at", late).groupBy(F.window("at", window), "status").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "status", "n")
