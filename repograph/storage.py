"""Cutting lineage for loops, and keeping frames that many plans read."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def ready(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package when the cluster has not shipped it already."""
    env = spark.sparkContext.environment
    parts = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in parts:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *parts])
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or in local mode one of our own where that is unset."""
    context = spark.sparkContext
    told = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not told:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        told = tempfile.mkdtemp(prefix="repograph-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(told)
    return told.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table(df: DataFrame, label: str, by: list[str] | None = None) -> DataFrame:
    """``df`` written once as Parquet in the shared folder, in folders by the columns ``by``, and read again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/repograph-{label}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*by) if by else writer).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def written(df: DataFrame) -> DataFrame:
    """Cuts the lineage by a written table: for loops, as a checkpoint keeps what the planner has inferred of its columns, which grows in each round."""
    return table(df, "step")


def keep(df: DataFrame) -> DataFrame:
    """Held in memory and on disk while plans read it; lost parts are computed again."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def shuffled(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """A join of frames that both grow with the input, so that neither is ever sent through the driver: a file of keys is small, but not what is made of it."""
    return left.join(right.hint("merge"), on, how)


def tasks(rows: int, most: int = 250_000) -> int:
    """How many tasks hold ``rows`` rows when none is to hold more than about ``most``: a count told to repartition is not coalesced, so what a task sorts does not grow with the input."""
    return max(1, -(-rows // most))


def slots(df: DataFrame) -> int:
    """Four tasks for each core that the cluster has."""
    context = df.sparkSession.sparkContext
    conf = context.getConf()
    return 4 * max(context.defaultParallelism, int(conf.get("spark.executor.instances", "0")) * int(conf.get("spark.executor.cores", "1")))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys`` to ``slots`` tasks: for costly work on rows whose own file is small, as that is read by a task or two."""
    return df.repartition(slots(df), *keys)
