"""Session plumbing the operators share: workers' import path, shared storage, row identity."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


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


def cores(spark: SparkSession) -> int | None:
    """The cores that the cluster may have; None where it may grow without a bound that is set."""
    conf = spark.sparkContext.getConf()
    of_one = int(conf.get("spark.executor.cores", "1"))
    known = max(spark.sparkContext.defaultParallelism, int(conf.get("spark.executor.instances", "0")) * of_one)
    if conf.get("spark.dynamicAllocation.enabled", "false").lower() != "true":
        return known
    most = conf.get("spark.dynamicAllocation.maxExecutors")
    return max(known, int(most) * of_one) if most else None


def fewer(df: DataFrame) -> DataFrame:
    """The frame in at most two partitions for each core that the cluster may have, so that small ones are not written as very many files.

    The limit reaches back into the stage before it, so this is for what comes from an exchange of narrow rows, not for scans.
    """
    most = cores(df.sparkSession)
    return df.coalesce(2 * most) if most else df


def cut(df: DataFrame, scans: bool = False) -> DataFrame:
    """Cut the lineage with a reliable checkpoint: for narrow tables that several plans read.  ``scans``: the frame's stage reads a
    table, and keeps as many tasks as that has partitions."""
    shared_dir(df.sparkSession)
    return (df if scans else fewer(df)).checkpoint(eager=True)


def table(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it again: for wide intermediate rows."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/repograph-{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def remove(*tables: DataFrame) -> None:
    """Delete what ``table`` wrote, once nothing that is still to run reads it."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.written_to)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def same_columns(df: DataFrame) -> list:
    """The columns of a frame as they are, whatever their names hold."""
    return [F.col(f"`{c.replace('`', '``')}`") for c in df.columns]


def numbered(df: DataFrame) -> DataFrame:
    """The frame with plain column names, as functions over Arrow batches cannot take all names."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def places(df: DataFrame, *names: str) -> list[int]:
    """Where the columns of exactly these names are, or where there is no such column the first that differs in case only."""
    found = []
    for name in names:
        at = [i for i, c in enumerate(df.columns) if c == name] or [i for i, c in enumerate(df.columns) if c.lower() == name.lower()]
        if not at:
            raise ValueError(f"no column {name} among {df.columns}")
        found.append(at[0])
    return found


def pick(df: DataFrame, *names: str) -> list:
    """The frame with plain column names, and its columns of these names; others may clash."""
    return [numbered(df), *(F.col(f"c{i}").alias(name) for i, name in zip(places(df, *names), names))]


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")
