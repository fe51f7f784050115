"""Tables of the engine as Parquet folders: scans by job, appends, upserts and deletes without MERGE.

Tables are partitioned by job, so a scan or a ``delete_job`` touches that job's files only.  An upsert, update or
delete by condition finds the jobs that it touches, writes these anew beside the table and puts their folders in place of
the old ones; other jobs' files stay as they are.  A ``replace``, or a change of more than ``MANY`` jobs, writes a new version of
the whole table and moves a pointer file in one step; versions are kept until ``vacuum``.

Changes are numbered.  A writer notes the number before it reads and must be the one that makes the next; of two writers that
have read the same state the second one raises ``LostRace`` and leaves nothing behind, so no update is lost.
"""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


MANY = 1000  # jobs whose folders are put in place one by one


class LostRace(RuntimeError):
    """Another writer has changed the table since it was read."""


class Table:
    """A versioned Parquet table."""

    def __init__(self, spark: SparkSession, path: str, schema: str, partition: str | None = "job_id"):
        self.spark, self.path, self.schema, self.partition = spark, path.rstrip("/"), schema, partition

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/_current")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path, jvm

    def _state(self) -> tuple[str | None, int]:
        """The current version's folder, and the number of the last change."""
        fs, path, _ = self._fs()
        if not fs.exists(path):
            return None, 0
        stream = fs.open(path)
        try:
            folder, _, number = bytes(stream.readAllBytes()).decode().partition(" ")
        finally:
            stream.close()
        return folder, int(number or 0)

    def _version(self) -> str | None:
        return self._state()[0]

    def _claim(self, number: int, staged: str | None = None) -> None:
        """Makes the change of this number ours, or removes what was staged and raises."""
        fs, _, jvm = self._fs()
        try:
            fs.create(jvm.org.apache.hadoop.fs.Path(f"{self.path}/_changes/{number}"), False).close()
        except Py4JJavaError as e:
            if staged:
                fs.delete(jvm.org.apache.hadoop.fs.Path(staged), True)
            raise LostRace(f"{self.path}: change {number} is another writer's") from e

    def _point_to(self, version: str) -> None:
        fs, path, jvm = self._fs()
        hadoop, gateway = jvm.org.apache.hadoop.fs, self.spark.sparkContext._gateway
        beside = hadoop.Path(f"{self.path}/_next-{uuid.uuid4().hex}")
        stream = fs.create(beside, True)
        stream.write(bytearray(version.encode()))
        stream.close()
        kind = getattr(hadoop, "Options$Rename")
        over = gateway.new_array(kind, 1)
        over[0] = kind.OVERWRITE
        hadoop.FileContext.getFileContext(fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration()).rename(beside, path, over)

    def read(self) -> DataFrame:
        version = self._version()
        if version is None:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/{version}")

    def _write(self, rows: DataFrame, folder: str, mode: str) -> None:
        writer = rows.write.mode(mode)
        (writer.partitionBy(self.partition) if self.partition else writer).parquet(folder)

    def replace(self, rows: DataFrame, number: int | None = None) -> None:
        """A new version of the whole table; ``number``: that of the last change when ``rows`` were read, or now."""
        number = self._state()[1] if number is None else number
        version = f"v-{uuid.uuid4().hex}"
        self._write(rows, f"{self.path}/{version}", "errorifexists")
        self._claim(number + 1, f"{self.path}/{version}")
        self._point_to(f"{version} {number + 1}")

    def _change(self, touched: DataFrame, changed) -> None:
        """Rewrites the jobs of ``touched`` (job_id): ``changed`` turns their rows, or all, into what they shall be."""
        version, number = self._state()
        jobs = [r[0] for r in touched.distinct().limit(MANY + 1).collect()] if version and self.partition == "job_id" else [None]
        if not jobs:
            return
        if None in jobs or len(jobs) > MANY:
            self.replace(changed(self.read()), number)
            return
        staged = f"{self.path}/s-{uuid.uuid4().hex}"
        self._write(changed(self.read().where(F.col("job_id").isin(jobs))), staged, "errorifexists")
        self._claim(number + 1, staged)
        fs, _, jvm = self._fs()
        hadoop = jvm.org.apache.hadoop.fs.Path
        for job in jobs:
            name = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.getPartitionPathString("job_id", job)
            fs.delete(hadoop(f"{self.path}/{version}", name), True)
            if fs.exists(hadoop(staged, name)):
                fs.rename(hadoop(staged, name), hadoop(f"{self.path}/{version}", name))
        fs.delete(hadoop(staged), True)
        self._point_to(f"{version} {number + 1}")

    def append(self, rows: DataFrame) -> None:
        version = self._version()
        if version is None:
            self.replace(rows)
        else:
            self._write(rows, f"{self.path}/{version}", "append")
            if self._version() != version:
                raise LostRace(f"{self.path}: the table was replaced while rows were added")

    def insert_if_absent(self, rows: DataFrame, key: str = "id") -> None:
        """The first row of a key stays."""
        self.append(absent(self.read(), rows, key))

    def upsert(self, rows: DataFrame, keys: tuple[str, ...] = ("id",), keep: tuple[str, ...] = ("job_id", "created_at")) -> None:
        if "job_id" not in rows.columns or self.partition != "job_id":
            number = self._state()[1]
            self.replace(merged(self.read(), rows, keys, keep), number)
            return
        known = self.read().join(rows.select(*keys).distinct(), list(keys), "left_semi").select("job_id")
        self._change(known.unionByName(rows.select("job_id")), lambda old: merged(old, rows, keys, keep))

    def update(self, condition: Column, **values) -> None:
        def changed(rows: DataFrame) -> DataFrame:
            for name, value in values.items():
                rows = rows.withColumn(name, F.when(condition, value if isinstance(value, Column) else F.lit(value)).otherwise(F.col(name)).cast(rows.schema[name].dataType))
            return rows

        if self.partition in values:  # rows move to other jobs
            number = self._state()[1]
            self.replace(changed(self.read()), number)
        else:
            self._change(self._jobs_of(condition), changed)

    def delete(self, condition: Column) -> int:
        """Removes rows; returns how many."""
        n = self.read().where(condition).count()
        if n:
            self._change(self._jobs_of(condition), lambda rows: rows.where(~F.coalesce(condition, F.lit(False))))
        return n

    def _jobs_of(self, condition: Column) -> DataFrame:
        rows = self.read().where(condition)
        return rows.select("job_id") if self.partition == "job_id" else rows.select(F.lit(None).alias("job_id"))

    def delete_job(self, job_id: str) -> int:
        """Removes the folder of one job from the current version; returns how many rows it had.

        Other jobs' files are neither read nor written.  Readers that have already listed the folder fail.
        """
        if self.partition != "job_id":
            return self.delete(F.col("job_id") == job_id)
        version = self._version()
        n = self.read().where(F.col("job_id") == job_id).count()
        if n:
            fs, _, jvm = self._fs()
            name = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.getPartitionPathString("job_id", job_id)
            fs.delete(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{version}", name), True)
        return n

    def vacuum(self) -> None:
        """Removes versions that are not current."""
        fs, path, jvm = self._fs()
        current = self._version()
        for status in fs.listStatus(path.getParent()):
            name = status.getPath().getName()
            if name.startswith("v-") and name != current:
                fs.delete(status.getPath(), True)


def delete_graph(nodes: Table, edges: Table, job_id: str) -> tuple[int, int]:
    """Removes a job's edges, then its nodes; how many nodes and edges there were."""
    n_edges = edges.delete_job(job_id)
    return nodes.delete_job(job_id), n_edges


def absent(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose key is not there yet, one for each key."""
    return new.dropDuplicates([key]).join(old.select(key), key, "left_anti").select(new.columns)


def merged(old: DataFrame, new: DataFrame, keys: tuple[str, ...], keep: tuple[str, ...] = (), seq: str | None = None) -> DataFrame:
    """Last write wins by key; the columns ``keep`` stay as first written."""
    versions = old.withColumn("__v", F.lit(0)).withColumn("__s", F.lit(0).cast("long")).unionByName(new.withColumn("__v", F.lit(1)).withColumn("__s", F.col(seq).cast("long") if seq else F.lit(0).cast("long")), allowMissingColumns=True)
    last, first = W.partitionBy(*keys).orderBy(F.desc("__v"), F.desc("__s")), W.partitionBy(*keys).orderBy("__v", "__s")
    for name in keep:
        if name in old.columns and name not in keys:
            versions = versions.withColumn(f"__{name}", F.first(name).over(first))
    top = versions.withColumn("__rn", F.row_number().over(last)).where("__rn = 1")
    for name in keep:
        if f"__{name}" in top.columns:
            top = top.withColumn(name, F.col(f"__{name}"))
    return top.select(old.columns)


# -- scans ----------------------------------------------------------------------------------


def by_job(frame: DataFrame, job_id: str, node_type: str | None = None, relationship: str | None = None) -> DataFrame:
    out = frame.where(F.col("job_id") == job_id)
    if node_type:
        out = out.where(F.col("node_type") == node_type)
    return out.where(F.col("relationship") == relationship) if relationship else out


def newest(frame: DataFrame, limit: int | None = None, by: str = "created_at", **equal) -> DataFrame:
    """Rows that match, newest first; a value of None or 'all' matches everything."""
    for name, value in equal.items():
        if value not in (None, "all"):
            frame = frame.where(F.col(name) == value)
    ordered = frame.orderBy(F.desc(by), "id")
    return ordered.limit(limit) if limit else ordered


def checked_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges, or an error if an end of one is missing."""
    ids = nodes.select("job_id", "id").distinct()
    for end in ("source_id", "target_id"):
        there = ids.withColumnRenamed("id", end).withColumn("__there", F.lit(True))
        edges = edges.join(there, ["job_id", end], "left")
        edges = edges.withColumn(end, F.when(F.col("__there"), F.col(end)).otherwise(F.raise_error(F.concat(F.lit("no such node: "), F.col(end))))).drop("__there")
    return edges


def completed_graph(jobs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes of completed jobs only: what a report may be computed from."""
    return nodes.join(jobs.where("status = 'completed'").select(F.col("id").alias("job_id")), "job_id", "left_semi")
