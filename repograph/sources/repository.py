"""Repositories as sources: a file-tree data source, selection of code files, and contents."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import rules
from ..functions.text import extension
from ..storage import ready

FILES = "job_id string, path string, name string, size long, content string"


class Folder(InputPartition):
    def __init__(self, top: str, paths: list[str]):
        super().__init__(top)
        self.top, self.paths = top, paths


class TreeReader(DataSourceReader):
    """Lists a checked-out tree on the driver and reads its files in batches on the executors."""

    def __init__(self, options):
        self.top = options.get("path")
        self.job = options.get("job_id", "")
        self.batch = int(options.get("files_per_task", "200"))
        self.skip = {".git"}

    def partitions(self):
        paths = []
        for folder, dirs, names in os.walk(self.top):
            dirs[:] = sorted(d for d in dirs if d not in self.skip)
            paths += [os.path.relpath(os.path.join(folder, n), self.top) for n in sorted(names)]
        return [Folder(self.top, paths[i : i + self.batch]) for i in range(0, len(paths), self.batch)] or [Folder(self.top, [])]

    def read(self, partition):
        for path in partition.paths:
            full = os.path.join(partition.top, path)
            size = os.path.getsize(full)
            with open(full, "rb") as f:
                try:
                    text = f.read().decode("utf-8")
                except UnicodeDecodeError:
                    text = None
            yield self.job, path.replace(os.sep, "/"), os.path.basename(path), size, text


class Tree(DataSource):
    """``spark.read.format("repository_tree").option("path", ...).option("job_id", ...)``."""

    @classmethod
    def name(cls):
        return "repository_tree"

    def schema(self):
        return FILES

    def reader(self, schema):
        return TreeReader(self.options)


def register(spark: SparkSession) -> None:
    ready(spark).dataSource.register(Tree)


def read_tree(spark: SparkSession, path: str, job_id: str) -> DataFrame:
    register(spark)
    return spark.read.format("repository_tree").option("path", path).option("job_id", job_id).load()


def decode_content(encoded: Column) -> Column:
    """Text of a file that an API gave in base 64, line breaks inside or not."""
    return F.decode(F.unbase64(F.regexp_replace(encoded, r"\s", "")), "UTF-8")


def code_files(files: DataFrame, most: int = 150) -> DataFrame:
    """Of each job the largest files of fetched languages, ties by path."""
    wanted = files.where(extension(F.col("path")).isin(*rules.FETCHED_EXTENSIONS))
    order = W.partitionBy("job_id").orderBy(F.desc("size"), "path")
    return wanted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).drop("rank")


def is_code_file(path: Column) -> Column:
    return extension(path).isin(*rules.CODE_EXTENSIONS)


def is_config_file(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1).isin(*rules.CONFIG_NAMES) | extension(path).isin(".yaml", ".yml", ".toml", ".json")
