"""Dependencies between files: coupling, instability, fan-in and fan-out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def internal_dependencies(files: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct job_id, source_id, target_id of imports between the files, without those of a file to itself."""
    ids = files.select("job_id", "id")
    wanted = edges.where(F.col("relationship").isin("IMPORTS", "DEPENDS_ON") & (F.col("source_id") != F.col("target_id"))).select("job_id", "source_id", "target_id").distinct()
    for end in ("source_id", "target_id"):
        wanted = wanted.join(ids.withColumnRenamed("id", end), ["job_id", end], "left_semi")
    return wanted.select("job_id", "source_id", "target_id")


def coupling(files: DataFrame, edges: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """job_id, id, ce, ca, instability (null without any dependency) of each file; ``pairs``: the internal dependencies, where they are known.

    One union of both ends and one aggregation; dependencies are distinct, so counts are distinct counts.
    """
    pairs = internal_dependencies(files, edges) if pairs is None else pairs
    ends = pairs.select("job_id", F.col("source_id").alias("id"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionAll(pairs.select("job_id", F.col("target_id").alias("id"), F.lit(0), F.lit(1)))
    counts = files.select("job_id", "id", F.lit(0).alias("out"), F.lit(0).alias("into")).unionAll(ends).groupBy("job_id", "id").agg(F.sum("out").alias("ce"), F.sum("into").alias("ca"))
    total = F.col("ce") + F.col("ca")
    return counts.withColumn("instability", F.when(total > 0, F.col("ce") / total))


def average_instability(metrics: DataFrame) -> DataFrame:
    return metrics.groupBy("job_id").agg(F.coalesce(F.avg("instability"), F.lit(0.0)).alias("avg_instability"))


def fans(edges: DataFrame, relationships=("IMPORTS", "DEPENDS_ON", "CALLS"), distinct: bool = False) -> DataFrame:
    """job_id, id, fan_in, fan_out; an import counts once for each of its edges unless ``distinct``."""
    wanted = edges.where(F.col("relationship").isin(*relationships)).select("job_id", "source_id", "target_id")
    wanted = wanted.distinct() if distinct else wanted
    ends = wanted.select("job_id", F.col("source_id").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionAll(wanted.select("job_id", F.col("target_id").alias("id"), F.lit(1), F.lit(0)))
    return ends.groupBy("job_id", "id").agg(F.sum("i").alias("fan_in"), F.sum("o").alias("fan_out"))


def incident_edges(edges: DataFrame, node_id: str) -> DataFrame:
    return edges.where((F.col("source_id") == node_id) | (F.col("target_id") == node_id))


def resolve_owner(symbols: DataFrame, files: DataFrame, classes: DataFrame, edges: DataFrame) -> DataFrame:
    """file_id of each symbol (job_id, id, file): the file that holds it, else its class's file, else the file of its path.

    Three outer joins and a coalesce, in that order whatever the order of the edges.
    """
    held = edges.where("relationship = 'CONTAINS'").select("job_id", F.col("source_id").alias("holder"), F.col("target_id").alias("id"))
    of_file = held.join(files.select("job_id", F.col("id").alias("holder")), ["job_id", "holder"], "left_semi").groupBy("job_id", "id").agg(F.max("holder").alias("direct"))
    of_class = held.join(classes.select("job_id", F.col("id").alias("holder")), ["job_id", "holder"], "left_semi").groupBy("job_id", "id").agg(F.max("holder").alias("class_id"))
    through = of_class.join(of_file.select("job_id", F.col("id").alias("class_id"), F.col("direct").alias("via_class")), ["job_id", "class_id"]).select("job_id", "id", "via_class")
    by_path = files.groupBy("job_id", F.col("path").alias("file")).agg(F.max("id").alias("by_path"))
    found = symbols.join(of_file, ["job_id", "id"], "left").join(through, ["job_id", "id"], "left").join(by_path, ["job_id", "file"], "left")
    return found.withColumn("file_id", F.coalesce("direct", "via_class", "by_path")).drop("direct", "via_class", "by_path")
