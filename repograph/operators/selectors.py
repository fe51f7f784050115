"""Selectors over nodes, edges, issues, flags, artifacts and jobs: predicates as columns, choices as filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text
from ..schemas import SEVERITIES

# Fixed values.
ENTRY_TYPES = ("Repository", "Module")
DEPENDENCIES = ("IMPORTS", "DEPENDS_ON")
ADVICE_KEYS = ("threshold", "recommendation", "suggestion")
ROWS_SHOWN, GROUPS_SHOWN, EVIDENCE_SHOWN = 40, 15, 5

# -- nodes and edges ------------------------------------------------------------------------


def is_entry_point(node_type: Column) -> Column:
    return F.coalesce(node_type.isin(*ENTRY_TYPES), F.lit(False))


def display_label(node_type: Column, label: Column) -> Column:
    return F.concat(node_type, F.lit(": "), label)


def is_dependency(relationship: Column) -> Column:
    return F.coalesce(relationship.isin(*DEPENDENCIES), F.lit(False))


def properties(stored: Column) -> Column:
    """The map that a JSON object holds; an empty one for null, malformed or other JSON."""
    return F.coalesce(F.from_json(stored, "map<string,string>"), F.create_map().cast("map<string,string>"))


def label_repeats(nodes: DataFrame) -> DataFrame:
    """Each node with ``same_label``, how many of its job have its label (null labels are one label)."""
    return nodes.withColumn("same_label", F.count(F.lit(1)).over(W.partitionBy("job_id", "label")))


# -- issues and flags -----------------------------------------------------------------------


def chosen(frame: DataFrame, **equal) -> DataFrame:
    """The rows that match every choice; None and 'all' choose everything."""
    for name, value in equal.items():
        if value not in (None, "all"):
            frame = frame.where(F.col(name) == value)
    return frame


def issues_at(issues: DataFrame, severity: str) -> DataFrame:
    """Issues of a severity; the critical ones count as high."""
    return issues.where(F.col("severity").isin("high", "critical") if severity == "high" else F.col("severity") == severity)


def severity_counts(issues: DataFrame) -> DataFrame:
    """job_id and a count for each severity, zero where a job has none of it."""
    return issues.groupBy("job_id").agg(*[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES])


def categories(issues: DataFrame) -> DataFrame:
    """job_id and its categories, distinct and sorted."""
    return issues.where("category is not null").groupBy("job_id").agg(F.sort_array(F.collect_set("category")).alias("categories"))


def evidence(of: Column) -> Column:
    """The first few entries of an issue's evidence, without the keys that hold advice."""
    left = F.filter(F.map_entries(of), lambda e: ~e["key"].isin(*ADVICE_KEYS))
    return F.coalesce(F.slice(left, 1, EVIDENCE_SHOWN), F.slice(F.map_entries(F.create_map(F.lit(""), F.lit(""))), 1, 0))


def shown(frame: DataFrame, order: list, everything: bool = False, most: int = ROWS_SHOWN) -> DataFrame:
    """The first rows in an order (``GROUPS_SHOWN`` is the number for groups), or all."""
    ordered = frame.orderBy(*order)
    return ordered if everything else ordered.limit(most)


# -- artifacts, jobs, questions -------------------------------------------------------------


def artifact_counts(artifacts: DataFrame) -> DataFrame:
    return artifacts.groupBy("job_id").agg(F.count(F.lit(1)).alias("n"))


def checked_tokens(query: Column) -> Column:
    """The words of a query that are searched for; an error if none has more than two characters."""
    words = F.array_compact(text.search_tokens(F.coalesce(query, F.lit(""))))
    return F.when(F.size(words) > 0, words).otherwise(F.raise_error(F.lit("the query is too short: no word has more than two characters")).cast("array<string>"))


def gate(asked: DataFrame, jobs: DataFrame, nodes: DataFrame) -> DataFrame:
    """job_id and verdict of each asked job: missing, not completed, no graph or ready.

    Jobs come as job_id and status, one row each; of nodes only which jobs have some is read.
    """
    there = nodes.select("job_id").distinct().withColumn("has_graph", F.lit(True))
    known = asked.select("job_id").distinct().join(jobs.select("job_id", "status", F.lit(True).alias("known")), "job_id", "left").join(there, "job_id", "left")
    verdict = F.when(F.col("known").isNull(), "missing").when(~F.col("status").eqNullSafe("completed"), "not completed").when(F.col("has_graph").isNull(), "no graph").otherwise("ready")
    return known.select("job_id", verdict.alias("verdict"))
