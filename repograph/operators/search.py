"""Keyword retrieval over nodes and facts, chat windows and fallback routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def relevance(words: Column, fields: list[tuple[Column, int]]) -> Column:
    """For each word and field, the field's weight if it contains the word (letter for letter, in lower case)."""
    total = F.lit(0)
    for field, weight in fields:
        low = F.lower(F.coalesce(field, F.lit("")))
        total = total + weight * F.size(F.filter(words, _inside(low)))
    return total


def _inside(low: Column):
    return lambda w: F.contains(low, w)


def top_nodes(nodes: DataFrame, words: Column, k: int = 8) -> DataFrame:
    """The k most relevant nodes of each job (label 3, file 2, path 1), ties by id."""
    score = relevance(words, [(F.col("label"), 3), (F.col("file"), 2), (F.col("path"), 1)])
    best = W.partitionBy("job_id").orderBy(F.desc("score"), "id")
    return nodes.withColumn("score", score).where("score > 0").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def context(nodes: DataFrame, words: Column, k: int = 8, modules: int = 6) -> DataFrame:
    """The relevant nodes of each job; without any its repositories and first modules."""
    found = top_nodes(nodes, words, k)
    without = nodes.where(F.col("node_type").isin("Repository", "Module")).join(found.select("job_id").distinct(), "job_id", "left_anti")
    order = W.partitionBy("job_id", "node_type").orderBy("id")
    spare = without.withColumn("place", F.row_number().over(order)).where((F.col("node_type") == "Repository") | (F.col("place") <= modules))
    rank = F.row_number().over(W.partitionBy("job_id").orderBy(F.desc("node_type"), "place"))
    return found.unionByName(spare.withColumn("score", F.lit(0)).withColumn("rank", rank).drop("place"))


def render_context(found: DataFrame) -> DataFrame:
    """job_id and the context as text, a section for each node type."""
    line = F.concat(F.lit("- `"), F.col("label"), F.lit("`"), F.when(F.length("file") > 0, F.concat(F.lit(" in `"), F.col("file"), F.lit("`"))).otherwise(""))
    sections = found.groupBy("job_id", "node_type").agg(F.min("rank").alias("first"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x["line"]), "\n").alias("body"))
    text = F.concat(F.lit("### "), F.col("node_type"), F.lit(" nodes:\n"), F.col("body"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("first", text.alias("t")))), lambda x: x["t"]), "\n\n")
    return sections.groupBy("job_id").agg(F.concat(F.lit("## Relevant code context from the repository:\n\n"), joined).alias("context"))


def search_facts(facts: DataFrame, words: Column, repo_url: str | None = None, k: int = 10) -> DataFrame:
    """The k best facts (symbol 3, text 2, file 1), of one repository if given; ties by id."""
    scoped = facts if repo_url is None else facts.where(F.col("repo_url") == repo_url)
    score = relevance(words, [(F.col("source_symbol"), 3), (F.col("text"), 2), (F.col("source_file"), 1)])
    return scoped.withColumn("score", score).where("score > 0").orderBy(F.desc("score"), "id").limit(k)


def history(messages: DataFrame, last: int = 6) -> DataFrame:
    """Of each session the last messages without the newest, oldest first by ``turn_no``."""
    newest = W.partitionBy("session_id").orderBy(F.desc("created_at"), F.desc("id"))
    return messages.withColumn("back", F.row_number().over(newest)).where((F.col("back") > 1) & (F.col("back") <= last))


def sessions_with_messages(messages: DataFrame) -> DataFrame:
    """A row for each session with its messages in order."""
    return messages.groupBy("session_id").agg(F.sort_array(F.collect_list(F.struct("created_at", "id", "role", "content"))).alias("messages"))


def intent(question: Column) -> Column:
    """Which fallback answers a question: the first group of words that occurs."""
    low = F.lower(question)
    return F.when(low.rlike("what|describe|explain"), "context").when(low.rlike("how many|count|total"), "counts").otherwise("context")
